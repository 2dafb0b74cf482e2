"""Probabilities for classifiers that only give margins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sigmoid per class: (slope, offset) of 1 / (1 + exp(slope * margin + offset)).
Sigmoids = list[tuple[float, float]]


def _lookup(values: list[float], place: Column) -> Column:
    return F.get(F.array(*(F.lit(float(v)) for v in values)), place)


def _likelihood_sums(cells: DataFrame, sigmoids: Sigmoids) -> dict[int, dict]:
    """Per class the loss at its sigmoid, its gradient and its curvature: one aggregate over all rows."""
    m, t = F.col("margin"), F.col("wanted")
    z = _lookup([a for a, _ in sigmoids], F.col("class")) * m + _lookup([b for _, b in sigmoids], F.col("class"))
    p = F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
    loss = t * z + F.when(z >= 0, F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)) - z)
    d, c = t - p, p * (1 - p)
    sums = cells.groupBy("class").agg(
        F.sum(loss).alias("loss"), F.sum(m * d).alias("ga"), F.sum(d).alias("gb"),
        F.sum(m * m * c).alias("haa"), F.sum(m * c).alias("hab"), F.sum(c).alias("hbb"))
    return {r["class"]: r.asDict() for r in sums.collect()}  # one row per class


def platt_sigmoids(scored: DataFrame, label: str, margins: Column, classes: int, rounds: int = 40) -> Sigmoids:
    """Sigmoids that turn each class's margin into its probability, fitted to margins of rows the model did not see.

    Targets are pulled towards one half by the class sizes, so that separable classes keep finite slopes.  Each Newton
    step of all classes is one aggregate; a step that makes a class's loss larger is halved.
    A class without rows, or with nothing else, gets its prior.
    """
    cells = scored.select(F.col(label).cast("int").alias("own"), F.posexplode(margins).alias("class", "margin"))
    sizes = {r["class"]: (r["hits"], r["rest"]) for r in cells.groupBy("class").agg(
        F.count_if(F.col("own") == F.col("class")).alias("hits"),
        F.count_if(F.col("own") != F.col("class")).alias("rest")).collect()}
    pairs = [sizes.get(c, (0, 0)) for c in range(classes)]
    high, low = [(h + 1) / (h + 2) for h, _ in pairs], [1 / (r + 2) for _, r in pairs]
    cells = cells.select("class", "margin", F.when(F.col("own") == F.col("class"), _lookup(high, F.col("class")))
                         .otherwise(_lookup(low, F.col("class"))).alias("wanted"))
    held: Sigmoids = [(0.0, math.log((r + 1) / (h + 1))) for h, r in pairs]
    tried, best, step = list(held), [math.inf] * classes, [(0.0, 0.0)] * classes
    moving = {c for c, (h, r) in enumerate(pairs) if h and r}
    for _ in range(rounds):
        if not moving:
            break
        sums = _likelihood_sums(cells.where(F.col("class").isin(*sorted(moving))), tried)
        for c in sorted(moving):
            s = sums[c]
            if s["loss"] > best[c]:
                step[c] = (step[c][0] / 2, step[c][1] / 2)
                if max(map(abs, step[c])) < 1e-10:
                    moving.discard(c)
            else:
                held[c], best[c] = tried[c], s["loss"]
                haa, hbb = s["haa"] + 1e-12, s["hbb"] + 1e-12
                det = haa * hbb - s["hab"] ** 2
                step[c] = (-(hbb * s["ga"] - s["hab"] * s["gb"]) / det, -(haa * s["gb"] - s["hab"] * s["ga"]) / det)
                if max(abs(s["ga"]), abs(s["gb"])) < 1e-7 * max(1, sum(pairs[c])):
                    moving.discard(c)
            tried[c] = (held[c][0] + step[c][0], held[c][1] + step[c][1])
    return held


def calibrated(margins: Column, sigmoids: Sigmoids) -> Column:
    """The classes' probabilities, which sum to one."""
    a, b = (F.array(*(F.lit(float(s[i])) for s in sigmoids)) for i in (0, 1))
    single = F.transform(margins, lambda m, i: 1 / (1 + F.exp(F.get(a, i) * m + F.get(b, i))))
    total = F.aggregate(single, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(single, lambda p: F.when(total > 0, p / total).otherwise(F.lit(1.0 / len(sigmoids))))
