"""Exact order statistics and rank sums against numpy, with hot groups and hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendmill.operators.evaluate import roc_auc
from trendmill.operators.ordering import order_breaks
from trendmill.operators.ranks import column_quantiles, exact_quantiles


@pytest.mark.parametrize("shape", ["uniform", "heavy", "negative", "constant", "hot"])
def test_quantiles_equal_numpy(spark, shape):
    rng = np.random.default_rng(3)
    values = {"uniform": rng.uniform(0, 1, 5000), "heavy": np.floor(np.exp(rng.normal(10, 3, 5000))),
              "negative": rng.normal(0, 1000, 5000), "constant": np.full(500, 7.0),
              "hot": np.concatenate([np.full(4000, 12345.0), rng.uniform(0, 1e6, 2000)])}[shape]
    groups = ["big" if i % 3 else "small" for i in range(len(values))]
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)] + [("big", None), (None, 1.0)],
                               "g string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for name in ("big", "small"):
        mine = values[np.array(groups) == name]
        for column, p in probs.items():
            assert got[name][column] == pytest.approx(np.quantile(mine, p), rel=1e-12, abs=1e-12)
    assert got[None].p50 == 1.0


def test_quantiles_without_groups_and_by_column(spark):
    df = spark.range(1001).select(F.col("id").alias("a"), (F.col("id") * -2).alias("b"))
    assert exact_quantiles(df, [], "a", {"m": 0.5}).first().m == 500
    got = {r.column: (r.q1, r.q3) for r in column_quantiles(df, ["a", "b"], {"q1": 0.25, "q3": 0.75}).collect()}
    assert got == {"a": (250.0, 750.0), "b": (-1500.0, -500.0)}


def test_auc_with_ties(spark):
    rng = np.random.default_rng(5)
    score = np.round(rng.uniform(-1, 1, 600), 1)
    label = (rng.uniform(size=600) < (score + 1) / 2).astype(int)
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(label, score)], "y int, s double")
    pos, neg = score[label == 1], score[label == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert roc_auc(df, "y", "s").first().roc_auc == pytest.approx(wins / (len(pos) * len(neg)))


def test_order_breaks_across_segments_and_ties(spark):
    rng = np.random.default_rng(8)
    order = rng.integers(0, 400, 3000)
    order[:1000] = 77  # a hot order number
    value = rng.integers(0, 50, 3000)
    df = spark.createDataFrame([(int(o), int(v)) for o, v in zip(order, value)], "o long, v long")
    line = sorted(zip(order.tolist(), value.tolist()))
    want = sum(b[1] < a[1] for a, b in zip(line, line[1:]))
    got = order_breaks(df, "o", F.col("v"), span=32).first()
    assert (got.checked, got.breaks) == (3000, want)
