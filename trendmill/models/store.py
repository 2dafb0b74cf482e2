"""Models that are fitted once and loaded by every later caller.

An entry is named by a hash of the training rows, the features and all parameters, so other data or another
parameter is another entry.  It lives in the shared scratch folder: models fitted under one
``spark.checkpoint.dir`` serve every session that names it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from threading import BoundedSemaphore
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendmill.session import scratch_path, scratch_root

#: Fits that run side by side in a session, whoever started them; each keeps its own trees on the driver.
PARALLEL_FITS = 12
#: Training rows of one task of a fit: numbers, and texts as vectors.
NUMBERS_PER_TASK = 250_000
TEXTS_PER_TASK = 20_000

T = TypeVar("T")
_SLOTS = BoundedSemaphore(PARALLEL_FITS)
_LIGHT_SLOTS = BoundedSemaphore(PARALLEL_FITS)


def fingerprint(rows: DataFrame) -> str:
    """Count, sum and exclusive or of the rows' hashes: the same for the same rows in any order, repeats counting."""
    row = F.xxhash64(*sorted(rows.columns))
    found = rows.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("total"),
                     F.bit_xor(row).alias("mixed")).first()
    return f"{found['n']}:{found['total']}:{found['mixed']}"


def estimator_key(estimator) -> dict:
    """Class and every plain parameter, defaults included; an estimator inside another one has a key of its own."""
    params = {p.name: v for p, v in estimator.extractParamMap().items() if isinstance(v, (str, bool, int, float))}
    return {"class": type(estimator).__name__, **params}


def fitted_once(rows: DataFrame, name: str, about: dict,
                fit: Callable[[], tuple[PipelineModel, dict]]) -> tuple[PipelineModel, dict]:
    """The pipeline and figures stored for ``rows`` and ``about``, fitted by ``fit`` if there are none yet.

    The row with the figures names the pipeline's folder and is written last, so a fit cut short leaves
    nothing that a later caller would take.  Of two callers that fit at once, either may be kept.
    """
    spark = rows.sparkSession
    label = json.dumps({"rows": fingerprint(rows), "schema": rows.schema.simpleString(), "spark": spark.version,
                        **about}, sort_keys=True)
    entry = f"{scratch_root(spark)}/models/{name}-{hashlib.sha256(label.encode()).hexdigest()[:32]}"
    try:
        held = spark.read.schema("pipeline string, figures string").parquet(entry).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    if held is not None:
        return PipelineModel.load(held["pipeline"]), json.loads(held["figures"])
    model, figures = fit()
    path = scratch_path(spark, name)
    model.write().save(path)
    spark.createDataFrame([(path, json.dumps(figures))], "pipeline string, figures string").coalesce(1).write.mode(
        "ignore").parquet(entry)
    return model, figures


def train_tasks(rows: int, rows_per_task: int) -> int:
    """Tasks for the passes of a fit over ``rows`` training rows."""
    return max(1, -(-rows // rows_per_task))


def side_by_side(calls: list[Callable[[], T]], parallel: int) -> list[T]:
    """The results of ``calls``, at most ``parallel`` at a time."""
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return list(pool.map(inheritable_thread_target(lambda call: call()), calls))


def fit_side_by_side(fits: list[Callable[[], T]], parallel: int = PARALLEL_FITS, light: bool = False) -> list[T]:
    """The results of ``fits``, a few at a time, and ``PARALLEL_FITS`` at most with those of other callers.

    An iterative fit is many short jobs, and each task of a job sends the figures of every node or coefficient, so a fit
    gets as many tasks as its rows fill (``train_tasks``), and fits beside each other fill the cores.
    ``light`` fits, such as boostings, which keep a small tree at a time and wait on short jobs, have as many places of their
    own, so that they need not wait for forests.
    A fit must not start others through here: it would wait for a place while it holds one.
    """
    def placed(fit):
        with _LIGHT_SLOTS if light else _SLOTS:
            return fit()

    return side_by_side([partial(placed, fit) for fit in fits], parallel)
