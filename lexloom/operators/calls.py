"""Calls to services outside, pages to fetch or prompts to answer: with back-off, a bound on their rate, and resume.

A call is a function of a row's payload that gives a text or raises.  Rows are dealt to a fixed number of tasks, each
of which keeps its share of the rate.  What was answered is appended to a table slice by slice, so that a run that is
killed loses one slice at most, and the next run calls only for keys without an answer: those not reached and those
that failed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Policy:
    """Tries of a call, seconds before the second one (then doubled), calls a second of all tasks together, tasks, slices.

    With a rate, tasks that run at the same time share it; fewer run, fewer calls are made.
    """

    tries: int = 3
    wait: float = 5.0
    rate: float | None = None
    tasks: int = 8
    slices: int = 8


def called(df: DataFrame, call: Callable[[str], str], key: str, payload: str, policy: Policy) -> DataFrame:
    """key, value, error, tries: what each row's call gave, or the last error.  A null payload is an error without a call."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType)]).add("value", "string").add("error", "string").add("tries", "integer")
    tries, wait, gap = max(1, policy.tries), policy.wait, policy.tasks / policy.rate if policy.rate else 0.0

    def one(text):
        nonlocal free_at
        if text is None:
            return None, "no payload", 0
        for n in range(1, tries + 1):
            time.sleep(max(0.0, free_at - time.monotonic()))
            free_at = time.monotonic() + gap
            try:
                return call(text), None, n
            except Exception as error:  # noqa: BLE001 - any service may be plugged in
                if n == tries:
                    return None, f"{type(error).__name__}: {error}", n
                time.sleep(wait * 2 ** (n - 1))
        return None

    free_at = 0.0

    def run(batches):
        nonlocal free_at
        free_at = time.monotonic()
        for batch in batches:
            out = [one(text) for text in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], names=schema.names)

    return df.select(key, F.col(payload).cast("string").alias("payload of call")).repartition(policy.tasks).mapInArrow(run, schema)


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def run_pending(df: DataFrame, path: str, call: Callable[[str], str], key: str, payload: str, policy: Policy | None = None) -> DataFrame:
    """Call for every key of df that has no answer under path yet, and give answers()."""
    spark, policy = df.sparkSession, policy or Policy()
    for part in range(policy.slices):
        rows = df.where(F.pmod(F.xxhash64(key), F.lit(policy.slices)) == part)
        known = _known(spark, path)
        if known is not None:
            rows = rows.join(known.where("error IS NULL").select(key).distinct(), key, "left_anti")
        called(rows, call, key, payload, policy).write.mode("append").parquet(path)
    return answers(spark, path, key)


def answers(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, value, error, tries: the answer of each key, or its last error; tries of all runs."""
    rows = spark.read.parquet(path)
    best = F.max(F.struct(F.col("error").isNull().alias("found"), "value", "error"))
    return rows.groupBy(key).agg(best.alias("best"), F.sum("tries").alias("tries")).select(key, "best.value", "best.error", "tries")
