"""What a session needs before Python functions of this library run in its workers."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
#: Bytes of code of a method beyond which the JVM interprets it.
COMPILED_BYTES = 8000

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this checkout also when the application was started elsewhere (clusters ship it with --py-files)."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of pages or packed blocks end at BATCH_BYTES, so that a worker's memory does not follow the size of 10,000 rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def compiled_methods(spark: SparkSession) -> None:
    """Stages whose generated method is longer than the JVM compiles run operator by operator, in methods that it does compile."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > COMPILED_BYTES:
        spark.conf.set(key, str(COMPILED_BYTES))


def _bytes(size: str) -> int:
    """A size such as 64m, 64MB or 67108864 in bytes (-1: without end)."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1]]


def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        bounded_batches(spark)
        compiled_methods(spark)
        return query(spark, sf_dir)

    return run
