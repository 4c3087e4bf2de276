"""Helpers shared by the operators: the shared folder, staged tables, ordered prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablero import session

_alone: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts per Arrow batch: a batch is in memory in the executor and in its Python worker at once.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, for texts are long, and to the bytes of ``session``; smaller settings stay."""
    session.bounded_batches(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir).

    Only where the setting is absent and the session is local, as in tests on one machine, a temporary folder stands in.
    """
    bounded_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _alone:
            _alone.append(f"file://{tempfile.mkdtemp(prefix='tablero-')}")
        base = _alone[0]
    return f"{base.rstrip('/')}/tablero-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered_offsets(df: DataFrame, order: list[str], size: str, out: str = "start") -> DataFrame:
    """Add the exclusive prefix sum of ``size`` over the total order ``order`` (which must be unique).

    Range-partitioned and sorted; each partition runs one counter, and only one total per partition
    is summed across partitions. No row passes through a single task.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    schema = T.StructType([*df.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("inner", T.LongType())])
    at = df.columns.index(size)

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pid, total = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = pc.cumulative_sum(b.column(at).cast(pa.int64()))
            inner = pc.add(pc.subtract(ends, b.column(at).cast(pa.int64())), total)
            if b.num_rows:
                total += ends[-1].as_py()
            cols = [*b.columns, pa.array([pid] * b.num_rows, pa.int32()), inner]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "pid", "inner"])

    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    counted = staged(ranged.mapInArrow(count, schema))
    totals = counted.groupBy("pid").agg(F.sum(size).alias("in_pid"))
    before = F.sum("in_pid").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    # one row per range partition: at most n rows
    bases = totals.select(F.col("pid").alias("base_pid"), F.coalesce(before, F.lit(0)).alias("base"))
    return (
        counted.join(F.broadcast(bases), F.col("pid") == F.col("base_pid"))
        .withColumn(out, F.col("base") + F.col("inner"))
        .drop("pid", "inner", "base", "base_pid")
    )
