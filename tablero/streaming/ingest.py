"""Incremental ingest of a landing folder: each file is read once, each row of a new game is stored once."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.tables import new_rows


def ingest_stream(spark: SparkSession, landing: str, schema: StructType, target: str, checkpoint: str, key: Sequence[str] = ("league", "game"), partition_by: Sequence[str] = (), files_per_batch: int = 1000) -> StreamingQuery:
    """Read the files that are there now and add the rows of games that ``target`` did not hold before this run; returns when done.

    ``target`` is partitioned by run, batch and ``partition_by``. A batch overwrites the partitions of its own number, so a retry
    replaces what it wrote before and changes nothing else; the whole target is never read for it. The games known before a run are
    written beside the checkpoint, and renewed only after a run that came to its end, so a game whose rows lie in files of several
    batches arrives whole, also over a restart. Rows that an earlier batch of the same run brought are found in that run's partitions.
    """
    base = checkpoint.rstrip("/")
    known, label, done = f"{base}-known", f"{base}-run", f"{base}-done"
    if not _exists(spark, f"{label}/_SUCCESS") or _exists(spark, done):
        before = spark.read.schema(schema).parquet(target) if _exists(spark, target) else spark.createDataFrame([], schema)
        before.select(*key).distinct().write.mode("overwrite").parquet(known)
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.mode("overwrite").parquet(label)
        _path(spark, done)[0].delete(_path(spark, done)[1], True)
    run = spark.read.parquet(label).first()["run"]
    key_schema = StructType([schema[k] for k in key])
    stored = StructType([*schema, StructField("run", StringType()), StructField("batch", LongType())])

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = new_rows(batch, session.read.schema(key_schema).parquet(known), key)
        if number > 0 and _exists(session, f"{target.rstrip('/')}/run={run}"):
            same = session.read.schema(stored).option("basePath", target).parquet(f"{target.rstrip('/')}/run={run}").where(F.col("batch") < number)
            rows = rows.join(same, [rows[c.name].eqNullSafe(same[c.name]) for c in schema], "left_anti")
        out = rows.withColumns({"run": F.lit(run), "batch": F.lit(number).cast("long")})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch", *partition_by).parquet(target)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    fs, path = _path(spark, done)
    fs.mkdirs(path)
    return query


def _path(spark: SparkSession, path: str) -> tuple:
    """The store and its name of a path that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)
