"""Team state kept up to date from a landing folder of games."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import KEYS
from ..operators.state import merged_state, part_state
from .ingest import _exists


def keep_state(spark: SparkSession, landing: str, schema: StructType, state: str, checkpoint: str, metrics: Sequence[str], keys: Sequence[str] = KEYS, span: int = 10, files_per_batch: int = 1000) -> StreamingQuery:
    """Read the files that are there now, batch by batch, and bring the state up to date; returns when done.

    The state after a batch is a version of its own, made from the version before and the batch, so a batch that is run again
    writes the same version. Files must arrive in the order of their games; reading a version does not read older ones.
    """
    base = state.rstrip("/")

    def update(batch: DataFrame, number: int) -> None:
        session, new = batch.sparkSession, part_state(batch, metrics, keys, span)
        before = f"{base}/version={number - 1}"
        if _exists(session, before):
            new = merged_state(session.read.parquet(before), new, metrics, keys, span)
        new.write.mode("overwrite").parquet(f"{base}/version={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = source.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current_state(spark: SparkSession, state: str) -> DataFrame:
    """The latest version; its number comes from the folder names."""
    every = spark.read.parquet(state)
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == last).drop("version")
