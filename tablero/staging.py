"""Tables that are written once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one; where spark.checkpoint.dir is unset, as in tests on one machine, a temporary folder stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tablero-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: what was dealt stays dealt, and a lost executor loses nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
