"""Fact tables that lie together: bucketed and sorted by (league, season, game), so that joins and groups by game need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAME_KEY = ("league", "season", "game")
#: One number for all facts: buckets of two tables meet only if there are as many.
BUCKETS = 64


#: Rows of a bucket, on the mean.
BUCKET_ROWS = 250_000


def bucket_number(rows: int, least: int = 8) -> int:
    """Buckets for facts whose largest table has ``rows`` rows: a bucket's task reads about as much whatever their size."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int = BUCKETS, key: Sequence[str] = GAME_KEY, mode: str = "overwrite") -> DataFrame:
    """Save df as an external table with a file per bucket, sorted by ``key``; returns it as read back.

    ``buckets`` should follow the size of the largest fact table (a bucket is a task of the joins). A hot game is one
    bucket's; games are bounded by their events.
    """
    df.repartition(buckets, *key).write.mode(mode).bucketBy(buckets, *key).sortBy(*key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def with_result(events: DataFrame, games: DataFrame, key: Sequence[str] = GAME_KEY) -> DataFrame:
    """J6: the result columns of the game beside every event (or box row, or shot) of the same key."""
    return events.join(games.hint("merge"), list(key), "left")


def game_totals(rows: DataFrame, stats: Sequence[str], key: Sequence[str] = GAME_KEY, by: Sequence[str] = ("team",)) -> DataFrame:
    """Sums per game and team; over a bucketed table without a shuffle."""
    return rows.groupBy(*key, *by).agg(F.count("*").alias("rows"), *(F.sum(s).alias(s) for s in stats))


def forget(spark: SparkSession, *tables: str) -> None:
    """Take tables out of the catalog; their files stay, and so do plans that read them."""
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
