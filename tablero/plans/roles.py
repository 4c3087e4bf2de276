"""The driver tables in basketball roles: order lines are box rows, orders a team's games, events the play-by-play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dims import EVENTS
from ..staging import scratch  # noqa: F401

KINDS = [e[0] for e in EVENTS]
PERIOD_DAYS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box row per order line: game = order, team = line status, player = part; integer stats."""
    hundred = lambda c: F.round(F.col(c) * 100).cast("long")
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game"), F.col("l_linestatus").alias("team"), F.when(F.col("l_linestatus") == "O", "F").otherwise("O").alias("rival"), (F.col("l_linestatus") == "O").alias("is_home"),
        F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("player"), F.col("l_suppkey").alias("supplier"), (q * 60).alias("seconds"),
        F.round("l_extendedprice").cast("long").alias("pts"), q.alias("fg2m"), (q + n).alias("fg2a"), n.alias("fg3m"), (2 * n).alias("fg3a"), hundred("l_discount").alias("ftm"), (hundred("l_discount") + hundred("l_tax")).alias("fta"),
        hundred("l_tax").alias("orb"), n.alias("drb"), n.alias("ast"), hundred("l_tax").alias("stl"), hundred("l_discount").alias("tov"), n.alias("pf"), F.lit(0).cast("long").alias("blk"), q.alias("fouls_drawn"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One team game per order: team = customer, rival = order status, win = even total in cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("team"), F.col("o_orderkey").alias("game"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("rival"), F.col("o_totalprice").alias("price"),
        cents.alias("pts"), F.pmod(F.col("o_orderkey") * 7919, F.lit(40_000_000)).alias("opp_pts"), (cents % 2 == 0).alias("won"), (F.col("o_orderkey") % 2 == 0).alias("is_home"), F.col("o_orderpriority").alias("league"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play-by-play from events: game = user, kind and player from props.k, side from the id; running scores."""
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    period = (F.floor(day / PERIOD_DAYS) + 1).cast("int")
    spent = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) - (period - 1) * PERIOD_DAYS * 86400
    kind = F.element_at(F.array(*map(F.lit, KINDS)), k % len(KINDS) + 1)
    side = F.when(kind.rlike("^(INICIO|FINAL)"), None).when(F.col("event_id") % 2 == 0, "LOCAL").otherwise("VISITANTE")
    base = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("game"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), side.alias("side"), F.when(k % 11 > 0, F.concat(F.lit("P"), (k % 11).cast("string"))).alias("player"),
        period.alias("period"), (600 - F.floor(spent * 600 / (PERIOD_DAYS * 86400))).cast("int").alias("clock"),
    )
    run = Window.partitionBy("game").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    pts = F.when(F.col("kind") == "CANASTA-1P", 1).when(F.col("kind") == "CANASTA-2P", 2).when(F.col("kind") == "CANASTA-3P", 3).otherwise(0)
    score = lambda s: F.sum(F.when(F.col("side") == s, pts).otherwise(0)).over(run)
    team = F.when(F.col("side") == "LOCAL", "home").when(F.col("side") == "VISITANTE", "away")
    rival = F.when(F.col("side") == "LOCAL", "away").when(F.col("side") == "VISITANTE", "home")
    return base.withColumns({"home_score": score("LOCAL"), "away_score": score("VISITANTE"), "team": team, "rival": rival})


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shot per event: zone from props.k, result from the value, team from the user."""
    k = F.get_json_object("props", "$.k").cast("int")
    zone = F.when(k % 16 == 15, "FRANJA-DE").when(k % 16 == 0, None).otherwise(F.concat(F.lit("Z"), (k % 16).cast("string"), F.when(k % 2 == 0, "-DE").otherwise("-IZ")))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("team"), F.col("user_id").alias("game"), zone.alias("zone"), F.when(F.col("event_id") % 3 == 0, "CONVERTIDO").otherwise("FALLADO").alias("result"),
        F.when(k % 16 > 10, "TIRO3").otherwise("TIRO2").alias("kind"), (k * 1.02).alias("top_pct"), (k % 13).alias("jersey"),
    )
