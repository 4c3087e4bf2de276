"""Team by game: box totals, opponent, Four Factors and ratings, rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import efg, possessions, ratio
from . import KEYS
from .scan import previous

STATS = ("pts", "fg2m", "fg2a", "fg3m", "fg3a", "ftm", "fta", "orb", "drb", "ast", "stl", "tov", "pf")
CONTEXT = ("date", "rival", "is_home", "won")


def team_box(box: DataFrame, stats: Sequence[str] = STATS, context: Sequence[str] = CONTEXT, keys: Sequence[str] = KEYS, source: str = "totals") -> DataFrame:
    """Sums per team and game, with the context that a team has in its game.

    source: 'totals' uses the TOTALES rows (the default), 'players' the player rows, 'all' both (about double: what a sum without
    the filter gives). ``box`` marks TOTALES rows in is_total; without that column all rows count.
    """
    rows = box
    if "is_total" in box.columns and source != "all":
        rows = box.where(F.col("is_total") if source == "totals" else ~F.col("is_total"))
    out = rows.groupBy(*keys, "game", "team").agg(*(F.sum(s).alias(s) for s in stats), *(F.max(c).alias(c) for c in context))
    if {"fg2m", "fg3m", "fg2a", "fg3a"} <= set(stats):
        out = out.withColumn("fgm", F.col("fg2m") + F.col("fg3m")).withColumn("fga", F.col("fg2a") + F.col("fg3a"))
    return out


def with_opponent(team_game: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, prefix: str = "opp_") -> DataFrame:
    """The rival's columns of the same game; a missing rival leaves nulls."""
    rival = team_game.select(*keys, "game", F.col("team").alias("rival"), *(F.col(c).alias(f"{prefix}{c}") for c in columns))
    return team_game.join(rival, [*keys, "game", "rival"], "left")


def four_factors(team_game: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """eFG, turnover rate, free-throw rate, rebound rates, ratings, the opponent's and the five differences.

    opp_drtg divides by the opponent's possessions, so opp_net_rating is not the rival row's net_rating; that one is
    rival_net_rating. opp_orb_pct is 1 - orb_pct. drb_pct_opp uses the rival's offensive rebounds.
    """
    base = ["pts", "fgm", "fga", "fg3m", "fta", "orb", "drb", "tov"]
    t = with_opponent(team_game, base, keys)
    t = t.withColumn("poss", possessions("fga", "orb", "tov", "fta", 1.0)).withColumn("opp_poss", possessions("opp_fga", "opp_orb", "opp_tov", "opp_fta", 1.0))
    t = t.withColumn("opp_poss", F.when(F.col("opp_fga").isNotNull(), F.col("opp_poss")))
    t = t.withColumns(
        {
            "efg_pct": efg("fgm", "fg3m", "fga"),
            "tov_pct": ratio("tov", "poss"),
            "ftr": ratio("fta", "fga"),
            "orb_pct": ratio("orb", F.col("orb") + F.col("opp_drb")),
            "drb_pct": ratio("drb", F.col("drb") + F.col("orb")),
            "drb_pct_opp": ratio("drb", F.col("drb") + F.col("opp_orb")),
            "ortg": 100 * ratio("pts", "poss"),
            "drtg": 100 * ratio("opp_pts", "opp_poss"),
            "opp_efg_pct": efg("opp_fgm", "opp_fg3m", "opp_fga"),
            "opp_tov_pct": ratio("opp_tov", "opp_poss"),
            "opp_ftr": ratio("opp_fta", "opp_fga"),
            "opp_orb_pct": ratio("opp_drb", F.col("opp_drb") + F.col("orb")),
            "opp_ortg": 100 * ratio("opp_pts", "opp_poss"),
            "opp_drtg": 100 * ratio("pts", "opp_poss"),
        }
    )
    t = t.withColumns({"net_rating": F.col("ortg") - F.col("drtg"), "opp_net_rating": F.col("opp_ortg") - F.col("opp_drtg")})
    t = t.withColumn("rival_net_rating", F.col("opp_ortg") - F.col("ortg"))
    return t.withColumns({f"delta_{c}": F.col(c) - F.col(f"opp_{c}") for c in ("efg_pct", "tov_pct", "ftr", "orb_pct", "net_rating")})


def rest_days(team_game: DataFrame, keys: Sequence[str] = KEYS, first: int = 7) -> DataFrame:
    """Days since the team's game before; the first game has ``first``. Runs over ranges of games: a team may have any number."""
    rows = previous(team_game, [*keys, "team"], ["date", "game"], "date", "_before")
    return rows.withColumn("rest", F.coalesce(F.datediff("date", "_before"), F.lit(first))).drop("_before")


def rest_difference(team_game: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """rest minus the rival's rest of the same game."""
    return with_opponent(team_game, ["rest"], keys).withColumn("rest_diff", F.col("rest") - F.col("opp_rest"))


def head_to_head(team_game: DataFrame, a: str, b: str) -> DataFrame:
    """The games of two teams, from the first one's side."""
    return team_game.where((F.col("team") == a) & (F.col("rival") == b))


def game_list(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per game with home and away team and date, from the TOTALES rows."""
    return totals.groupBy(*keys, "game").agg(
        F.max("date").alias("date"),
        F.max(F.when(F.col("is_home"), F.col("team"))).alias("home"),
        F.max(F.when(~F.col("is_home"), F.col("team"))).alias("away"),
    )
