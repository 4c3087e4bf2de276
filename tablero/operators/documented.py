"""Metrics that the reference only describes: clutch and overtime records, phases, recent form, usage, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import zone_category
from ..functions import efg, ratio, true_shooting
from . import KEYS
from .events import MADE, points
from .history import last_k
from .possessions import assisted_baskets
from .reports import player_report, records, splits, team_report
from .shots import shot_profile


def _both_sides(events: DataFrame, game: Sequence[str]) -> DataFrame:
    """Each team event once for its team and once against the rival."""
    roles = F.explode(F.array(F.struct(F.col("team").alias("who"), F.lit(True).alias("own")), F.struct(F.col("rival").alias("who"), F.lit(False).alias("own"))))
    return events.where("team is not null").withColumn("_r", roles).select(*game, "kind", "period", F.col("_r.who").alias("team"), F.col("_r.own").alias("own"))


def clutch_team_report(events: DataFrame, when: Column, game: Sequence[str] = (*KEYS, "game"), keys: Sequence[str] = KEYS, results: DataFrame | None = None) -> DataFrame:
    """Clutch games, points for and against, ratings, eFG and turnover rate per team; with ``results`` (game, team, won) also the record in those games."""
    rows = _both_sides(events.where(when), game)
    own, kind = F.col("own"), F.col("kind")
    made = kind.isin("CANASTA-2P", "CANASTA-3P")
    fga = made | kind.isin("TIRO2-FALLADO", "TIRO3-FALLADO")
    poss = fga.cast("int") - (kind == "REBOTE-OFENSIVO").cast("int") + (kind == "PERDIDA").cast("int") + 0.44 * kind.isin("CANASTA-1P", "TIRO1-FALLADO").cast("int")
    out = rows.groupBy(*keys, "team").agg(
        F.count_distinct(*(F.col(g) for g in game)).alias("games"), F.sum(F.when(own, points()).otherwise(0)).alias("pts"), F.sum(F.when(~own, points()).otherwise(0)).alias("opp_pts"),
        F.sum(F.when(own, poss).otherwise(0.0)).alias("poss"), F.sum(F.when(~own, poss).otherwise(0.0)).alias("opp_poss"), F.count_if(own & fga).alias("fga"), F.count_if(own & made).alias("fgm"),
        F.count_if(own & (kind == "CANASTA-3P")).alias("fg3m"), F.count_if(own & (kind == "PERDIDA")).alias("tov"),
    )
    out = out.withColumns({"ortg": 100 * ratio("pts", "poss"), "drtg": 100 * ratio("opp_pts", "opp_poss"), "efg_pct": efg("fgm", "fg3m", "fga"), "tov_pct": ratio("tov", "poss")})
    if results is None:
        return out
    return out.join(records(results.join(rows.select(*game, "team").distinct(), [*game, "team"], "left_semi"), (*keys, "team")), [*keys, "team"], "left")


def overtime_record(events: DataFrame, team_games: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Record in games that went past the fourth period."""
    long = events.where("period >= 5").select(*keys, "game").distinct()
    return records(team_games.join(long, [*keys, "game"], "left_semi"), (*keys, "team"))


def stretch_points(events: DataFrame, period: int = 3, seconds: int = 180, length: int = 600, game: Sequence[str] = (*KEYS, "game")) -> DataFrame:
    """Points for and against per team and game in the first ``seconds`` of a period."""
    inside = (F.col("period") == period) & (F.col("clock") >= length - seconds) & F.col("kind").isin(*MADE)
    rows = _both_sides(events.where(inside), game)
    return rows.groupBy(*game, "team").agg(F.sum(F.when(F.col("own"), points()).otherwise(0)).alias("pts"), F.sum(F.when(~F.col("own"), points()).otherwise(0)).alias("opp_pts"))


def phase_comparison(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Team report of the regular phase and the playoffs side by side, with differences (rows carry ``phase``)."""
    return _by_phase(team_report(rows, (*keys, "team", "phase")), (*keys, "team"))


def _by_phase(both: DataFrame, group: Sequence[str]) -> DataFrame:
    metrics = [c for c in both.columns if c not in (*group, "phase")]
    at = lambda m, p: F.max(F.when(F.col("phase") == p, F.col(m)))
    out = both.groupBy(*group).agg(*(at(m, p).alias(f"{m}_{p}") for m in metrics for p in ("regular", "playoff")))
    return out.withColumns({f"{m}_change": F.col(f"{m}_playoff") - F.col(f"{m}_regular") for m in metrics})


def recent_form(factors: DataFrame, k: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last k games of each team, the latest first, with result and ratings."""
    return last_k(factors, [*keys, "team"], ["date", "game"], k, "back")


def usage_per_game(players: DataFrame, team_possessions: DataFrame, keys: Sequence[str] = KEYS, top: int = 5) -> DataFrame:
    """Minutes-scaled usage per game, (FGA + 0.44 FTA + TOV) / (minutes / 40 * team possessions), of the players with the most minutes of their team.

    ``team_possessions`` has game, team, poss; no minutes give null.
    """
    team = (*keys, "team")
    used = F.col("fga") + 0.44 * F.col("fta") + F.col("tov")
    rows = players.join(team_possessions.select(*team, "game", "poss"), [*team, "game"])
    rows = rows.withColumn("usage", ratio(used, (F.col("seconds") / 2400.0) * F.col("poss")))
    most = players.groupBy(*team, "player").agg(F.sum("seconds").alias("_s")).withColumn("_r", F.row_number().over(Window.partitionBy(*team).orderBy(F.desc("_s"), "player"))).where(F.col("_r") <= top)
    return rows.join(most.select(*team, "player"), [*team, "player"], "left_semi").drop("poss")


def player_phases(players: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Player averages of the regular phase and the playoffs side by side, with differences (rows carry ``phase``).

    Rows are dealt once by team and phase: players' and teams' sums, their distinct dates and the join of both need no further shuffle.
    """
    group = (*keys, "team", "phase")
    return _by_phase(player_report(players.repartition(*group), group), (*keys, "team", "player"))


def points_by_origin(events: DataFrame, shots: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("num", "seq"), rules: str = "report") -> DataFrame:
    """Per team: points from free throws, twos and threes (events), the twos' split into paint and mid range (shots), and the share of field goals
    with an assist: an assist makes one basket assisted, the one that ``events.assist_pairs`` finds."""
    game = (*keys, "game")
    basket = F.col("kind").isin("CANASTA-2P", "CANASTA-3P")
    rows = assisted_baskets(events, game, order).where("team is not null")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, points()).otherwise(0))
    out = rows.groupBy(*keys, "team").agg(of("CANASTA-1P").alias("free_throw_pts"), of("CANASTA-2P").alias("two_pts"), of("CANASTA-3P").alias("three_pts"), F.count_if(basket).alias("fgm"), F.count_if(basket & (F.col("assists") > 0)).alias("assisted"))
    zone = zone_category("zone", rules)
    made = shots.where("result = 'CONVERTIDO' and kind = 'TIRO2'")
    areas = made.groupBy(*keys, "team").agg((2 * F.count_if(zone == "paint")).alias("paint_pts"), (2 * F.count_if(zone == "mid")).alias("mid_pts"))
    return out.join(areas, [*keys, "team"], "left").withColumn("assisted_share", ratio("assisted", "fgm"))


def period_splits(quarters: DataFrame, games: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean points for and against per team in the first half, the second half and the fourth quarter; only games with all four quarters count.

    ``quarters`` as of ``events.quarter_scores``; ``games`` has game, home, away.
    """
    part = lambda s, name, on: F.sum(F.when(on, F.col(f"{s}_pts")).otherwise(0)).alias(f"{s}_{name}")
    spans = (("first_half", F.col("period") <= 2), ("second_half", F.col("period") >= 3), ("fourth", F.col("period") == 4))
    per_game = quarters.groupBy(*keys, "game").agg(F.count("*").alias("_n"), *(part(s, name, on) for s in ("home", "away") for name, on in spans)).where("_n = 4").join(games, [*keys, "game"])
    side = lambda own, other: per_game.select(*keys, F.col(own).alias("team"), *(F.col(f"{own}_{n}").alias(f"{n}_for") for n, _ in spans), *(F.col(f"{other}_{n}").alias(f"{n}_against") for n, _ in spans))
    both = side("home", "away").unionByName(side("away", "home"))
    return both.groupBy(*keys, "team").agg(F.count("*").alias("games"), *(F.avg(f"{n}_{x}").alias(f"{n}_{x}") for n, _ in spans for x in ("for", "against")))


def allowed_efficiency(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What a team's rivals reach against it: eFG, true shooting and offensive rebound share (rows carry the opp_ columns)."""
    cols = ("opp_pts", "opp_fgm", "opp_fga", "opp_fg3m", "opp_fta", "opp_orb", "drb")
    s = rows.groupBy(*keys, "team").agg(F.count("*").alias("games"), *(F.sum(c).alias(c) for c in cols))
    return s.select(*keys, "team", "games", efg("opp_fgm", "opp_fg3m", "opp_fga").alias("opp_efg_pct"), true_shooting("opp_pts", "opp_fga", "opp_fta").alias("opp_ts_pct"), ratio("opp_orb", F.col("opp_orb") + F.col("drb")).alias("opp_orb_pct"))


def allowed_zones(shots: DataFrame, keys: Sequence[str] = KEYS, rules: str = "report") -> DataFrame:
    """The shot profile that each team allows its rivals."""
    return shot_profile(shots, (*keys, "rival"), rules).withColumnRenamed("rival", "team")


def executive_comparison(rows: DataFrame, a: str, b: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """metric, a, b for two teams: report, home and away records, last ten, head to head."""
    both = rows.where(F.col("team").isin(a, b))
    report = team_report(both, (*keys, "team"))
    side = splits(both, (*keys, "team", "is_home")).groupBy(*keys, "team").agg(*(F.max(F.when(F.col("is_home") == h, F.col(c))).alias(f"{c}_{n}") for h, n in ((True, "home"), (False, "away")) for c in ("wins", "losses")))
    ten = records(last_k(both, [*keys, "team"], ["date", "game"], 10), (*keys, "team")).withColumnsRenamed({"wins": "wins_last10", "losses": "losses_last10"})
    met = records(both.where(F.col("rival").isin(a, b)), (*keys, "team")).withColumnsRenamed({"wins": "wins_h2h", "losses": "losses_h2h"})
    wide = report
    for extra in (side, ten, met):
        wide = wide.join(extra, [*keys, "team"], "left")
    metrics = [c for c in wide.columns if c not in (*keys, "team")]
    long = wide.select(*keys, "team", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("r")).select(*keys, "team", "r.*")
    pick = lambda t: F.max(F.when(F.col("team") == t, F.col("value")))
    return long.groupBy(*keys, "metric").agg(pick(a).alias("a"), pick(b).alias("b"))
