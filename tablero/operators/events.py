"""Play-by-play operators. Events are ordered by (num, seq) inside a game; a null number keeps its page position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from . import KEYS

ORDER = ("num", "seq")
MADE = {"CANASTA-1P": 1, "CANASTA-2P": 2, "CANASTA-3P": 3}
MISSED = ("TIRO1-FALLADO", "TIRO2-FALLADO", "TIRO3-FALLADO")


def _when_map(column: Column, values: dict, other) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(other) if out is not None else F.lit(other)


def points(kind: str | Column = "kind", made: dict[str, int] = MADE) -> Column:
    return _when_map(F.col(kind) if isinstance(kind, str) else kind, made, 0)


POSSESSION_WEIGHTS = {"CANASTA-2P": 1.0, "CANASTA-3P": 1.0, "TIRO2-FALLADO": 1.0, "TIRO3-FALLADO": 1.0, "PERDIDA": 1.0, "CANASTA-1P": 0.44, "TIRO1-FALLADO": 0.44}


def score_fill(events: DataFrame, scores: Sequence[str] = ("home_score", "away_score"), game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Scores carried forward in event order, 0 before the first."""
    w = Window.partitionBy(*game).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({s: F.coalesce(F.last(s, ignorenulls=True).over(w), F.lit(0)) for s in scores})


def pace(events: DataFrame, group: Sequence[str] = (*KEYS, "game", "team"), weights: dict[str, float] = POSSESSION_WEIGHTS) -> DataFrame:
    """Sum of possession weights per team and game (no rebound term)."""
    rows = events.where(F.col("kind").isin(*weights))
    return rows.groupBy(*group).agg(F.sum(_when_map(F.col("kind"), weights, 0.0)).alias("pace"))


def clutch(preset: str = "model", margin: int = 5) -> Column:
    """model: period 4, two minutes or less, all scoring. report: period 4 within five minutes or any overtime, field goals only. team: period 4 within
    five minutes, all events."""
    close = F.abs(F.col("home_score") - F.col("away_score")) <= margin
    if preset == "model":
        return (F.col("period") == 4) & (F.col("clock") <= 120) & close
    if preset == "report":
        return (((F.col("period") == 4) & (F.col("clock") <= 300)) | (F.col("period") >= 5)) & close & F.col("kind").isin("CANASTA-2P", "CANASTA-3P", *MISSED[1:])
    if preset == "team":
        return (F.col("period") == 4) & (F.col("clock") <= 300) & close
    raise ValueError(f"unknown preset {preset!r}")


def clutch_net(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), when: Column | None = None, made: dict[str, int] = MADE) -> DataFrame:
    """Clutch points for, against and net per team and game: each score counts for its team and against the rival, in one grouping."""
    scored = events.where((clutch() if when is None else when) & F.col("kind").isin(*made)).withColumn("p", points("kind", made))
    roles = F.explode(F.array(F.struct(F.col("team").alias("who"), F.col("p").alias("f"), F.lit(0).alias("a")), F.struct(F.col("rival").alias("who"), F.lit(0).alias("f"), F.col("p").alias("a"))))
    flat = scored.select(*game, roles.alias("r")).select(*game, F.col("r.who").alias("team"), "r.f", "r.a")
    return flat.groupBy(*game, "team").agg(F.sum("f").alias("clutch_for"), F.sum("a").alias("clutch_against"), F.sum(F.col("f") - F.col("a")).alias("clutch_net"))


def team_event_features(events: DataFrame, game: Sequence[str] = (*KEYS, "game")) -> DataFrame:
    """pace and clutch_net per team and game, zero where a team has no clutch points."""
    net = clutch_net(events, game).select(*game, "team", "clutch_net")
    return pace(events, (*game, "team")).join(net, [*game, "team"], "left").withColumn("clutch_net", F.coalesce("clutch_net", F.lit(0)))


def clutch_shooting(events: DataFrame, group: Sequence[str] = (*KEYS, "team"), when: Column | None = None) -> DataFrame:
    """Per player: clutch attempts, makes, threes, eFG and the share of the team's clutch attempts."""
    rows = events.where(clutch("report") if when is None else when)
    two, three = F.col("kind").isin("CANASTA-2P", "TIRO2-FALLADO"), F.col("kind").isin("CANASTA-3P", "TIRO3-FALLADO")
    made = F.col("kind").startswith("CANASTA")
    count = lambda c, name: F.count_if(c).alias(name)
    out = rows.groupBy(*group, "player").agg(count(two | three, "fga"), count((two | three) & made, "fgm"), count(three, "fg3a"), count(three & made, "fg3m"))
    out = out.withColumn("efg_pct", ratio(F.col("fgm") + 0.5 * F.col("fg3m"), "fga"))
    return out.withColumn("share", ratio("fga", F.sum("fga").over(Window.partitionBy(*group))))


def assist_pairs(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ORDER, look_back: int = 4) -> DataFrame:
    """Each assist with the scorer of the team's last basket among the ``look_back`` rows before; assists without one are left out.

    The basket is wrapped in a struct, so a basket without player is found as such and not skipped for an older one. The
    rows looked at are those of both sides; the nearest own basket is taken.
    """
    w = Window.partitionBy(*game).orderBy(*order)
    # per side the last basket of that side in the frame
    out = events
    frame = w.rowsBetween(-look_back, -1)
    for side in ("LOCAL", "VISITANTE"):
        hit = F.when((F.col("side") == side) & F.col("kind").isin(*MADE), F.struct(F.col("player").alias("scorer")))
        out = out.withColumn(f"_{side}", F.last(hit, ignorenulls=True).over(frame))
    found = F.when(F.col("side") == "LOCAL", F.col("_LOCAL")).when(F.col("side") == "VISITANTE", F.col("_VISITANTE"))
    pairs = out.where(F.col("kind") == "ASISTENCIA").withColumn("_found", found).where(F.col("_found").isNotNull())
    return pairs.select(*game, "side", *(c for c in ("team",) if c in events.columns), F.col("player").alias("passer"), F.col("_found.scorer").alias("scorer"))


def pair_counts(pairs: DataFrame, group: Sequence[str] = (*KEYS, "team"), top: int | None = 5) -> DataFrame:
    """Assists per passer and scorer; the ``top`` pairs per group, ties by names."""
    out = pairs.where("passer is not null and scorer is not null").groupBy(*group, "passer", "scorer").agg(F.count("*").alias("assists"))
    if top is None:
        return out
    w = Window.partitionBy(*group).orderBy(F.desc("assists"), "passer", "scorer")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def second_chance(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ORDER, dedupe_possession: bool = False) -> DataFrame:
    """Points after each offensive rebound until the possession ends, one row per rebound.

    A possession ends with any defensive rebound or period or game end, or with an own turnover or field goal; its own
    points are counted up to there. Nested rebounds each count the later points; dedupe_possession keeps the last rebound only.
    """
    w = Window.partitionBy(*game).orderBy(*order)
    run, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*game)
    out, ends_any = events, F.coalesce(F.col("kind").isin("REBOTE-DEFENSIVO", "FINAL-PERIODO", "FINAL-PARTIDO"), F.lit(False))
    for side in ("LOCAL", "VISITANTE"):
        own = F.coalesce(F.col("side") == side, F.lit(False))
        out = out.withColumn(f"_cum_{side}", F.sum(F.when(own, points()).otherwise(0)).over(run))
        ends = ends_any | (own & F.coalesce(F.col("kind").isin("PERDIDA", "CANASTA-2P", "CANASTA-3P"), F.lit(False)))
        again = own & (F.col("kind") == "REBOTE-OFENSIVO")
        out = out.withColumn(f"_end_{side}", F.coalesce(F.first(F.when(ends, F.col(f"_cum_{side}")), ignorenulls=True).over(after), F.max(f"_cum_{side}").over(whole)))
        if dedupe_possession:
            out = out.withColumn(f"_next_{side}", F.first(F.when(ends, "end").when(again, "again"), ignorenulls=True).over(after))
    rebounds = out.where((F.col("kind") == "REBOTE-OFENSIVO") & F.col("side").isin("LOCAL", "VISITANTE"))
    pick = lambda name: F.when(F.col("side") == "LOCAL", F.col(f"_{name}_LOCAL")).otherwise(F.col(f"_{name}_VISITANTE"))
    if dedupe_possession:
        rebounds = rebounds.where(F.coalesce(pick("next"), F.lit("end")) != "again")
    return rebounds.withColumn("second_chance_pts", pick("end") - pick("cum")).select(*events.columns, "second_chance_pts")


def quarter_scores(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ORDER, periods: int = 4) -> DataFrame:
    """Score of both sides at the end of each regulation period, and what was added since the period end before (missing ends are skipped)."""
    ends = events.where((F.col("kind") == "FINAL-PERIODO") & F.col("period").between(1, periods))
    at = F.struct(*order)
    last = ends.groupBy(*game, "period").agg(F.max_by("home_score", at).alias("home_score"), F.max_by("away_score", at).alias("away_score"))
    w = Window.partitionBy(*game).orderBy("period")
    return last.withColumns({f"{s}_pts": F.col(f"{s}_score") - F.coalesce(F.lag(f"{s}_score").over(w), F.lit(0)) for s in ("home", "away")})


def points_per_quarter(quarters: DataFrame, games: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean points for and against per team and quarter; ``games`` has game, home, away."""
    side = lambda team, f, a: quarters.join(games, [*keys, "game"]).select(*keys, F.col(team).alias("team"), "period", F.col(f).alias("f"), F.col(a).alias("a"))
    both = side("home", "home_pts", "away_pts").unionByName(side("away", "away_pts", "home_pts"))
    return both.groupBy(*keys, "team", "period").agg(F.avg("f").alias("pts_for"), F.avg("a").alias("pts_against"))


def rebound_by_result(team_game: DataFrame, chances: DataFrame, keys: Sequence[str] = KEYS, group: Sequence[str] = ()) -> DataFrame:
    """Offensive rebounding in won and lost games: totals, rates and second-chance points."""
    per_game = chances.groupBy(*keys, "game", "team").agg(F.count("*").alias("chances"), F.sum("second_chance_pts").alias("chance_pts"))
    rows = team_game.join(per_game, [*keys, "game", "team"], "left").na.fill(0, ["chances", "chance_pts"])
    out = rows.groupBy(*keys, "team", *group, "won").agg(
        F.count("*").alias("games"), F.sum("orb").alias("orb"), F.sum("opp_drb").alias("opp_drb"), F.sum("chances").alias("chances"), F.sum("chance_pts").alias("chance_pts")
    )
    return out.withColumns(
        {"orb_per_game": ratio("orb", "games"), "orb_pct": ratio("orb", F.col("orb") + F.col("opp_drb")), "chance_pts_per_game": ratio("chance_pts", "games"), "chance_ppp": ratio("chance_pts", "chances")}
    )


def win_loss_difference(by_result: DataFrame, metrics: Sequence[str], group: Sequence[str]) -> DataFrame:
    """won minus lost value of each metric; null where one of the two is missing."""
    pick = lambda m, w: F.max(F.when(F.col("won") == w, F.col(m)))
    return by_result.groupBy(*group).agg(*((pick(m, True) - pick(m, False)).alias(f"{m}_diff") for m in metrics))


def points_after_turnover(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ORDER, seconds: int | None = None) -> DataFrame:
    """Points that a side scores after the rival's turnover until its possession ends; with ``seconds`` only those within that time."""
    w = Window.partitionBy(*game).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("kind") == "PERDIDA", F.struct("side", *(c for c in ("elapsed",) if seconds is not None)))
    stop = F.when(F.col("kind").isin("PERDIDA", "REBOTE-DEFENSIVO", "CANASTA-2P", "CANASTA-3P", "FINAL-PERIODO"), F.col("kind"))
    rows = events.withColumn("_turn", F.last(turn, ignorenulls=True).over(before)).withColumn("_stop", F.last(stop, ignorenulls=True).over(before))
    hit = (F.col("_stop") == "PERDIDA") & (F.col("side") != F.col("_turn.side")) & F.col("kind").isin(*MADE)
    if seconds is not None:
        hit = hit & (F.col("elapsed") - F.col("_turn.elapsed") <= seconds)
    return rows.where(hit).groupBy(*game, "side").agg(F.sum(points()).alias("pts_after_turnover"))
