"""Further registered queries over the driver tables: player similarity, splits, profiles and the parts of the win probability model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import documented as dc
from ..operators import events as ev
from ..operators import lineups as li
from ..operators import possessions as po
from ..operators import reports as rp
from ..operators import shots as sh
from ..operators import similarity as sm
from ..operators import teamgame as tg
from ..operators import winprob as wp
from ..staging import staged
from . import roles

GAME, EVENT_ORDER = ("game",), ("ts", "seq")
LEAST_MINUTES = 100.0


def _opponents(spark: SparkSession, sf: str) -> DataFrame:
    own = tg.team_box(roles.box_rows(spark, sf), context=("date", "rival", "is_home"), keys=())
    t = tg.with_opponent(own, ["pts", "fgm", "fga", "fg3m", "fta", "orb", "drb", "tov"], keys=())
    return t.where("opp_pts is not null").withColumn("won", F.col("pts") > F.col("opp_pts"))


def _seasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.box_rows(spark, sf).withColumn("team", F.col("supplier")).withColumn("league", F.lit("all"))
    return sm.player_seasons(rows, least_minutes=LEAST_MINUTES)


def player_features(spark, sf):
    return sm.z_scores(sm.features(_seasons(spark, sf)), sm.FEATURES).select("player", "season", *sm.FEATURES, F.round("pts_40_z", 6).alias("pts_40_z"), F.round("trb_40_z", 6).alias("trb_40_z"), F.round("ast_tov_z", 6).alias("ast_tov_z"))


def similar_players_all(spark, sf):
    seasons = staged(_seasons(spark, sf))  # read several times
    return sm.similar_all(sm.player_vectors(seasons), 3, keys=("league", "season")).select("season", "player", "match", F.round("score", 6).alias("score"), "rank")


def similar_players_one(spark, sf):
    seasons = staged(_seasons(spark, sf))  # read several times
    vectors = sm.player_vectors(seasons)
    asked = seasons.agg(F.min("player")).first()[0]
    out = sm.similar_players(vectors, asked, 5, keys=("league",))
    return out.select("ref_player", "season", "player", "rank", F.round("score", 1).alias("score"), "team", "games", "minutes", "pts_40", "ast_40", "trb_40", "ts_pct", "efg_pct")


def compare_players(spark, sf):
    seasons = staged(_seasons(spark, sf))  # read several times
    vectors = sm.player_vectors(seasons)
    a, b = (r[0] for r in seasons.select("player").distinct().orderBy("player").limit(2).collect())
    out = sm.compare(vectors, a, b)
    return out.select("feature", "value_a", "value_b", "diff", F.round("diff_z", 6).alias("diff_z"), "alike", "different")


def player_profile(spark, sf):
    box = roles.box_rows(spark, sf).withColumns({"team": F.col("supplier"), "league": F.lit("all"), "season": fn.season_label("date")})
    team = tg.team_box(box, context=("date",), keys=("league", "season")).select("league", "season", "team", "game", fn.possessions("fga", "orb", "tov", "fta").alias("poss"))
    out = rp.player_profile(sm.features(_seasons(spark, sf)), team, keys=("league", "season"))
    return out.select("player", "season", *(F.round(f"{m}_pctile", 6).alias(f"{m}_pctile") for m in rp.PROFILE), F.round("usg_scaled", 6).alias("usg_scaled"))


def top_lineups(spark, sf):
    best = li.top_lineups(li.lineup_ratings(li.court_segments(roles.actions(spark, sf), GAME, size=2, order=EVENT_ORDER), ("side",)), ("side",), 5)
    return best.select("side", "list", "rank", "label", F.round("minutes", 6).alias("minutes"), F.round("net", 6).alias("net"))


def top_scorers(spark, sf):
    per = roles.box_rows(spark, sf).groupBy(F.col("supplier").alias("team"), "player").agg(F.avg("pts").alias("pts_per_game"))
    return rp.top_n(per, ("team",), [F.desc("pts_per_game"), "player"], 6)


def points_by_origin(spark, sf):
    a = roles.actions(spark, sf)
    shots = roles.shots(spark, sf).withColumn("team", F.when(F.col("game") % 2 == 0, "home").otherwise("away"))
    return dc.points_by_origin(a, shots, keys=(), order=EVENT_ORDER)


def period_splits(spark, sf):
    a = roles.actions(spark, sf)
    games = a.select("game").distinct().select("game", (F.col("game") % 10).alias("home"), (F.col("game") % 10 + 10).alias("away"))
    return dc.period_splits(ev.quarter_scores(a, GAME, EVENT_ORDER), games, keys=())


def transition_split(spark, sf):
    a = roles.actions(spark, sf).withColumn("elapsed", fn.elapsed_seconds("period", "clock"))
    return po.transition_split(a, GAME, EVENT_ORDER, seconds=8)


def allowed_efficiency(spark, sf):
    return dc.allowed_efficiency(_opponents(spark, sf), keys=())


def player_phases(spark, sf):
    rows = roles.box_rows(spark, sf).withColumns({"team": F.col("supplier"), "fgm": F.col("fg2m") + F.col("fg3m"), "fga": F.col("fg2a") + F.col("fg3a"), "phase": F.when(F.col("date") >= "1996-01-01", "playoff").otherwise("regular")})
    out = dc.player_phases(rows, keys=())
    return out.select("team", "player", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("team", "player")))


def team_pace(spark, sf):
    t = _opponents(spark, sf).join(roles.box_rows(spark, sf).groupBy("game", "team").agg(F.sum("seconds").alias("seconds")), ["game", "team"])
    return rp.team_report(t, ("team",)).select("team", F.round("pace", 6).alias("pace"), F.round("pace_40", 6).alias("pace_40"))


def close_record(spark, sf):
    games = roles.games(spark, sf).withColumn("game", F.col("game") % 400)
    return rp.close_after_three(ev.quarter_scores(roles.actions(spark, sf), GAME, EVENT_ORDER), games, keys=(), margin=8)


def expected_threes(spark, sf):
    per = tg.team_box(roles.box_rows(spark, sf).withColumn("team", F.col("supplier")), context=("date",), keys=()).groupBy("team").agg(F.count("*").alias("games"), F.sum("fg3a").alias("fg3a"), F.sum("fg3m").alias("fg3m"))
    return rp.expected_three_points(per, keys=()).select("team", "expected_three_pts")


def advantages(spark, sf):
    per = roles.games(spark, sf).groupBy("league", "is_home").agg(F.avg("pts").alias("pts"), F.avg("opp_pts").alias("opp_pts"), F.count_if("won").alias("wins"))
    side = lambda home: per.where(F.col("is_home") == home).drop("is_home")
    return rp.advantage(side(True), side(False), ["pts", "opp_pts", "wins"], on=("league",)).select("league", "metric", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), "sign")


def rest_difference(spark, sf):
    own = tg.team_box(roles.box_rows(spark, sf), stats=("pts",), context=("date", "rival"), keys=())
    return tg.rest_difference(tg.rest_days(own, keys=()), keys=()).select("game", "team", "rest", "opp_rest", "rest_diff")


def team_events(spark, sf):
    return ev.team_event_features(roles.actions(spark, sf), GAME).select("game", "team", F.round("pace", 6).alias("pace"), "clutch_net")


def game_list(spark, sf):
    return tg.game_list(tg.team_box(roles.box_rows(spark, sf), stats=("pts",), context=("date", "is_home"), keys=()), keys=())


def shot_names_missing(spark, sf):
    roster = spark.range(20).select(F.col("id").alias("team"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).select("team", F.col("n").cast("string").alias("jersey"), F.concat(F.lit("p"), "team", F.lit("-"), "n").alias("player"))
    named = sh.with_players(roles.shots(spark, sf).withColumn("jersey", F.concat(F.col("jersey").cast("string"), F.lit(".0"))), roster, keys=())
    return sh.miss_rate(named, keys=("team",))


def event_vocabulary(spark, sf):
    from ..dims import event_dim

    kinds = roles.actions(spark, sf).groupBy(F.col("kind").alias("tipo")).agg(F.count("*").alias("n"))
    return kinds.join(event_dim(spark), "tipo").select("tipo", "n", "points", "poss_weight", "is_fg", "is_made", "is_ft", "is_boundary")


def _feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The model's table: Four Factors of both sides, events of the game of the same number (home is O) and its shots."""
    own = tg.team_box(roles.box_rows(spark, sf), context=("date", "rival", "is_home"), keys=())
    factors = tg.rest_difference(tg.rest_days(tg.four_factors(own, keys=()), keys=()), keys=()).withColumn("won", F.col("pts") > F.col("opp_pts"))
    side = F.when(F.col("team") == "home", "O").otherwise("F")
    events = ev.team_event_features(roles.actions(spark, sf).where("team is not null"), GAME).withColumn("team", side)
    shots = sh.shot_profile(sh.on_court(roles.shots(spark, sf)).withColumn("team", F.when(F.col("game") % 2 == 0, "O").otherwise("F")), ("game", "team")).select("game", "team", "paint_efg", "paint_rate")
    return wp.feature_table(factors, events, shots, keys=())


def feature_table(spark, sf):
    out = _feature_rows(spark, sf)
    six = lambda c: F.round(c, 6).alias(c)
    return out.select("game", "team", "home", "win", "rest_diff", "fg3_pct", six("pace"), "clutch_net", "paint_efg", "paint_rate", F.round("net_rating_ewm", 3).alias("net_rating_ewm"), six("efg_pct_ewm"), six("paint_efg_ewm"), "win_last5")


#: A stand-in for a fitted model, so that SQL can follow: coefficients of the pre-game features, means and deviations, and two calibrations.
FIXED_SCALE = {"home": (0.5, 0.5), "net_rating_ewm": (0.0, 1000.0), "win_last5": (0.5, 0.2), "paint_efg_ewm": (0.3, 0.1), "fg3_pct_ewm": (0.5, 0.1)}
FIXED = [wp.Linear(0.1, (0.368, 0.29, -0.11, 0.129, -0.085)), wp.Linear(-0.05, (0.3, 0.2, 0.1, 0.05, -0.02))]
FIXED_PLATT = [(1.1, 0.02), (0.9, -0.01)]


def _fixed_model() -> wp.WinModel:
    return wp.WinModel(wp.PREGAME, FIXED_SCALE, FIXED, FIXED_PLATT, {})


def winprob_score(spark, sf):
    return _fixed_model().transform(_feature_rows(spark, sf)).select("game", "team", F.round("prob", 6).alias("prob"))


def _fixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = roles.games(spark, sf).withColumns({"win": F.col("won").cast("int"), "net_rating": (F.col("pts") - F.col("opp_pts")) / 10000.0, "paint_efg": (F.col("pts") % 100) / 100.0, "fg3_pct": (F.col("opp_pts") % 100) / 100.0})
    state = wp.team_state(g, ["net_rating", "paint_efg", "fg3_pct"], keys=())
    fixture = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("home"), (F.col("c_custkey") + 1).alias("away"), F.lit("2001-08-03").cast("date").alias("date"))
    return fixture, state


def fixture_predict(spark, sf):
    """Predicted fixtures, written as CSV and read back."""
    from ..sources import tables

    path = f"{roles.scratch(spark)}/predictions"
    tables.write_predictions(wp.predict_fixture(*_fixture(spark, sf), _fixed_model(), keys=()), path)
    return tables.read_csv(spark, path).select("fecha", F.col("local").cast("long").alias("local"), F.col("visitante").cast("long").alias("visitante"), F.col("prob_local").cast("double").alias("prob_local"), F.col("prob_visit").cast("double").alias("prob_visit"))


def _own() -> list[Callable]:
    return [
        player_features, similar_players_all, similar_players_one, compare_players, player_profile, top_lineups, top_scorers, points_by_origin, period_splits, transition_split, allowed_efficiency, player_phases,
        team_pace, close_record, expected_threes, advantages, rest_difference, team_events, game_list, shot_names_missing, event_vocabulary, feature_table, winprob_score, fixture_predict,
    ]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _own()}
