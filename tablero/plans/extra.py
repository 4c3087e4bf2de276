"""Queries of possessions, scans over ranges, two leagues, the analysis model and the co-located facts, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import neighbours as nb
from ..operators import possessions as po
from ..operators import scan
from ..operators import similarity as sm
from ..operators import state as ts
from ..operators import winprob as wp
from ..sources import facts
from . import more, roles
from .more_sql import _FG, _Q, FEATURE_ROWS, POSSESSIONS
from .oracle import ACTIONS, BOX, GAMES

GAME, EVENT_ORDER = ("game",), ("ts", "seq")


def possession_events(spark, sf):
    return po.numbered_possessions(roles.actions(spark, sf), GAME, EVENT_ORDER).select("seq", "possession", "attack")


def possession_table(spark, sf):
    a = roles.actions(spark, sf).withColumn("elapsed", fn.elapsed_seconds("period", "clock"))
    return po.possession_table(a, GAME, EVENT_ORDER)


def possession_count(spark, sf):
    return po.possession_count(roles.actions(spark, sf), (), GAME, EVENT_ORDER).withColumn("estimate", F.round("estimate", 6))


def assisted_baskets(spark, sf):
    rows = po.assisted_baskets(roles.actions(spark, sf), GAME, EVENT_ORDER)
    return rows.groupBy("side", "kind").agg(F.count("*").alias("baskets"), F.count_if(F.col("assists") > 0).alias("assisted"), F.sum("assists").alias("assists"))


def scan_ewm_form(spark, sf):
    out = scan.ewm_before(roles.games(spark, sf), ["team"], ["date", "game"], ["price"])
    return out.select("team", "game", F.round("price_ewm", 6).alias("price_ewm"))


def scan_rolling_mean(spark, sf):
    return scan.rolling_before(roles.games(spark, sf), ["team"], ["date", "game"], "pts", 5).select("team", "game", "pts_last5")


def scan_score_fill(spark, sf):
    a = roles.actions(spark, sf)
    seen = a.withColumns({s: F.when(F.col("kind").startswith("CANASTA"), F.col(s)) for s in ("home_score", "away_score")})
    return scan.fill_forward(seen, GAME, EVENT_ORDER, ["home_score", "away_score"]).select("seq", "home_score", "away_score")


def scan_running_points(spark, sf):
    return scan.running_sum(roles.games(spark, sf), ["league"], ["date", "game"], {"pts_so_far": F.col("pts"), "wins_so_far": F.col("won").cast("long")}).select("game", "pts_so_far", "wins_so_far")


def scan_percentiles(spark, sf):
    rows = roles.games(spark, sf).select("league", "game", "pts", F.col("opp_pts").alias("against"), F.when(F.col("game") % 5 > 0, F.col("game") % 40).alias("some"))
    out = scan.percentiles(rows, ["pts", "against", "some"], ["league"])
    return out.select("game", *(F.round(f"{m}_pctile", 9).alias(f"{m}_pctile") for m in ("pts", "against", "some")))


def fixture_fallback(spark, sf):
    """Teams without a value take the league's mean over game rows, in two leagues."""
    g = roles.games(spark, sf).withColumn("league", F.when(F.col("team") % 3 == 0, "a").otherwise("b"))
    g = g.withColumns({"win": F.col("won").cast("int"), "form": F.when(F.col("team") % 7 > 0, (F.col("pts") % 1000).cast("double"))})
    state = wp.team_state(g, ["form"], keys=("league",))
    fixture = roles.table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "a").otherwise("b").alias("league"), F.col("c_custkey").alias("home"), (F.col("c_custkey") + 3).alias("away"), F.lit("2001-08-03").cast("date").alias("date"))
    out = wp.fixture_features(fixture, state, keys=("league",))
    return out.select("league", "home", "away", "rest_diff", F.round("win_last5", 6).alias("win_last5"), F.round("form_ewm", 6).alias("form_ewm"))


def similar_two_leagues(spark, sf):
    """Two leagues with a population, z-scores and matches of their own."""
    cols = [f"f{i}" for i in range(8)]
    v = roles.table(spark, sf, "embeddings").select(F.when(F.col("vec_id") % 3 == 0, "first").otherwise("second").alias("league"), F.col("vec_id").alias("player"), F.lit(1).alias("season"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)))
    z = sm.z_scores(v, cols, ("league",)).withColumn("vector", F.array(*(f"{c}_z" for c in cols)))
    return sm.similar_all(z, 3, keys=("league", "season")).select("league", "player", "match", F.round("score", 6).alias("score"), "rank")


#: Stand-ins for a fitted model of the analysis features, so that SQL can follow.
ANALYSIS_SCALE = {f: (0.1 * i, 1.0 + 50.0 * ("net" in f)) for i, f in enumerate(wp.ANALYSIS)}
ANALYSIS_MODEL = wp.Linear(0.05, tuple(0.3 - 0.07 * i for i in range(len(wp.ANALYSIS))))


def winprob_analysis(spark, sf):
    model = wp.WinModel(wp.ANALYSIS, ANALYSIS_SCALE, [ANALYSIS_MODEL], [(1.0, 0.0)], {})
    rows = more._feature_rows(spark, sf)
    return model.transform(rows).select("game", "team", F.round("prob", 6).alias("prob"))


def nearest_pruned(spark, sf):
    e = roles.table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").alias("player"), F.col("label").alias("season"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return nb.nearest_all(v, 3, keys=("season",), block=64).select("season", "player", "match", F.round("score", 6).alias("score"), "rank")


def streamed_state(spark, sf):
    """Games arrive in three parts; the state kept by the stream scores like that of the whole history."""
    from ..streaming import current_state, keep_state

    work = roles.scratch(spark)
    g = roles.games(spark, sf).select("team", "game", "date", F.col("won").cast("int").alias("win"), F.when(F.col("game") % 4 > 0, F.col("price")).alias("price"))
    for low, high in (("1900-01-01", "1994-06-30"), ("1994-07-01", "1999-01-31"), ("1999-02-01", "2100-01-01")):
        g.where(F.col("date").between(F.lit(low).cast("date"), F.lit(high).cast("date"))).write.mode("append").parquet(f"{work}/landing")
        keep_state(spark, f"{work}/landing", g.schema, f"{work}/state", f"{work}/offsets", ["price"], keys=(), files_per_batch=100_000)
    state = current_state(spark, f"{work}/state")
    out = ts.scoring_state(state, ["price"], keys=())
    return out.select("team", "last_date", *(F.round(c, 4).alias(c) for c in ("win_last5", "price_ewm", "league_win_last5", "league_price_ewm")))


def colocated_result(spark, sf):
    """Box rows with the result of their game, from two bucketed fact tables: neither the join nor the sums shuffle."""
    work, name = roles.scratch(spark), f"tablero_{uuid.uuid4().hex}"
    where = {"league": F.lit("all"), "season": F.floor(F.col("game") / 1000)}
    buckets = facts.bucket_number(roles.box_rows(spark, sf).count())
    box = facts.write_bucketed(roles.box_rows(spark, sf).withColumns(where), f"{name}_box", f"{work}/box", buckets=buckets)
    games = facts.write_bucketed(roles.games(spark, sf).withColumns(where).select(*facts.GAME_KEY, "won"), f"{name}_games", f"{work}/games", buckets=buckets)
    out = facts.game_totals(facts.with_result(box, games), ["pts", "ast"], by=("team", "won")).select("game", "team", "won", "rows", "pts", "ast")
    out._jdf.queryExecution().optimizedPlan()  # the relations are known from here on
    facts.forget(spark, f"{name}_box", f"{name}_games")
    return out


def _own() -> list[Callable[[SparkSession, str], DataFrame]]:
    return [
        possession_events, possession_table, possession_count, assisted_baskets, scan_ewm_form, scan_rolling_mean, scan_score_fill, scan_running_points, scan_percentiles, fixture_fallback,
        similar_two_leagues, winprob_analysis, nearest_pruned, streamed_state, colocated_result,
    ]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _own()}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    q: dict[str, str] = {}
    windows = oracle.oracle_sql()
    q["possession_events"] = f"""WITH {POSSESSIONS}, t AS (SELECT game, n, possession, CASE WHEN begins = 1 THEN side END AS attack FROM nm)
        SELECT act.seq, coalesce(max(possession) OVER w, 0)::BIGINT AS possession, last_value(attack IGNORE NULLS) OVER w AS attack FROM act LEFT JOIN t ON t.game = act.game AND t.n = act.n
        WINDOW w AS (PARTITION BY act.game ORDER BY act.n ROWS UNBOUNDED PRECEDING)"""
    q["possession_table"] = f"WITH {POSSESSIONS} SELECT game, possession::BIGINT AS possession, period, side, pts, second_chances, first_try, seconds_to_try FROM po"
    q["possession_count"] = f"""WITH {POSSESSIONS}, e AS (SELECT nm.*, CASE WHEN kind IN {_FG} OR kind = 'PERDIDA' THEN 1.0::DOUBLE WHEN kind = 'REBOTE-OFENSIVO' THEN -1 WHEN kind IN ('CANASTA-1P', 'TIRO1-FALLADO') THEN 0.44::DOUBLE ELSE 0 END AS v FROM nm WHERE possession > 0 AND NOT edge),
        c AS (SELECT side, count(*) AS possessions FROM po GROUP BY side) SELECT c.side, possessions, round(sum(v), 6) AS estimate FROM c JOIN e USING (side) GROUP BY ALL"""
    q["assisted_baskets"] = f"""WITH {ACTIONS}, pk AS (SELECT a.game, a.n AS assist, max(b.n) AS n FROM act a JOIN act b ON b.game = a.game AND b.side = a.side AND b.n BETWEEN a.n - 4 AND a.n - 1 AND b.kind LIKE 'CANASTA%' WHERE a.kind = 'ASISTENCIA' GROUP BY ALL),
        h AS (SELECT game, n, count(*) AS assists FROM pk GROUP BY ALL)
        SELECT side, kind, count(*) AS baskets, count(assists) AS assisted, coalesce(sum(assists), 0)::BIGINT AS assists FROM act LEFT JOIN h USING (game, n) WHERE kind LIKE 'CANASTA%' AND side IS NOT NULL GROUP BY side, kind"""
    q["scan_ewm_form"], q["scan_rolling_mean"], q["scan_score_fill"] = windows["ewm_form"], windows["rolling_mean_5"], windows["score_ffill"]
    q["scan_running_points"] = f"WITH {GAMES} SELECT game, sum(pts) OVER w::BIGINT AS pts_so_far, sum(won::INT) OVER w::BIGINT AS wins_so_far FROM g WINDOW w AS (PARTITION BY league ORDER BY date, game ROWS UNBOUNDED PRECEDING)"
    pct = lambda m, x: f"round(percent_rank() OVER (PARTITION BY league ORDER BY {x} NULLS FIRST), 9) AS {m}_pctile"
    q["scan_percentiles"] = f"WITH {GAMES} SELECT game, {pct('pts', 'pts')}, {pct('against', 'opp_pts')}, {pct('some', 'CASE WHEN game % 5 > 0 THEN game % 40 END')} FROM g"
    w = _Q.format("back - 1")
    q["fixture_fallback"] = f"""WITH {GAMES}, b AS (SELECT *, CASE WHEN team % 3 = 0 THEN 'a' ELSE 'b' END AS lg, CASE WHEN team % 7 > 0 THEN (pts % 1000)::DOUBLE END AS form, row_number() OVER (PARTITION BY team ORDER BY date DESC, game DESC) AS back FROM g),
        l AS (SELECT lg, avg(form) AS league_form FROM b GROUP BY lg),
        s AS (SELECT lg, team, max(date) AS last_date, avg(won::INT) FILTER (back <= 5) AS win_last5, sum(form * {w}) / sum({w}) FILTER (form IS NOT NULL) AS form FROM b GROUP BY lg, team)
        SELECT lg AS league, h.team AS home, a.team AS away, (greatest(DATE '2001-08-03' - h.last_date, 1) - greatest(DATE '2001-08-03' - a.last_date, 1))::INT AS rest_diff, round(h.win_last5, 6) AS win_last5, round(coalesce(h.form, league_form), 6) AS form_ewm
        FROM s h JOIN s a USING (lg) JOIN l USING (lg) WHERE a.team = h.team + 3"""
    z = ", ".join(f"coalesce((embedding[{i + 1}]::DOUBLE - avg(embedding[{i + 1}]::DOUBLE) OVER l) / nullif(stddev_pop(embedding[{i + 1}]::DOUBLE) OVER l, 0), 0)" for i in range(8))
    q["similar_two_leagues"] = f"""WITH v AS (SELECT CASE WHEN vec_id % 3 = 0 THEN 'first' ELSE 'second' END AS league, vec_id, [{z}] AS e FROM embeddings WINDOW l AS (PARTITION BY vec_id % 3 = 0)),
        s AS (SELECT a.league, a.vec_id AS player, b.vec_id AS "match", list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS score FROM v a JOIN v b ON a.league = b.league AND a.vec_id <> b.vec_id)
        SELECT league, player, "match", round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY score DESC, "match") AS rank FROM s) WHERE rank <= 3"""
    q["nearest_pruned"] = windows["similar_topk"]
    q["streamed_state"] = f"""WITH {GAMES}, b AS (SELECT *, CASE WHEN game % 4 > 0 THEN price END AS p, row_number() OVER (PARTITION BY team ORDER BY date DESC, game DESC) AS back FROM g),
        l AS (SELECT avg(won::INT) AS lw, avg(p) AS lp FROM b)
        SELECT team, max(date) AS last_date, round(avg(won::INT) FILTER (back <= 5), 4) AS win_last5, round(sum(p * {w}) / sum({w}) FILTER (p IS NOT NULL), 4) AS price_ewm, round(any_value(lw), 4) AS league_win_last5, round(any_value(lp), 4) AS league_price_ewm FROM b, l GROUP BY team"""
    q["colocated_result"] = f"""WITH {BOX}, {GAMES} SELECT box.game, box.team, won, count(*) AS rows, sum(box.pts)::BIGINT AS pts, sum(ast)::BIGINT AS ast FROM box LEFT JOIN g ON g.game = box.game GROUP BY ALL"""
    of = {"home": "ft.home", "rest_diff": "ft.rest_diff", "net_rating_ewm": "net_rating_ewm", "efg_pct_ewm": "efg_pct_ewm", "tov_pct_ewm": "tov_pct_ewm"}
    of |= {"delta_efg_pct": "f.efg_pct - f.oefg", "delta_tov_pct": "f.tov_pct - f.otp", "delta_ftr": "f.ftr - f.oftr", "delta_orb_pct": "f.orb_pct - f.oorbp", "delta_net_rating": "(f.ortg - f.drtg) - (f.oortg - f.odrtg)"}
    margin = " + ".join([f"{ANALYSIS_MODEL.intercept!r}::DOUBLE", *(f"({c!r}::DOUBLE) * (coalesce({of[f]}, {ANALYSIS_SCALE[f][0]!r}::DOUBLE) - {ANALYSIS_SCALE[f][0]!r}::DOUBLE) / {ANALYSIS_SCALE[f][1]!r}::DOUBLE" for f, c in zip(wp.ANALYSIS, ANALYSIS_MODEL.coefficients))])
    past = "sum(b.tov_pct * {0}) / sum({0}) FILTER (b.tov_pct IS NOT NULL)".format(_Q.format("a.n - b.n"))
    q["winprob_analysis"] = f"""WITH {FEATURE_ROWS}, nn AS (SELECT game, team, tov_pct, row_number() OVER (PARTITION BY team ORDER BY date, game) AS n FROM f),
        tv AS (SELECT a.game, a.team, {past} AS tov_pct_ewm FROM nn a LEFT JOIN nn b ON b.team = a.team AND b.n < a.n AND b.n >= a.n - 150 GROUP BY a.game, a.team)
        SELECT ft.game, ft.team, round(1 / (1 + exp(-({margin}))), 6) AS prob FROM ft JOIN f USING (game, team) JOIN ew USING (game, team) JOIN tv USING (game, team)"""
    return q
