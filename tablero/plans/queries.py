"""One query per operator (or small group of operators), each an application of the library to the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import documented as dc
from ..operators import events as ev
from ..operators import history as hi
from ..operators import lineups as li
from ..operators import reports as rp
from ..operators import shots as sh
from ..operators import similarity as sm
from ..operators import teamgame as tg
from ..operators import winprob as wp
from ..sources import extract, tables
from . import extra, more, pages, roles

GAME, EVENT_ORDER = ("game",), ("ts", "seq")


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    return tg.team_box(roles.box_rows(spark, sf), context=("date", "rival", "is_home"), keys=())


def _factors(spark: SparkSession, sf: str) -> DataFrame:
    return tg.four_factors(_sides(spark, sf), keys=())


def _opponents(spark: SparkSession, sf: str) -> DataFrame:
    own = _sides(spark, sf)
    t = tg.with_opponent(own, ["pts", "fgm", "fga", "fg3m", "fta", "orb", "drb", "tov"], keys=())
    return t.where("opp_pts is not null").withColumn("won", F.col("pts") > F.col("opp_pts"))


def team_game_box(spark, sf):
    return _sides(spark, sf)


def four_factors_opponent(spark, sf):
    cols = ["efg_pct", "tov_pct", "ftr", "orb_pct", "drb_pct", "drb_pct_opp", "ortg", "drtg", "net_rating", "opp_net_rating", "rival_net_rating", "delta_efg_pct", "delta_tov_pct", "delta_ftr", "delta_orb_pct", "delta_net_rating"]
    return _factors(spark, sf).select("game", "team", *cols)


def rest_days(spark, sf):
    return tg.rest_days(roles.games(spark, sf), keys=()).select("team", "game", "rest")


def ewm_form(spark, sf):
    out = hi.ewm_before(roles.games(spark, sf), ["team"], ["date", "game"], ["price"])
    return out.select("team", "game", F.round("price_ewm", 6).alias("price_ewm"))


def rolling_mean_5(spark, sf):
    return hi.rolling_before(roles.games(spark, sf), ["team"], ["date", "game"], "pts", 5).select("team", "game", "pts_last5")


def moving_average_5(spark, sf):
    return hi.moving_average(roles.games(spark, sf), ["team"], ["date", "game"], "pts", 5).select("team", "game", "pts_ma5")


def last_k(spark, sf):
    return hi.last_k(roles.games(spark, sf), ["team"], ["date", "game"], 5, "back").select("team", "game", "back")


def ewm_last5(spark, sf):
    return hi.ewm_last_k(roles.games(spark, sf), ["team"], ["date", "game"], ["price"]).select("team", F.round("price_now", 6).alias("price_now"))


def period_report(spark, sf):
    rows = [(None, "before", None, "1998-06-30", None), (None, "since", "1998-07-01", None, None), (None, "last5", None, None, 5), (10, "own", "1995-01-01", None, None), (10, "last2", None, None, 2), (13, "last2", None, None, 3), (None, "all", None, None, 1200)]
    dim = spark.createDataFrame(rows, "team long, label string, date_from string, date_to string, last_k int").withColumns({c: F.col(c).cast("date") for c in ("date_from", "date_to")})
    member = rp.period_membership(roles.games(spark, sf), dim, keys=())
    return member.groupBy("team", "label").agg(F.count("*").alias("games"), F.sum("pts").alias("pts"), F.count_if("won").alias("wins"))


def team_report(spark, sf):
    return rp.team_report(_opponents(spark, sf), group=("team",))


def record_splits(spark, sf):
    return rp.splits(roles.games(spark, sf), group=("team", "is_home"))


def margins(spark, sf):
    return rp.margins(roles.games(spark, sf), group=("team",))


def ranking(spark, sf):
    return rp.ranking(roles.games(spark, sf), keys=("league",)).select("league", "team", "wins", "losses", "rank")


def against_league(spark, sf):
    per = roles.games(spark, sf).groupBy("league", "team").agg(F.sum("pts").alias("pts"))
    return rp.against_league(per, ["pts"], keys=("league",))


def win_loss_diff(spark, sf):
    by = roles.games(spark, sf).groupBy("team", "won").agg(F.avg("pts").alias("pts"), F.count("*").alias("games"))
    return ev.win_loss_difference(by, ["pts", "games"], ["team"])


def streaks(spark, sf):
    return hi.streaks(roles.games(spark, sf), ["team"], ["date", "game"])


def rest_buckets(spark, sf):
    return tg.rest_days(roles.games(spark, sf), keys=()).groupBy(hi.rest_bucket().alias("bucket")).agg(F.count("*").alias("games"), F.count_if("won").alias("wins"))


def bursts(spark, sf):
    return hi.bursts(roles.games(spark, sf), ["team"], ["date", "game"])


def player_season(spark, sf):
    return sm.player_seasons(roles.box_rows(spark, sf).withColumn("team", F.col("supplier")), keys=(), least_minutes=100.0).select("player", "season", "team", "games", "minutes", "pts", "fg3a", "tov")


def zscore(spark, sf):
    c = roles.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return sm.z_scores(c, ["c_acctbal"], ["c_nationkey"]).select("c_custkey", F.round("c_acctbal_z", 6).alias("z"))


def _vectors(spark, sf):
    e = roles.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("player"), F.col("label").alias("season"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def similar_topk(spark, sf):
    return sm.similar_all(_vectors(spark, sf), 3, keys=("season",)).select("season", "player", "match", F.round("score", 6).alias("score"), "rank")


def compare_pair(spark, sf):
    v = _vectors(spark, sf).select(F.lit("all").alias("league"), F.concat(F.lit("v"), F.col("player").cast("string")).alias("player"), F.col("season").cast("string").alias("season"), *(F.get("vector", F.lit(i)).alias(f"f{i}") for i in range(64)))
    cols = [f"f{i}" for i in range(64)]
    return sm.compare(sm.z_scores(v, cols), "v1", "v2", cols).select("feature", "value_a", "value_b", F.round("diff_z", 6).alias("diff_z"), "alike", "different")


def score_ffill(spark, sf):
    a = roles.actions(spark, sf)
    seen = a.withColumns({s: F.when(F.col("kind").startswith("CANASTA"), F.col(s)) for s in ("home_score", "away_score")})
    return ev.score_fill(seen, game=GAME, order=EVENT_ORDER).select("seq", "home_score", "away_score")


def quarter_delta(spark, sf):
    return ev.quarter_scores(roles.actions(spark, sf), GAME, EVENT_ORDER)


def quarter_points(spark, sf):
    games = roles.actions(spark, sf).select("game").distinct().select("game", (F.col("game") % 10).alias("home"), (F.col("game") % 10 + 10).alias("away"))
    return ev.points_per_quarter(ev.quarter_scores(roles.actions(spark, sf), GAME, EVENT_ORDER), games, keys=())


def pace_weighted(spark, sf):
    return ev.pace(roles.actions(spark, sf), ("game", "team")).withColumn("pace", F.round("pace", 6))


def clutch_net(spark, sf):
    return ev.clutch_net(roles.actions(spark, sf), GAME, ev.clutch("model", 15))


def clutch_share(spark, sf):
    return ev.clutch_shooting(roles.actions(spark, sf), ("game", "team"), ev.clutch("report", 15))


def assist_pairs(spark, sf):
    pairs = ev.assist_pairs(roles.actions(spark, sf), GAME, EVENT_ORDER)
    return ev.pair_counts(pairs, ("side",), top=5)


def second_chance(spark, sf):
    return ev.second_chance(roles.actions(spark, sf), GAME, EVENT_ORDER).select("seq", "second_chance_pts")


def rebound_result(spark, sf):
    a = roles.actions(spark, sf)
    rows = a.where("side is not null").groupBy("game", "team").agg(F.count_if(F.col("kind") == "REBOTE-OFENSIVO").alias("orb"), F.count_if(F.col("kind") == "PERDIDA").alias("opp_drb"), (F.max(F.when(F.col("side") == "LOCAL", F.col("home_score")).otherwise(F.col("away_score"))) % 2 == 0).alias("won"))
    out = ev.rebound_by_result(rows, ev.second_chance(a, GAME, EVENT_ORDER), keys=())
    return out.select("team", "won", "games", "orb", "chances", "chance_pts", "orb_pct", "chance_ppp")


def after_turnover(spark, sf):
    return ev.points_after_turnover(roles.actions(spark, sf), GAME, EVENT_ORDER)


def lineup_segments(spark, sf):
    on = li.court_segments(roles.actions(spark, sf), GAME, size=None, order=EVENT_ORDER, timing=False)
    return on.select("game", "side", "n_from", "n_to", F.array_join("lineup", " / ").alias("lineup"))


def lineup_facts(spark, sf):
    rated = li.lineup_ratings(li.court_segments(roles.actions(spark, sf), GAME, size=2, order=EVENT_ORDER), ("side",), least_minutes=None)
    six = [F.round(c, 6).alias(c) for c in ("minutes", "poss", "opp_poss", "ortg", "drtg", "net", "tov_pct", "fg3_share", "ft_rate", "ast_pct", "poss_per_game")]
    return rated.select("side", F.array_join("lineup", " / ").alias("lineup"), "label", "pts", "opp_pts", "fga", "fgm", "fg3a", "fta", "tov", "ast", "games", *six)


def zone_profile(spark, sf):
    return sh.shot_profile(sh.on_court(roles.shots(spark, sf)), ("team",))


def zone_distribution(spark, sf):
    zones = spark.createDataFrame([(z,) for z in ("Z1-IZ", "Z2-DE", "Z7-IZ", "Z12-DE", "FRANJA-DE", "Z99-DE")], "zone string")
    return sh.zone_distribution(roles.shots(spark, sf).where("zone is not null"), zones, ("team",))


def zone_vs_league(spark, sf):
    return sh.zone_against_league(roles.shots(spark, sf).where("zone is not null"), keys=()).select("team", "zone", "att", "pts", "ppa", "league_ppa")


def jersey_map(spark, sf):
    roster = spark.range(20).select(F.col("id").alias("team"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).select("team", F.concat("n", F.lit(".0")).alias("jersey"), F.concat(F.lit("p"), "team", F.lit("-"), "n").alias("player"))
    named = sh.with_players(roles.shots(spark, sf).withColumn("jersey", F.col("jersey").cast("string")), roster, keys=())
    return named.groupBy("team", "player").agg(F.count("*").alias("shots"))


def shot_cell_parse(spark, sf):
    rows = roles.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.least(F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("m"), F.col("l_quantity").cast("int").alias("a"))
    cell = F.concat(F.bround(100.0 * F.col("m") / F.col("a")).cast("int"), F.col("m"), F.lit("/"), F.col("a"))
    cells = rows.select(cell.alias("cell"), F.concat("m", F.lit("/"), "a").alias("plain")).groupBy("cell", "plain").agg(F.count("*").alias("_n"))
    got, plain = fn.split_pct_cell("cell"), fn.split_made_att("plain")  # equal cells are read once
    return cells.select(got["made"].alias("made"), got["att"].alias("att"), plain["made"].alias("plain_made"), plain["pct"].alias("plain_pct"), "_n").groupBy("made", "att", "plain_made", "plain_pct").agg(F.sum("_n").alias("n"))


def name_split(spark, sf):
    c = roles.table(spark, sf, "customer")
    n = fn.full_name(F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(", "), "c_name")).otherwise(F.concat("c_name", F.lit(" "), "c_mktsegment")))
    return c.select("c_custkey", n["last"].alias("last_name"), n["first"].alias("first_name"), n["full"].alias("full_name"))


def clock_parse(spark, sf):
    e = roles.table(spark, sf, "events")
    text = F.concat(F.lit("Cuarto "), F.col("event_id") % 4 + 1, F.lit(" - 00:"), F.date_format("ts", "mm:ss"))
    pc, sc = fn.period_clock(text), fn.score_pair(F.concat(F.col("user_id"), F.lit(" - "), F.col("event_id") % 100))
    return e.select("event_id", pc["period"].alias("period"), fn.clock_seconds(pc["clock"]).alias("seconds"), sc["home"].alias("home"), sc["away"].alias("away"))


def date_stadium(spark, sf):
    o = roles.table(spark, sf, "orders")
    ds = fn.date_stadium(F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 21:30"), F.col("o_orderpriority")))
    return o.select("o_orderkey", fn.day_first(ds["date"]).alias("date"), ds["time"].alias("time"), ds["stadium"].alias("stadium"), fn.season_label(fn.day_first(ds["date"])).alias("season"))


def link_extract(spark, sf):
    found = extract.links(roles.table(spark, sf, "pages"), 'href="([^"]+)"')
    return found.groupBy("link").agg(F.count_distinct("page_id").alias("pages"), F.min("pos").alias("first_pos"))


def dedupe_first(spark, sf):
    found = extract.links(roles.table(spark, sf, "pages"), 'href="([^"]+)"')
    return extract.first_of(found, ["link"], ["page_id", "pos"]).select("link", "page_id", "pos")


def json_explode(spark, sf):
    e = roles.table(spark, sf, "events")
    arr = F.from_json(F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]")), "array<struct<k: int>>")
    return e.select("event_id", F.posexplode(arr).alias("pos", "s")).select("event_id", "pos", F.col("s.k").alias("k"))


def incremental_new(spark, sf):
    o = roles.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old = o.where("o_orderkey % 3 = 0").withColumn("o_custkey", F.lit(-1).cast("long"))
    return tables.merged(old, o.unionByName(o.where("o_orderkey % 5 = 0")), ["o_orderkey"])


def time_folds(spark, sf):
    f = hi.temporal_folds(roles.games(spark, sf), "date", ["game"], 5)
    return f.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("game").alias("games"))


def temporal_cut(spark, sf):
    return hi.temporal_cut(roles.games(spark, sf), "date", ["game"]).select("game", "is_train")


def auc_logloss(spark, sf):
    rows = roles.table(spark, sf, "labels").join(roles.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    scored = rows.select(F.col("quality").alias("win"), F.col("toxic"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("prob"))
    out = wp.metrics(scored, group=["toxic"])
    return out.select("toxic", "n", F.round("accuracy", 6).alias("accuracy"), F.round("auc", 6).alias("auc"), F.round("log_loss", 6).alias("log_loss"))


def fixture_state_join(spark, sf):
    g = roles.games(spark, sf).withColumn("win", F.col("won").cast("int"))
    state = wp.team_state(g, ["price"], keys=())
    fixture = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("home"), (F.col("c_custkey") + 1).alias("away"), F.lit("2001-08-03").cast("date").alias("date"))
    out = wp.fixture_features(fixture, state, keys=())
    return out.select("home", "away", "rest", "opp_rest", "rest_diff", F.round("win_last5", 6).alias("win_last5"), F.round("price_ewm", 4).alias("price_ewm"))


def percentile_profile(spark, sf):
    c = roles.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rp.percentiles(c, ["c_acctbal"], keys=("c_nationkey",)).select("c_custkey", F.round("c_acctbal_pctile", 6).alias("pctile"))


def half_season_trend(spark, sf):
    return rp.half_season_trend(roles.games(spark, sf), "pts", group=("team",))


def player_report(spark, sf):
    rows = roles.box_rows(spark, sf).withColumns({"team": F.col("supplier"), "fgm": F.col("fg2m") + F.col("fg3m"), "fga": F.col("fg2a") + F.col("fg3a")})
    # a team's totals hold one turnover a game that no player has
    totals = tg.team_box(rows.drop("fgm", "fga"), context=("date",), keys=()).withColumn("tov", F.col("tov") + 1)
    out = rp.player_report(rows, ("team",), totals)
    six = [F.round(c, 6).alias(c) for c in ("minutes", "min_per_game", "usg_share5", "usg_scaled", "tov_pct")]
    return rp.top_n(out, ("team",), [F.desc("minutes"), "player"], 8).select("team", "player", "gp", "pts_per_game", "efg_pct", "fg3_share", "ast_pct", "ast_per_fgm", "ast_tov", *six, "rank")


def head_to_head(spark, sf):
    return rp.records(tg.head_to_head(_opponents(spark, sf), "O", "F"), group=("team", "rival"))


def foul_trouble(spark, sf):
    return rp.foul_trouble(roles.box_rows(spark, sf), group=("player",))


def rotation(spark, sf):
    rows = roles.box_rows(spark, sf).groupBy("supplier", "player").agg(F.avg("seconds").alias("min_per_game"))
    return rp.rotation(rows.withColumnRenamed("supplier", "team"), group=("team",), n=8)


def zone_rules(spark, sf):
    from ..dims import zone_category

    rows = roles.shots(spark, sf).select("zone", *(zone_category("zone", r).alias(r) for r in ("model", "report", "document")))
    return rows.groupBy("zone", "model", "report", "document").agg(F.count("*").alias("n"))


def clutch_team(spark, sf):
    a = roles.actions(spark, sf)
    last = a.groupBy("game").agg(F.max("home_score").alias("h"), F.max("away_score").alias("a"))
    results = last.select("game", F.explode(F.array(F.struct(F.lit("home").alias("team"), (F.col("h") > F.col("a")).alias("won")), F.struct(F.lit("away").alias("team"), (F.col("a") > F.col("h")).alias("won")))).alias("r")).select("game", "r.*")
    out = dc.clutch_team_report(a, ev.clutch("team"), GAME, keys=(), results=results)
    return out.select("team", "games", "wins", "losses", "pts", "opp_pts", "fga", "fgm", "tov", "efg_pct", *(F.round(c, 6).alias(c) for c in ("poss", "opp_poss", "ortg", "drtg", "tov_pct")))


def overtime_record(spark, sf):
    games = roles.games(spark, sf).withColumn("game", F.col("game") % 400)
    return dc.overtime_record(roles.actions(spark, sf), games, keys=())


def stretch_points(spark, sf):
    return dc.stretch_points(roles.actions(spark, sf), 3, 180, game=GAME)


def phase_comparison(spark, sf):
    cutoffs = spark.createDataFrame([("O", "2000-01-01"), ("F", "1994-01-01")], "team string, cutoff string").withColumn("cutoff", F.col("cutoff").cast("date"))
    rows = rp.phase(_opponents(spark, sf), cutoffs, keys=())
    out = dc.phase_comparison(rows, keys=())
    return out.select("team", *(F.round(c, 6).alias(c) for c in out.columns if c != "team"))


def recent_form(spark, sf):
    rows = _factors(spark, sf).where("opp_pts is not null").withColumns({"won": F.col("pts") > F.col("opp_pts"), "reb": F.col("orb") + F.col("drb")})
    return dc.recent_form(rows, 10, keys=()).select("team", "game", "back", "date", "rival", "is_home", "won", "pts", "opp_pts", "efg_pct", "tov", "reb", "ortg", "drtg", "net_rating")


def usage_per_game(spark, sf):
    box = roles.box_rows(spark, sf).withColumn("team", F.col("supplier"))
    rows = box.groupBy("team", "game", "player").agg(*(F.sum(c).alias(c) for c in ("seconds", "fg2a", "fg3a", "fta", "tov"))).withColumn("fga", F.col("fg2a") + F.col("fg3a"))
    team = tg.team_box(box, context=("date",), keys=()).select("team", "game", fn.possessions("fga", "orb", "tov", "fta", 1.0).alias("poss"))
    return dc.usage_per_game(rows, team, keys=()).select("team", "game", "player", F.round("usage", 6).alias("usage"))


def allowed_zones(spark, sf):
    shots = roles.shots(spark, sf).withColumn("rival", (F.col("team") + 1) % 20)
    return dc.allowed_zones(shots, keys=()).select("team", "shots", "paint_att", "mid_att", "triple_att", "paint_efg")


def executive_comparison(spark, sf):
    return dc.executive_comparison(_opponents(spark, sf), "O", "F", keys=()).select("metric", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def _model_rows(spark, sf):
    g = roles.games(spark, sf).withColumns({"win": F.col("won").cast("int"), "home": F.col("is_home").cast("int"), "form": F.col("pts") / 1e7})
    g = hi.ewm_before(g, ["team"], ["date", "game"], ["form"])
    g = hi.rolling_before(g, ["team"], ["date", "game"], "win", 5)
    # a target that depends on the features, so that the model has something to learn
    signal = F.col("home") * 0.4 + F.col("form_ewm") * 0.3 + F.pmod(F.col("game") * 2654435761, F.lit(1000)) / 500.0 > 1.9
    return g.withColumn("win", signal.cast("int"))


MODEL_FEATURES = ["home", "form_ewm", "win_last5"]


def winprob_scaling(spark, sf):
    cut = hi.temporal_cut(_model_rows(spark, sf).dropna(subset=[*MODEL_FEATURES, "win"]), "date", ["game"]).where("is_train")
    scale = wp.scaling(cut, MODEL_FEATURES)
    n = cut.count()
    return spark.createDataFrame([(f, n, round(m, 9), round(d, 9)) for f, (m, d) in scale.items()], "feature string, n long, mean double, deviation double")


def winprob_fit(spark, sf):
    model = wp.train(_model_rows(spark, sf), MODEL_FEATURES)
    return model.coefficients(spark).select("feature", F.round("coefficient", 4).alias("coefficient"))


def _four(metrics):
    return metrics.select(*(c for c in metrics.columns if c not in ("accuracy", "auc", "log_loss")), *(F.round(c, 4).alias(c) for c in ("accuracy", "auc", "log_loss")))


def winprob_cv(spark, sf):
    return _four(wp.cross_validate(_model_rows(spark, sf), MODEL_FEATURES, order=["game"]))


def winprob_cv_summary(spark, sf):
    out = wp.cv_summary(wp.cross_validate(_model_rows(spark, sf), MODEL_FEATURES, order=["game"]))
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


def winprob_holdout(spark, sf):
    model, scored = wp.train_holdout(_model_rows(spark, sf), MODEL_FEATURES, order=["game"])
    return _four(wp.metrics(scored).withColumn("n_train", F.lit(model.meta["n_rows"]).cast("long")))


def winprob_platt(spark, sf):
    rows = _model_rows(spark, sf)
    model = wp.train_calibrated(rows, MODEL_FEATURES, order=["game"])
    return _four(wp.metrics(model.transform(rows.dropna(subset=MODEL_FEATURES))))


def winprob_retrain(spark, sf):
    """The production model, saved and read back, scores its rows; its metadata beside them."""
    rows = _model_rows(spark, sf)
    model = wp.retrain(rows, f"{roles.scratch(spark)}/model", MODEL_FEATURES, order=["game"])
    out = model.transform(rows.dropna(subset=MODEL_FEATURES))
    return out.select("game", F.round("prob", 3).alias("prob"), F.lit(model.meta["n_rows"]).alias("n_rows"), F.lit(model.meta["last_date"]).alias("last_date"))


def stream_ingest(spark, sf):
    work = roles.scratch(spark)
    events = roles.table(spark, sf, "events")
    games = events.select(F.col("user_id").alias("game"), "event_id", "event_type")
    games.repartition(2).write.parquet(f"{work}/landing")
    games.where("game % 2 = 0").withColumns({"run": F.lit("before"), "batch": F.lit(0).cast("long")}).write.partitionBy("run", "batch").parquet(f"{work}/target")
    from ..streaming import ingest_stream

    ingest_stream(spark, f"{work}/landing", games.schema, f"{work}/target", f"{work}/offsets", key=("game",), files_per_batch=1000).awaitTermination()
    return spark.read.schema(games.schema).parquet(f"{work}/target").groupBy("game").agg(F.count("*").alias("n"))


def _own() -> list[Callable]:
    return [
        team_game_box, four_factors_opponent, rest_days, ewm_form, rolling_mean_5, moving_average_5, last_k, ewm_last5, period_report, team_report, record_splits, margins, ranking, against_league,
        win_loss_diff, streaks, rest_buckets, bursts, player_season, zscore, similar_topk, compare_pair, score_ffill, quarter_delta, quarter_points, pace_weighted, clutch_net, clutch_share, assist_pairs,
        second_chance, rebound_result, after_turnover, lineup_segments, lineup_facts, zone_profile, zone_distribution, zone_vs_league, jersey_map, shot_cell_parse, name_split, clock_parse, date_stadium,
        link_extract, dedupe_first, json_explode, incremental_new, time_folds, temporal_cut, auc_logloss, fixture_state_join, percentile_profile, half_season_trend, player_report, head_to_head, foul_trouble,
        rotation, zone_rules, clutch_team, overtime_record, stretch_points, phase_comparison, recent_form, usage_per_game, allowed_zones, executive_comparison, winprob_scaling, winprob_fit, winprob_cv, winprob_cv_summary, winprob_holdout, winprob_platt, winprob_retrain, stream_ingest,
    ]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _own()} | more.queries() | pages.queries() | extra.queries()
