import random

import pytest
from pyspark.sql import functions as F

from tablero import plans
from tablero.operators import events as ev
from tablero.operators import history as hi
from tablero.operators import lineups as li
from tablero.operators import reports as rp
from tablero.operators import shots as sh
from tablero.operators import similarity as sm
from tablero.operators import teamgame as tg
from tablero.operators import winprob as wp

KINDS = ["CANASTA-1P", "CANASTA-2P", "CANASTA-3P", "TIRO2-FALLADO", "PERDIDA", "REBOTE-OFENSIVO", "REBOTE-DEFENSIVO", "ASISTENCIA", "FINAL-PERIODO", "CAMBIO-JUGADOR-ENTRA", "CAMBIO-JUGADOR-SALE"]


@pytest.fixture(scope="module")
def stream():
    """(game, num, seq, kind, side, player) with null and equal numbers."""
    rng, rows = random.Random(11), []
    for game in range(4):
        num = 0
        for seq in range(150):
            num += rng.random() < 0.8
            kind = rng.choice(KINDS)
            side = None if kind == "FINAL-PERIODO" else rng.choice(["LOCAL", "VISITANTE"])
            player = None if rng.random() < 0.1 else f"p{rng.randrange(7)}"
            rows.append((game, num if rng.random() < 0.95 else None, seq, kind, side, player, "x"))
    return rows


@pytest.fixture(scope="module")
def events(spark, stream):
    return spark.createDataFrame(stream, "game long, num int, seq int, kind string, side string, player string, team string").cache()


def in_order(stream):
    by = {}
    for r in stream:
        by.setdefault(r[0], []).append(r)
    return {g: sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for g, rs in by.items()}


def test_assist_pairs_against_a_loop(events, stream):
    want = []
    for g, rows in in_order(stream).items():
        for i, r in enumerate(rows):
            if r[3] == "ASISTENCIA":
                for b in reversed(rows[max(0, i - 4) : i]):
                    if b[4] == r[4] and b[3].startswith("CANASTA"):
                        want.append((g, r[4], r[5], b[5]))
                        break
    got = [(r["game"], r["side"], r["passer"], r["scorer"]) for r in ev.assist_pairs(events, ("game",)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and want


@pytest.mark.parametrize("dedupe", [False, True])
def test_second_chance_against_a_loop(events, stream, dedupe):
    points = {"CANASTA-1P": 1, "CANASTA-2P": 2, "CANASTA-3P": 3}
    want = []
    for g, rows in in_order(stream).items():
        for i, r in enumerate(rows):
            if r[3] != "REBOTE-OFENSIVO":
                continue
            total, nested = 0, False
            for b in rows[i + 1 :]:
                own = b[4] == r[4]
                if own and b[3] == "REBOTE-OFENSIVO":
                    nested = True
                if own:
                    total += points.get(b[3], 0)
                if b[3] in ("REBOTE-DEFENSIVO", "FINAL-PERIODO") or own and b[3] in ("PERDIDA", "CANASTA-2P", "CANASTA-3P"):
                    break
            if not (dedupe and nested):
                want.append((g, r[2], total))
    got = [(r["game"], r["seq"], r["second_chance_pts"]) for r in ev.second_chance(events, ("game",), dedupe_possession=dedupe).collect()]
    assert sorted(got) == sorted(want) and want


def test_players_on_court_against_a_set_loop(events, stream):
    a = li.numbered(events, ("game",))
    got = {(r["game"], r["side"], r["n_from"]): set(r["lineup"]) for r in li.on_court(li.segments(a, ("game",)), li.stints(a, ("game",)), ("game",), size=None).collect()}
    for g, rows in in_order(stream).items():
        on = {"LOCAL": set(), "VISITANTE": set()}
        for n, r in enumerate(rows, 1):
            if r[3] == "CAMBIO-JUGADOR-ENTRA" and r[5]:
                on[r[4]].add(r[5])
            if r[3] == "CAMBIO-JUGADOR-SALE" and r[5]:
                on[r[4]].discard(r[5])
            for side in on:
                if (g, side, n) in got:
                    assert got[g, side, n] == on[side]


def test_ewm_matches_pandas_and_does_not_leak(spark):
    rng = random.Random(3)
    rows = [(k, i, None if rng.random() < 0.15 else rng.random()) for k in range(3) for i in range(40)]
    got = hi.ewm_before(spark.createDataFrame(rows, "team long, game long, x double"), ["team"], ["game"], ["x"]).toPandas().sort_values(["team", "game"])
    for _, part in got.groupby("team"):
        want = part["x"].shift(1).ewm(span=10, min_periods=1).mean()
        assert ((part["x_ewm"] - want).abs().fillna(0) < 1e-12).all() and (part["x_ewm"].isna() == want.isna()).all()


def test_folds_have_the_published_sizes(spark):
    rows = spark.range(637).select((F.col("id") / 4).cast("int").alias("d"), F.col("id").alias("game"))
    rows = rows.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    got = {(r["fold"], r["role"]): r["count"] for r in hi.temporal_folds(rows, "date", ["game"]).groupBy("fold", "role").count().collect()}
    assert [got[k, "train"] for k in range(1, 6)] == [107, 213, 319, 425, 531] and {got[k, "test"] for k in range(1, 6)} == {106}
    assert hi.temporal_cut(rows, "date", ["game"]).where("is_train").count() == 477


def test_four_factor_signs(spark):
    out = plans.queries()["four_factors_opponent"](spark, "/root/testdata/sf0.001").toPandas()
    both = out[out.groupby("game")["team"].transform("count") == 2].sort_values(["game", "team"])
    a, b = both.iloc[::2].reset_index(), both.iloc[1::2].reset_index()
    for c in ("delta_efg_pct", "delta_tov_pct", "delta_ftr", "net_rating"):
        assert ((a[c] + b[c]).abs().fillna(0) < 1e-9).all()
    assert ((a["net_rating"] - b["rival_net_rating"]).abs() < 1e-9).all()
    alone = out[out.groupby("game")["team"].transform("count") == 1]
    assert alone["net_rating"].isna().all()


def test_totals_are_not_counted_twice(spark):
    rows = [("L", "S", "g", "A", 10, False), ("L", "S", "g", "A", 12, False), ("L", "S", "g", "A", 22, True)]
    box = spark.createDataFrame(rows, "league string, season string, game string, team string, pts long, is_total boolean")
    for source, want in (("totals", 22), ("players", 22), ("all", 44)):
        assert tg.team_box(box, ("pts",), (), source=source).first()["pts"] == want


def test_rest_ties_and_membership(spark):
    rows = [("a", 1, "2024-01-01"), ("a", 2, "2024-01-01"), ("a", 3, "2024-01-04")]
    games = spark.createDataFrame(rows, "team string, game long, date string").withColumn("date", F.col("date").cast("date"))
    assert [r["rest"] for r in tg.rest_days(games, keys=()).orderBy("game").collect()] == [7, 0, 3]
    dim = spark.createDataFrame([(None, "all", None, None, None), ("a", "late", "2024-01-02", None, None), (None, "last2", None, None, 2)], "team string, label string, date_from string, date_to string, last_k int")
    dim = dim.withColumns({c: F.col(c).cast("date") for c in ("date_from", "date_to")})
    got = {r["label"]: r["count"] for r in rp.period_membership(games, dim, keys=()).groupBy("label").count().collect()}
    assert got == {"all": 3, "late": 1, "last2": 2}


def test_similarity_is_symmetric_and_unknown_players_raise(spark):
    v = spark.createDataFrame([("L", "S", p, [float(i == k) for i in range(4)] + [0.5]) for k, p in enumerate("abcd")], "league string, season string, player string, vector array<double>")
    got = {(r["player"], r["match"]): r["score"] for r in sm.similar_all(v, 3, block=2).collect()}
    assert all(abs(got[a, b] - got[b, a]) < 1e-12 for a, b in got) and len(got) == 12
    assert sm.similar_players(v, "a", 2).count() == 2
    with pytest.raises(ValueError, match="close names"):
        sm.similar_players(v, "zz")


def test_metrics_count_ties_half(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)]
    got = wp.metrics(spark.createDataFrame(rows, "win int, prob double")).first()
    assert got["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4) and got["accuracy"] == 0.5


def test_win_model_round_trip(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        x, h = rng.gauss(0, 1), rng.randrange(2)
        rows.append((i // 2, i, "t", h, x, int(x + 0.5 * h + rng.gauss(0, 1) > 0)))
    df = spark.createDataFrame(rows, "d int, game long, team string, home int, form double, win int").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    model = wp.train_calibrated(df, ["home", "form"], folds=3)
    scored = model.transform(df)
    assert wp.metrics(scored).first()["auc"] > 0.7
    model.save(spark, f"file://{tmp_path}/model")
    again = wp.WinModel.load(spark, f"file://{tmp_path}/model").transform(df)
    assert scored.join(again.select("game", F.col("prob").alias("p2")), "game").where(F.abs(F.col("prob") - F.col("p2")) > 1e-12).count() == 0
    cv = wp.cross_validate(df, ["home", "form"], folds=2).orderBy("fold").collect()
    assert [r["n_train"] for r in cv] == [100, 200]


def test_plans_have_no_cartesian_product(spark):
    for name in ("four_factors_opponent", "ewm_form", "second_chance", "lineup_segments", "time_folds"):
        plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name


def test_zone_distribution_keeps_zones_outside_the_dimension(spark):
    rows = [("a", "Z1-IZ", "TIRO2", "CONVERTIDO"), ("a", "Z5-IZ", "TIRO2", "FALLADO"), ("b", "Z5-IZ", "TIRO2", "CONVERTIDO"), ("b", None, "TIRO2", "FALLADO")]
    shots = spark.createDataFrame(rows, "team string, zone string, kind string, result string")
    got = {(r["team"], r["zone"]): (r["att"], r["share"]) for r in sh.zone_distribution(shots, spark.createDataFrame([("Z1-IZ",), ("Z99-DE",)], "zone string"), ("team",)).collect()}
    assert got == {("a", "Z1-IZ"): (1, 0.5), ("a", "Z5-IZ"): (1, 0.5), ("a", "Z99-DE"): (0, 0.0), ("b", "Z1-IZ"): (0, 0.0), ("b", "Z5-IZ"): (1, 1.0), ("b", "Z99-DE"): (0, 0.0)}


def test_ewm_of_keys_with_very_many_rows(spark):
    rng = random.Random(4)
    rows = [("long", i, None if i % 7 == 3 or 4000 <= i < 5500 else 1e5 * rng.random()) for i in range(9000)] + [("short", i, float(i)) for i in range(30)]
    got = hi.ewm_before(spark.createDataFrame(rows, "team string, game long, x double"), ["team"], ["game"], ["x"]).toPandas().sort_values(["team", "game"])
    assert list(got.columns) == ["team", "game", "x", "x_ewm"] and len(got) == 9030
    for _, part in got.groupby("team"):
        want = part["x"].ewm(span=10, min_periods=1).mean().shift(1)
        assert (part["x_ewm"].isna() == want.isna()).all() and ((part["x_ewm"] - want).abs().fillna(0) < 1e-6).all()


def test_period_membership_keeps_more_than_a_thousand_last_games(spark):
    games = spark.range(1500).select(F.lit("a").alias("team"), F.col("id").alias("game"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    dim = spark.createDataFrame([(None, "last1200", None, None, 1200), (None, "last2", None, None, 2)], "team string, label string, date_from date, date_to date, last_k int")
    got = {r["label"]: r["count"] for r in rp.period_membership(games, dim, keys=()).groupBy("label").count().collect()}
    assert got == {"last1200": 1200, "last2": 2}


def test_period_membership_keeps_teams_and_keys_apart(spark):
    rows = [("l", t, d, f"2024-01-{d:02d}") for t in "AB" for d in range(1, 10)]
    games = spark.createDataFrame(rows, "league string, team string, game int, date string").withColumn("date", F.col("date").cast("date"))
    dim = [("l", "A", "last3", None, None, 3), (None, None, "early", None, "2024-01-02", None), ("other", None, "none", None, None, 5), (None, "B", "last1", None, None, 1)]
    dim = spark.createDataFrame(dim, "league string, team string, label string, date_from string, date_to string, last_k int").withColumns({c: F.col(c).cast("date") for c in ("date_from", "date_to")})
    got = sorted((r["label"], r["team"], r["game"]) for r in rp.period_membership(games, dim, keys=("league",)).collect())
    assert got == sorted([("last3", "A", d) for d in (7, 8, 9)] + [("early", t, d) for t in "AB" for d in (1, 2)] + [("last1", "B", 9)])


def test_player_features_by_hand(spark):
    one = {"player": "P", "season": "s", "minutes": 400.0, "pts": 200, "fg2m": 50, "fg2a": 100, "fg3m": 20, "fg3a": 50, "ftm": 40, "fta": 50, "orb": 30, "drb": 70, "ast": 60, "stl": 20, "blk": 10, "tov": 30}
    r = sm.features(spark.createDataFrame([one])).first()
    want = {"pts_40": 20, "fga_40": 15, "ast_40": 6, "trb_40": 10, "stl_40": 2, "blk_40": 1, "tov_40": 3, "fg3a_40": 5, "fta_40": 5, "fg_pct": 70 / 150, "fg3_pct": 0.4, "ft_pct": 0.8, "efg_pct": 80 / 150, "ts_pct": 200 / (2 * (150 + 22)), "ast_tov": 2, "fg3_rate": 1 / 3, "ft_rate": 1 / 3, "orb_share": 0.3, "drb_share": 0.7}
    assert set(want) == set(sm.FEATURES) and all(abs(r[f] - v) < 1e-12 for f, v in want.items())
    assert abs(sum(sm.WEIGHTS.values()) - 1) < 1e-12 and sum(w == 0 for w in sm.WEIGHTS.values()) == 4


def test_lineup_minutes_span_the_boundaries(spark):
    ddl = "game int, seq int, kind string, side string, player string, period int, clock int"
    rows = [(1, 1, "INICIO-PERIODO", None, None, 1, None), (1, 2, "CAMBIO-JUGADOR-ENTRA", "LOCAL", "A", 1, 600), (1, 3, "CANASTA-2P", "LOCAL", "A", 1, 500), (1, 4, "REBOTE-OFENSIVO", "LOCAL", "A", 1, 450), (1, 5, "CAMBIO-JUGADOR-SALE", "LOCAL", "A", 1, 100), (1, 6, "CAMBIO-JUGADOR-ENTRA", "LOCAL", "B", 1, 100), (1, 7, "FINAL-PERIODO", None, None, 1, None), (1, 8, "INICIO-PERIODO", None, None, 2, None), (1, 9, "FINAL-PERIODO", None, None, 2, None)]
    a = li.timed(li.numbered(spark.createDataFrame(rows, ddl), ("game",), ("seq",)), ("game",))
    on = li.on_court(li.segments(a, ("game",)), li.stints(a, ("game",)), ("game",), size=1)
    facts = li.segment_facts(a.withColumn("team", F.lit("t")), on, ("game",))
    got = {tuple(r["lineup"]): (r["seconds"], r["poss"]) for r in facts.groupBy("lineup").agg(F.sum("seconds").alias("seconds"), F.sum("poss").alias("poss")).collect()}
    assert got == {("A",): (500, 0.0), ("B",): (700, 0.0)}


def test_latest_team_of_a_player_with_two_teams_in_the_last_game(spark):
    rows = [("x", 1, team, "2024-05-01", 600 * 60, 1) for team in (7, 9, 8)] + [("x", 1, 3, "2024-04-01", 60, 1)]
    box = spark.createDataFrame(rows, "player string, game long, team long, date string, seconds long, pts long").withColumn("date", F.col("date").cast("date"))
    for order in ("team", F.desc("team")):
        got = sm.player_seasons(box.orderBy(order).coalesce(1), keys=(), stats=("pts",))
        assert [r["team"] for r in got.collect()] == [9]


def test_profile_ranks_of_equal_teams_do_not_hang_on_row_order(spark):
    from tablero.operators import reports as rp

    seasons = spark.createDataFrame([(f"p{t}", t, 100.0, 3, 50, 40, 10, 20, 8, 5) for t in range(12)], "player string, team long, minutes double, games long, pts long, fga long, fta long, tov long, ast long, trb long")
    same = {m: F.lit(1.0) for m in rp.PROFILE if m not in ("pts_per_game", "usg_scaled")}
    poss = [0.44 * k + 0.1 for k in range(40)]
    games = spark.createDataFrame([(t, g, poss[(g * (2 * t + 1)) % 40]) for t in range(12) for g in range(40) if len({(g * (2 * t + 1)) % 40 for g in range(40)}) == 40], "team long, game long, poss double").coalesce(1)
    out = rp.player_profile(seasons.withColumns(same), games, keys=()).where("usg_scaled is not null").collect()
    assert len({r["usg_scaled"] for r in out}) == 1 and len({r["usg_scaled_pctile"] for r in out}) == 1 and len(out) > 3


def test_similar_all_sends_a_row_to_few_blocks_and_ties_go_to_the_smaller_id(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(sm, "GRID", 3)
    monkeypatch.setattr(sm, "TILE", 7)
    rng = np.random.default_rng(1)
    rows = [("a", i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(60)]
    got = sm.similar_all(spark.createDataFrame(rows, "season string, player long, vector array<double>"), 4, ("season",), block=4).collect()
    v = np.array([r[2] for r in rows])
    norm = np.linalg.norm(v, axis=1)
    s = np.divide(v @ v.T, np.outer(norm, norm), out=np.zeros((60, 60)), where=np.outer(norm, norm) > 0)
    assert sorted((r["player"], r["rank"], r["match"]) for r in got) == [(i, k + 1, j) for i in range(60) for k, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:4])]


def test_similar_all_compares_few_of_all_pairs_and_equal_players_once(spark, monkeypatch):
    import numpy as np

    from tablero.operators import regions

    monkeypatch.setattr(sm, "GRID", 5)
    monkeypatch.setattr(regions, "LEAF", 16)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(800, 3)).round(2)  # few dimensions, as player seasons have
    wide = rng.normal(size=(120, 12))
    each = [("a", i, points[i % 800].tolist()) for i in range(2000)] + [("b", 5000 + i, wide[i].tolist()) for i in range(120)] + [("a", 9001, [0.0] * 3), ("b", 9002, [0.0] * 12), ("c", 1, [1.0, 2.0])]
    got = sm.similar_all(spark.createDataFrame(each, "season string, player long, vector array<double>"), 4, ("season",), block=100).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault((r["season"], r["player"]), []).append((r["match"], r["score"]))
    for season in "ab":
        ids = [i for s, i, _ in each if s == season]
        v = np.array([x for s, _, x in each if s == season])
        square, s = sum(x * x for x in v.T), sum(np.outer(x, x) for x in v.T)
        length = np.outer(np.sqrt(square), np.sqrt(square))
        s = np.divide(s, length, out=np.zeros_like(s), where=length > 0)
        for k, i in enumerate(ids):
            want = sorted(((ids[j], s[k, j]) for j in range(len(ids)) if j != k), key=lambda x: (-x[1], x[0]))[:4]
            assert found[season, i] == want
    assert ("c", 1) not in found
    # the work: columns that rows are scored against
    v = regions.Vectors(rng.normal(size=(4000, 3)))
    scored = []
    monkeypatch.setattr(np, "nonzero", lambda x, real=np.nonzero: (scored.append(x.size), real(x))[1])
    regions.search(v, np.full(4000, -np.inf), v, 5, 1024)
    assert sum(scored) < 0.2 * 4000**2
