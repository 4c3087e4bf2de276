import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablero.operators import events as ev
from tablero.operators import history as hi
from tablero.operators import lineups as li
from tablero.operators import newton
from tablero.operators import possessions as po
from tablero.operators import reports as rp
from tablero.operators import scan
from tablero.operators import winprob as wp

KINDS = [
    "CANASTA-1P", "CANASTA-2P", "CANASTA-3P", "TIRO1-FALLADO", "TIRO2-FALLADO", "TIRO3-FALLADO", "PERDIDA", "REBOTE-OFENSIVO", "REBOTE-DEFENSIVO", "ASISTENCIA", "FALTA-RECIBIDA",
    "FINAL-PERIODO", "INICIO-PERIODO", "CAMBIO-JUGADOR-ENTRA", "CAMBIO-JUGADOR-SALE",
]
SCHEMA = "game long, num int, seq int, kind string, side string, player string, team string, period int, clock int, elapsed int"
GAME = ("game",)


def game_rows(events):
    """(game, num, seq, kind, side, player, team, period, clock, elapsed) of a list of (kind, side, elapsed)."""
    return [(1, i, i, kind, side, "p", side, 1, 600 - at, at) for i, (kind, side, at) in enumerate(events)]


@pytest.fixture(scope="module")
def stream():
    rng, rows = random.Random(21), []
    for game in range(6):
        at, period = 0, 1
        for seq in range(220):
            at += rng.choice([0, 1, 3, 9])
            kind = rng.choice(KINDS)
            bound = kind.startswith(("FINAL", "INICIO"))
            period += kind == "INICIO-PERIODO" and period < 5
            side = None if bound else rng.choice(["LOCAL", "LOCAL", "VISITANTE", None if kind == "FALTA-RECIBIDA" else "VISITANTE"])
            player = None if rng.random() < 0.1 else f"p{rng.randrange(7)}"
            clock = None if bound and rng.random() < 0.3 else max(600 - at % 600, 0)
            rows.append((game, None if rng.random() < 0.05 else seq, seq, kind, side, player, side, period, clock, at))
    return rows


@pytest.fixture(scope="module")
def events(spark, stream):
    return spark.createDataFrame(stream, SCHEMA).repartition(3).cache()


def in_order(stream):
    by = {}
    for r in stream:
        by.setdefault(r[0], []).append(r)
    return {g: sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for g, rs in by.items()}


def loop_possessions(rows):
    """(seq -> number, list of possessions) by walking over one game's events."""
    tries = {"CANASTA-1P", "CANASTA-2P", "CANASTA-3P", "TIRO1-FALLADO", "TIRO2-FALLADO", "TIRO3-FALLADO", "PERDIDA"}
    plays = [r for r in rows if r[3] in ("INICIO-PERIODO", "FINAL-PERIODO", "FINAL-PARTIDO") or (r[4] and (r[3] in tries or r[3].startswith("REBOTE")))]
    after = {r[2]: plays[i + 1] if i + 1 < len(plays) else None for i, r in enumerate(plays)}
    number, number_of, found, holder = 0, {}, [], None
    for r in rows:
        kind, side = r[3], r[4]
        if r[2] in after:
            if side is None:
                holder = None
            else:
                if holder != side or kind == "REBOTE-DEFENSIVO":
                    number += 1
                    start = r[9] if kind == "REBOTE-DEFENSIVO" else found[-1]["end"] if found and found[-1]["period"] == r[7] else None
                    found.append({"side": side, "period": r[7], "pts": 0, "start": start, "tried": None, "end": None})
                p = found[-1]
                p["pts"] += ev.MADE.get(kind, 0)
                p["end"] = r[9]
                if kind in tries and p["tried"] is None:
                    p["tried"] = r[9]
                nxt = after[r[2]]
                thrown = nxt is not None and nxt[3] in ("CANASTA-1P", "TIRO1-FALLADO") and nxt[4] == side
                holder = None if kind == "PERDIDA" or (kind.startswith("CANASTA") and not thrown) else side
        number_of[r[2]] = number
    return number_of, found


def test_possessions_against_a_loop(events, stream):
    got = {(r["game"], r["seq"]): r["possession"] for r in po.numbered_possessions(events, GAME).collect()}
    table = {(r["game"], r["possession"]): r for r in po.possession_table(events, GAME).collect()}
    split = {(r["game"], r["side"], r["transition"]): r for r in po.transition_split(events, GAME, seconds=8).collect()}
    for g, rows in in_order(stream).items():
        numbers, found = loop_possessions(rows)
        assert {s: got[g, s] for s in numbers} == numbers
        sums = {}
        for i, p in enumerate(found, 1):
            r = table[g, i]
            seconds = None if p["tried"] is None or p["start"] is None else p["tried"] - p["start"]
            assert (r["side"], r["pts"], r["seconds_to_try"]) == (p["side"], p["pts"], seconds), (g, i)
            total = sums.setdefault((g, p["side"], seconds is not None and seconds <= 8), [0, 0])
            total[0] += p["pts"]
            total[1] += 1
        for k, (pts, n) in sums.items():
            assert (split[k]["pts"], split[k]["poss"]) == (pts, n) and split[k]["ppp"] == pytest.approx(pts / n)
    assert len(table) > 300


def test_offensive_rebound_stays_in_the_possession(spark):
    rows = game_rows([("TIRO2-FALLADO", "LOCAL", 5), ("REBOTE-OFENSIVO", "LOCAL", 7), ("CANASTA-2P", "LOCAL", 9), ("PERDIDA", "VISITANTE", 20)])
    one = po.possession_table(spark.createDataFrame(rows, SCHEMA), GAME).orderBy("possession").collect()
    assert [(r["side"], r["pts"], r["second_chances"], r["seconds_to_try"]) for r in one] == [("LOCAL", 2, 1, None), ("VISITANTE", 0, 0, 11)]


def test_basket_and_foul_and_last_free_throw_end_a_possession(spark):
    rows = game_rows([("CANASTA-2P", "LOCAL", 5), ("ASISTENCIA", "LOCAL", 5), ("FALTA-RECIBIDA", "LOCAL", 5), ("CANASTA-1P", "LOCAL", 5), ("CANASTA-1P", "VISITANTE", 9), ("CANASTA-1P", "VISITANTE", 9), ("TIRO3-FALLADO", "LOCAL", 15), ("REBOTE-DEFENSIVO", "VISITANTE", 16), ("CANASTA-3P", "VISITANTE", 20)])
    got = po.transition_split(spark.createDataFrame(rows, SCHEMA), GAME).collect()
    assert {(r["side"], r["transition"]): (r["pts"], r["poss"]) for r in got} == {("LOCAL", False): (3, 1), ("LOCAL", True): (0, 1), ("VISITANTE", True): (5, 2)}
    assert {r["share"] for r in got if r["side"] == "LOCAL"} == {0.5}


def test_an_assist_makes_one_basket_assisted(spark, events):
    rows = game_rows([("CANASTA-2P", "LOCAL", 1), ("CANASTA-3P", "LOCAL", 2), ("ASISTENCIA", "LOCAL", 2)])
    got = po.assisted_baskets(spark.createDataFrame(rows, SCHEMA), GAME).orderBy("seq").collect()
    assert [r["assists"] for r in got] == [0, 1]
    pairs = ev.assist_pairs(events, GAME).groupBy("side").count()
    sums = po.assisted_baskets(events, GAME).groupBy("side").agg(F.sum("assists").alias("count"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, sums.collect()))


@pytest.mark.parametrize("parity", [False, True])
@pytest.mark.parametrize("size", [None, 2, 3])
def test_lineup_sweep_equals_the_joins(events, size, parity):
    a = li.timed(li.numbered(events.drop("elapsed"), GAME), GAME)
    joined = li.segment_facts(a, li.on_court(li.segments(a, GAME), li.stints(a, GAME), GAME, size), GAME, parity)
    swept = li.court_segments(events.drop("elapsed"), GAME, size, parity)
    columns = ["game", "side", "n_from", "n_to", "seconds", "lineup", *li.SEGMENT]
    rows = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.select(*columns).collect())
    assert rows(swept) == rows(joined) and (size is not None or len(rows(swept)) > 50)


def test_lineup_sweep_has_one_shuffle(spark, events):
    plan = li.court_segments(events.drop("elapsed"), GAME)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.fixture(scope="module")
def history(spark):
    rng, rows = random.Random(2), []
    for key, n in ((1, 3000), (2, 1), (3, 40), (None, 30), (4, 700)):
        for i in range(n):
            x = None if rng.random() < 0.2 or i < 2 and key == 3 else rng.gauss(10, 3)
            rows.append((key, i // 2, i, x, rng.choice([None, rng.randrange(50)])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "team long, date int, game int, x double, y int").repartition(4).cache()


@pytest.mark.parametrize("parts", [1, 7, 60])
@pytest.mark.parametrize("span", [1, 5, 10])
def test_ranged_ewm_equals_the_window(history, parts, span):
    a = hi.ewm_before(history, ["team"], ["date", "game"], ["x", "y"], span).withColumnsRenamed({"x_ewm": "a", "y_ewm": "b"})
    b = scan.ewm_before(history, ["team"], ["date", "game"], ["x", "y"], span, parts=parts)
    both = a.alias("l").join(b.alias("r"), F.col("l.team").eqNullSafe(F.col("r.team")) & (F.col("l.game") == F.col("r.game")))
    off = lambda p, q: ~F.col(p).isNull().eqNullSafe(F.col(q).isNull()) | (F.abs(F.col(p) - F.col(q)) > 1e-9)
    assert both.count() == history.count() and both.where(off("a", "x_ewm") | off("b", "y_ewm")).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 400])
def test_ranged_scans_equal_windows(history, parts):
    key, order = ["team"], ["date", "game"]
    want = hi.rolling_before(ev.score_fill(history, ["y"], ("team",), ("date", "game")).withColumnRenamed("y", "filled").join(history.select("team", "game", "y"), ["team", "game"]), key, order, "x", 5)
    got = scan.rolling_before(history, key, order, "x", 5, parts=parts)
    rows = lambda df, *c: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.where("team is not null").select("team", "game", *c).collect())
    assert rows(got, "x_last5") == rows(want, "x_last5")
    filled = scan.fill_forward(history, key, order, ["y"], parts=parts)
    assert rows(filled.withColumnRenamed("y", "filled"), "filled") == rows(want, "filled")
    sums = scan.running_sum(history, key, order, {"s": F.col("y"), "n": F.lit(1)}, parts=parts)
    from pyspark.sql import Window

    w = Window.partitionBy("team").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    assert rows(sums, "s", "n") == rows(history.withColumns({"s": F.coalesce(F.sum("y").over(w), F.lit(0)), "n": F.count("*").over(w)}), "s", "n")


def test_a_hot_key_lies_in_several_parts(history):
    parts = scan.in_parts(history, ["team"], ["date", "game"], 8).groupBy("team", scan.PART).count().where("team = 1").collect()
    assert len(parts) >= 5 and max(r["count"] for r in parts) < 2 * 3771 / 8


@pytest.mark.parametrize("parts", [1, 5])
def test_ranged_percentiles_equal_percent_rank(spark, parts):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 0.5, rng.random() ** 20]), rng.randrange(4)) for i in range(800)] + [("alone", 900, 1.0, 1)]
    df = spark.createDataFrame(rows, "league string, id long, skewed double, few int")
    a = {r["id"]: (r["skewed_pctile"], r["few_pctile"]) for r in rp.percentiles(df, ["skewed", "few"], ["league"]).collect()}
    b = {r["id"]: (r["skewed_pctile"], r["few_pctile"]) for r in scan.percentiles(df, ["skewed", "few"], ["league"], parts).collect()}
    assert a.keys() == b.keys() and all(b[i] == pytest.approx(a[i]) for i in a)


def test_metrics_of_skewed_probabilities(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.4), 0.5 + rng.random() * 1e-9 if i % 3 else rng.random()) for i in range(500)]
    got = wp.metrics(spark.createDataFrame(rows, "win int, prob double")).first()
    wins, losses = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in wins for b in losses) / len(wins) / len(losses)
    assert got["auc"] == pytest.approx(auc)


def test_many_models_equal_single_fits(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = random.Random(6)
    rows = [(i, rng.gauss(0, 1), rng.gauss(3, 2), i % 3) for i in range(400)]
    rows = [(*r, int(r[1] - 0.3 * r[2] + rng.gauss(0, 1) > -0.5)) for r in rows]
    df = spark.createDataFrame(rows, "id int, a double, b double, fold int, y int").cache()
    others = F.filter(F.array(*map(F.lit, range(3))), lambda k: k != F.col("fold"))
    scales, sizes = newton.scales_of(df, ["a", "b"], others, 4)
    assert sizes == [sum(r[3] != k for r in rows) for k in range(3)] + [0]
    got = newton.fit_many(df, others, 4, newton.standardised(["a", "b"], scales, F.col("_m")), F.col("y"), 0.2)
    assert got[3] == newton.Linear(0.0, (0.0, 0.0))
    for k in range(3):
        own, s = df.where(F.col("fold") != k), scales[k]
        ready = own.select(array_to_vector(F.array(*((F.col(f) - s[f][0]) / s[f][1] for f in ("a", "b")))).alias("features"), F.col("y").cast("double").alias("label"))
        one = LogisticRegression(regParam=1 / (0.2 * sizes[k]), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-12).fit(ready)
        assert got[k].intercept == pytest.approx(one.intercept, abs=1e-6) and got[k].coefficients == pytest.approx(list(one.coefficients), abs=1e-6)


def test_league_mean_is_over_game_rows(spark):
    rows = [("l", "a", i, i, 1, 4.0) for i in range(3)] + [("l", "b", 1, 9, 0, 1.0), ("l", "c", 1, 10, 0, None), ("m", "c", 1, 11, 1, 100.0)]
    games = spark.createDataFrame(rows, "league string, team string, d int, game int, win int, form double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    state = wp.team_state(games, ["form"], keys=("league",))
    fixture = spark.createDataFrame([("l", "c", "a"), ("l", "a", "c")], "league string, home string, away string").withColumn("date", F.lit("2024-02-01").cast("date"))
    got = {r["home"]: r["form_ewm"] for r in wp.fixture_features(fixture, state, keys=("league",)).collect()}
    assert got["c"] == pytest.approx((3 * 4 + 1) / 4) and got["a"] == pytest.approx(4)


def test_scaled_usage_by_hand(spark):
    rows = [("t", "p", "2024-01-01", 1200, 10, 4, 8, 2, 2, 1, 3, 2, 1), ("t", "q", "2024-01-01", 1200, 8, 3, 6, 0, 1, 2, 2, 1, 0), ("t", "p", "2024-01-03", 2400, 20, 8, 16, 2, 4, 3, 4, 4, 2)]
    df = spark.createDataFrame(rows, "team string, player string, date string, seconds int, pts int, fgm int, fga int, fg3m int, fg3a int, ast int, fta int, tov int, orb int")
    p = {r["player"]: r for r in rp.player_report(df, ("team",)).collect()}["p"]
    possessions = ((8 + 6) - 1 + 3 + 0.44 * 5 + 16 - 2 + 4 + 0.44 * 4) / 2
    assert p["usg_scaled"] == pytest.approx((8 + 16 + 0.44 * 7 + 6) / (60 / 40 * possessions))


def test_ingest_replaces_a_repeated_batch(spark, tmp_path):
    from tablero.streaming import ingest_stream

    base = f"file://{tmp_path}"
    schema = "league string, game string, x int"
    rows = spark.createDataFrame([("n", f"g{i}", i) for i in range(6)], schema)
    for i in range(3):
        rows.where(F.col("x") % 3 == i).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    rows.where("x = 1").coalesce(1).write.mode("append").parquet(f"{base}/landing")  # rows that came before
    read = lambda: sorted(r["x"] for r in spark.read.schema(rows.schema).parquet(f"{base}/target").collect())
    ingest_stream(spark, f"{base}/landing", rows.schema, f"{base}/target", f"{base}/offsets", files_per_batch=1)
    assert read() == list(range(6))
    # the last batch is lost after it was written: its commit is gone, and the run is not marked as done
    commits = sorted((tmp_path / "offsets" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "offsets" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    (tmp_path / "offsets-done").rmdir()
    ingest_stream(spark, f"{base}/landing", rows.schema, f"{base}/target", f"{base}/offsets", files_per_batch=1)
    assert read() == list(range(6))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_form_and_previous_over_ranges_equal_windows(spark, parts):
    rng = random.Random(5)
    rows = [(t, i // 3, i, None if (i // 300) % 2 and i % 7 or rng.random() < 0.1 else rng.random(), rng.randrange(2) if rng.random() < 0.9 else None) for t, n in ((None, 40), (1, 3000), (2, 1), (3, 260), (4, 700)) for i in range(n)]
    games = spark.createDataFrame(rows, "team long, day int, game long, x double, win int").withColumns({"date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")), "y": F.col("x") * F.col("game")}).drop("day")
    order = ["date", "game"]
    want = hi.rolling_before(hi.ewm_before(games, ["team"], order, ["x", "y"]), ["team"], order, "win", 5).withColumn("was", F.lag("win").over(Window.partitionBy("team").orderBy(*order)))
    got = scan.previous(scan.form_before(games, ["team"], order, ["x", "y"], "win", parts=parts), ["team"], order, "win", "was", parts=parts)
    keyed = lambda df: {(r["team"], r["game"]): r for r in df.collect()}
    a, b = keyed(want), keyed(got)
    assert a.keys() == b.keys()
    for k, r in a.items():
        assert b[k]["was"] == r["was"] and b[k]["x"] == r["x"]
        assert all(b[k][c] == pytest.approx(r[c], rel=1e-9) if r[c] is not None else b[k][c] is None for c in ("x_ewm", "y_ewm", "win_last5")), k
