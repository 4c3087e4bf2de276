import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablero import api
from tablero.operators import neighbours as nb
from tablero.operators import similarity as sm
from tablero.operators import state as ts
from tablero.operators import winprob as wp
from tablero.sources import facts, tables
from tablero.streaming import current_state, keep_state


@pytest.fixture(scope="module")
def games(spark):
    rng, rows = random.Random(3), []
    for team in range(9):
        for i in range(rng.choice([1, 3, 12, 40])):
            rows.append(("l" if team % 2 else "m", f"t{team}", i, 100 * team + i, rng.choice([0, 1, None]), rng.choice([None, rng.gauss(0, 5)]) if team != 4 else None))
    df = spark.createDataFrame(rows, "league string, team string, d int, game long, win int, form double")
    return df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).drop("d").cache()


def same_state(got, want, metrics=("form",)):
    key = lambda r: (r["league"], r["team"])
    a, b = ({key(r): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["last_date"] == b[k]["last_date"]
        for c in ("win_last5", "league_win_last5", *(f"{m}_ewm" for m in metrics), *(f"league_{m}_ewm" for m in metrics)):
            assert (a[k][c] is None) == (b[k][c] is None) and (a[k][c] is None or a[k][c] == pytest.approx(b[k][c])), (k, c)


@pytest.mark.parametrize("cuts", [[], [0], [5], [1, 2, 7, 30], [10, 20]])
def test_state_of_parts_is_the_state_of_the_whole(games, cuts):
    keys, day = ("league",), F.datediff("date", F.lit("2024-01-01").cast("date"))
    state, low = None, -1
    for high in (*cuts, 1000):
        part = ts.part_state(games.where((day > low) & (day <= high)), ["form"], keys)
        state = part if state is None else ts.merged_state(state, part, ["form"], keys)
        low = high
    same_state(ts.scoring_state(state, ["form"], keys), wp.team_state(games, ["form"], keys))


def test_merging_states_is_associative_and_knows_late_parts(games):
    keys, day = ("league",), F.datediff("date", F.lit("2024-01-01").cast("date"))
    a, b, c = (ts.part_state(games.where(w), ["form"], keys) for w in (day < 3, (day >= 3) & (day < 9), day >= 9))
    left = ts.merged_state(ts.merged_state(a, b, ["form"], keys), c, ["form"], keys)
    right = ts.merged_state(a, ts.merged_state(b, c, ["form"], keys), ["form"], keys)
    same_state(ts.scoring_state(left, ["form"], keys), ts.scoring_state(right, ["form"], keys))
    assert ts.out_of_order(a, b, keys).count() == 0 and ts.out_of_order(b, a, keys).count() > 0


def test_kept_state_follows_batches_and_repeats_none(spark, games, tmp_path):
    base, keys, day = f"file://{tmp_path}", ("league",), F.datediff("date", F.lit("2024-01-01").cast("date"))
    run = lambda: keep_state(spark, f"{base}/landing", games.schema, f"{base}/state", f"{base}/offsets", ["form"], keys)
    for low, high in ((0, 4), (5, 11), (12, 99)):
        games.where((day >= low) & (day <= high)).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        run()
    want = wp.team_state(games, ["form"], keys)
    same_state(ts.scoring_state(current_state(spark, f"{base}/state"), ["form"], keys), want)
    # the last commit is lost: its batch is run again
    last = max((tmp_path / "offsets" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    same_state(ts.scoring_state(current_state(spark, f"{base}/state"), ["form"], keys), want)


def test_bucketed_facts_join_without_a_shuffle(spark, tmp_path):
    rows = [("n", "2024", f"g{i % 30}", f"t{i % 2}", i) for i in range(400)]
    events = facts.write_bucketed(spark.createDataFrame(rows, "league string, season string, game string, team string, x int"), "facts_events", f"file://{tmp_path}/e", 4)
    games = facts.write_bucketed(spark.createDataFrame([("n", "2024", f"g{i}", i % 3 == 0) for i in range(29)], "league string, season string, game string, won boolean"), "facts_games", f"file://{tmp_path}/g", 4)
    joined = facts.with_result(events, games)
    sums = facts.game_totals(joined, ["x"])
    for df in (joined, sums):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    facts.forget(spark, "facts_events", "facts_games")
    got = {(r["game"], r["team"]): (r["rows"], r["x"]) for r in sums.collect()}
    assert len(got) == 30 and sum(n for n, _ in got.values()) == 400 and sum(x for _, x in got.values()) == sum(range(400))
    assert joined.where("won is null").select("game").distinct().collect()[0][0] == "g29"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    rows = [("a", f"p{i:04d}", (centres[i % 12] + 0.02 * rng.normal(size=6)).tolist()) for i in range(600)]
    rows += [("b", f"q{i}", rng.normal(size=6).tolist()) for i in range(50)] + [("a", "zero", [0.0] * 6), ("c", "alone", [1.0] * 6)]
    return spark.createDataFrame(rows, "season string, player string, vector array<double>").cache()


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_pruned_neighbours_equal_all_pairs(clustered, block):
    key = lambda df: sorted((r["season"], r["player"], r["rank"], round(r["score"], 9)) for r in df.collect())
    want = sm.similar_all(clustered, 4, ("season",))
    assert key(nb.nearest_all(clustered, 4, ("season",), block=block)) == key(want)


def test_block_pairs_are_left_out(clustered):
    blocks = nb.blocks_of(clustered, 4, ("season",), "player", 60).where("season = 'a'")
    n, kept = blocks.count(), nb.block_pairs(blocks, ("season",)).count()
    assert n >= 10 and kept < 0.5 * n * n


def test_caps_bound_cosines():
    rng = np.random.default_rng(1)
    groups = [nb.unit_rows(rng.normal(size=(rng.integers(1, 9), 5)) * rng.random() + rng.normal(size=5)) for _ in range(30)] + [np.zeros((2, 5)), np.vstack([np.zeros(5), nb.unit_rows(np.ones((1, 5)))])]
    caps = [nb.cap(g) for g in groups]
    centres, radii = np.array([c for c, _ in caps]), np.array([r for _, r in caps])
    got = nb.bounds(centres, radii, centres, radii)
    for i, a in enumerate(groups):
        for j, b in enumerate(groups):
            assert got[i, j] >= (a @ b.T).max()


def test_missing_fixture_files_give_no_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_text("fecha,hora,local,visitante,estadio\n01/02/2024,21:00,A,B,S\n")
    got = tables.read_fixtures(spark, [f"file://{tmp_path}/f.csv", f"file://{tmp_path}/none.csv"])
    assert got.count() == 1 and tables.read_fixtures(spark, [f"file://{tmp_path}/none.csv"]).count() == 0


def test_public_names(spark, games):
    names = "get_similar_players compare_players reload_model load_data build_features build_pbp_features build_shots_features build_rolling_features train_model evaluate_model cross_validate_temporal predict_proba_game retrain load_model predict_upcoming_games"
    assert all(callable(getattr(api, n)) for n in names.split())
    scale = {f: (0.0, 1.0) for f in ("home", "form_ewm")}
    model = wp.WinModel(tuple(scale), scale, [wp.Linear(0.0, (1.0, 0.5))], [(1.0, 0.0)], {})
    fixture = spark.createDataFrame([("l", "t1", "t3"), ("l", "t1", "nobody")], "league string, home string, away string").withColumn("date", F.lit("2024-06-01").cast("date"))
    out = api.predict_upcoming_games(fixture, games, model, ["form"], ("league",)).collect()
    assert len(out) == 1 and out[0]["prob_local"] + out[0]["prob_visit"] == pytest.approx(1)


def test_buckets_follow_the_rows():
    from tablero.sources import facts

    assert facts.bucket_number(0) == 8 and all(rows / facts.bucket_number(rows) <= facts.BUCKET_ROWS for rows in (10**6, 10**8, 216 * 10**6))


def test_neighbours_of_copies_tie_and_blocks_travel_once_to_a_group(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 7))
    rows = [("a", 1000 * k + i, v.tolist()) for k in range(4) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "season string, player long, vector array<double>")
    monkeypatch.setattr(nb, "GROUP_ROWS", 100)
    monkeypatch.setattr(nb, "SLICE", 150)
    monkeypatch.setattr(nb, "PIVOTS", 9)
    blocks = nb.blocks_of(df, 3, ("season",), "player", 16)
    need = nb.needed_blocks(blocks, ("season",))
    assert sorted(i for r in blocks.collect() for i in r["ids"]) == sorted(r[1] for r in rows)
    assert need.count() == need.select("season", "_group", "other").distinct().count() <= 5 * blocks.count()
    got = {}
    for r in nb.nearest_all(df, 3, ("season",), block=16).collect():
        got.setdefault(r["player"], []).append((r["rank"], r["match"]))
    # the three copies tie with each other and come by id
    assert {p: [m for _, m in sorted(x)] for p, x in got.items()} == {1000 * k + i: [1000 * j + i for j in range(4) if j != k] for k in range(4) for i in range(120)}
