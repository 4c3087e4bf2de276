import random
import tracemalloc

import numpy as np

from tablero.llm import graph
from tablero.llm import op03_ngram_join as op3
from tablero.llm.common import staged


def plain(links):
    label = {x: x for link in links for x in link}
    while moved := [(a, b) for a, b in links if label[a] != label[b]]:
        for a, b in moved:
            label[a] = label[b] = min(label[a], label[b])
    return label


def as_dict(df):
    rows = df.collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: r["component"] for r in rows}


def test_components_of_late_links_join_the_known_ones(spark):
    rng = random.Random(4)
    links = [(rng.randint(-200, 200), rng.randint(-200, 200)) for _ in range(190)] + [(9, 9)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    assert as_dict(graph.components(frame(links))) == plain(links)
    known = graph.components(frame(links[:120]))
    assert as_dict(graph.merged(known, frame(links[120:]))) == plain(links)
    assert as_dict(graph.merged(known, frame([]))) == plain(links[:120])


def test_a_family_of_many_links_is_left_after_one_round(spark):
    """Links inside a family do not come again in later rounds, whatever their number."""
    family = [(a, b) for a in range(40) for b in range(a + 1, 40) if (a + b) % 3]
    links = spark.createDataFrame([*family, (39, 100), (100, 101)], "a long, b long").distinct()
    root = graph.roots(links).withColumnRenamed("root", "label")
    assert graph.relabelled(links, root).count() <= 2


def test_fine_sketches_leave_hardly_a_pair_below_the_threshold():
    """Members of a family that differ in more than the threshold allows: the coarse sketch lets many pairs pass, the fine one hardly any."""
    rng = np.random.default_rng(2)
    base, sets = rng.integers(0, 1 << 62, 150, dtype=np.uint64), []
    for _ in range(60):
        sets.append(np.unique(np.r_[base, rng.integers(0, 1 << 62, 24, dtype=np.uint64)]))  # Jaccard 150 / 198
    i, j = np.triu_indices(len(sets), 1)
    passed = {}
    for name, kind in (("coarse", op3.COARSE), ("fine", op3.FINE)):
        raw = [np.frombuffer(op3.parity(s, 80, *kind), np.uint8) for s in sets]
        m = op3.Members(np.array([len(s) for s in sets]), np.arange(len(sets)), np.concatenate(raw), np.r_[0, np.cumsum([len(r) for r in raw])])
        passed[name] = m.possible(i, j, 80).mean()
        near = np.array([len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)])
        assert m.possible(i, j, 80)[near].all()
    assert passed["fine"] < 0.02 < passed["coarse"]


def test_comparing_fine_sketches_takes_little_memory():
    """Half a million pairs of two blocks with sketches of 1 KB: a worker holds a few MB of them, not all indices of their bytes."""
    rng = np.random.default_rng(3)
    width, size = 1 << op3.FINE[1] >> 3, op3.BLOCK
    m = op3.Members(np.full(size, 2000), np.arange(size), rng.integers(0, 256, size * width).astype(np.uint8), np.arange(size + 1) * width)
    i, j = np.triu_indices(size, 1)
    tracemalloc.start()
    m.possible(i, j, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_postings_without_a_partner_of_near_size_go(spark):
    """A token that sets of far sizes hold is no candidate; neighbours of near size stay whatever lies around them."""
    rows = [(1, 100, [7, 8]), (2, 1000, [7]), (3, 5000, [7, 9]), (4, 4600, [7]), (5, 20, [8]), (5, 20, [8]), (6, 19, [8]), (7, 5000, [10])]
    found = spark.createDataFrame(rows, "sig long, n int, tokens array<long>").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = sorted((r["token"], r["n"], r["sig"]) for r in op3.shared_postings(found, 90).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ends = {(7, 100, 1), (10, 5000, 7)}  # of the partition
    assert set(got) - ends == {(7, 4600, 4), (7, 5000, 3), (8, 19, 6), (8, 20, 5)} and len(got) == len(set(got))


def test_pairs_across_components_of_one_block_and_of_several(spark):
    """Tokens of one block, which meets itself in place, and of several blocks, which are joined, give the pairs of a plain comparison."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 62, 60, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.r_[base[k % 3], rng.integers(0, 1 << 62, k % 5, dtype=np.uint64)]) for k in range(60)]
    rows = [(t, len(sets[k]), k, op3.parity(sets[k], 90, *op3.FINE), k % 4) for t, holders in ((1, range(60)), (2, range(7, 12)), (3, range(0, 60, 9)), (4, [5, 6])) for k in holders]
    members = spark.createDataFrame(rows, "token long, n int, sig long, parity binary, component long")
    blocks = staged(op3.blocked(members))  # read several times: numbers of blocks must stay
    assert blocks.where("alone").count() and blocks.where("NOT alone").groupBy("token").count().where("count > 1").count()
    got = {(r["a"], r["b"]) for r in op3.cross_pairs(blocks, 90, None).collect()}
    want = set()
    for a in range(60):
        for b in range(a + 1, 60):
            common = len(np.intersect1d(sets[a], sets[b]))
            if a % 4 != b % 4 and 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                want.add((a, b))
    assert want and want <= got and len(got) < 60 * 59 / 2
