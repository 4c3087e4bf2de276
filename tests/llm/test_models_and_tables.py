import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablero.llm import graph
from tablero.llm import op02_warc as op2
from tablero.llm import op05_toxicity as op5
from tablero.llm import op06_quality as op6
from tablero.llm import op07_topk as op7
from tablero.llm import op10_mixing as op10
from tablero.llm import queries as registry
from tablero.llm.common import ordered_offsets, shared_dir


SMALL = "/root/testdata/sf0.001"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def auc(pairs):
    pos, neg = ([s for y, s in pairs if y == k] for k in (1, 0))
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_ordered_offsets(spark):
    rows = spark.createDataFrame([(i * 7 % 31, i % 5) for i in range(31)], "k long, n long")
    got = sorted((r["k"], r["n"], r["start"]) for r in ordered_offsets(rows, ["k"], "n").collect())
    at = 0
    for _, n, start in got:
        assert start == at
        at += n


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>é\r\nWARC/1.1\r\n\r\n</p>"), (3, None, "<p>one</p>"), (4, "u\r\nx", None), (5, "http://a/5", ""), (6, "http://a/6", "z" * 300_000), (6, "http://a/6", "z" * 300_000), (None, "n", "<p>one</p>"), (None, "n2", "only")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, shard int")
    folder = shared_dir(spark)
    manifest = op2.write_warc(df, folder, roll=300, shard_bytes=1000, least_shards=3)
    first = sorted(map(tuple, manifest.collect()))
    assert len(first) > 3 and sum(r[3] for r in first) == len(pages)
    got = sorted((tuple(r) for r in op2.read_warc(manifest, folder).collect()), key=str)
    size = lambda h: len((h or "").encode())
    want = [
        (1, size(pages[0][2]), op2.base32_sha1(b"<p>one</p>"), "revisit", 3), (2, size(pages[1][2]), op2.base32_sha1(pages[1][2].encode()), "response", None), (3, 10, op2.base32_sha1(b"<p>one</p>"), "response", None),
        (4, 0, op2.base32_sha1(b""), "revisit", 5), (5, 0, op2.base32_sha1(b""), "response", None), (6, 300_000, op2.base32_sha1(b"z" * 300_000), "response", None), (6, 300_000, op2.base32_sha1(b"z" * 300_000), "revisit", 6),
        (None, 10, op2.base32_sha1(b"<p>one</p>"), "revisit", 3), (None, 4, op2.base32_sha1(b"only"), "response", None),
    ]
    assert got == sorted(want, key=str)
    again = op2.write_warc(df.repartition(7), shared_dir(spark), roll=300, shard_bytes=1000, least_shards=3)
    assert sorted(map(tuple, again.collect())) == first  # same bytes from another layout
    assert op2.warc_round_trip(df.where("false")).count() == 0


def test_quality_on_held_out_rows(labelled, nasty, empty):
    docs, labels = labelled
    rows = op6.quality_scores(docs, labels).join(labels, "doc_id").collect()
    test = [(r["quality"], r["score"]) for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows) and auc(test) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert op6.quality_scores(nasty, labels).count() == nasty.count()
    assert op6.quality_scores(nasty, labels.where("false")).select("score").distinct().collect()[0][0] == 0.5
    assert op6.quality_scores(empty, labels).count() == 0


def test_statistics_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["a b\n\nC d!!", "", None, "x $$$ y\nx $$$ y\n", "Word" * 40, "\n"]
    whole = op6.statistics(pa.array(texts))
    assert np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(op6.statistics(pa.array([t], pa.string())), whole[i : i + 1])


def test_toxicity_learns_prefixes_and_tolerates_insertions(spark):
    rng = random.Random(1)
    syllables = ["ka", "lo", "mi", "ten", "sor", "val", "dre", "pin", "gu", "sha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    insults = ["blorkhead", "grumfzit"]
    rows, labels = [], []
    for i in range(600):
        text = [word() for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(insults)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic), 1))
    extra = {1000: "ka lo blork-head mi ten", 1001: "ka b l o r k h e a d mi", 1002: "ka blorkxhead lo mi", 1003: "ka lo mi ten sor", 1004: "", 1005: None}
    docs = spark.createDataFrame(rows + list(extra.items()), "doc_id long, text string")
    out = {r["doc_id"]: r for r in op5.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()}
    assert len(out) == 606
    assert auc([(y, out[i]["score"]) for i, y, _ in labels if held(i)]) > 0.99
    assert [out[i]["predicted"] for i in range(1000, 1006)] == [1, 1, 1, 0, 0, 0]
    none = op5.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.select("score").distinct().collect()[0][0] == 0.0


def test_toxicity_on_nasty_rows(labelled, nasty, empty):
    docs, labels = labelled
    model = op5.fit(docs, labels)
    assert op5.scores(nasty, model).where("score between 0 and 1").count() == nasty.count()
    assert op5.scores(empty, model).count() == 0


def brute_top(vectors, k=5, every=50):
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return sorted(out)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[50][1]) for i in range(40)]  # many equal vectors
    vectors += [(400, None), (450, [1.0, None]), (451, [float("nan")] * 8), (452, [float("inf")] * 8), (453, [0.5, 0.5]), (454, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in op7.top_k(df, range_rows=64, chunk_rows=2).collect())
    assert got == brute_top(vectors)
    assert op7.top_k(df.where("vec_id < 3")).count() == 2
    assert op7.top_k(df.where("false")).count() == 0


def test_block_search_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(4)
    w = np.sort(rng.integers(-50, 50, (400, 4)), axis=0).astype(float)
    q = rng.integers(-50, 50, (5, 4)).astype(float)
    got = op7.block_search(np.arange(400), w, np.arange(1000, 1005), q, 5, np.full(5, -np.inf), 16)
    for j in range(5):
        want = sorted((-int(s), i) for i, s in enumerate(w @ q[j]))[:5]
        assert sorted((-s, i) for k, i, s in got if k == 1000 + j) == want


def test_mix_properties(nasty, nasty_rows, empty):
    rows = op10.mix(nasty, block=7).collect()
    assert len(rows) == len(nasty_rows)
    total, by = sum(r["size"] for r in rows), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert sum(r["taken"] for r in v) == int(v[0]["target"]) and sum(r["size"] for r in v) == v[0]["source_size"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, op10.mix(nasty.repartition(5), block=7).collect())) == sorted(map(key, rows))
    assert sorted(map(key, op10.mix(nasty, block=50).collect())) == sorted(map(key, rows))  # blocks do not change the words taken
    assert op10.mix(empty).count() == 0


def test_schedule_prefixes_follow_the_weights(spark):
    sized = spark.createDataFrame([("a", 6400), ("b", 6400), ("c", 6400)], "source string, size long")
    plan = op10.targets(sized)
    slots = [r["source_no"] for r in op10.schedule(spark, plan, 64).orderBy("slot").collect()]
    assert abs(len(slots) - 300) <= 3
    for n in (32, 64, 128, 256):
        for no, share in ((1, 5 / 8), (2, 2 / 8), (3, 1 / 8)):
            assert abs(slots[:n].count(no) - share * n) <= np.log2(n) + 2


def test_mixed_documents_repeat_and_cut(plain):
    mixed = op10.mix(plain)
    want = {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]}
    got = op10.mixed_documents(plain)
    assert got.columns == plain.columns
    words = got.groupBy("doc_id").agg(F.sum(op10.words_in(F.col("text"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in words} == want


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns and docs.count() > 0
        if name in ("quality", "exact_dedup", "ngram_join"):
            assert docs.join(before, "doc_id", "left_anti").count() == 0 and docs.count() == docs.select("doc_id").distinct().count()
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names[:13]] == [f"op{k}" for k in range(1, 14)] and "pipeline" in names[13:]
    assert set(registry.oracle_sql()) < set(names)


def test_main_path_of_the_mix_is_native(nasty):
    plan = op10.mix(nasty)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_mixed_documents_keeps_all_words_taken_of_texts_that_begin_with_white_space(spark):
    rows = [(i, "\n\t" + " ".join(f"w{i}_{k}" for k in range(7)) + "\n", "abc"[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in op10.mix(docs).collect()}
    words = dict.fromkeys(taken, 0)
    for r in op10.mixed_documents(docs).collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {d: t for d, (t, _) in taken.items()} and any(t % n for t, n in taken.values())
