import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablero.llm import op01_packing as op1
from tablero.llm import op03_ngram_join as op3
from tablero.llm import op04_substring_dedup as op4
from tablero.llm import op08_pitman_yor as op8
from tablero.llm import op09_exact_dedup as op9
from tablero.llm import textops

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_word_hashes_name_words():
    texts = ["The the  THE\tcat", None, "", "É é cat", "cat" * 3000]
    seen = {}
    for lo, _, hashes, rows in textops.hashed_rows(pa.array(texts)):
        for h, r in zip(hashes.tolist(), rows.tolist()):
            seen.setdefault(lo + r, []).append(h)
    flat = [w for t in texts for w in words(t)]
    got = [h for r in sorted(seen) for h in seen[r]]
    assert len(flat) == len(got) and len(set(zip(flat, got))) == len(set(flat)) == len(set(got))


def test_hilbert_neighbours_touch():
    grid = np.array([[i, j] for i in range(16) for j in range(16)])
    keys = op1.hilbert_keys(grid, 4)
    assert sorted(keys) == list(range(256))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_run_tokenizer_is_the_tokenizer():
    from tokenizers import Tokenizer

    whole, tool = Tokenizer.from_file(op1.default_vocabulary()), op1.RunTokenizer.at(op1.default_vocabulary())
    texts = ["It's 12 o'clock!! don't", "a\x0bb \x1c c\xa0d", "ΑΣ ÉTÉ Straße naïve œuvre", "", "  x\n\ny ", "<|endoftext|> hi", "é ́a İx", "日本 語", "a" * 300]
    for text, raw in zip(texts, tool.encode(texts, 2)):
        assert np.frombuffer(raw, tool.kind).tolist() == whole.encode(text, add_special_tokens=False).ids + [2], text


def test_packing_covers_every_id_once(nasty, nasty_rows, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(op1.default_vocabulary())
    got = op1.pack(nasty, length=256).collect()
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in nasty_rows}
    per_doc, per_seq = {}, {}
    for r in got:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + r["length"]
        per_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    copies = Counter(i for i, *_ in nasty_rows)
    assert per_doc == {i: len(x) * copies[i] for i, x in ids.items()}
    filled = {}
    for s, parts in per_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        filled[s] = at
    assert sorted(filled) == list(range(len(filled))) and sum(v < 256 for v in filled.values()) <= 1
    assert op1.pack(empty).count() == 0


def brute_components(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join_matches_all_pairs(plain, nasty_rows, nasty, empty):
    for width, percent in ((3, 90), (5, 80)):
        want = brute_components(nasty_rows[:-2], width, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3.ngram_join(plain, width, percent).collect()}
        assert got == want
    assert op3.ngram_join(nasty, 3, 90).count() == len(nasty_rows)
    assert op3.ngram_join(empty).count() == 0


def test_ngram_join_chain_below_threshold_at_its_ends(spark):
    """A drifts from B drifts from C: one component although A and C do not link."""
    base = [f"t{i}" for i in range(60)]
    rows = []
    for k in range(12):
        base = [*base[:-2], f"n{k}", f"m{k}"] if k % 2 else [f"n{k}", *base[1:]]
        rows.append((k, " ".join(base)))
    want = brute_components(rows, 3, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == want


def test_prefixes_of_linked_sets_meet_under_every_order():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 200, 1 << op3.SKETCH_BITS).astype(np.uint8)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
        b = np.unique(np.r_[a[3:], rng.integers(0, 2**63, 2, dtype=np.uint64)])
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 90 * (len(a) + len(b) - inter):
            for k in range(op3.ORDERS):
                pa_, pb = (op3.ordered(s, classes, k, op3.prefix_length(len(s), 90)) for s in (a, b))
                assert len(np.intersect1d(pa_, pb))


def test_substring_dedup(nasty, nasty_rows, empty, spark):
    got = {(r["doc_id"], r["start"], r["end"]) for r in op4.removed_units(nasty).collect()}
    units = [(doc is None, doc, s, e, d) for doc, text in {(r[0], r[1]) for r in nasty_rows} for s, e, d in op4.units_of(text or "")]
    first, want = {}, set()
    for none, doc, s, e, d in sorted(units, key=lambda u: (u[0], u[1] or 0, u[2])):
        if first.setdefault(d, (doc, s)) != (doc, s):
            want.add((doc, s, e))
    assert got == want and want
    rows = op4.substring_dedup(nasty).collect()
    texts = {r[0]: r[1] for r in nasty_rows}
    assert len(rows) == len(nasty_rows)
    for r in rows:
        cuts = {(s, e) for doc, s, e in want if doc == r["doc_id"]}
        text, spans, words, longest = op4.cleaned(texts[r["doc_id"]], list(cuts)) if cuts else (texts[r["doc_id"]], [], 0, 0)
        assert (r["text"], r["spans"], r["removed_units"], r["removed_words"], r["longest"]) == (text, " ".join(f"{i}-{j}" for i, j in spans), len(cuts), words, longest)
    assert op4.removed_units(empty).count() == 0 and op4.substring_dedup(empty).count() == 0


def test_substring_dedup_sees_a_passage_inside_lines(spark):
    passage = " ".join(f"Alpha{i} beta gamma delta epsilon zeta." for i in range(10))
    rows = [(1, f"own words here without a stop {passage} and more of the text"), (2, f"something quite else {passage} then other words follow"), (3, "no passage in this one. It has its own words."), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in op4.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["predicted"] for i in range(1, 6)] == [0, 1, 0, 0, 0]
    assert got[2]["longest"] == 54 and got[2]["text"] == "something quite else Alpha0 beta gamma delta epsilon zeta. then other words follow"
    assert got[4]["text"] is None and got[5]["text"] == ""


def test_substring_dedup_tells_texts_of_one_id_apart(spark):
    rows = [(1, "one two three four five"), (7, "one two three four five"), (7, "a b c d e\none two three four five")]
    got = sorted((r["doc_id"], r["text"]) for r in op4.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "one two three four five"), (7, ""), (7, "a b c d e\n")]


def test_substring_dedup_sees_passages_of_short_lines(spark):
    words = [f"p{i}" for i in range(60)]
    wrapped = lambda n: "\n".join(" ".join(words[i : i + n]) for i in range(0, 60, n))
    texts = [f"own head a\n{wrapped(2)}\nown tail a", f"another\n{wrapped(2)}\nends so", f"x y\n\n{wrapped(9)}\n\nz", f"{wrapped(7)}", "one of nine words that stands in two texts\nq", "r\none of nine words that stands in two texts"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cleaned = {r["doc_id"]: r["text"] for r in op4.substring_dedup(docs).collect()}
    assert cleaned[0] == texts[0] and cleaned[1] == "another\nends so"  # one passage inside paragraphs of their own
    assert cleaned[2] == texts[2] and cleaned[3] == ""  # one paragraph in another wrap
    assert cleaned[4] == texts[4] and cleaned[5] == "r\n"


def test_exact_dedup(nasty, nasty_rows, empty):
    groups = {}
    for i, t, *_ in nasty_rows:
        groups.setdefault("".join(c for c in (t or "") if c not in op9.SPACES), []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for text, rows in groups.items():
        keep = min(rows)[3]
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(rows), i == keep, sha) for *_, i in rows]
    got = [tuple(r) for r in op9.exact_dedup(nasty).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    small = [tuple(r) for r in op9.exact_dedup(nasty, most=2000).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(small, key=key) == sorted(want, key=key)
    assert op9.exact_dedup(empty).count() == 0


def test_grace_spills_and_folds(tmp_path):
    records = [(hashlib.sha256(str(i % 500).encode()).digest(), str(i % 500).encode() * 9, i % 7, i, 1) for i in range(3000)]
    found = list(op9.grace(iter(records), f"file://{tmp_path}/spill", most=2000))
    assert len(found) == 500 and sum(r[4] for r in found) == 3000
    assert not list((tmp_path / "spill").iterdir())
    for digest, content, length, doc, _ in found:
        same = [r for r in records if r[1] == content]
        assert (-length, doc) == min((-r[2], r[3]) for r in same)


def test_pitman_yor_base_and_gain(nasty, nasty_rows, empty):
    rows = op8.score(nasty).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t, *_ in nasty_rows:
        if not held(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    texts = {r[0]: r[1] for r in nasty_rows}
    assert len(rows) == len(nasty_rows)
    for r in rows:
        tokens = [*words(texts[r["doc_id"]]), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"], r["held_out"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), held(r["doc_id"]))
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert all(math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"])) for r in rows)
    assert op8.score(empty).count() == 0 and not [t for t in empty.sparkSession.catalog.listTables() if t.name.startswith("tablero_")]


def test_pitman_yor_sweeps_go_on_after_the_start(spark, monkeypatch):
    """Three sweeps of all chains follow the start; without chains or sweeps there is no model."""
    settled, appended = [], op8.appended
    monkeypatch.setattr(op8, "appended", lambda *a: settled.append(1) or appended(*a))
    assert op8.score(spark.createDataFrame([(i, "a b a b a c") for i in range(8)], "doc_id long, text string")).count() == 8
    assert len(settled) == op8.SWEEPS >= 4
    for none in ({"sweeps": 0}, {"chains": 0}):
        with pytest.raises(ValueError):
            op8.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), **none)


def test_pitman_yor_sums_to_one(spark):
    """The probabilities of all known words and the unknown one after one context."""
    train = [(i, "a b a c a b d b", None) for i in range(40)]
    train = [(i, t) for i, t, _ in train if zlib.crc32(str(i).encode()) % 5 != 1]
    ids = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 5 == 1]
    # a held-out text "b x": p(b | start) p(x | b) p(end | x); dividing by the text "b" forms leaves the middle factor
    probes = {w: ids[k] for k, w in enumerate(["a", "b", "c", "d", "unknown"])}
    rows = train + [(i, f"b {w}") for w, i in probes.items()]
    got = {r["doc_id"]: r["score"] for r in op8.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ends = {w: ids[10 + k] for k, w in enumerate(probes)}
    firsts = spark.createDataFrame(train + [(i, w) for w, i in ends.items()], "doc_id long, text string")
    alone = {r["doc_id"]: r["score"] for r in op8.score(firsts).collect()}
    # p(start -> w) p(w -> end) from the second run; p(w -> end) is unknown, so check total mass by bounds instead
    assert all(got[i] < 0 for i in probes.values()) and all(alone[i] < 0 for i in ends.values())
    shape = op8.Shape(100, 4, 10, 3, 2, 2, 1)
    customers, tables = np.array([4, 3, 2, 1]), np.array([2, 1, 1, 1])
    parent = shape.parent(np.r_[customers, 0], np.r_[tables, 0], 10, 5)
    assert math.isclose(parent.sum(), 1)
    c, t = np.array([5, 2, 0, 0, 0]), np.array([2, 1, 0, 0, 0])
    p = (c - shape.d * t + (op8.STRENGTH + shape.d * t.sum()) * parent) / (op8.STRENGTH + c.sum())
    assert math.isclose(p.sum(), 1)


def test_seating_follows_the_process():
    rng = np.random.default_rng(1)
    even, none = np.full(20000, 0.5), np.zeros(20000)
    t = op8.seated(np.array([0, 1, 2, 1000]), even[:4], none[:4], 0.5, rng).tables
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and 1 <= t[3] <= 1000
    many = op8.seated(np.full(20000, 2), even, none, 0.5, rng).tables
    assert abs((many == 2).mean() - 0.5 / (1 - 0.5 + 0.5)) < 0.02


def test_steps_reach_the_exact_distribution_of_tables():
    """Against the sum over all seatings of c customers at t tables, by the recursion of generalised Stirling numbers."""
    d, fresh, slope = 0.7, 0.2, 0.05
    for c in (2, 3, 6, 40):
        ways = np.zeros((c + 1, c + 2))
        ways[0, 0] = 1
        for n in range(c):
            for t in range(n + 1):
                ways[n + 1, t] += ways[n, t] * max(n - d * t, 0)
                ways[n + 1, t + 1] += ways[n, t]
        want = np.array([ways[c, t] * np.prod([fresh + slope * i for i in range(t)]) for t in range(c + 1)])
        want /= want.sum()
        rng, state = np.random.default_rng(2), op8.Paths(np.full(20000, c))
        for _ in range(12):
            state = op8.reseated(state, np.full(20000, fresh), np.full(20000, slope), d, rng)
        assert np.abs(np.bincount(state.tables, minlength=c + 1) / 20000 - want).max() < 0.015


def test_a_dish_finished_alone_follows_the_process():
    """One by one, customers at one dish open tables as often as the skipping search does."""
    d, fresh, slope, c, rng = 0.7, 0.2, 0.05, 40, np.random.default_rng(3)
    alone = np.array([1 + len(op8.finished(c, 1, 1, fresh, slope, d, rng)) for _ in range(20000)])
    tables = np.zeros(c + 1)
    tables[1] = 1
    for i in range(1, c):
        a = fresh + slope * np.arange(c + 1)
        p = np.clip(a / np.maximum(a + i - d * np.arange(c + 1), a), 0, 1)
        tables = tables * (1 - p) + np.r_[0, (tables * p)[:-1]]
    assert np.abs(np.bincount(alone, minlength=c + 1) / 20000 - tables).max() < 0.015
    assert op8.finished(9, 9, 2, fresh, slope, d, rng) == []


def test_frequent_contexts_are_dealt_apart(spark):
    """Counts of contexts decide their spread only; scores do not depend on it."""
    docs = spark.createDataFrame([(i, f"the a{i % 7} the b{i % 5} rare{i}") for i in range(300)], "doc_id long, text string")
    size, bits = op8.context_sizes(docs, most=100)
    cell = lambda w: int(np.uint64(op8.hash_of(w)) >> np.uint64(op8.CELL_SHIFT))
    assert size == sum(len(t) for _, t in docs.collect())
    assert bits[cell("the")] == 3 and bits[cell("rare1")] == 0 and bits[int(op8.START >> np.uint64(op8.CELL_SHIFT))] == 2
