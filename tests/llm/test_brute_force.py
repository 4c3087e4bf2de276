"""Operators without SQL against plain computations."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tablero.llm import op05_toxicity as op5
from tablero.llm import op06_quality as op6
from tablero.llm import op07_topk as op7
from tablero.llm import op09_exact_dedup as op9


def test_kernel_against_enumerated_subsequences():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdexyz") for _ in range(rng.randint(1, 24))) for _ in range(30)] + [b" insult", b" insxult", b" in"]

    def features(word):
        out = Counter()
        for offsets, weight in op5.PATTERNS:
            for i in range(len(word) - offsets[-1]):
                out[bytes(word[i + k] for k in offsets)] += weight
        return out

    norm = lambda w: math.sqrt(sum(max(len(w) - o[-1], 0) * x * x for o, x in op5.PATTERNS) + 1e-9)
    marks = words[:8] + words[-3:]
    got = op5.Kernel(marks).values(*op5.as_units(words))
    for i, u in enumerate(words):
        fu = features(u)
        for j, m in enumerate(marks):
            fm = features(m)
            want = sum(v * fm[k] for k, v in fu.items()) / norm(u) / norm(m)
            assert abs(got[i, j] - want) < 1e-6, (u, m)
    close, far = got[-2, -2], got[0, -2]
    assert close > 0.3 > far  # an inserted character only lowers the value


def test_decisions_are_sums_over_kernel_rows():
    rng = np.random.default_rng(5)
    marks = [b" mark", b" other", b" third"]
    kernel, coef = op5.Kernel(marks), rng.normal(size=3)
    model = op5.Model(kernel, coef, 0.25)
    units = op5.as_units([b" mark", b" maxrk", b" zzz", b" something long"])
    assert np.allclose(model.decision(*units), kernel.values(*units) @ coef + 0.25, atol=1e-5)


def test_training_units_cover_very_long_words():
    word = "a" * 20 + "INSULT" + "b" * 70
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([f"x {word}"]), pa.array([1], pa.int32())], names=["doc_id", "text", "y"])
    units = [bytes(u) for b in op5.units_of([batch]) for u in b.column(2).to_pylist()]
    assert max(map(len, units)) <= op5.UNIT_BYTES and any(b"insult" in u for u in units) and any(u.endswith(b"bbb") for u in units)
    text = (" " + word).lower().encode()
    assert all(text[i : i + 8] in b"|".join(units) for i in range(len(text) - 8))


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(7)
    d = len(op6.NAMES)
    x = {0: rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) * 0.3, 1: rng.normal(size=(90, d)) + 0.7}
    model = op6.Discriminant({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()})
    both = np.vstack([x[0], x[1]])
    mean, scale = both.mean(0), np.sqrt(np.maximum(both.var(0), 1e-6))
    z = {k: (v - mean) / scale for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    common = (400 * cov[0] + 90 * cov[1]) / 490
    probe = rng.normal(size=(50, d))
    logs = []
    for k, n in ((0, 400), (1, 90)):
        own = op6.SHRINK_POOLED + (1 - op6.SHRINK_POOLED) * min(1.0, d / n)
        c = (1 - own) * cov[k] + own * common
        c = (1 - op6.SHRINK_SPHERE) * c + op6.SHRINK_SPHERE * np.trace(c) / d * np.eye(d)
        delta = (probe - mean) / scale - z[k].mean(0)
        logs.append(np.log(n / 490) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", delta, np.linalg.inv(c), delta))
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_one_class_alone_gives_the_share_of_label_one(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    scores = {r["score"] for r in op6.quality_scores(docs, labels).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1


def test_statistics_against_plain_counts():
    text = "One two TWO.\nthree 3 ### é!\nOne two TWO."
    row = dict(zip(op6.NAMES, op6.statistics(pa.array([text]))[0]))
    raw = text.encode()
    kinds = Counter(int(op6.CLASS[b]) for b in raw)
    top = max(range(op6.N_CLASS), key=lambda k: kinds[k])
    assert max(range(op6.N_CLASS), key=lambda k: row[f"share_{k}"]) == top and row["share_3"] > 0 and len(row) == len(op6.NAMES)


def test_blocks_of_clusters_are_skipped():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 300
    w = np.floor(np.repeat(centres, 32, axis=0) + rng.normal(size=(1280, 16)) * 5)
    q = np.floor(centres[:10] + rng.normal(size=(10, 16)))
    scored: list[int] = []
    got = op7.block_search(np.arange(1280), w, np.arange(5000, 5010), q, 5, np.full(10, -np.inf), 32, scored)
    for j in range(10):
        want = sorted((-int(s), i) for i, s in enumerate(w @ q[j]))[:5]
        assert sorted((-s, i) for k, i, s in got if k == 5000 + j) == want
    assert np.mean(scored) < 0.2 * 40  # four blocks of five and more are left out


def test_bounds_hold_for_extreme_values():
    w = np.array([[1e200, -1e200], [1.0, 2.0], [0.0, 0.0]])
    q = np.array([[0.0, 0.0], [1e-200, 1.0]])
    with np.errstate(all="ignore"):
        bound = op7.ball_bounds(q, *op7.ball([w[:2], w[2:]]))
    assert not np.isnan(bound).any() and (bound[:, 0] >= (q @ w[:2].T).max(1)).all() and (bound[:, 1] >= 0).all()


def test_exact_dedup_knows_the_largest_id(spark):
    top = 2**63 - 1
    rows = [(top, "same text"), (None, "same  text"), (None, "other"), (top - 1, "third"), (None, "third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in op9.exact_dedup(docs).collect())
    assert got == sorted(map(str, [(top, None, 2, False), (None, None, 2, True), (None, None, 1, True), (top - 1, top - 1, 2, True), (None, top - 1, 2, False)]))


def test_language_model_scores_from_a_known_seating(spark):
    """With every pair and word once in training there is one seating only; scores follow from its tables."""
    import zlib

    from tablero.llm import op08_pitman_yor as op8

    trained = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    words = [f"w{k}" for k in range(8)]
    texts = {trained: " ".join(words), held[0]: "w3 W4 zz w1", held[1]: "", held[2]: "qq"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op8.score(rows).collect()}
    # nine tokens, words, pairs and tables (the end is one of each); counts of counts put both discounts at their upper end
    d, n = 0.95, 9
    tokens = [*words, None]
    pairs = set(zip(["start", *words], tokens))
    parent = lambda w: ((1 - d if w in tokens else 0) + (1 + d * n) / (n + 1)) / (1 + n)

    def chance(u, w):
        if u not in ("start", *words):
            return parent(w)
        return ((1 - d if (u, w) in pairs else 0) + (1 + d) * parent(w)) / 2

    assert abs(sum(chance("w3", w) for w in [*tokens, "unknown"]) - 1) < 1e-12
    for i, text in texts.items():
        own = [*text.lower().split(), None]
        want = sum(math.log10(chance(u, w)) for u, w in zip(["start", *own], own))
        base = sum(math.log10(((w in tokens) + 0.5) / (n + 0.5 * (n + 1))) for w in own)
        r = got[i]
        assert abs(r["score"] - want) < 1e-5 and abs(r["base_score"] - base) < 1e-6, i
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(w in tokens for w in own), n, i != trained)


def test_tables_are_found_in_few_probes(monkeypatch):
    from tablero.llm import op08_pitman_yor as op8

    rng = np.random.default_rng(5)
    n = 3000
    c, fresh, slope = rng.integers(200, 200_000, n), rng.random(n) * 2 + 1e-4, rng.random(n) * 0.3
    probed, real = [], op8.log_rise
    monkeypatch.setattr(op8, "log_rise", lambda lo, hi, base: (probed.append(len(lo)), real(lo, hi, base))[1])
    got = op8.seated(c, fresh, slope, 0.6, np.random.default_rng(9))
    assert sum(probed) / 2 < 8 * (len(got.at) + n)  # two a probe; steps and halves alone took over twenty
    # the same draws, seated customer by customer
    dishes, places, draws = [], [], np.random.default_rng(9)
    k, t = np.arange(n), np.ones(n, np.int64)
    for seats in range(1, op8.EARLY):
        a = fresh + slope * t
        opened = np.flatnonzero(draws.random(n) * (a + seats - 0.6 * t) < a)
        t[opened] += 1
        dishes.append(opened)
        places.append(np.full(len(opened), seats))
    i = np.full(n, op8.EARLY)
    u = np.log(draws.random(n))
    for dish in range(200):
        at = np.arange(i[dish], c[dish])
        a, held = fresh[dish] + slope[dish] * t[dish], 0.6 * t[dish]
        gone = np.cumsum(np.log(at - held) - np.log(at + a - held)) < u[dish]
        mine = np.sort(got.at[(got.dish == dish) & (got.at >= op8.EARLY)])
        assert (mine[0] == at[np.argmax(gone)]) if gone.any() else not len(mine)
    early = sorted(zip(np.concatenate(dishes), np.concatenate(places)))
    assert early == sorted((d, p) for d, p in zip(got.dish, got.at) if p < op8.EARLY)


def test_pairs_are_ordered_as_one_number_or_as_two():
    from tablero.llm import op08_pitman_yor as op8

    rng = np.random.default_rng(2)
    rows = np.sort(rng.integers(0, 500, 5000)).astype(np.int32)
    held = rng.random(500) < 0.2
    u, w = rng.integers(0, 90, 5000), rng.integers(0, 90, 5000)
    (key, at), (wide, far) = op8.sorted_pairs(u, w, held, rows, 90), op8.sorted_pairs(u, w, held, rows, 1 << 30)
    want = sorted(zip(u.tolist(), w.tolist(), held[rows].tolist(), rows.tolist()))
    assert [((k >> 26), (k >> 1) & ((1 << 25) - 1), bool(k & 1), d) for k, d in zip(key.tolist(), at.tolist())] == want
    assert (key == wide).all() and (at == far).all() and at.dtype == rows.dtype
    for x in (rng.integers(0, 9, 50), rng.integers(0, 1 << 40, 50), np.zeros(0, np.int64), np.array([7, 7], np.uint8)):
        for a, b in zip(op8.numbered(x), np.unique(x, return_inverse=True)):
            assert a.tolist() == b.tolist()
        assert op8.distinct(x).tolist() == np.unique(x).tolist()
