"""Toxicity: a gapped-subsequence string kernel, Nyström features over landmark words, a linear SVM.

Unit: a lower-cased word with a mark at its start; runs of one-letter words are joined first, so
spelled-out words are units too. Kernel: subsequences of three, five and seven bytes with a few skipped
bytes, each weighing DECAY per skipped byte, normalised by length; inserted characters only lower the value. With
so few gaps the kernel has a finite feature map (subsequences hashed to 24 bits), and its values against all landmarks are
sums over one table of the landmarks' subsequences. The SVM is trained on units of labelled sentences: units of clean sentences, and
from toxic texts the witness units, chosen anew from round to round. A text's score is Platt's
logistic of its three highest units and its length.

Defined cases: null or empty text has no unit and gets the score of texts without evidence; without toxic
or clean training rows every score is 0; rows without a label take no part in the fit; repeated rows are scored
each; very long texts are read whole, very long words in overlapping pieces; extra columns are ignored; an empty table gives an empty result.

The fit uses at most TOXIC_ROWS and CLEAN_ROWS labelled rows, those with the smallest hashed ids.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .op06_quality import remainder
from .textops import IS_SPACE, LOWER, SPACES, byte_buffer, slices, word_hashes, word_spans

TOXIC_ROWS, CLEAN_ROWS = 4000, 12000
CANDIDATES, CLEAN_UNITS = 3000, 12000
LANDMARKS = 128
MARK, TOP = 0x20, 3
#: Subsequence length and the bytes that may be skipped inside.
GAPS, DECAY = {3: 2, 5: 1, 7: 0}, 0.5
#: Bytes of a unit that are read; a longer one is cut into overlapping pieces of this length.
UNIT_BYTES = 32
DEPTH = 3
ROUNDS, HARD_UNITS = 2, 4000
COST = 500.0
THRESHOLD = 0.5

#: Bytes that units keep: white space (it parts them), digits, letters, and all bytes of other scripts.
KEEP = np.array([c in SPACES or c >= 128 or chr(c).isalnum() for c in range(256)])



def patterns() -> list[tuple[tuple[int, ...], float]]:
    """Offsets of the bytes of a subsequence, and its weight."""
    out = []
    for length, gaps in GAPS.items():
        for skips in itertools.product(range(gaps + 1), repeat=length - 1):
            if sum(skips) <= gaps:
                out.append(((0, *itertools.accumulate(1 + k for k in skips)), DECAY ** sum(skips)))
    return out


PATTERNS = patterns()


def spelled(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the spaces inside runs of at least three one-letter words with single spaces between."""
    single = ends - starts == 1
    near = np.zeros(len(starts), bool)
    near[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (rows[1:] == rows[:-1])
    run = np.cumsum(~near)
    return starts[near & (np.bincount(run)[run] >= 3)] - 1


def pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut units over UNIT_BYTES into half-overlapping pieces; also each piece's unit."""
    length = ends - starts
    step = UNIT_BYTES // 2
    n = np.where(length > UNIT_BYTES, -(-(length - UNIT_BYTES) // step) + 1, 1)
    unit = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
    s = starts[unit] + k * step
    return s, np.minimum(s + UNIT_BYTES, ends[unit]), unit


def subsequences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per gap pattern: units (as positions in starts) and the 24-bit codes of their subsequences, and the weight.

    ``data`` is lower-cased. flags: a table over 2**24 codes; other codes are skipped.
    """
    length = ends - starts
    wide = data.astype(np.uint32)
    for offsets, weight in PATTERNS:
        n = np.maximum(length - offsets[-1], 0)
        total = int(n.sum())
        if not total:
            continue
        at = np.arange(total) - np.repeat(np.cumsum(n) - n - starts, n)
        code = np.full(total, len(offsets), np.uint32)
        for k in offsets:
            code = code * np.uint32(0x01000193) + wide[at + k]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(8)
        unit = np.repeat(np.arange(len(starts)), n)
        if flags is not None:
            hit = flags[code]
            unit, code = unit[hit], code[hit]
        yield unit, code.astype(np.int64), weight


def unit_norms(length: np.ndarray) -> np.ndarray:
    """Length of the feature vector of a unit of so many bytes, if its subsequences differ."""
    return np.sqrt(sum(np.maximum(length - o[-1], 0) * w * w for o, w in PATTERNS) + 1e-9)


class Kernel:
    """Values of the kernel between units and a fixed list of landmark strings."""

    def __init__(self, landmarks: list[bytes]) -> None:
        data, starts, ends = as_units(landmarks)
        norm = unit_norms(ends - starts)
        hits = list(subsequences(data, starts, ends))
        unit, code = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
        value = np.concatenate([np.full(len(h[0]), h[2]) for h in hits])
        self.codes, at = np.unique(code, return_inverse=True)
        self.rows = np.zeros((len(self.codes), len(landmarks)))
        np.add.at(self.rows, (at, unit), value / norm[unit])

    def values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Matrix units x landmarks."""
        out = np.zeros((len(starts), self.rows.shape[1]))
        norm = unit_norms(ends - starts)
        flags = np.zeros(1 << 24, bool)
        flags[self.codes] = True
        for unit, code, weight in subsequences(data, starts, ends, flags):
            np.add.at(out, unit, self.rows[np.searchsorted(self.codes, code)] * weight)
        return out / norm[:, None]


def text_units(column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of a text column: first row, bytes, and starts, ends, rows (from the first) of the units.

    A unit begins with MARK. Letters are lower-cased; ASCII marks inside words are dropped, as they are the commonest insertions.
    """
    data, offsets = byte_buffer(column)
    for lo, hi in slices(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        keep = KEEP[part]
        at = np.r_[0, np.cumsum(keep)]
        part, offs = part[keep], at[offsets[lo : hi + 1] - offsets[lo]]
        starts, ends, rows = word_spans(part, offs)
        if len(starts) and len(inner := spelled(starts, ends, rows)):
            part, offs = np.delete(part, inner), offs - np.searchsorted(inner, offs)
        part = np.where(IS_SPACE[part], np.uint8(MARK), part)
        part, offs = np.insert(part, offs[:-1], MARK), offs + np.arange(len(offs))
        starts, ends, rows = word_spans(part, offs)
        yield lo, part, starts - 1, ends, rows


def as_units(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[np.frombuffer(b"".join(words) or b" ", np.uint8)]
    ends = np.cumsum([len(w) for w in words])
    return data, ends - np.array([len(w) for w in words]), ends


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 60) -> np.ndarray:
    """Squared-hinge linear SVM (last coefficient: bias) by Newton steps with a line search."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-3]

    def loss(v: np.ndarray) -> float:
        return 0.5 * (ridge * v * v).sum() + c * (weight * np.maximum(1 - y * (x @ v), 0) ** 2).sum()

    now = loss(w)
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = ridge * w - 2 * c * (x[on] * (weight * y * slack)[on, None]).sum(0)
        step = np.linalg.solve(np.diag(ridge) + 2 * c * (x[on] * weight[on, None]).T @ x[on], grad)
        rate = 1.0
        while rate > 1e-4 and (new := loss(w - rate * step)) > now:
            rate /= 2
        if rate <= 1e-4 or now - new < 1e-9 * now:
            break
        w, now = w - rate * step, new
    return w


class Model:
    """The SVM over Nyström features. A decision is linear in the kernel row, hence a sum over the unit's subsequences."""

    def __init__(self, kernel: Kernel | None = None, coef: np.ndarray | None = None, bias: float = 0.0) -> None:
        self.codes = kernel.codes if kernel else None
        self.weights = (kernel.rows @ coef).astype(np.float32) if kernel else None
        self.bias, self.scale = float(bias), np.r_[4.0, np.zeros(TOP + 1)]
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}  # each worker builds its own

    def decision(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._table is None:
            flags = np.zeros(1 << 24, bool)
            flags[self.codes] = True
            self._table = (flags, self.weights)
        flags, weights = self._table
        out = np.zeros(len(starts))
        for unit, code, weight in subsequences(data, starts, ends, flags):
            out += weight * np.bincount(unit, weights=weights[np.searchsorted(self.codes, code)], minlength=len(starts))
        return out / unit_norms(ends - starts) + self.bias

    def evidence(self, column) -> np.ndarray:
        """Per text: decisions of its three highest different units and the log of its number of units."""
        out = np.full((len(column), TOP + 1), -1.5)
        out[:, TOP] = 0
        for lo, part, s, e, r in text_units(column):
            if not len(s):
                continue
            _, first, which = np.unique(word_hashes(part, s, e), return_index=True, return_inverse=True)
            ps, pe, unit = pieces(s[first], e[first])
            value = np.full(len(first), -np.inf)
            np.maximum.at(value, unit, self.decision(part, ps, pe))
            pairs = np.unique(r * len(first) + which)
            row, v = pairs // len(first), np.clip(value[pairs % len(first)], -1.5, 1.5)
            order = np.lexsort((-v, row))
            row, v = row[order], v[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < TOP
            out[lo + row[top], rank[top]] = v[top]
            n = np.bincount(r)
            out[lo : lo + len(n), TOP] = np.log1p(n)
        return out

    def text_scores(self, column) -> np.ndarray:
        if self.codes is None:
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(self.evidence(column) @ self.scale[:-1] + self.scale[-1], -500, 500)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's logistic of a text's evidence, by Newton steps with a small ridge."""
        x = np.c_[x, np.ones(len(x))]
        w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.3
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (q - y) + ridge @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.scale = w


def sampled(labels: DataFrame, label: str, toxic_rows: int, clean_rows: int) -> DataFrame:
    """The bounded sample of training labels: doc_id, y."""
    own = labels.where(F.col(label).isin(0, 1) & (remainder(F.col("doc_id")) != 0)).select("doc_id", F.col(label).alias("y"))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    take = lambda y, n: own.where(F.col("y") == y).orderBy("h", "doc_id").limit(n)
    return take(1, toxic_rows).unionByName(take(0, clean_rows)).drop("h")


def units_of(batches):
    """Per text its different units, longer ones in overlapping pieces: y, doc_id, unit."""
    import pyarrow as pa

    for b in batches:
        ids, ys = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        for lo, part, s, e, r in text_units(b.column(1)):
            if len(s):
                h = word_hashes(part, s, e)
                order = np.lexsort((h, r))
                pick = order[np.r_[True, (h[order][1:] != h[order][:-1]) | (r[order][1:] != r[order][:-1])]]
                raw = part.tobytes()
                ps, pe, unit = pieces(s[pick], e[pick])
                units = [raw[i:j] for i, j in zip(ps.tolist(), pe.tolist())]
                rows = lo + r[pick][unit]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ys[rows].astype(np.int32)), pa.array(units, pa.binary())], names=["doc_id", "y", "unit"])


def cover(held: list[tuple[int, ...]], n: int) -> np.ndarray:
    """Greedy witnesses: per candidate the number of toxic texts that it helps to explain (0: no witness).

    A text is explained by up to DEPTH witnesses; one that is no text's first must explain a hundredth of all.
    Texts with the same candidates, as copies have, count once. A text holds an insult and much else; what only its
    copies share explains nothing that the insult has not explained before.
    """
    groups = sorted(set(held))
    holders: list[list[int]] = [[] for _ in range(n)]
    for g, ks in enumerate(groups):
        for k in ks:
            holders[k].append(g)
    gain, votes, left = np.array([len(h) for h in holders]), np.zeros(n), np.full(len(groups), DEPTH)
    for _ in range(n):
        k = int(gain.argmax())
        first = sum(left[g] == DEPTH for g in holders[k])  # texts not explained at all before
        if gain[k] < max(2, 0.002 * len(groups)):
            break
        if first >= max(2, 0.002 * len(groups)) or gain[k] >= 0.01 * len(groups):
            votes[k] = gain[k]
            for g in holders[k]:
                if left[g]:
                    left[g] -= 1
                    if not left[g]:
                        gain[list(groups[g])] -= 1
        gain[k] = 0
    return votes


def varied(unit: bytes) -> list[bytes]:
    """The unit with one character inserted or replaced inside."""
    inner = range(2, len(unit))
    return [unit[:i] + x + unit[i:] for i in inner for x in (b"x", b"1")] + [unit[:i] + b"x" + unit[i + 1 :] for i in inner[:-1]]


def train(picked: list[bytes], votes: np.ndarray, clean: list[bytes]) -> Model:
    """The SVM of witness units and their variants against clean units."""
    order = [i for i in np.argsort(-votes, kind="stable") if votes[i] > 0]
    marks = [picked[i] for i in order[: LANDMARKS * 3 // 4]] + [u for u in clean if len(u) > 4][: LANDMARKS // 4]
    kernel = Kernel(marks)
    bad = [(picked[i], float(np.sqrt(votes[i]))) for i in order]
    shifted = [(v, w / (3 * len(u))) for u, w in bad for v in varied(u)]
    units = [u for u, _ in bad + shifted]
    x = np.vstack([kernel.values(*as_units(units)), kernel.values(*as_units(clean))])
    gram = kernel.values(*as_units(marks))
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-4 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])
    w = np.array([w for _, w in bad + shifted])
    weight = np.r_[w / w.sum(), np.full(len(clean), 1 / len(clean))] * COST
    y = np.r_[np.ones(len(units)), -np.ones(len(clean))]
    coef = linear_svm(x @ to_features, y, weight)
    return Model(kernel, to_features @ coef[:-1], coef[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Train on at most toxic_rows + clean_rows labelled texts."""
    spark = docs.sparkSession
    chosen = sampled(labels, label, toxic_rows, clean_rows)  # bounded by the two parameters
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))
    units = staged(texts.mapInArrow(units_of, "doc_id long, y int, unit binary"))
    counts = units.groupBy("unit").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    # a unit is a candidate witness if toxic texts hold it and clean ones hardly do
    suspects = counts.where("bad >= 2 and good * 20 <= bad and length(unit) >= 5").orderBy(F.desc("bad"), "unit").limit(CANDIDATES)
    picked = [bytes(r["unit"]) for r in suspects.collect()]
    good = counts.where("good > 0 and bad <= good").select("unit", "good")
    clean = [bytes(r["unit"]) for r in good.orderBy(F.xxhash64("unit"), "unit").limit(CLEAN_UNITS).collect()]
    clean += [bytes(r["unit"]) for r in good.orderBy(F.desc("good"), "unit").limit(CLEAN_UNITS // 4).collect()]
    clean = list(dict.fromkeys(clean))
    if not picked or not clean:
        return Model()
    small = spark.createDataFrame([(bytearray(u), i) for i, u in enumerate(picked)], "unit binary, k int")
    held = units.where("y = 1").join(F.broadcast(small), "unit").groupBy("doc_id").agg(F.sort_array(F.collect_set("k")).alias("ks")).collect()
    votes = cover([tuple(r["ks"]) for r in held], len(picked))
    if not votes.any():
        return Model()
    model = train(picked, votes, clean)
    for _ in range(ROUNDS):  # clean units that score highest join the clean side

        def score(batches, model=model):
            import pyarrow as pa

            for b in batches:
                data, starts, ends = as_units(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.decision(data, starts, ends))], names=["unit", "d"])

        hard = good.select("unit").mapInArrow(score, "unit binary, d double").where("d > -0.9").orderBy(F.desc("d"), "unit").limit(HARD_UNITS)
        clean = list(dict.fromkeys(clean + [bytes(r["unit"]) for r in hard.collect()]))
        model = train(picked, votes, clean)
    y, x = zip(*texts.mapInArrow(lambda bs: _evidence(bs, model), "y int, x array<double>").collect())  # the bounded sample again
    model.calibrate(np.array(x), np.array(y))
    return model


def _evidence(batches, model: Model):
    import pyarrow as pa

    for b in batches:
        x = model.evidence(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.text_scores(b.column(1)).astype(float))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return scores(docs, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
