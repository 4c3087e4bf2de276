"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text gives a fixed vector of statistics (lengths, character and word shapes, repetition).
Labelled training rows give class means and covariances as sums over partitions; a covariance is
shrunk towards the pooled one and towards its own mean variance. A score is the logistic of the
difference of Gaussian log densities, with Mahalanobis terms from Cholesky factors that are computed once and shipped with the task.

Defined cases: null and empty texts have the statistics of an empty text and get a score like any
other; a missing label takes no part in the fit; without labels of both classes the score is the share of label 1 (0.5
without labels); repeated rows are scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .textops import byte_buffer, slices, word_hashes, word_spans

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 loud marks, 7 symbols, 8 bars and brackets, 9 non-ASCII
_KINDS = (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\n\x0b\x0c\r", 4), (".,;:'\"?-", 5), ("!", 6), ("#$%&*+=@^~", 7), ("|<>[]{}()/\\_`", 8))
CLASS = np.zeros(256, np.uint8)
for _chars, _k in _KINDS:
    CLASS[[ord(c) for c in _chars]] = _k
CLASS[128:] = 9
N_CLASS = 10

NAMES = [
    "bytes", "words", "lines", "word_length", "word_spread", "line_words",
    *(f"share_{k}" for k in range(N_CLASS)),
    "odd_endings", "one_byte_words", "long_words", "capital_words", "upper_words", "symbol_words",
    "distinct_words", "distinct_lines", "top_word",
]
TRAIN_FOLDS = 5
SHRINK_POOLED, SHRINK_SPHERE = 0.1, 0.02
THRESHOLD = 0.3


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Square root of a share: spreads the small ones."""
    return np.sqrt(count / np.maximum(total, 1))


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of different hashes, and the count of the most frequent one."""
    kinds, top = np.zeros(n), np.zeros(n)
    if len(rows):
        order = np.lexsort((hashes, rows))
        r, h = rows[order], hashes[order]
        new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
        counts = np.diff(np.r_[new, len(r)])
        kinds = np.bincount(r[new], minlength=n).astype(float)
        np.maximum.at(top, r[new], counts)
    return kinds, top


def statistics(column) -> np.ndarray:
    """The matrix of statistics of a text column, one row per text."""
    data, offsets = byte_buffer(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for lo, hi in slices(offsets):
        part, offs, n = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hi - lo
        size = np.diff(offs).astype(float)
        kind = CLASS[part]
        byte_rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
        by_kind = np.bincount(byte_rows * N_CLASS + kind, minlength=n * N_CLASS).reshape(n, N_CLASS)
        starts, ends, rows = word_spans(part, offs)
        hashes = word_hashes(part, starts, ends)
        length = (ends - starts).astype(float)
        words = np.bincount(rows, minlength=n).astype(float)
        per_word = lambda v: np.bincount(rows, weights=v, minlength=n)
        mean = per_word(length) / np.maximum(words, 1)
        spread = np.sqrt(np.maximum(per_word(length**2) / np.maximum(words, 1) - mean**2, 0))
        newline = np.flatnonzero(part == 10)
        line_at = np.unique(np.r_[newline, offs[1:]][np.r_[newline, offs[1:]] > 0])
        line_start = np.r_[0, line_at[:-1]][: len(line_at)]
        line_rows = np.searchsorted(offs, line_start, "right") - 1
        lines = np.bincount(line_rows, minlength=n)[:n].astype(float) if len(line_at) else np.zeros(n)
        line_kinds, _ = _distinct(line_rows, word_hashes(part, line_start + (part[line_start] == 10), line_at), n) if len(line_at) else (np.zeros(n), None)
        kinds, top = _distinct(rows, hashes, n)
        head, tail = (kind[starts], kind[ends - 1]) if len(starts) else (kind[:0], kind[:0])
        upper = np.r_[0, np.cumsum(kind == 2)]
        odd = np.r_[0, np.cumsum((kind == 7) | (kind == 6))]
        all_upper = (upper[ends] - upper[starts] >= 0.6 * length) & (length > 1)
        out[lo:hi] = np.column_stack(
            [
                np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(mean), np.log1p(spread), np.log1p(words / np.maximum(lines, 1)),
                _share(by_kind, size[:, None]),
                _share(per_word((tail >= 6) & (tail <= 8)), words), _share(per_word(length == 1), words), _share(per_word(length > 12), words),
                _share(per_word(head == 2), words), _share(per_word(all_upper), words), _share(per_word(odd[ends] > odd[starts]), words),
                np.log((kinds + 1) / (words + 1)), np.log((line_kinds + 1) / (lines + 1)), _share(top, words),
            ]
        )
    return out


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(TRAIN_FOLDS))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics as array<float>."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            flat = statistics(b.column(1)).astype(np.float32)
            offsets = np.arange(0, flat.size + 1, len(NAMES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat.ravel())], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<float>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label: count, sums and sums of products of (stats, label); fixed size, whatever the number of rows."""
    d = len(NAMES)

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)
                y = b.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    own = x[y == k]
                    sums[k] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        k, at = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(at.ravel()), pa.array(sums.ravel())], names=["k", "at", "v"])

    found = np.zeros((2, 1 + d + d * d))
    for k, at, v in rows.select("stats", "label").mapInArrow(run, "k long, at long, v double").groupBy("k", "at").agg(F.sum("v")).collect():
        found[k, at] = v
    return {k: (found[k, 0], found[k, 1 : 1 + d], found[k, 1 + d :].reshape(d, d)) for k in (0, 1)}


class Discriminant:
    """Two shrunk Gaussians with cached Cholesky factors."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = SHRINK_POOLED, sphere: float = SHRINK_SPHERE) -> None:
        n = {k: sums[k][0] for k in (0, 1)}
        total = n[0] + n[1]
        self.flat = None if min(n.values()) >= 2 else (n[1] + 1) / (total + 2)
        if self.flat is not None:
            return
        d = len(sums[0][1])
        mean = (sums[0][1] + sums[1][1]) / total
        scale = np.sqrt(np.maximum(np.diag(sums[0][2] + sums[1][2]) / total - mean**2, 1e-6))
        self.mean, self.scale = mean, scale
        centre, cov = {}, {}
        for k in (0, 1):
            m = sums[k][1] / n[k]
            cov[k] = (sums[k][2] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
            centre[k] = (m - mean) / scale
        common = (n[0] * cov[0] + n[1] * cov[1]) / total
        self.parts = []
        for k in (0, 1):
            own = pooled + (1 - pooled) * min(1.0, d / n[k])  # few rows lean on the pooled estimate
            c = (1 - own) * cov[k] + own * common
            c = (1 - sphere) * c + sphere * max(np.trace(c) / d, 1e-3) * np.eye(d)
            low = np.linalg.cholesky(c)
            self.parts.append((centre[k], np.linalg.inv(low), np.log(np.diag(low)).sum(), np.log(n[k] / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        z = (x - self.mean) / self.scale
        logs = [prior - det - 0.5 * (((z - m) @ inverse.T) ** 2).sum(1) for m, inverse, det, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    own = labels.where(F.col(label).isin(0, 1) & (remainder(F.col("doc_id")) != 0)).select("doc_id", F.col(label).cast("long").alias("label"))
    return Discriminant(moments(stats.join(own, "doc_id").select("stats", "label")))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    d = len(NAMES)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = staged(with_statistics(docs))
    found = scored(stats, fit(stats, labels))
    return found.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
