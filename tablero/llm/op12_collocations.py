"""Phrase collocation mining by a distributed multikey quicksort of suffix pointers.

Two passes over the texts. The first counts words per language; words below the threshold end every suffix, for no phrase
with them can reach it. The second turns every position into a suffix of at most five word numbers, cut at the end of its
piece or before a rare word, folds equal suffixes of a block with their counts, and routes them to buckets by ranges of
their leading words (ranges of whole suffixes, so that a hot leading word or pair spreads over several buckets). A bucket
sorts its suffix pointers with a three-way multikey quicksort: the size of an equal part at depth d is the count of the
phrase of d words, and parts below the threshold are abandoned, except along the two edges of a range, where a phrase may
go on in the next bucket; those counts are added up by phrase. Scores, inner phrases and ranks are DataFrame joins.

Word numbers: the ``NUMBERED`` most frequent words have small numbers (a table of fixed size that travels to the tasks),
further frequent words are named by 64 bits of their hash; a bitmap of fixed size leaves out most rare words, and those it
lets through only cost space. Words are told apart by 64-bit hashes of language and word. The sample that sets the ranges
is bounded and balances work only.

Null text: no words. Null language: ``und``. Empty tables and languages without a candidate: no rows. Repeated rows count
as often as they stand. Very long texts are cut into portions between pieces; memory follows the longest piece. Extra
columns are ignored. Arithmetic is decimal with 38 digits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged
from .textops import LOWER, byte_buffer, mix, slices, word_hashes

#: The characters that end a piece, and those that end only a word.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_ENDS = b"\x20\x09"
IS_PIECE_END = np.zeros(256, bool)
IS_PIECE_END[list(PIECE_ENDS)] = True
IS_WORD = ~IS_PIECE_END
IS_WORD[list(WORD_ENDS)] = False

#: Words with numbers of their own, bits of the bitmap of further frequent words, tokens a bucket, positions a block.
NUMBERED = (1 << 18) - 1
FILTER_BITS = 1 << 25
BUCKET_TOKENS = 2_000_000
BLOCK = 1_000_000
PORTION = 2_000_000
#: Sampled suffixes per block of words, and sampled blocks at most: for the borders of ranges only.
SAMPLED = 256
SAMPLED_BLOCKS = 512
#: Parts of fewer pointers are split by one sort instead of around pivots.
SMALL = 4096
DEPTH = 5
ESCAPE = np.uint64(1 << 63)


def portions(data: np.ndarray, offsets: np.ndarray):
    """Slices of whole rows (bytes, offsets in them, first row); a long row is cut behind the end of a piece."""
    for lo, hi in slices(offsets, PORTION):
        at, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or end - at <= PORTION:
            yield data[at:end], offsets[lo : hi + 1] - at, lo
            continue
        while at < end:
            stop = min(at + PORTION, end)
            if stop < end:
                ends = np.flatnonzero(IS_PIECE_END[data[at:stop]])
                if len(ends):
                    stop = at + int(ends[-1]) + 1
                else:
                    ends = np.flatnonzero(IS_PIECE_END[data[stop:end]])
                    stop = stop + int(ends[0]) + 1 if len(ends) else end
            yield data[at:stop], np.array([0, stop - at]), lo
            at = stop


def seed_of(lang: str) -> int:
    """64 bits that stand for a language: of its exact bytes (``EN`` is not ``en``), and of no kin to the hashes of words (``es`` in ``de`` is not ``de`` in ``es``)."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def words_of(lang, text):
    """Per portion: hashes of (language, word), whether a word begins a piece, starts, ends, bytes and row of every word."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(lang, pa.ChunkedArray):
        lang = lang.combine_chunks()
    named = pc.dictionary_encode(lang.fill_null("und"))
    seeds = np.array([seed_of(x) for x in named.dictionary.to_pylist()], np.uint64)
    of_row = named.indices.to_numpy(zero_copy_only=False)
    for part, offs, first in portions(*byte_buffer(text)):
        inside, edge = IS_WORD[part], np.zeros(len(part) + 1, bool)
        edge[offs] = True
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        if not len(starts):
            continue
        rows = np.searchsorted(offs, starts, "right") - 1
        stops = np.cumsum(IS_PIECE_END[part])
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (stops[starts[1:]] != stops[starts[:-1]]) | (rows[1:] != rows[:-1])
        yield mix(word_hashes(part, starts, ends) ^ seeds[of_row[first + rows]]), fresh, starts, ends, part, first + rows


def _strings(part: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The lower-cased words of the given spans as an Arrow array."""
    import pyarrow as pa

    sizes = ends - starts
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    raw = LOWER[part[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])]]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(raw)])


def narrow(values: np.ndarray) -> np.ndarray:
    """Four bytes a value where all fit."""
    return values.astype(np.uint32) if values.size and values.max() < 1 << 32 else values


def _suffixes(values: np.ndarray, fresh: np.ndarray, least: int) -> np.ndarray:
    """Suffixes (rows of DEPTH values, 0 after their end) of all positions with ``least`` words or more; value 0 ends one."""
    n = len(values)
    at = np.flatnonzero(values)
    values = narrow(values)
    out = np.zeros((len(at), DEPTH), values.dtype)
    out[:, 0], alive = values[at], np.arange(len(at))
    for d in range(1, DEPTH):
        p = at[alive] + d
        inside = p < n
        alive, p = alive[inside], p[inside]
        on = (values[p] != 0) & ~fresh[p]
        alive, p = alive[on], p[on]
        out[alive, d] = values[p]
    return out[out[:, least - 1] != 0] if least > 1 else out


def _word_counts(docs: DataFrame, text: str, lang: str, least: int) -> DataFrame:
    """lang, word, hash, f of the words with ``least`` occurrences; rows without word hold a language's total (n in f) or a sample."""

    def count(batches):
        import pyarrow as pa

        held, size = [], 0

        def folded():
            totals: dict[str, int] = {}
            for h, c, _, langs, _ in held:
                for name, k in langs:
                    totals[name] = totals.get(name, 0) + k
            hashes = np.concatenate([x[0] for x in held])
            u, first, where = np.unique(hashes, return_index=True, return_inverse=True)
            counts = np.bincount(where, np.concatenate([x[1] for x in held]).astype(np.float64)).astype(np.int64)
            words = pa.concat_arrays([x[2][0] for x in held]).take(pa.array(first)).cast(pa.string())
            names = pa.concat_arrays([x[2][1] for x in held]).take(pa.array(first))
            sample = np.concatenate([x[4] for x in held])
            sample = sample[np.random.default_rng(len(sample)).permutation(len(sample))[:SAMPLED]]
            yield pa.RecordBatch.from_arrays([names, words, pa.array(u.view(np.int64)), pa.array([None] * len(u), pa.binary()), pa.array(counts)], names=["lang", "word", "hash", "sample", "f"])
            k = len(totals) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([*totals, None], pa.string()), pa.array([None] * k, pa.string()), pa.array([None] * k, pa.int64()), pa.array([None] * (k - 1) + [sample.tobytes()], pa.binary()), pa.array([*totals.values(), 0], pa.int64())],
                names=["lang", "word", "hash", "sample", "f"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0).fill_null("und")
            for h, fresh, starts, ends, part, rows in words_of(b.column(0), b.column(1)):
                u, first, counts = np.unique(h, return_index=True, return_counts=True)
                by_row = np.bincount(rows, minlength=b.num_rows)
                seen = np.flatnonzero(by_row)
                langs = list(zip(names.take(pa.array(seen)).to_pylist(), by_row[seen].tolist()))
                drawn = np.random.default_rng(len(h)).integers(0, len(h), min(len(h), SAMPLED))
                sample = np.zeros((len(drawn), DEPTH), np.uint64)
                alive = np.ones(len(drawn), bool)
                for d in range(DEPTH):
                    p = np.minimum(drawn + d, len(h) - 1)
                    alive &= (drawn + d < len(h)) & (~fresh[p] if d else True)
                    sample[:, d] = np.where(alive, h[p], 0)
                held.append((u, counts, (_strings(part, starts[first], ends[first]), names.take(pa.array(rows[first]))), langs, sample))
                size += len(h)
                if size >= 2 * BLOCK:
                    yield from folded()
                    held, size = [], 0
        if held:
            yield from folded()

    words = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, word string, hash long, sample binary, f long")
    return staged(words.groupBy("lang", "word", "hash", "sample").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("word").isNull()))


def _filter(rest: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``bits`` bits (packed) with the cells of the given hashes; made in chunks, so that its size is fixed."""
    chunks = 64
    cells = rest.select(F.pmod(F.col("hash"), F.lit(bits)).alias("cell")).distinct()

    def packed(keys, frame):
        import pandas as pd

        mark = np.zeros(bits // chunks, bool)
        mark[frame["cell"].to_numpy() % (bits // chunks)] = True
        return pd.DataFrame({"chunk": [keys[0]], "bits": [np.packbits(mark).tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    chunk = F.floor(F.col("cell") / (bits // chunks)).cast("long")
    for row in cells.withColumn("chunk", chunk).groupBy("chunk").applyInPandas(packed, "chunk long, bits binary").collect():
        size = bits // chunks // 8
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


class Numbers:
    """Values of word hashes: a number from 1 for numbered words, the hash with ESCAPE for others in the bitmap, else 0."""

    def __init__(self, hashes: np.ndarray, bitmap: np.ndarray | None) -> None:
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.bitmap = hashes[order], (order + 1).astype(np.uint64), bitmap

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            out[known] = self.numbers[at[known]]
        if self.bitmap is not None:
            cell = h.view(np.int64) % (len(self.bitmap) * 8)
            perhaps = (out == 0) & (self.bitmap[cell >> 3] & (128 >> (cell & 7)).astype(np.uint8) != 0)
            out[perhaps] = h[perhaps] | ESCAPE
        return out


def in_order(s: np.ndarray) -> np.ndarray:
    """The order of suffixes."""
    if len(s) and s.max() < 1 << 18:
        part = lambda d, bits: s[:, d].astype(np.uint64) << np.uint64(bits)
        return np.lexsort((part(3, 18) | part(4, 0), part(0, 36) | part(1, 18) | part(2, 0)))
    return np.lexsort(s.T[::-1])


def fold(s: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, equal ones once, and their counts."""
    order = in_order(s)
    s = s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(s))) if weights is None else np.add.reduceat(weights[order], at)
    return s[at], counts.astype(np.int64)


def cuts(s: np.ndarray, borders: np.ndarray) -> list[int]:
    """Per border the first of the ordered suffixes that is not below it."""
    out, columns = [], [np.ascontiguousarray(s[:, d]) for d in range(DEPTH)]
    top = np.iinfo(s.dtype).max
    for border in borders:
        lo, hi = 0, len(s)
        if border.max() > top:
            columns, top = [c.astype(np.uint64) for c in columns], border.max()
        border = border.astype(columns[0].dtype)
        for d in range(DEPTH):
            part = columns[d][lo:hi]
            lo, hi = lo + int(np.searchsorted(part, border[d], "left")), lo + int(np.searchsorted(part, border[d], "right"))
        out.append(lo)
    return out


def pack(s: np.ndarray, counts: np.ndarray) -> bytes:
    """Compressed byte planes of suffixes and counts."""
    import pyarrow as pa

    kind = np.uint32 if s.dtype == np.uint32 and (not len(counts) or counts.max() < 1 << 32) else np.uint64
    cells = np.column_stack([s.astype(kind, copy=False), counts.astype(kind)])
    planes = np.ascontiguousarray(np.ascontiguousarray(cells.T).reshape(-1).view(np.uint8).reshape(cells.size, -1).T)
    return np.array([len(s), cells.itemsize], np.int64).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    n, size = np.frombuffer(raw[:16], np.int64)
    planes = np.frombuffer(pa.decompress(raw[16:], decompressed_size=int(n * size * (DEPTH + 1)), codec="zstd", asbytes=True), np.uint8)
    flat = np.ascontiguousarray(planes.reshape(int(size), -1).T).reshape(-1).view(np.uint32 if size == 4 else np.uint64)
    cells = flat.reshape(DEPTH + 1, int(n))
    return cells[:DEPTH].T, cells[DEPTH].astype(np.int64)


def multikey_quicksort(s: np.ndarray, weights: np.ndarray, least: int, edges: list[np.ndarray]):
    """(phrase, count) of every equal part of two words or more with ``least`` occurrences, and of all leading parts of ``edges``.

    Pointers are parted around a pivot of the word at one depth into smaller, equal and larger; the equal part goes on with
    the next word. Parts whose counts cannot reach ``least`` are abandoned unless an edge leads through them.
    """
    columns = [np.ascontiguousarray(s[:, d]) for d in range(DEPTH)]
    pointers = np.arange(len(s))
    # (pointers, depth, words so far, edges that begin with them)
    stack = [(pointers, 0, (), [e for e in edges])]
    while stack:
        part, depth, words, along = stack.pop()
        keys = columns[depth][part]
        if len(part) <= SMALL:
            order = np.argsort(keys, kind="stable")
            part, keys = part[order], keys[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            sums = np.add.reduceat(weights[part], at) if len(at) else at
            ends = np.append(at[1:], len(part))
            kept = np.flatnonzero(sums >= least)
            if along:
                kept = np.union1d(kept, np.flatnonzero(np.isin(keys[at], np.array([e[depth] for e in along], np.uint64))))
            equals = [(part[at[i] : ends[i]], keys[at[i]], int(sums[i])) for i in kept]
        else:
            pivot = np.partition(keys[:: len(keys) // 9], 4)[4]
            below, above = keys < pivot, keys > pivot
            equal = ~(below | above)
            for side, on in ((below, [e for e in along if e[depth] < pivot]), (above, [e for e in along if e[depth] > pivot])):
                rest = part[side]
                if len(rest) and (on or weights[rest].sum() >= least):
                    stack.append((rest, depth, words, on))
            rest = part[equal]
            equals = [(rest, pivot, int(weights[rest].sum()))]
        for rest, word, count in equals:
            on = [e for e in along if e[depth] == word]
            if word == 0 or (count < least and not on):
                continue
            phrase = (*words, int(word))
            if depth:
                yield phrase, count
            if depth + 1 < DEPTH:
                stack.append((rest, depth + 1, phrase, on))


def _phrases(docs: DataFrame, numbers: Numbers, borders: np.ndarray, text: str, lang: str, least: int, longest: int) -> DataFrame:
    """key (values of the words), a: phrases of 2 to ``longest`` words with ``least`` occurrences."""

    def route(batches):
        import pyarrow as pa

        held, size = [], 0

        def flushed():
            s, counts = fold(np.concatenate(held))
            at = [0, *cuts(s, borders), len(s)]
            full = [i for i in range(len(at) - 1) if at[i + 1] > at[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([pack(s[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]) for i in full], pa.binary())], names=["bucket", "suffixes"]
            )

        for b in batches:
            for h, fresh, *_ in words_of(b.column(0), b.column(1)) if b.num_rows else ():
                found = _suffixes(numbers.of(h), fresh, 2)
                held.append(found)
                size += len(found)
                if size >= BLOCK:
                    yield from flushed()
                    held, size = [], 0
        if size:
            yield from flushed()

    def count(batches):
        import pyarrow as pa

        buckets: dict[int, list] = {}
        for b in batches:
            for no, raw in zip(b.column(0).to_pylist(), b.column(1)):
                buckets.setdefault(no, []).append(unpack(raw.as_buffer()))
        for no in sorted(buckets):
            got = buckets.pop(no)
            s, weights = fold(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            del got
            edges = [e for e in borders[max(no - 1, 0) : no + 1]]
            keys, sums = [], []
            for phrase, total in multikey_quicksort(s, weights, least, edges):
                keys.append(np.array(phrase, np.uint64).view(np.int64))
                sums.append(total)
            for lo in range(0, len(keys), 10_000):
                part = keys[lo : lo + 10_000]
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in part])), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(part))), pa.array(sums[lo : lo + 10_000], pa.int64())], names=["key", "a"])

    routed = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(route, "bucket int, suffixes binary")
    parts = routed.repartitionById(len(borders) + 1, "bucket").mapInArrow(count, "key array<bigint>, a long")
    return staged(parts.groupBy("key").agg(F.sum("a").alias("a")).where((F.col("a") >= least) & (F.size("key") <= longest)))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, first: int = 2000, text: str = "text", lang: str = "lang", numbered: int = NUMBERED, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` phrases.

    Candidates are phrases of 2 to ``longest`` (at most 5) words with ``least`` occurrences within pieces. A candidate's
    score is its lowest floor(1000 * a * n / (l * r)) over its cuts. Candidates inside a longer one that has ``share``
    percent of their count are dropped. Order: score and a descending, phrase by bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    table = _word_counts(docs, text, lang, least)
    words = table.where(F.col("word").isNotNull()).select("lang", "word", "hash", "f")
    totals = table.where("word is null and sample is null").select(F.col("lang").alias("of_lang"), F.col("f").alias("n"))
    tokens = int(totals.agg(F.sum("n")).first()[0] or 0)
    top = words.orderBy(F.desc("f"), "hash").limit(numbered)
    ranked = np.array(top.select("hash").toArrow().column(0).to_numpy(), np.int64).view(np.uint64)
    bitmap = None
    if len(ranked) == numbered:
        bitmap = _filter(words, FILTER_BITS)
    numbers = Numbers(ranked, bitmap)
    buckets = max(1, min(65_536, tokens // bucket_tokens))
    sampled = table.where("sample is not null").orderBy(F.md5("sample")).limit(SAMPLED_BLOCKS).select("sample").collect()
    borders = _borders([r[0] for r in sampled], numbers, buckets)
    cands = _phrases(docs, numbers, borders, text, lang, least, longest)
    value = _values(words, numbers)
    named = staged(words.select("lang", "word", "f", value.alias("value")))

    by_word = named.select(F.col("value").alias("head"), "lang")
    known = cands.withColumn("head", F.col("key")[0]).join(by_word, "head").join(totals, F.col("lang") == F.col("of_lang")).select("key", "a", "lang", "n")
    counts = cands.select("key", F.col("a").alias("f")).unionByName(named.select(F.array("value").alias("key"), "f"))
    cut = known.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("key") - 1)))
    cut = cut.withColumn("left", F.slice("key", F.lit(1), F.col("k"))).withColumn("right", F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")))
    cut = cut.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    exact = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cut.withColumn("score", exact).groupBy("key", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = F.explode(F.array(F.slice("key", F.lit(1), F.size("key") - 1), F.slice("key", F.lit(2), F.size("key") - 1)))
    longer = cands.where(F.size("key") > 2).select(inner.alias("key"), F.col("a").alias("around")).groupBy("key").agg(F.max("around").alias("around"))
    stay = scored.join(longer, "key", "left").where(F.col("around").isNull() | (100 * big("around") < share * big("a")))
    flat = stay.select("key", F.posexplode("key").alias("at", "value"))
    phrase = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]))
    texts = flat.join(named.select("value", "word"), "value").groupBy("key").agg(phrase.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = stay.join(texts, "key").select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _values(words: DataFrame, numbers: Numbers):
    """The column of word values: as Numbers.of, in tasks."""
    from pyspark.sql.functions import pandas_udf

    def value(h):
        import pandas as pd

        return pd.Series(numbers.of(h.to_numpy().astype(np.int64).view(np.uint64)).view(np.int64))

    return pandas_udf(value, "long")(F.col("hash"))


def _borders(sampled: list[bytes], numbers: Numbers, buckets: int) -> np.ndarray:
    """At most ``buckets`` - 1 suffixes that part the sampled ones into ranges of equal numbers."""
    none = np.zeros((0, DEPTH), np.uint64)
    if not sampled or buckets == 1:
        return none
    drawn = np.frombuffer(b"".join(sampled), np.uint64).reshape(-1, DEPTH)
    values = numbers.of(drawn.reshape(-1)).reshape(-1, DEPTH)
    values = np.where((drawn != 0) & np.logical_and.accumulate((values != 0) & (drawn != 0), axis=1), values, np.uint64(0))
    values = values[values[:, 1] != 0]
    if not len(values):
        return none
    values = values[in_order(values)]
    return np.unique(values[np.linspace(0, len(values), buckets, endpoint=False).astype(int)[1:]], axis=0)
