"""Substring deduplication by hashing of lines, sentences and paragraphs.

A text's units are its lines (with words), its sentences (runs of words inside a paragraph up to a word that ends in a full stop,
question or exclamation mark) and its paragraphs of several lines (between lines without words). A line or sentence of fewer than MIN_WORDS
words is joined with the following ones up to MIN_WORDS words, so that a passage of short lines is seen wherever it stands, and one inside
a longer line by its sentences. A unit is normalised (A-Z lower-cased, runs of ASCII white space, line ends with
them, to one blank, ends stripped) and grouped by digest over the whole corpus, whatever its kind. The occurrence ranked first, by doc_id and
offset, stays; all others are removed from their texts, with their places in the original text reported. MIN_WORDS only keeps out
chance repeats of one to three words. Units may overlap; what goes is their union.

Units are dealt by ranges of (digest, doc_id, offset), so that a line of very many copies spreads over many tasks; each task walks its sorted
rows, and one row per partition tells whether its first digest began in the partition before. Inside tasks, texts are read and cut in slices
of about 1 MB with numpy; in Python itself a unit costs its MD5 and nothing else.

Defined cases: null texts stay null and empty ones empty, without units; rows without doc_id rank last; rows that repeat doc_id and text are
the same document, so a unit at the same offset of them is one occurrence; rows that share a doc_id but not the text are
told apart by a hash of the text; a unit repeated within a document is removed after its first place; very long texts are read whole, by one
task; ties cannot be, as (doc_id, offset, text) is the occurrence; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged
from .textops import IS_SPACE, LOWER, byte_buffer, slices, word_spans

MIN_WORDS = 4
#: Words in one run of removed units from which on a document counts as repeating a passage.
PASSAGE_WORDS = 25
_STOPS = np.isin(np.arange(256), list(b".!?"))
#: The last characters of a sentence that take three bytes.
_WIDE_STOPS = [np.frombuffer(c.encode(), np.uint8) for c in "。！？"]
_NORMAL = np.where(IS_SPACE, 32, LOWER).astype(np.uint8)


def characters(data: np.ndarray) -> np.ndarray:
    """Whether a code point begins at each byte of UTF-8."""
    return (data & 0xC0) != 0x80


def running(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each place, and before the end."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def stopped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word ends in a full stop, question or exclamation mark."""
    out = _STOPS[data[ends - 1]]
    wide = np.flatnonzero((data[ends - 1] > 127) & (ends - starts >= 3))
    if len(wide):
        last = data[ends[wide, None] + np.arange(-3, 0)]
        out[wide] = np.any([(last == c).all(axis=1) for c in _WIDE_STOPS], axis=0)
    return out


def joined(starts: np.ndarray, n: int, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges: from every start the fewest following pieces of its row that hold ``least`` words together; every row begins a piece."""
    ends = np.append(starts[1:], n)
    k = np.searchsorted(ends, starts + max(least, 1))
    full = k < len(ends)
    full[full] = rows[starts[k[full]]] == rows[starts[full]]
    return starts[full], ends[k[full]]


def units_in(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end (code points of the row) and digest (rows of 16 bytes) of each different unit of several texts."""
    starts, ends, rows = word_spans(data, offsets)
    n = len(starts)
    if not n:
        return rows, rows, rows, np.zeros((0, 16), np.uint8)
    lines_before = running(data == 10)
    breaks = lines_before[starts] - lines_before[np.append(0, ends[:-1])]
    breaks[np.append(True, rows[1:] != rows[:-1])] = 2
    lines, paragraphs = np.flatnonzero(breaks > 0), np.flatnonzero(breaks > 1)
    sentences = np.flatnonzero((breaks > 1) | np.append(False, stopped(data, starts, ends)[:-1]))
    after = np.append(paragraphs[1:], n)
    several = (after - paragraphs >= min_words) & (np.append(lines, n)[np.searchsorted(lines, paragraphs, "right")] < after)
    ranges = [joined(lines, n, rows, min_words), joined(sentences, n, rows, min_words), (paragraphs[several], after[several])]
    first, last = np.divmod(np.unique(np.concatenate([i * (n + 1) + j for i, j in ranges])), n + 1)
    # lower-cased words with one blank after each
    kept = ~IS_SPACE[data]
    blank = ends < len(data)
    blank[blank] = ~kept[ends[blank]]
    kept[ends[blank]] = True
    normal = _NORMAL[data[kept]].tobytes()
    lengths = ends - starts
    at = np.cumsum(lengths + blank) - lengths - blank
    md5 = hashlib.md5
    digests = b"".join([md5(normal[a:b]).digest() for a, b in zip(at[first].tolist(), (at + lengths)[last - 1].tolist())])
    place = running(characters(data))
    row, base = rows[first], place[offsets]
    return row, place[starts[first]] - base[row], place[ends[last - 1]] - base[row], np.frombuffer(digests, np.uint8).reshape(-1, 16)


def units_of(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """start, end (code points) and digest of each different unit."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    _, start, end, digest = units_in(data, np.array([0, len(data)]), min_words)
    return [(s, e, d.tobytes()) for s, e, d in zip(start.tolist(), end.tolist(), digest)]


def named(docs: DataFrame) -> DataFrame:
    """doc_id, name, text; the name tells rows apart that share a doc_id but not the text."""
    return docs.select("doc_id", F.hash("text").alias("name"), "text")


def hashed_units(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, name, start, end, digest (as two longs) of all units."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = byte_buffer(b.column(2))
            for lo, hi in slices(offsets):
                row, start, end, digest = units_in(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], min_words)
                halves = digest.view(np.int64)
                row = pa.array(row + lo)
                columns = [b.column(0).take(row), b.column(1).take(row), pa.array(start, pa.int32()), pa.array(end, pa.int32()), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "name", "start", "end", "head", "tail"])

    return named(docs).mapInArrow(run, "doc_id long, name int, start int, end int, head long, tail long")


def removed_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, name, start, end of the removed units; repeated rows repeat theirs."""
    spark = docs.sparkSession
    order = ["head", "tail", F.col("doc_id").asc_nulls_last(), "start", "name"]
    dealt = staged(hashed_units(docs, min_words)).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ddl = "doc_id long, name int, start int, end int, pid int, head long, tail long, last_head long, last_tail long"

    def run(batches) -> Iterator:
        """Removed units: all but the first of a digest; and with pid and digests the partition's first row, which may be the first or not, and its last digest."""
        import pyarrow as pa

        names = ["doc_id", "name", "start", "end", "pid", "head", "tail", "last_head", "last_tail"]
        kinds = (pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 4)
        first, opening, now = None, None, None  # the first row of the digest at hand, the partition's first row, its last digest
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.RecordBatch.from_arrays(list(b.columns), names=["doc_id", "name", "start", "end", "head", "tail"])
            opening = opening or tuple(b.slice(0, 1).to_pylist()[0].values())
            # the first row of the digest at hand leads the batch, so that a digest may go on from one batch to the next
            rows = b if first is None else pa.concat_batches([first, b])
            doc, name, start, head, tail = (rows.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("doc_id", "name", "start", "head", "tail"))
            null = rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            begins = np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))
            of = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
            again = np.flatnonzero((doc != doc[of]) | (null != null[of]) | (name != name[of]) | (start != start[of]))
            first, now = rows.slice(int(of[-1]), 1), (int(head[-1]), int(tail[-1]))
            if len(again):
                out = rows.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([*out.columns[:4], *(pa.nulls(len(again), k) for k in kinds[4:])], names=names)
        if opening is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*opening[:4], TaskContext.get().partitionId(), *opening[4:], *now), kinds)], names=names)

    found = staged(dealt.mapInArrow(run, ddl))
    edges = sorted(found.where("pid is not null").collect(), key=lambda r: r["pid"])  # one row per partition
    again = [tuple(r[c] for c in ("doc_id", "name", "start", "end")) for before, r in zip(edges, edges[1:]) if (before["last_head"], before["last_tail"]) == (r["head"], r["tail"])]
    rows = found.where("pid is null").select("doc_id", "name", "start", "end")
    return rows.unionByName(spark.createDataFrame(again, rows.schema))


def cut(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Several texts without the given units (by row and start; from a word's start to a word's end, in code points of the row).

    Remaining bytes, their row offsets, and row, start, end and words of the disjoint removed spans; spans parted by white space only are one.
    With a span goes one white-space character that follows it.
    """
    if not len(rows):
        return data, offsets, rows, starts, ends, rows
    place = running(characters(data))
    base = place[offsets]
    begin, end = (np.searchsorted(place[1:], base[rows] + at + 1) for at in (starts, ends))  # from code points to bytes
    end = np.maximum.accumulate(end)
    words = word_spans(data, offsets)[0]
    before, through = np.searchsorted(words, begin), np.searchsorted(words, end)
    opens = np.append(True, (rows[1:] != rows[:-1]) | (before[1:] > through[:-1]))
    i = np.flatnonzero(opens)
    j = np.append(i[1:], len(rows)) - 1
    row, begin, end = rows[i], begin[i], end[j]
    upto = np.minimum(end + 1, offsets[row + 1])
    edges = np.zeros(len(data) + 1, np.int8)
    edges[begin] += 1
    edges[upto] -= 1
    left = data[np.cumsum(edges[:-1], dtype=np.int8) == 0]
    gone = np.append(0, np.cumsum(upto - begin))
    return left, offsets - gone[np.searchsorted(row, np.arange(len(offsets)))], row, place[begin] - base[row], place[end] - base[row], through[j] - before[i]


def cleaned(text: str, cuts: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]], int, int]:
    """``cut`` for one text and at least one unit: remaining text, removed spans, words removed, words of the longest span."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    start, end = np.array(sorted(cuts)).T
    left, _, _, start, end, words = cut(data, np.array([0, len(data)]), np.zeros(len(cuts), np.int64), start, end)
    return left.tobytes().decode("utf-8", "surrogatepass"), list(zip(start.tolist(), end.tolist())), int(words.sum()), int(words.max())


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per document: doc_id, text without its repeated units, spans ('start-end' in the original text, by blanks), removed_units,
    removed_words, longest (words of the longest removed span), predicted (1 if that is a passage, of ``passage_words`` words or more)."""
    # start and length: a long's hash is the xor of its halves, which of start and end is the same for most units
    place = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end") - F.col("start")
    removed = removed_units(docs, min_words).select("doc_id", "name", place.alias("place"))
    cuts = removed.groupBy("doc_id", "name").agg(F.collect_set("place").alias("cuts")).withColumnsRenamed({"doc_id": "own", "name": "own_name"})
    rows = named(docs).join(cuts, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("name") == F.col("own_name")), "left").select("doc_id", "text", "cuts")

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = byte_buffer(b.column(1))
            units = pc.list_value_length(b.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            places, owner = b.column(2).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(b.num_rows), units)
            order = np.lexsort((places, owner))
            places, owner = places[order], owner[order]
            for lo, hi in slices(offsets):
                one, end = np.searchsorted(owner, (lo, hi))
                place = places[one:end]
                left, offs, row, i, j, words = cut(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], owner[one:end] - lo, place >> 32, (place >> 32) + (place & 0xFFFFFFFF))
                spans = pc.binary_join_element_wise(*(pa.array(x).cast(pa.string()) for x in (i, j)), "-")
                by_row = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32()), spans)
                total, longest = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                np.add.at(total, row, words)
                np.maximum.at(longest, row, words)
                doc, given = (b.column(c).slice(lo, hi - lo) for c in (0, 1))
                valid = pa.py_buffer(np.packbits(given.is_valid().to_numpy(zero_copy_only=False), bitorder="little")) if given.null_count else None
                text = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(left)), valid)
                yield pa.RecordBatch.from_arrays([doc, text, pc.binary_join(by_row, " "), *(pa.array(c) for c in (units[lo:hi], total, longest))], names=["doc_id", "text", "spans", "removed_units", "removed_words", "longest"])

    out = rows.mapInArrow(run, "doc_id long, text string, spans string, removed_units long, removed_words long, longest long")
    return out.withColumn("predicted", (F.col("longest") >= passage_words).cast("int"))
