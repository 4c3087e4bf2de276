"""N-gram Jaccard join with prefix filters under several global token orders.

A text's set: the hashes of its distinct word shingles. Equal sets are one node. Every order puts
shingles of rare sketch cells first (a fixed-size count sketch over all documents gives the
rarity) and breaks ties by another hash; sets that reach the threshold share a token of their prefixes
under each order. Candidates come from the first order's prefixes, must share prefix tokens under the
other orders as well, and are then verified on whole sets. A parity sketch, which travels with each posting of a token that
several sets hold, bounds the symmetric difference from below and drops pairs that cannot reach the threshold inside the bucket.

Postings are dealt by ranges of (token, size, set), so a token of very many sets spreads over many tasks. A
bucket is never expanded into all its pairs. First each member meets its neighbour and the first member of its block, all buckets in
the same order, so that a family of near copies tests about the same few pairs a member in every bucket. Where the
sketches allow no other pair the bucket is finished; the postings of the others are kept. Verified links are joined to components, and
of the kept buckets only those of several components are read again, in blocks: pairs across components that sketches allow and
no test has covered, a few per member at first and then all that are left. So no link between different components is
missed and component ids are exact, while a family of very many near copies costs tests in proportion to its postings. In these
rounds the few members that are left bring a finer sketch, which is close to the symmetric difference itself, so that hardly a pair
below the threshold becomes a row. Links found late only join the components known by then.

Defined cases: null or empty text, or text without words, has the empty set and links with nothing; fewer words than a
shingle make one shingle; sets too small to differ and still reach the threshold link only with equal sets; very long
texts are read whole, one slice each; repeated rows are equal sets (a null doc_id never names a component unless all its members
are null); ties of size are ordered by the set's hash; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged
from .graph import components, merged
from .textops import hashed_rows, mix, shingle_hashes

WIDTH, PERCENT = 5, 80
SKETCH_BITS, SKETCH_BLOCK = 20, 4096
ORDERS = 3
FILTER_BITS = 24
#: Bits of the least and the largest parity sketch.
LEAST_CELLS, MOST_CELLS = 6, 11
#: Cells per token that may differ and bits of the largest in the sketch that travels with postings, and in the fine one of the rounds across components.
COARSE, FINE = (5, MOST_CELLS), (40, 13)
#: Members of a bucket that meet in one piece; buckets of up to SMALL members are compared whole at once.
BLOCK, SMALL = 1024, 64
#: Bytes of sketches of pairs, and members of a block, that are compared at once with another block.
PAIR_BYTES, SLAB = 4 << 20, 128
#: Partners of a member in the first round across components.
PARTNERS = 4


def text_sets(column, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every text with words."""
    for lo, _, hashes, rows in hashed_rows(column):
        cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1], True]) if len(rows) else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield lo + int(rows[i]), np.unique(shingle_hashes(hashes[i:j], width))


def signature(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(tokens ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, sig) per text, and per task the non-empty blocks of its count sketch."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n", "sig", "block", "counts"]
        for b in batches:
            n, sig, has = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
            held = []
            for row, tokens in text_sets(b.column(1), width):
                n[row], sig[row], has[row] = len(tokens), signature(tokens), True
                held.append(tokens)
                if len(held) == 2000:
                    counts += cells(held)
                    held = []
            counts += cells(held)
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sig, mask=~has), none, pa.nulls(b.num_rows, pa.binary())], names=names)
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        at = np.flatnonzero(blocks.any(1))
        raw = [zlib.compress(blocks[i].astype("<i8").tobytes(), 1) for i in at]
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(at, pa.int32()), pa.array(raw, pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long, block int, counts binary")


def cells(sets: list[np.ndarray]) -> np.ndarray:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return np.bincount((np.concatenate(sets) & mask).astype(np.int64), minlength=1 << SKETCH_BITS) if sets else np.zeros(1 << SKETCH_BITS, np.int64)


def rarity(sketches: DataFrame) -> np.ndarray:
    """Class of each sketch cell by its count, in eighths of a doubling: one byte per cell, whatever the corpus."""

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in pdf["counts"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.tobytes()]})

    out = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.int64).reshape(-1, SKETCH_BLOCK)
    for r in sketches.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        out[r["block"]] = np.frombuffer(r["counts"], "<i8")
    return np.minimum(8 * np.log2(1 + out.ravel()), 255).astype(np.uint8)


def ordered(tokens: np.ndarray, classes: np.ndarray, order: int, count: int) -> np.ndarray:
    """The first ``count`` tokens under global order number ``order``."""
    rank = classes[(tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
    key = rank | (mix(tokens + np.uint64(order * 0x51ED270B)) >> np.uint64(8))
    return tokens[np.argpartition(key, count - 1)[:count]] if count < len(tokens) else tokens


def prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def least_size(percent: int) -> int:
    """Smallest set that can reach the threshold with a different set."""
    return -(-percent // (100 - percent))


def parity(tokens: np.ndarray, percent: int, each: int = COARSE[0], most: int = COARSE[1]) -> bytes:
    """Parity of the number of tokens in each cell, as bits; about ``each`` cells for each token that may differ at the threshold."""
    bits = (len(tokens) * each * (100 - percent) // 100).bit_length()
    cells_ = 1 << min(max(bits, LEAST_CELLS), most)
    at = (mix(tokens ^ np.uint64(0x7F4A7C15)) & np.uint64(cells_ - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells_) & 1).astype(np.uint8)).tobytes()


def prefixes(docs: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """sig, n, both parity sketches and the prefix under the first order of every set; copies within a task count once."""
    least = least_size(percent)

    def run(batches) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for b in batches:
            tokens, sigs, sizes, bits, fine = [], [], [], [], []
            for _, s in text_sets(b.column(0), width):
                if len(s) < least:
                    continue
                if (name := signature(s)) in seen:
                    continue
                if len(seen) < 1_000_000:  # copies beyond come twice and fold later
                    seen.add(name)
                tokens.append(ordered(s, classes, 0, prefix_length(len(s), percent)).astype(np.int64))
                sigs.append(name)
                sizes.append(len(s))
                bits.append(parity(s, percent))
                fine.append(parity(s, percent, *FINE))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(fine, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], names=["sig", "n", "parity", "fine", "tokens"])

    return docs.select("text").mapInArrow(run, "sig long, n int, parity binary, fine binary, tokens array<long>")


def shared_postings(found: DataFrame, percent: int) -> DataFrame:
    """token, n, sig of the tokens that at least two different sets of near sizes hold (and those at the ends of a partition).

    In order of size a posting has a partner of near size exactly if a neighbour is one.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        held, before = np.zeros((3, 0), np.int64), None  # the last posting, whose successor is not known yet; the one before it

        def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[0] == b[0]) & near_sizes(a[1], b[1], percent)

        def kept(rows: np.ndarray, after: np.ndarray | None) -> pa.RecordBatch:
            nonlocal before
            same = meet(rows[:, 1:], rows[:, :-1])
            keep = np.r_[before is None or meet(before, rows[:, 0]), same] | np.r_[same, after is None or meet(after, rows[:, -1])]
            before = rows[:, -1]
            token, n, sig = rows[:, keep]
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int32)), pa.array(sig)], names=["token", "n", "sig"])

        for b in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])], 1)
            if rows.shape[1]:
                rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)]]  # copies are neighbours
                held = rows[:, -1:]
                if rows.shape[1] > 1:
                    yield kept(rows[:, :-1], held[:, 0])
        if held.shape[1]:
            yield kept(held, None)

    parts = shuffle_partitions(found.sparkSession)
    postings = found.select(F.explode("tokens").alias("token"), "n", "sig")
    return postings.repartitionByRange(parts, "token", "n", "sig").sortWithinPartitions("token", "n", "sig").mapInArrow(run, "token long, n int, sig long")


def near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


class Members:
    """Sizes, names and parity sketches of some sets."""

    def __init__(self, n: np.ndarray, sig: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        self.n, self.sig, self.data, self.offsets = n.astype(np.int64), sig, data, offsets
        self.width = np.diff(offsets)

    @staticmethod
    def of(n, sig, parities) -> "Members":
        """From Arrow columns."""
        offsets = np.frombuffer(parities.buffers()[1], np.int32)[parities.offset : parities.offset + len(parities) + 1].astype(np.int64)
        data = np.frombuffer(parities.buffers()[2], np.uint8) if len(parities) else np.zeros(0, np.uint8)
        return Members(n.to_numpy(zero_copy_only=False), sig.to_numpy(zero_copy_only=False), data, offsets)

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """Sketches of the members ``at``, folded to ``width`` bytes."""
        own, out = self.width[at], np.zeros((len(at), width), np.uint8)
        for size in np.unique(own):
            k = np.flatnonzero(own == size)
            m = self.data[self.offsets[at[k]][:, None] + np.arange(size)]
            out[k] = np.bitwise_xor.reduce(m.reshape(len(k), size // width, width), axis=1)
        return out

    def folded(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of the distinct members of ``at`` as words, and the place of each of ``at`` in them."""
        members, place = np.unique(at, return_inverse=True)
        return self.rows(members, width).view(np.uint64), place

    def possible(self, i: np.ndarray, j: np.ndarray, percent: int, other: "Members | None" = None) -> np.ndarray:
        """Marks of the pairs (member i, member j of ``other``) whose sizes and sketches allow the threshold; at most PAIR_BYTES of sketches are compared at once."""
        other = other or self
        keep = near_sizes(self.n[i], other.n[j], percent)
        width = np.minimum(self.width[i], other.width[j])
        for w in np.unique(width[keep]):
            at = np.flatnonzero(keep & (width == w))
            (own, a), (others, b) = self.folded(i[at], w), other.folded(j[at], w)
            for lo in range(0, len(at), step := max(1, PAIR_BYTES // int(w))):
                k = at[lo : lo + step]
                apart = np.bitwise_count(own[a[lo : lo + step]] ^ others[b[lo : lo + step]]).sum(1, dtype=np.int64)
                keep[k] = apart * (100 + percent) <= (self.n[i[k]] + other.n[j[k]]) * (100 - percent)
        return keep


def pair_batch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, the smaller name first."""
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)


def group_pairs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j) of neighbours and of first member and any later one, in every group of a sorted run; and all other (i, j) of small groups."""
    size = ends - starts
    at, start = np.arange(size.sum()), np.repeat(starts, size)
    i = np.r_[at[at > start] - 1, start[at > start + 1]]
    j = np.r_[at[at > start], at[at > start + 1]]
    other_i, other_j = [], []
    for step in range(2, SMALL):
        k = at[(at - step > start) & np.repeat(size <= SMALL, size)]
        if not len(k):
            break
        other_i.append(k - step)
        other_j.append(k)
    none = np.zeros(0, np.int64)
    return i, j, np.concatenate([none, *other_i]), np.concatenate([none, *other_j])


_BOTH = "a long, b long, token long, n int, sig long, parity binary"


def first_pairs(sketched: DataFrame, percent: int) -> DataFrame:
    """Rows of two kinds: pairs (a, b) to test, and the postings of buckets that other pairs may hide in."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ["a", "b", "token", "n", "sig", "parity"]
        long, first, open_token = pa.int64(), None, None

        def work(t, final: bool):
            """Rows of whole tokens, or whole blocks of the token in ``open_token``."""
            token = t.column(0).to_numpy(zero_copy_only=False)
            m = Members.of(t.column(1), t.column(2), t.column(3))
            run_starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[run_starts, len(token)])
            place = np.arange(len(token)) - np.repeat(run_starts, sizes)
            starts = np.flatnonzero(place % BLOCK == 0)
            ends = np.r_[starts[1:], len(token)]
            i, j, oi, oj = group_pairs(starts, ends)
            ok = m.possible(i, j, percent)
            group = np.repeat(np.arange(len(starts)), ends - starts)
            wanting = ends - starts > SMALL  # not compared whole here
            wanting |= np.repeat(sizes > BLOCK, -(-sizes // BLOCK))
            wanting |= (token[starts] == first) | (token[starts] == open_token)
            if final:
                wanting |= token[starts] == token[-1]
            left = ~wanting[group[oi]]
            wanting[group[oi[left][m.possible(oi[left], oj[left], percent)]]] = True
            pairs = pair_batch(m.sig[i[ok]], m.sig[j[ok]])
            if len(pairs):
                no = pa.nulls(len(pairs), long)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), no, pa.nulls(len(pairs), pa.int32()), no, pa.nulls(len(pairs), pa.binary())], names=names)
            kept = t.filter(pa.array(wanting[group]))
            if kept.num_rows:
                no = pa.nulls(kept.num_rows, long)
                yield pa.RecordBatch.from_arrays([no, no, *kept.columns], names=names)

        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            if not t.num_rows:
                continue
            token = t.column(0).to_numpy()
            first = token[0] if first is None else first
            cut = int(np.searchsorted(token, token[-1], "left"))  # the last token may go on
            if t.num_rows - cut > 4 * BLOCK:
                cut += (t.num_rows - cut) // BLOCK * BLOCK
            if cut:
                whole = t.slice(0, cut).combine_chunks().to_batches()[0]
                yield from work(whole, False)
                open_token = token[cut - 1]
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks().to_batches()[0], True)

    return sketched.mapInArrow(run, _BOTH)


_BLOCKS = "token long, block long, alone boolean, low long, high long, least int, most int, n binary, sig binary, component binary, parity binary, offsets binary"


def blocked(rows: DataFrame) -> DataFrame:
    """token, n, sig, parity, component, dealt by ranges, packed to blocks of at most BLOCK members of one token; ``alone``: surely its token's only block."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("token", pa.int64()), ("block", pa.int64()), ("alone", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), *((c, pa.binary()) for c in ("n", "sig", "component", "parity", "offsets"))])
        block = TaskContext.get().partitionId() << 40
        for b in batches:
            token, component = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 4))
            m = Members.of(b.column(1), b.column(2), b.column(3))
            runs = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            place = np.arange(len(token)) - np.repeat(runs, np.diff(np.r_[runs, len(token)]))
            starts = np.flatnonzero(place % BLOCK == 0)
            out = []
            for i, j in zip(starts, np.r_[starts[1:], len(token)]):
                n, c, lo = m.n[i:j], component[i:j], m.offsets[i]
                alone = 0 < i and j < len(token) and token[i - 1] != token[i] and token[j] != token[i]
                out.append((token[i], block, alone, c.min(), c.max(), n.min(), n.max(), n.tobytes(), m.sig[i:j].tobytes(), c.tobytes(), m.data[lo : m.offsets[j]].tobytes(), (m.offsets[i : j + 1] - lo).tobytes()))
                block += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartitionByRange(parts, "token", "component", "n", "sig").sortWithinPartitions("token", "component", "n", "sig").mapInArrow(run, _BLOCKS)


def cross_pairs(blocks: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs of sets of different components in the blocks of one token that sizes and sketches allow, at most ``most`` a member.

    A block meets itself where it lies. Of tokens with several blocks these meet by number first, those of one and the same component or of
    far sizes not at all; then their contents are joined.
    """
    columns = ("n", "sig", "component", "parity", "offsets")
    own = blocks.where("low < high").select(*columns)
    several = blocks.where("NOT alone")
    near = several.select("token", "block", "low", "high", "least", "most")
    a, b = near.alias("a"), near.alias("b")
    apart = ~((F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high")) & (F.col("a.low") == F.col("b.low")))
    sizes = (F.col("a.most") * 100 >= F.col("b.least") * percent) & (F.col("b.most") * 100 >= F.col("a.least") * percent)
    meet = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.block") < F.col("b.block")) & apart & sizes).select(F.col("a.block").alias("block"), F.col("b.block").alias("other"))
    left = several.select("block", *(F.col(c).alias(f"{c}_a") for c in columns))
    right = several.select(F.col("block").alias("other"), *(F.col(c).alias(f"{c}_b") for c in columns))
    rows = meet.join(left, "block").join(right, "other").select(*(f"{c}_{s}" for s in "ab" for c in columns))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for row in range(batch.num_rows):  # the content of a block, or of two
                na, sa, ca, pa_, oa, *second = (np.frombuffer(c[row].as_buffer(), np.uint8 if k % 5 == 3 else np.int64) for k, c in enumerate(batch.columns))
                nb, sb, cb, pb, ob = second or (na, sa, ca, pa_, oa)
                m, o = Members(na, sa, pa_, oa), Members(nb, sb, pb, ob)
                for lo in range(0, len(sa), SLAB):
                    i, j = np.nonzero(ca[lo : lo + SLAB, None] != cb[None, :])
                    i += lo
                    if not second:
                        i, j = i[i < j], j[i < j]
                    ok = m.possible(i, j, percent, o)
                    i, j = i[ok], j[ok]
                    if most is not None and len(i):
                        i, j = i[(few := np.arange(len(i)) - np.searchsorted(i, i) < most)], j[few]
                    if len(i):
                        found.append(pair_batch(sa[i], sb[j]))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return own.mapInArrow(run, "a long, b long").unionByName(rows.mapInArrow(run, "a long, b long"))


HEADS = [f"head{k}" for k in range(1, ORDERS)]


def _bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """2**FILTER_BITS bits (2 MB), of which those of the column's hashed values are set."""
    marked = rows.select(_bit(column).alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    table = np.zeros(1 << FILTER_BITS, np.uint8)
    for r in marked.collect():  # bit k of bucket b, counted from 1, stands for (b - 1) * 32768 + k
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        table[(r["no"] - 1) * 32768 :][: len(bits)] = bits
    return np.packbits(table)


def fine_sketches(found: DataFrame, members: DataFrame) -> DataFrame:
    """sig, fine sketch of the sets of ``members``, each once; a bitmap keeps most others out of the shuffle."""
    packed = bitmap(members, "sig")

    def run(batches) -> Iterator:
        import pyarrow as pa

        wanted = np.unpackbits(packed).astype(bool)
        for b in batches:
            yield b.filter(pa.array(wanted[b.column(2).to_numpy(zero_copy_only=False)])).select(["sig", "parity"])

    few = found.select("sig", F.col("fine").alias("parity"), _bit("sig").alias("bit")).mapInArrow(run, "sig long, parity binary")
    return few.join(members.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"])


def whole_sets(docs: DataFrame, reps: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """sig, n, tokens, prefixes under the other orders (32 bits a token, as they only filter) of the documents named in ``reps`` (and of a few more).

    A bitmap of their hashed ids keeps most others from being read into sets.
    """
    packed = bitmap(reps, "rep")

    def run(batches) -> Iterator:
        import pyarrow as pa

        wanted = np.unpackbits(packed).astype(bool)
        for whole in batches:
            whole = whole.filter(pa.array(wanted[whole.column(1).to_numpy(zero_copy_only=False)]))
            for at in range(0, whole.num_rows, 256):
                sets = [s for _, s in text_sets(whole.slice(at, 256).column(0), width)]
                heads = [pa.array([(ordered(s, classes, k, prefix_length(len(s), percent)) >> np.uint64(33)).astype(np.int32) for s in sets], pa.list_(pa.int32())) for k in range(1, ORDERS)]
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())), *heads], names=["sig", "n", "tokens", *HEADS])

    return docs.select("text", _bit("doc_id").alias("bit")).mapInArrow(run, "sig long, n long, tokens array<long>, " + ", ".join(f"{h} array<int>" for h in HEADS))


def _sides(sets: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    a, b = (sets.select(F.col("sig").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "ab")
    return a, b


def sharing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that share a prefix token under every other order."""
    for h in HEADS:
        a, b = _sides(sets, [h])
        pairs = pairs.join(a, "a").join(b, "b").where(F.arrays_overlap(f"{h}_a", f"{h}_b")).select("a", "b")
    return pairs


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    a, b = _sides(sets, ["n", "tokens"])
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(a, "a").join(b, "b").where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    parts = shuffle_partitions(docs.sparkSession)
    rows = staged(signed(docs, width))
    texts = rows.where("block is null").select("doc_id", "n", "sig")
    classes = rarity(rows.where("block is not null").select("block", "counts"))
    reps = staged(texts.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")))
    found = staged(prefixes(docs, classes, width, percent))
    shared = staged(shared_postings(found, percent))

    # sketches travel with the postings, so that hopeless pairs never become rows
    sketched = shared.join(found.select("sig", "parity").dropDuplicates(["sig"]), "sig").select("token", "n", "sig", "parity")
    dealt = sketched.repartitionByRange(parts, "token", "n", "sig").sortWithinPartitions("token", "n", "sig")
    both = staged(first_pairs(dealt, percent))
    kept = both.where("token is not null").select("token", "n", "sig", "parity")
    tested = staged(both.where("a is not null").select("a", "b").distinct())

    def links_of(pairs: DataFrame) -> DataFrame:
        # only the sets of these pairs are read and shuffled, not those of rounds before
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        sets = staged(whole_sets(docs, ends.join(reps, "sig"), classes, width, percent))
        return staged(verified(sharing(pairs, sets), sets, percent).distinct())

    joined = components(links_of(tested)).withColumnRenamed("node", "sig")
    fine = None
    for most in (PARTNERS, None):
        named = kept.join(joined, "sig", "left").select("token", "n", "sig", F.coalesce("component", "sig").alias("component"))
        mixed = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
        members = staged(named.join(mixed, "token").select("token", "n", "sig", "component"))
        if fine is None:  # buckets of several components only get fewer, so the second round needs no other sets
            fine = staged(fine_sketches(found, members))
        blocks = staged(blocked(members.join(fine, "sig").select("token", "n", "sig", "parity", "component")))
        rest = staged(cross_pairs(blocks, percent, most).distinct().join(tested, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            break
        joined, tested = merged(joined.withColumnRenamed("sig", "node"), links_of(rest)).withColumnRenamed("node", "sig"), tested.unionByName(rest)

    named_sets = reps.join(joined, "sig", "left").select("sig", "rep", F.coalesce("component", "sig").alias("component"))
    smallest = named_sets.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = staged(named_sets.join(smallest, "component").select("sig", "component_id"))
    # both sides are dealt plainly by sig, so a set of very many copies can be split
    return texts.join(ids, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
