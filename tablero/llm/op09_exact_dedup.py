"""Exact deduplication by Grace hashing.

Texts are equal when identical after deleting white space. Each input task first folds equal texts it
has at hand (so a huge group of copies becomes one record per task), records are then dealt by hash,
and every bucket is partitioned recursively to spill files until a part fits an open-addressing
table that compares whole contents. The table is a flat slot array with linear probing.

Defined cases: null text counts as empty, and all empty texts are equal; a repeated doc_id is a row like
any other (ties of length go to the smallest doc_id, a null doc_id last); extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, staged

#: Bytes of content that one table may hold; beyond it a task flushes (input side) or spills (bucket side).
TABLE_BYTES = 64 << 20
FAN_OUT = 16
#: Stands for a null id in Python: above every id.
NO_ID = 2**63

SPACES = " \t\n\x0b\x0c\r"
_DELETE = str.maketrans("", "", SPACES)

#: (digest, content, best length, best id, members)
Record = tuple[bytes, bytes, int, int, int]


class Table:
    """Open addressing: slots hold record numbers; a probe compares the digest's head and then whole contents."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 64
        self.rows: list[list] = []
        self.bytes = 0

    def _find(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (k := self.slots[at]) >= 0:
            row = self.rows[k]
            if row[0] == digest and row[1] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, record: Record) -> None:
        digest, content, length, doc, members = record
        at = self._find(digest, content)
        if (k := self.slots[at]) >= 0:
            row = self.rows[k]
            row[4] += members
            if (-length, doc) < (-row[2], row[3]):
                row[2], row[3] = length, doc
            return
        self.slots[at] = len(self.rows)
        self.rows.append([digest, content, length, doc, members])
        self.bytes += len(content) + 64
        if 2 * len(self.rows) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for k, row in enumerate(self.rows):
                self.slots[self._find(row[0], row[1])] = k

    def pop_all(self) -> list[Record]:
        rows, self.rows, self.slots, self.bytes = self.rows, [], [-1] * 64, 0
        return [tuple(r) for r in rows]


def grace(records: Iterable[Record], folder: str, most: int = TABLE_BYTES, depth: int = 0) -> Iterator[Record]:
    """Fold equal contents of a stream of any length in bounded memory, through spill files in ``folder``.

    A part that is full goes to FAN_OUT files by the next 4 bits of the digest. Copies of one content fold in
    the table before it spills, so a part only grows with different contents.
    """
    import pickle

    from pyarrow import fs

    table, files, names, store = Table(), [], [], None
    level = lambda digest: (digest[depth // 2 % 32] >> (4 * (depth % 2))) % FAN_OUT

    def spill() -> None:
        for r in table.pop_all():
            raw = pickle.dumps(r, 5)
            files[level(r[0])].write(len(raw).to_bytes(8, "little") + raw)

    for record in records:
        table.add(record)
        if table.bytes > most and len(table.rows) > 1:
            if not files:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                names = [f"{root}/{uuid.uuid4().hex}" for _ in range(FAN_OUT)]
                files = [store.open_output_stream(n, compression=None) for n in names]
            spill()
    if not files:
        yield from table.pop_all()
        return
    spill()
    for f in files:
        f.close()

    def reread(name: str) -> Iterator[Record]:
        with store.open_input_stream(name, compression=None) as f:
            while head := f.read(8):
                yield pickle.loads(f.read(int.from_bytes(head, "little")))

    for name in names:
        # 64 levels use up the digest: what is left then differs in content only, and one table takes it
        yield from grace(reread(name), folder, most if depth < 63 else 1 << 62, depth + 1)
        store.delete_file(name)


def _batches(rows: Iterable[Record], schema, each: int = 512, most: int = 16 << 20) -> Iterator:
    import pyarrow as pa

    def batch(held: list) -> pa.RecordBatch:
        columns = list(zip(*held))
        columns[3] = [None if x == NO_ID else x for x in columns[3]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names=_NAMES)

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[1])
        if len(held) >= each or size >= most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


_NAMES = ["digest", "content", "best_len", "best_id", "members"]
_DDL = "digest binary, content binary, best_len long, best_id long, members long"


def _types() -> list:
    import pyarrow as pa

    return [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def fold_input(most: int) -> Callable:
    def run(batches):
        table = Table()

        def rows():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    text = text or ""
                    content = text.translate(_DELETE).encode("utf-8", "surrogatepass")
                    doc = NO_ID if doc is None else doc
                    table.add((hashlib.sha256(content).digest(), content, len(text), doc, 1))
                    if table.bytes > most:
                        yield from table.pop_all()
            yield from table.pop_all()

        yield from _batches(rows(), _types())

    return run


def fold_buckets(folder: str, most: int) -> Callable:
    def run(batches):
        def rows():
            for b in batches:
                columns = [c.to_pylist() for c in b.columns]
                columns[3] = [NO_ID if x is None else x for x in columns[3]]
                yield from zip(*columns)

        yield from _batches(((r[0], b"", *r[2:]) for r in grace(rows(), folder, most)), _types())

    return run


def normalised(text):
    """The text without white space, as a column (null counts as empty)."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_groups(docs: DataFrame, most: int = TABLE_BYTES) -> DataFrame:
    """One row per different normalised text: text_sha256, keep_id, group_size."""
    spark = docs.sparkSession
    folded = docs.select("doc_id", "text").mapInArrow(fold_input(most), _DDL)
    dealt = folded.repartition(shuffle_partitions(spark), "digest")
    found = dealt.mapInArrow(fold_buckets(shared_dir(spark), most), _DDL)
    return found.select(
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("best_id").alias("keep_id"),
        F.col("members").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, most: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text, ...)."""
    groups = staged(exact_groups(docs, most))
    members = docs.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    # both sides are dealt plainly by the digest, so adaptive execution splits a group of very many copies
    return members.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
