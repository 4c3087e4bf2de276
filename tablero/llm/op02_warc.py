"""WARC: a deterministic sharded writer, and a reader.

Records are ordered by page_id. Exact running sums of payload bytes deal them to shards (contiguous id ranges of about
equal bytes), so file contents depend on the pages alone, not on partitions or attempts. A task
streams its shards in order, compresses record by record, and rolls to the next file of the shard once
the compressed size passes a limit. Headers and digests are made anew. Each file is written under
a temporary name and moved to its final one when complete; a second attempt makes the same bytes. The manifest (a table of
files with sizes, counts and SHA-1s) is written last, by Spark's committed write, and readers open only what it lists.

Of equal payloads the record with the largest page_id is a response, the others are revisits of it. Payloads under
``least`` bytes are always responses.

Defined cases: null html is an empty payload; null url is an empty target URI; rows with a null page_id come last and are
responses of their own unless a page with an id has their payload; of rows with the same page_id and payload the
first by url is the response if that id is the largest, and the others revisit it; extra columns are ignored; an
empty table gives a manifest without files and an empty result. Rows of one page_id stay in one shard.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ordered_offsets, shared_dir, shuffle_partitions, staged

ROLL_BYTES = 64 << 20
SHARD_BYTES = 512 << 20
LEAST_SHARDS = 64
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{copy}>"


def warc_record(page_id: int | None, copy: int, url: str, payload: bytes, refers: int | None, refers_copy: int, revisit: bool) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP header block and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = url.replace("\r", "%0D").replace("\n", "%0A").strip()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, refers_copy)}"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time stamp or name: equal data give equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class ShardFiles:
    """The rolled files of one shard: written under temporary names, moved when complete."""

    def __init__(self, store, root: str, shard: int, roll: int) -> None:
        self.store, self.root, self.shard, self.roll = store, root, shard, roll
        self.no, self.out, self.done = -1, None, []

    def write(self, record: bytes) -> None:
        if self.out is None:
            self.no += 1
            self.name = f"part-{self.shard:06d}-{self.no:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.count, self.sha = self.store.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha1()
            self._put(gzip_member(warcinfo(self.name)))
        self._put(gzip_member(record))
        self.count += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.shard, self.name, self.size, self.count, self.sha.hexdigest()))
            self.out = None


def warcinfo(name: str) -> bytes:
    body = b"software: tablero\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def in_shards(batches, bounds: list[tuple[int, int | None]]) -> Iterator:
    """Prefix each row with the shard that its page_id falls into; null ids go to the last one."""
    import numpy as np
    import pyarrow as pa

    shards = np.array([s for s, _ in bounds] or [0])
    lows = np.array([x for _, x in bounds if x is not None], np.int64)
    for b in batches:
        ids = b.column(0)
        at = np.searchsorted(lows, ids.fill_null(0).to_numpy(zero_copy_only=False), "right") - 1
        at = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(shards) - 1, np.maximum(at, 0))
        yield pa.RecordBatch.from_arrays([pa.array(shards[at], pa.int64()), *b.columns], names=["shard", *b.schema.names])


def write_warc(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Write page_id, url, html to ``folder``; returns the committed manifest: shard, file, bytes, records, sha1."""
    spark = pages.sparkSession
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    meta = staged(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("bytes")))
    sizes = meta.groupBy("page_id").agg(F.sum("bytes").alias("bytes")).withColumn("last", F.col("page_id").isNull())
    # an id takes a place of its own even without payload, so that empty pages spread as well
    sizes = sizes.withColumn("bytes", F.col("bytes") + 1)
    placed = ordered_offsets(sizes, ["last", "page_id"], "bytes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    width = max(1, -(-total // max(least_shards, -(-total // shard_bytes))))
    # the first id of each shard: as many values as there are shards
    firsts = placed.groupBy(F.floor(F.col("start") / width).alias("shard")).agg(F.min("page_id").alias("first")).orderBy("shard").collect()
    bounds = [(r["shard"], r["first"]) for r in firsts]
    # joined on plain keys: adaptive execution can split a payload with very many copies
    best = staged(meta.groupBy("digest").agg(F.max("page_id").alias("best")))
    links = meta.select("page_id", "digest").distinct().join(best, "digest")
    none = lambda kind: F.lit(None).cast(kind)
    small = links.select("page_id", F.unhex("digest").alias("digest"), none("string").alias("url"), none("string").alias("html"), "best")
    large = rows.select("page_id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest"), "url", "html", none("long").alias("best"))
    # html is shuffled once: each (page, payload) meets the row with its largest id inside the shard
    tagged = small.unionByName(large).mapInArrow(lambda batches: in_shards(batches, bounds), "shard long, page_id long, digest binary, url string, html string, best long")
    # a task per shard, none by chance with several
    shards = 1 + max((s for s, _ in bounds), default=0)
    dealt = tagged.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", F.col("url").asc_nulls_first())

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        files, done = None, []
        last, copies, best, first = object(), 0, None, 0
        for b in batches:
            for shard, page, digest, url, html, own in zip(*(c.to_pylist() for c in b.columns)):
                if files is None or files.shard != shard:
                    if files:
                        files.close()
                        done += files.done
                    files = ShardFiles(store, root, shard, roll)
                if page != last:
                    last, copies = page, 0
                if url is None:  # heads the rows of this page and payload
                    best, first = own, copies
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                revisit = len(payload) >= least and best is not None and (page != best or copies != first)
                files.write(warc_record(page, copies, url, payload, best, first if page == best else 0, revisit))
                copies += 1
        if files:
            files.close()
            done += files.done
        cols = list(zip(*done)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "file", "bytes", "records", "sha1"])

    dealt.mapInArrow(run, "shard long, file string, bytes long, records long, sha1 string").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def parse_member(data: bytes) -> tuple | None:
    """page_id, payload bytes, digest, type, refers_to of a response or revisit record; other records give None."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    page = lambda urn: None if (x := urn.strip("<>").split(":")[2]) == "none" else int(x)
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged block {fields['WARC-Record-ID']}")
    return page(fields["WARC-Record-ID"]), length, digest, kind, page(fields["WARC-Refers-To"]) if kind == "revisit" else None


def members(stream, each: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, held = zlib.decompressobj(31), []
    while data := stream.read(each):
        while data:
            held.append(unpack.decompress(data))
            if not unpack.eof:
                break
            yield b"".join(held)
            data, unpack, held = unpack.unused_data, zlib.decompressobj(31), []
    if any(held):
        raise ValueError("truncated gzip member")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """The page records of all files that the manifest lists, with digests checked."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows = []
                    for m in members(f):
                        if r := parse_member(m):
                            rows.append(r)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)

    spark: SparkSession = manifest.sparkSession
    files = manifest.select("file").repartition(shuffle_partitions(spark), "file")
    return files.mapInArrow(run, RECORDS_DDL)


_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read the archives back."""
    folder = shared_dir(pages.sparkSession)
    return read_warc(write_warc(pages, folder), folder)
