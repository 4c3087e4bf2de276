"""Packing along a space-filling curve.

A document's hashed bag of token ids is projected to DIMS numbers by signs taken from the ids' hashes; the
point's Hilbert key orders the corpus, so that neighbours on the curve share vocabulary. In that
order (range-partitioned, sorted by key and id) the token streams follow one another and are
cut at every ``length`` tokens: only the last sequence can need padding.

Tokenising: white space always ends a token and is dropped by this vocabulary, so ids are remembered per
white-space-free run; runs not seen before go through the tokenizer in batches.

Defined cases: null or empty text is the end id alone; documents with equal keys follow by doc_id (null
first), repeated rows are packed each; very long texts are tokenised in portions; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered_offsets, staged
from .textops import mix

LENGTH = 4096
END_ID = 2
DIMS, BITS = 4, 12
#: Remembered runs per worker process; the memory starts anew beyond it.
MEMORY = 1_000_000
PORTION = 4_000_000
_SPACE = re.compile("[ \n\t\r]")
#: What str.split parts at besides _SPACE.
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n\t\r"]
#: Runs whose characters have no composition and only simple case: printable ASCII and the Latin-1 letters.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Fixed: the vocabulary's own split pattern, for lower-cased runs of that kind.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class RunTokenizer:
    """Ids of texts as little-endian unsigned 16- or 32-bit bytes."""

    _loaded: dict[str, "RunTokenizer"] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges for parts that are split and lower-cased already
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.runs: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "RunTokenizer":
        """One tokenizer per worker process, so that what it remembers serves later tasks too."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        get, cut, missing, gaps = self.runs.get, [], set(), []
        for text in texts:
            streams = []
            for part in portions(text):
                runs = runs_of(part)
                found = list(map(get, runs))
                if None in found:
                    holes = [(i, runs[i]) for i, f in enumerate(found) if f is None]
                    missing.update(r for _, r in holes)
                    gaps.append((found, holes))
                streams.append(found)
            cut.append(streams)
        self.learn(list(missing))
        known, tail = self.runs, np.array([end], self.kind).tobytes()
        for found, holes in gaps:
            for i, r in holes:
                found[i] = known[r]
        out = [b"".join([*map(b"".join, streams), tail]) for streams in cut]
        if len(self.runs) > MEMORY:
            self.runs = {"": b""}
        if len(self.parts) > MEMORY:
            self.parts = {}
        return out

    def learn(self, new: list[str]) -> None:
        """Runs of plain Latin letters share the ids of their lower-cased parts; other runs are asked for whole."""
        split, odd, parts = {}, [], self.parts
        for run in new:
            if _PLAIN.fullmatch(run) and "<|" not in run:
                split[run] = _PARTS.findall(run.lower())
            else:
                odd.append(run)
        ask = list({p for found in split.values() for p in found if p not in parts})
        for at in range(0, len(ask), 8192):
            some = ask[at : at + 8192]
            found = self.plain.encode_batch_fast([" ".join(some[i : i + 64]) for i in range(0, len(some), 64)], add_special_tokens=False)
            ids = np.array([i for f in found for i in f.ids], self.kind)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize  # the last id of a part carries the word end
            if len(cuts) != len(some):
                raise ValueError("the vocabulary does not mark word ends")
            raw, low = ids.tobytes(), 0
            for p, high in zip(some, cuts.tolist()):
                parts[p] = raw[low:high]
                low = high
        for run, found in split.items():
            self.runs[run] = parts[found[0]] if len(found) == 1 else b"".join([parts[p] for p in found])
        for run, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.runs[run] = np.array(found.ids, self.kind).tobytes()


def runs_of(text: str) -> list[str]:
    """The runs between blanks and line ends; rarer white space is left to the tokenizer inside a run."""
    return _SPACE.sub(" ", text).split(" ") if any(c in text for c in _RARE) else text.split()


def portions(text: str) -> Iterator[str]:
    """The text in parts of about PORTION characters, cut at white space."""
    at = 0
    while len(text) - at > PORTION:
        m = _SPACE.search(text, at + PORTION)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n x d, each below 2**bits), by Skilling's transpose method."""
    x = points.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[:, i] & q) > 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] = x[:, i] ^ t
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _signs() -> np.ndarray:
    ids = mix(np.arange(1 << 16, dtype=np.uint64))
    return np.stack([((ids >> np.uint64(k)) & np.uint64(1)).astype(np.float32) * 2 - 1 for k in range(DIMS)], 1)


def curve_keys(ids: list[bytes], kind: np.dtype) -> np.ndarray:
    """Hilbert key of each document's hashed bag of ids, projected to DIMS mean signs."""
    mean = np.zeros((len(ids), DIMS))
    for i, raw in enumerate(ids):
        mean[i] = SIGNS[np.frombuffer(raw, kind) & 0xFFFF].mean(0)
    grid = (0.5 + 0.5 * np.tanh(4 * mean)) * ((1 << BITS) - 1)
    return hilbert_keys(grid.astype(np.int64))


SIGNS = _signs()


def tokenised(docs: DataFrame, vocabulary: str, end: int = END_ID) -> DataFrame:
    """rid (unique once written), doc_id, curve key, number of ids, and the ids as bytes."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        tool, rid = RunTokenizer.at(vocabulary), TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids = tool.encode([t or "" for t in b.column(1).to_pylist()], end)
                n = [len(x) // tool.kind.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + len(n))), b.column(0), pa.array(curve_keys(ids, tool.kind)), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["rid", "doc_id", "key", "n", "ids"],
                )
                rid += len(n)

    return docs.select("doc_id", "text").mapInArrow(run, "rid long, doc_id long, key long, n long, ids binary")


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    vocabulary = vocabulary or default_vocabulary()
    streams = staged(tokenised(docs, vocabulary, end))
    placed = ordered_offsets(streams.select("rid", "doc_id", "key", "n"), ["key", "doc_id", "rid"], "n", "at").select("rid", "at")

    def cut(batches) -> Iterator:
        import pyarrow as pa

        kind = RunTokenizer.at(vocabulary).kind
        for b in batches:
            rows = []
            for doc, n, ids, at in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(ids, kind).astype("<u4")
                start = 0
                while start < n:
                    offset = (at + start) % length
                    size = min(n - start, length - offset)
                    rows.append((doc, start, size, zlib.crc32(ids[start : start + size]), n, (at + start) // length, offset))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=_NAMES)

    # the ids are dealt once, and never sorted: the small side is hashed
    joined = streams.select("rid", "doc_id", "n", "ids").join(placed.hint("shuffle_hash"), "rid").select("doc_id", "n", "ids", "at")
    return joined.mapInArrow(cut, ", ".join(f"{c} long" for c in _NAMES))


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per sequence its filled and padded length (a power of two needs no padding)."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    whole = F.bit_count("filled") == 1
    return filled.withColumn("padded", F.when(whole, F.col("filled")).otherwise(F.lit(length)))
