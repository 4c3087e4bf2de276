"""Exact top-k inner products by block-at-a-time pruning.

A vector's terms are its dimensions with their integer weights floor(256 x). Vectors are ordered by a sign code of a few random
projections and id, and cut to ranges of about RANGE_ROWS; a range is stored as blocks (document ranges) with, per
block, the largest and smallest weight of each term, and a forward index (the dense weights). A query bounds a block by the sum over its
terms of weight times the term's extreme; it visits blocks by falling bound and scores them through the forward
index until the next bound lies below its k-th score (equal bounds are visited, for ties). A first
pass over each query's own range gives thresholds with which every other range starts.

Chunks of queries first meet the extremes of the ranges, EXTREMES ranges to a row, and only queries whose bound reaches their threshold
travel on to a range's vectors; what leaves a range is k rows per query at most.

Defined cases: null vectors and vectors that hold null or non-finite components take no part; shorter vectors count as padded with zero weights;
fewer than k other vectors give as many rows as there are; ties go to the smaller id; a
repeated id is a row of its own and only rows with the query's id are left out; null ids take no part; extra columns are
ignored; empty tables give an empty result. Scores are exact in 64-bit integers; beyond that the job stops with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered_offsets, staged

K, EVERY, SCALE = 5, 50, 256
RANGE_ROWS, BLOCK_ROWS, CHUNK_ROWS = 4096, 128, 256
#: Ranges whose extremes stand in one row.
EXTREMES = 256
_DDL = "query_id long, vec_id long, score long"


def sign_code(weights: np.ndarray, bits: int = 10) -> np.ndarray:
    """Signs of random projections: near vectors share blocks, which tightens bounds."""
    plane = np.random.default_rng(7).standard_normal((weights.shape[1], bits)) if weights.size else np.zeros((weights.shape[1], bits))
    return ((weights @ plane > 0) << np.arange(bits)).sum(1) if len(weights) else np.zeros(0, np.int64)


def integer_weights(column) -> np.ndarray:
    """Rows of floor(SCALE * x) as float64 integers (null rows have been dropped; shorter ones are padded)."""
    import pyarrow.compute as pc

    length = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    out = np.zeros((len(column), int(length.max(initial=0))))
    row = np.repeat(np.arange(len(column)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, weights as bytes (float64), code."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            w = integer_weights(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in w], pa.binary()), pa.array(sign_code(w), pa.int64())], names=["vec_id", "w", "code"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, w binary, code long")


def gather(raws: list[bytes]) -> np.ndarray:
    """A matrix of byte rows, padded to the longest."""
    wide = max(map(len, raws), default=0)
    return np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in raws), np.float64).reshape(len(raws), wide // 8)


def side_by_side(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: ids, weights and floors of its rows as bytes, in order of id."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["vec_id", "floor"])
        w = gather(list(pdf["w"]))
        ids, floors = pdf["vec_id"].to_numpy(np.int64), pdf["floor"].to_numpy(float)
        return pd.DataFrame([(pdf[key].iloc[0], ids.tobytes(), w.tobytes(), w.shape[1], floors.tobytes())], columns=["key", "ids", "w", "dims", "floors"])

    return rows.select(key, "vec_id", "w", "floor").groupBy(key).applyInPandas(run, "key long, ids binary, w binary, dims long, floors binary")


def ball(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of groups of vectors."""
    with np.errstate(over="ignore", invalid="ignore"):
        centres = np.stack([p.mean(0) for p in parts])
        return centres, np.array([np.sqrt(((p - c) ** 2).sum(1).max()) for p, c in zip(parts, centres)])


def ball_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with balls; the margin covers rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((q * q).sum(1))
        bound = q @ centres.T + np.outer(size, radii) + 1 + 1e-9 * np.outer(size, np.sqrt((centres * centres).sum(1)) + radii)
    return np.where(np.isnan(bound), np.inf, bound)  # values beyond the range of squares bound nothing


def block_search(ids: np.ndarray, w: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, block: int = BLOCK_ROWS, scored: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of the k best of a range for each query, above or at its floor.

    A block's bound is the lesser of the sum of its terms' extremes and of its ball's (centre and radius). ``scored`` takes the number
    of blocks that each query scored.
    """
    d = max(w.shape[1], q.shape[1])
    w = np.pad(w, ((0, 0), (0, d - w.shape[1])))
    q = np.pad(q, ((0, 0), (0, d - q.shape[1])))
    if len(w) and len(q) and np.abs(w).max(initial=0) * np.abs(q).max(initial=0) * max(d, 1) >= 2.0**52:
        w, q = w.astype(object), q.astype(object)
        w, q = np.vectorize(int, otypes=[object])(w), np.vectorize(int, otypes=[object])(q)
    edges = list(range(0, len(w), block))
    high = np.stack([w[i : i + block].max(0) for i in edges])
    low = np.stack([w[i : i + block].min(0) for i in edges])
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bounds = up @ high.T + down @ low.T
    if w.dtype != object:
        bounds = np.minimum(bounds, ball_bounds(q, *ball([w[i : i + block] for i in edges])))
    out = []
    for j in range(len(q)):
        best_s, best_i, least, seen = [], [], floor[j], 0
        for b in np.argsort(-bounds[j], kind="stable"):
            if bounds[j, b] < least:
                break
            seen += 1
            at = slice(edges[b], edges[b] + block)
            scores, own = w[at] @ q[j], ids[at]
            keep = (scores >= least) & (own != q_ids[j])
            best_s, best_i = [*best_s, *scores[keep].tolist()], [*best_i, *own[keep].tolist()]
            if len(best_s) >= k:
                best = sorted(zip([-s for s in best_s], best_i))[:k]
                best_s, best_i = [-s for s, _ in best], [i for _, i in best]
                least = max(least, best_s[-1])
        out += [(int(q_ids[j]), int(i), int(s)) for s, i in zip(best_s, best_i)]
        if scored is not None:
            scored.append(seen)
    return out


def search(pairs: DataFrame, k: int) -> DataFrame:
    """Rows of (range ids, w, dims; query ids, w, dims, floors) to (query_id, vec_id, score)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for ids, w, dims, q_ids, q, q_dims, floors in zip(*b.columns):
                i, qi = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(q_ids.as_py(), np.int64)
                rows = block_search(
                    i, np.frombuffer(w.as_py(), np.float64).reshape(len(i), dims.as_py()),
                    qi, np.frombuffer(q.as_py(), np.float64).reshape(len(qi), q_dims.as_py()), k, np.frombuffer(floors.as_py(), np.float64),
                )
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, _DDL)


def extremes(ranges: DataFrame, each: int) -> DataFrame:
    """block, keys, dims, high, low, mid, radii: the largest and smallest weights and the ball of each range, ``each`` ranges to a row."""

    def one(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for key, ids, w, dims in zip(*(c.to_pylist() for c in b.columns)):
                m = np.frombuffer(w, np.float64).reshape(len(ids) // 8, dims)
                mid, radius = ball([m])
                out.append((key // each, key, m.max(0).tobytes(), m.min(0).tobytes(), mid[0].tobytes(), float(radius[0])))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["block", "key", "high", "low", "mid", "radius"])

    def side(pdf):
        import pandas as pd

        pdf = pdf.sort_values("key")
        high, low, mid = (gather(list(pdf[c])) for c in ("high", "low", "mid"))
        radii = pdf["radius"].to_numpy(np.float64).tobytes()
        return pd.DataFrame([(pdf["block"].iloc[0], pdf["key"].to_numpy(np.int64).tobytes(), high.shape[1], high.tobytes(), low.tobytes(), mid.tobytes(), radii)], columns=["block", "keys", "width", "high", "low", "mid", "radii"])

    rows = ranges.select("key", "ids", "w", "dims").mapInArrow(one, "block long, key long, high binary, low binary, mid binary, radius double")
    return rows.groupBy("block").applyInPandas(side, "block long, keys binary, width long, high binary, low binary, mid binary, radii binary")


def promising(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """to, ids, w, dims, floors: for each range the queries of a chunk whose bound there reaches their floor."""
    blocks = ends.count()
    spread = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks - 1, 0)).cast("long"))))
    met_ends = spread.join(ends, "block").select("ids", "w", "dims", "floors", "keys", "width", "high", "low", "mid", "radii")

    def run(batches) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
        for b in batches:
            for ids, w, dims, floors, keys, width, high, low, mid, radii in zip(*(c.to_pylist() for c in b.columns)):
                ids, floors, keys = np.frombuffer(ids, np.int64), np.frombuffer(floors, np.float64), np.frombuffer(keys, np.int64)
                q = np.frombuffer(w, np.float64).reshape(len(ids), dims)
                high, low, mid = (np.frombuffer(x, np.float64).reshape(len(keys), width) for x in (high, low, mid))
                d = min(dims, width)  # weights beyond the shorter side are zero there
                bound = np.maximum(q[:, :d], 0) @ high[:, :d].T + np.minimum(q[:, :d], 0) @ low[:, :d].T
                full = np.zeros((len(q), max(dims, width)))
                full[:, :dims] = q
                bound = np.minimum(bound, ball_bounds(full, np.pad(mid, ((0, 0), (0, full.shape[1] - width))), np.frombuffer(radii, np.float64)))
                reach = bound + 1 + 1e-9 * np.abs(bound) >= floors[:, None]
                out = [(int(keys[k]), ids[on].tobytes(), q[on].tobytes(), dims, floors[on].tobytes()) for k in range(len(keys)) if (on := reach[:, k]).any()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["to", "ids", "w", "dims", "floors"])

    return met_ends.mapInArrow(run, "to long, ids binary, w binary, dims long, floors binary")


def best_k(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, range_rows: int = RANGE_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every vector whose id is divisible by ``every``."""
    base = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    rows = coded(base).withColumn("one", F.lit(1).cast("long")).withColumn("tie", F.xxhash64("w"))
    placed = ordered_offsets(rows, ["code", "vec_id", "tie"], "one", "at")
    placed = staged(placed.withColumn("range", F.floor(F.col("at") / range_rows)).select("vec_id", "w", "range", "at"))
    none = F.lit(float("-inf"))
    ranges = staged(side_by_side(placed.withColumn("floor", none), "range"))
    asked = placed.where(F.col("vec_id") % every == 0)
    own = side_by_side(asked.withColumn("floor", none), "range")
    home = staged(search(met(ranges, own, ranges["key"] == own["key"]), k))
    floor = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
    again = asked.join(floor, asked["vec_id"] == floor["query_id"], "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least")).otherwise(none))
    chunks = staged(side_by_side(again.withColumn("chunk", F.floor(F.col("at") / (chunk_rows * every))), "chunk"))
    aimed = promising(chunks, staged(extremes(ranges, EXTREMES)))
    found = search(met(ranges, aimed, ranges["key"] == aimed["to"]), k)
    return best_k(found, k).select("query_id", "rank", "vec_id", "score")


def met(ranges: DataFrame, queries: DataFrame, on: Column) -> DataFrame:
    return ranges.join(queries, on).select(ranges["ids"], ranges["w"], ranges["dims"], queries["ids"].alias("q_ids"), queries["w"].alias("q"), queries["dims"].alias("q_dims"), queries["floors"])
