"""Running values over keys of any size: an associative scan over ranges of rows.

Rows are dealt by ranges of (key, order), so a key with a third of all rows lies in several parts. Inside a part windows run as
usual; what a part hands on (decayed sums, last values, counts) is one row per key and part, scanned over the parts of the key
and joined back by (key, part), by which the rows are dealt already. The ranged table is written once, so that parts stay what they were.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged
from .history import PAST

PART = "_part"


def in_parts(df: DataFrame, key: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """df with _part, the number of the range of (key, order) that a row lies in; equal values share a part."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *key, *order).withColumn(PART, F.spark_partition_id()))


def _inside(key: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*key, PART).orderBy(*order)


def _with_carried(rows: DataFrame, handed: DataFrame, key: Sequence[str], carried: Mapping[str, Column]) -> DataFrame:
    """rows with ``carried``, computed over the earlier parts' rows of ``handed`` (a row per key and part)."""
    right = handed.withColumns(dict(carried)).select(*(F.col(k).alias(f"_of_{k}") for k in (*key, PART)), *carried)
    on = F.col(PART) == F.col(f"_of_{PART}")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(right, on).drop(*(f"_of_{k}" for k in (*key, PART)))


def _earlier(key: Sequence[str], most: int | None = None):
    w = Window.partitionBy(*key).orderBy(PART)
    return w.rowsBetween(*PAST) if most is None else w.rowsBetween(-most, -1)


def running_sum(df: DataFrame, key: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], inclusive: bool = True, parts: int | None = None) -> DataFrame:
    """Sums over the rows of a key up to a row (or before it) in ``order``, which must be unique inside a key."""
    names = {f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    rows = in_parts(df.withColumns(names), key, order, parts)
    frame = _inside(key, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    handed = rows.groupBy(*key, PART).agg(*(F.sum(v).alias(v) for v in names))
    rows = rows.withColumns({out: F.coalesce(F.sum(v).over(frame), F.lit(0)) for out, v in zip(sums, names)}).drop(*names)
    rows = _with_carried(rows, handed, key, {f"{v}_in": F.coalesce(F.sum(v).over(_earlier(key)), F.lit(0)) for v in names})
    return rows.withColumns({out: F.col(out) + F.col(f"{v}_in") for out, v in zip(sums, names)}).drop(PART, *(f"{v}_in" for v in names))


def fill_forward(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], default: object = 0, parts: int | None = None) -> DataFrame:
    """As ``events.score_fill``: the last value that is not null up to a row, ``default`` before the first."""
    rows = in_parts(df, key, order, parts)
    at = F.struct(*order)
    handed = rows.groupBy(*key, PART).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_last{i}") for i, c in enumerate(columns)))
    run = _inside(key, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(run) for c in columns})
    rows = _with_carried(rows, handed, key, {f"_in{i}": F.last(f"_last{i}", ignorenulls=True).over(_earlier(key)) for i in range(len(columns))})
    return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"_in{i}"), F.lit(default)) for i, c in enumerate(columns)}).drop(PART, *(f"_in{i}" for i in range(len(columns))))


def previous(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, out: str, parts: int | None = None) -> DataFrame:
    """``column`` of the row before (null at the first); a part hands on its last value."""
    rows = in_parts(df, key, order, parts)
    # wrapped, so that a null value is told from no row
    handed = rows.groupBy(*key, PART).agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("_last"))
    rows = rows.withColumn("_near", F.lag(F.struct(F.col(column).alias("v"))).over(_inside(key, order)))
    rows = _with_carried(rows, handed, key, {"_in": F.last("_last").over(_earlier(key, 1))})
    return rows.withColumn(out, F.coalesce("_near", "_in")["v"]).drop(PART, "_near", "_in")


def rolling_before(df: DataFrame, key: Sequence[str], order: Sequence[str], metric: str, games: int = 5, out: str | None = None, parts: int | None = None) -> DataFrame:
    """As ``history.rolling_before``: the mean of the ``games`` rows before; a part hands on its last ``games`` values."""
    rows = in_parts(df, key, order, parts)
    w = _inside(key, order)
    value = F.struct(F.col(metric).alias("v"))
    back = rows.withColumn("_back", F.row_number().over(Window.partitionBy(*key, PART).orderBy(*(F.col(c).desc() for c in order)))).where(F.col("_back") <= games)
    handed = back.groupBy(*key, PART).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col(metric).alias("v")))), lambda x: F.struct(x["v"].alias("v"))).alias("_last"))
    rows = rows.withColumn("_near", F.collect_list(value).over(w.rowsBetween(-games, -1)))
    # every earlier part has a row, so that ``games`` parts hold enough
    rows = _with_carried(rows, handed, key, {"_in": F.flatten(F.collect_list("_last").over(_earlier(key, games)))})
    seen = F.concat("_in", "_near")
    last = F.when(F.size(seen) > games, F.slice(seen, F.size(seen) - games + 1, games)).otherwise(seen)
    known = F.filter(F.transform(last, lambda x: x["v"].cast("double")), lambda v: v.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known))
    return rows.withColumn(out or f"{metric}_last{games}", mean).drop(PART, "_near", "_in")


def ewm_before(df: DataFrame, key: Sequence[str], order: Sequence[str], metrics: Sequence[str], span: int = 10, suffix: str = "_ewm", parts: int | None = None) -> DataFrame:
    """As ``history.ewm_before``: exponentially weighted mean of all earlier rows, adjusted weights, nulls skipped in their place.

    Inside a part sums run in blocks whose weights stay below e^50 and which take over the decayed totals of the two before. A part
    hands on its totals decayed to its end and its number of rows; a row takes those of the parts before, as many as have weight (every
    part has a row, so a fixed number of them). Nulls after a row lower all weights alike, so its mean stays, over any number of parts.
    """
    q = max(1 - 2 / (span + 1), 1e-20)
    size, most = max(1, int(50 / -math.log(q))), max(1, math.ceil(80 / -math.log(q)))
    rows = in_parts(df, key, order, parts)
    rows = rows.withColumn("_n", F.row_number().over(_inside(key, order)) - 1).withColumns({"_block": F.floor(F.col("_n") / size), "_at": F.col("_n") % size + 1})
    up = F.pow(F.lit(q), -F.col("_at"))
    names = [f"_{part}{i}" for i in range(len(metrics)) for part in ("sum", "weight")]
    terms = [t for m in metrics for t in (F.col(m) * up, F.when(F.col(m).isNotNull(), up))]
    block = Window.partitionBy(*key, PART, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*key, PART).orderBy("_n").rowsBetween(*PAST)
    ends, decay = F.col("_at") == size, q**size
    before = lambda c: F.coalesce(F.last(F.when(ends, c), ignorenulls=True).over(past), F.lit(0.0))
    rows = rows.withColumns({c: F.coalesce(F.sum(t).over(block), F.lit(0.0)) for c, t in zip(names, terms)})
    rows = rows.withColumns({f"{c}_last": before(F.col(c) * decay) for c in names})
    rows = rows.withColumns({f"{c}_both": before((F.col(c) + F.col(f"{c}_last")) * decay) for c in names})
    # a row's totals inside its part, seen from its block's start, and what earlier parts weigh there
    gone = F.pow(F.lit(q), F.col("_block") * size)
    own = {f"_own{i}": F.when(F.col(m).isNotNull(), F.struct((F.col(f"_sum{i}") + F.col(f"_sum{i}_both")).alias("s"), (F.col(f"_weight{i}") + F.col(f"_weight{i}_both")).alias("w"), gone.alias("g"))) for i, m in enumerate(metrics)}
    rows = rows.withColumns(own).withColumns({f"_prior{i}": F.last(f"_own{i}", ignorenulls=True).over(past) for i in range(len(metrics))})
    at_end = lambda c: F.max_by((F.col(c) + F.col(f"{c}_both")) * F.pow(F.lit(q), F.col("_at")), "_n")
    handed = rows.groupBy(*key, PART).agg(F.count("*").alias("_rows"), *(at_end(c).alias(c) for c in names), *(F.max_by(o, F.when(F.col(o).isNotNull(), F.col("_n"))).alias(o) for o in own))
    handed = handed.withColumn("_parts", F.collect_list(F.struct("_rows", *names)).over(_earlier(key, most)))
    total = lambda c: F.aggregate("_parts", F.lit(0.0), lambda t, p: t * F.pow(F.lit(q), p["_rows"]) + p[c])
    mean = lambda o, i: (o["s"] + o["g"] * F.col(f"_sum{i}_in")) / (o["w"] + o["g"] * F.col(f"_weight{i}_in"))
    handed = handed.withColumns({f"{c}_in": total(c) for c in names})
    handed = handed.withColumns({f"_mean{i}": mean(F.col(f"_own{i}"), i) for i in range(len(metrics))})
    carried = {f"_mean{i}_in": F.last(f"_mean{i}", ignorenulls=True).over(_earlier(key)) for i in range(len(metrics))}
    local = [*names, *(f"{c}_{part}" for c in names for part in ("last", "both")), *own, "_n", "_block", "_at"]
    rows = _with_carried(rows.drop(*local), handed, key, {f"{c}_in": F.col(f"{c}_in") for c in names} | carried)
    rows = rows.withColumns({f"{m}{suffix}": F.when(F.col(f"_prior{i}").isNotNull(), mean(F.col(f"_prior{i}"), i)).otherwise(F.col(f"_mean{i}_in")) for i, m in enumerate(metrics)})
    return rows.drop(PART, *(f"{c}_in" for c in names), *(f"{p}{i}{e}" for i in range(len(metrics)) for p, e in (("_prior", ""), ("_mean", "_in"))))


class _Run:
    """What a key hands on: decayed sums and weights per metric, and the last values of the rolling metric."""

    def __init__(self, metrics: int) -> None:
        self.num, self.den, self.last = np.zeros(metrics), np.zeros(metrics), np.zeros(0)

    def before(self, x: np.ndarray, known: np.ndarray, q: float, size: int) -> np.ndarray:
        """Weighted means before each row (nan: none yet); rows are taken in blocks whose weights stay below e^50."""
        out = np.empty(x.shape)
        for lo in range(0, len(x), size):
            k = known[lo : lo + size]
            up = q ** -np.arange(1.0, len(k) + 1)[:, None]
            num, den = self.num + np.cumsum(np.where(k, x[lo : lo + size], 0.0) * up, 0), self.den + np.cumsum(k * up, 0)
            out[lo] = np.divide(self.num, self.den, out=np.full(len(self.num), np.nan), where=self.den > 0)
            out[lo + 1 : lo + len(k)] = np.divide(num[:-1], den[:-1], out=np.full(num[:-1].shape, np.nan), where=den[:-1] > 0)
            self.num, self.den = num[-1] * q ** len(k), den[-1] * q ** len(k)
            # nulls after a row lower all weights alike, so that its mean stays over any number of them
            faint = (self.den > 0) & (self.den < 1e-100)
            self.num[faint], self.den[faint] = self.num[faint] / self.den[faint] * 1e-100, 1e-100
        return out

    def rolled(self, v: np.ndarray, games: int) -> np.ndarray:
        """Means of the ``games`` rows before each row (nan: none known)."""
        seen = np.concatenate([np.full(games - len(self.last), np.nan), self.last, v])
        near = np.lib.stride_tricks.sliding_window_view(seen, games)[: len(v)]
        count = (~np.isnan(near)).sum(1)
        self.last = seen[-games:]
        return np.divide(np.nansum(near, 1), count, out=np.full(len(v), np.nan), where=count > 0)

    def after(self, earlier: "_Run", rows: int, q: float, games: int) -> "_Run":
        """This run with another one before it."""
        out, fade = _Run(len(self.num)), q ** min(rows, 10_000)
        out.num, out.den = earlier.num * fade + self.num, earlier.den * fade + self.den
        none = (self.den == 0) & (earlier.den > 0) & (out.den < 1e-100)
        out.num[none], out.den[none] = earlier.num[none] / earlier.den[none] * 1e-100, 1e-100
        out.last = np.concatenate([earlier.last, self.last[len(self.last) - min(rows, games) :]])[-games:]
        return out


def form_before(df: DataFrame, key: Sequence[str], order: Sequence[str], metrics: Sequence[str], rolling: str, span: int = 10, games: int = 5, suffix: str = "_ewm", parts: int | None = None) -> DataFrame:
    """``history.ewm_before`` of the metrics and ``history.rolling_before`` of one more, in one pass over ranges of (key, order).

    Only the first key of a range can have begun in an earlier one, so a range hands on a single state: one row a range meets on the driver,
    which adds them up in order. Ranges are read as sorted Arrow batches, with the state as the only memory.
    """
    q = max(1 - 2 / (span + 1), 1e-20)
    size, many, made = max(1, int(50 / -math.log(q))), len(metrics), [*(f"{m}{suffix}" for m in metrics), f"{rolling}_last{games}"]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the pass reads what it needs by name and gives its columns by row number, so that readers of the result read no more than they ask for
    dealt = staged(df.repartitionByRange(n, *key, *order).withColumns({PART: F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    ranged = lambda rows: rows.repartitionById(n, PART).sortWithinPartitions(PART, *key, *order)

    def segments(batch):
        """(part, key, first row, end) of the batch's runs of one key, and the metrics as numbers."""
        import pyarrow.compute as pc

        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for name in (*key, PART):
            coded = pc.dictionary_encode(batch.column(name)).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= coded[1:] != coded[:-1]
        at = np.flatnonzero(new)
        names = [tuple(x) for x in zip(*(batch.column(k).take(at).to_pylist() for k in (PART, *key)))]
        column = lambda c: batch.column(c).cast("double").to_numpy(zero_copy_only=False)
        known = np.stack([batch.column(m).is_valid().to_numpy(zero_copy_only=False) for m in metrics], 1)
        return zip(names, at.tolist(), [*at[1:].tolist(), batch.num_rows]), np.stack([column(m) for m in metrics], 1), known, column(rolling)

    def hand_on(batches):
        import pickle

        import pandas as pd

        held = {}  # part: [first key, last key, rows of the last key, its run]
        for b in batches:
            if not b.num_rows:
                continue
            found, x, known, v = segments(b)
            for (part, *name), lo, hi in found:
                was = held.setdefault(part, [name, name, 0, _Run(many)])
                if was[1] != name:
                    was[1:] = [name, 0, _Run(many)]
                was[3].before(x[lo:hi], known[lo:hi], q, size)
                was[3].rolled(v[lo:hi], games)
                was[2] += hi - lo
        import pyarrow as pa

        yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": pd.Series(list(held), dtype="int32"), "state": pd.Series([pickle.dumps(h) for h in held.values()], dtype=object)}), schema=pa.schema([("part", pa.int32()), ("state", pa.binary())]), preserve_index=False)

    import pickle

    carried, before = {}, None  # part: (key, run) of what comes before it
    wanted = dict.fromkeys([*key, *order, *metrics, rolling, PART])
    for row in sorted(ranged(dealt.select(*wanted)).mapInArrow(hand_on, "part int, state binary").collect()):
        first, last, rows, run = pickle.loads(row["state"])
        if before is not None:
            carried[row["part"]] = before
        if before is not None and first == last == before[0]:
            run = run.after(before[1], rows, q, games)
        before = (last, run)

    def scan(batches):
        import copy

        import pyarrow as pa

        own, run = None, None
        for b in batches:
            if not b.num_rows:
                continue
            found, x, known, v = segments(b)
            means, mean = np.empty(x.shape), np.empty(len(v))
            for (part, *name), lo, hi in found:
                if own is None or own[0] != part or own[1] != name:
                    start = carried.get(part)
                    fresh = own is None or own[0] != part
                    run = copy.deepcopy(start[1]) if fresh and start is not None and start[0] == name else _Run(many)
                    own = (part, name)
                means[lo:hi], mean[lo:hi] = run.before(x[lo:hi], known[lo:hi], q, size), run.rolled(v[lo:hi], games)
            numbers = lambda a: pa.array(a, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([b.column("_row"), *(numbers(means[:, i]) for i in range(many)), numbers(mean)], names=["_row", *made])

    found = ranged(dealt.select(*wanted, "_row")).mapInArrow(scan, T.StructType([T.StructField("_row", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in made)]))
    return dealt.drop(PART).join(found, "_row").drop("_row")


def counts_below(values: DataFrame, key: Sequence[str], value: str, count: str, parts: int | None = None) -> DataFrame:
    """Rows of (key, value, count), each value once a key, with _below: the count of all smaller values of the key (null is the smallest)."""
    return running_sum(values, key, [value], {"_below": F.col(count)}, inclusive=False, parts=parts)


def percentiles(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """As ``reports.percentiles``: percent_rank of each metric, from counts per distinct value; no task sees a whole league.

    All metrics are ranked in one scan over (keys, metric, value) and joined back by value.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("_metric"), F.col(m).cast("double").alias("_value")) for m in metrics)))
    long = rows.select(*keys, pairs.alias("_p")).select(*keys, "_p.*")
    per = long.groupBy(*keys, "_metric", "_value").agg(F.count("*").alias("_n"))
    below = counts_below(per, (*keys, "_metric"), "_value", "_n", parts)
    size = rows.groupBy(*keys).agg(F.count("*").alias("_all")) if keys else rows.agg(F.count("*").alias("_all"))
    names = {k: f"_k_{k}" for k in keys}

    def equal(*pairs: tuple[Column, Column]) -> Column:
        on = F.lit(True)
        for a, b in pairs:
            on = on & a.eqNullSafe(b)
        return on

    same = [(F.col(k), F.col(n)) for k, n in names.items()]
    out = rows.join(size.withColumnsRenamed(names), equal(*same)).drop(*names.values()) if keys else rows.crossJoin(F.broadcast(size))  # one row
    ranks = staged(below.withColumnsRenamed(names).select(*names.values(), "_metric", "_value", "_below"))
    for m in metrics:
        own = ranks.where(F.col("_metric") == m).drop("_metric")
        out = out.join(own, equal(*same, (F.col(m).cast("double"), F.col("_value"))))
        out = out.withColumn(f"{m}_pctile", F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1)).otherwise(0.0)).drop(*names.values(), "_value", "_below")
    return out.drop("_all")
