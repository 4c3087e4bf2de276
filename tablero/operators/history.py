"""What a team knew before a game: leak-free windows, last games, streaks, temporal cuts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAST = (Window.unboundedPreceding, -1)


def ewm_before(df: DataFrame, key: Sequence[str], order: Sequence[str], metrics: Sequence[str], span: int = 10, suffix: str = "_ewm") -> DataFrame:
    """Exponentially weighted mean of all earlier rows: adjusted weights; nulls are skipped but keep their place.

    Closed form sum(x q^-n) / sum(q^-n), q = 1 - 2 / (span + 1), within blocks of rows of a key, whose weights stay below e^50; a block takes over
    the decayed totals of the two before, which leaves out weights below e^-100 of the latest only. So keys may have any number of rows.
    """
    q = max(1 - 2 / (span + 1), 1e-20)
    size = max(1, int(50 / -math.log(q)))
    w = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn("_n", F.row_number().over(w) - 1).withColumns({"_block": F.floor(F.col("_n") / size), "_at": F.col("_n") % size + 1})
    out = out.withColumn("_k", F.pow(F.lit(q), -F.col("_at")))
    inside = Window.partitionBy(*key, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*key).orderBy("_block", "_n").rowsBetween(*PAST)
    ends, decay = F.col("_at") == size, q**size
    before = lambda c: F.coalesce(F.last(F.when(ends, c), ignorenulls=True).over(past), F.lit(0.0))
    names = [f"_{part}{i}" for i in range(len(metrics)) for part in ("sum", "weight")]
    terms = [t for m in metrics for t in (F.col(m) * F.col("_k"), F.when(F.col(m).isNotNull(), F.col("_k")))]
    out = out.withColumns({c: F.coalesce(F.sum(t).over(inside), F.lit(0.0)) for c, t in zip(names, terms)})
    out = out.withColumns({f"{c}_last": before(F.col(c) * decay) for c in names})
    out = out.withColumns({f"{c}_both": before((F.col(c) + F.col(f"{c}_last")) * decay) for c in names})
    mean = lambda i: F.try_divide(F.col(f"_sum{i}") + F.col(f"_sum{i}_both"), F.col(f"_weight{i}") + F.col(f"_weight{i}_both"))
    # nulls after a row lower all weights alike, so that its mean stays
    out = out.withColumns({f"{m}{suffix}": F.last(F.when(F.col(m).isNotNull(), mean(i)), ignorenulls=True).over(past) for i, m in enumerate(metrics)})
    return out.drop("_n", "_block", "_at", "_k", *names, *(f"{c}_{part}" for c in names for part in ("last", "both")))


def rolling_before(df: DataFrame, key: Sequence[str], order: Sequence[str], metric: str, games: int = 5, out: str | None = None) -> DataFrame:
    """Mean of the ``games`` rows before, at least one."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-games, -1)
    return df.withColumn(out or f"{metric}_last{games}", F.avg(metric).over(w))


def moving_average(df: DataFrame, key: Sequence[str], order: Sequence[str], metric: str, games: int = 5, out: str | None = None) -> DataFrame:
    """Mean of the row and the ``games`` - 1 before."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - games, 0)
    return df.withColumn(out or f"{metric}_ma{games}", F.avg(metric).over(w))


def last_k(df: DataFrame, key: Sequence[str], order: Sequence[str], k: int = 5, rank: str = "_back") -> DataFrame:
    """The last k rows of every key; ``rank`` counts from the latest."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ewm_last_k(df: DataFrame, key: Sequence[str], order: Sequence[str], metrics: Sequence[str], k: int = 5, span: int = 10) -> DataFrame:
    """Current exponentially weighted mean over only the last k rows of every key."""
    q = 1 - 2 / (span + 1)
    rows = last_k(df, key, order, k)
    weight = F.pow(F.lit(q), F.col("_back") - 1)
    mean = lambda m: F.try_divide(F.sum(F.col(m) * weight), F.sum(F.when(F.col(m).isNotNull(), weight)))
    return rows.groupBy(*key).agg(*(mean(m).alias(f"{m}_now") for m in metrics))


def streaks(df: DataFrame, key: Sequence[str], order: Sequence[str], won: str = "won") -> DataFrame:
    """Current streak (positive: wins) and longest winning and losing streaks of every key."""
    w, same = Window.partitionBy(*key).orderBy(*order), Window.partitionBy(*key, won).orderBy(*order)
    runs = df.withColumn("_n", F.row_number().over(w)).withColumn("_run", F.col("_n") - F.row_number().over(same))
    runs = runs.groupBy(*key, won, "_run").agg(F.count("*").alias("length"), F.max("_n").alias("last"))
    signed = F.when(F.col(won), F.col("length")).otherwise(-F.col("length"))
    return runs.groupBy(*key).agg(
        F.max_by(signed, "last").alias("current_streak"),
        F.coalesce(F.max(F.when(F.col(won), F.col("length"))), F.lit(0)).alias("longest_wins"),
        F.coalesce(F.max(F.when(~F.col(won), F.col("length"))), F.lit(0)).alias("longest_losses"),
    )


def bursts(df: DataFrame, key: Sequence[str], order: Sequence[str], rival: str = "rival", least: int = 2) -> DataFrame:
    """Runs of at least ``least`` consecutive games against one rival: key, rival, games, first and last order value."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.when(F.col(rival).eqNullSafe(F.lag(rival).over(w)), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = order[0]
    return runs.groupBy(*key, "_run", rival).agg(F.count("*").alias("games"), F.min(first).alias("first"), F.max(first).alias("last")).where(F.col("games") >= least).drop("_run")


def rest_bucket(rest: str = "rest"):
    """back-to-back (up to a day), 1 day, 2 or more."""
    r = F.col(rest)
    return F.when(r <= 1, "b2b").when(r == 2, "1").otherwise("2+")


def positions(df: DataFrame, date: str, order: Sequence[str], out: str = "position", partition: Sequence[str] = ()) -> DataFrame:
    """Row number (from 0) in the total order (date, order) without gathering all rows in one task.

    Rows are counted per date, the small table of dates is summed up, and rows are numbered inside their date.
    """
    days = df.groupBy(*partition, date).agg(F.count("*").alias("_in_day"))
    before = Window.partitionBy(*partition).orderBy(date).rowsBetween(*PAST)
    days = days.withColumn("_before", F.coalesce(F.sum("_in_day").over(before), F.lit(0))).drop("_in_day")
    within = Window.partitionBy(*partition, date).orderBy(*order)
    return df.withColumn("_in", F.row_number().over(within) - 1).join(days, [*partition, date]).withColumn(out, F.col("_before") + F.col("_in")).drop("_in", "_before")


def temporal_cut(df: DataFrame, date: str, order: Sequence[str], share: float = 0.75) -> DataFrame:
    """is_train for the first ``share`` of rows in the order (date, order)."""
    n = df.agg(F.count("*").alias("_rows"))
    return positions(df, date, order, "_at").crossJoin(F.broadcast(n)).withColumn("is_train", F.col("_at") < F.floor(F.col("_rows") * share)).drop("_at", "_rows")


def temporal_folds(df: DataFrame, date: str, order: Sequence[str], folds: int = 5) -> DataFrame:
    """A row per fold that a row takes part in, with role train or test: tests are ``n div (folds + 1)`` rows, training all before."""
    n = df.agg(F.count("*").alias("_rows"))  # one row
    placed = positions(df, date, order, "_at").crossJoin(F.broadcast(n))
    size = F.floor(F.col("_rows") / (folds + 1))
    each = placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    low = F.col("_rows") - (folds - F.col("fold") + 1) * size
    role = F.when(F.col("_at") < low, "train").when(F.col("_at") < low + size, "test")
    return each.withColumn("role", role).where("role is not null").drop("_at", "_rows")
