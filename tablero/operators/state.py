"""Team state that is kept up to date: parts of a team's history fold into states, and states of neighbouring parts merge.

A state holds decayed sums and weights (seen from the team's last game), the last wins, and plain sums for the league's means. Parts
must follow each other in (date, game) per team; merging is associative, so any division of a history into consecutive
parts gives the state of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import KEYS
from .history import last_k

RECENT = 5


def part_state(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS, span: int = 10) -> DataFrame:
    """The state of a part: keys, team, games, first and last (date, game), recent wins (latest first), sums per metric."""
    own, q = [*keys, "team"], 1 - 2 / (span + 1)
    back = last_k(rows, own, ["date", "game"], 1 << 30)
    weight = F.pow(F.lit(q), F.col("_back") - 1)
    at = F.struct("date", "game")
    near = F.collect_list(F.when(F.col("_back") <= RECENT, F.struct("_back", "win")))
    sums = [
        s for m in metrics for s in (
            F.coalesce(F.sum(F.col(m) * weight), F.lit(0.0)).alias(f"{m}_sum"), F.coalesce(F.sum(F.when(F.col(m).isNotNull(), weight)), F.lit(0.0)).alias(f"{m}_weight"),
            F.coalesce(F.sum(F.col(m).cast("double")), F.lit(0.0)).alias(f"{m}_total"), F.count(m).alias(f"{m}_count"),
        )
    ]
    out = back.groupBy(*own).agg(F.count("*").alias("games"), F.min(at).alias("first"), F.max(at).alias("last"), near.alias("_near"), F.sum("win").cast("double").alias("win_total"), F.count("win").alias("win_count"), *sums)
    return out.withColumn("recent", F.transform(F.array_sort("_near"), lambda x: x["win"])).drop("_near")


def merged_state(earlier: DataFrame, later: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS, span: int = 10) -> DataFrame:
    """The state of two parts of which ``later`` follows ``earlier``; teams may be in either alone."""
    own, q = [*keys, "team"], 1 - 2 / (span + 1)
    plain = [c for c in later.columns if c not in own]
    a = earlier.select(*own, F.struct(*plain).alias("_a"))
    b = later.select(*own, F.struct(*plain).alias("_b"))
    both = a.join(b, own, "full")
    of = lambda s, c, other: F.coalesce(F.col(f"{s}.{c}"), other)
    zero = F.lit(0)
    none = F.array().cast(dict(later.dtypes)["recent"])
    decay = F.pow(F.lit(q), of("_b", "games", zero))
    columns = {
        "games": of("_a", "games", zero) + of("_b", "games", zero), "first": of("_a", "first", F.col("_b.first")), "last": of("_b", "last", F.col("_a.last")),
        "recent": F.slice(F.concat(of("_b", "recent", none), of("_a", "recent", none)), 1, RECENT),
    }
    for m in metrics:
        columns |= {f"{m}_{c}": of("_a", f"{m}_{c}", F.lit(0.0)) * decay + of("_b", f"{m}_{c}", F.lit(0.0)) for c in ("sum", "weight")}
    for m in ("win", *metrics):
        columns |= {f"{m}_total": of("_a", f"{m}_total", F.lit(0.0)) + of("_b", f"{m}_total", F.lit(0.0)), f"{m}_count": of("_a", f"{m}_count", zero) + of("_b", f"{m}_count", zero)}
    types = dict(later.dtypes)
    return both.select(*own, *(columns[c].cast(types[c]).alias(c) for c in plain))


def out_of_order(state: DataFrame, part: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Teams whose ``part`` begins before their state's last game: their state has to be built anew from all rows."""
    own = [*keys, "team"]
    return part.select(*own, "first").join(state.select(*own, F.col("last").alias("_last")), own).where(F.col("first") <= F.col("_last")).select(*own)


def scoring_state(state: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The columns of ``winprob.team_state``: last_date, win_last5, form and the league's means over game rows."""
    known = F.filter("recent", lambda w: w.isNotNull())
    form = {f"{m}_ewm": F.try_divide(F.col(f"{m}_sum"), F.nullif(F.col(f"{m}_weight"), F.lit(0.0))) for m in metrics}
    win = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, w: s + w) / F.size(known))
    mean = lambda m: F.try_divide(F.sum(f"{m}_total"), F.sum(f"{m}_count"))
    means = [mean("win").alias("league_win_last5"), *(mean(m).alias(f"league_{m}_ewm") for m in metrics)]
    league = state.groupBy(*keys).agg(*means) if keys else state.agg(*means)
    teams = state.select(*keys, "team", F.col("last.date").alias("last_date"), win.alias("win_last5"), *(c.alias(n) for n, c in form.items()))
    return teams.join(league, list(keys)) if keys else teams.crossJoin(F.broadcast(league))  # one row
