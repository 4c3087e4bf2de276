"""Possessions as numbered runs of events, and assists given to baskets.

A possession belongs to one side. It ends with that side's turnover, with its field goal unless an own free throw follows (a basket
and foul), with its last made free throw, with the rival's defensive rebound, and with the period; an own offensive rebound
stays inside. Where the page leaves the end out and the other side acts, a new possession begins there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from . import KEYS
from .events import MADE, ORDER, points

FIELD_GOALS = ("CANASTA-2P", "CANASTA-3P")
FREE_THROWS = ("CANASTA-1P", "TIRO1-FALLADO")
#: What a side does with the ball: attempts, free throws and turnovers; with offensive rebounds what shows who has it.
TRIES = (*FIELD_GOALS, "TIRO2-FALLADO", "TIRO3-FALLADO", *FREE_THROWS, "PERDIDA")
BOUNDARIES = ("INICIO-PERIODO", "FINAL-PERIODO", "FINAL-PARTIDO")


def numbered_possessions(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ORDER) -> DataFrame:
    """Add possession, the number of the game's possession that an event lies in (0 before the first), and attack, its side.

    One shuffle by game serves all windows. Assists, fouls and substitutions lie in the possession that began last.
    """
    kind, side = F.col("kind"), F.col("side")
    play = kind.isin(*TRIES, "REBOTE-OFENSIVO", "REBOTE-DEFENSIVO") & side.isNotNull()
    rows = events.repartition(*game).withColumn("_play", F.coalesce(play | kind.isin(*BOUNDARIES), F.lit(False)))
    plays = Window.partitionBy(*game, "_play").orderBy(*order)
    before = lambda c: F.lag(c).over(plays)
    thrown_next = F.coalesce(F.lead("kind").over(plays).isin(*FREE_THROWS) & (F.lead("side").over(plays) == side), F.lit(False))
    over = kind.isin(*BOUNDARIES, "PERDIDA") | (kind.isin(*FIELD_GOALS, "CANASTA-1P") & ~thrown_next)
    rows = rows.withColumn("_over", over)
    begins = ~kind.isin(*BOUNDARIES) & (F.coalesce(before("_over"), F.lit(True)) | (kind == "REBOTE-DEFENSIVO") | ~F.coalesce(before("side") == side, F.lit(False)))
    rows = rows.withColumn("_begins", F.when(F.col("_play") & begins, 1).otherwise(0))
    run = Window.partitionBy(*game).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"possession": F.sum("_begins").over(run), "attack": F.last(F.when(F.col("_begins") == 1, side), ignorenulls=True).over(run)})
    return rows.drop("_play", "_over", "_begins")


def possession_table(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ORDER) -> DataFrame:
    """A row per possession: side, points, its first try, the seconds from the change of possession to it, and rebounds inside.

    The change is the end of the possession before (for a defensive rebound, the rebound); a period's first possession has none,
    and a possession without a try no seconds. Needs ``elapsed``.
    """
    rows = events if "possession" in events.columns else numbered_possessions(events, game, order)
    at, own = F.struct(*order), F.col("side") == F.col("attack")
    tried = F.col("kind").isin(*TRIES) & own
    ends = F.col("kind").isin(*TRIES, "REBOTE-OFENSIVO", "REBOTE-DEFENSIVO")
    one = rows.where("possession > 0").groupBy(*game, "possession").agg(
        F.first("attack").alias("side"), F.sum(F.when(own, points()).otherwise(0)).alias("pts"), F.count_if(own & (F.col("kind") == "REBOTE-OFENSIVO")).alias("second_chances"),
        F.min_by("kind", F.when(tried, at)).alias("first_try"), F.min_by("elapsed", F.when(tried, at)).alias("_tried"), F.max_by("elapsed", F.when(ends, at)).alias("_ended"),
        F.min_by("period", at).alias("period"), F.min_by("kind", at).alias("_first"), F.min_by("elapsed", at).alias("_began"),
    )
    w = Window.partitionBy(*game).orderBy("possession")
    same = F.lag("period").over(w).eqNullSafe(F.col("period"))
    change = F.when(F.col("_first") == "REBOTE-DEFENSIVO", F.col("_began")).when(same, F.lag("_ended").over(w))
    return one.withColumn("seconds_to_try", F.col("_tried") - change).select(*game, "possession", "period", "side", "pts", "second_chances", "first_try", "seconds_to_try")


def transition_split(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ORDER, seconds: int = 8, group: Sequence[str] | None = None) -> DataFrame:
    """Possessions, points, points per possession and share of possessions of each side in transition and in the half court.

    A possession is in transition if its first try comes within ``seconds`` of the change of possession. ``group`` (default: game and side).
    """
    group = (*game, "side") if group is None else tuple(group)
    rows = possession_table(events, game, order).withColumn("transition", F.coalesce(F.col("seconds_to_try") <= seconds, F.lit(False)))
    out = rows.groupBy(*group, "transition").agg(F.sum("pts").alias("pts"), F.count("*").alias("poss"))
    return out.withColumns({"ppp": ratio("pts", "poss"), "share": ratio("poss", F.sum("poss").over(Window.partitionBy(*group)))})


def assisted_baskets(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ORDER, look_back: int = 4) -> DataFrame:
    """Baskets with assists, the number of assists that ``events.assist_pairs`` pairs with each: the inverse of that as-of join, by windows alone.

    An assist takes the last own basket among the ``look_back`` rows before it, so a basket has the own assists among the rows after it up to
    the next own basket. The sum of assists is the number of pairs.
    """
    kind = F.col("kind")
    rows = events.repartition(*game).withColumn("_n", F.row_number().over(Window.partitionBy(*game).orderBy(*order)))
    rows = rows.withColumn("_basket", F.coalesce(kind.isin(*MADE) & F.col("side").isin("LOCAL", "VISITANTE"), F.lit(False)))
    following = F.lead("_n").over(Window.partitionBy(*game, "side", "_basket").orderBy("_n"))
    ahead = F.collect_list(F.when(kind == "ASISTENCIA", F.struct("side", "_n"))).over(Window.partitionBy(*game).orderBy("_n").rowsBetween(1, look_back))
    rows = rows.withColumns({"_next": following, "_ahead": ahead}).where("_basket")
    mine = F.filter("_ahead", lambda a: (a["side"] == F.col("side")) & (F.col("_next").isNull() | (a["_n"] < F.col("_next"))))
    return rows.withColumn("assists", F.size(mine)).drop("_n", "_basket", "_next", "_ahead")


def possession_count(events: DataFrame, group: Sequence[str] = (*KEYS, "game"), game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ORDER) -> DataFrame:
    """Possessions of each side counted from the events, beside the estimate attempts - offensive rebounds + turnovers + 0.44 free throws."""
    rows = numbered_possessions(events, game, order)
    kind, own = F.col("kind"), F.col("side") == F.col("attack")
    estimate: Column = kind.isin(*FIELD_GOALS, "TIRO2-FALLADO", "TIRO3-FALLADO", "PERDIDA").cast("int") - (kind == "REBOTE-OFENSIVO").cast("int") + 0.44 * kind.isin(*FREE_THROWS).cast("int")
    counted = rows.where("possession > 0").groupBy(*game, F.col("attack").alias("side")).agg(F.count_distinct("possession").alias("possessions"), F.sum(F.when(own, estimate).otherwise(0.0)).alias("estimate"))
    return counted.groupBy(*group, "side").agg(F.sum("possessions").alias("possessions"), F.sum("estimate").alias("estimate"))
