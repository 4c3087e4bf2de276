"""Players on court and lineup ratings.

A stint is the time from a player's entry to the next substitution of that player; a segment lies between two neighbouring
boundaries of a side in a game (own substitutions, period starts and ends). Events belong to the segment of their place; only
segments with ``size`` players and with time on the clock count. A segment lasts from the clock of its first boundary to that of its last.

``court_segments`` does all of it in one ordered pass per game; ``stints``, ``segments``, ``on_court`` and ``segment_facts`` are the same as joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elapsed_seconds, lineup_label, ratio
from . import KEYS
from .events import MADE, points

IN, OUT = "CAMBIO-JUGADOR-ENTRA", "CAMBIO-JUGADOR-SALE"


def numbered(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), order: Sequence[str] = ("num", "seq")) -> DataFrame:
    """Add n, the event's place in its game."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy(*game).orderBy(*order)))


def stints(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), entry: str = IN, leave: str = OUT) -> DataFrame:
    """(game, side, player, n_in, n_out): a player is on court after events n with n_in <= n < n_out (null: to the end)."""
    subs = events.where(F.col("kind").isin(entry, leave)).select(*game, "side", "player", "n", "kind")
    w = Window.partitionBy(*game, "side", "player").orderBy("n")
    return subs.withColumn("n_out", F.lead("n").over(w)).where(F.col("kind") == entry).select(*game, "side", "player", F.col("n").alias("n_in"), "n_out")


def timed(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), length: int = 600, overtime: int = 300) -> DataFrame:
    """Add elapsed, the game seconds gone. A period start without clock has the period's full length, an end 0; other rows without clock or
    period take the time of the row before. Needs ``n`` (see ``numbered``)."""
    full = F.when(F.col("period") <= 4, length).otherwise(overtime)
    clock = F.coalesce("clock", F.when(F.col("kind") == "INICIO-PERIODO", full).when(F.col("kind") == "FINAL-PERIODO", 0))
    w = Window.partitionBy(*game).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("elapsed", F.coalesce(F.last(elapsed_seconds("period", clock, overtime, length), ignorenulls=True).over(w), F.lit(0)))


def segments(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), entry: str = IN, leave: str = OUT, boundaries: Sequence[str] = ("INICIO-PERIODO", "FINAL-PERIODO", "FINAL-PARTIDO")) -> DataFrame:
    """(game, side, n_from, n_to) between neighbouring boundaries of each side, and seconds where events carry ``elapsed``.

    Substitutions at one clock make segments without time. The last segment is open and lasts to the game's last event.
    """
    time = ["elapsed"] if "elapsed" in events.columns else []
    own = events.where(F.col("kind").isin(entry, leave)).select(*game, "side", "n", *time)
    both = events.where(F.col("kind").isin(*boundaries)).select(*game, F.explode(F.array(F.lit("LOCAL"), F.lit("VISITANTE"))).alias("side"), "n", *time)
    w = Window.partitionBy(*game, "side").orderBy("n")
    cuts = own.unionByName(both).distinct().withColumn("n_to", F.lead("n").over(w))
    if not time:
        return cuts.select(*game, "side", F.col("n").alias("n_from"), "n_to")
    last = events.groupBy(*game).agg(F.max("elapsed").alias("_last"))
    cuts = cuts.withColumn("_end", F.lead("elapsed").over(w)).join(last, list(game))
    return cuts.select(*game, "side", F.col("n").alias("n_from"), "n_to", (F.coalesce("_end", "_last") - F.col("elapsed")).alias("seconds"))


def on_court(segs: DataFrame, stint: DataFrame, game: Sequence[str] = (*KEYS, "game"), size: int | None = 5) -> DataFrame:
    """Each segment with its sorted players (range join inside a game and side)."""
    s, t = segs.alias("s"), stint.alias("t")
    same = F.lit(True)
    for k in (*game, "side"):
        same = same & (F.col(f"s.{k}") == F.col(f"t.{k}"))
    inside = (F.col("t.n_in") <= F.col("s.n_from")) & (F.col("t.n_out").isNull() | (F.col("s.n_from") < F.col("t.n_out")))
    rows = s.join(t, same & inside).groupBy(*(F.col(f"s.{k}").alias(k) for k in segs.columns)).agg(F.sort_array(F.collect_set("t.player")).alias("lineup"))
    return rows if size is None else rows.where(F.size("lineup") == size)


SEGMENT = ("pts", "opp_pts", "poss", "opp_poss", "fga", "fgm", "fg3a", "fta", "tov", "ast")


class _Side:
    """What a pass over a game knows of one side: who is on court, and the segment that is open."""

    def __init__(self) -> None:
        self.court: dict = {}
        self.start, self.lineup, self.facts = None, None, None

    def open(self, n: int, elapsed: int | None) -> None:
        self.start = (n, elapsed)
        self.lineup = sorted(p for p in self.court if p is not None) if self.court else None
        self.facts = dict.fromkeys(SEGMENT, 0)

    def closed(self, n: int | None, elapsed: int | None) -> tuple:
        seconds = None if elapsed is None else elapsed - self.start[1]
        return (self.start[0], n, seconds, self.lineup, *(self.facts[c] for c in SEGMENT))


def court_segments(events: DataFrame, game: Sequence[str] = (*KEYS, "game"), size: int | None = 5, parity: bool = False, order: Sequence[str] = ("num", "seq"), timing: bool = True, entry: str = IN, leave: str = OUT, boundaries: Sequence[str] = ("INICIO-PERIODO", "FINAL-PERIODO", "FINAL-PARTIDO")) -> DataFrame:
    """Segments with their lineup and facts (as ``segment_facts``) by one pass over each game's events in order: one shuffle, by game.

    The pass keeps the players on court and the open segment of both sides, so memory is a few dozen values per task, whatever a
    game's length. With ``timing`` only segments that have time are given. Numbers and times are windows by game over the same shuffle.
    """
    timed_ = timing
    events = numbered(events, game, order)
    events = timed(events, game) if timing else events
    kinds = dict(events.dtypes)
    columns = [*game, "side", "player", "kind", "n", *(["elapsed"] if timed_ else [])]
    field = {"CANASTA-2P", "CANASTA-3P"}
    attempts = set(MADE) if parity else field | {"TIRO2-FALLADO", "TIRO3-FALLADO"}
    threes = {"CANASTA-3P"} if parity else {"CANASTA-3P", "TIRO3-FALLADO"}
    thrown = {"CANASTA-1P"} if parity else {"CANASTA-1P", "TIRO1-FALLADO"}
    free = {"FALTA-RECIBIDA"} if parity else thrown
    k, cuts = len(game), set(boundaries)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in game), "side string, n_from int, n_to int, seconds long, lineup array<string>", *(f"{c} {'double' if 'poss' in c else 'long'}" for c in SEGMENT)])

    def sweep(batches) -> Iterator:
        import pandas as pd

        held, sides, last, out = None, {}, None, []

        def frame():
            return pd.DataFrame(out, columns=[*game, "side", "n_from", "n_to", "seconds", "lineup", *SEGMENT]).astype({"n_to": "Int32", "seconds": "Int64"})

        def keep(side: str, row: tuple) -> None:
            if row[3] is not None and (size is None or len(row[3]) == size) and (row[2] is None or row[2] > 0):
                out.append((*held, side, *row))

        def finish() -> None:
            for name, side in sides.items():
                if side.start is not None:
                    keep(name, side.closed(None, last))

        for pdf in batches:
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                side, player, kind, n = row[k : k + 4]
                if held != row[:k]:
                    if held is not None:
                        finish()
                    held, sides, last = row[:k], {"LOCAL": _Side(), "VISITANTE": _Side()}, None
                elapsed = row[k + 4] if timed_ else None
                last = elapsed if last is None or elapsed is None else max(last, elapsed)
                for name, own in sides.items():
                    if own.start is None or side is None:
                        continue
                    f, mine = own.facts, name == side
                    pts = MADE.get(kind, 0)
                    poss = (kind in attempts) - (kind == "REBOTE-OFENSIVO") + (kind == "PERDIDA") + 0.44 * (kind in free)
                    f["pts" if mine else "opp_pts"] += pts
                    f["poss" if mine else "opp_poss"] += poss
                    if mine:
                        for c, hit in (("fga", kind in attempts), ("fgm", kind in field), ("fg3a", kind in threes), ("fta", kind in thrown), ("tov", kind == "PERDIDA"), ("ast", kind == "ASISTENCIA")):
                            f[c] += hit
                if kind in (entry, leave) and side in sides:
                    if kind == entry:
                        sides[side].court[player] = True
                    else:
                        sides[side].court.pop(player, None)
                    cut = (side,)
                else:
                    cut = tuple(sides) if kind in cuts else ()
                for name in cut:
                    if sides[name].start is not None:
                        keep(name, sides[name].closed(n, elapsed))
                    sides[name].open(n, elapsed)
            if len(out) >= 5000:
                yield frame()
                out.clear()
        if held is not None:
            finish()
        yield frame()

    # the windows dealt the rows by game already
    return events.select(*columns).sortWithinPartitions(*game, "n").mapInPandas(sweep, schema)


def segment_facts(events: DataFrame, lineups: DataFrame, game: Sequence[str] = (*KEYS, "game"), parity: bool = False) -> DataFrame:
    """Own and rival points, attempts and possessions (attempts - offensive rebounds + turnovers + 0.44 free throws) of each segment that has time.

    parity: the narrower event sets (attempts are makes, threes made only, fouls drawn for free throws).
    """
    lineups = lineups.where("seconds > 0") if "seconds" in lineups.columns else lineups.withColumn("seconds", F.lit(None).cast("long"))
    own = F.col("e.side") == F.col("l.side")
    other = F.col("e.side").isNotNull() & ~own
    kind = F.col("e.kind")
    made = kind.isin("CANASTA-2P", "CANASTA-3P")
    fga = kind.isin(*MADE) if parity else made | kind.isin("TIRO2-FALLADO", "TIRO3-FALLADO")
    fg3a = kind == "CANASTA-3P" if parity else kind.isin("CANASTA-3P", "TIRO3-FALLADO")
    fta = kind == "CANASTA-1P" if parity else kind.isin("CANASTA-1P", "TIRO1-FALLADO")
    free = kind == "FALTA-RECIBIDA" if parity else fta
    poss = fga.cast("int") - (kind == "REBOTE-OFENSIVO").cast("int") + (kind == "PERDIDA").cast("int") + 0.44 * free.cast("int")
    same = F.lit(True)
    for k in game:
        same = same & (F.col(f"e.{k}") == F.col(f"l.{k}"))
    span = (F.col("e.n") > F.col("l.n_from")) & (F.col("l.n_to").isNull() | (F.col("e.n") <= F.col("l.n_to")))
    joined = lineups.alias("l").join(events.alias("e"), same & span, "left")
    count = lambda c, who, name: F.count_if(who & c).alias(name)
    return joined.groupBy(*(F.col(f"l.{k}").alias(k) for k in (*game, "side", "n_from", "n_to", "seconds", "lineup"))).agg(
        F.sum(F.when(own, points(kind)).otherwise(0)).alias("pts"),
        F.sum(F.when(other, points(kind)).otherwise(0)).alias("opp_pts"),
        F.sum(F.when(own, poss).otherwise(0.0)).alias("poss"),
        F.sum(F.when(other, poss).otherwise(0.0)).alias("opp_poss"),
        count(fga, own, "fga"), count(made, own, "fgm"), count(fg3a, own, "fg3a"), count(fta, own, "fta"), count(kind == "PERDIDA", own, "tov"), count(kind == "ASISTENCIA", own, "ast"),
    )


def lineup_ratings(facts: DataFrame, group: Sequence[str] = (*KEYS, "side"), least_minutes: float | None = 3.0) -> DataFrame:
    """Ratings and rates per lineup; ratios are null only for zero denominators."""
    cols = ("pts", "opp_pts", "poss", "opp_poss", "fga", "fgm", "fg3a", "fta", "tov", "ast", "seconds")
    out = facts.groupBy(*group, "lineup").agg(*(F.sum(c).alias(c) for c in cols), F.count_distinct("game").alias("games"))
    out = out.withColumns(
        {
            "label": lineup_label("lineup"), "minutes": F.col("seconds") / 60.0, "ortg": 100 * ratio("pts", "poss"), "drtg": 100 * ratio("opp_pts", "opp_poss"), "tov_pct": ratio("tov", "poss"),
            "fg3_share": ratio("fg3a", "fga"), "ft_rate": ratio("fta", "fga"), "ast_pct": ratio("ast", "fgm"), "poss_per_game": ratio("poss", "games"),
        }
    ).withColumn("net", F.col("ortg") - F.col("drtg"))
    return out if least_minutes is None else out.where(F.col("minutes") >= least_minutes)


def top_lineups(ratings: DataFrame, group: Sequence[str] = (*KEYS, "side"), n: int = 5, least_minutes: float = 5.0) -> DataFrame:
    """The best by net rating and the most used, with a column list saying which."""
    rows = ratings.where(F.col("minutes") >= least_minutes)
    by = lambda name, col: rows.where(F.col(col).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(col), "label"))).where(F.col("rank") <= n).withColumn("list", F.lit(name))
    return by("net", "net").unionByName(by("minutes", "minutes"))
