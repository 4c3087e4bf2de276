"""Column builders for cells, clocks, names, dates and rates. No Python UDFs; bad input gives null or the stated default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_int(text: ColumnLike) -> Column:
    """Integer or 0."""
    return F.coalesce(F.trim(_c(text)).try_cast("int"), F.lit(0))


_PCT_CELL = r"^\s*(\d+)/(\d+)\s*$"


def pct_cell_parts(cell: ColumnLike) -> tuple[Column, Column]:
    """Of '{pct}{made}/{att}' the digits before the bar and the attempts; steps of ``split_pct_cell`` that are worth a column of their own."""
    return F.regexp_extract(_c(cell), _PCT_CELL, 1), F.regexp_extract(_c(cell), _PCT_CELL, 2).try_cast("int")


def split_pct_cell(cell: ColumnLike) -> Column:
    """'{pct}{made}/{att}' run together: struct(pct, made, att).

    The percentage has 3, 2 or 1 digits; the first width whose value is at most 100 and within 1 of 100 * made / att
    counts. Nothing fitting gives made 0; no attempts give zeros.
    """
    return split_pct_parts(*pct_cell_parts(cell))


def split_pct_parts(left: ColumnLike, attempts: ColumnLike) -> Column:
    """``split_pct_cell`` from the parts of the cell."""
    left, att, zero = _c(left), _c(attempts), F.lit(0)
    cuts = [(F.substring(left, 1, w).try_cast("int"), left.substr(F.lit(w + 1), F.length(left)).try_cast("int")) for w in (3, 2, 1)]
    fits = [(pct <= 100) & made.isNotNull() & (F.abs(F.bround(F.try_divide(100.0 * made, att)) - pct) <= 1) for pct, made in cuts]

    def best(k: int) -> Column:
        out = F.when(F.coalesce(att, zero) == 0, zero)
        for fit, cut in zip(fits, cuts):
            out = out.when(fit, cut[k])
        return out.otherwise(zero)

    return F.struct(best(0).alias("pct"), best(1).alias("made"), F.coalesce(att, zero).alias("att"))


def split_made_att(cell: ColumnLike) -> Column:
    """'made/att': struct(made, att, pct with two decimals, 0 without attempts)."""
    made, att = (F.coalesce(F.get(F.split(_c(cell), "/"), F.lit(k)).try_cast("int"), F.lit(0)) for k in (0, 1))
    return F.struct(made.alias("made"), att.alias("att"), F.coalesce(F.round(F.try_divide(100.0 * made, att), 2), F.lit(0.0)).alias("pct"))


_CLOCK = r"^\s*(\d+):(\d{1,2})\s*$"


def clock_seconds(text: ColumnLike) -> Column:
    """'MM:SS' to seconds, null where it does not match."""
    part = lambda k: F.regexp_extract(_c(text), _CLOCK, k).try_cast("int")
    return part(1) * 60 + part(2)


def clock_seconds_or_zero(text: ColumnLike) -> Column:
    return F.coalesce(clock_seconds(text), F.lit(0))


def clock_minutes(text: ColumnLike) -> Column:
    return clock_seconds(text) / 60.0


def full_name(name: ColumnLike) -> Column:
    """struct(last, first, full) of 'LAST, FIRST' or of words whose last one is the surname."""
    n = F.trim(_c(name))
    words = F.split(n, r"\s+")
    comma = F.instr(n, ",") > 0
    pieces = F.split(n, ",", 2)
    last = F.when(comma, F.trim(F.get(pieces, F.lit(0)))).otherwise(F.element_at(words, -1))
    first = F.when(comma, F.trim(F.get(pieces, F.lit(1)))).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "))
    return F.struct(last.alias("last"), first.alias("first"), F.trim(F.concat_ws(" ", first, last)).alias("full"))


def jersey_number(text: ColumnLike) -> Column:
    """Digits of a jersey cell as an integer, null without any."""
    return F.regexp_replace(_c(text), r"\D", "").try_cast("int")


def jersey_key(text: ColumnLike) -> Column:
    """Join key of a jersey that may be stored as '7', '7.0' or 7."""
    return _c(text).cast("string").try_cast("double").cast("int")


def is_starter(text: ColumnLike) -> Column:
    return F.coalesce(F.contains(_c(text), F.lit("*")), F.lit(False))


_DATE_STADIUM = r"^\s*(\d{2}/\d{2}/\d{4})(?:\s+(\d{2}:\d{2}))?\s*(.*)$"


def date_stadium(text: ColumnLike) -> Column:
    """'DD/MM/YYYY HH:MM{stadium}': struct(date, time, stadium)."""
    part = lambda k: F.nullif(F.trim(F.regexp_extract(_c(text), _DATE_STADIUM, k)), F.lit(""))
    return F.struct(part(1).alias("date"), part(2).alias("time"), part(3).alias("stadium"))


_PERIOD_CLOCK = r"(\d+)\s*-\s*(?:\d{1,2}:)?(\d{1,2}:\d{2})\s*$"


def period_clock(text: ColumnLike) -> Column:
    """'Cuarto N - [HH:]MM:SS': struct(period, clock)."""
    return F.struct(
        F.regexp_extract(_c(text), _PERIOD_CLOCK, 1).try_cast("int").alias("period"),
        F.nullif(F.regexp_extract(_c(text), _PERIOD_CLOCK, 2), F.lit("")).alias("clock"),
    )


def score_pair(text: ColumnLike) -> Column:
    """'a - b' with a hyphen or an en dash: struct(home, away)."""
    part = lambda k: F.regexp_extract(_c(text), "^\\s*(\\d+)\\s*[-–]\\s*(\\d+)\\s*$", k).try_cast("int")
    return F.struct(part(1).alias("home"), part(2).alias("away"))


def won(local: ColumnLike, home_score: ColumnLike, away_score: ColumnLike) -> Column:
    """Did the side win? A missing score gives false."""
    return F.coalesce(F.when(_c(local), _c(home_score) > _c(away_score)).otherwise(_c(away_score) > _c(home_score)), F.lit(False))


def day_first(text: ColumnLike) -> Column:
    return F.try_to_timestamp(_c(text), F.lit("d/M/yyyy")).cast("date")


def season_label(date: ColumnLike) -> Column:
    """July to June: '2023/2024'."""
    y = F.year(_c(date))
    return F.when(F.month(_c(date)) < 7, F.concat(y - 1, F.lit("/"), y)).otherwise(F.concat(y, F.lit("/"), y + 1))


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den, null for a zero denominator."""
    return F.try_divide(_c(num).cast("double"), _c(den))


def per_40(stat: ColumnLike, minutes: ColumnLike) -> Column:
    return ratio(stat, minutes) * 40


def possessions(fga: ColumnLike, orb: ColumnLike, tov: ColumnLike, fta: ColumnLike, floor: float | None = None) -> Column:
    """FGA - ORB + TOV + 0.44 FTA, optionally not below ``floor`` (the model uses 1)."""
    p = _c(fga) - _c(orb) + _c(tov) + 0.44 * _c(fta)
    return p if floor is None else F.greatest(p, F.lit(float(floor)))


def efg(fgm: ColumnLike, fg3m: ColumnLike, fga: ColumnLike) -> Column:
    return ratio(_c(fgm) + 0.5 * _c(fg3m), fga)


def true_shooting(pts: ColumnLike, fga: ColumnLike, fta: ColumnLike) -> Column:
    return ratio(pts, 2 * (_c(fga) + 0.44 * _c(fta)))


def zone_number(zone: ColumnLike) -> Column:
    """'Z11-IZ' gives 11, a zone without number 0, null stays null."""
    n = F.regexp_extract(_c(zone), r"^Z(\d+)", 1).try_cast("int")
    return F.when(_c(zone).isNotNull(), F.coalesce(n, F.lit(0)))


def shot_action(code: ColumnLike) -> Column:
    """'T2C' or 'TIRO2-CONVERTIDO' forms: struct(kind TIROn, result); others null."""
    n = F.nullif(F.regexp_extract(_c(code), r"^(?:TIRO|T)([123])", 1), F.lit(""))
    made = F.when(F.upper(_c(code)).rlike(r"(CONVERTIDO|C)$"), "CONVERTIDO").when(F.upper(_c(code)).rlike(r"(FALLADO|F)$"), "FALLADO")
    both = n.isNotNull() & made.isNotNull()
    return F.struct(F.when(both, F.concat(F.lit("TIRO"), n)).alias("kind"), F.when(both, made).alias("result"))


def percent_value(text: ColumnLike) -> Column:
    """'12.3%' to 12.3."""
    return F.regexp_extract(_c(text), r"^\s*(-?\d+(?:\.\d+)?)\s*%", 1).try_cast("double")


def elapsed_seconds(period: ColumnLike, clock: ColumnLike, overtime: int = 300, regulation: int = 600) -> Column:
    """Game seconds gone at a clock that counts down; overtime=600 repeats the fixed period length."""
    p = _c(period)
    before = F.least(p - 1, F.lit(4)) * regulation + F.greatest(p - 5, F.lit(0)) * overtime
    return before + F.when(p <= 4, regulation).otherwise(overtime) - _c(clock)


def lineup_label(players: ColumnLike) -> Column:
    """Surnames of a lineup joined by ' / '."""
    return F.array_join(F.transform(_c(players), lambda p: F.trim(F.get(F.split(p, ","), F.lit(0)))), " / ")


def acting_team(side: ColumnLike, home: ColumnLike, away: ColumnLike) -> Column:
    """The home team on LOCAL, else the away team."""
    return F.when(_c(side) == "LOCAL", _c(home)).otherwise(_c(away))


def shown(value: ColumnLike, decimals: int = 1, percent: bool = False) -> Column:
    """Display text: a dash for null."""
    return F.coalesce(F.concat(F.format_number(_c(value), decimals), F.lit("%" if percent else "")), F.lit("—"))


def team_key(name: ColumnLike) -> Column:
    """Accent-free team name for joins across sources."""
    return F.translate(F.upper(F.trim(_c(name))), "ÁÉÍÓÚÜ", "AEIOUU")
