"""Small dimension tables: event kinds, shot zones, report periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import zone_number

#: The event vocabulary (points, possession weight, marks).
EVENTS = [
    # kind, points, possession weight, field goal, made, free throw, boundary
    ("CANASTA-1P", 1, 0.44, False, True, True, False),
    ("CANASTA-2P", 2, 1.0, True, True, False, False),
    ("CANASTA-3P", 3, 1.0, True, True, False, False),
    ("TIRO1-FALLADO", 0, 0.44, False, False, True, False),
    ("TIRO2-FALLADO", 0, 1.0, True, False, False, False),
    ("TIRO3-FALLADO", 0, 1.0, True, False, False, False),
    ("PERDIDA", 0, 1.0, False, False, False, False),
    ("REBOTE-OFENSIVO", 0, 0.0, False, False, False, False),
    ("REBOTE-DEFENSIVO", 0, 0.0, False, False, False, False),
    ("ASISTENCIA", 0, 0.0, False, False, False, False),
    ("FALTA-RECIBIDA", 0, 0.0, False, False, False, False),
    ("CAMBIO-JUGADOR-ENTRA", 0, 0.0, False, False, False, False),
    ("CAMBIO-JUGADOR-SALE", 0, 0.0, False, False, False, False),
    ("INICIO-PARTIDO", 0, 0.0, False, False, False, True),
    ("FINAL-PARTIDO", 0, 0.0, False, False, False, True),
    ("INICIO-PERIODO", 0, 0.0, False, False, False, True),
    ("FINAL-PERIODO", 0, 0.0, False, False, False, True),
]


def event_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENTS, "tipo string, points int, poss_weight double, is_fg boolean, is_made boolean, is_ft boolean, is_boundary boolean")


def zone_category(zone: Column | str, rules: str = "report") -> Column:
    """paint, mid or triple. Rule sets: model (Z1 and FRANJA paint, Z10-Z14 triple, the rest and null mid), report (up to
    Z5 and FRANJA paint, up to Z10 mid, above triple, null stays null), document (as report, but Z11-Z14 triple only)."""
    z = F.col(zone) if isinstance(zone, str) else zone
    n, band = zone_number(z), z.startswith("FRANJA")
    if rules == "model":
        return F.when((n == 1) | band, "paint").when(n.between(10, 14), "triple").otherwise("mid")
    if rules == "report":
        return F.when(z.isNull(), None).when(band | (n <= 5), "paint").when(n <= 10, "mid").otherwise("triple")
    if rules == "document":
        return F.when(z.isNull(), None).when(band | (n <= 5), "paint").when(n.between(11, 14), "triple").otherwise("mid")
    raise ValueError(f"unknown zone rules {rules!r}")


def period_dim(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(league, season, team, label, date_from, date_to, last_k); open ends are null."""
    return spark.createDataFrame(rows, "league string, season string, team string, label string, date_from date, date_to date, last_k int")
