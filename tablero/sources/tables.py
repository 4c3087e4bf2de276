"""Reading and writing the fact tables, fixtures, predictions and profiles; incremental batch ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day_first, jersey_key, safe_int

#: The source columns of the three fact tables and the silver names they get.
BOX_COLUMNS = {
    "Fecha": "date", "Condicion equipos": "side", "Equipo": "team", "Rival": "rival", "Número Camiseta": "jersey", "Apellido": "last_name", "Nombre": "first_name", "Nombre completo": "player",
    "Segundos jugados": "seconds", "Tiempo jugado (mm:ss)": "time_played", "Puntos": "pts", "T2A": "fg2m", "T2I": "fg2a", "T2%": "fg2_pct", "T3A": "fg3m", "T3I": "fg3a", "T3%": "fg3_pct",
    "T1A": "ftm", "T1I": "fta", "T1%": "ft_pct", "DReb": "drb", "OReb": "orb", "TReb": "trb", "Asistencias": "ast", "Recuperos": "stl", "Perdidas": "tov", "Tapones cometidos": "blk",
    "Tapones recibidos": "blk_against", "Faltas Cometidas": "pf", "Faltas Recibidas": "fouls_drawn", "Valoracion": "rating", "Ganado": "won", "Estadio": "stadium", "IdPartido": "game", "Etapa": "stage", "Titular": "starter",
}
PBP_COLUMNS = {
    "IdPartido": "game", "Fecha": "date", "Equipo_local": "home", "Equipo_visitante": "away", "NumAccion": "num", "Tipo": "kind", "Equipo_lado": "side", "Dorsal": "jersey", "Jugador": "player",
    "Periodo": "period", "Tiempo": "clock_text", "Marcador_local": "home_score", "Marcador_visitante": "away_score",
}
SHOT_COLUMNS = {
    "IdPartido": "game", "Fecha": "date", "Equipo_local": "home", "Equipo_visitante": "away", "Local": "is_home", "Equipo": "team", "Dorsal": "jersey", "Periodo": "period", "Tipo": "kind",
    "Resultado": "result", "Zona": "zone", "Left_pct": "left_pct", "Top_pct": "top_pct",
}
_INTS = {"seconds", "pts", "fg2m", "fg2a", "fg3m", "fg3a", "ftm", "fta", "drb", "orb", "trb", "ast", "stl", "tov", "blk", "blk_against", "pf", "fouls_drawn", "rating"}
_FLOATS = {"fg2_pct", "fg3_pct", "ft_pct", "left_pct", "top_pct"}
_BOOLS = {"won", "starter", "is_home"}
_NULLABLE_INTS = {"num", "period", "home_score", "away_score"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by header (Spark strips a byte-order mark)."""
    return spark.read.option("header", True).csv(path)


def typed(raw: DataFrame, columns: dict[str, str], league: str | None = None) -> DataFrame:
    """Named and typed by one mapping; a column that the source lacks is null."""
    def cell(source: str, name: str):
        c = F.col(f"`{source}`") if source in raw.columns else F.lit(None).cast("string")
        if name == "date":
            return day_first(c)
        if name == "jersey":
            return jersey_key(c)
        if name in _INTS:
            return safe_int(c.cast("string"))
        if name in _FLOATS:
            return c.try_cast("double")
        if name in _BOOLS:
            return c.try_cast("boolean")
        return c.try_cast("double").cast("int") if name in _NULLABLE_INTS else c

    out = raw.select(*(cell(s, n).alias(n) for s, n in columns.items()))
    return out if league is None else out.withColumn("league", F.lit(league))


def read_box(spark: SparkSession, path: str, league: str | None = None, stage: str | None = "regular") -> DataFrame:
    """Box rows; TOTALES rows are marked in is_total; only the given stage."""
    box = typed(read_csv(spark, path), BOX_COLUMNS, league).withColumn("is_total", F.upper("player").startswith("TOTALES")).withColumn("is_home", F.col("side") == "LOCAL")
    return box if stage is None else box.where(F.col("stage") == stage)


def read_pbp(spark: SparkSession, path: str, league: str | None = None) -> DataFrame:
    return typed(read_csv(spark, path), PBP_COLUMNS, league)


def read_shots(spark: SparkSession, path: str, league: str | None = None) -> DataFrame:
    return typed(read_csv(spark, path), SHOT_COLUMNS, league)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or any match of a pattern) is there, in the store that Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


FIXTURE = ("fecha", "hora", "local", "visitante", "estadio")


def read_fixtures(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Fixture files of any column order, by name: date, time, home, away, stadium; missing files and files without rows give none."""
    out = None
    for path in paths:
        if not exists(spark, path):
            continue
        one = read_csv(spark, path)
        one = one.select(*((F.col(c) if c in one.columns else F.lit(None).cast("string")).alias(c) for c in FIXTURE))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"{c} string" for c in FIXTURE))
    return out.select(day_first("fecha").alias("date"), F.col("hora").alias("time"), F.col("local").alias("home"), F.col("visitante").alias("away"), F.col("estadio").alias("stadium"))


def known_games(spark: SparkSession, path: str) -> DataFrame:
    """Distinct game ids of a fact table: reads one column."""
    return spark.read.parquet(path).select("game").distinct()


def write_facts(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("league", "season").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predicted fixtures as CSV, in the order of the fixture: fecha, local, visitante, prob_local, prob_visit."""
    export_csv(predictions.select(F.date_format("date", "dd/MM/yyyy").alias("fecha"), "local", "visitante", "prob_local", "prob_visit"), path)


def write_profiles(players: DataFrame, path: str) -> None:
    """Player profiles as CSV: liga, nombre_completo, nombre_abreviado, fecha_nacimiento, url_perfil."""
    names = {"league": "liga", "full_name": "nombre_completo", "short_name": "nombre_abreviado", "birth_date": "fecha_nacimiento", "url": "url_perfil"}
    export_csv(players.select(*(F.col(c).alias(n) for c, n in names.items())), path)


def new_rows(incoming: DataFrame, existing: DataFrame, key: Sequence[str] = ("league", "game")) -> DataFrame:
    """Incoming rows of games that are not known yet, full duplicates folded."""
    return incoming.join(existing.select(*key).distinct(), list(key), "left_anti").dropDuplicates()


def merged(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = ("league", "game"), full_refresh: bool = False) -> DataFrame:
    """Existing and new rows under the existing types; full_refresh keeps only the incoming ones."""
    if full_refresh:
        return incoming.dropDuplicates()
    fresh = new_rows(incoming, existing, key)
    same = fresh.select(*((F.col(f.name).cast(f.dataType) if f.name in fresh.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in existing.schema))
    return existing.unionByName(same)


def without_blocked(games: DataFrame, blocklist: DataFrame, key: Sequence[str] = ("league", "game")) -> DataFrame:
    """Played games (with a score) that are not on the blocklist."""
    return games.where("home_score is not null and away_score is not null").join(blocklist, list(key), "left_anti")
