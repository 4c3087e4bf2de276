from pyspark.sql import functions as F

from tablero import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pct_cells(spark):
    cells = {"251/4": (25, 1, 4), "00/3": (0, 0, 3), "1005/5": (100, 5, 5), "": (0, 0, 0), "504/8": (50, 4, 8), "7/0": (0, 0, 0), "xx/3": (0, 0, 0)}
    for text, want in cells.items():
        got = one(spark, fn.split_pct_cell(F.lit(text)))
        assert (got["pct"], got["made"], got["att"] or 0) == want, text
    for att in range(1, 25):
        for made in range(att + 1):
            pct = round(100 * made / att)
            got = one(spark, fn.split_pct_cell(F.lit(f"{pct}{made}/{att}"))) if att in (3, 7, 24) else None
            assert got is None or (got["made"], got["att"]) == (made, att)


def test_clocks_names_dates(spark):
    assert one(spark, fn.clock_seconds(F.lit("12:05"))) == 725
    assert one(spark, fn.clock_seconds(F.lit("x"))) is None and one(spark, fn.clock_seconds_or_zero(F.lit("x"))) == 0
    assert tuple(one(spark, fn.full_name(F.lit("PEREZ, JUAN JOSE")))) == ("PEREZ", "JUAN JOSE", "JUAN JOSE PEREZ")
    assert tuple(one(spark, fn.full_name(F.lit("JUAN PEREZ")))) == ("PEREZ", "JUAN", "JUAN PEREZ")
    assert tuple(one(spark, fn.date_stadium(F.lit("05/11/2024 21:00Polideportivo")))) == ("05/11/2024", "21:00", "Polideportivo")
    assert tuple(one(spark, fn.period_clock(F.lit("Cuarto 4 - 00:01:33")))) == (4, "01:33") == tuple(one(spark, fn.period_clock(F.lit("Cuarto 4 - 01:33"))))
    assert tuple(one(spark, fn.score_pair(F.lit("121 – 118")))) == (121, 118)
    assert one(spark, fn.season_label(F.lit("2024-06-30").cast("date"))) == "2023/2024" and one(spark, fn.season_label(F.lit("2024-07-01").cast("date"))) == "2024/2025"
    assert str(one(spark, fn.day_first(F.lit("5/11/2024")))) == "2024-11-05" and one(spark, fn.day_first(F.lit("31/31/2024"))) is None


def test_rates(spark):
    """A published card: 18 games, 115/256 twos, 34/123 threes, 96/143 free throws."""
    pts = 2 * 115 + 3 * 34 + 96
    assert pts == 428 and round(pts / 18, 1) == 23.8
    assert round(100 * one(spark, fn.efg(F.lit(149), F.lit(34), F.lit(379))), 1) == 43.8
    assert round(100 * one(spark, fn.true_shooting(F.lit(pts), F.lit(379), F.lit(143))), 1) == 48.4
    assert one(spark, fn.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, fn.possessions(F.lit(0), F.lit(5), F.lit(0), F.lit(0), 1.0)) == 1.0
    assert one(spark, fn.elapsed_seconds(F.lit(5), F.lit(300))) == 2400 and one(spark, fn.elapsed_seconds(F.lit(2), F.lit(0))) == 1200
    assert one(spark, fn.jersey_key(F.lit("7.0"))) == 7 == one(spark, fn.jersey_number(F.lit("*7")))
    assert one(spark, fn.zone_number(F.lit("Z11-IZ"))) == 11 and one(spark, fn.zone_number(F.lit("FRANJA-DE"))) == 0
    assert one(spark, fn.shown(F.lit(None).cast("double"))) == "—" and one(spark, fn.shown(F.lit(12.345), 1, True)) == "12.3%"
    assert one(spark, fn.lineup_label(F.array(F.lit("PEREZ, J"), F.lit("DIAZ, A")))) == "PEREZ / DIAZ"
    assert one(spark, fn.team_key(F.lit(" Oberá "))) == "OBERA"
