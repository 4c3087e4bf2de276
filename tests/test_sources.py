from pyspark.sql import functions as F

from tablero.sources import extract, tables
from tablero.streaming import ingest_stream

PAGES = "league string, page_kind string, game_id string, url string, html string"


def page(kind, html, game="g1==", league="nacional", url="u"):
    return (league, kind, game, url, html)


def test_fixture_page(spark):
    row = '<tr><td></td><td>BOCA</td><td>{}</td><td>80</td><td>OBERÁ</td><td></td><td>05/11/2024 21:00Polideportivo</td><td><a href="/liga/partido/{}/boca-vs-obera">ver</a></td></tr>'
    html = "<table>" + row.format("90", "AB==") + row.format("-", "CD==") + row.format("1", "AB==") + '<tr><td>06/11/2024</td><td><a href="/liga/partido/EF==/a-vs-b">x</a></td></tr></table>'
    got = {r["game"]: r for r in extract.fixtures(spark.createDataFrame([page("fixture", html)], PAGES)).collect()}
    assert set(got) == {"AB==", "CD==", "EF=="}
    assert (got["AB=="]["home"], got["AB=="]["home_score"], got["AB=="]["away_score"], got["AB=="]["stadium"], got["AB=="]["date_text"]) == ("BOCA", 90, 80, "Polideportivo", "05/11/2024")
    assert got["CD=="]["home_score"] is None and got["EF=="]["date_text"] == "06/11/2024" and got["EF=="]["home"] is None


def test_stats_page(spark):
    def team(name, cells, total):
        body = "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr><tr>" + "".join(f"<th>{c}</th>" for c in total) + "</tr>"
        return f'<p>{name}</p><p>Entrenador: X</p><div class="table-responsive"><table>{body}</table></div>'

    player = ["*7", "PEREZ, JUAN", "30:15", "20", "504/8", "251/4", "00/3", "5", "2", "7", "4", "1", "3", "0", "1", "2", "6", "22"]
    total = ["Totales", "200:00", "80", "20/40", "8/25", "16/20", "25", "10", "35", "18", "7", "12", "2", "3", "20", "21", "90"]
    html = "<div>" + team("HURACAN (LH)", player, total) + team("BOCA", player, total) + "</div>"
    rows = extract.box_scores(spark.createDataFrame([page("stats", html), page("stats", "<p>nothing</p>", "g2")], PAGES)).orderBy("is_home", "is_total").collect()
    assert len(rows) == 4
    home = [r for r in rows if r["is_home"]]
    assert {r["team"] for r in home} == {"HURACAN (LH)"} and {r["rival"] for r in home} == {"BOCA"}
    p = next(r for r in home if not r["is_total"])
    assert (p["player"], p["jersey"], p["starter"], p["seconds"], p["fg2m"], p["fg2a"], p["fg3m"], p["ftm"], p["rating"]) == ("JUAN PEREZ", 7, True, 1815, 4, 8, 1, 0, 22)
    t = next(r for r in home if r["is_total"])
    assert (t["pts"], t["fg2m"], t["fg3a"], t["fta"], t["orb"]) == (80, 20, 25, 20, 10)


def test_live_page_is_reversed_and_filled(spark):
    def li(kind, num, side, body):
        return f'<li class="accion {kind} {side} accion-{num}"><div class="informacion">{body}</div></li>'

    basket = '<strong class="titulo">x <span>#10</span></strong><span class="informacion">DIAZ</span><span class="informacion">Cuarto 1 - 00:09:10</span><strong class="informacionAdicional">2 - 0</strong>'
    html = "<ul>" + li("FINAL-PERIODO", 3, "", '<strong class="titulo">Final <span>1</span></strong>') + li("CANASTA-2P", 2, "local", basket) + li("INICIO-PARTIDO", 1, "", "<strong class='titulo'>Inicio</strong>") + "</ul>"
    rows = extract.actions(spark.createDataFrame([page("live", html)], PAGES)).orderBy("seq").collect()
    assert [r["kind"] for r in rows] == ["INICIO-PARTIDO", "CANASTA-2P", "FINAL-PERIODO"]
    assert (rows[0]["home_score"], rows[2]["home_score"], rows[2]["period"], rows[2]["jersey"]) == (0, 2, 1, None)
    assert (rows[1]["jersey"], rows[1]["player"], rows[1]["period"], rows[1]["clock_text"], rows[1]["side"]) == (10, "DIAZ", 1, "09:10", "LOCAL")


def test_shot_page(spark):
    shot = '{{"accion_tipo": "{}", "posicion_x": "{}", "posicion_y": "10%", "local": {}, "dorsal": "7", "numero_periodo": "1", "zona": "Z1-DE"}}'
    good = "var tiros = [" + ",".join([shot.format("CANASTA-3P", "12.5%", "true"), shot.format("TIRO2-FALLADO", "50%", "false"), shot.format("PERDIDA", "1%", "true"), shot.format("CANASTA-2P", "", "true")]) + "];"
    pages = spark.createDataFrame([page("shots", f"<script>{good}</script>"), page("shots", "var tiros = [{bad];", "g2")], PAGES)
    games = spark.createDataFrame([("nacional", "g1==", "H", "A")], "league string, game string, home string, away string")
    rows = extract.shots(pages, games).orderBy("kind").collect()
    assert [(r["kind"], r["result"], r["team"], r["left_pct"]) for r in rows] == [("TIRO2", "FALLADO", "A", 50.0), ("TIRO3", "CONVERTIDO", "H", 12.5)]


def test_player_pages(spark):
    anchor = '<a class="x" href="/liga/jugador/9/ana"><span class="nombre-jugador-nowrap">A. Paz</span></a>'
    profile = "<title>Ana Paz | La Liga</title><h5><strong>Fecha de nacimiento:</strong> 01/02/1999</h5>"
    pages = spark.createDataFrame([page("player_list", anchor, league="b"), page("player_list", anchor, league="a"), page("profile", profile, url="/liga/jugador/9/ana")], PAGES)
    rows = extract.players(pages, ["a", "b"]).collect()
    assert [(r["league"], r["full_name"], r["short_name"], r["birth_date"]) for r in rows] == [("a", "ANA PAZ", "A. Paz", "01/02/1999")]


def test_fixture_layouts_by_name(spark, tmp_path):
    a, b, c = (tmp_path / f"{n}.csv" for n in "abc")
    a.write_text("﻿fecha,hora,local,visitante,estadio\n05/11/2024,21:00,BOCA,OBERA,X\n", encoding="utf-8")
    b.write_text("local,visitante,fecha,hora,estadio\nFERRO,BOCA,31/31/2024,20:00,\n", encoding="utf-8")
    c.write_text("local,visitante,fecha,hora,estadio\n", encoding="utf-8")
    rows = tables.read_fixtures(spark, [f"file://{p}" for p in (a, b, c)]).orderBy("home").collect()
    assert [(r["home"], r["away"], str(r["date"])) for r in rows] == [("BOCA", "OBERA", "2024-11-05"), ("FERRO", "BOCA", "None")]
    assert tables.read_fixtures(spark, []).count() == 0


def test_box_csv(spark, tmp_path):
    f = tmp_path / "box.csv"
    f.write_text("﻿Fecha,Condicion equipos,Equipo,Nombre completo,Número Camiseta,Puntos,Ganado,IdPartido,Etapa\n05/11/2024,LOCAL,BOCA,TOTALES,,80,True,g==,regular\n05/11/2024,LOCAL,BOCA,ANA,7.0,x,True,g==,regular\n05/11/2024,LOCAL,BOCA,ANA,7.0,3,True,h==,otro\n", encoding="utf-8")
    rows = tables.read_box(spark, f"file://{f}", "nacional").orderBy("is_total").collect()
    assert [(r["player"], r["jersey"], r["pts"], r["is_total"], r["is_home"], str(r["date"])) for r in rows] == [("ANA", 7, 0, False, True, "2024-11-05"), ("TOTALES", None, 80, True, True, "2024-11-05")]


def test_ingest_is_idempotent(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "league string, game string, x int"
    first = spark.createDataFrame([("n", "g1", 1), ("n", "g1", 1), ("n", "g2", 2)], schema)
    first.write.parquet(f"{base}/landing")
    typed = first.schema
    for _ in range(2):
        ingest_stream(spark, f"{base}/landing", typed, f"{base}/target", f"{base}/offsets").awaitTermination()
        assert spark.read.parquet(f"{base}/target").count() == 2
    spark.createDataFrame([("n", "g2", 9), ("n", "g3", 3)], schema).write.mode("append").parquet(f"{base}/landing")
    ingest_stream(spark, f"{base}/landing", typed, f"{base}/target", f"{base}/offsets").awaitTermination()
    assert sorted((r["game"], r["x"]) for r in spark.read.parquet(f"{base}/target").collect()) == [("g1", 1), ("g2", 2), ("g3", 3)]


def test_merge_aligns_types_and_blocklist(spark):
    old = spark.createDataFrame([("n", "g1", 1)], "league string, game string, pts int")
    new = spark.createDataFrame([("n", "g1", "9"), ("n", "g2", "7")], "league string, game string, pts string")
    assert sorted((r["game"], r["pts"]) for r in tables.merged(old, new).collect()) == [("g1", 1), ("g2", 7)]
    games = spark.createDataFrame([("n", "a", 1, 2), ("n", "b", None, 2), ("n", "c", 1, 2)], "league string, game string, home_score int, away_score int")
    blocked = spark.createDataFrame([("n", "c")], "league string, game string")
    assert [r["game"] for r in tables.without_blocked(games, blocked).collect()] == ["a"]
    assert tables.new_rows(new, old).agg(F.count("*")).first()[0] == 1


def test_plain_pages_are_read_as_by_the_parser():
    import random

    from tablero.sources import extract

    rng, pieces = random.Random(3), ["<div class='a b'>", "</div>", "<p>", "</p>", "<b id=\"x&amp;y\" class=\"\">", "</b>", "text ", "&amp;&lt", " <br> ", "<TR>", "</tr>", "<td hidden>", "</td>", "<a href=\"/partido/1/a-vs-b\">", "</a>", "\n", "é", "<hr >"]
    odd = ["<!-- x -->", "<script>var a = '<p>';</script>", "a < b", "<br/>", "<p/>", "<a href=x>", "<title>T</title>", "<a b='>'>", "<"]
    for i in range(3000):
        html = "".join(rng.choice(pieces) if rng.random() < 0.98 or i % 2 else rng.choice(odd) for _ in range(rng.randrange(40)))
        assert extract._elements(html) == extract._parsed(html), html


def test_rows_of_many_pages_come_in_small_frames(monkeypatch):
    import pandas as pd

    from tablero.sources import extract

    monkeypatch.setattr(extract, "MOST_ROWS", 10)
    pages = pd.DataFrame({"league": ["l"] * 50, "game_id": [str(i) for i in range(50)], "html": ["x"] * 50})
    got = list(extract._cells([pages], lambda html: [(1,), (2,), (3,)], ["n"]))
    assert max(map(len, got)) <= 12 and sum(map(len, got)) == 150


def test_plain_rows_of_a_box_page_are_read_at_once(monkeypatch):
    from tablero.sources import extract

    row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    players = "".join(row("td", [f"*{k}", f" Parte{k}, P ", "12:30", *range(15)]) for k in range(40))
    box = lambda team, rows: f'<h4>{team}</h4><div>Entrenador: X</div><div class="table-responsive"><table>{rows}</table></div>'
    pages = [
        box("EQUIPO (O)", players + row("th", ["TOTALES", "200:00", *range(15)])) + box("EQUIPO (F)", row("th", ["A"]) + players),
        box("UNO", "<tr><td>a</td><th>Total</th><td></td></tr><tr><td> b </td></tr>") + box("DOS", "<tbody>" + players + "</tbody>"),
        box("UNO", "<tr>\n<td>a</td></tr>" + row("td", ["x &amp; y", "<b>z</b>", "5 > 3"]) + row("td", ["q"])),
        "<table>" + row("td", ["EQUIPO"]) + "<tr><td><table>" + row("td", [1, 2]) + "</table></td></tr></table><table>" + row("th", ["TOTAL", 3]) + "</table>",
        "<h4>UNO</h4><tr><td>EQUIPO DOS</td></tr><table>" + row("td", ["a"]) + "</table><table>" + row("td", ["b"]),
        "<table>" + row("td", ["TOTALES12"]) + "</table><table>" + row("td", ["b"]) + "</table>",
        "<table><tr>" + row("td", ["a"]) + "</tr></table>",
        "<script>x</script>" + box("UNO", players),
    ]
    got = [list(extract.stats_rows(p)) for p in pages]
    assert len(extract._elements(pages[0], rows=True)) < 100 < len(extract._elements(pages[0]))
    real = extract._elements
    monkeypatch.setattr(extract, "_elements", lambda html, rows=False: real(html))
    assert got == [list(extract.stats_rows(p)) for p in pages] and sum(map(len, got)) > 160
    monkeypatch.setattr(extract, "_elements", lambda html, rows=False: extract._parsed(html))
    assert got == [list(extract.stats_rows(p)) for p in pages]


def test_generated_methods_stay_within_what_the_jvm_compiles(spark):
    from tablero import session

    session.compiled_methods(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
