"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

from ..dims import EVENTS

_KINDS = "[" + ", ".join(f"'{e[0]}'" for e in EVENTS) + "]"
_N = len(EVENTS)

BOX = """
box AS (
  SELECT l_orderkey AS game, l_linestatus AS team, CASE WHEN l_linestatus = 'O' THEN 'F' ELSE 'O' END AS rival, l_linestatus = 'O' AS is_home, l_shipdate::DATE AS date,
         l_partkey AS player, l_suppkey AS supplier, l_quantity::BIGINT * 60 AS seconds, round(l_extendedprice)::BIGINT AS pts, l_quantity::BIGINT AS fg2m, l_quantity::BIGINT + l_linenumber AS fg2a,
         l_linenumber::BIGINT AS fg3m, 2 * l_linenumber::BIGINT AS fg3a, round(l_discount * 100)::BIGINT AS ftm, (round(l_discount * 100) + round(l_tax * 100))::BIGINT AS fta,
         round(l_tax * 100)::BIGINT AS orb, l_linenumber::BIGINT AS drb, l_linenumber::BIGINT AS ast, round(l_tax * 100)::BIGINT AS stl, round(l_discount * 100)::BIGINT AS tov, l_linenumber::BIGINT AS pf
  FROM lineitem)"""
SIDES = BOX + """,
tg AS (
  SELECT game, team, sum(pts)::BIGINT AS pts, sum(fg2m)::BIGINT AS fg2m, sum(fg2a)::BIGINT AS fg2a, sum(fg3m)::BIGINT AS fg3m, sum(fg3a)::BIGINT AS fg3a, sum(ftm)::BIGINT AS ftm, sum(fta)::BIGINT AS fta,
         sum(orb)::BIGINT AS orb, sum(drb)::BIGINT AS drb, sum(ast)::BIGINT AS ast, sum(stl)::BIGINT AS stl, sum(tov)::BIGINT AS tov, sum(pf)::BIGINT AS pf, max(date) AS date, max(rival) AS rival, bool_or(is_home) AS is_home,
         sum(fg2m + fg3m)::BIGINT AS fgm, sum(fg2a + fg3a)::BIGINT AS fga
  FROM box GROUP BY game, team)"""
_POSS = "greatest({0}fga - {0}orb + {0}tov + 0.44::DOUBLE * {0}fta, 1.0::DOUBLE)"
FACTORS = SIDES + f""",
j AS (SELECT a.*, b.pts AS opts, b.fgm AS ofgm, b.fga AS ofga, b.fg3m AS ofg3m, b.fta AS ofta, b.orb AS oorb, b.drb AS odrb, b.tov AS otov,
             {_POSS.format('a.')} AS poss, CASE WHEN b.fga IS NOT NULL THEN {_POSS.format('b.')} END AS oposs
      FROM tg a LEFT JOIN tg b ON a.game = b.game AND a.rival = b.team),
f AS (SELECT *, (fgm + 0.5::DOUBLE * fg3m) / nullif(fga, 0) AS efg_pct, tov / nullif(poss, 0) AS tov_pct, fta / nullif(fga, 0) AS ftr, orb / nullif(orb + odrb, 0) AS orb_pct, drb / nullif(drb + orb, 0) AS drb_pct,
             drb / nullif(drb + oorb, 0) AS drb_pct_opp, 100 * (pts / nullif(poss, 0)) AS ortg, 100 * (opts / nullif(oposs, 0)) AS drtg,
             (ofgm + 0.5::DOUBLE * ofg3m) / nullif(ofga, 0) AS oefg, otov / nullif(oposs, 0) AS otp, ofta / nullif(ofga, 0) AS oftr, odrb / nullif(odrb + orb, 0) AS oorbp, 100 * (opts / nullif(oposs, 0)) AS oortg, 100 * (pts / nullif(oposs, 0)) AS odrtg
      FROM j)"""
GAMES = """
g AS (
  SELECT o_custkey AS team, o_orderkey AS game, o_orderdate::DATE AS date, o_orderstatus AS rival, o_totalprice AS price, round(o_totalprice * 100)::BIGINT AS pts,
         (o_orderkey * 7919) % 40000000 AS opp_pts, round(o_totalprice * 100)::BIGINT % 2 = 0 AS won, o_orderkey % 2 = 0 AS is_home, o_orderpriority AS league
  FROM orders)"""
REST = GAMES + """,
r AS (SELECT *, coalesce(date - lag(date) OVER (PARTITION BY team ORDER BY date, game), 7) AS rest FROM g)"""
ACTIONS = f"""
a0 AS (SELECT event_id AS seq, ts, user_id AS game, json_extract(props, '$.k')::INT AS k, ts::DATE - DATE '2024-01-01' AS day FROM events),
a1 AS (SELECT *, ({_KINDS})[k % {_N} + 1] AS kind, day // 6 + 1 AS period FROM a0),
a2 AS (SELECT seq, ts, game, kind, CASE WHEN regexp_matches(kind, '^(INICIO|FINAL)') THEN NULL WHEN seq % 2 = 0 THEN 'LOCAL' ELSE 'VISITANTE' END AS side,
              CASE WHEN k % 11 > 0 THEN 'P' || (k % 11) END AS player, period::INT AS period,
              (600 - ((floor(epoch(ts))::BIGINT - epoch(TIMESTAMP '2024-01-01')::BIGINT - (period - 1) * 6 * 86400) * 600) // (6 * 86400))::INT AS clock,
              CASE kind WHEN 'CANASTA-1P' THEN 1 WHEN 'CANASTA-2P' THEN 2 WHEN 'CANASTA-3P' THEN 3 ELSE 0 END AS p FROM a1),
act AS (SELECT *, sum(CASE WHEN side = 'LOCAL' THEN p ELSE 0 END) OVER w::BIGINT AS home_score, sum(CASE WHEN side = 'VISITANTE' THEN p ELSE 0 END) OVER w::BIGINT AS away_score,
               CASE side WHEN 'LOCAL' THEN 'home' WHEN 'VISITANTE' THEN 'away' END AS team, CASE side WHEN 'LOCAL' THEN 'away' WHEN 'VISITANTE' THEN 'home' END AS rival,
               row_number() OVER (PARTITION BY game ORDER BY ts, seq) AS n
        FROM a2 WINDOW w AS (PARTITION BY game ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))"""
SHOTS = """
s0 AS (SELECT *, json_extract(props, '$.k')::INT AS k FROM events),
shots AS (SELECT user_id % 20 AS team, CASE WHEN k % 16 = 15 THEN 'FRANJA-DE' WHEN k % 16 = 0 THEN NULL ELSE 'Z' || (k % 16) || CASE WHEN k % 2 = 0 THEN '-DE' ELSE '-IZ' END END AS zone,
                 CASE WHEN event_id % 3 = 0 THEN 'CONVERTIDO' ELSE 'FALLADO' END AS result, CASE WHEN k % 16 > 10 THEN 'TIRO3' ELSE 'TIRO2' END AS kind, k * 1.02::DOUBLE AS top_pct, k % 13 AS jersey FROM s0)"""
ZONES = """
z AS (SELECT *, CASE WHEN zone IS NULL THEN NULL WHEN regexp_matches(zone, '^Z[0-9]+') THEN regexp_extract(zone, '^Z([0-9]+)', 1)::INT ELSE 0 END AS zn, starts_with(zone, 'FRANJA') AS band FROM shots),
zc AS (SELECT *, CASE WHEN zn = 1 OR band THEN 'paint' WHEN zn BETWEEN 10 AND 14 THEN 'triple' ELSE 'mid' END AS model,
              CASE WHEN zone IS NULL THEN NULL WHEN band OR zn <= 5 THEN 'paint' WHEN zn <= 10 THEN 'mid' ELSE 'triple' END AS report,
              CASE WHEN zone IS NULL THEN NULL WHEN band OR zn <= 5 THEN 'paint' WHEN zn BETWEEN 11 AND 14 THEN 'triple' ELSE 'mid' END AS document FROM z)"""
_Q = "pow(1 - 2 / 11::DOUBLE, {})"
STINTS = ACTIONS + """,
subs AS (SELECT game, side, player, n, kind FROM act WHERE kind IN ('CAMBIO-JUGADOR-ENTRA', 'CAMBIO-JUGADOR-SALE')),
st0 AS (SELECT *, lead(n) OVER (PARTITION BY game, side, player ORDER BY n) AS n_out FROM subs),
st AS (SELECT game, side, player, n AS n_in, n_out FROM st0 WHERE kind = 'CAMBIO-JUGADOR-ENTRA'),
cuts AS (SELECT game, side, n FROM subs UNION SELECT game, s.side, n FROM act, (VALUES ('LOCAL'), ('VISITANTE')) s(side) WHERE kind IN ('INICIO-PERIODO', 'FINAL-PERIODO', 'FINAL-PARTIDO')),
seg AS (SELECT game, side, n AS n_from, lead(n) OVER (PARTITION BY game, side ORDER BY n) AS n_to FROM cuts),
lu AS (SELECT seg.game, seg.side, n_from, n_to, list_sort(list_distinct(list(st.player))) AS lineup
       FROM seg JOIN st ON seg.game = st.game AND seg.side = st.side AND n_in <= n_from AND (n_out IS NULL OR n_from < n_out) GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["team_game_box"] = f"WITH {SIDES} SELECT * FROM tg"
    q["four_factors_opponent"] = f"""WITH {FACTORS} SELECT game, team, efg_pct, tov_pct, ftr, orb_pct, drb_pct, drb_pct_opp, ortg, drtg, ortg - drtg AS net_rating, oortg - odrtg AS opp_net_rating, oortg - ortg AS rival_net_rating,
        efg_pct - oefg AS delta_efg_pct, tov_pct - otp AS delta_tov_pct, ftr - oftr AS delta_ftr, orb_pct - oorbp AS delta_orb_pct, (ortg - drtg) - (oortg - odrtg) AS delta_net_rating FROM f"""
    q["rest_days"] = f"WITH {REST} SELECT team, game, rest FROM r"
    q["ewm_form"] = f"""WITH {GAMES}, k AS (SELECT *, {_Q.format('-row_number() OVER (PARTITION BY team ORDER BY date, game)')} AS k FROM g)
        SELECT team, game, round(sum(price * k) OVER w / sum(k) OVER w, 6) AS price_ewm FROM k WINDOW w AS (PARTITION BY team ORDER BY date, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    q["rolling_mean_5"] = f"WITH {GAMES} SELECT team, game, avg(pts) OVER (PARTITION BY team ORDER BY date, game ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pts_last5 FROM g"
    q["moving_average_5"] = f"WITH {GAMES} SELECT team, game, avg(pts) OVER (PARTITION BY team ORDER BY date, game ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS pts_ma5 FROM g"
    back = "row_number() OVER (PARTITION BY team ORDER BY date DESC, game DESC)"
    q["last_k"] = f"WITH {GAMES} SELECT * FROM (SELECT team, game, {back} AS back FROM g) WHERE back <= 5"
    q["ewm_last5"] = f"WITH {GAMES}, b AS (SELECT *, {back} AS back FROM g) SELECT team, round(sum(price * {_Q.format('back - 1')}) / sum({_Q.format('back - 1')}), 6) AS price_now FROM b WHERE back <= 5 GROUP BY team"
    q["team_report"] = f"""WITH {FACTORS}, t AS (SELECT team, count(*) AS games, sum(pts)::BIGINT AS pts, sum(fgm)::BIGINT AS fgm, sum(fga)::BIGINT AS fga, sum(fg2m)::BIGINT AS fg2m, sum(fg2a)::BIGINT AS fg2a, sum(fg3m)::BIGINT AS fg3m, sum(fg3a)::BIGINT AS fg3a,
        sum(fta)::BIGINT AS fta, sum(orb)::BIGINT AS orb, sum(drb)::BIGINT AS drb, sum(ast)::BIGINT AS ast, sum(tov)::BIGINT AS tov, sum(opts)::BIGINT AS opts, sum(oorb)::BIGINT AS oorb, sum(odrb)::BIGINT AS odrb,
        sum(fga - orb + tov + 0.44::DOUBLE * fta) AS poss, sum(ofga - oorb + otov + 0.44::DOUBLE * ofta) AS oposs FROM f WHERE opts IS NOT NULL GROUP BY team)
        SELECT team, games, pts / games AS pts_per_game, (fgm + 0.5::DOUBLE * fg3m) / fga AS efg_pct, fg2a / fga AS fg2_share, fg3a / fga AS fg3_share, fg2m / fg2a AS fg2_pct, fg3m / fg3a AS fg3_pct, fta / fga AS ft_rate,
        100 * (pts / poss) AS ortg, 100 * (opts / oposs) AS drtg, 100 * (pts / poss) - 100 * (opts / oposs) AS net, (poss + oposs) / (2 * games) AS pace, orb / (orb + odrb) AS orb_pct, drb / (drb + oorb) AS drb_pct, tov / poss AS tov_pct, ast / games AS ast_per_game,
        pts / (2 * (fga + 0.44::DOUBLE * fta)) AS ts_pct FROM t"""
    q["record_splits"] = f"WITH {GAMES} SELECT team, is_home, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, avg(pts) AS pts_for, avg(opp_pts) AS pts_against, avg(pts - opp_pts) AS diff FROM g GROUP BY team, is_home"
    q["margins"] = f"WITH {GAMES} SELECT team, avg(pts - opp_pts) FILTER (won) AS win_margin, avg(pts - opp_pts) FILTER (NOT won) AS loss_margin FROM g GROUP BY team"
    q["ranking"] = f"WITH {GAMES}, r AS (SELECT league, team, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM g GROUP BY league, team) SELECT *, rank() OVER (PARTITION BY league ORDER BY wins / (wins + losses) DESC) AS rank FROM r"
    q["against_league"] = f"WITH {GAMES}, p AS (SELECT league, team, sum(pts)::BIGINT AS pts FROM g GROUP BY league, team) SELECT *, avg(pts) OVER (PARTITION BY league) AS league_pts, pts - avg(pts) OVER (PARTITION BY league) AS pts_vs_league FROM p"
    q["win_loss_diff"] = f"WITH {GAMES} SELECT team, avg(pts) FILTER (won) - avg(pts) FILTER (NOT won) AS pts_diff, nullif(count(*) FILTER (won), 0) - nullif(count(*) FILTER (NOT won), 0) AS games_diff FROM g GROUP BY team"
    q["streaks"] = f"""WITH {GAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, game) AS n, row_number() OVER (PARTITION BY team, won ORDER BY date, game) AS m FROM g),
        s AS (SELECT team, won, n - m AS run, count(*) AS len, max(n) AS last FROM n GROUP BY team, won, run)
        SELECT team, arg_max(CASE WHEN won THEN len ELSE -len END, last) AS current_streak, coalesce(max(len) FILTER (won), 0) AS longest_wins, coalesce(max(len) FILTER (NOT won), 0) AS longest_losses FROM s GROUP BY team"""
    q["rest_buckets"] = f"WITH {REST} SELECT CASE WHEN rest <= 1 THEN 'b2b' WHEN rest = 2 THEN '1' ELSE '2+' END AS bucket, count(*) AS games, count(*) FILTER (won) AS wins FROM r GROUP BY 1"
    q["bursts"] = f"""WITH {GAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, game) - row_number() OVER (PARTITION BY team, rival ORDER BY date, game) AS run FROM g)
        SELECT team, rival, count(*) AS games, min(date) AS first, max(date) AS last FROM n GROUP BY team, rival, run HAVING count(*) >= 2"""
    q["player_season"] = f"""WITH {BOX}, y AS (SELECT *, CASE WHEN month(date) < 7 THEN (year(date) - 1) || '/' || year(date) ELSE year(date) || '/' || (year(date) + 1) END AS season FROM box)
        SELECT player, season, arg_max(supplier, (date, game, supplier)) AS team, count(DISTINCT game) AS games, sum(seconds) / 60.0::DOUBLE AS minutes, sum(pts)::BIGINT AS pts, sum(fg3a)::BIGINT AS fg3a, sum(tov)::BIGINT AS tov FROM y GROUP BY player, season HAVING sum(seconds) / 60.0::DOUBLE >= 100"""
    q["zscore"] = "SELECT c_custkey, round(coalesce((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0), 0), 6) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)"
    q["similar_topk"] = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT a.label AS season, a.vec_id AS player, b.vec_id AS "match", list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY season, player ORDER BY score DESC, "match") AS rank FROM s) SELECT season, player, "match", round(score, 6) AS score, rank FROM r WHERE rank <= 3"""
    filled = lambda s: f"coalesce(last_value(CASE WHEN kind LIKE 'CANASTA%' THEN {s} END IGNORE NULLS) OVER (PARTITION BY game ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS {s}"
    q["score_ffill"] = f"WITH {ACTIONS} SELECT seq, {filled('home_score')}, {filled('away_score')} FROM act"
    quarters = """e AS (SELECT game, period, arg_max(home_score, n) AS home_score, arg_max(away_score, n) AS away_score FROM act WHERE kind = 'FINAL-PERIODO' AND period BETWEEN 1 AND 4 GROUP BY game, period),
        qd AS (SELECT *, home_score - coalesce(lag(home_score) OVER w, 0) AS home_pts, away_score - coalesce(lag(away_score) OVER w, 0) AS away_pts FROM e WINDOW w AS (PARTITION BY game ORDER BY period))"""
    q["quarter_delta"] = f"WITH {ACTIONS}, {quarters} SELECT * FROM qd"
    q["quarter_points"] = f"WITH {ACTIONS}, {quarters}, b AS (SELECT game % 10 AS team, period, home_pts AS f, away_pts AS a FROM qd UNION ALL SELECT game % 10 + 10, period, away_pts, home_pts FROM qd) SELECT team, period, avg(f) AS pts_for, avg(a) AS pts_against FROM b GROUP BY team, period"
    q["pace_weighted"] = f"""WITH {ACTIONS} SELECT game, team, round(sum(CASE WHEN kind IN ('CANASTA-1P', 'TIRO1-FALLADO') THEN 0.44::DOUBLE ELSE 1.0::DOUBLE END), 6) AS pace FROM act
        WHERE kind IN ('CANASTA-1P', 'CANASTA-2P', 'CANASTA-3P', 'TIRO1-FALLADO', 'TIRO2-FALLADO', 'TIRO3-FALLADO', 'PERDIDA') GROUP BY game, team"""
    q["clutch_net"] = f"""WITH {ACTIONS}, c AS (SELECT * FROM act WHERE kind LIKE 'CANASTA%' AND period = 4 AND clock <= 120 AND abs(home_score - away_score) <= 15),
        u AS (SELECT game, team, p AS f, 0 AS a FROM c UNION ALL SELECT game, rival, 0, p FROM c) SELECT game, team, sum(f)::BIGINT AS clutch_for, sum(a)::BIGINT AS clutch_against, sum(f - a)::BIGINT AS clutch_net FROM u GROUP BY game, team"""
    q["clutch_share"] = f"""WITH {ACTIONS}, c AS (SELECT * FROM act WHERE ((period = 4 AND clock <= 300) OR period >= 5) AND abs(home_score - away_score) <= 15 AND kind IN ('CANASTA-2P', 'CANASTA-3P', 'TIRO2-FALLADO', 'TIRO3-FALLADO')),
        p AS (SELECT game, team, player, count(*) AS fga, count(*) FILTER (kind LIKE 'CANASTA%') AS fgm, count(*) FILTER (kind IN ('CANASTA-3P', 'TIRO3-FALLADO')) AS fg3a, count(*) FILTER (kind = 'CANASTA-3P') AS fg3m FROM c GROUP BY game, team, player)
        SELECT *, (fgm + 0.5::DOUBLE * fg3m) / fga AS efg_pct, fga / sum(fga) OVER (PARTITION BY game, team) AS share FROM p"""
    q["assist_pairs"] = f"""WITH {ACTIONS}, b AS (SELECT a.game, a.n, a.side, a.player AS passer, arg_max({{'s': c.player}}, c.n) AS got FROM act a JOIN act c ON a.game = c.game AND c.n BETWEEN a.n - 4 AND a.n - 1 AND c.side = a.side AND c.kind LIKE 'CANASTA%'
        WHERE a.kind = 'ASISTENCIA' GROUP BY ALL), k AS (SELECT side, passer, got.s AS scorer, count(*) AS assists FROM b WHERE passer IS NOT NULL AND got.s IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY assists DESC, passer, scorer) AS rank FROM k) SELECT * FROM r WHERE rank <= 5"""
    chance = """rb AS (SELECT * FROM act WHERE kind = 'REBOTE-OFENSIVO'),
        en AS (SELECT r.seq, min(t.n) AS stop FROM rb r JOIN act t ON r.game = t.game AND t.n > r.n AND (t.kind IN ('REBOTE-DEFENSIVO', 'FINAL-PERIODO', 'FINAL-PARTIDO') OR (t.side = r.side AND t.kind IN ('PERDIDA', 'CANASTA-2P', 'CANASTA-3P'))) GROUP BY r.seq),
        ch AS (SELECT r.seq, any_value(r.game) AS game, any_value(r.team) AS team, coalesce(sum(t.p) FILTER (t.side = r.side), 0)::BIGINT AS second_chance_pts FROM rb r LEFT JOIN en ON r.seq = en.seq LEFT JOIN act t ON t.game = r.game AND t.n > r.n AND t.n <= coalesce(en.stop, 1e9) GROUP BY r.seq)"""
    q["second_chance"] = f"WITH {ACTIONS}, {chance} SELECT seq, second_chance_pts FROM ch"
    q["rebound_result"] = f"""WITH {ACTIONS}, {chance}, t AS (SELECT game, team, count(*) FILTER (kind = 'REBOTE-OFENSIVO') AS orb, count(*) FILTER (kind = 'PERDIDA') AS odrb, max(CASE WHEN side = 'LOCAL' THEN home_score ELSE away_score END) % 2 = 0 AS won FROM act WHERE side IS NOT NULL GROUP BY game, team),
        c AS (SELECT game, team, count(*) AS chances, sum(second_chance_pts)::BIGINT AS pts FROM ch GROUP BY game, team),
        s AS (SELECT t.team, won, count(*) AS games, sum(orb)::BIGINT AS orb, sum(odrb)::BIGINT AS odrb, sum(coalesce(chances, 0))::BIGINT AS chances, sum(coalesce(c.pts, 0))::BIGINT AS chance_pts FROM t LEFT JOIN c ON t.game = c.game AND t.team = c.team GROUP BY t.team, won)
        SELECT team, won, games, orb, chances, chance_pts, orb / nullif(orb + odrb, 0) AS orb_pct, chance_pts / nullif(chances, 0) AS chance_ppp FROM s"""
    q["after_turnover"] = f"""WITH {ACTIONS}, s AS (SELECT *, last_value(CASE WHEN kind = 'PERDIDA' THEN {{'s': side}} END IGNORE NULLS) OVER w AS turn,
        last_value(CASE WHEN kind IN ('PERDIDA', 'REBOTE-DEFENSIVO', 'CANASTA-2P', 'CANASTA-3P', 'FINAL-PERIODO') THEN kind END IGNORE NULLS) OVER w AS stop FROM act WINDOW w AS (PARTITION BY game ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT game, side, sum(p)::BIGINT AS pts_after_turnover FROM s WHERE stop = 'PERDIDA' AND side <> turn.s AND kind LIKE 'CANASTA%' GROUP BY game, side"""
    q["lineup_segments"] = f"WITH {STINTS} SELECT game, side, n_from, n_to, array_to_string(lineup, ' / ') AS lineup FROM lu"
    att = ", ".join(f"count(*) FILTER (model = '{z}') AS {z}_att, count(*) FILTER (model = '{z}' AND result = 'CONVERTIDO') AS {z}_made" for z in ("paint", "mid", "triple"))
    q["zone_profile"] = f"WITH {SHOTS}, {ZONES}, p AS (SELECT team, count(*) AS shots, {att} FROM zc WHERE top_pct <= 100 GROUP BY team) SELECT *, paint_att / shots AS paint_rate, mid_att / shots AS mid_rate, triple_att / shots AS triple_rate, paint_made / nullif(paint_att, 0) AS paint_efg FROM p"
    q["zone_vs_league"] = f"""WITH {SHOTS}, p AS (SELECT team, zone, count(*) AS att, sum(CASE WHEN result = 'CONVERTIDO' THEN CASE WHEN kind = 'TIRO3' THEN 3 ELSE 2 END ELSE 0 END)::BIGINT AS pts FROM shots WHERE zone IS NOT NULL GROUP BY team, zone)
        SELECT team, zone, att, pts, pts / att AS ppa, sum(pts) OVER (PARTITION BY zone) / sum(att) OVER (PARTITION BY zone) AS league_ppa FROM p"""
    q["jersey_map"] = f"WITH {SHOTS} SELECT team, CASE WHEN jersey <= 9 THEN 'p' || team || '-' || jersey END AS player, count(*) AS shots FROM shots GROUP BY 1, 2"
    q["zone_rules"] = f"WITH {SHOTS}, {ZONES} SELECT zone, model, report, document, count(*) AS n FROM zc GROUP BY ALL"
    q["shot_cell_parse"] = """WITH c AS (SELECT least(l_linenumber, l_quantity::INT) AS m, l_quantity::INT AS a FROM lineitem)
        SELECT m AS made, a AS att, m AS plain_made, round((100 * m)::DOUBLE / a, 2) AS plain_pct, count(*) AS n FROM c GROUP BY ALL"""
    q["name_split"] = """SELECT c_custkey, c_mktsegment AS last_name, c_name AS first_name, c_name || ' ' || c_mktsegment AS full_name FROM customer"""
    q["clock_parse"] = "SELECT event_id, (event_id % 4 + 1)::INT AS period, (minute(ts) * 60 + second(ts))::INT AS seconds, user_id::INT AS home, (event_id % 100)::INT AS away FROM events"
    q["date_stadium"] = """SELECT o_orderkey, o_orderdate::DATE AS date, '21:30' AS time, o_orderpriority AS stadium,
        CASE WHEN month(o_orderdate) < 7 THEN (year(o_orderdate) - 1) || '/' || year(o_orderdate) ELSE year(o_orderdate) || '/' || (year(o_orderdate) + 1) END AS season FROM orders"""
    links = "l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), 1) - 1 AS pos FROM pages)"
    q["link_extract"] = f"WITH {links} SELECT link, count(DISTINCT page_id) AS pages, min(pos) AS first_pos FROM l GROUP BY link"
    q["dedupe_first"] = f"WITH {links}, r AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS n FROM l) SELECT link, page_id, pos FROM r WHERE n = 1"
    q["json_explode"] = "SELECT event_id, pos, json_extract(props, '$.k')::INT AS k FROM events, (VALUES (0), (1)) t(pos)"
    q["incremental_new"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders"
    pos = 'p AS (SELECT *, row_number() OVER (ORDER BY date, game) - 1 AS "at", count(*) OVER () AS rows FROM g)'
    q["time_folds"] = f"""WITH {GAMES}, {pos}, f AS (SELECT *, rows - (5 - fold + 1) * (rows // 6) AS low, rows // 6 AS size FROM p, range(1, 6) r(fold)), x AS (SELECT *, CASE WHEN "at" < low THEN 'train' WHEN "at" < low + size THEN 'test' END AS role FROM f)
        SELECT fold::INT AS fold, role, count(*) AS n, min(date) AS first, max(date) AS last, sum(game)::BIGINT AS games FROM x WHERE role IS NOT NULL GROUP BY fold, role"""
    q["temporal_cut"] = f'WITH {GAMES}, {pos} SELECT game, "at" < floor(rows * 0.75::DOUBLE) AS is_train FROM p'
    q["auc_logloss"] = """WITH s AS (SELECT quality AS y, toxic, n_chars / (n_chars + 1000.0::DOUBLE) AS p FROM labels JOIN documents USING (doc_id)),
        c AS (SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q, (rank() OVER (PARTITION BY toxic ORDER BY p) + rank() OVER (PARTITION BY toxic ORDER BY p) + count(*) OVER (PARTITION BY toxic, p) - 1) / 2.0::DOUBLE AS r FROM s)
        SELECT toxic, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
        round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM c GROUP BY toxic"""
    q["fixture_state_join"] = f"""WITH {GAMES}, b AS (SELECT *, {back} AS back FROM g),
        s AS (SELECT team, max(date) AS last_date, avg(won::INT) FILTER (back <= 5) AS win_last5, sum(price * {_Q.format('back - 1')}) / sum({_Q.format('back - 1')}) AS price_ewm FROM b GROUP BY team)
        SELECT h.team AS home, a.team AS away, greatest(DATE '2001-08-03' - h.last_date, 1)::INT AS rest, greatest(DATE '2001-08-03' - a.last_date, 1)::INT AS opp_rest,
        (greatest(DATE '2001-08-03' - h.last_date, 1) - greatest(DATE '2001-08-03' - a.last_date, 1))::INT AS rest_diff, round(h.win_last5, 6) AS win_last5, round(h.price_ewm, 4) AS price_ewm FROM s h JOIN s a ON a.team = h.team + 1"""
    q["percentile_profile"] = "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS pctile FROM customer"
    q["half_season_trend"] = f"""WITH {GAMES}, h AS (SELECT *, ntile(2) OVER (PARTITION BY team ORDER BY date, game) AS half FROM g)
        SELECT team, avg(pts) FILTER (half = 1) AS first_half, avg(pts) FILTER (half = 2) AS second_half, avg(pts) FILTER (half = 2) - avg(pts) FILTER (half = 1) AS change FROM h GROUP BY team"""
    q["head_to_head"] = f"WITH {FACTORS} SELECT team, rival, count(*) FILTER (pts > opts) AS wins, count(*) FILTER (NOT pts > opts) AS losses FROM f WHERE opts IS NOT NULL AND team = 'O' AND rival = 'F' GROUP BY team, rival"
    q["foul_trouble"] = f"WITH {BOX} SELECT player, avg((pf >= 4)::INT) AS foul_trouble FROM box GROUP BY player"
    q["rotation"] = f"""WITH {BOX}, p AS (SELECT supplier AS team, player, avg(seconds) AS min_per_game FROM box GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY min_per_game DESC, player) AS rank FROM p) SELECT * FROM r WHERE rank <= 8"""
    sides = """b AS (SELECT game, kind, p, team, TRUE AS own FROM x UNION ALL SELECT game, kind, p, rival, FALSE FROM x)"""
    q["overtime_record"] = f"WITH {GAMES}, {ACTIONS} SELECT team, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM g WHERE game % 400 IN (SELECT game FROM act WHERE period >= 5) GROUP BY team"
    q["stretch_points"] = f"WITH {ACTIONS}, x AS (SELECT * FROM act WHERE period = 3 AND clock >= 420 AND kind LIKE 'CANASTA%'), {sides} SELECT game, team, coalesce(sum(p) FILTER (own), 0)::BIGINT AS pts, coalesce(sum(p) FILTER (NOT own), 0)::BIGINT AS opp_pts FROM b GROUP BY game, team"
    q["allowed_zones"] = f"""WITH {SHOTS}, {ZONES} SELECT (team + 1) % 20 AS team, count(*) AS shots, count(*) FILTER (report = 'paint') AS paint_att, count(*) FILTER (report = 'mid') AS mid_att, count(*) FILTER (report = 'triple') AS triple_att,
        count(*) FILTER (report = 'paint' AND result = 'CONVERTIDO') / nullif(count(*) FILTER (report = 'paint'), 0) AS paint_efg FROM zc GROUP BY 1"""
    q["stream_ingest"] = "SELECT user_id AS game, count(*) AS n FROM events GROUP BY user_id"
    return q
