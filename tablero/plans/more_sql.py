"""DuckDB SQL for the queries of ``more``, and for those whose definitions are longer than a line, written from their definitions."""

from __future__ import annotations

from ..operators.similarity import FEATURES, WEIGHTS
from .oracle import _Q, ACTIONS, BOX, FACTORS, GAMES, REST, SHOTS, SIDES, STINTS, ZONES

_FG = "('CANASTA-2P', 'CANASTA-3P', 'TIRO2-FALLADO', 'TIRO3-FALLADO')"
_ELAPSED = "(least(period - 1, 4) * 600 + greatest(period - 5, 0) * 300 + CASE WHEN period <= 4 THEN 600 ELSE 300 END - clock)"
#: Possessions of an event: attempts, free throws and turnovers add, offensive rebounds take away.
_EVENT_POSS = f"(CASE WHEN kind IN {_FG} OR kind = 'PERDIDA' THEN 1.0::DOUBLE WHEN kind = 'REBOTE-OFENSIVO' THEN -1.0::DOUBLE WHEN kind IN ('CANASTA-1P', 'TIRO1-FALLADO') THEN 0.44::DOUBLE ELSE 0 END)"

SEASONS = BOX + """,
y AS (SELECT *, CASE WHEN month(date) < 7 THEN (year(date) - 1) || '/' || year(date) ELSE year(date) || '/' || (year(date) + 1) END AS season FROM box),
ps AS (
  SELECT player, season, arg_max(supplier, (date, game, supplier)) AS team, count(DISTINCT game) AS games, sum(seconds) / 60.0::DOUBLE AS minutes, sum(pts)::BIGINT AS pts, sum(fg2m)::BIGINT AS fg2m, sum(fg2a)::BIGINT AS fg2a, sum(fg3m)::BIGINT AS fg3m,
         sum(fg3a)::BIGINT AS fg3a, sum(ftm)::BIGINT AS ftm, sum(fta)::BIGINT AS fta, sum(orb)::BIGINT AS orb, sum(drb)::BIGINT AS drb, sum(ast)::BIGINT AS ast, sum(stl)::BIGINT AS stl, sum(tov)::BIGINT AS tov
  FROM y GROUP BY player, season HAVING sum(seconds) / 60.0::DOUBLE >= 100),
pf AS (
  SELECT *, pts / minutes * 40 AS pts_40, (fg2a + fg3a) / minutes * 40 AS fga_40, ast / minutes * 40 AS ast_40, (orb + drb) / minutes * 40 AS trb_40, stl / minutes * 40 AS stl_40, 0 / minutes * 40 AS blk_40, tov / minutes * 40 AS tov_40,
         fg3a / minutes * 40 AS fg3a_40, fta / minutes * 40 AS fta_40, (fg2m + fg3m) / nullif(fg2a + fg3a, 0) AS fg_pct, fg3m / nullif(fg3a, 0) AS fg3_pct, ftm / nullif(fta, 0) AS ft_pct, (fg2m + fg3m + 0.5::DOUBLE * fg3m) / nullif(fg2a + fg3a, 0) AS efg_pct,
         pts / nullif(2 * (fg2a + fg3a + 0.44::DOUBLE * fta), 0) AS ts_pct, ast / nullif(tov, 0) AS ast_tov, fg3a / nullif(fg2a + fg3a, 0) AS fg3_rate, fta / nullif(fg2a + fg3a, 0) AS ft_rate, orb / nullif(orb + drb, 0) AS orb_share, drb / nullif(orb + drb, 0) AS drb_share FROM ps),
pz AS (SELECT *, """ + ", ".join(f"coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 0) AS {f}_z" for f in FEATURES) + """ FROM pf),
pv AS (SELECT *, [""" + ", ".join(f"{f}_z * sqrt({WEIGHTS[f]!r}::DOUBLE)" for f in FEATURES) + """] AS v FROM pz)"""
_COS = "coalesce(list_inner_product(a.v, b.v) / nullif(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 0), 0)"
OPPONENTS = FACTORS + ", o AS (SELECT *, pts > opts AS won FROM f WHERE opts IS NOT NULL)"
#: Sums and ratios of a team report; {0} are the grouping columns.
_REPORT = """SELECT {0}, count(*) AS games, sum(pts) / count(*) AS pts_per_game, (sum(fgm) + 0.5::DOUBLE * sum(fg3m)) / sum(fga) AS efg_pct, sum(fg2a) / sum(fga) AS fg2_share, sum(fg3a) / sum(fga) AS fg3_share, sum(fg2m) / sum(fg2a) AS fg2_pct, sum(fg3m) / sum(fg3a) AS fg3_pct,
         sum(fta) / sum(fga) AS ft_rate, 100 * sum(pts) / sum(p) AS ortg, 100 * sum(opts) / sum(op) AS drtg, 100 * sum(pts) / sum(p) - 100 * sum(opts) / sum(op) AS net, (sum(p) + sum(op)) / (2 * count(*)) AS pace, sum(orb) / (sum(orb) + sum(odrb)) AS orb_pct,
         sum(drb) / (sum(drb) + sum(oorb)) AS drb_pct, sum(tov) / sum(p) AS tov_pct, sum(ast) / count(*) AS ast_per_game, sum(pts) / (2 * (sum(fga) + 0.44::DOUBLE * sum(fta))) AS ts_pct
  FROM (SELECT *, fga - orb + tov + 0.44::DOUBLE * fta AS p, ofga - oorb + otov + 0.44::DOUBLE * ofta AS op FROM {1}) GROUP BY {0}"""
_METRICS = ("games", "pts_per_game", "efg_pct", "fg2_share", "fg3_share", "fg2_pct", "fg3_pct", "ft_rate", "ortg", "drtg", "net", "pace", "orb_pct", "drb_pct", "tov_pct", "ast_per_game", "ts_pct")
LINEUPS = STINTS + f""",
ae AS (SELECT *, {_ELAPSED} AS elapsed FROM act),
ends AS (SELECT game, max(elapsed) AS last FROM ae GROUP BY game),
sg AS (SELECT c.game, c.side, c.n AS n_from, coalesce(lead(e.elapsed) OVER (PARTITION BY c.game, c.side ORDER BY c.n), last) - e.elapsed AS seconds FROM cuts c JOIN ae e ON e.game = c.game AND e.n = c.n JOIN ends ON ends.game = c.game),
l2 AS (SELECT lu.*, seconds FROM lu JOIN sg USING (game, side, n_from) WHERE len(list_filter(lineup, lambda x: x IS NOT NULL)) = 2 AND seconds > 0),
se AS (SELECT l2.game, l2.side, l2.n_from, l2.seconds, array_to_string(l2.lineup, ' / ') AS lineup, act.side = l2.side AS own, act.kind, act.p, act.side IS NOT NULL AND act.side <> l2.side AS other
       FROM l2 LEFT JOIN act ON act.game = l2.game AND act.n > l2.n_from AND (l2.n_to IS NULL OR act.n <= l2.n_to)),
fs AS (SELECT game, side, n_from, lineup, any_value(seconds) AS seconds, coalesce(sum(p) FILTER (own), 0) AS pts, coalesce(sum(p) FILTER (other), 0) AS opp_pts, coalesce(sum({_EVENT_POSS}) FILTER (own), 0) AS poss, coalesce(sum({_EVENT_POSS}) FILTER (other), 0) AS opp_poss,
         count(*) FILTER (own AND kind IN {_FG}) AS fga, count(*) FILTER (own AND kind IN ('CANASTA-2P', 'CANASTA-3P')) AS fgm, count(*) FILTER (own AND kind IN ('CANASTA-3P', 'TIRO3-FALLADO')) AS fg3a, count(*) FILTER (own AND kind IN ('CANASTA-1P', 'TIRO1-FALLADO')) AS fta,
         count(*) FILTER (own AND kind = 'PERDIDA') AS tov, count(*) FILTER (own AND kind = 'ASISTENCIA') AS ast FROM se GROUP BY game, side, n_from, lineup),
lr AS (SELECT side, lineup, sum(pts)::BIGINT AS pts, sum(opp_pts)::BIGINT AS opp_pts, sum(poss) AS poss, sum(opp_poss) AS opp_poss, sum(fga)::BIGINT AS fga, sum(fgm)::BIGINT AS fgm, sum(fg3a)::BIGINT AS fg3a, sum(fta)::BIGINT AS fta, sum(tov)::BIGINT AS tov,
         sum(ast)::BIGINT AS ast, count(DISTINCT game) AS games, sum(seconds) / 60.0::DOUBLE AS minutes FROM fs GROUP BY side, lineup),
lx AS (SELECT *, 100 * (pts / nullif(poss, 0)) AS ortg, 100 * (opp_pts / nullif(opp_poss, 0)) AS drtg, 100 * (pts / nullif(poss, 0)) - 100 * (opp_pts / nullif(opp_poss, 0)) AS net FROM lr)"""
QUARTERS = ACTIONS + """,
e AS (SELECT game, period, arg_max(home_score, n) AS home_score, arg_max(away_score, n) AS away_score FROM act WHERE kind = 'FINAL-PERIODO' AND period BETWEEN 1 AND 4 GROUP BY game, period),
qd AS (SELECT *, home_score - coalesce(lag(home_score) OVER w, 0) AS h, away_score - coalesce(lag(away_score) OVER w, 0) AS a FROM e WINDOW w AS (PARTITION BY game ORDER BY period))"""
_EV = """ev AS (
  SELECT p.game, CASE WHEN p.team = 'home' THEN 'O' ELSE 'F' END AS team, p.team AS side, pace, coalesce(clutch_net, 0) AS clutch_net FROM
  (SELECT game, team, sum(CASE WHEN kind IN ('CANASTA-1P', 'TIRO1-FALLADO') THEN 0.44::DOUBLE ELSE 1.0::DOUBLE END) AS pace FROM act WHERE kind IN ('CANASTA-1P', 'CANASTA-2P', 'CANASTA-3P', 'TIRO1-FALLADO', 'TIRO2-FALLADO', 'TIRO3-FALLADO', 'PERDIDA') GROUP BY game, team) p
  LEFT JOIN (SELECT game, team, sum(f - a)::BIGINT AS clutch_net FROM (SELECT game, team, p AS f, 0 AS a FROM c UNION ALL SELECT game, rival, 0, p FROM c) GROUP BY game, team) k ON p.game = k.game AND p.team = k.team)"""
#: Possessions by joins of neighbouring plays: a play is what a side does with the ball, a rebound, or a boundary.
POSSESSIONS = ACTIONS + f""",
pl AS (SELECT *, {_ELAPSED} AS elapsed, row_number() OVER (PARTITION BY game ORDER BY n) AS i, kind IN ('INICIO-PERIODO', 'FINAL-PERIODO', 'FINAL-PARTIDO') AS edge,
              kind IN {_FG} OR kind IN ('CANASTA-1P', 'TIRO1-FALLADO', 'PERDIDA') AS try FROM act
       WHERE kind IN ('INICIO-PERIODO', 'FINAL-PERIODO', 'FINAL-PARTIDO') OR (side IS NOT NULL AND (kind IN {_FG} OR kind IN ('CANASTA-1P', 'TIRO1-FALLADO', 'PERDIDA', 'REBOTE-OFENSIVO', 'REBOTE-DEFENSIVO')))),
ov AS (SELECT a.*, a.edge OR a.kind = 'PERDIDA' OR (a.kind LIKE 'CANASTA%' AND NOT coalesce(b.kind IN ('CANASTA-1P', 'TIRO1-FALLADO') AND b.side = a.side, FALSE)) AS over FROM pl a LEFT JOIN pl b ON b.game = a.game AND b.i = a.i + 1),
bg AS (SELECT a.*, (NOT a.edge AND (b.game IS NULL OR b.over OR a.kind = 'REBOTE-DEFENSIVO' OR a.side IS DISTINCT FROM b.side))::INT AS begins FROM ov a LEFT JOIN ov b ON b.game = a.game AND b.i = a.i - 1),
nm AS (SELECT *, sum(begins) OVER (PARTITION BY game ORDER BY i) AS possession FROM bg),
p0 AS (SELECT game, possession, arg_min(side, i) AS side, arg_min(period, i) AS period, arg_min(kind, i) AS first, arg_min(elapsed, i) AS began, sum(p)::BIGINT AS pts, count(*) FILTER (kind = 'REBOTE-OFENSIVO') AS second_chances,
              arg_min(kind, i) FILTER (try) AS first_try, arg_min(elapsed, i) FILTER (try) AS tried, arg_max(elapsed, i) FILTER (NOT edge) AS ended FROM nm WHERE possession > 0 GROUP BY game, possession),
po AS (SELECT *, tried - CASE WHEN first = 'REBOTE-DEFENSIVO' THEN began WHEN lag(period) OVER w = period THEN lag(ended) OVER w END AS seconds_to_try FROM p0 WINDOW w AS (PARTITION BY game ORDER BY possession))"""
_CLUTCH = "c AS (SELECT * FROM act WHERE kind LIKE 'CANASTA%' AND period = 4 AND clock <= 120 AND abs(home_score - away_score) <= 5)"


def _ewm(metric: str, rows: str = "150") -> str:
    """Weighted mean of the rows before (older ones than ``rows`` weigh less than 1e-13)."""
    q = _Q.format("t.n - s.n")
    return f"sum(s.{metric} * {q}) / sum({q}) FILTER (s.{metric} IS NOT NULL) AS {metric}_ewm"


FEATURE_ROWS = FACTORS + ", " + ACTIONS.strip() + ", " + _CLUTCH + ", " + _EV + ", " + SHOTS.strip() + f""",
z AS (SELECT *, user_id AS game, CASE WHEN k % 16 = 15 THEN 'FRANJA-DE' WHEN k % 16 > 0 THEN 'Z' || (k % 16) END AS zn, event_id % 3 = 0 AS made FROM s0 WHERE k * 1.02::DOUBLE <= 100),
sp AS (SELECT game, CASE WHEN game % 2 = 0 THEN 'O' ELSE 'F' END AS team, count(*) AS shots, count(*) FILTER (zn IN ('Z1', 'FRANJA-DE')) AS att, count(*) FILTER (zn IN ('Z1', 'FRANJA-DE') AND made) AS paint_made FROM z GROUP BY game),
rs AS (SELECT *, coalesce(date - lag(date) OVER (PARTITION BY team ORDER BY date, game), 7) AS rest FROM f),
ft AS (
  SELECT r.game, r.team, r.date, r.is_home::INT AS home, CASE WHEN r.opts IS NOT NULL THEN (r.pts > r.opts)::INT END AS win, r.rest - o.rest AS rest_diff, r.fg3m / nullif(r.fg3a, 0) AS fg3_pct, ev.pace, ev.clutch_net, paint_made / nullif(att, 0) AS paint_efg, att / shots AS paint_rate,
         r.ortg - r.drtg AS net_rating, r.efg_pct, row_number() OVER (PARTITION BY r.team ORDER BY r.date, r.game) AS n,
         avg(CASE WHEN r.opts IS NOT NULL THEN (r.pts > r.opts)::INT END) OVER (PARTITION BY r.team ORDER BY r.date, r.game ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS win_last5
  FROM rs r LEFT JOIN rs o ON r.game = o.game AND r.rival = o.team LEFT JOIN ev ON ev.game = r.game AND ev.team = r.team LEFT JOIN sp ON sp.game = r.game AND sp.team = r.team),
ew AS (SELECT t.game, t.team, {_ewm('net_rating')}, {_ewm('efg_pct')}, {_ewm('fg3_pct')} FROM ft t LEFT JOIN ft s ON s.team = t.team AND s.n < t.n AND s.n >= t.n - 150 GROUP BY t.game, t.team),
pp AS (SELECT * FROM ft WHERE paint_efg IS NOT NULL),
pe AS (SELECT t.game, t.team, sum(s.paint_efg * {_Q.format('t.n - s.n')}) / sum({_Q.format('t.n - s.n')}) AS paint_efg_ewm FROM ft t JOIN pp s ON s.team = t.team AND s.n < t.n AND t.n - s.n < 3000 GROUP BY t.game, t.team)"""


def _prob(cols: dict[str, str]) -> str:
    from .more import FIXED, FIXED_PLATT, FIXED_SCALE
    from ..operators.winprob import PREGAME

    parts = []
    for m, (a, b) in zip(FIXED, FIXED_PLATT):
        terms = " + ".join(f"({w!r}::DOUBLE) * (coalesce({cols[f]}, {FIXED_SCALE[f][0]!r}::DOUBLE) - {FIXED_SCALE[f][0]!r}::DOUBLE) / {FIXED_SCALE[f][1]!r}::DOUBLE" for f, w in zip(PREGAME, m.coefficients))
        parts.append(f"1 / (1 + exp(-({a!r}::DOUBLE * ({m.intercept!r}::DOUBLE + {terms}) + ({b!r}::DOUBLE))))")
    return f"(({' + '.join(parts)}) / {len(parts)})"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["player_features"] = f"WITH {SEASONS} SELECT player, season, {', '.join(FEATURES)}, round(pts_40_z, 6) AS pts_40_z, round(trb_40_z, 6) AS trb_40_z, round(ast_tov_z, 6) AS ast_tov_z FROM pz"
    q["similar_players_all"] = f"""WITH {SEASONS}, s AS (SELECT a.season, a.player, b.player AS "match", {_COS} AS score FROM pv a JOIN pv b ON a.season = b.season AND a.player <> b.player),
        r AS (SELECT *, row_number() OVER (PARTITION BY season, player ORDER BY score DESC, "match") AS rank FROM s) SELECT season, player, "match", round(score, 6) AS score, rank FROM r WHERE rank <= 3"""
    q["similar_players_one"] = f"""WITH {SEASONS}, one AS (SELECT * FROM pv WHERE player = (SELECT min(player) FROM pv) ORDER BY season DESC LIMIT 1),
        s AS (SELECT a.player AS ref_player, b.*, round(100 * {_COS}, 1) AS score FROM one a JOIN pv b ON a.season = b.season AND a.player <> b.player), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, player) AS rank FROM s)
        SELECT ref_player, season, player, rank, score, team, games, minutes, pts_40, ast_40, trb_40, ts_pct, efg_pct FROM r WHERE rank <= 5"""
    items = ", ".join(f"({i}, '{f}', {f}, {f}_z)" for i, f in enumerate(FEATURES))
    q["compare_players"] = f"""WITH {SEASONS}, two AS (SELECT *, dense_rank() OVER (ORDER BY player) AS k, row_number() OVER (PARTITION BY player ORDER BY season DESC) AS r FROM pz),
        l AS (SELECT k, u.* FROM two, LATERAL (VALUES {items}) u(pos, feature, value, z) WHERE k <= 2 AND r = 1),
        d AS (SELECT a.pos, a.feature, a.value::DOUBLE AS value_a, b.value::DOUBLE AS value_b, abs(a.z - b.z) AS dz FROM l a JOIN l b ON a.pos = b.pos WHERE a.k = 1 AND b.k = 2)
        SELECT feature, value_a, value_b, abs(value_a - value_b) AS diff, round(dz, 6) AS diff_z, row_number() OVER (ORDER BY dz, pos) <= 3 AS alike, row_number() OVER (ORDER BY dz DESC, pos) <= 3 AS different FROM d"""
    rank = lambda m: f"round(percent_rank() OVER (PARTITION BY season ORDER BY {m} NULLS FIRST), 6)"
    q["player_profile"] = f"""WITH {SEASONS}, tp AS (SELECT supplier AS team, season, sum(fg2a + fg3a - orb + tov + 0.44::DOUBLE * fta) / count(DISTINCT game) AS poss FROM y GROUP BY ALL),
        g AS (SELECT pf.*, pts / games AS pts_per_game, (fg2a + fg3a + 0.44::DOUBLE * fta + tov) / ((minutes / 40) * poss) AS usg_scaled FROM pf LEFT JOIN tp USING (team, season))
        SELECT player, season, {', '.join(f'{rank(m)} AS {m}_pctile' for m in ('pts_per_game', 'efg_pct', 'ts_pct', 'usg_scaled', 'ast_tov', 'trb_40', 'stl_40', 'blk_40'))}, round(usg_scaled, 6) AS usg_scaled FROM g"""
    q["lineup_facts"] = f"""WITH {LINEUPS} SELECT side, lineup, lineup AS label, pts, opp_pts, fga, fgm, fg3a, fta, tov, ast, games, round(minutes, 6) AS minutes, round(poss, 6) AS poss, round(opp_poss, 6) AS opp_poss, round(ortg, 6) AS ortg, round(drtg, 6) AS drtg, round(net, 6) AS net,
        round(tov / nullif(poss, 0), 6) AS tov_pct, round(fg3a / nullif(fga, 0), 6) AS fg3_share, round(fta / nullif(fga, 0), 6) AS ft_rate, round(ast / nullif(fgm, 0), 6) AS ast_pct, round(poss / games, 6) AS poss_per_game FROM lx"""
    q["top_lineups"] = f"""WITH {LINEUPS}, k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY net DESC, lineup) AS rn, row_number() OVER (PARTITION BY side ORDER BY minutes DESC, lineup) AS rm FROM lx WHERE minutes >= 5),
        kn AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY net DESC, lineup) AS r FROM lx WHERE minutes >= 5 AND net IS NOT NULL)
        SELECT side, 'net' AS list, r AS rank, lineup AS label, round(minutes, 6) AS minutes, round(net, 6) AS net FROM kn WHERE r <= 5 UNION ALL SELECT side, 'minutes', rm, lineup, round(minutes, 6), round(net, 6) FROM k WHERE rm <= 5"""
    q["top_scorers"] = f"WITH {BOX}, p AS (SELECT supplier AS team, player, avg(pts) AS pts_per_game FROM box GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY pts_per_game DESC, player) AS rank FROM p) SELECT * FROM r WHERE rank <= 6"
    q["points_by_origin"] = f"""WITH {ACTIONS}, {SHOTS.strip()}, pk AS (SELECT a.game, a.n AS assist, max(b.n) AS n FROM act a JOIN act b ON b.game = a.game AND b.side = a.side AND b.n BETWEEN a.n - 4 AND a.n - 1 AND b.kind LIKE 'CANASTA%' WHERE a.kind = 'ASISTENCIA' GROUP BY ALL),
        h AS (SELECT act.seq, pk.n IS NOT NULL AS helped FROM act LEFT JOIN (SELECT DISTINCT game, n FROM pk) pk ON pk.game = act.game AND pk.n = act.n),
        t AS (SELECT team, sum(CASE WHEN kind = 'CANASTA-1P' THEN p ELSE 0 END)::BIGINT AS free_throw_pts, sum(CASE WHEN kind = 'CANASTA-2P' THEN p ELSE 0 END)::BIGINT AS two_pts, sum(CASE WHEN kind = 'CANASTA-3P' THEN p ELSE 0 END)::BIGINT AS three_pts,
              count(*) FILTER (kind IN ('CANASTA-2P', 'CANASTA-3P')) AS fgm, count(*) FILTER (kind IN ('CANASTA-2P', 'CANASTA-3P') AND helped) AS assisted FROM act JOIN h USING (seq) WHERE team IS NOT NULL GROUP BY team),
        zz AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS team, k % 16 AS z FROM s0 WHERE event_id % 3 = 0 AND k % 16 <= 10),
        a AS (SELECT team, 2 * count(*) FILTER (z BETWEEN 1 AND 5) AS paint_pts, 2 * count(*) FILTER (z BETWEEN 6 AND 10) AS mid_pts FROM zz GROUP BY team)
        SELECT t.*, paint_pts, mid_pts, assisted / nullif(fgm, 0) AS assisted_share FROM t LEFT JOIN a USING (team)"""
    cols = ", ".join(f"avg({n}_{x}) AS {n}_{x}" for n in ("first_half", "second_half", "fourth") for x in ("for", "against"))
    half = lambda x: f"sum(CASE WHEN period <= 2 THEN {x} ELSE 0 END) AS {x}1, sum(CASE WHEN period >= 3 THEN {x} ELSE 0 END) AS {x}2, sum(CASE WHEN period = 4 THEN {x} ELSE 0 END) AS {x}4"
    q["period_splits"] = f"""WITH {QUARTERS}, g AS (SELECT game, {half('h')}, {half('a')} FROM qd GROUP BY game HAVING count(*) = 4),
        b AS (SELECT game % 10 AS team, h1 AS first_half_for, a1 AS first_half_against, h2 AS second_half_for, a2 AS second_half_against, h4 AS fourth_for, a4 AS fourth_against FROM g UNION ALL SELECT game % 10 + 10, a1, h1, a2, h2, a4, h4 FROM g)
        SELECT team, count(*) AS games, {cols} FROM b GROUP BY team"""
    q["transition_split"] = f"""WITH {POSSESSIONS}, z AS (SELECT *, coalesce(seconds_to_try <= 8, FALSE) AS transition FROM po)
        SELECT game, side, transition, sum(pts)::BIGINT AS pts, count(*) AS poss, sum(pts) / count(*) AS ppp, count(*) / sum(count(*)) OVER (PARTITION BY game, side) AS share FROM z GROUP BY game, side, transition"""
    q["allowed_efficiency"] = f"""WITH {OPPONENTS} SELECT team, count(*) AS games, (sum(ofgm) + 0.5::DOUBLE * sum(ofg3m)) / sum(ofga) AS opp_efg_pct, sum(opts) / (2 * (sum(ofga) + 0.44::DOUBLE * sum(ofta))) AS opp_ts_pct, sum(oorb) / (sum(oorb) + sum(drb)) AS opp_orb_pct FROM o GROUP BY team"""
    stats = ("gp", "minutes", "min_per_game", "pts_per_game", "efg_pct", "usg_share5", "usg_scaled", "fg3_share", "ast_pct", "ast_per_fgm", "ast_tov", "tov_pct")
    both = ", ".join(f"round(max({m}) FILTER (NOT late), 6) AS {m}_regular, round(max({m}) FILTER (late), 6) AS {m}_playoff, round(max({m}) FILTER (late) - max({m}) FILTER (NOT late), 6) AS {m}_change" for m in stats)
    q["player_phases"] = f"""WITH {BOX}, b AS (SELECT *, date >= DATE '1996-01-01' AS late, fg2a + fg3a + 0.44::DOUBLE * fta + tov AS used, fg2m + fg3m AS fgm, fg2a + fg3a AS fga FROM box WHERE seconds > 0),
        t AS (SELECT supplier AS team, late, sum(used) AS tu, sum(fga - orb + tov + 0.44::DOUBLE * fta) / count(DISTINCT date) AS tp, sum(fgm) AS tf FROM b GROUP BY ALL),
        p AS (SELECT supplier AS team, player, late, count(DISTINCT date) AS gp, sum(seconds) / 60.0::DOUBLE AS minutes, sum(pts) AS pts, sum(fgm) AS fgm, sum(fga) AS fga, sum(fg3m) AS fg3m, sum(fg3a) AS fg3a, sum(ast) AS ast, sum(tov) AS tov, sum(used) AS used FROM b GROUP BY ALL),
        r AS (SELECT p.team, player, p.late, gp, minutes, minutes / gp AS min_per_game, pts / gp AS pts_per_game, (fgm + 0.5::DOUBLE * fg3m) / nullif(fga, 0) AS efg_pct, 5 * (used / tu) AS usg_share5, used / ((minutes / 40) * tp) AS usg_scaled, fg3a / nullif(fga, 0) AS fg3_share,
                     ast / tf AS ast_pct, ast / nullif(fgm, 0) AS ast_per_fgm, ast / nullif(tov, 0) AS ast_tov, tov / used AS tov_pct FROM p JOIN t USING (team, late))
        SELECT team, player, {both} FROM r GROUP BY team, player"""
    q["team_pace"] = f"""WITH {OPPONENTS}, s AS (SELECT game, team, sum(seconds) AS seconds FROM box GROUP BY game, team), p AS (SELECT team, sum(fga - orb + tov + 0.44::DOUBLE * fta + ofga - oorb + otov + 0.44::DOUBLE * ofta) AS total, count(*) AS games, sum(seconds) AS seconds FROM o JOIN s USING (game, team) GROUP BY team)
        SELECT team, round(total / (2 * games), 6) AS pace, round(40 * (total / (2 * seconds / 300.0::DOUBLE)), 6) AS pace_40 FROM p"""
    q["close_record"] = f"WITH {GAMES}, {QUARTERS} SELECT team, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM g WHERE game % 400 IN (SELECT game FROM e WHERE period = 3 AND abs(home_score - away_score) <= 8) GROUP BY team"
    q["expected_threes"] = f"WITH {BOX}, t AS (SELECT supplier AS team, count(DISTINCT game) AS games, sum(fg3a) AS a, sum(fg3m) AS m FROM box GROUP BY supplier) SELECT team, 3 * (a / games) * (m / nullif(a, 0)) AS expected_three_pts FROM t"
    q["advantages"] = f"""WITH {GAMES}, p AS (SELECT league, is_home, avg(pts) AS pts, avg(opp_pts) AS opp_pts, (count(*) FILTER (won))::DOUBLE AS wins FROM g GROUP BY league, is_home),
        l AS (SELECT league, is_home, u.* FROM p, LATERAL (VALUES ('pts', pts), ('opp_pts', opp_pts), ('wins', wins)) u(metric, v)) SELECT a.league, a.metric, a.v AS a, b.v AS b, sign(a.v - b.v)::DOUBLE AS sign FROM l a JOIN l b ON a.league = b.league AND a.metric = b.metric WHERE a.is_home AND NOT b.is_home"""
    q["rest_difference"] = f"WITH {SIDES}, r AS (SELECT *, coalesce(date - lag(date) OVER (PARTITION BY team ORDER BY date, game), 7) AS rest FROM tg) SELECT a.game, a.team, a.rest::INT AS rest, b.rest::INT AS opp_rest, (a.rest - b.rest)::INT AS rest_diff FROM r a LEFT JOIN r b ON a.game = b.game AND a.rival = b.team"
    q["team_events"] = f"WITH {ACTIONS}, {_CLUTCH}, {_EV} SELECT game, side AS team, round(pace, 6) AS pace, clutch_net FROM ev"
    q["game_list"] = f"WITH {SIDES} SELECT game, max(date) AS date, max(team) FILTER (is_home) AS home, max(team) FILTER (NOT is_home) AS away FROM tg GROUP BY game"
    q["shot_names_missing"] = f"WITH {SHOTS} SELECT team, count(*) AS shots, count(*) FILTER (jersey > 9) AS without_player FROM shots GROUP BY team"
    q["event_vocabulary"] = f"""WITH {ACTIONS} SELECT kind AS tipo, count(*) AS n, CASE WHEN kind LIKE 'CANASTA%' THEN substr(kind, 9, 1)::INT ELSE 0 END AS points,
        CASE WHEN kind IN {_FG} OR kind = 'PERDIDA' THEN 1.0::DOUBLE WHEN kind IN ('CANASTA-1P', 'TIRO1-FALLADO') THEN 0.44::DOUBLE ELSE 0.0::DOUBLE END AS poss_weight, kind IN {_FG} AS is_fg, kind LIKE 'CANASTA%' AS is_made, kind IN ('CANASTA-1P', 'TIRO1-FALLADO') AS is_ft,
        regexp_matches(kind, '^(INICIO|FINAL)') AS is_boundary FROM act GROUP BY kind"""
    q["feature_table"] = f"""WITH {FEATURE_ROWS} SELECT game, team, home, win, rest_diff::INT AS rest_diff, fg3_pct, round(pace, 6) AS pace, clutch_net, paint_efg, paint_rate, round(net_rating_ewm, 3) AS net_rating_ewm, round(efg_pct_ewm, 6) AS efg_pct_ewm, round(paint_efg_ewm, 6) AS paint_efg_ewm, win_last5
        FROM ft JOIN ew USING (game, team) LEFT JOIN pe USING (game, team)"""
    q["winprob_score"] = f"WITH {FEATURE_ROWS} SELECT game, team, round({_prob({'home': 'home', 'net_rating_ewm': 'net_rating_ewm', 'win_last5': 'win_last5', 'paint_efg_ewm': 'paint_efg_ewm', 'fg3_pct_ewm': 'fg3_pct_ewm'})}, 6) AS prob FROM ft JOIN ew USING (game, team) LEFT JOIN pe USING (game, team)"
    w = _Q.format("back - 1")
    state = ", ".join(f"sum({x} * {w}) / sum({w}) AS {n}_ewm" for n, x in (("net_rating", "((pts - opp_pts) / 10000.0::DOUBLE)"), ("paint_efg", "((pts % 100) / 100.0::DOUBLE)"), ("fg3_pct", "((opp_pts % 100) / 100.0::DOUBLE)")))
    p = _prob({"home": "1.0::DOUBLE", "net_rating_ewm": "h.net_rating_ewm", "win_last5": "h.win_last5", "paint_efg_ewm": "h.paint_efg_ewm", "fg3_pct_ewm": "h.fg3_pct_ewm"})
    q["fixture_predict"] = f"""WITH {GAMES}, b AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, game DESC) AS back FROM g), s AS (SELECT team, avg(won::INT) FILTER (back <= 5) AS win_last5, {state} FROM b GROUP BY team)
        SELECT '03/08/2001' AS fecha, h.team AS local, a.team AS visitante, round({p}, 3) AS prob_local, round(1 - round({p}, 3), 3) AS prob_visit FROM s h JOIN s a ON a.team = h.team + 1"""

    # queries of ``queries`` with longer definitions
    q["zone_distribution"] = f"""WITH {SHOTS}, d AS (SELECT zone FROM shots WHERE zone IS NOT NULL UNION SELECT unnest(['Z1-IZ', 'Z2-DE', 'Z7-IZ', 'Z12-DE', 'FRANJA-DE', 'Z99-DE'])), t AS (SELECT DISTINCT team FROM shots WHERE zone IS NOT NULL),
        c AS (SELECT t.team, d.zone, count(s.result) AS att, count(*) FILTER (s.result = 'CONVERTIDO') AS made, count(*) FILTER (s.result = 'CONVERTIDO' AND s.kind = 'TIRO3') AS made3 FROM t CROSS JOIN d LEFT JOIN shots s ON s.team = t.team AND s.zone = d.zone GROUP BY ALL)
        SELECT *, att / nullif(sum(att) OVER (PARTITION BY team), 0) AS share, made / nullif(att, 0) AS fg_pct, (made + 0.5::DOUBLE * made3) / nullif(att, 0) AS efg_pct FROM c"""
    q["period_report"] = f"""WITH {GAMES}, b AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, game DESC) AS back FROM g), m AS (
        SELECT team, pts, won, u.label FROM b, LATERAL (VALUES ('before', date <= DATE '1998-06-30'), ('since', date >= DATE '1998-07-01'), ('last5', back <= 5), ('own', team = 10 AND date >= DATE '1995-01-01'), ('last2', (team = 10 AND back <= 2) OR (team = 13 AND back <= 3)), ('all', back <= 1200)) u(label, x) WHERE x)
        SELECT team, label, count(*) AS games, sum(pts)::BIGINT AS pts, count(*) FILTER (won) AS wins FROM m GROUP BY team, label"""
    q["compare_pair"] = """WITH v AS (SELECT vec_id, i - 1 AS pos, 'f' || (i - 1) AS feature, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)),
        z AS (SELECT *, coalesce((x - avg(x) OVER (PARTITION BY pos)) / nullif(stddev_pop(x) OVER (PARTITION BY pos), 0), 0) AS z FROM v),
        d AS (SELECT a.pos, a.feature, a.x AS value_a, b.x AS value_b, abs(a.z - b.z) AS diff_z FROM z a JOIN z b ON a.pos = b.pos WHERE a.vec_id = 1 AND b.vec_id = 2)
        SELECT feature, value_a, value_b, round(diff_z, 6) AS diff_z, row_number() OVER (ORDER BY diff_z, pos) <= 3 AS alike, row_number() OVER (ORDER BY diff_z DESC, pos) <= 3 AS different FROM d"""
    q["clutch_team"] = f"""WITH {ACTIONS}, x AS (SELECT * FROM act WHERE period = 4 AND clock <= 300 AND abs(home_score - away_score) <= 5 AND team IS NOT NULL), b AS (SELECT game, kind, p, team, TRUE AS own FROM x UNION ALL SELECT game, kind, p, rival, FALSE FROM x),
        r AS (SELECT game, max(home_score) AS h, max(away_score) AS a FROM act GROUP BY game), v AS (SELECT game, 'home' AS team, h > a AS won FROM r UNION ALL SELECT game, 'away', a > h FROM r),
        t AS (SELECT team, count(DISTINCT game) AS games, coalesce(sum(p) FILTER (own), 0)::BIGINT AS pts, coalesce(sum(p) FILTER (NOT own), 0)::BIGINT AS opp_pts, sum({_EVENT_POSS}) FILTER (own) AS poss, sum({_EVENT_POSS}) FILTER (NOT own) AS opp_poss,
              count(*) FILTER (own AND kind IN {_FG}) AS fga, count(*) FILTER (own AND kind IN ('CANASTA-2P', 'CANASTA-3P')) AS fgm, count(*) FILTER (own AND kind = 'PERDIDA') AS tov, count(*) FILTER (own AND kind = 'CANASTA-3P') AS m3 FROM b GROUP BY team),
        w AS (SELECT team, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM v SEMI JOIN b ON v.game = b.game AND v.team = b.team GROUP BY team)
        SELECT t.team, games, wins, losses, pts, opp_pts, fga, fgm, tov, (fgm + 0.5::DOUBLE * m3) / nullif(fga, 0) AS efg_pct, round(poss, 6) AS poss, round(opp_poss, 6) AS opp_poss, round(100 * pts / nullif(poss, 0), 6) AS ortg, round(100 * opp_pts / nullif(opp_poss, 0), 6) AS drtg, round(tov / nullif(poss, 0), 6) AS tov_pct FROM t JOIN w USING (team)"""
    phases = ", ".join(f"round(max({m}) FILTER (phase = '{x}'), 6) AS {m}_{x}" for m in _METRICS for x in ("regular", "playoff"))
    changes = ", ".join(f"round(max({m}) FILTER (phase = 'playoff') - max({m}) FILTER (phase = 'regular'), 6) AS {m}_change" for m in _METRICS)
    q["phase_comparison"] = f"""WITH {OPPONENTS}, x AS (SELECT *, CASE WHEN date >= CASE team WHEN 'O' THEN DATE '2000-01-01' ELSE DATE '1994-01-01' END THEN 'playoff' ELSE 'regular' END AS phase FROM o), r AS ({_REPORT.format('team, phase', 'x')}) SELECT team, {phases}, {changes} FROM r GROUP BY team"""
    q["recent_form"] = f"WITH {OPPONENTS}, b AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, game DESC) AS back FROM o) SELECT team, game, back, date, rival, is_home, won, pts, opts AS opp_pts, efg_pct, tov, orb + drb AS reb, ortg, drtg, ortg - drtg AS net_rating FROM b WHERE back <= 10"
    extra = ("wins_h2h", "losses_h2h", "wins_last10", "losses_last10", "wins_home", "losses_home", "wins_away", "losses_away")
    q["executive_comparison"] = f"""WITH {OPPONENTS}, r AS ({_REPORT.format('team', 'o')}), b AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, game DESC) AS back FROM o),
        w AS (SELECT team, count(*) FILTER (won) AS wins_h2h, count(*) FILTER (NOT won) AS losses_h2h, count(*) FILTER (won AND back <= 10) AS wins_last10, count(*) FILTER (NOT won AND back <= 10) AS losses_last10, CASE WHEN team = 'O' THEN count(*) FILTER (won) END AS wins_home,
              CASE WHEN team = 'O' THEN count(*) FILTER (NOT won) END AS losses_home, CASE WHEN team = 'F' THEN count(*) FILTER (won) END AS wins_away, CASE WHEN team = 'F' THEN count(*) FILTER (NOT won) END AS losses_away FROM b GROUP BY team),
        l AS (SELECT team, u.* FROM r JOIN w USING (team), LATERAL (VALUES {', '.join(f"('{m}', {m}::DOUBLE)" for m in _METRICS + extra)}) u(metric, v)) SELECT metric, round(max(v) FILTER (team = 'O'), 6) AS a, round(max(v) FILTER (team = 'F'), 6) AS b FROM l GROUP BY metric"""
    q["usage_per_game"] = f"""WITH {BOX}, p AS (SELECT supplier AS team, game, player, sum(seconds)::BIGINT AS seconds, sum(fg2a + fg3a)::BIGINT + 0.44::DOUBLE * sum(fta)::BIGINT + sum(tov)::BIGINT AS used FROM box GROUP BY ALL),
        t AS (SELECT supplier AS team, game, greatest(sum(fg2a + fg3a) - sum(orb) + sum(tov) + 0.44::DOUBLE * sum(fta), 1.0::DOUBLE) AS poss FROM box GROUP BY ALL),
        m AS (SELECT team, player FROM (SELECT team, player, row_number() OVER (PARTITION BY team ORDER BY sum(seconds) DESC, player) AS r FROM p GROUP BY team, player) WHERE r <= 5)
        SELECT team, game, player, round(used / nullif((seconds / 2400.0::DOUBLE) * poss, 0), 6) AS usage FROM p JOIN t USING (team, game) SEMI JOIN m USING (team, player)"""
    q["player_report"] = f"""WITH {BOX}, dd AS (SELECT supplier AS team, count(DISTINCT date) AS days FROM (SELECT supplier, game, max(date) AS date FROM box GROUP BY ALL) GROUP BY 1), t AS (SELECT supplier AS team, sum(fg2a + fg3a + 0.44::DOUBLE * fta + tov) + count(DISTINCT game) AS tu, sum(fg2a + fg3a - orb + tov + 0.44::DOUBLE * fta) + count(DISTINCT game) AS tp, sum(fg2m + fg3m) AS tf FROM box GROUP BY 1), p AS (SELECT supplier AS team, player, count(DISTINCT date) AS gp, sum(seconds) / 60.0::DOUBLE AS minutes, sum(pts) AS pts,
        sum(fg2m + fg3m) AS fgm, sum(fg2a + fg3a) AS fga, sum(fg3m) AS fg3m, sum(fg3a) AS fg3a, sum(ast) AS ast, sum(tov) AS tov, sum(fg2a + fg3a + 0.44::DOUBLE * fta + tov) AS used FROM box WHERE seconds > 0 GROUP BY 1, 2),
        s AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY minutes DESC, player) AS rank FROM p)
        SELECT team, player, gp, pts / gp AS pts_per_game, (fgm + 0.5::DOUBLE * fg3m) / nullif(fga, 0) AS efg_pct, fg3a / nullif(fga, 0) AS fg3_share, ast / tf AS ast_pct, ast / nullif(fgm, 0) AS ast_per_fgm, ast / nullif(tov, 0) AS ast_tov, round(minutes, 6) AS minutes, round(minutes / gp, 6) AS min_per_game,
        round(5 * (used / tu), 6) AS usg_share5, round(used / ((minutes / 40) * (tp / days)), 6) AS usg_scaled, round(tov / used, 6) AS tov_pct, rank FROM s JOIN t USING (team) JOIN dd USING (team) WHERE rank <= 8"""
    q |= _models()
    return q


#: Rows of the model queries: features of a team's past and the drawn target; rows with nulls leave.
MODEL_ROWS = GAMES + f""",
m0 AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, game) AS n, is_home::INT AS home, pts / 1e7::DOUBLE AS form FROM g),
m1 AS (SELECT *, {_Q.format('-n')} AS k FROM m0),
m2 AS (SELECT *, sum(form * k) OVER w / sum(k) OVER w AS form_ewm, avg(won::INT) OVER (PARTITION BY team ORDER BY date, game ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS win_last5 FROM m1 WINDOW w AS (PARTITION BY team ORDER BY date, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rows_ AS (SELECT game, date, home, form_ewm, win_last5, (home * 0.4::DOUBLE + form_ewm * 0.3::DOUBLE + ((game * 2654435761) % 1000) / 500.0::DOUBLE > 1.9)::INT AS win FROM m2 WHERE form_ewm IS NOT NULL AND win_last5 IS NOT NULL)"""
_X = ("home", "form_ewm", "win_last5")


def _descent(name: str, train: str, steps: int = 250, rate: float = 2.0) -> str:
    """CTEs that fit an L2 logistic regression (C = 0.2) per fold of ``train`` (fold, y, features standardised as x1.. xk) by gradient descent: name(fold, b, w1.. wk)."""
    k = range(1, len(_X) + 1)
    keys = ", ".join(["fold", "i", "b", *(f"w{j}" for j in k)])
    margin = "b + " + " + ".join(f"w{j} * x{j}" for j in k)
    grads = ", ".join([f"avg(1 / (1 + exp(-({margin}))) - y) AS g0", *(f"avg((1 / (1 + exp(-({margin}))) - y) * x{j}) + w{j} / (0.2::DOUBLE * count(*)) AS g{j}" for j in k)])
    move = ", ".join([f"b - {rate} * g0", *(f"w{j} - {rate} * g{j}" for j in k)])
    return f"""{name}_i(fold, i, b, {', '.join(f'w{j}' for j in k)}) AS (SELECT DISTINCT fold, 0, 0.0::DOUBLE, {', '.join('0.0::DOUBLE' for _ in k)} FROM {train}
        UNION ALL SELECT fold, i + 1, {move} FROM (SELECT {keys}, {grads} FROM {name}_i JOIN {train} USING (fold) WHERE i < {steps} GROUP BY {keys})),
        {name} AS (SELECT * FROM {name}_i WHERE i = {steps})"""


def _standard(name: str, rows: str, stats: str) -> str:
    """CTE with x1.. xk: the features of ``rows`` by the means and deviations that ``stats`` rows of the fold have."""
    cols = ", ".join(f"(r.{x} - m{j}) / d{j} AS x{j}" for j, x in enumerate(_X, 1))
    ms = ", ".join(f"avg({x}) AS m{j}, stddev_pop({x}) AS d{j}" for j, x in enumerate(_X, 1))
    return f"{name}_s AS (SELECT fold, {ms}, count(*) AS n_train FROM {stats} GROUP BY fold), {name} AS (SELECT r.*, r.win AS y, n_train, {cols} FROM {rows} r JOIN {name}_s USING (fold))"


_SCORES = """n, round(ok / n, 4) AS accuracy, round((ranks - pos * (pos + 1) / 2) / nullif(pos * (n - pos), 0), 4) AS auc, round(loss / n, 4) AS log_loss"""


def _metrics(rows: str, keep: str) -> str:
    return f"""a_ AS (SELECT *, least(greatest(prob, 1e-15), 1 - 1e-15) AS c_, (rank() OVER w + rank() OVER w + count(*) OVER (PARTITION BY fold, prob) - 1) / 2.0::DOUBLE AS r_ FROM {rows} WINDOW w AS (PARTITION BY fold ORDER BY prob)),
        t_ AS (SELECT {keep}, count(*) AS n, sum(y)::DOUBLE AS pos, sum(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS ok, sum(r_) FILTER (y = 1) AS ranks, sum(-(y * ln(c_) + (1 - y) * ln(1 - c_))) AS loss FROM a_ GROUP BY {keep})"""


def _models() -> dict[str, str]:
    margin = "b + " + " + ".join(f"w{j} * x{j}" for j in range(1, len(_X) + 1))
    at = "p_ AS (SELECT *, row_number() OVER (ORDER BY date, game) - 1 AS \"at\", count(*) OVER () AS n_ FROM rows_)"
    q = {}
    q["winprob_scaling"] = f"WITH {MODEL_ROWS}, {at}, l AS (SELECT u.* FROM p_, LATERAL (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, {x}::DOUBLE)' for x in _X)}) u(feature, v) WHERE \"at\" < floor(n_ * 0.75::DOUBLE)) SELECT feature, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS deviation FROM l GROUP BY feature"
    q["winprob_fit"] = f"""WITH RECURSIVE {MODEL_ROWS}, r_ AS (SELECT *, 0 AS fold FROM rows_), {_standard('x_', 'r_', 'r_')}, {_descent('fit', 'x_')}
        SELECT u.feature, round(u.v, 4) AS coefficient FROM fit, LATERAL (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, w{j})' for j, x in enumerate(_X, 1))}) u(feature, v)"""
    fold = f"{at}, f_ AS (SELECT *, CASE WHEN \"at\" < n_ - (6 - fold) * (n_ // 6) THEN 'train' WHEN \"at\" < n_ - (6 - fold) * (n_ // 6) + n_ // 6 THEN 'test' END AS role FROM p_, range(1, 6) t(fold)), tr_ AS (SELECT * FROM f_ WHERE role = 'train'), te_ AS (SELECT * FROM f_ WHERE role = 'test')"
    scored = "s_ AS (SELECT fold, y, n_train, 1 / (1 + exp(-(" + margin + "))) AS prob FROM xt_ JOIN fit USING (fold))"
    cv = f"WITH RECURSIVE {MODEL_ROWS}, {fold}, {_standard('x_', 'tr_', 'tr_')}, {_standard('xt_', 'te_', 'tr_')}, {_descent('fit', 'x_')}, {scored}, {_metrics('s_', 'fold, n_train')}"
    q["winprob_cv"] = f"{cv} SELECT fold::INT AS fold, n_train, {_SCORES} FROM t_"
    q["winprob_cv_summary"] = f"{cv}, u_ AS (SELECT {_SCORES.replace(', 4)', ', 12)')} FROM t_) SELECT " + ", ".join(f"round(avg({m}), 4) AS {m}_mean, round(stddev_pop({m}), 4) AS {m}_std" for m in ("accuracy", "auc", "log_loss")) + " FROM u_"
    hold = f"{at}, tr_ AS (SELECT *, 0 AS fold FROM p_ WHERE \"at\" < floor(n_ * 0.75::DOUBLE)), te_ AS (SELECT *, 0 AS fold FROM p_ WHERE \"at\" >= floor(n_ * 0.75::DOUBLE))"
    q["winprob_holdout"] = f"WITH RECURSIVE {MODEL_ROWS}, {hold}, {_standard('x_', 'tr_', 'tr_')}, {_standard('xt_', 'te_', 'tr_')}, {_descent('fit', 'x_')}, {scored}, {_metrics('s_', 'n_train')} SELECT n_train, {_SCORES} FROM t_"
    # five models on stratified folds, each with Platt's sigmoid of the part it has not seen (Newton's method on two numbers)
    five = f"""c_ AS (SELECT *, floor((row_number() OVER (PARTITION BY win ORDER BY date, game) - 1) * 5 / count(*) OVER (PARTITION BY win)) AS part FROM rows_), all_ AS (SELECT *, fold AS f FROM c_, range(0, 5) t(fold)),
        st_ AS (SELECT fold, {', '.join(f'avg({x}) AS m{j}, stddev_pop({x}) AS d{j}' for j, x in enumerate(_X, 1))} FROM all_ GROUP BY fold), z_ AS (SELECT r.fold, r.game, r.date, r.part, r.win AS y, {', '.join(f'(r.{x} - m{j}) / d{j} AS x{j}' for j, x in enumerate(_X, 1))} FROM all_ r JOIN st_ USING (fold)),
        tr_ AS (SELECT * FROM z_ WHERE part <> fold), {_descent('fit', 'tr_')}, mg_ AS (SELECT z_.fold, z_.game, z_.date, part, y, {margin} AS m FROM z_ JOIN fit USING (fold)),
        he_ AS (SELECT *, CASE WHEN y = 1 THEN (sum(y) OVER (PARTITION BY fold) + 1.0::DOUBLE) / (sum(y) OVER (PARTITION BY fold) + 2) ELSE 1.0::DOUBLE / (sum(1 - y) OVER (PARTITION BY fold) + 2) END AS t FROM mg_ WHERE part = fold),
        pl_(fold, i, a, b) AS (SELECT fold, 0, 1.0::DOUBLE, 0.0::DOUBLE FROM fit UNION ALL SELECT fold, i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
          SELECT fold, i, a, b, sum((s - t) * m) AS ga, sum(s - t) AS gb, sum(s * (1 - s) * m * m) AS haa, sum(s * (1 - s) * m) AS hab, sum(s * (1 - s)) AS hbb FROM (SELECT pl_.fold, i, a, b, m, t, 1 / (1 + exp(-(a * m + b))) AS s FROM pl_ JOIN he_ USING (fold) WHERE i < 25) GROUP BY fold, i, a, b)),
        s_ AS (SELECT 0 AS fold, game, any_value(y) AS y, avg(1 / (1 + exp(-(a * m + b)))) AS prob FROM mg_ JOIN pl_ USING (fold) WHERE i = 25 GROUP BY game)"""
    q["winprob_platt"] = f"WITH RECURSIVE {MODEL_ROWS}, {five}, {_metrics('s_', 'fold')} SELECT {_SCORES} FROM t_"
    q["winprob_retrain"] = f"WITH RECURSIVE {MODEL_ROWS}, {five} SELECT game, round(prob, 3) AS prob, (SELECT count(*)::VARCHAR FROM rows_) AS n_rows, (SELECT strftime(max(date), '%Y-%m-%d') FROM rows_) AS last_date FROM s_"
    return q
