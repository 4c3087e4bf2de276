"""Period reports of teams and players, records, splits, margins and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import efg, possessions, ratio, true_shooting
from . import KEYS, scan


def period_membership(games: DataFrame, periods: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("date", "game")) -> DataFrame:
    """Team games times the report periods they fall into (periods may overlap): by date range, or the last k of the team.

    ``periods`` has keys, team, label, date_from, date_to, last_k; a null team or key applies to all. Its rows are joined on those keys that they
    name, one join per combination that occurs; at most 2**(keys + 1) rows come to the driver to tell.
    """
    own = [*keys, "team"]
    dim = periods.select(*(F.col(k).alias(f"_{k}") for k in own), "label", "date_from", "date_to", "last_k")
    back = Window.partitionBy(*own).orderBy(*(F.col(c).desc() for c in order))
    rows = games.withColumn("_back", F.row_number().over(back))
    inside = (F.col("date_from").isNull() | (F.col("date") >= F.col("date_from"))) & (F.col("date_to").isNull() | (F.col("date") <= F.col("date_to")))
    inside = F.when(F.col("last_k").isNotNull(), F.col("_back") <= F.col("last_k")).otherwise(inside)
    out = games.withColumn("label", F.lit(None).cast("string")).limit(0)
    for named in dim.select(*(F.col(f"_{k}").isNotNull().alias(k) for k in own)).distinct().collect():
        part, on = dim, inside
        for k in own:
            part = part.where(F.col(f"_{k}").isNotNull() if named[k] else F.col(f"_{k}").isNull())
            on = on & (F.col(k) == F.col(f"_{k}")) if named[k] else on
        out = out.unionByName(rows.join(part, on).select(*games.columns, "label"))
    return out


def team_report(rows: DataFrame, group: Sequence[str] = (*KEYS, "team", "label")) -> DataFrame:
    """Team averages and ratings over its games (rows carry the opponent's opp_ columns); pace_40 where rows carry the team's playing time in seconds."""
    own = possessions("fga", "orb", "tov", "fta")
    other = possessions("opp_fga", "opp_orb", "opp_tov", "opp_fta")
    # five players share a team's playing time
    cols = [*(("seconds",) if "seconds" in rows.columns else ()), "pts", "fgm", "fga", "fg2m", "fg2a", "fg3m", "fg3a", "ftm", "fta", "orb", "drb", "ast", "tov", "opp_pts", "opp_orb", "opp_drb"]
    s = rows.groupBy(*group).agg(F.count("*").alias("games"), *(F.sum(c).alias(c) for c in cols), F.sum(own).alias("poss"), F.sum(other).alias("opp_poss"))
    return s.select(
        *group,
        "games",
        ratio("pts", "games").alias("pts_per_game"),
        efg("fgm", "fg3m", "fga").alias("efg_pct"),
        ratio("fg2a", "fga").alias("fg2_share"),
        ratio("fg3a", "fga").alias("fg3_share"),
        ratio("fg2m", "fg2a").alias("fg2_pct"),
        ratio("fg3m", "fg3a").alias("fg3_pct"),
        ratio("fta", "fga").alias("ft_rate"),
        (100 * ratio("pts", "poss")).alias("ortg"),
        (100 * ratio("opp_pts", "opp_poss")).alias("drtg"),
        (100 * ratio("pts", "poss") - 100 * ratio("opp_pts", "opp_poss")).alias("net"),
        ratio(F.col("poss") + F.col("opp_poss"), 2 * F.col("games")).alias("pace"),
        *((40 * ratio(F.col("poss") + F.col("opp_poss"), 2 * F.col("seconds") / 300.0)).alias("pace_40") for _ in range("seconds" in rows.columns)),
        ratio("orb", F.col("orb") + F.col("opp_drb")).alias("orb_pct"),
        ratio("drb", F.col("drb") + F.col("opp_orb")).alias("drb_pct"),
        ratio("tov", "poss").alias("tov_pct"),
        ratio("ast", "games").alias("ast_per_game"),
        true_shooting("pts", "fga", "fta").alias("ts_pct"),
    )


def player_report(players: DataFrame, group: Sequence[str] = (*KEYS, "team", "label"), totals: DataFrame | None = None) -> DataFrame:
    """Player averages and shares of team totals; usg_share5 has no minutes in it, usg_scaled has: plays over (minutes / 40 * team possessions a game).

    ``totals`` holds the team's game totals (fgm, fga, fta, orb, tov, date; the TOTALES rows), which are more than the sum of the players
    (team rebounds, team turnovers); without it the sums of the player rows stand in.
    """
    used = F.col("fga") + 0.44 * F.col("fta") + F.col("tov")
    rows = players.where("seconds > 0").withColumn("_used", used)
    p = rows.groupBy(*group, "player").agg(
        F.count_distinct("date").alias("gp"), F.sum("seconds").alias("seconds"), *(F.sum(c).alias(c) for c in ("pts", "fgm", "fga", "fg3m", "fg3a", "fta", "ast", "tov", "_used"))
    )
    team = (rows if totals is None else totals).groupBy(*group).agg(F.count_distinct("date").alias("_team_games"), F.sum(used).alias("_team_used"), F.sum(possessions("fga", "orb", "tov", "fta")).alias("_team_poss"), F.sum("fgm").alias("_team_fgm"))
    p = p.join(team, list(group))
    minutes = F.col("seconds") / 60.0
    return p.select(
        *group,
        "player",
        "gp",
        minutes.alias("minutes"),
        ratio(minutes, "gp").alias("min_per_game"),
        ratio("pts", "gp").alias("pts_per_game"),
        efg("fgm", "fg3m", "fga").alias("efg_pct"),
        (5 * ratio("_used", "_team_used")).alias("usg_share5"),
        ratio("_used", (minutes / 40) * ratio("_team_poss", "_team_games")).alias("usg_scaled"),
        ratio("fg3a", "fga").alias("fg3_share"),
        ratio("ast", "_team_fgm").alias("ast_pct"),
        ratio("ast", "fgm").alias("ast_per_fgm"),
        ratio("ast", "tov").alias("ast_tov"),
        ratio("tov", "_used").alias("tov_pct"),
    )


def top_n(df: DataFrame, group: Sequence[str], by: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of every group in a stated order (which should end with a unique tie-break)."""
    w = Window.partitionBy(*group).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def rotation(players: DataFrame, group: Sequence[str] = (*KEYS, "team"), n: int = 8) -> DataFrame:
    """The n players with the most minutes per game."""
    return top_n(players, group, [F.desc("min_per_game"), "player"], n)


def records(rows: DataFrame, group: Sequence[str] = (*KEYS, "team")) -> DataFrame:
    return rows.groupBy(*group).agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"))


def splits(rows: DataFrame, group: Sequence[str] = (*KEYS, "team", "is_home")) -> DataFrame:
    """Record, points for and against and their difference per team and side."""
    return rows.groupBy(*group).agg(
        F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.avg("pts").alias("pts_for"), F.avg("opp_pts").alias("pts_against"), F.avg(F.col("pts") - F.col("opp_pts")).alias("diff")
    )


def margins(rows: DataFrame, group: Sequence[str] = (*KEYS, "team")) -> DataFrame:
    """Average margin of won and of lost games."""
    m = F.col("pts") - F.col("opp_pts")
    return rows.groupBy(*group).agg(F.avg(F.when(F.col("won"), m)).alias("win_margin"), F.avg(F.when(~F.col("won"), m)).alias("loss_margin"))


def ranking(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Teams of a league by share of wins; equal shares share a rank."""
    r = records(rows, (*keys, "team")).withColumn("win_pct", ratio("wins", F.col("wins") + F.col("losses")))
    return r.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("win_pct"))))


def against_league(team: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Each team's metrics beside the league's mean over teams."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return team.withColumns({f"league_{m}": F.avg(m).over(w) for m in metrics} | {f"{m}_vs_league": F.col(m) - F.avg(m).over(w) for m in metrics})


def phase(rows: DataFrame, cutoffs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """regular or playoff by each team's cutoff date (a small dimension: keys, team, cutoff)."""
    # a row a team: broadcast, for dealt by team few teams would make few tasks
    joined = rows.join(F.broadcast(cutoffs), [*keys, "team"], "left")
    return joined.withColumn("phase", F.when(F.col("date") >= F.col("cutoff"), "playoff").otherwise("regular")).drop("cutoff")


def percentiles(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """League percentile (0 to 1) of each metric."""
    part = Window.partitionBy(*keys)
    return rows.withColumns({f"{m}_pctile": F.percent_rank().over(part.orderBy(m)) for m in metrics})


#: The eight dimensions of a player profile.
PROFILE = ("pts_per_game", "efg_pct", "ts_pct", "usg_scaled", "ast_tov", "trb_40", "stl_40", "blk_40")


def player_profile(seasons: DataFrame, team_games: DataFrame, keys: Sequence[str] = KEYS, parts: int | None = None) -> DataFrame:
    """League percentiles of the eight dimensions; ``seasons`` has the season totals and games of ``similarity.player_seasons`` with their features.

    Usage is scaled by minutes: plays over (minutes / 40 * the team's possessions a game), from ``team_games`` (keys, team, game, poss), which hold
    all games of a team whatever seasons the minutes filter left. Ranks come from ranges of values, not from a task a league.
    """
    used = F.col("fga") + 0.44 * F.col("fta") + F.col("tov")
    # decimal sums do not hang on the order of rows, so that equal teams stay equal and their players share a rank
    pace = team_games.groupBy(*keys, "team").agg((F.sum(F.col("poss").cast("decimal(28,6)")).cast("double") / F.count_distinct("game")).alias("_poss"))
    rows = seasons.join(pace, [*keys, "team"], "left").withColumns({"pts_per_game": ratio("pts", "games"), "usg_scaled": ratio(used, (F.col("minutes") / 40) * F.col("_poss"))})
    return scan.percentiles(rows.drop("_poss"), PROFILE, keys, parts)


def foul_trouble(players: DataFrame, group: Sequence[str] = (*KEYS, "team", "player"), fouls: int = 4) -> DataFrame:
    return players.groupBy(*group).agg(F.avg((F.col("pf") >= fouls).cast("double")).alias("foul_trouble"))


def advantage(a: DataFrame, b: DataFrame, metrics: Sequence[str], on: Sequence[str] = KEYS) -> DataFrame:
    """Sign of a minus b per metric: rows (key, metric, a, b, sign)."""
    pair = a.select(*on, *(F.col(m).alias(f"a_{m}") for m in metrics)).join(b.select(*on, *(F.col(m).alias(f"b_{m}") for m in metrics)), list(on))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("a"), F.col(f"b_{m}").alias("b")) for m in metrics)))
    return pair.select(*on, rows.alias("r")).select(*on, "r.*").withColumn("sign", F.signum(F.col("a") - F.col("b")))


def half_season_trend(players: DataFrame, metric: str, group: Sequence[str] = (*KEYS, "player")) -> DataFrame:
    """Mean of the metric in the first and the second half of a player's games, and the change."""
    halves = players.withColumn("_half", F.ntile(2).over(Window.partitionBy(*group).orderBy("date", "game")))
    out = halves.groupBy(*group).agg(F.avg(F.when(F.col("_half") == 1, F.col(metric))).alias("first_half"), F.avg(F.when(F.col("_half") == 2, F.col(metric))).alias("second_half"))
    return out.withColumn("change", F.col("second_half") - F.col("first_half"))


def close_after_three(quarters: DataFrame, team_games: DataFrame, keys: Sequence[str] = KEYS, margin: int = 8) -> DataFrame:
    """Record in games within ``margin`` points after the third period."""
    close = quarters.where((F.col("period") == 3) & (F.abs(F.col("home_score") - F.col("away_score")) <= margin)).select(*keys, "game")
    return records(team_games.join(close, [*keys, "game"], "left_semi"), (*keys, "team"))


def expected_three_points(team: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Threes attempted per game times the share made times three."""
    return team.withColumn("expected_three_pts", 3 * ratio("fg3a", "games") * ratio("fg3m", "fg3a"))
