"""The public functions by the names that users of the analysis scripts know; each is a call of the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import KEYS
from .operators import events as _events
from .operators import shots as _shots
from .operators import similarity as _similarity
from .operators import teamgame as _teamgame
from .operators import winprob as _winprob
from .sources import tables as _tables


def load_data(spark: SparkSession, path: str, league: str | None = None, stage: str | None = "regular") -> DataFrame:
    """Box rows of a CSV file."""
    return _tables.read_box(spark, path, league, stage)


def build_features(team_games: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Four Factors of both sides and rest days, from team game rows."""
    return _teamgame.rest_difference(_teamgame.rest_days(_teamgame.four_factors(team_games, keys=keys), keys=keys), keys=keys)


def build_pbp_features(events: DataFrame, game: Sequence[str] = (*KEYS, "game")) -> DataFrame:
    """Pace and clutch points per team and game."""
    return _events.team_event_features(events, game)


def build_shots_features(shots: DataFrame, group: Sequence[str] = (*KEYS, "game", "team")) -> DataFrame:
    """Shot profile per team and game."""
    return _shots.shot_profile(_shots.on_court(shots), group)


def build_rolling_features(features: DataFrame, events: DataFrame | None = None, shots: DataFrame | None = None, keys: Sequence[str] = KEYS, span: int = 10) -> DataFrame:
    """The model's table: features with event and shot features and what each team knew before the game."""
    return _winprob.feature_table(features, events, shots, keys, span)


train_model = _winprob.train_holdout
evaluate_model = _winprob.metrics
cross_validate_temporal = _winprob.cross_validate
retrain = _winprob.retrain
load_model = reload_model = _winprob.WinModel.load


def predict_proba_game(rows: DataFrame, model: _winprob.WinModel) -> DataFrame:
    """Probability of a win for rows of the model's table."""
    return model.transform(rows)


def predict_upcoming_games(fixture: DataFrame, games: DataFrame, model: _winprob.WinModel, metrics: Sequence[str] = ("net_rating", "paint_efg", "fg3_pct"), keys: Sequence[str] = KEYS) -> DataFrame:
    """Probabilities of the fixture's games from the teams' latest state."""
    return _winprob.predict_fixture(fixture, _winprob.team_state(games, metrics, keys), model, keys)


get_similar_players = _similarity.similar_players
compare_players = _similarity.compare
