"""Structured Streaming jobs."""

from .ingest import ingest_stream
from .team_state import current_state, keep_state

__all__ = ["current_state", "ingest_stream", "keep_state"]
