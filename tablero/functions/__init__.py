"""Scalar functions as Column expressions."""

from .scalars import *  # noqa: F403
