"""DataFrame operators over the silver tables; every key list starts with league and season unless told otherwise."""

KEYS = ("league", "season")
