"""Registered queries: one per operator, with the SQL that a second engine answers it by."""

from . import chunks, events, index, machines, matching, measures, playback, records, sequences, signals, texts

_PARTS = (chunks, events, index, machines, matching, measures, playback, records, sequences, signals, texts)


def queries() -> dict:
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
