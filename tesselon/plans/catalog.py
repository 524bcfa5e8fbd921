"""All queries over the reference tables, with their SQL."""

from . import cellular, files, forecast, learning, models, selection, streams, timeseries  # noqa: F401  they register their queries
from .base import QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
