"""Where queries are registered, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.sources.bars import BARS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _with_bars(text: str) -> str:
    text = text.strip()
    return f"WITH RECURSIVE {BARS_SQL}" + (", " + text.split(None, 2 if text.upper().startswith("WITH RECURSIVE") else 1)[-1] if text.upper().startswith("WITH") else " " + text)


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = _with_bars(sql)


def rounded(df: DataFrame, *keys: str, places: int = 8) -> DataFrame:
    """Keys as they are, and doubles to eight places (prices over a quantity of 32 end in a five at the seventh) or fewer, for long sums."""
    return df.select(*keys, *[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])
