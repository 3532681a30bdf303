"""Columns by their exact names, whatever characters these have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that further columns can't clash with them."""
    return F.struct(*(col(c) for c in df.columns))


def unpacked(struct: str, names: list[str]) -> list[Column]:
    return [F.col(f"{struct}.{quoted(c)}").alias(c) for c in names]
