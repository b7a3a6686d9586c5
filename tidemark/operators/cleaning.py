"""Row and column rules that feeds go through before features are made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_contract(df: DataFrame, columns: list[str], fill: bool = False) -> DataFrame:
    """Those of the columns that df has, in their order; with fill the others as 0.0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns if fill or c in df.columns])


def first_available(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that df has."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {names} is there")


def positive_times(df: DataFrame, time: str) -> DataFrame:
    return df.where(F.col(time) > 0)


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have all keys."""
    return df.na.drop(subset=keys)


def with_values(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """Rows with values in at least that share of the columns, rounded down."""
    return df.na.drop(thresh=int(share * len(columns)), subset=columns)


def not_empty(df: DataFrame, columns: list[str], whole: bool = False) -> DataFrame:
    """Rows with a value in any of the columns; whole: in all."""
    return df.na.drop("any" if whole else "all", subset=columns)


def large_moves(df: DataFrame, column: str, over: float) -> DataFrame:
    return df.where(F.abs(F.col(column)) > over)


def outer_all(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All frames joined on the keys, fully outer; of columns that several frames have, the first frame's stay."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(*keys, *[c for c in b.columns if c not in a.columns]), keys, "full")

    return reduce(join, frames)
