"""Checks that stop a job. Each takes at most one row to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """The data breaks a rule the job depends on."""


class LockedSplitError(PermissionError):
    """The test split was asked for without leave."""


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "key") -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ContractError(f"duplicate {what}: {[twice[0][k] for k in keys]}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ContractError(f"{what} is empty")
    return df


def require_none(df: DataFrame, bad: Column, what: str) -> DataFrame:
    hit = df.where(bad).limit(1).collect()
    if hit:
        raise ContractError(f"{what}: {hit[0].asDict()}")
    return df


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df
