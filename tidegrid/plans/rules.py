"""Ordered rule lists: the first rule a row breaks is the one reported."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``ok`` must hold; a null result counts as broken."""

    name: str
    ok: Column


def first_broken(rules: Sequence[Rule]) -> Column:
    """1-based position of the first broken rule, null when all hold.

    ``coalesce`` stops at the first non-null argument, so a later rule is never
    evaluated on a row an earlier rule has refused.
    """
    return F.coalesce(*[
        F.when(~F.coalesce(rule.ok, F.lit(False)), F.lit(i))
        for i, rule in enumerate(rules, start=1)
    ])


def rule_name(position: Column, rules: Sequence[Rule]) -> Column:
    return F.get(F.array(*[F.lit(r.name) for r in rules]), position - 1)


def position_of(name: str, rules: Sequence[Rule]) -> int:
    return [r.name for r in rules].index(name) + 1


def passed(position: str, name: str, rules: Sequence[Rule]) -> Column:
    """The row got past rule ``name`` (and so past all rules before it)."""
    return F.col(position).isNull() | (F.col(position) > position_of(name, rules))


def broken_rows(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str],
                code: str | None = None) -> DataFrame:
    """One row per broken input row: ``keep`` columns, ``code`` and ``rule``."""
    hits = df.withColumn("__at", first_broken(rules)).where("__at is not null")
    name = rule_name(F.col("__at"), rules)
    return hits.select(*keep, (F.lit(code) if code else name).alias("code"), name.alias("rule"))
