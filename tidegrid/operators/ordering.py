"""Repeats, previous-row rules, samples, orders and row sets.

Rules that look at the row before use the row number as chunk, so a subject or
label holding any share of the rows is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.plans.chunked import CHUNK_ROWS, cut, number_rows, with_previous
from tidegrid.plans.guards import ContractError, require_none


def flag_repeats(rows: DataFrame, keys: Sequence[str], order: str = "row_no",
                 out: str = "is_repeat", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """True on every row of a key after its first."""
    numbered = number_rows(rows, keys, [order], cut(order, chunk_rows), "__copy")
    return numbered.withColumn(out, F.col("__copy") > 0).drop("__copy")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def changed_from_previous(rows: DataFrame, keys: Sequence[str], value: str, order: str = "row_no",
                          out: str = "changed", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """True where ``value`` differs from the key's row before.

    With subject and split this is the split leakage rule, with the parent and
    its score the label conflict rule: both compare with the last seen value.
    """
    seen = with_previous(rows, keys, [order], cut(order, chunk_rows), [value], "__before")
    differs = F.coalesce(F.col("__before") != F.col(value), F.lit(False))
    return seen.withColumn(out, differs).drop("__before")


def stratified_even_sample(rows: DataFrame, label: str, n: int, classes: int = 3,
                           order: str = "row_no", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``n`` rows split evenly over the labels, evenly spaced in table order.

    The wanted ranks follow from each label's row count alone, so one equi-join
    on (label, rank) picks the rows. A label with fewer rows than its share, or with
    none, stops the query: its rows would come twice or be missing.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    held = {r[label]: r["__size"] for r in sizes.where(F.col(label).between(0, classes - 1)).collect()}  # a row per label
    short = [i for i in range(classes) if held.get(i, 0) < n // classes + (i < n % classes)]
    if short:
        raise ContractError(f"too few rows of label {short}")
    quota = F.lit(n // classes) + F.when(F.col(label) < n % classes, 1).otherwise(0)
    last = F.col("__size") - 1
    i, q = F.col("__i"), F.col("__quota")
    spot = F.when(q == 1, F.lit(0)).when(i == q - 1, last).otherwise(F.floor(i * (last / (q - 1))))
    wanted = (
        sizes.withColumn("__quota", quota).where("__quota > 0")
        .withColumn("__i", F.explode(F.sequence(F.lit(0), q - 1)))
        .select(label, spot.cast("bigint").alias("__rank"))
    )
    ranked = number_rows(rows, [label], [order], cut(order, chunk_rows), "__rank")
    return ranked.join(wanted, [label, "__rank"]).drop("__rank")


def first_n_eligible(rows: DataFrame, eligible: Column, order: Sequence[str], n: int) -> DataFrame:
    return rows.where(eligible).orderBy(*order).limit(n)


def require_n(rows: DataFrame, n: int) -> DataFrame:
    if rows.count() < n:
        raise ContractError(f"fewer than {n} eligible rows")
    return rows


def split_rank(split: Column) -> Column:
    return F.when(split == "train", 0).when(split == "val", 1).when(split == "test", 2).otherwise(3)


def manifest_order(rows: DataFrame, start: str = "window_start_ms") -> DataFrame:
    """train, val, test; then subject, session and start as a number."""
    return rows.orderBy(split_rank(F.col("split")), "subject_id", "session_id", F.col(start).cast("bigint"))


def pair_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("subject_id", "session_id", F.col("window_start_ms").cast("bigint"))


def examples(rows: DataFrame, code: str, sample: str, k: int = 5) -> DataFrame:
    """Count of every code and its first ``k`` ids in order.

    The rank limit is applied in every input partition before the shuffle, so a
    code that holds most of the rows sends k rows per task, not all of them.
    """
    distinct = rows.groupBy(code, sample).agg(F.count(F.lit(1)).alias("__n"))
    top = (
        distinct.withColumn("__r", F.row_number().over(W.partitionBy(code).orderBy(sample)))
        .where(F.col("__r") <= k)
        .groupBy(code).agg(F.array_sort(F.collect_list(sample)).alias("examples"))
    )
    counts = distinct.groupBy(code).agg(F.sum("__n").alias("n"))
    return counts.join(top, code)


def intersect_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def minus_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).subtract(right.select(key))


def partition_valid(rows: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the others with their error.

    A valid row with an error or without a feature contradicts itself and stops
    the job when ``check`` is set.
    """
    valid = F.lower(F.trim("valid")).isin("true", "1")
    clash = valid & ((F.trim("error") != "") | (F.trim("feature_path") == ""))
    if check:
        require_none(rows, clash, "valid row with an error or without a feature")
    reason = F.when(F.col("error") == "", "INVALID_WITHOUT_ERROR").otherwise(F.col("error"))
    return rows.where(valid), rows.where(~valid).withColumn("error", reason)


def fatigue_subjects(spark) -> DataFrame:
    """The fixed subject split as a table (16 rows)."""
    rows = [(s, split) for split in C.SPLITS for s in C.FATIGUE_SUBJECTS[split]]
    pairs = F.array(*[F.struct(F.lit(s).alias("subject_id"), F.lit(p).alias("split")) for s, p in rows])
    return spark.range(1).select(F.inline(pairs))
