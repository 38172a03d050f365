"""Exact grouped median that never holds a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.plans.chunked import CHUNK_ROWS, cut


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str,
                 bucket: int = CHUNK_ROWS) -> DataFrame:
    """Median per key of a non-negative integer column, nulls left out.

    Rows are first counted per distinct value, then per bucket of values. The
    bucket counts say where the middle ranks lie; only the values of those one
    or two buckets are put in order. The middle two are averaged when the
    number of rows is even.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__b", cut("__v", bucket))
    )
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    picked = (
        counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"))
        .withColumn("__total", F.sum("__bn").over(whole))
        .withColumn("__upto", F.sum("__bn").over(upto))
        .withColumn("__before", F.col("__upto") - F.col("__bn"))
        .withColumn("__low", cut(F.col("__total") - 1, 2))
        .withColumn("__high", cut("__total", 2))
        .where((F.col("__before") <= F.col("__high")) & (F.col("__upto") > F.col("__low")))
        .select(*keys, "__b", "__before", "__low", "__high")
    )
    inside = W.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        counts.join(picked, [*keys, "__b"])
        .withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
        .withColumn("__start", F.col("__end") - F.col("__n"))
    )

    def at(rank: str):
        hit = (F.col("__start") <= F.col(rank)) & (F.col(rank) < F.col("__end"))
        return F.max(F.when(hit, F.col("__v")))

    return ranked.groupBy(*keys).agg(((at("__low") + at("__high")) / 2.0).alias(out))
