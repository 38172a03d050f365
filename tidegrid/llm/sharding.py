"""Shards of near equal size by sampled splitters, in built-in functions only.

Keys are sampled with a chance in proportion to the size of their rows; the quantiles of
the sample cut the key order into ranges. A range with too many rows is cut again by a
sample of its own, so that no task orders more than a bounded number of rows. Totals of
the ranges then place every row exactly in the order of all rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import staged

#: Rows drawn in one sampling round, about; and ranges cut from them.
SAMPLES, RANGES = 8192, 256
#: Rows that one range may hold.
RANGE_ROWS = 2_000_000


def _draw(rows: DataFrame, total: int, samples: int) -> list[tuple]:
    """Keys with the size each stands for. A row is drawn with chance size * samples / total."""
    chance = F.col("size") * F.lit(samples / max(1, total))
    uniform = F.expr("(xxhash64(doc_id, uid) & 9007199254740991) / 9007199254740992D")
    drawn = rows.where(uniform < chance).select("doc_id", "uid", F.greatest(F.col("size").cast("double"), F.lit(total / samples)))
    return sorted(map(tuple, drawn.collect()), key=_order)


def _order(key: tuple) -> tuple:
    return (key[0] is not None, key[0] or 0, key[1])


def _quantiles(sample: list[tuple], ranges: int) -> list[tuple]:
    """Keys that cut the sampled size into equal parts."""
    whole, done, cuts = sum(s[2] for s in sample), 0.0, []
    for doc_id, uid, weight in sample:
        done += weight
        if len(cuts) < ranges - 1 and done >= whole * (len(cuts) + 1) / ranges:
            cuts.append((doc_id, uid))
    return cuts


def _range_of(cuts: list[tuple]) -> Column:
    """Number of splitters at or before a row's key, by two short searches: the block, then inside the block."""
    def lit(key: tuple) -> Column:
        return F.struct((F.lit(None) if key[0] is None else F.lit(key[0])).cast("long").alias("doc_id"), F.lit(key[1]).cast("long").alias("uid"))

    if not cuts:
        return F.lit(0)
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("uid").alias("uid"))
    width = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i: i + width] for i in range(0, len(cuts), width)]
    block = F.size(F.filter(F.array(*(lit(b[0]) for b in blocks)), lambda c: c <= key))
    inside = F.array(*(F.array(*map(lit, b)) for b in blocks))
    return F.when(block == 0, 0).otherwise(
        (block - 1) * width + F.size(F.filter(F.get(inside, block - 1), lambda c: c <= key)))


def size_records(docs: DataFrame) -> DataFrame:
    """One staged row per input row: doc_id, size (UTF-8 bytes and 1), text_crc32 and a fixed row number as tie breaker."""
    text = F.coalesce("text", F.lit(""))
    return staged(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
                  .withColumn("uid", F.monotonically_increasing_id()), "records")


def cut_ranges(records: DataFrame, range_rows: int = RANGE_ROWS, ranges: int = RANGES,
               samples: int = SAMPLES) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``records`` with ``range_id`` in key order, and each range's (size, rows); no range holds over ``range_rows`` rows."""
    total = records.agg(F.sum("size")).first()[0] or 0
    cuts = _quantiles(_draw(records, total, samples), ranges)
    while True:
        ranged = records.withColumn("range_id", _range_of(cuts))
        held = {r["range_id"]: (r["s"], r["n"]) for r in
                ranged.groupBy("range_id").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
        overfull = {i: s for i, (s, n) in held.items() if n > range_rows}
        if not overfull:
            return ranged, [held.get(i, (0, 0)) for i in range(len(cuts) + 1)]
        whole = sum(overfull.values())
        again = _draw(ranged.where(F.col("range_id").isin(list(overfull))), whole, samples)
        parts: dict[int, list[tuple]] = {}
        at = [_order(c) for c in cuts]
        for key in again:
            parts.setdefault(bisect_right(at, _order(key)), []).append(key)
        for i, keys in parts.items():
            cuts += _quantiles(keys, max(2, 2 * held[i][1] // range_rows))
        cuts = sorted(set(cuts), key=_order)


def assign_shards(docs: DataFrame, shards: int = 16, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows go to shards in the order of doc_id (nulls first, repeated ids in any fixed order), each
    by the middle of its bytes, so that shards differ by less than the largest row. A null text
    counts one byte; an empty table gives no row; other columns are left out.
    """
    ranged, held = cut_ranges(size_records(docs), range_rows)
    sizes, counts, starts = 0, 0, []
    for size, n in held:
        starts.append((sizes, counts))
        sizes, counts = sizes + size, counts + n
    before = F.array(*(F.struct(F.lit(s).cast("long").alias("s"), F.lit(n).cast("long").alias("n")) for s, n in starts))
    order = Window.partitionBy("range_id").orderBy(F.col("doc_id").asc_nulls_first(), "uid")
    placed = ranged.select(
        "doc_id", "size", "text_crc32", F.get(before, "range_id").alias("before"),
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.row_number().over(order).alias("number"))
    middle = 2 * (F.col("before.s") + F.col("upto")) - F.col("size")
    placed = staged(placed.select(
        "doc_id", "size", "text_crc32", (F.col("before.n") + F.col("number") - 1).alias("place"),
        F.floor(middle * shards / F.lit(2 * max(1, sizes))).cast("int").alias("shard")), "placed")
    first = {r["shard"]: r["place"] for r in placed.groupBy("shard").agg(F.min("place").alias("place")).collect()}
    begin = F.array(*(F.lit(first.get(i, 0)).cast("long") for i in range(shards)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.get(begin, "shard")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
