"""Ordered work inside a key without one task per key.

A plain ``Window.partitionBy(key).orderBy(...)`` brings a whole key into one
task, and one session may hold a third of all rows. Here the key is cut into
chunks along its order. The window runs inside (key, chunk); what has to cross
a chunk border travels through a table with one row per chunk.

``chunk`` is a column that never decreases along the order, such as the row
number or the clock cut into fixed lengths. Keys and chunk must not be null. Where
nothing bounds the rows of a fixed length, ``bounded_chunks`` makes the column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.session import stage

CHUNK_ROWS = 1 << 16
_CHUNK = "__chunk"
#: Bits of a digit: a digit has at most 65,536 values, so its values can be put in order in one task.
DIGIT_BITS = 16


def cut(column: Column | str, length: int = CHUNK_ROWS) -> Column:
    """Whole-number chunk of a non-negative integer column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.call_function("div", column, F.lit(length))


def digits_of(column: Column, bits: int = 64) -> list[Column]:
    """A whole number as digits that sort like it; ``bits`` are its lowest bits that differ (64: any number, negative ones first)."""
    number = column.cast("bigint")
    if bits == 64:
        number = number.bitwiseXOR(F.lit(-(1 << 63)))
    return [F.shiftrightunsigned(number, at).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)) for at in range((bits - 1) // DIGIT_BITS * DIGIT_BITS, -1, -DIGIT_BITS)]


def digits_of_double(column: Column) -> list[Column]:
    """A double as digits that sort like it: its whole part, then 48 bits of the rest."""
    whole = F.floor(column)
    rest = column - whole
    parts = [F.floor(rest * float(1 << DIGIT_BITS * k)).cast("bigint").bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)) for k in (1, 2, 3)]
    return [*digits_of(whole), *parts]


def bounded_chunks(df: DataFrame, keys: Sequence[str], digits: Sequence[Column], limit: int = CHUNK_ROWS,
                   out: str = "__part") -> DataFrame:
    """Adds a chunk column of which no value holds over ``limit`` rows of a key, whatever the spread of the rows.

    ``digits`` are whole numbers that sort like the rows, the widest first (hour, microsecond
    of the hour, digits of an id). Cells of the first digit are counted; a cell over the limit is cut by
    the next digit into runs of about equal depth, and what is still over the limit by the one after
    it. Only the counts of such cells are put in order, at most one digit's values at a time. The map is
    as small as the number of heavy cells; where there are none, the first digit is the chunk. Rows
    that agree in all digits stay together.
    """
    names = [f"__u{i}" for i in range(len(digits))]
    rows, step, maps = df.withColumns(dict(zip(names, digits))), max(1, limit // 2), []
    counts = rows.groupBy(*keys, names[0]).agg(F.count(F.lit(1)).alias("__n"))
    for level in range(1, len(digits)):
        heavy = counts.where(F.col("__n") > limit).select(*keys, *names[:level])
        if heavy.isEmpty():
            break
        heavy = stage(heavy, "heavy")
        cell = W.partitionBy(*keys, *names[:level]).orderBy(names[level]).rowsBetween(W.unboundedPreceding, -1)
        inside = rows.join(heavy, [*keys, *names[:level]], "left_semi").groupBy(*keys, *names[: level + 1]).agg(F.count(F.lit(1)).alias("__n"))
        # A cell deeper than a step gets a run of its own; the others of a run add up to less than two steps.
        run = 2 * cut(F.coalesce(F.sum("__n").over(cell), F.lit(0)), step) + (F.col("__n") > step).cast("bigint")
        counts = stage(inside.withColumn(f"__c{level}", run), "chunks")
        maps.append(counts.drop("__n"))
    for level, found in enumerate(maps, 1):
        rows = rows.join(found, [*keys, *names[: level + 1]], "left")
    runs = [F.coalesce(F.col(f"__c{level}"), F.lit(0)).alias(f"c{level}") for level in range(1, len(maps) + 1)]
    return rows.withColumn(out, F.struct(F.col(names[0]).alias("c0"), *runs)).drop(*names, *[f"__c{k + 1}" for k in range(len(maps))])


def _one(names: Sequence[str]) -> Column:
    # A single primitive column keeps max_by inside the hash aggregate.
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def _split(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column):
    parts = df.withColumn(_CHUNK, chunk)
    laid_out = parts.repartition(*[F.col(k) for k in keys], F.col(_CHUNK))
    inside = W.partitionBy(*keys, _CHUNK).orderBy(*order)
    between = W.partitionBy(*keys).orderBy(_CHUNK)
    return parts, laid_out, inside, between


def with_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                 previous: Sequence[str] = (), out: str = "previous",
                 running: dict[str, Column] | None = None, include_current: bool = False) -> DataFrame:
    """Adds the previous row's values and running maxima in one pass.

    ``previous`` names the columns taken from the row before: one as it is,
    several as a struct, under ``out``. Each entry of ``running`` becomes the
    maximum of its expression over all earlier rows (and the row itself with
    ``include_current``).
    """
    running = running or {}
    df = df.withColumns({f"__v_{n}": c for n, c in running.items()})
    parts, laid_out, inside, between = _split(df, keys, order, chunk)
    earlier = between.rowsBetween(W.unboundedPreceding, -1)
    upto = inside.rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    facts = [F.max(f"__v_{n}").alias(f"__m_{n}") for n in running]
    carried = [F.max(f"__m_{n}").over(earlier).alias(f"__c_{n}") for n in running]
    if previous:
        facts.append(F.max_by(_one(previous), _one(order)).alias("__tail"))
        carried.append(F.lag("__tail").over(between).alias("__carry"))
    per_chunk = parts.groupBy(*keys, _CHUNK).agg(*facts).select(*keys, _CHUNK, *carried)
    rows = laid_out.withColumns({f"__r_{n}": F.max(f"__v_{n}").over(upto) for n in running})
    if previous:
        rows = rows.withColumns({
            "__first": F.row_number().over(inside) == 1, out: F.lag(_one(previous)).over(inside)})
    rows = rows.join(per_chunk, [*keys, _CHUNK], "left").withColumns(
        {n: F.greatest(f"__r_{n}", f"__c_{n}") for n in running})
    if previous:
        rows = rows.withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col(out)))
    return rows.drop(_CHUNK, "__first", "__carry", *[f"__{p}_{n}" for n in running for p in "vrc"])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                  values: Sequence[str], out: str = "previous") -> DataFrame:
    return with_history(df, keys, order, chunk, previous=values, out=out)


def with_running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                     values: dict[str, Column], include_current: bool = False) -> DataFrame:
    return with_history(df, keys, order, chunk, running=values, include_current=include_current)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                out: str = "row_no") -> DataFrame:
    """Adds a dense 0-based row number per key along ``order``."""
    parts, laid_out, inside, between = _split(df, keys, order, chunk)
    earlier = between.rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, _CHUNK, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    return (
        laid_out.withColumn("__in_chunk", F.row_number().over(inside))
        .join(offsets, [*keys, _CHUNK], "left")
        .withColumn(out, F.col("__before") + F.col("__in_chunk") - 1)
        .drop("__before", "__in_chunk", _CHUNK)
    )
