"""Interval unions, clip blocks and duration agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.plans.chunked import CHUNK_ROWS, bounded_chunks, digits_of_double, with_running_max


def covered_length(intervals: DataFrame, keys: Sequence[str], start: str, end: str,
                   chunk_length: int = 1 << 16, out: str = "covered", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Length of the union of intervals per key; touching ones merge.

    Intervals with one start are folded to the longest first, so copies never
    travel. Each interval then adds what lies beyond the furthest end before it. Starts are
    cut by ``chunk_length``, and where more than ``chunk_rows`` lie that close, by their depth.
    """
    folded = intervals.groupBy(*keys, F.col(start).alias("__s")).agg(F.max(end).alias("__e"))
    wide = F.floor(F.col("__s") / chunk_length)
    parts = bounded_chunks(folded, keys, [wide, *digits_of_double(F.col("__s"))], chunk_rows)
    reach = with_running_max(parts, keys, ["__s"], F.col("__part"), {"__reach": F.col("__e")})
    added = F.greatest(F.lit(0.0), F.col("__e") - F.greatest(F.col("__s"), F.col("__reach")))
    return reach.groupBy(*keys).agg(F.sum(added.cast("double")).alias(out))


def covered_seconds(support: Column, mask: Column) -> Column:
    """Same for one sample held as arrays of (start, end) and validity."""
    used = F.array_sort(F.filter(
        F.transform(F.arrays_zip(support.alias("s"), mask.alias("m")),
                    lambda z: F.when(z["m"], F.struct(z["s"]["start"].alias("a"), z["s"]["end"].alias("b")))),
        lambda v: v.isNotNull()))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(float("-inf")).alias("reach"))

    def add(acc: Column, iv: Column) -> Column:
        new = F.greatest(F.lit(0.0), iv["b"] - F.greatest(iv["a"], acc["reach"]))
        return F.struct((acc["total"] + new).alias("total"), F.greatest(acc["reach"], iv["b"]).alias("reach"))

    return F.aggregate(used, zero, add, lambda acc: acc["total"])


def coverage_ratio(support: Column, mask: Column, duration_s: float = C.CLIP_SECONDS,
                   cap: bool = True) -> Column:
    ratio = covered_seconds(support, mask) / duration_s
    return F.least(F.lit(1.0), ratio) if cap else ratio


def block_frames(clips: DataFrame, frames: str, block: int = 32_000, blocks: int = 5,
                 min_observed: float = C.MIN_COVERAGE) -> DataFrame:
    """Fixed blocks of each clip with the observed share and validity."""
    left = F.col("block_no") * block
    filled = F.least(left + block, F.col(frames)) - left
    share = F.when(filled > 0, filled / block).otherwise(0.0).cast("float")
    return (
        clips.withColumn("block_no", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("observed_fraction", share)
        .withColumn("block_valid", F.col("observed_fraction") >= F.lit(min_observed).cast("float"))
    )


def sync_audit(sessions: DataFrame, videos: DataFrame, keys: Sequence[str],
               tolerance_ms: float = 100.0, rate: float = C.NOMINAL_TELEMETRY_HZ) -> DataFrame:
    """Video length against telemetry rows at the nominal rate, per session.

    ``sessions`` has one row per key with ``source_rows``; ``videos`` has one
    row per video file with ``video_duration_s``. Only a single video counts.
    """
    single = videos.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("video_files"), F.max("video_duration_s").alias("__d"))
    telemetry_s = F.col("source_rows") / rate
    diff = (F.col("__d") - telemetry_s) * 1000.0
    unique = F.coalesce(F.col("video_files") == 1, F.lit(False))
    aligned = unique & (F.abs(diff) <= tolerance_ms)
    return (
        sessions.join(single, list(keys), "left")
        .withColumn("video_files", F.coalesce("video_files", F.lit(0)).cast("bigint"))
        .withColumn("video_duration_s", F.when(unique, F.col("__d")))
        .withColumn("telemetry_nominal_duration_s", F.when(unique, telemetry_s))
        .withColumn("duration_difference_ms", F.when(unique, diff))
        .withColumn("offset_ms", F.when(aligned, 0).cast("bigint"))
        .withColumn("sync_status", F.when(~unique, C.SYNC_NO_VIDEO)
                    .when(aligned, C.SYNC_ALIGNED).otherwise(C.SYNC_MISMATCH))
        .drop("__d")
    )
