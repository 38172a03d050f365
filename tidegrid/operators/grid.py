"""Window grids over sessions, parents and completeness (exact millisecond times)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids
from tidegrid.functions.numeric import codes_where


def candidate_grid(labels: DataFrame, window_ms: int = C.WINDOW_MS,
                   windows: int = C.WINDOWS_PER_PARENT) -> DataFrame:
    """Every window of every labelled interval.

    ``labels`` holds subject_id, session_id, label_index and kss_score. Rows of
    a subject outside the fixed split are left out, as they are no candidates.
    """
    parent_ms = window_ms * windows
    start = F.col("label_start_ms") + F.col("window_index").cast("bigint") * window_ms
    return (
        labels.withColumn("split", ids.fatigue_split(F.col("subject_id")))
        .where("split is not null")
        .withColumn("label_start_ms", F.col("label_index").cast("bigint") * parent_ms)
        .withColumn("label_end_ms", F.col("label_start_ms") + parent_ms)
        .withColumn("label_id", ids.kss_label_id(F.col("kss_score")))
        .withColumn("label_class", ids.kss_label_class(F.col("kss_score")))
        .withColumn("window_index", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
        .withColumn("window_start_ms", start)
        .withColumn("window_end_ms", F.col("window_start_ms") + window_ms)
        .withColumn("duration_ms", F.lit(window_ms).cast("bigint"))
        .withColumn("sample_id", ids.window_id(
            F.col("session_id"), F.col("window_start_ms"), F.col("window_end_ms")))
        .withColumn("parent_id", ids.window_id(
            F.col("session_id"), F.col("label_start_ms"), F.col("label_end_ms")))
    )


def window_rule_codes(window_ms: int = C.WINDOW_MS, parent_ms: int = C.PARENT_MS) -> Column:
    """Codes of the window/parent geometry rules broken by a row."""
    start, end = F.col("window_start_ms"), F.col("window_end_ms")
    first, last = F.col("label_start_ms"), F.col("label_end_ms")
    return codes_where(
        ("duration", (end - start != window_ms) | (F.col("duration_ms") != window_ms)),
        ("off_grid", (start < 0) | (start % window_ms != 0)),
        ("parent", (first < 0) | (first % parent_ms != 0) | (last - first != parent_ms)),
        ("outside_parent", (start < first) | (end > last) | (start >= end)),
        ("window_index", F.col("window_index") != F.call_function("div", start - first, F.lit(window_ms))),
    )


def stride_check(windows: DataFrame, keys: Sequence[str], start: str = "window_start_ms",
                 stride: int = C.STRIDE_MS) -> DataFrame:
    """Per session: do the distinct starts step by exactly ``stride``?

    Distinct integers step by s everywhere exactly when they all agree modulo s
    and their number is (max-min)/s + 1, so no ordering is needed. The first
    aggregation brings copies of a start together before the session is a key.
    """
    starts = windows.groupBy(*keys, F.col(start).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return starts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_starts"),
        F.min("s").alias("first_start"),
        F.max("s").alias("last_start"),
        ((F.min(F.pmod("s", F.lit(stride))) == F.max(F.pmod("s", F.lit(stride))))
         & (F.max("s") - F.min("s") == (F.count(F.lit(1)) - 1) * stride)).alias("regular"),
    )


def full_grid_check(windows: DataFrame, keys: Sequence[str], start: str = "window_start_ms",
                    stride: int = C.STRIDE_MS, length: int = C.SESSION_GRID_MS) -> DataFrame:
    """Per session: are the starts exactly 0, stride, … up to ``length``?"""
    s, cells = F.col(start), length // stride
    on_grid = (s >= 0) & (s < length) & (s % stride == 0)
    starts = windows.groupBy(*keys, s.alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.first(on_grid).alias("ok"))
    return starts.groupBy(*keys).agg(
        F.sum("n").alias("window_count"),
        ((F.sum("n") == cells) & (F.count(F.lit(1)) == cells) & F.bool_and("ok")).alias("full_grid"),
    )


def index_set_is_full(index: Column, size: int) -> Column:
    """Aggregate: the group holds 0 … size-1, each once (size up to 62)."""
    bits = F.bit_or(F.when(index.between(0, size - 1), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), index.cast("int"))))
    return F.coalesce(
        (F.count(F.lit(1)) == size) & (bits == (1 << size) - 1), F.lit(False))


def merged_codes(codes: Column, known: Sequence[str] | None = None) -> Column:
    """Aggregate: sorted union of code arrays; null arrays add nothing.

    With ``known`` (up to 62 codes) the buffer is one number with a bit per code, and
    a code outside the list, null too, stops the query. Without it the buffer holds the distinct arrays.
    """
    if known is None:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(codes))))
    names = sorted(set(known))
    if len(names) > 62:
        raise ValueError("a mask holds at most 62 codes")
    mask = F.lit(0).cast("bigint")
    for i, name in enumerate(names):
        mask = mask + F.when(F.array_contains(codes, name), F.lit(1 << i)).otherwise(F.lit(0))
    listed = F.array(*[F.lit(n) for n in names])
    # Most arrays name each code once, and then as many as there are bits: only others are searched for unknown codes.
    sound = (F.size(codes) == F.bit_count(mask)) | (F.size(F.array_except(codes, listed)) == 0)
    text = F.concat(F.lit("code outside the list: "), F.to_json(codes))
    merged = F.bit_or(F.when(codes.isNull(), F.lit(0).cast("bigint")).when(sound, mask).otherwise(F.raise_error(text).cast("bigint")))
    return F.array_compact(F.array(*[F.when(merged.bitwiseAND(F.lit(1 << i)) != 0, name) for i, name in enumerate(names)]))


_PARENT_IDENTITY = (
    "subject_id", "session_id", "split", "label_start_ms", "label_end_ms",
    "kss_score", "label_class", "label_id",
)


def parent_manifest(windows: DataFrame, parent: str = "parent_id", order: str = "row_no",
                    size: int = C.WINDOWS_PER_PARENT,
                    identity: Sequence[str] = _PARENT_IDENTITY, known: Sequence[str] | None = None) -> DataFrame:
    """One row per parent: identity of its first row, counts, completeness, reasons.

    Needs ``window_index``, ``valid`` (boolean) and ``qc_reason_codes`` (array, of the codes in ``known`` if given).
    The aggregate holds numbers only if the codes are known. The first rows are found apart from it, one per parent
    and task before the shuffle, and both sides meet where the parents already are. Windows without a
    parent (null) form one row without identity.
    """
    full = index_set_is_full(F.col("window_index"), size)
    facts = windows.groupBy(parent).agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count_if(F.col("valid")).alias("valid_window_count"),
        full.alias("__full"),
        merged_codes(F.col("qc_reason_codes"), known).alias("qc_reason_codes"),
    )
    place = F.row_number().over(W.partitionBy(parent).orderBy(F.col(order).asc_nulls_last()))
    first = windows.select(parent, order, *[c for c in identity if c not in (parent, order)]).withColumn("__place", place).where("__place = 1")
    return facts.join(first.select(parent, F.struct(*identity).alias("__first")), parent, "left").select(
        parent, "__first.*", "window_count", "valid_window_count",
        (F.col("__full") & (F.col("valid_window_count") == size)).alias("complete_for_240s"),
        "qc_reason_codes",
    )


def complete_parents(pairs: DataFrame, window_ms: int = C.WINDOW_MS,
                     windows: int = C.WINDOWS_PER_PARENT) -> DataFrame:
    """Parents whose valid pairs fill the interval exactly, with one true label.

    ``pairs`` needs the pair identity columns and boolean ``paired_valid``. The
    ``windows`` identifiers of a kept parent come as an ordered array; the group
    size is fixed by the rule before the identifiers are gathered.
    """
    parent_ms = window_ms * windows
    keys = ["split", "subject_id", "session_id", "label_start_ms", "label_end_ms"]
    start, first = F.col("window_start_ms"), F.col("label_start_ms")
    offset = start - first
    slot = F.when((offset >= 0) & (offset % window_ms == 0),
                  F.call_function("div", offset, F.lit(window_ms)))
    label = F.struct("kss_score", "label_class", "label_id")
    fits = F.col("window_end_ms") - start == window_ms
    slots = [
        F.max(F.when(F.col("__slot") == i, F.col("paired_sample_id"))).alias(f"__id{i}")
        for i in range(windows)
    ]
    grouped = (
        pairs.where("paired_valid").withColumn("__slot", slot)
        .groupBy(*keys)
        .agg(
            index_set_is_full(F.col("__slot"), windows).alias("__full"),
            F.bool_and(fits).alias("__fits"),
            F.min(label).alias("__lo"), F.max(label).alias("__hi"),
            *slots,
        )
    )
    true_label = (
        (F.col("__lo.label_id") == ids.kss_label_id(F.col("__lo.kss_score")))
        & (F.col("__lo.label_class") == ids.kss_label_class(F.col("__lo.kss_score")))
    )
    return (
        grouped.where(
            F.col("__full") & F.col("__fits") & (F.col("__lo") == F.col("__hi")) & true_label
            & (F.col("label_end_ms") - first == parent_ms))
        .select(
            ids.pair_id(F.col("subject_id"), F.col("session_id"), first,
                        F.col("label_end_ms")).alias("parent_id"),
            *keys, "__lo.*", F.lit(windows).cast("bigint").alias("window_count"),
            F.array(*[f"__id{i}" for i in range(windows)]).alias("paired_sample_ids"),
        )
    )


def mark_eligible(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds complete8_eligible, its exclusion reason and the parent id.

    The parent key is joined instead of the identifiers: every valid row of a
    kept parent key is one of its windows.
    """
    keys = ["split", "subject_id", "session_id", "label_start_ms", "label_end_ms"]
    kept = parents.select(*keys, F.col("parent_id").alias("__parent"))
    eligible = F.col("__parent").isNotNull() & F.col("paired_valid")
    joined = pairs.join(kept, keys, "left").withColumn("complete8_eligible", eligible)
    if "parent_id" in pairs.columns:
        parent = F.when(eligible, F.col("__parent")).otherwise(F.col("parent_id"))
    else:
        parent = F.when(eligible, F.col("__parent")).otherwise("")
    return (
        joined.withColumn("parent_id", parent)
        .withColumn("complete8_exclude_reason",
                    F.when(F.col("complete8_eligible"), "")
                    .when(F.col("paired_valid"), "incomplete_240s_parent")
                    .otherwise("pair_invalid"))
        .drop("__parent")
    )


def restrict_to_complete(windows: DataFrame, parents: DataFrame, size: int = C.WINDOWS_PER_PARENT
                         ) -> tuple[DataFrame, DataFrame]:
    """Windows of the listed parents, and the listed parents that do not hold.

    A listed parent fails when it has no window (``missing``), not each index
    once (``window_indices``) or more than one label (``labels``).
    """
    listed = parents.select("parent_id").distinct()
    kept = windows.join(listed, "parent_id", "left_semi")
    state = kept.groupBy("parent_id").agg(
        index_set_is_full(F.col("window_index"), size).alias("__full"),
        (F.min("label_id") == F.max("label_id")).alias("__one"),
    )
    problems = (
        listed.join(state, "parent_id", "left")
        .withColumn("code", F.when(F.col("__full").isNull(), "missing")
                    .when(~F.col("__full"), "window_indices")
                    .when(~F.col("__one"), "labels"))
        .where("code is not null").select("parent_id", "code")
    )
    return kept, problems


def missing_source_windows(grid: DataFrame, sessions_with_data: DataFrame) -> DataFrame:
    """All windows of labelled sessions without any telemetry, kept as failed rows."""
    have = sessions_with_data.select("session_id").distinct()
    return grid.join(have, "session_id", "left_anti").withColumns({
        "valid": F.lit(False),
        "valid_ratio": F.lit(0.0),
        "error": F.lit(C.SOURCE_MISSING),
        "clock_status": F.lit("source_missing"),
        "qc_status": F.lit("FAIL"),
        "qc_reason_codes": F.array(F.lit(C.SOURCE_MISSING)),
    })
