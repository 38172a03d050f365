"""Counts, coverage tables and acceptance reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.operators.ordering import fatigue_subjects
from tidegrid.plans.guards import ContractError


def split_summary(windows: DataFrame, parents: DataFrame) -> DataFrame:
    """Per split: subjects, sessions, candidate/valid/excluded windows, complete parents."""
    w = windows.groupBy("split").agg(
        F.count_distinct("subject_id").alias("subject_count"),
        F.count_distinct("session_id").alias("session_count"),
        F.count(F.lit(1)).alias("candidate_windows"),
        F.count_if("valid").alias("valid_windows"),
        F.count_if(~F.col("valid")).alias("excluded_windows"),
        *[F.count_if(F.col("valid") & (F.col("label_class") == c)).alias(f"valid_{c}") for c in C.FATIGUE_CLASSES],
    )
    p = parents.where("complete_for_240s").groupBy("split").agg(F.count(F.lit(1)).alias("complete_parents"))
    return w.join(p, "split", "left").withColumn("complete_parents", F.coalesce("complete_parents", F.lit(0)).cast("bigint"))


def reason_counts(rows: DataFrame, codes: str) -> DataFrame:
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def split_codes(text: Column) -> Column:
    """Codes of a ``;``-joined text, empty parts left out."""
    return F.filter(F.split(text, ";"), lambda c: c != "")


def label_class_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("label_class").agg(
        F.count(F.lit(1)).alias("all_windows"), F.count_if("valid").alias("valid_windows"))


def subject_table(windows: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Every subject of the split with its counts, also those without rows."""
    subjects = fatigue_subjects(windows.sparkSession) if subjects is None else subjects
    counts = windows.groupBy("subject_id").agg(
        F.count_distinct("session_id").alias("session_count"),
        F.count(F.lit(1)).alias("window_count"), F.count_if("valid").alias("valid_window_count"))
    return subjects.join(counts, "subject_id", "left").na.fill(
        0, ["session_count", "window_count", "valid_window_count"])


def subject_sessions(windows: DataFrame) -> DataFrame:
    """The sessions of every subject, one per row: the list has no size bound."""
    return windows.select("subject_id", "session_id").distinct()


def dataset_coverage(windows: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = C.FATIGUE_CLASSES) -> DataFrame:
    """Windows, parents, subjects, sessions and class counts, zeros included."""
    return windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_distinct("parent_id").alias("parents"),
        F.count_distinct("subject_id").alias("subjects"),
        F.count_distinct("session_id").alias("sessions"),
        *[F.count_if(F.col("label_id") == i).alias(f"class_{c}") for i, c in enumerate(classes)],
    )


def count_differences(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Names whose actual count is not the frozen one."""
    a = actual.select(key, F.col(value).alias("actual"))
    e = expected.select(key, F.col(value).alias("expected"))
    return a.join(e, key, "full").where(~F.col("actual").eqNullSafe(F.col("expected")))


def assert_expected_counts(coverage: DataFrame, expected: dict[str, int]) -> None:
    """Stops the job unless the one coverage row equals the frozen counts."""
    row = coverage.select(*expected).first()
    got = row.asDict() if row else {}
    if got != expected:
        raise ContractError(f"frozen counts differ: expected {expected}, found {got}")


def clip_audit_totals(clips: DataFrame) -> DataFrame:
    """Totals of a clip audit as (metric, key, value) rows.

    ``clips`` holds one row per file: sample_id (null when the name did not
    parse), label_class, subject_id, qc_status, arrays flags and reason_codes,
    measured_duration_s (null when undecoded), tail_shortfall_s.
    """
    named = F.col("sample_id").isNotNull()
    decoded = named & F.col("measured_duration_s").isNotNull()
    d = F.when(decoded, F.col("measured_duration_s"))
    s = F.when(decoded, F.col("tail_shortfall_s"))
    single = clips.agg(
        F.count(F.lit(1)).cast("double").alias("files_total"),
        F.count_if(named).cast("double").alias("rows_total"),
        F.count_if(~named).cast("double").alias("unparsed_total"),
        F.count(d).cast("double").alias("duration_count"),
        F.round(F.min(d), 6).alias("duration_min_s"), F.round(F.max(d), 6).alias("duration_max_s"),
        F.round(F.avg(d), 6).alias("duration_mean_s"),
        F.count(s).cast("double").alias("shortfall_count"),
        F.round(F.min(s), 6).alias("shortfall_min_s"), F.round(F.max(s), 6).alias("shortfall_max_s"),
    )
    totals = single.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).alias("value")) for c in single.columns])))
    # One pass over the files for all five breakdowns.
    facts = F.concat(
        F.array(
            F.struct(F.lit("rows_by_class").alias("metric"), F.col("label_class").alias("key")),
            F.struct(F.lit("rows_by_subject").alias("metric"), F.col("subject_id").alias("key")),
            F.struct(F.lit("rows_by_qc_status").alias("metric"), F.col("qc_status").alias("key")),
        ),
        F.transform("flags", lambda f: F.struct(F.lit("flag_counts").alias("metric"), f.alias("key"))),
        F.transform("reason_codes", lambda f: F.struct(F.lit("reason_counts").alias("metric"), f.alias("key"))),
    )
    parts = clips.where(named).select(F.inline(facts)).groupBy("metric", "key").agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    return totals.unionByName(parts)


def feature_dims(bundles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Widths found per group, and whether the group has exactly one."""
    width = F.size(F.get("x", F.lit(0)))
    return bundles.groupBy(*by).agg(
        F.min(width).alias("min_dim"), F.max(width).alias("max_dim"), F.count(F.lit(1)).alias("samples"),
        (F.min(width) == F.max(width)).alias("consistent"))


def acceptance_report(windows: DataFrame, problems: DataFrame, expected: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Per split: coverage, number of rows with a finding, PASS or FAIL.

    ``problems`` has split and sample_id, one row per finding.
    """
    found = problems.groupBy("split", "sample_id").agg(F.lit(1).alias("one")).groupBy("split").agg(
        F.count("one").alias("problem_samples"))
    table = dataset_coverage(windows, ["split"]).join(found, "split", "left")
    table = table.withColumn("problem_samples", F.coalesce("problem_samples", F.lit(0)).cast("bigint"))
    ok = F.col("problem_samples") == 0
    for split, wanted in (expected or {}).items():
        for name, value in wanted.items():
            ok = ok & ((F.col("split") != split) | (F.col(name) == value))
    return table.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def summary_report(**parts: DataFrame) -> DataFrame:
    """One JSON text out of small aggregate tables.

    Every part must already be an aggregate of bounded size (per split, class,
    code or one row); rows are gathered per part in their own order.
    """
    out = None
    for name, table in parts.items():
        row = F.to_json(F.struct(*table.columns))
        packed = table.select(row.alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
        piece = packed.select(F.lit(name).alias("section"), F.concat(
            F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("body"))
        out = piece if out is None else out.unionByName(piece)
    item = F.concat(F.lit('"'), F.col("section"), F.lit('":'), F.col("body"))
    return out.agg(F.array_sort(F.collect_list(item)).alias("i")).select(
        F.concat(F.lit("{"), F.array_join("i", ","), F.lit("}")).alias("report"))
