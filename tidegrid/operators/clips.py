"""Clip quality rules and six-class clip metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids
from tidegrid.functions.numeric import codes_where
from tidegrid.functions.parsing import is_safe_relative_path


def clip_qc(facts: DataFrame) -> DataFrame:
    """Flags, blocking reasons, status and primary error of each clip.

    ``facts`` has samplerate, channels, sample_width_bytes, nframes,
    nonzero_samples, clipped_ratio and decode_error ('' when decoded). Where it also has
    samples, the number really read, a header without data behind it is empty audio.
    """
    read = F.col("samples") if "samples" in facts.columns else F.col("nframes")
    measured = F.when(F.col("samplerate") > 0, F.col("nframes") / F.col("samplerate")).otherwise(0.0)
    shortfall = F.when(measured > 0, F.greatest(F.lit(0.0), C.CLIP_SECONDS - measured)).otherwise(C.CLIP_SECONDS)
    observed = F.when(measured > 0, F.least(measured, F.lit(C.CLIP_SECONDS)) / C.CLIP_SECONDS).otherwise(0.0)
    wide = F.col("sample_width_bytes") == C.CLIP_WIDTH
    empty = (F.col("nframes") == 0) | (wide & (read == 0))
    sixteen_bit = ~empty & wide
    short = (measured < C.CLIP_SECONDS) & ~(measured > C.CLIP_SECONDS + C.CLIP_SLACK_S)
    minor = short & (shortfall <= C.CLIP_TAIL_S)
    found = [
        ("SAMPLE_RATE_DEVIATION", F.col("samplerate") != C.CLIP_RATE, True),
        ("CHANNELS_NOT_STEREO", F.col("channels") != C.CLIP_CHANNELS, True),
        ("SAMPLE_WIDTH_NOT_16BIT", F.col("sample_width_bytes") != C.CLIP_WIDTH, True),
        ("EMPTY_AUDIO", empty, True),
        ("ZERO_AUDIO", sixteen_bit & (F.col("nonzero_samples") == 0), True),
        ("POSSIBLE_CLIPPING", sixteen_bit & (F.col("clipped_ratio") > C.CLIP_PEAK_RATIO), False),
        ("LONGER_THAN_NOMINAL", measured > C.CLIP_SECONDS + C.CLIP_SLACK_S, True),
        ("MINOR_TAIL_SHORTFALL", minor, False),
        ("TAIL_SHORTFALL_EXCEEDS", short & ~minor, True),
    ]
    decoded = F.col("decode_error") == ""
    none = F.array().cast("array<string>")
    flags = codes_where(*[(name, cond) for name, cond, _ in found])
    reasons = codes_where(*[(name, cond) for name, cond, blocks in found if blocks])

    def measured_as(value: Column) -> Column:
        return F.when(decoded, F.round(value, 6))

    return (
        facts
        .withColumn("flags", F.when(decoded, flags).otherwise(none))
        .withColumn("reason_codes", F.when(decoded, reasons).otherwise(F.array("decode_error")))
        .withColumn("measured_duration_s", measured_as(measured))
        .withColumn("tail_shortfall_s", measured_as(shortfall))
        .withColumn("raw_observed_fraction", measured_as(observed))
        .withColumn("qc_status", F.when(F.size("reason_codes") > 0, "pending")
                    .when(F.size("flags") > 0, "pass_with_flags").otherwise("pass"))
        .withColumn("primary_error", F.coalesce(F.get("reason_codes", F.lit(0)), F.lit("")))
    )


def clip_metadata(qc: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Nine-class metadata of audited clips (``source_file`` plus clip_qc columns).

    Files whose name does not parse are kept with a null sample_id, so that the
    totals can count them.
    """
    ref = qc.withColumn("__ref", ids.parse_clip_name(F.col("source_file")))
    task = F.col("__ref.task_code")
    rows = (
        ref
        .withColumn("sample_id", F.col("__ref.stem"))
        .withColumn("modality", F.lit("audio"))
        .withColumn("subject_id", F.col("__ref.subject_id"))
        .withColumn("session_id", F.when(F.col("__ref").isNotNull(), ids.clip_session_id(
            F.col("__ref.subject_id"), F.col("__ref.date"), F.col("__ref.start_hhmmss"))))
        .withColumn("label_id", ids.nine_class_id(task))
        .withColumn("label_class", ids.nine_class_name(task))
        .withColumn("error", F.when(F.col("primary_error") != "", F.col("primary_error")).otherwise(C.NO_FEATURES))
        .drop("__ref")
    )
    if splits is None:
        return rows.withColumn("split", F.lit(""))
    joined = rows.join(splits.select("subject_id", "split"), "subject_id", "left")
    return joined.withColumn("split", F.coalesce("split", F.lit("")))


def index_problems(index: DataFrame) -> DataFrame:
    """Rows of a feature index that break its contract, with the first code.

    A repeated id is reported on every one of its rows.
    """
    copies = index.groupBy("sample_id").agg(F.count(F.lit(1)).alias("__copies"))
    rows = index.join(copies, "sample_id", "left")
    positive = lambda c: F.col(c).isNull() | (F.col(c) >= 1)
    code = (
        F.when(F.coalesce(F.col("sample_id"), F.lit("")) == "", "sample_id")
        .when(F.col("__copies") > 1, "duplicate")
        .when(~is_safe_relative_path(F.col("path")), "path")
        .when(~F.lower("path").endswith(".npz"), "suffix")
        .when(F.coalesce(F.col("status"), F.lit("")) == "", "status")
        .when(~positive("T"), "T").when(~positive("D"), "D")
    )
    return rows.withColumn("code", code).where("code is not null").drop("__copies")


def attach_features_strict(audit: DataFrame, index: DataFrame, bundles: DataFrame) -> DataFrame:
    """Six-class state of each audited clip: the first obstacle, or valid.

    ``audit``: sample_id, error. ``index``: sample_id, path, status. ``bundles``:
    path, bundle_error ('' when all array rules hold), coverage, shape, dtype.
    """
    entry = index.select("sample_id", F.col("path").alias("__path"), F.col("status").alias("__status"))
    facts = bundles.select(F.col("path").alias("__path"), "bundle_error", "coverage", "shape", "dtype")
    joined = audit.join(entry, "sample_id", "left").join(facts, "__path", "left")
    audit_error = F.coalesce("error", F.lit(""))
    error = (
        F.when((audit_error != "") & (audit_error != C.NO_FEATURES), audit_error)
        .when(F.col("__path").isNull(), C.NO_FEATURES)
        .when(F.coalesce("__status", F.lit("")) != "ok", C.INDEX_NOT_OK)
        .when(F.coalesce("bundle_error", F.lit("missing")) != "", C.FILE_INVALID)
        .when(~F.coalesce(F.col("coverage") >= C.MIN_COVERAGE, F.lit(False)), C.COVERAGE_LOW)
        .otherwise("")
    )
    good = F.col("error") == ""
    shown = lambda value: F.when(good, value).otherwise("")
    return (
        joined.withColumn("error", error)
        .withColumn("valid", good)
        .withColumn("valid_ratio", F.when(good, F.col("coverage")).otherwise(0.0))
        .withColumn("mask", shown(F.concat("__path", F.lit("::valid_mask"))))
        .withColumn("feature_path", shown(F.col("__path")))
        .withColumn("feature_shape", shown(F.col("shape")))
        .withColumn("feature_dtype", shown(F.col("dtype")))
        .drop("__path", "__status", "bundle_error", "coverage", "shape", "dtype")
    )


def attach_features_lenient(clips: DataFrame, index: DataFrame | None, bundles: DataFrame | None,
                            layout: str = "video_features_v1") -> DataFrame:
    """Six-class state where a file under its usual name also counts.

    A row below the coverage limit keeps its descriptors. With ``bundles`` None
    no file can be looked at, so a listed one is only not verified.
    """
    usual = F.concat(F.lit(f"{layout}/"), "sample_id", F.lit(".npz"))
    rows = clips
    if index is not None:
        rows = rows.join(index.select("sample_id", F.col("path").alias("__listed")), "sample_id", "left")
    else:
        rows = rows.withColumn("__listed", F.lit(None).cast("string"))
    rows = rows.withColumn("__path", F.coalesce("__listed", usual))
    if bundles is not None:
        facts = bundles.select(F.col("path").alias("__path"), "coverage", "shape", "dtype")
        rows = rows.join(facts, "__path", "left")
    else:
        blank = F.lit(None).cast("string")
        rows = rows.withColumns({"coverage": F.lit(None).cast("double"), "shape": blank, "dtype": blank})
    found, listed = F.col("coverage").isNotNull(), F.col("__listed").isNotNull()
    ratio = F.least(F.lit(1.0), F.coalesce("coverage", F.lit(0.0)))
    absent = C.NOT_VERIFIED if bundles is None else C.FILE_MISSING
    return (
        rows
        .withColumn("valid_ratio", ratio)
        .withColumn("valid", found & (ratio >= C.MIN_COVERAGE))
        .withColumn("error", F.when(found, F.when(ratio >= C.MIN_COVERAGE, "").otherwise(C.COVERAGE_BELOW))
                    .when(listed, absent).otherwise(C.NO_FEATURES))
        .withColumn("mask", F.when(found, F.concat("__path", F.lit("::valid_mask"))).otherwise(""))
        .withColumn("feature_path", F.when(found | listed, F.col("__path")).otherwise(""))
        .withColumn("feature_shape", F.coalesce("shape", F.lit("")))
        .withColumn("feature_dtype", F.coalesce("dtype", F.lit("")))
        .drop("__path", "__listed", "coverage", "shape", "dtype")
    )
