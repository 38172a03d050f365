"""The jobs: readers, operators and writers put together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids
from tidegrid.operators import clips, coverage, grid, intervals, pairing, telemetry, validators
from tidegrid.operators.ordering import partition_valid
from tidegrid.plans.guards import require_none, require_unique
from tidegrid.session import stage


@dataclass(frozen=True)
class TelemetryDataset:
    windows: DataFrame
    parents: DataFrame
    subjects: DataFrame
    anomalies: DataFrame
    excluded_sessions: DataFrame
    unjudged_sessions: DataFrame


def build_telemetry_dataset(labels: DataFrame, rows: DataFrame,
                            settings: telemetry.TokenSettings = telemetry.TokenSettings()) -> TelemetryDataset:
    """Labels and telemetry to judged windows, parents, subjects and anomalies.

    Steps, audit and windows each feed several branches, so each is written once
    to the shared folder and read back with only the columns a branch needs.

    A session whose clock cannot be audited keeps all its windows, judged as without
    telemetry, and is named with its error in ``unjudged_sessions``.
    """
    rows = stage(telemetry.clock_steps(rows), "steps")
    audit = stage(telemetry.clock_audit(rows, settings.clock_jump_s), "audit")
    unjudged = audit.where("clock_error <> ''").select("session_id", "clock_error")
    audit = audit.where("clock_error = ''")
    rows = rows.join(unjudged, "session_id", "left_anti")
    lattice = grid.candidate_grid(labels, settings.window_us // 1000)
    judged = stage(telemetry.telemetry_windows(lattice, rows, settings, audit), "windows")
    outside = labels.where(ids.fatigue_split(F.col("subject_id")).isNull()).select("session_id").distinct()
    return TelemetryDataset(
        judged,
        grid.parent_manifest(judged, order="window_start_ms", known=C.WINDOW_REASONS),
        coverage.subject_table(judged),
        telemetry.clock_anomalies(rows, settings.clock_jump_s),
        outside,
        unjudged,
    )


def freeze_splits(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Valid windows, excluded windows, complete parents and the split summary.

    Any row rule broken stops the job before anything is split.
    """
    require_none(validators.validate_split_rows(rows), F.lit(True), "metadata row")
    valid, excluded = partition_valid(rows)
    typed = rows.withColumns({
        "valid": F.lower(F.trim("valid")) == "true",
        "window_index": F.col("window_index").cast("int"),
        "qc_reason_codes": coverage.split_codes(F.col("qc_reason_codes")),
    })
    parents = grid.parent_manifest(typed)
    return valid, excluded, parents.where("complete_for_240s"), coverage.split_summary(typed, parents)


def build_clip_metadata(facts: DataFrame, splits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clip rows and their audit totals."""
    rows = clips.clip_metadata(clips.clip_qc(facts), splits)
    return rows, coverage.clip_audit_totals(rows)


def _six_class(rows: DataFrame) -> DataFrame:
    task = F.substring("sample_id", 1, 2)
    kept = rows.where(task.isin(*C.CLIP_TASKS_6)).withColumn("__task", task.cast("int"))
    return kept.withColumns({
        "label_id": ids.six_class_id(F.col("__task")),
        "label_class": ids.six_class_name(F.col("__task")),
        "label_scheme": F.lit(C.CLIP_SCHEME),
    }).drop("__task")


def build_audio_6c(audit: DataFrame, splits: DataFrame, index: DataFrame, bundles: DataFrame) -> DataFrame:
    """Six-class audio metadata: task filter, strict feature state, split."""
    rows = clips.attach_features_strict(_six_class(audit.drop("split")), index, bundles)
    source = F.col("source_file")
    session = F.coalesce(
        ids.session_of_clip_name(source), ids.session_of_clip_name(F.concat("sample_id", F.lit(".wav"))), "session_id")
    out = pairing.assign_split(rows.withColumn("session_id", session), splits)
    return out.withColumn("source_file", F.to_json(F.array(source)))


def build_video_6c(clips_table: DataFrame, splits: DataFrame, index: DataFrame | None,
                   bundles: DataFrame | None) -> DataFrame:
    """Six-class video metadata: lenient feature state; an unknown subject stops."""
    rows = clips.attach_features_lenient(_six_class(clips_table.drop("split")), index, bundles)
    return pairing.assign_split(rows, splits, strict=True).withColumn(
        "source_file", F.to_json(F.array(F.translate("source_file", "\\", "/"))))


@dataclass(frozen=True)
class PairCohort:
    pairs: DataFrame
    parents: DataFrame
    sync: DataFrame
    unmatched: DataFrame
    reasons: DataFrame


def build_pairs(video: DataFrame, rows: DataFrame, sessions: DataFrame, videos: DataFrame,
                tolerance_ms: float = 100.0, settings_ms: int = C.WINDOW_MS, check: bool = True) -> PairCohort:
    """Both modalities to pairs, complete parents, sync audit and leftovers."""
    if check:
        require_unique(rows, list(C.PAIR_KEY), "telemetry pair key")
        require_none(video, F.col("split") == "test", "test row in the video hand-off")
        require_none(rows, F.col("split") == "test", "test row in the telemetry manifest")
    sync = intervals.sync_audit(sessions, videos, ["subject_id", "session_id"], tolerance_ms)
    pairs = stage(pairing.pair_modalities(video, rows, sync), "pairs")
    parents = grid.complete_parents(pairs, settings_ms)
    return PairCohort(
        grid.mark_eligible(pairs, parents), parents, sync,
        pairing.unmatched_right(rows, video, list(C.PAIR_KEY)),
        coverage.reason_counts(pairs, "exclude_codes"),
    )
