"""Names, labels and canonical identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid import constants as C

# -- name patterns of the contract (fixed values) ----------------------------
_CLIP_STEM = r"[0-9]{2}_P[0-9]{2}_[0-9]{8}_[0-9]{2}_[0-9]{2}_[0-9]{2}_[0-9]+"
SUBJECT = r"P(?:0[1-9]|[1-3][0-9]|40)"
CLIP_SESSION = r"P[0-9]{2}_[0-9]{8}_[0-9]{4}_[0-9]{2}"
REQUEST_ID = r"[A-Za-z0-9_.-]+"


def full_match(col: Column, pattern: str) -> Column:
    """Whole-string match; ``\\z`` because ``$`` lets a last newline through."""
    return col.rlike(rf"\A(?:{pattern})\z")


def base_name(col: Column) -> Column:
    """Last path part, with backslashes taken as separators."""
    return F.substring_index(F.translate(col, "\\", "/"), "/", -1)


def drop_extension(col: Column) -> Column:
    return F.regexp_replace(col, r"\.[^.]*\z", "")


def _clip_parts(base: Column, accepted: Column) -> Column:
    """Fields of a matched name; every field but the last has a fixed width."""
    tail = F.substring(base, 26, 1 << 20)
    clock = F.concat(F.substring(base, 17, 2), F.substring(base, 20, 2), F.substring(base, 23, 2))
    return F.when(accepted, F.struct(
        F.substring(base, 1, 2).cast("int").alias("task_code"),
        F.substring(base, 4, 3).alias("subject_id"),
        F.substring(base, 8, 8).alias("date"),
        clock.alias("start_hhmmss"),
        F.substring_index(tail, ".", 1).try_cast("bigint").alias("takeover_decisec"),
        drop_extension(base).alias("stem"),
        F.lower(F.regexp_replace(F.substring_index(base, ".", -1), r"\n\z", "")).alias("extension"),
    ))


def _is_clip_name(base: Column) -> Column:
    return (
        base.rlike(rf"\A{_CLIP_STEM}\.[A-Za-z0-9]+\n?\z")
        & F.substring(base, 1, 2).between("01", "09")
        & full_match(F.substring(base, 4, 3), SUBJECT)
    )


def parse_clip_name(col: Column) -> Column:
    """Struct of a nine-class clip name, null when the name is not one."""
    base = base_name(col)
    return _clip_parts(base, _is_clip_name(base))


def session_of_clip_name(col: Column) -> Column:
    """Session id straight from a nine-class clip name, null when it is not one."""
    base = base_name(col)
    clock = F.concat(F.substring(base, 17, 2), F.substring(base, 20, 2))
    parts = F.concat_ws("_", F.substring(base, 4, 3), F.substring(base, 8, 8), clock, F.substring(base, 23, 2))
    return F.when(_is_clip_name(base), parts)


def parse_video_clip_name(col: Column) -> Column:
    """Struct of a six-class video clip name; the pattern ignores case."""
    base = base_name(col)
    accepted = (
        base.rlike(rf"(?i)\A{_CLIP_STEM}\.(?:mp4|avi|mov)\z")
        & F.substring(base, 1, 2).isin(*C.CLIP_TASKS_6)
        & full_match(F.substring(base, 4, 3), SUBJECT)
    )
    return _clip_parts(base, accepted)


def clip_session_id(subject: Column, date: Column, hhmmss: Column) -> Column:
    return F.concat_ws("_", subject, date, F.substring(hhmmss, 1, 4), F.substring(hhmmss, 5, 2))


def in_kss_range(score: Column) -> Column:
    """True for a finite score in [1, 9]; null counts as out of range."""
    return F.coalesce(~F.isnan(score) & score.between(1.0, 9.0), F.lit(False))


def kss_label_id(score: Column) -> Column:
    return F.when(in_kss_range(score), F.when(score < 4, 0).when(score < 7, 1).otherwise(2))


def class_name(label_id: Column, names: tuple[str, ...]) -> Column:
    """Name at ``label_id``; null outside the range."""
    return F.get(F.array(*[F.lit(n) for n in names]), label_id)


def kss_label_class(score: Column) -> Column:
    return class_name(kss_label_id(score), C.FATIGUE_CLASSES)


def nine_class_id(task: Column) -> Column:
    return F.when(task.between(1, len(C.CLIP_CLASSES_9)), task - 1)


def nine_class_name(task: Column) -> Column:
    return class_name(nine_class_id(task), C.CLIP_CLASSES_9)


def six_class_id(task: Column) -> Column:
    """Class of a task code given as an integer; null outside the six tasks."""
    chain = F.lit(None).cast("int")
    for index, code in reversed(list(enumerate(C.CLIP_TASKS_6))):
        chain = F.when(task == int(code), index).otherwise(chain)
    return chain


def six_class_name(task: Column) -> Column:
    return class_name(six_class_id(task), C.CLIP_CLASSES_6)


def fatigue_split(subject: Column) -> Column:
    """Fixed split of a subject letter; null for an unassigned subject."""
    chain = F.lit(None).cast("string")
    for split in reversed(C.SPLITS):
        chain = F.when(subject.isin(*C.FATIGUE_SUBJECTS[split]), split).otherwise(chain)
    return chain


def session_from_file(col: Column, kind: str = "Telemetry") -> Column:
    """``X_A`` / ``X_D`` out of ``X_<kind>_A.csv``; null when it is no such file."""
    base = base_name(col)
    hit = base.rlike(rf"\A[A-Z]_{kind}_[AD]\.csv\n?\z")
    return F.when(hit, F.concat_ws("_", F.substring(base, 1, 1), F.substring(base, len(kind) + 4, 1)))


def session_from_label(col: Column) -> Column:
    """``X_A`` out of ``X_Alert``, ``X_D`` out of ``X_Drowsy``."""
    name = F.trim(col)
    return (
        F.when(full_match(name, "[A-Z]_Alert"), F.concat(F.substring(name, 1, 1), F.lit("_A")))
        .when(full_match(name, "[A-Z]_Drowsy"), F.concat(F.substring(name, 1, 1), F.lit("_D")))
    )


def condition_name(session: Column) -> Column:
    code = F.substring_index(session, "_", -1)
    return F.when(code == "A", "Alert").when(code == "D", "Drowsy")


def window_id(session: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.format_string("ULDD_%s_%09d_%09d", session, start_ms, end_ms)


def pair_id(subject: Column, session: Column, start_ms: Column, end_ms: Column) -> Column:
    """Identifier of a pair; the condition is the last part of the session."""
    return F.format_string(
        "ULDD_%s_%s_%09d_%09d", subject, F.substring_index(session, "_", -1), start_ms, end_ms
    )


def video_window_id(session: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.format_string("video30__%s__%010d_%010d", session, start_ms, end_ms)


def video_child_id(session: Column, start_ms: Column, position: Column | int) -> Column:
    position = F.lit(position) if isinstance(position, int) else position
    first = (start_ms + position * C.SUBWINDOW_MS) * 1000
    last = (start_ms + (position + 1) * C.SUBWINDOW_MS) * 1000
    return F.format_string("video5__%s_IR_%013d_%013d", session, first, last)


def video_child_ids(session: Column, start_ms: Column) -> Column:
    return F.array(*[
        video_child_id(session, start_ms, p) for p in range(C.SUBWINDOWS_PER_WINDOW)
    ])


def feature_names(width: Column) -> Column:
    """``video_feature_000`` … for a feature width given as a column."""
    return F.transform(
        F.sequence(F.lit(0), width - 1), lambda i: F.format_string("video_feature_%03d", i)
    )
