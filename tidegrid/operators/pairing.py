"""Equi-joins of two modalities that explain every non-match.

No join carries a broadcast hint: sides are broadcast only where the optimizer
finds them small enough at run time, and a skewed side is split by the adaptive
skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids
from tidegrid.functions.numeric import codes_where, field_kind, near, same_value
from tidegrid.functions.parsing import source_stems
from tidegrid.plans.guards import require_none


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def mismatched_fields(left: dict[str, Column], right: dict[str, Column], prefix: str = "",
                      absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    """Names of the fields that disagree, in field order."""
    return codes_where(*[
        (f"{prefix}{name}", ~same_value(left[name], right[name], field_kind(name), absolute, relative))
        for name in left
    ])


def pair_modalities(video: DataFrame, telemetry: DataFrame, sync: DataFrame | None = None) -> DataFrame:
    """One row per video window with its telemetry partner or the reasons for none.

    Both sides hold the pair key, the label fields, sample_id and boolean
    ``valid``; the telemetry key must be unique. An optional ``feature_codes``
    array on the telemetry side carries earlier feature findings. ``sync`` gives
    a sync_status per subject and session.
    """
    key = list(C.PAIR_KEY)
    right = prefixed(telemetry, "t_", key)
    joined = video.join(right, key, "left")
    if sync is not None:
        status = sync.select("subject_id", "session_id", "sync_status")
        joined = joined.join(status, ["subject_id", "session_id"], "left")
    matched = F.col("t_sample_id").isNotNull()
    labels = mismatched_fields(
        {f: F.col(f) for f in C.PAIR_LABEL_FIELDS},
        {f: F.col(f"t_{f}") for f in C.PAIR_LABEL_FIELDS}, "label_mismatch_")
    none = F.array().cast("array<string>")
    parts = [
        F.when(F.coalesce("valid", F.lit(False)), none).otherwise(F.array(F.lit("video_invalid"))),
        F.when(matched, none).otherwise(F.array(F.lit("can_missing_or_invalid"))),
        F.when(matched & ~F.coalesce("t_valid", F.lit(False)), F.array(F.lit("can_invalid"))).otherwise(none),
        F.when(matched, labels).otherwise(none),
    ]
    if sync is not None:
        unsure = matched & (F.coalesce("sync_status", F.lit("")) != C.SYNC_ALIGNED)
        parts.append(F.when(unsure, F.array(F.lit("sync_unverified"))).otherwise(none))
        joined = joined.withColumn("sync_status", F.when(
            matched, F.coalesce("sync_status", F.lit("not_applicable_missing_can"))
        ).otherwise("not_applicable_missing_can"))
    if "feature_codes" in telemetry.columns:
        parts.append(F.when(matched, F.coalesce("t_feature_codes", none)).otherwise(none))
    codes = F.array_sort(F.array_distinct(F.concat(*parts)))
    start = F.col("window_start_ms")
    return (
        joined
        .withColumn("paired_sample_id", ids.pair_id(
            F.col("subject_id"), F.col("session_id"), start, F.col("window_end_ms")))
        .withColumn("window_index", F.call_function("div", start - F.col("label_start_ms"), F.lit(C.WINDOW_MS)))
        .withColumn("exclude_codes", codes)
        .withColumn("exclude_reason", F.array_join("exclude_codes", ";"))
        .withColumn("paired_valid", F.size("exclude_codes") == 0)
    )


def attach_sync_status(pairs: DataFrame, sync: DataFrame) -> DataFrame:
    """Adds each session's sync status; one that is absent counts as unverified."""
    status = sync.select("subject_id", "session_id", "sync_status")
    return pairs.join(status, ["subject_id", "session_id"], "left").withColumn(
        "sync_ok", F.coalesce(F.col("sync_status") == C.SYNC_ALIGNED, F.lit(False)))


def unmatched_right(right: DataFrame, left: DataFrame, keys: Sequence[str]) -> DataFrame:
    return right.join(left.select(*keys), list(keys), "left_anti")


# -- two metadata tables against each other -----------------------------------

_CHECKED = ("label_id", "label_class", "label_scheme", "split", "subject_id", "session_id", "source_file")


def _indexed(rows: DataFrame, side: str, order: str, last: bool) -> DataFrame:
    """One row per non-empty sample_id: the first (or last) copy and the count."""
    sample = F.trim("sample_id") if not last else F.col("sample_id")
    cols = [F.col(c) for c in _CHECKED if c in rows.columns]
    pick = F.max_by if last else F.min_by
    return (
        rows.withColumn("sample_id", sample).where("sample_id <> ''")
        .groupBy("sample_id")
        .agg(pick(F.struct(*cols), F.col(order)).alias(side), F.count(F.lit(1)).alias(f"{side}_copies"))
    )


def pair_check_rows(left: DataFrame, right: DataFrame, order: str = "row_no", strict: bool = True) -> DataFrame:
    """Full outer comparison by sample_id: one row per id with its codes.

    Strict: the first copy of an id counts, empty values are mismatches and the
    label scheme is compared. Lenient: the last copy counts, empty session or
    source values are passed over, no scheme.
    """
    a = _indexed(left, "a", order, not strict)
    b = _indexed(right, "b", order, not strict)
    text = lambda side, name: F.coalesce(F.col(f"{side}.{name}"), F.lit(""))
    both = F.col("a_copies").isNotNull() & F.col("b_copies").isNotNull()

    def differ(name: str, trim: bool = False) -> Column:
        x, y = text("a", name), text("b", name)
        x, y = (F.trim(x), F.trim(y)) if trim else (x, y)
        return x != y

    def unequal_or_empty(name: str, trim: bool) -> Column:
        x = F.trim(text("a", name)) if trim else text("a", name)
        return (x == "") | differ(name, trim)

    stems_a = F.coalesce(source_stems(text("a", "source_file")), F.array().cast("array<string>"))
    stems_b = F.coalesce(source_stems(text("b", "source_file")), F.array().cast("array<string>"))
    other_set = (F.size(F.array_except(stems_a, stems_b)) > 0) | (F.size(F.array_except(stems_b, stems_a)) > 0)
    empty_a, empty_b = F.size(stems_a) == 0, F.size(stems_b) == 0
    sample = F.col("sample_id")
    in_a, in_b = F.array_contains(stems_a, sample), F.array_contains(stems_b, sample)
    label = differ("label_id") | differ("label_class")
    if strict:
        checks = [
            ("label_mismatch", label),
            ("label_scheme_mismatch", unequal_or_empty("label_scheme", True)),
            ("split_mismatch", unequal_or_empty("subject_id", False) | differ("split")),
            ("session_mismatch", unequal_or_empty("session_id", True)),
            ("source_mismatch", empty_a | empty_b | other_set | ~in_a | ~in_b),
        ]
    else:
        given = (text("a", "session_id") != "") & (text("b", "session_id") != "")
        checks = [
            ("label_mismatch", label),
            ("split_mismatch", differ("subject_id") | differ("split")),
            ("session_mismatch", given & differ("session_id")),
            ("source_mismatch", ~empty_a & ~empty_b & (other_set | ~in_a)),
        ]
    codes = codes_where(
        ("only_left", F.col("b_copies").isNull()),
        ("only_right", F.col("a_copies").isNull()),
        ("duplicate_left", F.coalesce("a_copies", F.lit(0)) > 1),
        ("duplicate_right", F.coalesce("b_copies", F.lit(0)) > 1),
        *[(name, both & cond) for name, cond in checks],
    )
    return a.join(b, "sample_id", "full").select("sample_id", both.alias("common"), codes.alias("codes"))


_CHECK_CODES = (
    "only_left", "only_right", "duplicate_left", "duplicate_right", "label_mismatch",
    "label_scheme_mismatch", "split_mismatch", "session_mismatch", "source_mismatch",
)


def pair_check_report(left: DataFrame, right: DataFrame, order: str = "row_no", strict: bool = True) -> DataFrame:
    """One row of counts and PASS or FAIL for the comparison."""
    rows = pair_check_rows(left, right, order, strict)
    sizes = left.agg(F.count(F.lit(1)).alias("left_rows"), F.count_if(
        F.trim("sample_id") == "" if strict else F.col("sample_id") == "").alias("left_empty_ids"))
    sizes_right = right.agg(F.count(F.lit(1)).alias("right_rows"), F.count_if(
        F.trim("sample_id") == "" if strict else F.col("sample_id") == "").alias("right_empty_ids"))
    names = [c for c in _CHECK_CODES if strict or c != "label_scheme_mismatch"]
    counts = rows.agg(
        F.count_if("common").alias("common_samples"),
        *[F.count_if(F.array_contains("codes", c)).alias(f"{c}_count") for c in names],
    )
    extra = {c: sizes.select(c).scalar() for c in sizes.columns}
    extra |= {c: sizes_right.select(c).scalar() for c in sizes_right.columns}
    out = counts.withColumns(extra)
    trouble = F.col("left_empty_ids") + F.col("right_empty_ids")
    for c in names:
        trouble = trouble + F.col(f"{c}_count")
    return out.withColumn("status", F.when(trouble == 0, "PASS").otherwise("FAIL"))


# -- cohorts, inventories, id sets --------------------------------------------

def cohort_rows(windows: DataFrame, parents: DataFrame, pairs: DataFrame,
                fields: Sequence[str], feature_fields: Sequence[str]) -> DataFrame:
    """Windows of complete parents against pairs, by split and sample id."""
    complete = parents.where("complete_for_240s").select("parent_id").distinct()
    effective = windows.join(complete, "parent_id", "left_semi")
    a = effective.select("split", "sample_id", F.struct(*fields, *feature_fields).alias("a"))
    b = pairs.select("split", "sample_id", F.struct(*fields, *feature_fields).alias("b"))
    joined = a.join(b, ["split", "sample_id"], "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    identity = mismatched_fields(
        {f: F.col(f"a.{f}") for f in fields}, {f: F.col(f"b.{f}") for f in fields}, "", 1e-9, 0.0)
    feature = F.lit(True)
    for f in feature_fields:
        x, y = F.col(f"a.{f}"), F.col(f"b.{f}")
        feature = feature & (near(x.cast("double"), y.cast("double"), 1e-6) if f.endswith("ratio") else F.coalesce(x == y, F.lit(False)))
    return joined.select(
        "split", "sample_id", F.col("b").isNull().alias("only_window"), F.col("a").isNull().alias("only_pair"),
        F.when(both, identity).otherwise(F.array().cast("array<string>")).alias("identity_mismatches"),
        (both & ~feature).alias("feature_mismatch"),
    )


def cohort_equivalence(windows: DataFrame, parents: DataFrame, pairs: DataFrame,
                       fields: Sequence[str], feature_fields: Sequence[str]) -> DataFrame:
    """Counts of the differences per split, parent sets included."""
    rows = cohort_rows(windows, parents, pairs, fields, feature_fields)
    counts = rows.groupBy("split").agg(
        F.count_if(~F.col("only_pair")).alias("effective_windows"),
        F.count_if(~F.col("only_window")).alias("paired_windows"),
        F.count_if(F.col("only_window") | F.col("only_pair")).alias("sample_id_difference_count"),
        F.count_if(F.size("identity_mismatches") > 0).alias("identity_mismatch_count"),
        F.count_if("feature_mismatch").alias("feature_mismatch_count"),
    )
    a = parents.where("complete_for_240s").groupBy("split", "parent_id").agg(F.lit(True).alias("a"))
    b = pairs.groupBy("split", "parent_id").agg(F.lit(True).alias("b"))
    parent_diff = a.join(b, ["split", "parent_id"], "full").groupBy("split").agg(
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("parent_id_difference_count"))
    return counts.join(parent_diff, "split", "full").na.fill(0)


def inventory_diff(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded against actual files by path: the codes of every difference."""
    r = recorded.groupBy("path").agg(
        F.count(F.lit(1)).alias("copies"), F.min("size_bytes").alias("rs"), F.min("sha256").alias("rh"),
        F.max("size_bytes").alias("rs2"), F.max("sha256").alias("rh2"))
    a = actual.select("path", F.col("size_bytes").alias("s"), F.col("sha256").alias("h"))
    joined = r.join(a, "path", "full")
    both = F.col("copies").isNotNull() & F.col("s").isNotNull()
    codes = codes_where(
        ("duplicate_record", F.coalesce("copies", F.lit(0)) > 1),
        ("missing_file", F.col("s").isNull()),
        ("unrecorded_file", F.col("copies").isNull()),
        ("size_mismatch", both & ((F.col("rs") != F.col("s")) | (F.col("rs2") != F.col("s")))),
        ("hash_mismatch", both & ((F.col("rh") != F.col("h")) | (F.col("rh2") != F.col("h")))),
    )
    return joined.select("path", codes.alias("codes")).where(F.size("codes") > 0)


def id_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids on one side only, copies on either side, equality."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("b").isNull()).alias("only_left"),
        F.count_if(F.col("a").isNull()).alias("only_right"),
        F.count_if(F.col("a") > 1).alias("duplicate_left"),
        F.count_if(F.col("b") > 1).alias("duplicate_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def label_source_agreement(sheet: DataFrame, files: DataFrame) -> DataFrame:
    """Per session of the sheet: does its own label file hold the same scores?

    Both sides are long (session_id, label_index, kss_score).
    """
    a = sheet.select("session_id", "label_index", F.col("kss_score").alias("a"))
    b = files.select("session_id", "label_index", F.col("kss_score").alias("b"))
    rows = a.join(b, ["session_id", "label_index"], "full")
    state = rows.groupBy("session_id").agg(
        F.count("a").alias("sheet_scores"), F.count("b").alias("file_scores"),
        F.count_if(~F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("differing"))
    return state.where("sheet_scores > 0").withColumn(
        "code", F.when(F.col("file_scores") == 0, "missing").when(F.col("differing") > 0, "differs").otherwise(""))


def assign_split(rows: DataFrame, splits: DataFrame, strict: bool = False) -> DataFrame:
    """Split of each row's subject; unknown gives '' or, when strict, stops the job."""
    joined = rows.join(splits.select("subject_id", "split"), "subject_id", "left")
    if strict:
        text = F.concat(F.lit("no split for subject "), F.col("subject_id"))
        return joined.withColumn("split", F.coalesce("split", F.raise_error(text).cast("string")))
    return joined.withColumn("split", F.coalesce("split", F.lit("")))


# -- video windows and their children -----------------------------------------

def _near(id: Column, stretch: int) -> Column:
    """A number that ids share if they have one stem and start in one stretch of time. Equal ids have equal numbers, whatever they look like."""
    tail = F.substring_index(id, "_", -2)
    cut = F.call_function("div", F.substring_index(tail, "_", 1).try_cast("bigint"), F.lit(stretch))
    stem = F.substring(id, F.lit(1), F.length(id) - F.length(tail))
    return F.when(cut.isNotNull(), F.xxhash64(stem, cut)).when(id.isNotNull(), F.xxhash64(id))


def _by_id(left: DataFrame, right: DataFrame, id: str, right_id: str, stretch: int) -> DataFrame:
    """Left join on equal ids, dealt by ``_near``.

    What neighbours in time have in common lies together in the shuffle and is packed away there: rows take a
    fraction of the bytes. A stretch holds eight ids or so of a session, each of which meets the others. The
    ids are compared as a range, since Spark would deal rows by ids that it knows to be equal.
    """
    mine, theirs = f"__near_{id}", f"__near_{right_id}"
    left = left if mine in left.columns else left.withColumn(mine, _near(F.col(id), stretch))
    right = right if theirs in right.columns else right.withColumn(theirs, _near(F.col(right_id), stretch))
    return left.join(right, (F.col(mine) == F.col(theirs)) & F.col(id).between(F.col(right_id), F.col(right_id)), "left")


#: Stretches of the ids of windows (in ms) and of their children (in us): a parent, a window.
_PARENT, _WINDOW = C.PARENT_MS, C.WINDOW_MS * 1000


def _short(kids: Column, window_id: Column) -> Column:
    """The listed children of a window as a text that is equal for equal lists of one window: the list, or a sign where it is the one that follows from the id."""
    start = F.substring_index(F.substring_index(window_id, "_", -2), "_", 1).try_cast("bigint")
    session = F.regexp_extract(window_id, r"\Avideo30__(.*)__\d+_\d+\z", 1)
    return F.when(kids == F.array_join(ids.video_child_ids(session, start), "|"), "=").otherwise(F.concat(F.lit("!"), kids))


def _listed(rows: DataFrame, id: str) -> DataFrame:
    """Adds ``kids``, the listed children in short: long texts stay out of the shuffle."""
    return rows.withColumn("kids", _short(F.col("video_subwindow_ids"), F.col(id)))


def _out_of_order() -> Column:
    return F.split("video_subwindow_ids", r"\|") != ids.video_child_ids(F.col("session_id"), F.col("window_start_ms"))


def child_binding(windows: DataFrame, features: DataFrame, children: DataFrame) -> DataFrame:
    """Codes of each 30 s row against its feature row and six ordered children.

    All findings are reported, first those of the row, then per position. A
    window has exactly six expected children, so gathering them is bounded.
    """
    listed = _listed(windows, "sample_id").withColumn("out_of_order", _out_of_order())
    w = _by_id(listed, prefixed(_listed(features, "sample_id"), "f_"), "sample_id", "f_sample_id", _PARENT)
    start, end = F.col("window_start_ms"), F.col("window_end_ms")
    expected = ids.video_child_ids(F.col("session_id"), start)
    own = codes_where(
        ("source_30s_duration", end - start != C.WINDOW_MS),
        ("source_30s_id", F.col("sample_id") != ids.video_window_id(F.col("session_id"), start, end)),
        ("source_subject_session", ~F.startswith("session_id", F.concat("subject_id", F.lit("_")))),
        ("source_5s_order_or_identity", F.col("out_of_order")),
        ("source_feature_sample_id", F.col("f_sample_id").isNull()),
        ("source_feature_subwindow_ids", F.col("f_kids") != F.col("kids")),
        ("source_feature_member", F.col("f_relative_path") != F.concat(F.lit("features_30s/"), "sample_id", F.lit(".npz"))),
        ("source_feature_shape_or_dtype", (F.col("f_feature_shape") != "[6,96]") | (F.col("f_feature_dtype") != "float32")),
    )
    wide = w.select("*", F.posexplode(expected).alias("position", "child_id"))
    # Both sides are large, and an exploded side looks smaller to the optimizer
    # than it is, so it must not be taken for a broadcast.
    right = prefixed(children, "c_").hint("merge")
    joined = _by_id(wide, right, "child_id", "c_sample_id", _WINDOW)
    pos = F.col("position").cast("string")
    found = F.col("c_sample_id").isNotNull()

    def code(stem: str) -> Column:
        return F.concat(F.lit(f"source_5s_{stem}_"), pos)

    want = start + F.col("position") * C.SUBWINDOW_MS
    per_child = codes_where(
        (code("missing"), ~found),
        *[(code(f), found & ~same_value(F.col(f"c_{f}"), F.col(f), field_kind(f), 1e-6, 0.0)) for f in C.CHILD_FIELDS],
        (code("time"), found & ((F.col("c_window_start_ms") != want) | (F.col("c_window_end_ms") != want + C.SUBWINDOW_MS))),
        (code("invalid"), found & ~F.col("c_valid")),
        (code("feature_member"), found & (F.col("c_feature_path") != F.col("f_relative_path"))),
        (code("feature_hash"), found & (F.col("c_feature_sha256") != F.col("f_feature_sha256"))),
    )
    # Sound children end here; only findings are gathered, at most six per window.
    findings = (
        joined.select("sample_id", "position", per_child.alias("codes")).where(F.size("codes") > 0)
        .groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("position", "codes"))).alias("__c"))
    )
    none = F.array().cast("array<string>")
    later = F.coalesce(F.flatten(F.transform("__c", lambda c: c["codes"])), none)
    return w.select("sample_id", own.alias("__own")).join(findings, "sample_id", "left").select(
        "sample_id", F.concat("__own", later).alias("codes"))


def pair_binding(pairs: DataFrame, windows: DataFrame, features: DataFrame, children: DataFrame) -> DataFrame:
    """Codes of each pair row against the source window and feature it names."""
    bound = child_binding(windows, features, children).withColumnsRenamed({"sample_id": "__wid", "codes": "__child"})
    joined = _listed(pairs, "video_sample_id").withColumn("out_of_order", _out_of_order())
    for table, id in ((prefixed(_listed(windows, "sample_id"), "w_"), "w_sample_id"), (prefixed(features, "f_"), "f_sample_id"), (bound, "__wid")):
        joined = _by_id(joined, table, "video_sample_id", id, _PARENT)
    start, end = F.col("window_start_ms"), F.col("window_end_ms")
    head = codes_where(
        ("pair_video_sample_id", F.col("video_sample_id") != ids.video_window_id(F.col("session_id"), start, end)),
        ("pair_video_5s_order_or_identity", F.col("out_of_order")),
    )
    missing = F.col("w_sample_id").isNull() | F.col("f_sample_id").isNull()
    body = codes_where(
        *[(f"pair_video_{f}", ~same_value(F.col(f), F.col(f"w_{f}"), field_kind(f), 1e-6, 0.0))
          for f in C.PAIR_WINDOW_FIELDS],
        ("pair_video_subwindow_ids", F.col("kids") != F.col("w_kids")),
        ("pair_video_source_invalid", ~F.col("w_valid")),
        ("pair_video_feature_member", F.col("video_feature_member") != F.col("f_relative_path")),
        ("pair_video_feature_shape", F.col("video_feature_shape") != F.col("f_feature_shape")),
        ("pair_video_feature_dtype", F.col("video_feature_dtype") != F.col("f_feature_dtype")),
        ("pair_video_feature_sha256", F.col("video_feature_sha256") != F.col("f_feature_sha256")),
    )
    none = F.array().cast("array<string>")
    codes = F.when(missing, F.concat(head, F.array(F.lit("pair_video_source_missing")))).otherwise(
        F.concat(head, body, F.coalesce("__child", none)))
    return joined.select("paired_sample_id", codes.alias("codes"))


def union_splits(*tables: DataFrame, allow_test: bool = False) -> DataFrame:
    """Train and val manifests in one table; a test row stops the job."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out if allow_test else require_none(out, F.col("split") == "test", "test row in a development manifest")
