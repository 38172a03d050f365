"""Ordered rule lists over metadata tables, each giving error rows.

Metadata columns are text, as exported; empty text is a value. ``row_no`` is the
file line (the header is line 1). Rules that only add a code look at the rows
that got past every rule before them, in line order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids
from tidegrid.functions.numeric import array_mean, codes_where, is_finite, near
from tidegrid.functions.parsing import (
    int_list, is_safe_relative_path, is_sha256, is_versioned, mask_path, positive_shape, source_list,
    source_stems, strict_bool, strict_double, strict_int,
)
from tidegrid.operators.features import (
    bundle_rules, descriptor_rules, fixed_grid_codes, telemetry_value_codes, time_support_codes, union_ratio,
)
from tidegrid.operators.grid import full_grid_check, index_set_is_full, stride_check
from tidegrid.operators.ordering import flag_repeats
from tidegrid.operators.pairing import child_binding, id_set_difference
from tidegrid.plans.chunked import CHUNK_ROWS, cut, with_history
from tidegrid.plans.guards import ContractError, LockedSplitError
from tidegrid.plans.rules import Rule, broken_rows, first_broken, passed, rule_name
from tidegrid.session import stage

NAMED_FIELDS = ("sample_id", "subject_id", "session_id", "source_file", "extractor_name", "extractor_version")
_INTS = ("window_start_ms", "window_end_ms", "duration_ms", "window_index", "label_id")


def _typed(rows: DataFrame) -> DataFrame:
    """Trims every text column and adds the parsed values as ``p_*``."""
    text = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    out = rows.withColumns({c: F.trim(c) for c in text})
    ints = [c for c in (*_INTS, "label_start_ms", "label_end_ms") if c in rows.columns]
    parsed = {f"p_{c}": strict_int(F.col(c)) for c in ints}
    for name in ("kss_score", "valid_ratio"):
        if name in rows.columns:
            parsed[f"p_{name}"] = strict_double(F.col(name))
    parsed["p_valid"] = strict_bool(F.col("valid"))
    # Several rules look at each of these, so the text is parsed once here.
    parsed["p_sources"] = source_list(F.col("source_file"))
    parsed["p_shape"] = int_list(F.col("feature_shape"))
    parsed["p_mask"] = mask_path(F.col("mask"))
    return out.withColumns(parsed)


def _named() -> Column:
    good = F.lit(True)
    for name in NAMED_FIELDS:
        good = good & is_versioned(F.col(name))
    return good


def _quality_rules(min_ratio: float) -> list[Rule]:
    valid, ratio = F.col("p_valid"), F.col("p_valid_ratio")
    return [
        Rule("valid_text", valid.isNotNull()),
        Rule("ratio_range", is_finite(ratio) & ratio.between(0, 1)),
        Rule("valid_with_error", ~valid | (F.col("error") == "")),
        Rule("invalid_without_error", valid | (F.col("error") != "")),
        Rule("ratio_below_threshold", ~valid | (ratio >= min_ratio)),
    ]


def _no_feature() -> Column:
    blank = (F.col("mask") == "") & (F.col("feature_shape") == "") & (F.col("feature_dtype") == "")
    return ~F.col("p_valid") & (F.col("p_valid_ratio") == 0) & blank


def bundle_facts(bundles: DataFrame, duration_s: float, shape: tuple[int, int] | None = None) -> DataFrame:
    """What the row rules need to know of each feature, without its arrays.

    The arrays are judged where they are read; only the place of the first
    broken array rule, the shape and the union coverage travel to the rows.
    """
    judged = bundles.withColumn("array_at", first_broken(bundle_rules(duration_s, shape)))
    return judged.select(
        "feature_path", "array_at", F.size("x").alias("array_rows"), F.size(F.get("x", F.lit(0))).alias("array_columns"),
        F.when(F.col("array_at").isNull(), union_ratio(duration_s)).alias("array_ratio"))


def _feature_rules(duration_s: float, shape: tuple[int, int] | None = None) -> list[Rule]:
    """Descriptor and array rules, which only bind rows with a feature path."""
    bound = F.col("feature_path") != ""
    descriptors = {r.name: r for r in descriptor_rules()}
    arrays = [
        Rule(r.name, ~F.col("array_at").eqNullSafe(F.lit(i)))
        for i, r in enumerate(bundle_rules(duration_s, shape), start=1)
    ]
    ordered = [
        *[descriptors[n] for n in ("path", "npz_suffix", "mask_reference", "bundle_missing")], *arrays[:4],
        *[descriptors[n] for n in ("shape_json", "declared_shape", "declared_dtype")], *arrays[4:],
        Rule("ratio_union", near(F.col("p_valid_ratio"), F.col("array_ratio"), 1e-6)),
    ]
    return [Rule("absent_feature", bound | _no_feature()), *[Rule(r.name, ~bound | r.ok) for r in ordered]]


def metadata_rules(task: str, min_ratio: float = C.MIN_COVERAGE) -> list[Rule]:
    """The row rules of shared metadata in reporting order."""
    start, end, duration = (F.col(f"p_{n}") for n in ("window_start_ms", "window_end_ms", "duration_ms"))
    index, label = F.col("p_window_index"), F.col("p_label_id")
    sources = F.col("p_sources")
    ints = F.lit(True)
    for name in _INTS:
        ints = ints & F.col(f"p_{name}").isNotNull()
    rules = [
        Rule("identity_fields", _named()),
        Rule("modality", F.col("modality").isin(*C.TASK_MODALITIES[task])),
        Rule("split", F.col("split").isin(*C.SPLITS)),
    ]
    if task == "distraction":
        rules.append(Rule("subject", ids.full_match(F.col("subject_id"), ids.SUBJECT)))
    rules += [
        Rule("source_file", sources.isNotNull() & (F.size(sources) > 0) & F.forall(sources, lambda s: is_safe_relative_path(s))),
        Rule("integers", ints),
        Rule("window_times", (start >= 0) & (duration > 0) & (end - start == duration)),
    ]
    if task == "fatigue":
        first, last = F.col("p_label_start_ms"), F.col("p_label_end_ms")
        score = F.col("p_kss_score")
        rules += [
            Rule("label_integers", first.isNotNull() & last.isNotNull()),
            Rule("window_grid", (duration == C.WINDOW_MS) & (start % C.STRIDE_MS == 0)),
            Rule("parent_interval", (first >= 0) & (first % C.PARENT_MS == 0) & (last - first == C.PARENT_MS)
                 & (first <= start) & (start < end) & (end <= last)),
            Rule("window_index", index == F.call_function("div", start - first, F.lit(C.WINDOW_MS))),
            Rule("kss_mapping", (label == ids.kss_label_id(score)) & (F.col("label_class") == ids.kss_label_class(score))),
        ]
    else:
        rules += [
            Rule("clip_window", (start == 0) & (end == C.CLIP_MS) & (duration == C.CLIP_MS) & (index == 0)),
            Rule("clip_label", F.col("label_class") == ids.class_name(label.cast("int"), C.CLIP_CLASSES_9)),
        ]
    return rules + _quality_rules(min_ratio) + _feature_rules(_duration_s(task))


def _duration_s(task: str) -> float:
    return (C.WINDOW_MS if task == "fatigue" else C.CLIP_MS) / 1000


def with_facts(rows: DataFrame, bundles: DataFrame | None, duration_s: float,
               shape: tuple[int, int] | None = None) -> DataFrame:
    """Joins the facts of the named feature; nulls where there is none."""
    if bundles is None:
        kinds = {"array_at": "int", "array_rows": "int", "array_columns": "int", "array_ratio": "double"}
        return rows.withColumns({n: F.lit(None).cast(t) for n, t in kinds.items()})
    return rows.join(bundle_facts(bundles, duration_s, shape), "feature_path", "left")


def _error(rows: DataFrame, code: str, rule: str | Column = "") -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return rows.select(F.lit(code).alias("code"), F.col("row_no").cast("bigint").alias("row_no"), rule.alias("rule"))


def _file_error(code: str, flag: DataFrame) -> DataFrame:
    return flag.select(F.lit(code).alias("code"), F.lit(None).cast("bigint").alias("row_no"), F.lit("").alias("rule"))


def validate_metadata(rows: DataFrame, task: str, bundles: DataFrame | None = None,
                      min_ratio: float = C.MIN_COVERAGE) -> DataFrame:
    """Error rows (code, row_no, rule) of a shared metadata table.

    A ``malformed`` column, if there is one, marks lines of the wrong length:
    they are reported and take no further part. The verdicts are written to the
    shared folder, as the checks across rows all start from them.
    """
    errors = []
    if "malformed" in rows.columns:
        errors.append(_error(rows.where("malformed"), "MALFORMED_ROW"))
        rows = rows.where("not malformed").drop("malformed")
    rules = metadata_rules(task, min_ratio)
    judged = with_facts(_typed(rows), bundles, _duration_s(task)).withColumn("__at", first_broken(rules))
    kept = ["row_no", "sample_id", "subject_id", "session_id", "split", "modality", "p_window_start_ms", "__at"]
    if task == "fatigue":
        kept += ["p_label_start_ms", "p_kss_score"]
    state = stage(judged.select(*kept), "verdicts")
    errors += [_row_errors(state, rules, task), _order_errors(state, rules, task)]
    if task == "fatigue":
        odd = stride_check(state.where(passed("__at", "kss_mapping", rules)), ["subject_id", "session_id"], "p_window_start_ms").where("not regular")
        errors.append(_file_error("NONSTANDARD_STRIDE", odd))
    kind = F.when(passed("__at", "modality", rules), F.col("modality"))
    whole = state.agg(F.count(F.lit(1)).alias("n"), F.min(kind).alias("low"), F.max(kind).alias("high"))
    facts = F.array(F.when(F.col("low") != F.col("high"), "MIXED_MODALITIES"), F.when(F.col("n") == 0, "EMPTY_METADATA"))
    errors.append(whole.select(F.explode(F.array_compact(facts)).alias("code")).select(
        "code", F.lit(None).cast("bigint").alias("row_no"), F.lit("").alias("rule")))
    out = errors[0]
    for part in errors[1:]:
        out = out.unionByName(part)
    return out


def _row_errors(state: DataFrame, rules: Sequence[Rule], task: str) -> DataFrame:
    """Errors that a row shows by itself."""

    def error(when: Column, code: str, rule: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.col("row_no").cast("bigint").alias("row_no"), rule.alias("rule")))

    found = [error(F.col("__at").isNotNull(), "INVALID_ROW", rule_name(F.col("__at"), rules))]
    if task == "fatigue":
        wrong = ~F.coalesce(ids.fatigue_split(F.col("subject_id")) == F.col("split"), F.lit(False))
        found.append(error(passed("__at", "split", rules) & wrong, "WRONG_ULDD_SPLIT", F.lit("")))
    return state.select(F.inline(F.array_compact(F.array(*found))))


def _order_errors(state: DataFrame, rules: Sequence[Rule], task: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Errors against the row before with the same key, the rules told apart by a tag, in one layout of the rows.

    A key is a tag, two names and a time; cut by row number, so no key fills a task. A
    ``value`` is what must not change along the key; where any second row is an error, it is null in both.
    """
    none, text = F.lit(None).cast("double"), F.lit("")
    split = F.array_position(F.array(*[F.lit(s) for s in C.SPLITS]), F.col("split")).cast("double")
    checks = [
        ("DUPLICATE_SAMPLE_ID", "identity_fields", F.col("sample_id"), text, F.lit(0), none),
        ("SUBJECT_SPLIT_LEAKAGE", "split", F.col("subject_id"), text, F.lit(0), split),
    ]
    if task == "fatigue":
        place = (F.col("subject_id"), F.col("session_id"))
        checks += [
            ("PARENT_LABEL_CONFLICT", "kss_mapping", *place, F.col("p_label_start_ms"), F.col("p_kss_score")),
            ("DUPLICATE_WINDOW", "kss_mapping", *place, F.col("p_window_start_ms"), none),
        ]
    entries = [
        F.when(passed("__at", after, rules), F.struct(
            F.lit(tag).alias("tag"), one.alias("one"), two.alias("two"), time.cast("bigint").alias("time"),
            F.col("row_no").cast("bigint").alias("row_no"), value.alias("value")))
        for tag, (_, after, one, two, time, value) in enumerate(checks)
    ]
    laid_out = state.select(F.inline(F.array_compact(F.array(*entries))))
    seen = with_history(laid_out, ["tag", "one", "two", "time"], ["row_no"], cut("row_no", chunk_rows), ["row_no", "value"], "before")
    broken = F.col("before.row_no").isNotNull() & F.coalesce(F.col("before.value") != F.col("value"), F.col("value").isNull())
    code = F.get(F.array(*[F.lit(c[0]) for c in checks]), F.col("tag"))
    return seen.where(broken).select(code.alias("code"), "row_no", F.lit("").alias("rule"))


def validation_report(errors: DataFrame) -> DataFrame:
    """PASS or FAIL with the number of errors per code, in one row."""
    return errors.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("error_count"),
        F.when(F.coalesce(F.sum("n"), F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("status"))


def header_errors(columns: Sequence[str], required: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Codes about the header alone; missing columns end the validation."""
    out = []
    if len(columns) != len(set(columns)):
        out.append(("DUPLICATE_COLUMNS", sorted({c for c in columns if list(columns).count(c) > 1})))
    missing = sorted(set(required) - set(columns))
    if missing:
        out.append(("MISSING_COLUMNS", missing))
    return out


# -- telemetry ----------------------------------------------------------------

def telemetry_facts(bundles: DataFrame) -> DataFrame:
    """The telemetry contract's view of each feature, without its arrays."""
    values = telemetry_value_codes().alias("c")
    judged = bundles.withColumn("raw_coverage_ratio", array_mean(F.col("observed_fraction"))).withColumn("__c", values)
    return judged.select(
        "feature_path", "actual_sha256", F.col("raw_coverage_ratio").alias("mean_observed"),
        ((F.size("x") == C.TELEMETRY_SHAPE[0]) & F.forall("x", lambda r: F.size(r) == C.TELEMETRY_SHAPE[1])).alias("shape_ok"),
        (F.size(fixed_grid_codes(300, 0.1, 1e-12)) == 0).alias("grid_ok"), (F.size("__c") == 0).alias("values_ok"))


def telemetry_rules() -> list[Rule]:
    """Row rules of telemetry metadata beyond the shared ones."""
    valid = F.coalesce(F.lower(F.trim("valid")).isin("true", "1"), F.lit(False))
    names = F.from_json("feature_columns", "array<string>")
    bound = F.col("feature_path") != ""
    coverage = near(F.col("raw_coverage_ratio").try_cast("double"), F.col("mean_observed"), 1e-6)
    return [
        Rule("modality", F.col("modality") == "can"),
        Rule("feature_columns", names == F.array(*[F.lit(c) for c in C.TELEMETRY_FEATURES])),
        Rule("valid_status", valid == (F.col("qc_status") == "PASS")),
        Rule("valid_reasons", ~valid | (F.col("qc_reason_codes") == "")),
        Rule("pending_valid", ~((F.col("clock_status") == "pending_after_discontinuity") & valid)),
        Rule("bundle_missing", ~bound | F.col("shape_ok").isNotNull()),
        Rule("shape", ~bound | F.col("shape_ok")),
        Rule("grid", ~bound | F.col("grid_ok")),
        Rule("values", ~bound | (F.col("values_ok") & coverage)),
        Rule("sha256", ~bound | (F.col("feature_sha256") == F.col("actual_sha256"))),
    ]


def validate_telemetry(rows: DataFrame, bundles: DataFrame) -> DataFrame:
    """Telemetry contract on top of the shared one, with the full session grid.

    ``bundles`` also carries ``actual_sha256``.
    """
    shared = validate_metadata(rows, "fatigue", bundles)
    joined = rows.join(telemetry_facts(bundles), "feature_path", "left")
    own = broken_rows(joined, telemetry_rules(), ["row_no"], "INVALID_CAN_ROW").select(
        "code", F.col("row_no").cast("bigint").alias("row_no"), "rule")
    mine = rows.where(F.col("modality") == "can").withColumn("s", strict_int(F.col("window_start_ms"))).where("s is not null")
    grid = full_grid_check(mine, ["session_id"], "s").where("not full_grid")
    return shared.unionByName(own).unionByName(_file_error("INCOMPLETE_CAN_SESSION_GRID", grid))


# -- six-class clips ----------------------------------------------------------

def clip_6_rules(modality: str, expected_split: str, min_ratio: float = C.MIN_COVERAGE) -> list[Rule]:
    """Row rules of six-class metadata; audio and video differ in three points."""
    stems = source_stems(F.col("source_file"))
    sources = F.col("p_sources")
    task = F.substring("sample_id", 1, 2)
    start, end, duration, index = (F.col(f"p_{n}") for n in (
        "window_start_ms", "window_end_ms", "duration_ms", "window_index"))
    safe = F.forall(sources, lambda s: F.coalesce(
        (s != "") & ~F.translate(s, "\\", "/").startswith("/")
        & ~F.array_contains(F.split(F.translate(s, "\\", "/"), "/"), ".."), F.lit(False)))
    same_stem = F.forall(stems, lambda s: s == F.col("sample_id")) & (F.size(stems) == F.size(sources))
    task_no = F.when(task.isin(*C.CLIP_TASKS_6), task).try_cast("int")
    shape = C.CLIP_VIDEO_SHAPE if modality == "video" else None
    rules = [
        Rule("identity_fields", _named()),
        Rule("session_form", ids.full_match(F.col("session_id"), ids.CLIP_SESSION)),
        Rule("source_list", sources.isNotNull() & (F.size(sources) > 0)),
        Rule("source_path", safe),
        Rule("source_stem", same_stem),
        Rule("modality", F.col("modality") == modality),
        Rule("subject", ids.full_match(F.col("subject_id"), ids.SUBJECT)),
        Rule("split", F.col("split").isin(*C.SPLITS)),
        Rule("split_map", F.col("split") == F.col(expected_split)),
        Rule("task", task.isin(*C.CLIP_TASKS_6)),
        Rule("label", (F.col("p_label_id") == ids.six_class_id(task_no)) & (F.col("label_class") == ids.six_class_name(task_no))),
    ]
    if modality == "audio":
        rules.append(Rule("label_scheme", F.col("label_scheme") == C.CLIP_SCHEME))
    rules.append(Rule("clip_window", (start == 0) & (end == C.CLIP_MS) & (duration == C.CLIP_MS) & (index == 0)))
    rules += _quality_rules(min_ratio)
    features = _feature_rules(C.CLIP_SECONDS, shape)
    if modality == "audio":
        features.insert(1, Rule("feature_on_invalid", (F.col("feature_path") == "") | F.col("p_valid")))
    return rules + features


def validate_clips_6(rows: DataFrame, modality: str, splits: DataFrame, bundles: DataFrame | None = None,
                     min_ratio: float = C.MIN_COVERAGE) -> DataFrame:
    """Error rows of six-class metadata. Invalid audio rows may not carry a
    feature, invalid video rows may; video fixes the shape."""
    expected = splits.select("subject_id", F.col("split").alias("__want"))
    rules = clip_6_rules(modality, "__want", min_ratio)
    shape = C.CLIP_VIDEO_SHAPE if modality == "video" else None
    judged = with_facts(_typed(rows).join(expected, "subject_id", "left"), bundles, C.CLIP_SECONDS, shape)
    state = stage(judged.withColumn("__at", first_broken(rules)).select("row_no", "sample_id", "__at"), "verdicts")
    bad = _error(state.where("__at is not null"), "INVALID_ROW", rule_name(F.col("__at"), rules))
    got = state.where(passed("__at", "source_stem", rules))
    again = _error(flag_repeats(got, ["sample_id"]).where("is_repeat"), "DUPLICATE_SAMPLE_ID")
    return bad.unionByName(again)


# -- split, window and pair manifests -----------------------------------------

def split_row_rules() -> list[Rule]:
    """What must hold of every telemetry row before the splits are frozen."""
    valid = F.lower(F.trim("valid"))
    score = F.col("kss_score").try_cast("double")
    is_valid = valid == "true"
    return [
        Rule("sample_id", F.trim("sample_id") != ""),
        Rule("subject_split", F.coalesce(ids.fatigue_split(F.trim("subject_id")) == F.trim("split"), F.lit(False))),
        Rule("kss_mapping", (F.col("label_id") == ids.kss_label_id(score).cast("string"))
             & (F.col("label_class") == ids.kss_label_class(score))),
        Rule("valid_text", valid.isin("true", "false")),
        Rule("valid_quality", ~is_valid | ((F.col("qc_status") == "PASS") & (F.col("error") == "") & (F.col("qc_reason_codes") == ""))),
        Rule("feature_path", ~is_valid | is_safe_relative_path(F.col("feature_path"))),
        Rule("invalid_quality", is_valid | ((F.col("error") != "") & F.col("qc_status").isin("FAIL", "PENDING"))),
    ]


def validate_split_rows(rows: DataFrame) -> DataFrame:
    """Error rows; a repeated sample id is one on its later rows."""
    bad = broken_rows(rows, split_row_rules(), ["row_no"])
    again = flag_repeats(rows.withColumn("__id", F.trim("sample_id")), ["__id"]).where("is_repeat").select(
        "row_no", F.lit("duplicate_sample_id").alias("code"), F.lit("duplicate_sample_id").alias("rule"))
    return bad.unionByName(again)


def window_manifest_rules(split: str) -> list[Rule]:
    """Rules of one split's manifest of valid telemetry windows (text columns)."""
    n = {c: strict_int(F.col(c)) for c in (
        "label_id", "duration_ms", "window_start_ms", "window_end_ms", "label_start_ms", "label_end_ms", "window_index")}
    score = F.col("kss_score").try_cast("double")
    ratio = F.col("valid_ratio").try_cast("double")
    want = n["label_start_ms"] + n["window_index"] * C.WINDOW_MS
    names = F.from_json("feature_columns", "array<string>")
    return [
        Rule("split", F.col("split") == split),
        Rule("subject_split", F.coalesce(ids.fatigue_split(F.trim("subject_id")) == split, F.lit(False))),
        Rule("modality", F.col("modality") == "can"),
        Rule("valid_pass", strict_bool(F.col("valid")) & (F.col("qc_status") == "PASS")),
        Rule("error", F.trim("error") == ""),
        Rule("session_id", F.trim("session_id") != ""),
        Rule("extractor", (F.trim("extractor_name") != "") & (F.trim("extractor_version") != "")),
        Rule("sample_id", F.trim("sample_id") != ""),
        Rule("kss_mapping", (n["label_id"] == ids.kss_label_id(score)) & (F.col("label_class") == ids.kss_label_class(score))),
        Rule("duration", n["duration_ms"] == C.WINDOW_MS),
        Rule("time_bounds", n["window_end_ms"] - n["window_start_ms"] == C.WINDOW_MS),
        Rule("parent_duration", n["label_end_ms"] - n["label_start_ms"] == C.PARENT_MS),
        Rule("window_index", n["window_index"].between(0, C.WINDOWS_PER_PARENT - 1)),
        Rule("index_time", (n["window_start_ms"] == want) & (n["window_end_ms"] == want + C.WINDOW_MS)),
        Rule("feature_shape", int_list(F.col("feature_shape")) == F.array(*[F.lit(v) for v in C.TELEMETRY_SHAPE])),
        Rule("feature_dtype", F.col("feature_dtype") == "float32"),
        Rule("feature_columns", names == F.array(*[F.lit(c) for c in C.TELEMETRY_FEATURES])),
        Rule("valid_ratio", ratio.between(0.95, 1.0)),
        Rule("feature_path", is_safe_relative_path(F.col("feature_path"))),
    ]


def validate_window_manifest(rows: DataFrame, split: str) -> DataFrame:
    return broken_rows(rows, window_manifest_rules(split), ["row_no"])


def pair_rules(split: str) -> list[Rule]:
    """Rules of one split's pair manifest; ``p_*`` free, columns typed as built."""
    start, end = F.col("window_start_ms"), F.col("window_end_ms")
    first, last = F.col("label_start_ms"), F.col("label_end_ms")
    index, score = F.col("window_index"), F.col("kss_score")
    subject, session = F.trim("subject_id"), F.trim("session_id")
    want = first + index * C.WINDOW_MS
    children = F.filter(F.split("video_subwindow_ids", r"\|"), lambda v: v != "")
    condition = F.substring_index(session, "_", -1)
    pair = F.trim("paired_sample_id")
    shape = lambda col, dims: positive_shape(F.col(col)) == F.array(*[F.lit(d) for d in dims])
    return [
        Rule("subject_split", F.coalesce(ids.fatigue_split(subject) == split, F.lit(False))),
        Rule("session_prefix", (session != "") & F.startswith(session, F.concat(subject, F.lit("_")))),
        Rule("paired_valid", F.col("paired_valid")),
        Rule("complete8", F.col("complete8_eligible")),
        Rule("reasons", (F.trim("exclude_reason") == "") & (F.trim("complete8_exclude_reason") == "")),
        Rule("sync_status", F.col("sync_status") == C.SYNC_ALIGNED),
        Rule("offset", F.col("offset_ms") == 0),
        Rule("hardware_clock", ~F.col("hardware_clock_verified")),
        Rule("window_30s", (F.col("duration_ms") == C.WINDOW_MS) & (end - start == C.WINDOW_MS)),
        Rule("parent_240s", last - first == C.PARENT_MS),
        Rule("window_index", index.between(0, C.WINDOWS_PER_PARENT - 1)),
        Rule("index_time", (start == want) & (end == want + C.WINDOW_MS)),
        Rule("kss_mapping", (F.col("label_id") == ids.kss_label_id(score)) & (F.col("label_class") == ids.kss_label_class(score))),
        Rule("pair_id", pair == ids.pair_id(F.col("subject_id"), F.col("session_id"), start, end)),
        Rule("telemetry_id", F.trim("can_sample_id") == pair),
        Rule("parent_id", F.trim("parent_id") == F.format_string("ULDD_%s_%s_%09d_%09d", subject, condition, first, last)),
        Rule("video_shape", shape("video_feature_shape", C.VIDEO_SHAPE)),
        Rule("telemetry_shape", shape("can_feature_shape", C.TELEMETRY_SHAPE)),
        Rule("dtypes", (F.col("video_feature_dtype") == "float32") & (F.col("can_feature_dtype") == "float32")),
        Rule("time_reference", F.col("video_source_time_reference") == "session_relative"),
        Rule("time_transform", F.col("video_time_transform") == "subtract_window_start_ms_div_1000"),
        Rule("children", (F.size(children) == 6) & (F.size(F.array_distinct(children)) == 6)),
        Rule("valid_ratio", F.col("can_valid_ratio").between(0.95, 1.0)),
        Rule("paths", is_safe_relative_path(F.col("video_feature_archive"), False)
             & is_safe_relative_path(F.col("can_feature_path"), False)
             & is_safe_relative_path(F.col("video_feature_member"), False)),
        Rule("sha256", is_sha256(F.col("video_feature_sha256")) & is_sha256(F.col("can_feature_sha256"))),
    ]


def validate_pairs(rows: DataFrame, split: str) -> DataFrame:
    """Error rows of one split, copies of any of the three ids included."""
    mine = rows.where(F.col("split") == split)
    out = broken_rows(mine, pair_rules(split), ["row_no"])
    for name in ("paired_sample_id", "video_sample_id", "can_sample_id"):
        again = flag_repeats(mine, [name]).where("is_repeat")
        out = out.unionByName(again.select(
            "row_no", F.lit(f"duplicate_{name}").alias("code"), F.lit(f"duplicate_{name}").alias("rule")))
    return out


def validate_pair_parents(rows: DataFrame, size: int = C.WINDOWS_PER_PARENT) -> DataFrame:
    """Parents without each index once, one label, one subject and session."""
    state = rows.groupBy("parent_id").agg(
        index_set_is_full(F.col("window_index"), size).alias("full"),
        (F.min("label_id") == F.max("label_id")).alias("label"),
        ((F.min("subject_id") == F.max("subject_id")) & (F.min("session_id") == F.max("session_id"))).alias("owner"),
    )
    code = F.when(~F.col("full"), "window_indices").when(~F.col("label"), "labels").when(~F.col("owner"), "subject_or_session")
    return state.withColumn("code", code).where("code is not null").select("parent_id", "code")


def training_row_rules() -> list[Rule]:
    task = F.substring("sample_id", 1, 2)
    task_no = F.when(task.isin(*C.CLIP_TASKS_6), task).try_cast("int")
    return [
        Rule("sample_id", F.col("sample_id") != ""),
        Rule("label_scheme", F.col("label_scheme") == C.CLIP_SCHEME),
        Rule("split", F.col("split").isin(*C.SPLITS)),
        Rule("task", task_no.isNotNull()),
        Rule("label", (F.col("label_id") == ids.six_class_id(task_no).cast("string")) & (F.col("label_class") == ids.six_class_name(task_no))),
    ]


def validate_training_rows(rows: DataFrame) -> DataFrame:
    bad = broken_rows(rows, training_row_rules(), ["row_no"])
    again = flag_repeats(rows.where("sample_id <> ''"), ["sample_id"]).where("is_repeat").select(
        "row_no", F.lit("duplicate_sample_id").alias("code"), F.lit("duplicate_sample_id").alias("rule"))
    return bad.unionByName(again)


# -- feature requests and hand-offs -------------------------------------------

def forbidden_columns(columns: Sequence[str], parts: Sequence[str] = C.FORBIDDEN_NAME_PARTS) -> list[str]:
    """Column names that would carry a score or label."""
    return [c for c in columns if any(p in c.lower() for p in parts)]


def require_request_columns(rows: DataFrame, fields: Sequence[str] = C.REQUEST_FIELDS) -> DataFrame:
    if tuple(rows.columns) != tuple(fields):
        bad = forbidden_columns(rows.columns)
        raise ContractError(f"request holds scoring columns: {bad}" if bad else f"request columns must be {list(fields)}")
    return rows


def request_rules(subjects: Sequence[str]) -> list[Rule]:
    start, end = F.col("window_start_ms"), F.col("window_end_ms")
    return [
        Rule("sample_id", ids.full_match(F.col("sample_id"), ids.REQUEST_ID)),
        Rule("subject", F.col("subject_id").isin(*subjects)),
        Rule("subject_session", F.startswith("session_id", F.concat("subject_id", F.lit("_")))),
        Rule("interval", (end - start == C.WINDOW_MS) & (start >= 0)),
        Rule("source_path", is_safe_relative_path(F.col("source_feature"), False)),
        Rule("time_reference", F.col("source_time_reference").isin("session_relative", "sample_relative")),
    ]


def _copies(rows: DataFrame) -> DataFrame:
    twice = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    code = F.lit("duplicate_sample_id")
    return twice.select("sample_id", code.alias("code"), code.alias("rule"))


def _absent_subjects(rows: DataFrame, subjects: Sequence[str]) -> DataFrame:
    seen = rows.agg(*[F.count_if(F.col("subject_id") == s).alias(s) for s in subjects])
    return seen.select(F.inline(F.array(*[
        F.struct(F.lit("").alias("sample_id"), F.lit("missing_subject").alias("code"),
                 F.lit(s).alias("rule"), F.col(s).alias("n")) for s in subjects]))).where("n = 0").drop("n")


def validate_request(rows: DataFrame, subjects: Sequence[str] = C.FATIGUE_SUBJECTS["test"]) -> DataFrame:
    """Error rows of a feature request: rules, copies, and subjects not asked for."""
    bad = broken_rows(rows, request_rules(subjects), ["sample_id"])
    return bad.unionByName(_copies(rows)).unionByName(_absent_subjects(rows, subjects))


def validate_package(index: DataFrame, bundles: DataFrame, subjects: Sequence[str] = C.FATIGUE_SUBJECTS["test"]) -> DataFrame:
    """Error rows of a delivered feature package: index rules, hashes, arrays.

    ``bundles`` has feature_path, actual_sha256 and the arrays in sample time;
    they are judged first, so only their verdict is joined to the index.
    """
    arrays = bundle_rules(C.WINDOW_MS / 1000, C.VIDEO_SHAPE)
    strict = [
        *arrays,
        Rule("time_support", F.size(time_support_codes(C.WINDOW_MS / 1000)) == 0),
        Rule("no_valid_token", F.exists("valid_mask", lambda v: v)),
    ]
    facts = bundles.select(
        "feature_path", "actual_sha256", F.coalesce(rule_name(first_broken(strict), strict), F.lit("")).alias("array_rule"))
    joined = index.join(facts, "feature_path", "left")
    rules = [
        Rule("subject", F.col("subject_id").isin(*subjects)),
        Rule("feature_path", is_safe_relative_path(F.col("feature_path"), False)),
        Rule("missing_feature", F.col("array_rule").isNotNull()),
        Rule("feature_hash", F.col("actual_sha256") == F.col("feature_sha256")),
        *[Rule(r.name, F.col("array_rule") != r.name) for r in strict],
        Rule("declaration", (F.col("feature_shape") == "[6,96]") & (F.col("feature_dtype") == "float32")),
    ]
    bad = broken_rows(joined, rules, ["sample_id"])
    return bad.unionByName(_copies(index)).unionByName(_absent_subjects(index, subjects))


def validate_video_features(windows: DataFrame, features: DataFrame, children: DataFrame,
                            bundles: DataFrame) -> DataFrame:
    """Findings (sample_id, code) of a video hand-off; set findings have ''.

    ``bundles``: sample_id, actual_sha256 and the five arrays in sample time.
    """
    sets = id_set_difference(windows, features, "sample_id")
    set_codes = codes_where(
        ("duplicate_window_id", F.col("duplicate_left") > 0), ("duplicate_feature_id", F.col("duplicate_right") > 0),
        ("id_sets_differ", ~F.col("equal")))
    file_level = sets.select(F.lit("").alias("sample_id"), F.explode(set_codes).alias("code"))
    bound = child_binding(windows, features, children).select("sample_id", F.explode("codes").alias("code"))
    joined = features.join(bundles, "sample_id", "left")
    ones = F.forall("observed_fraction", lambda v: F.abs(v - 1.0) <= 1e-5 + 1e-8)
    arrays = codes_where(
        ("x_shape", ~((F.size("x") == C.VIDEO_SHAPE[0]) & F.forall("x", lambda r: F.size(r) == C.VIDEO_SHAPE[1]))),
        ("valid_mask", ~((F.size("valid_mask") == C.VIDEO_SHAPE[0]) & F.forall("valid_mask", lambda v: v))),
        ("observed_fraction", ~((F.size("observed_fraction") == C.VIDEO_SHAPE[0]) & ones)),
        ("nonfinite", ~F.forall("x", lambda r: F.forall(r, is_finite))),
    )
    codes = (
        F.when(F.col("x").isNull(), F.array(F.lit("missing_feature")))
        .when(F.col("actual_sha256") != F.col("feature_sha256"), F.array(F.lit("feature_hash")))
        .otherwise(F.concat(arrays, fixed_grid_codes()))
    )
    per_row = joined.select("sample_id", F.explode(codes).alias("code"))
    return file_level.unionByName(bound).unionByName(per_row)


def telemetry_feature_codes(has_file: Column, stored_hash: Column, actual_hash: Column) -> Column:
    """The light check made while pairing; a missing file ends it."""
    x = F.col("x")
    shape = (F.size(x) == C.TELEMETRY_SHAPE[0]) & F.forall(x, lambda r: F.size(r) == C.TELEMETRY_SHAPE[1])
    finite = F.forall(x, lambda r: F.forall(r, is_finite)) & F.forall("time_s", is_finite)
    relative = (F.array_min("time_s") >= 0) & (F.array_max(F.transform("support_s", lambda s: s["end"])) <= 30)
    codes = codes_where(
        ("can_feature_hash_mismatch", stored_hash != actual_hash),
        ("can_x_shape_dtype", ~shape), ("can_nonfinite", ~finite), ("can_time_not_sample_relative", ~relative))
    return F.when(~F.coalesce(has_file, F.lit(False)), F.array(F.lit("missing_can_feature"))).otherwise(codes)


def read_split(rows: DataFrame, split: str, allow_test: bool = False) -> DataFrame:
    """Rows of one split. The test split is locked, and a development manifest
    may not hold a test row at all."""
    if split not in C.SPLITS:
        raise ContractError(f"unknown split {split!r}")
    if not allow_test:
        if split == "test":
            raise LockedSplitError("the test split is locked")
        if not rows.where(F.col("split") == "test").isEmpty():
            raise LockedSplitError("a development manifest must not hold test rows")
    return rows.where(F.col("split") == split)
