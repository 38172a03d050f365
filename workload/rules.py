"""Ordered rule lists over manifests derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids
from tidegrid.operators import validators as V
from workload.registry import query, sql, table, view
from workload.views import (
    SQL_LETTERS, _place, _placed, letter, sql_kss_class, sql_kss_id, sql_split, v_tok,
)

# -- a fatigue manifest as exported text, with every kind of defect ----------------
# One order is one window. Defects follow from the order's own fields.

view("v_man", f"""
SELECT o_orderkey + 2 AS row_no, CASE WHEN o_orderkey % 97 = 5 THEN '' WHEN o_orderkey % 41 = 3 THEN 'S' || o_custkey ELSE 'S' || o_orderkey || '-' || o_custkey END AS sample_id,
 CASE WHEN o_orderkey % 53 = 2 THEN 'audio' WHEN o_orderkey % 2 = 0 THEN 'can' ELSE 'video' END AS modality, subject_id, subject_id || '_' || condition AS session_id,
 CASE WHEN o_orderkey % 59 = 4 THEN 'holdout' WHEN o_orderkey % 61 = 7 THEN 'val' ELSE {sql_split('subject_id')} END AS split,
 CASE WHEN o_orderkey % 67 = 8 THEN '["a.csv","../b.csv"]' WHEN o_orderkey % 3 = 0 THEN '["a.csv","b.csv"]' ELSE 'raw/a.csv' END AS source_file,
 CASE WHEN o_orderkey % 71 = 9 THEN '1.5' ELSE CAST(slot AS VARCHAR) END AS window_index,
 CAST(label_start_ms + slot * 30000 + CASE WHEN o_orderkey % 73 = 11 THEN 500 ELSE 0 END AS VARCHAR) AS window_start_ms,
 CAST(label_start_ms + slot * 30000 + 30000 + CASE WHEN o_orderkey % 73 = 11 THEN 500 WHEN o_orderkey % 79 = 12 THEN 1 ELSE 0 END AS VARCHAR) AS window_end_ms, '30000' AS duration_ms,
 CAST(label_start_ms + CASE WHEN o_orderkey % 83 = 13 THEN 1000 ELSE 0 END AS VARCHAR) AS label_start_ms, CAST(label_start_ms + 240000 AS VARCHAR) AS label_end_ms,
 CAST(base_score + CASE WHEN o_orderkey % 89 = 14 AND base_score < 8 THEN 0.25 ELSE 0 END AS VARCHAR) AS kss_score,
 {sql_kss_class('(base_score + CASE WHEN o_orderkey % 89 = 14 AND base_score < 8 THEN 0.25 ELSE 0 END)')} AS label_class,
 CAST({sql_kss_id('(base_score + CASE WHEN o_orderkey % 89 = 14 AND base_score < 8 THEN 0.25 ELSE 0 END)')} + CASE WHEN o_orderkey % 43 = 6 THEN 1 ELSE 0 END AS VARCHAR) AS label_id,
 CASE WHEN o_orderkey % 47 = 1 THEN 'yes' WHEN o_orderstatus = 'P' THEN 'false' ELSE ' True ' END AS valid,
 CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 37 = 1 THEN '0.5' ELSE '0' END WHEN o_orderkey % 31 = 2 THEN '0.9' WHEN o_orderkey % 29 = 2 THEN 'nan' ELSE '1' END AS valid_ratio,
 CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'f/' || o_custkey || '.npz::valid_mask' END AS mask, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'f/' || o_custkey || '.npz' END AS feature_path,
 CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderkey % 19 = 2 THEN '[16,5]' ELSE '[16, 4]' END AS feature_shape, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'float32' END AS feature_dtype,
 'box' AS extractor_name, CASE WHEN o_orderkey % 23 = 4 THEN 'Latest' ELSE '1.0' END AS extractor_version,
 CASE WHEN o_orderstatus = 'P' AND o_orderkey % 17 <> 1 THEN 'GAP' WHEN o_orderstatus = 'F' AND o_orderkey % 13 = 1 THEN 'odd' ELSE '' END AS error, o_orderkey, o_custkey
FROM (SELECT *, {_place('o_orderkey')} FROM orders)""")


def v_man(spark, d):
    rows = _placed(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    k, p = F.col("o_orderkey"), F.col("o_orderstatus") == "P"
    hit = lambda n, r: k % n == r
    text = lambda c: c.cast("string")
    score = F.col("kss_score") + F.when(hit(89, 14) & (F.col("kss_score") < 8), 0.25).otherwise(0.0)
    start = F.col("window_start_ms")
    off = F.when(hit(73, 11), 500).otherwise(0)
    path = F.concat(F.lit("f/"), "o_custkey", F.lit(".npz"))
    return rows.select(
        (k + 2).alias("row_no"),
        F.when(hit(97, 5), "").when(hit(41, 3), F.concat(F.lit("S"), "o_custkey")).otherwise(F.concat(F.lit("S"), k, F.lit("-"), "o_custkey")).alias("sample_id"),
        F.when(hit(53, 2), "audio").when(k % 2 == 0, "can").otherwise("video").alias("modality"), "subject_id", "session_id",
        F.when(hit(59, 4), "holdout").when(hit(61, 7), "val").otherwise(F.col("split")).alias("split"),
        F.when(hit(67, 8), '["a.csv","../b.csv"]').when(k % 3 == 0, '["a.csv","b.csv"]').otherwise("raw/a.csv").alias("source_file"),
        F.when(hit(71, 9), "1.5").otherwise(text(k % 8)).alias("window_index"),
        text(start + off).alias("window_start_ms"),
        text(start + 30_000 + F.when(hit(73, 11), 500).when(hit(79, 12), 1).otherwise(0)).alias("window_end_ms"), F.lit("30000").alias("duration_ms"),
        text(F.col("label_start_ms") + F.when(hit(83, 13), 1000).otherwise(0)).alias("label_start_ms"), text(F.col("label_start_ms") + 240_000).alias("label_end_ms"),
        text(score).alias("kss_score"), ids.kss_label_class(score).alias("label_class"),
        text(ids.kss_label_id(score) + F.when(hit(43, 6), 1).otherwise(0)).alias("label_id"),
        F.when(hit(47, 1), "yes").when(p, "false").otherwise(" True ").alias("valid"),
        F.when(p, F.when(hit(37, 1), "0.5").otherwise("0")).when(hit(31, 2), "0.9").when(hit(29, 2), "nan").otherwise("1").alias("valid_ratio"),
        F.when(p, "").otherwise(F.concat(path, F.lit("::valid_mask"))).alias("mask"), F.when(p, "").otherwise(path).alias("feature_path"),
        F.when(p, "").when(hit(19, 2), "[16,5]").otherwise("[16, 4]").alias("feature_shape"), F.when(p, "").otherwise("float32").alias("feature_dtype"),
        F.lit("box").alias("extractor_name"), F.when(hit(23, 4), "Latest").otherwise("1.0").alias("extractor_version"),
        F.when(p & (k % 17 != 1), "GAP").when((F.col("o_orderstatus") == "F") & hit(13, 1), "odd").otherwise("").alias("error"))


# the bundles of 30 s: the 10 s bundles stretched threefold
view("v_bun", """
SELECT 'f/' || vec_id || '.npz' AS feature_path, label, bool_and(coalesce(t > pt, true)) AS rising, bool_and(s * 3 >= 0 AND e * 3 <= 30 + 1e-9 AND e > s) AS support_ok,
 bool_and(t >= s AND t < e) AS centre_ok, bool_and(fraction BETWEEN 0 AND 1) AS fraction_ok, sum(CASE WHEN valid THEN greatest(0, e - greatest(s, coalesce(reach, s))) ELSE 0 END) / 10 AS ratio
FROM (SELECT *, lag(t) OVER (PARTITION BY vec_id ORDER BY k) AS pt, max(CASE WHEN valid THEN e END) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_tok)
GROUP BY ALL""", "v_tok")


def v_bundles(spark, d, factor=3.0):
    rows = v_tok(spark, d)
    return rows.select(
        F.concat(F.lit("f/"), "vec_id", F.lit(".npz")).alias("feature_path"), "x", F.transform("time_s", lambda t: t * factor).alias("time_s"), "valid_mask",
        F.transform("support_s", lambda s: F.struct((s["start"] * factor).alias("start"), (s["end"] * factor).alias("end"))).alias("support_s"), "observed_fraction")


_INT = "regexp_full_match({0}, '-?[0-9]+')"
_V1 = f"""
t AS (SELECT m.*, TRY_CAST(CASE WHEN {_INT.format('window_start_ms')} THEN window_start_ms END AS BIGINT) AS s, CAST(window_end_ms AS BIGINT) AS e, CAST(duration_ms AS BIGINT) AS du,
  CASE WHEN {_INT.format('window_index')} THEN TRY_CAST(window_index AS BIGINT) END AS wi, CAST(label_id AS BIGINT) AS li, CAST(label_start_ms AS BIGINT) AS ls, CAST(label_end_ms AS BIGINT) AS le,
  CAST(kss_score AS DOUBLE) AS sc, CAST(valid_ratio AS DOUBLE) AS vr, lower(trim(valid)) AS va, b.rising, b.support_ok, b.centre_ok, b.fraction_ok, b.ratio, b.label AS blabel
 FROM v_man m LEFT JOIN v_bun b USING (feature_path)),
r AS (SELECT *, CASE
 WHEN sample_id = '' OR lower(extractor_version) IN ('latest', 'to_be_filled') THEN 'identity_fields' WHEN modality NOT IN ('video', 'can') THEN 'modality' WHEN split NOT IN ('train', 'val', 'test') THEN 'split'
 WHEN contains(source_file, '..') THEN 'source_file' WHEN wi IS NULL THEN 'integers' WHEN s < 0 OR du <= 0 OR e - s <> du THEN 'window_times'
 WHEN du <> 30000 OR s % 30000 <> 0 THEN 'window_grid' WHEN ls < 0 OR ls % 240000 <> 0 OR le - ls <> 240000 OR s < ls OR e > le THEN 'parent_interval'
 WHEN wi <> (s - ls) // 30000 THEN 'window_index' WHEN li <> {sql_kss_id('sc')} OR label_class <> {sql_kss_class('sc')} THEN 'kss_mapping'
 WHEN va NOT IN ('true', 'false', '1', '0') THEN 'valid_text' WHEN isnan(vr) OR vr NOT BETWEEN 0 AND 1 THEN 'ratio_range' WHEN va = 'true' AND error <> '' THEN 'valid_with_error'
 WHEN va = 'false' AND error = '' THEN 'invalid_without_error' WHEN va = 'true' AND vr < 0.95 THEN 'ratio_below_threshold'
 WHEN feature_path = '' AND (va = 'true' OR vr <> 0 OR mask <> '') THEN 'absent_feature' WHEN feature_path <> '' AND blabel IS NULL THEN 'bundle_missing'
 WHEN feature_path <> '' AND feature_shape = '[16,5]' THEN 'declared_shape' WHEN feature_path <> '' AND NOT rising THEN 'time_increasing' WHEN feature_path <> '' AND NOT support_ok THEN 'support'
 WHEN feature_path <> '' AND NOT centre_ok THEN 'centre' WHEN feature_path <> '' AND NOT fraction_ok THEN 'fraction' WHEN feature_path <> '' AND abs(vr - ratio) > 1e-6 THEN 'ratio_union' END AS rule FROM t),
p AS (SELECT *, coalesce(list_position(['identity_fields','modality','split','source_file','integers','window_times','window_grid','parent_interval','window_index','kss_mapping'], rule), 99) AS reached FROM r),
errors AS (SELECT 'INVALID_ROW' AS code, row_no, rule FROM p WHERE rule IS NOT NULL
 UNION ALL SELECT 'DUPLICATE_SAMPLE_ID', row_no, '' FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY row_no) AS c FROM p WHERE reached > 1) WHERE c > 1
 UNION ALL SELECT 'SUBJECT_SPLIT_LEAKAGE', row_no, '' FROM (SELECT *, lag(split) OVER (PARTITION BY subject_id ORDER BY row_no) AS b FROM p WHERE reached > 3) WHERE b <> split
 UNION ALL SELECT 'WRONG_ULDD_SPLIT', row_no, '' FROM p WHERE reached > 3 AND {sql_split('subject_id')} IS DISTINCT FROM split
 UNION ALL SELECT 'PARENT_LABEL_CONFLICT', row_no, '' FROM (SELECT *, lag(sc) OVER (PARTITION BY subject_id, session_id, ls ORDER BY row_no) AS b FROM p WHERE reached > 10) WHERE b <> sc
 UNION ALL SELECT 'DUPLICATE_WINDOW', row_no, '' FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, session_id, s ORDER BY row_no) AS c FROM p WHERE reached > 10) WHERE c > 1
 UNION ALL SELECT 'NONSTANDARD_STRIDE', NULL, '' FROM (SELECT subject_id, session_id, bool_or(step <> 30000) AS odd FROM (
   SELECT *, s - lag(s) OVER (PARTITION BY subject_id, session_id ORDER BY s) AS step FROM (SELECT DISTINCT subject_id, session_id, s FROM p WHERE reached > 10)) GROUP BY ALL) WHERE odd
 UNION ALL SELECT 'MIXED_MODALITIES', NULL, '' FROM (SELECT count(DISTINCT modality) AS n FROM p WHERE reached > 2) WHERE n > 1)"""


def v1(spark, d):
    return V.validate_metadata(v_man(spark, d), "fatigue", v_bundles(spark, d))


@query("validate_metadata", sql("v_man v_bun", f"WITH {_V1} SELECT code, rule, count(*) AS n, CAST(coalesce(sum(row_no), 0) AS BIGINT) AS row_total FROM errors GROUP BY code, rule"))
def validate_metadata(spark, d):
    return v1(spark, d).groupBy("code", "rule").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("row_no"), F.lit(0)).alias("row_total"))


@query("validation_report", sql("v_man v_bun", f"WITH {_V1} SELECT count(*) AS error_count, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM errors"))
def validation_report(spark, d):
    return V.validation_report(v1(spark, d))


# -- V2 ------------------------------------------------------------------------------

_NAMES = "[" + ",".join(f'"{c}"' for c in C.TELEMETRY_FEATURES) + "]"
view("v_tman", f"""
SELECT m.*, CASE WHEN o_orderkey % 18 = 3 THEN '["rpm"]' ELSE '{_NAMES}' END AS feature_columns, CASE WHEN error = '' THEN 'PASS' ELSE 'FAIL' END AS qc_status,
 CASE WHEN o_orderkey % 14 = 3 THEN 'LOW' ELSE error END AS qc_reason_codes, CASE WHEN o_orderkey % 16 = 3 THEN 'pending_after_discontinuity' ELSE 'stable' END AS clock_status FROM v_man m""", "v_man")


@query("validate_telemetry", sql("v_tman", f"""
WITH x AS (SELECT *, lower(trim(valid)) IN ('true', '1') AS ok FROM v_tman),
c AS (SELECT row_no, CASE WHEN modality <> 'can' THEN 'modality' WHEN feature_columns = '["rpm"]' THEN 'feature_columns' WHEN ok <> (qc_status = 'PASS') THEN 'valid_status' WHEN ok AND qc_reason_codes <> '' THEN 'valid_reasons'
  WHEN clock_status <> 'stable' AND ok THEN 'pending_valid' WHEN feature_path <> '' AND o_custkey >= (SELECT count(*) FROM embeddings) THEN 'bundle_missing' WHEN feature_path <> '' THEN 'shape' END AS rule FROM x),
g AS (SELECT session_id, list_sort(list(CAST(window_start_ms AS BIGINT))) = range(0, 2400000, 30000) AS whole FROM v_tman WHERE modality = 'can' GROUP BY session_id)
SELECT 'INVALID_CAN_ROW' AS code, rule, count(*) AS n FROM c WHERE rule IS NOT NULL GROUP BY rule UNION ALL SELECT 'INCOMPLETE_CAN_SESSION_GRID', '', count(*) FROM g WHERE NOT whole HAVING count(*) > 0"""))
def validate_telemetry(spark, d):
    k = F.col("row_no") - 2
    rows = v_man(spark, d).withColumns({
        "feature_columns": F.when(k % 18 == 3, '["rpm"]').otherwise(_NAMES), "qc_status": F.when(F.col("error") == "", "PASS").otherwise("FAIL"),
        "qc_reason_codes": F.when(k % 14 == 3, "LOW").otherwise(F.col("error")),
        "clock_status": F.when(k % 16 == 3, "pending_after_discontinuity").otherwise("stable"),
        "raw_coverage_ratio": F.lit("1"), "feature_sha256": F.lit("h")})
    errors = V.validate_telemetry(rows, v_bundles(spark, d).withColumn("actual_sha256", F.lit("h")))
    own = errors.where("code in ('INVALID_CAN_ROW', 'INCOMPLETE_CAN_SESSION_GRID')")
    return own.groupBy("code", "rule").agg(F.count(F.lit(1)).alias("n"))


# -- V3, V4, V9: six-class clip manifests ---------------------------------------------

view("v_six_man", """
SELECT k + 2 AS row_no, CASE WHEN k % 101 = 7 THEN '' ELSE stem END AS sample_id, CASE WHEN k % 61 = 5 THEN 'text' ELSE 'M' END AS modality, CASE WHEN k % 67 = 3 THEN 'P99' ELSE subject END AS subject_id,
 CASE WHEN k % 71 = 4 THEN subject ELSE subject || '_20231111_0931_43' END AS session_id, CASE WHEN k % 73 = 5 THEN 'dev' WHEN k % 79 = 6 THEN 'test' ELSE want END AS split, want,
 CASE WHEN k % 83 = 2 THEN '/abs/' || stem || '.wav' WHEN k % 89 = 9 THEN 'clips/other.wav' ELSE '["clips/' || stem || '.wav"]' END AS source_file, tc,
 CASE WHEN k % 59 = 8 THEN '9' ELSE CAST(coalesce(lid, 0) AS VARCHAR) END AS label_id, coalesce((['No task','Playing game','Messaging','Phone call','Reading','Eating'])[lid + 1], 'No task') AS label_class,
 CASE WHEN k % 53 = 4 THEN 'old' ELSE 'dcpt_video_6c_v1' END AS label_scheme, CASE WHEN k % 97 = 3 THEN '9999' ELSE '10000' END AS window_end_ms,
 CASE WHEN k % 4 = 0 THEN 'false' ELSE 'true' END AS valid, CASE WHEN k % 4 = 0 THEN '0' ELSE '1' END AS valid_ratio, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 'NO_FEATURES_YET' ELSE 'coverage_below_0.95' END ELSE '' END AS error,
 CASE WHEN k % 8 = 0 THEN '' ELSE 'f/' || c || '.npz' END AS feature_path, c
FROM (SELECT o_orderkey AS k, o_custkey AS c, lpad(CAST(o_custkey % 9 + 1 AS VARCHAR), 2, '0') || '_' || o_orderkey // 2 AS stem, o_custkey % 9 + 1 AS tc, CAST(list_position([1,3,4,5,7,8], o_custkey % 9 + 1) - 1 AS INT) AS lid,
  'P' || lpad(CAST(o_custkey % 40 + 1 AS VARCHAR), 2, '0') AS subject, CASE WHEN o_custkey % 40 < 24 THEN 'train' WHEN o_custkey % 40 < 32 THEN 'val' ELSE 'test' END AS want FROM orders)""")


def v_six_man(spark, d, modality):
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    hit = lambda n, r: k % n == r
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    task = c % 9 + 1
    stem = F.concat(two(task), F.lit("_"), F.call_function("div", k, F.lit(2)))
    subject = F.concat(F.lit("P"), two(c % 40 + 1))
    want = F.when(c % 40 < 24, "train").when(c % 40 < 32, "val").otherwise("test")
    label = F.coalesce(ids.six_class_id(task), F.lit(0))
    path = F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("f/"), c, F.lit(".npz")))
    bound = k % 8 != 0
    return rows.select(
        (k + 2).alias("row_no"), F.when(hit(101, 7), "").otherwise(stem).alias("sample_id"), F.when(hit(61, 5), "text").otherwise(modality).alias("modality"),
        F.when(hit(67, 3), "P99").otherwise(subject).alias("subject_id"),
        F.when(hit(71, 4), subject).otherwise(F.concat(subject, F.lit("_20231111_0931_43"))).alias("session_id"),
        F.when(hit(73, 5), "dev").when(hit(79, 6), "test").otherwise(want).alias("split"),
        F.when(hit(83, 2), F.concat(F.lit("/abs/"), stem, F.lit(".wav"))).when(hit(89, 9), "clips/other.wav")
        .otherwise(F.concat(F.lit('["clips/'), stem, F.lit('.wav"]'))).alias("source_file"),
        F.lit("0").alias("window_index"), F.lit("0").alias("window_start_ms"), F.when(hit(97, 3), "9999").otherwise("10000").alias("window_end_ms"), F.lit("10000").alias("duration_ms"),
        F.when(hit(59, 8), "9").otherwise(label.cast("string")).alias("label_id"), ids.class_name(label, C.CLIP_CLASSES_6).alias("label_class"),
        F.when(hit(53, 4), "old").otherwise(C.CLIP_SCHEME).alias("label_scheme"), F.when(k % 4 == 0, "false").otherwise("true").alias("valid"),
        F.when(k % 4 == 0, "0").otherwise("1").alias("valid_ratio"), F.when(bound, F.concat(path, F.lit("::valid_mask"))).otherwise("").alias("mask"), path.alias("feature_path"),
        F.when(bound, "[16,4]").otherwise("").alias("feature_shape"), F.when(bound, "float32").otherwise("").alias("feature_dtype"), F.lit("net").alias("extractor_name"), F.lit("v1").alias("extractor_version"),
        F.when(k % 4 == 0, F.when(k % 8 == 0, C.NO_FEATURES).otherwise(C.COVERAGE_BELOW)).otherwise("").alias("error"))


def clip_splits(spark, d):
    c = F.col("c_custkey") % 40
    return table(spark, d, "customer", "c_custkey").select(
        F.concat(F.lit("P"), F.lpad((c + 1).cast("string"), 2, "0")).alias("subject_id"),
        F.when(c < 24, "train").when(c < 32, "val").otherwise("test").alias("split")).distinct()


def _six_sql(audio: bool) -> str:
    audio_scheme = "WHEN label_scheme = 'old' THEN 'label_scheme'" if audio else ""
    audio_invalid = "WHEN feature_path <> '' AND valid = 'false' THEN 'feature_on_invalid'" if audio else ""
    arrays = """WHEN feature_path <> '' AND NOT b.rising THEN 'time_increasing' WHEN feature_path <> '' AND NOT b.support_ok THEN 'support' WHEN feature_path <> '' AND NOT b.centre_ok THEN 'centre'
 WHEN feature_path <> '' AND NOT b.fraction_ok THEN 'fraction' WHEN feature_path <> '' AND abs(CAST(valid_ratio AS DOUBLE) - b.ratio) > 1e-6 THEN 'ratio_union'"""
    tail = arrays if audio else "WHEN feature_path <> '' THEN 'expected_shape'"
    return sql("v_six_man v_bun", f"""
WITH r AS (SELECT m.*, CASE WHEN sample_id = '' THEN 'identity_fields' WHEN NOT regexp_full_match(session_id, 'P[0-9]{{2}}_[0-9]{{8}}_[0-9]{{4}}_[0-9]{{2}}') THEN 'session_form' WHEN starts_with(source_file, '/') THEN 'source_path'
 WHEN source_file = 'clips/other.wav' THEN 'source_stem' WHEN modality <> 'M' THEN 'modality' WHEN subject_id = 'P99' THEN 'subject' WHEN split = 'dev' THEN 'split' WHEN split <> want THEN 'split_map'
 WHEN tc NOT IN (1,3,4,5,7,8) THEN 'task' WHEN label_id = '9' THEN 'label' {audio_scheme} WHEN window_end_ms <> '10000' THEN 'clip_window'
 {audio_invalid} WHEN feature_path <> '' AND b.label IS NULL THEN 'bundle_missing' {tail} END AS rule FROM v_six_man m LEFT JOIN v_bun b USING (feature_path)),
e AS (SELECT 'INVALID_ROW' AS code, rule, row_no FROM r WHERE rule IS NOT NULL UNION ALL SELECT 'DUPLICATE_SAMPLE_ID', '', row_no FROM (
 SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY row_no) AS c2 FROM r WHERE rule IS NULL OR rule NOT IN ('identity_fields', 'session_form', 'source_path', 'source_stem')) WHERE c2 > 1)
SELECT code, rule, count(*) AS n, CAST(sum(row_no) AS BIGINT) AS row_total FROM e GROUP BY code, rule""")


def _six(spark, d, modality):
    errors = V.validate_clips_6(v_six_man(spark, d, modality), modality, clip_splits(spark, d), v_bundles(spark, d, 1.0))
    return errors.groupBy("code", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("row_total"))


@query("validate_audio_6c", _six_sql(True))
def validate_audio_6c(spark, d):
    return _six(spark, d, "audio")


@query("validate_video_6c", _six_sql(False))
def validate_video_6c(spark, d):
    return _six(spark, d, "video")


@query("validate_training_rows", sql("v_six_man", """
WITH e AS (SELECT CASE WHEN sample_id = '' THEN 'sample_id' WHEN label_scheme = 'old' THEN 'label_scheme' WHEN split = 'dev' THEN 'split' WHEN tc NOT IN (1,3,4,5,7,8) THEN 'task' WHEN label_id = '9' THEN 'label' END AS rule FROM v_six_man
 UNION ALL SELECT 'duplicate_sample_id' FROM (SELECT row_number() OVER (PARTITION BY sample_id ORDER BY row_no) AS c FROM v_six_man WHERE sample_id <> '') WHERE c > 1)
SELECT rule, count(*) AS n FROM e WHERE rule IS NOT NULL GROUP BY rule"""))
def validate_training_rows(spark, d):
    return V.validate_training_rows(v_six_man(spark, d, "video")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# -- V5, V6 --------------------------------------------------------------------------------

@query("validate_split_rows", sql("v_tman", f"""
WITH e AS (SELECT CASE WHEN sample_id = '' THEN 'sample_id' WHEN {sql_split('subject_id')} IS DISTINCT FROM split THEN 'subject_split'
  WHEN CAST(label_id AS INT) <> {sql_kss_id('CAST(kss_score AS DOUBLE)')} OR label_class <> {sql_kss_class('CAST(kss_score AS DOUBLE)')} THEN 'kss_mapping' WHEN lower(trim(valid)) NOT IN ('true', 'false') THEN 'valid_text'
  WHEN lower(trim(valid)) = 'true' AND (qc_status <> 'PASS' OR error <> '' OR qc_reason_codes <> '') THEN 'valid_quality'
  WHEN lower(trim(valid)) = 'false' AND (error = '' OR qc_status NOT IN ('FAIL', 'PENDING')) THEN 'invalid_quality' END AS rule FROM v_tman
 UNION ALL SELECT 'duplicate_sample_id' FROM (SELECT row_number() OVER (PARTITION BY sample_id ORDER BY row_no) AS c FROM v_tman) WHERE c > 1)
SELECT rule, count(*) AS n FROM e WHERE rule IS NOT NULL GROUP BY rule"""))
def validate_split_rows(spark, d):
    return V.validate_split_rows(_telemetry_man(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _telemetry_man(spark, d):
    k = F.col("row_no") - 2
    return v_man(spark, d).withColumns({
        "feature_columns": F.when(k % 18 == 3, '["rpm"]').otherwise(_NAMES), "qc_status": F.when(F.col("error") == "", "PASS").otherwise("FAIL"),
        "qc_reason_codes": F.when(k % 14 == 3, "LOW").otherwise(F.col("error"))})


@query("validate_window_manifest", sql("v_tman", f"""
WITH e AS (SELECT CASE WHEN split <> 'train' THEN 'split' WHEN {sql_split('subject_id')} IS DISTINCT FROM 'train' THEN 'subject_split' WHEN modality <> 'can' THEN 'modality'
  WHEN lower(trim(valid)) NOT IN ('true', '1') OR qc_status <> 'PASS' THEN 'valid_pass' WHEN trim(error) <> '' THEN 'error' WHEN sample_id = '' THEN 'sample_id'
  WHEN CAST(label_id AS INT) <> {sql_kss_id('CAST(kss_score AS DOUBLE)')} THEN 'kss_mapping' WHEN CAST(window_end_ms AS BIGINT) - CAST(window_start_ms AS BIGINT) <> 30000 THEN 'time_bounds'
  WHEN CAST(label_end_ms AS BIGINT) - CAST(label_start_ms AS BIGINT) <> 240000 THEN 'parent_duration' WHEN window_index = '1.5' THEN 'window_index'
  WHEN CAST(window_start_ms AS BIGINT) <> CAST(label_start_ms AS BIGINT) + TRY_CAST(window_index AS BIGINT) * 30000 THEN 'index_time' ELSE 'feature_shape' END AS rule FROM v_tman)
SELECT rule, count(*) AS n FROM e GROUP BY rule"""))
def validate_window_manifest(spark, d):
    return V.validate_window_manifest(_telemetry_man(spark, d), "train").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# -- V7, V8: pair manifest --------------------------------------------------------------------

view("v_pman", f"""
SELECT o_orderkey + 2 AS row_no, o_orderkey AS k, subject_id, CASE WHEN o_orderkey % 29 = 1 THEN condition ELSE subject_id || '_' || condition END AS session_id, 'train' AS split, slot, label_start_ms AS ls,
 label_start_ms + slot * 30000 AS s, base_score AS sc, condition, o_orderstatus FROM (SELECT *, {_place('o_orderkey')} FROM orders)""")


def v_pman(spark, d):
    rows = _placed(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), "o_orderkey")
    k = F.col("o_orderkey")
    hit = lambda n, r: k % n == r
    subject, condition = F.col("subject_id"), F.substring_index("session_id", "_", -1)
    session = F.when(hit(29, 1), condition).otherwise(F.col("session_id"))
    start, end = F.col("window_start_ms"), F.col("window_end_ms")
    pair = ids.pair_id(subject, session, start, end)
    digest = F.sha2(k.cast("string"), 256)
    children = F.array_join(ids.video_child_ids(session, start), "|")
    return rows.select(
        (k + 2).alias("row_no"), "subject_id", session.alias("session_id"), F.lit("train").alias("split"), (k % 8).cast("int").alias("window_index"),
        start.alias("window_start_ms"), end.alias("window_end_ms"), F.lit(30_000).alias("duration_ms"), "label_start_ms", "label_end_ms", "kss_score",
        ids.kss_label_class(F.col("kss_score")).alias("label_class"), ids.kss_label_id(F.col("kss_score")).alias("label_id"),
        (F.col("o_orderstatus") != "P").alias("paired_valid"), (~hit(31, 2)).alias("complete8_eligible"), F.when(hit(37, 3), "x").otherwise("").alias("exclude_reason"),
        F.lit("").alias("complete8_exclude_reason"), F.when(hit(41, 4), C.SYNC_MISMATCH).otherwise(C.SYNC_ALIGNED).alias("sync_status"), F.when(hit(43, 5), 7).otherwise(0).alias("offset_ms"),
        hit(47, 6).alias("hardware_clock_verified"), pair.alias("paired_sample_id"), F.when(hit(53, 7), "other").otherwise(pair).alias("can_sample_id"),
        F.when(hit(97, 9), "twice").otherwise(ids.video_window_id(session, start, end)).alias("video_sample_id"),
        ids.pair_id(subject, session, F.col("label_start_ms"), F.col("label_end_ms")).alias("parent_id"),
        F.when(hit(59, 8), "[6,95]").otherwise("[6,96]").alias("video_feature_shape"), F.lit("[300, 9]").alias("can_feature_shape"), F.lit("float32").alias("video_feature_dtype"),
        F.when(hit(61, 9), "float64").otherwise("float32").alias("can_feature_dtype"), F.lit("session_relative").alias("video_source_time_reference"),
        F.lit("subtract_window_start_ms_div_1000").alias("video_time_transform"), F.when(hit(67, 1), "a|a|b|c|d|e").otherwise(children).alias("video_subwindow_ids"),
        F.when(hit(71, 2), 0.9).otherwise(0.99).alias("can_valid_ratio"), F.lit("v.zip").alias("video_feature_archive"), F.when(hit(73, 3), "../f.npz").otherwise("f.npz").alias("can_feature_path"),
        F.lit("features_30s/a.npz").alias("video_feature_member"), digest.alias("video_feature_sha256"), F.when(hit(79, 4), "00").otherwise(digest).alias("can_feature_sha256"))


@query("validate_pairs", sql("v_pman", f"""
WITH e AS (SELECT CASE WHEN {sql_split('subject_id')} <> 'train' THEN 'subject_split' WHEN k % 29 = 1 THEN 'session_prefix' WHEN o_orderstatus = 'P' THEN 'paired_valid' WHEN k % 31 = 2 THEN 'complete8' WHEN k % 37 = 3 THEN 'reasons'
 WHEN k % 41 = 4 THEN 'sync_status' WHEN k % 43 = 5 THEN 'offset' WHEN k % 47 = 6 THEN 'hardware_clock' WHEN k % 53 = 7 THEN 'telemetry_id' WHEN k % 59 = 8 THEN 'video_shape' WHEN k % 61 = 9 THEN 'dtypes'
 WHEN k % 67 = 1 THEN 'children' WHEN k % 71 = 2 THEN 'valid_ratio' WHEN k % 73 = 3 THEN 'paths' WHEN k % 79 = 4 THEN 'sha256' END AS rule FROM v_pman
UNION ALL SELECT 'duplicate_can_sample_id' FROM (SELECT row_number() OVER (ORDER BY row_no) AS c FROM v_pman WHERE k % 53 = 7) WHERE c > 1
UNION ALL SELECT 'duplicate_paired_sample_id' FROM (SELECT row_number() OVER (PARTITION BY subject_id, session_id, s ORDER BY row_no) AS c FROM v_pman WHERE 1 = 0) WHERE c > 1
UNION ALL SELECT 'duplicate_video_sample_id' FROM (SELECT row_number() OVER (PARTITION BY v ORDER BY row_no) AS c FROM (SELECT row_no, CASE WHEN k % 97 = 9 THEN 'twice' ELSE session_id || '#' || s END AS v FROM v_pman)) WHERE c > 1)
SELECT rule, count(*) AS n FROM e WHERE rule IS NOT NULL GROUP BY rule"""))
def validate_pairs(spark, d):
    return V.validate_pairs(v_pman(spark, d), "train").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("validate_pair_parents", """
WITH p AS (SELECT l_orderkey, list_sort(list(l_linenumber - 1)) = range(2) AS whole, count(DISTINCT l_returnflag) AS labels, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1)
SELECT code, count(*) AS n FROM (SELECT CASE WHEN NOT whole THEN 'window_indices' WHEN labels > 1 THEN 'labels' WHEN owners > 1 THEN 'subject_or_session' END AS code FROM p) WHERE code IS NOT NULL GROUP BY code""")
def validate_pair_parents(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey").select(
        F.col("l_orderkey").alias("parent_id"), (F.col("l_linenumber") - 1).alias("window_index"), F.col("l_returnflag").alias("label_id"),
        F.col("l_suppkey").alias("subject_id"), F.col("l_suppkey").alias("session_id"))
    return V.validate_pair_parents(rows, 2).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# -- V10, V12, V13 ---------------------------------------------------------------------------------

@query("validate_request", f"""
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 31 = 1 THEN 'a b' WHEN o_orderkey % 37 = 2 THEN 'twice' ELSE 'r-' || o_orderkey END AS sample_id, ({SQL_LETTERS})[o_custkey % 16 + 1] AS su FROM orders),
e AS (SELECT CASE WHEN sample_id = 'a b' THEN 'sample_id' WHEN su NOT IN ('C', 'H', 'P') THEN 'subject' WHEN k % 41 = 3 THEN 'subject_session' WHEN k % 43 = 4 THEN 'interval' WHEN k % 47 = 5 THEN 'source_path' WHEN k % 53 = 6 THEN 'time_reference' END AS rule FROM r
 UNION ALL SELECT 'duplicate_sample_id' FROM r GROUP BY sample_id HAVING count(*) > 1)
SELECT rule, count(*) AS n FROM e WHERE rule IS NOT NULL GROUP BY rule""")
def validate_request(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("subject_id", letter(F.col("o_custkey"))).select(
        F.when(k % 31 == 1, "a b").when(k % 37 == 2, "twice").otherwise(F.concat(F.lit("r-"), k)).alias("sample_id"), "subject_id",
        F.when(k % 41 == 3, "X_A").otherwise(F.concat("subject_id", F.lit("_A"))).alias("session_id"), (k * 30_000).alias("window_start_ms"),
        (k * 30_000 + F.when(k % 43 == 4, 29_999).otherwise(30_000)).alias("window_end_ms"), F.when(k % 47 == 5, "../x").otherwise("f/x.npz").alias("source_feature"),
        F.when(k % 53 == 6, "epoch").otherwise("session_relative").alias("source_time_reference"))
    errors = V.validate_request(V.require_request_columns(rows))
    return errors.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("telemetry_feature_codes", sql("v_tok", """
SELECT label, count(*) AS n, count(*) FILTER (WHERE label = 9) AS missing_can_feature, count(*) FILTER (WHERE label = 2) AS can_feature_hash_mismatch, count(*) FILTER (WHERE label <> 9) AS can_x_shape_dtype,
 count(*) FILTER (WHERE label <> 9 AND far) AS can_time_not_sample_relative FROM (SELECT vec_id, label, max(e) * 3 > 30 AS far FROM v_tok GROUP BY ALL) GROUP BY label"""))
def telemetry_feature_codes(spark, d):
    rows = v_bundles(spark, d).join(v_tok(spark, d).select(F.concat(F.lit("f/"), "vec_id", F.lit(".npz")).alias("feature_path"), "label"), "feature_path")
    label = F.col("label")
    codes = rows.select("label", V.telemetry_feature_codes(label != 9, F.lit("h"), F.when(label == 2, "g").otherwise("h")).alias("c"))
    names = ("missing_can_feature", "can_feature_hash_mismatch", "can_x_shape_dtype", "can_time_not_sample_relative")
    return codes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("c", n)).alias(n) for n in names])


@query("validate_package", sql("v_tok", f"""
WITH b AS (SELECT vec_id, label FROM v_tok GROUP BY ALL), r AS (SELECT o_orderkey AS k, o_custkey AS c, 'r-' || o_orderkey // 2 AS sample_id, ({SQL_LETTERS})[o_custkey % 16 + 1] AS su, label FROM orders LEFT JOIN b ON vec_id = o_custkey),
e AS (SELECT CASE WHEN su NOT IN ('C', 'H', 'P') THEN 'subject' WHEN label IS NULL THEN 'missing_feature' WHEN k % 5 = 0 THEN 'feature_hash' ELSE 'expected_shape' END AS rule FROM r
 UNION ALL SELECT 'duplicate_sample_id' FROM r GROUP BY sample_id HAVING count(*) > 1)
SELECT rule, count(*) AS n FROM e GROUP BY rule"""))
def validate_package(spark, d):
    """An index over bundles of another shape: every hash that agrees leads to the shape rule."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    index = table(spark, d, "orders", "o_orderkey", "o_custkey").select(
        F.concat(F.lit("r-"), F.call_function("div", k, F.lit(2))).alias("sample_id"), letter(c).alias("subject_id"), F.concat(F.lit("f/"), c, F.lit(".npz")).alias("feature_path"),
        F.when(k % 5 == 0, "old").otherwise("h").alias("feature_sha256"), F.lit("[6,96]").alias("feature_shape"), F.lit("float32").alias("feature_dtype"))
    errors = V.validate_package(index, v_bundles(spark, d).withColumn("actual_sha256", F.lit("h")))
    return errors.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
