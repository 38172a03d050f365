"""Pairs, checks between two tables, cohorts, inventories and bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids
from tidegrid.operators import clips, coverage, grid, intervals, jobs, pairing
from tidegrid.session import stage
from workload.registry import query, rounded, sql, table, view
from workload.views import (
    SYNC_TOLERANCE_MS, v_clip, v_clips_of_session, v_files, v_recorded, v_sessions, v_tele, v_video,
)

# -- J1-J4, T20 -------------------------------------------------------------------

view("v_sync", f"""
SELECT s.subject_id, s.session_id, source_rows, coalesce(n, 0) AS video_files, CASE WHEN n = 1 THEN dur END AS video_duration_s,
  CASE WHEN n = 1 THEN source_rows / 60.0::DOUBLE END AS telemetry_nominal_duration_s,
  CASE WHEN n = 1 THEN (dur - source_rows / 60.0::DOUBLE) * 1000 END AS duration_difference_ms,
  CASE WHEN n = 1 AND abs((dur - source_rows / 60.0::DOUBLE) * 1000) <= {SYNC_TOLERANCE_MS} THEN 0::BIGINT END AS offset_ms,
  CASE WHEN n IS DISTINCT FROM 1 THEN 'unverified_missing_unique_ir_video'
    WHEN abs((dur - source_rows / 60.0::DOUBLE) * 1000) <= {SYNC_TOLERANCE_MS} THEN 'provider_documented_aligned' ELSE 'unverified_duration_mismatch' END AS sync_status
FROM v_sessions s LEFT JOIN (SELECT subject_id, session_id, count(*) AS n, max(video_duration_s) AS dur FROM v_clips_of_session GROUP BY ALL) USING (subject_id, session_id)
""", "v_sessions", "v_clips_of_session")


def sync(spark, d):
    return intervals.sync_audit(v_sessions(spark, d), v_clips_of_session(spark, d), ["subject_id", "session_id"], SYNC_TOLERANCE_MS)


@query("sync_audit", sql("v_sync", """SELECT * REPLACE (round(video_duration_s, 6) AS video_duration_s,
 round(telemetry_nominal_duration_s, 6) AS telemetry_nominal_duration_s, round(duration_difference_ms, 6) AS duration_difference_ms) FROM v_sync"""))
def sync_audit(spark, d):
    return rounded(sync(spark, d))


view("v_pair", """
SELECT *, len(codes) = 0 AS paired_valid, array_to_string(codes, ';') AS exclude_reason FROM (
SELECT v.*, printf('ULDD_%s_%s_%09d_%09d', v.subject_id, right(v.session_id, 1), v.window_start_ms, v.window_end_ms) AS paired_sample_id,
  t.sample_id AS t_sample_id, CASE WHEN t.k IS NULL THEN 'not_applicable_missing_can' ELSE coalesce(s.sync_status, 'not_applicable_missing_can') END AS sync_status,
  list_sort(list_filter([CASE WHEN NOT v.valid THEN 'video_invalid' END, CASE WHEN t.k IS NULL THEN 'can_missing_or_invalid' END,
   CASE WHEN NOT t.valid THEN 'can_invalid' END, CASE WHEN t.split <> v.split THEN 'label_mismatch_split' END,
   CASE WHEN t.label_start_ms <> v.label_start_ms THEN 'label_mismatch_label_start_ms' END, CASE WHEN t.label_end_ms <> v.label_end_ms THEN 'label_mismatch_label_end_ms' END,
   CASE WHEN t.kss_score <> v.kss_score THEN 'label_mismatch_kss_score' END, CASE WHEN t.label_class <> v.label_class THEN 'label_mismatch_label_class' END,
   CASE WHEN t.label_id <> v.label_id THEN 'label_mismatch_label_id' END,
   CASE WHEN t.k IS NOT NULL AND s.sync_status IS DISTINCT FROM 'provider_documented_aligned' THEN 'sync_unverified' END], lambda x: x IS NOT NULL)) AS codes
FROM v_video v LEFT JOIN v_tele t ON t.subject_id = v.subject_id AND t.session_id = v.session_id AND t.window_start_ms = v.window_start_ms AND t.window_end_ms = v.window_end_ms
LEFT JOIN v_sync s ON s.subject_id = v.subject_id AND s.session_id = v.session_id)""", "v_video", "v_tele", "v_sync")


def paired(spark, d):
    return pairing.pair_modalities(v_video(spark, d), v_tele(spark, d), sync(spark, d))


@query("pair_left", sql("v_pair", "SELECT paired_sample_id, sample_id, t_sample_id, sync_status, exclude_reason, paired_valid FROM v_pair"))
def pair_left(spark, d):
    return paired(spark, d).select("paired_sample_id", "sample_id", "t_sample_id", "sync_status", "exclude_reason", "paired_valid")


@query("pair_reason_counts", sql("v_pair", "SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM v_pair) GROUP BY code"))
def pair_reason_counts(spark, d):
    return coverage.reason_counts(paired(spark, d), "exclude_codes")


@query("pair_sync", sql("v_video v_sync", """
SELECT sample_id, sync_status, coalesce(sync_status = 'provider_documented_aligned', false) AS sync_ok FROM v_video LEFT JOIN v_sync USING (subject_id, session_id)"""))
def pair_sync(spark, d):
    return pairing.attach_sync_status(v_video(spark, d), sync(spark, d)).select("sample_id", "sync_status", "sync_ok")


@query("label_agreement", sql("v_video v_tele", """
SELECT array_to_string(list_filter([CASE WHEN t.split <> v.split THEN 'split' END, CASE WHEN t.kss_score <> v.kss_score THEN 'kss_score' END,
  CASE WHEN t.label_class <> v.label_class THEN 'label_class' END, CASE WHEN t.label_id <> v.label_id THEN 'label_id' END], lambda x: x IS NOT NULL), ';') AS fields, count(*) AS n
FROM v_video v JOIN v_tele t USING (k) GROUP BY 1"""))
def label_agreement(spark, d):
    joined = v_video(spark, d).join(pairing.prefixed(v_tele(spark, d), "t_"), F.col("k") == F.col("t_k"))
    fields = pairing.mismatched_fields({f: F.col(f) for f in C.PAIR_LABEL_FIELDS}, {f: F.col(f"t_{f}") for f in C.PAIR_LABEL_FIELDS})
    return joined.groupBy(F.array_join(fields, ";").alias("fields")).agg(F.count(F.lit(1)).alias("n"))


@query("pair_anti", sql("v_video v_tele", """
SELECT v.sample_id, v.split FROM v_video v WHERE NOT EXISTS (SELECT 1 FROM v_tele t WHERE t.subject_id = v.subject_id AND t.session_id = v.session_id
 AND t.window_start_ms = v.window_start_ms AND t.window_end_ms = v.window_end_ms)"""))
def pair_anti(spark, d):
    return pairing.unmatched_right(v_video(spark, d), v_tele(spark, d), list(C.PAIR_KEY)).select("sample_id", "split")


# -- J5, J6 -------------------------------------------------------------------------

view("v_meta_left", """
SELECT o_orderkey AS row_no, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '' ELSE 'C' || o_custkey || '-' || year(o_orderdate) END AS sample_id,
  CAST(o_custkey % 6 AS VARCHAR) AS label_id, 'class ' || o_custkey % 6 AS label_class, 'scheme' AS label_scheme, 'train' AS split, 'P' || o_custkey AS subject_id,
  CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'S' || o_custkey END AS session_id, 'raw/C' || o_custkey || '-' || year(o_orderdate) || '.wav' AS source_file FROM orders""")
view("v_meta_right", """
SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 AS row_no, 'C' || c || '-' || year(l_shipdate) AS sample_id, CAST((c + CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END) % 6 AS VARCHAR) AS label_id,
  'class ' || c % 6 AS label_class, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'scheme' END AS label_scheme, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'val' END AS split,
  'P' || c AS subject_id, CASE WHEN c % 7 = 0 THEN 'T' ELSE 'S' END || c AS session_id,
  CASE WHEN l_returnflag = 'N' THEN '["raw\\\\C' || c || '-' || year(l_shipdate) || '.wav", "raw/x.wav"]' WHEN l_returnflag = 'A' THEN 'raw/C' || c || '-' || year(l_shipdate) || '.mp4' ELSE '' END AS source_file
FROM (SELECT *, l_partkey % 1500 AS c FROM lineitem)""")


def v_meta_left(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    c = F.col("o_custkey")
    name = F.concat(F.lit("C"), c, F.lit("-"), F.year("o_orderdate"))
    blank = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    return rows.select(
        F.col("o_orderkey").alias("row_no"), F.when(blank, "").otherwise(name).alias("sample_id"), (c % 6).cast("string").alias("label_id"),
        F.concat(F.lit("class "), c % 6).alias("label_class"), F.lit("scheme").alias("label_scheme"), F.lit("train").alias("split"),
        F.concat(F.lit("P"), c).alias("subject_id"), F.when(c % 5 == 0, "").otherwise(F.concat(F.lit("S"), c)).alias("session_id"),
        F.concat(F.lit("raw/"), name, F.lit(".wav")).alias("source_file"))


def v_meta_right(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    c = F.col("l_partkey") % 1500
    name = F.concat(F.lit("C"), c, F.lit("-"), F.year("l_shipdate"))
    source = (
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit('["raw\\\\'), name, F.lit('.wav", "raw/x.wav"]')))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("raw/"), name, F.lit(".mp4"))).otherwise(""))
    return rows.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") % 1_000_000).alias("row_no"), name.alias("sample_id"),
        ((c + F.when(F.col("l_quantity") > 48, 1).otherwise(0)) % 6).cast("string").alias("label_id"),
        F.concat(F.lit("class "), c % 6).alias("label_class"), F.when(F.col("l_returnflag") == "R", "").otherwise("scheme").alias("label_scheme"),
        F.when(F.col("l_linestatus") == "F", "train").otherwise("val").alias("split"), F.concat(F.lit("P"), c).alias("subject_id"),
        F.concat(F.when(c % 7 == 0, "T").otherwise("S"), c).alias("session_id"), source.alias("source_file"))


def _check_sql(strict: bool, head: str) -> str:
    order = "row_no" if strict else "row_no DESC"
    pick = f"QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY {order}) = 1"
    side = f"SELECT *, count(*) OVER (PARTITION BY sample_id) AS copies FROM {{0}} WHERE sample_id <> '' {pick}"
    stems = r"""list_transform(CASE WHEN starts_with({0}, '[') THEN CAST(from_json({0}, '["VARCHAR"]') AS VARCHAR[]) WHEN {0} = '' THEN [] ELSE [{0}] END, lambda v: regexp_replace(regexp_extract(replace(v, '\', '/'), '([^/]*)\z', 1), '\.[^.]*\z', ''))"""
    both = "a.sample_id IS NOT NULL AND b.sample_id IS NOT NULL"
    sets = "list_sort(list_distinct(sa)) <> list_sort(list_distinct(sb))"
    if strict:
        rest = f"""CASE WHEN bo AND (a_scheme = '' OR a_scheme <> b_scheme) THEN 'label_scheme_mismatch' END,
 CASE WHEN bo AND (a_subject = '' OR a_subject <> b_subject OR a_split <> b_split) THEN 'split_mismatch' END,
 CASE WHEN bo AND (a_session = '' OR a_session <> b_session) THEN 'session_mismatch' END,
 CASE WHEN bo AND (len(sa) = 0 OR len(sb) = 0 OR {sets} OR NOT list_contains(sa, sample_id) OR NOT list_contains(sb, sample_id)) THEN 'source_mismatch' END"""
    else:
        rest = f"""CASE WHEN bo AND (a_subject <> b_subject OR a_split <> b_split) THEN 'split_mismatch' END,
 CASE WHEN bo AND a_session <> '' AND b_session <> '' AND a_session <> b_session THEN 'session_mismatch' END,
 CASE WHEN bo AND len(sa) > 0 AND len(sb) > 0 AND ({sets} OR NOT list_contains(sa, sample_id)) THEN 'source_mismatch' END"""
    return sql("v_meta_left v_meta_right", f"""
WITH a AS ({side.format('v_meta_left')}), b AS ({side.format('v_meta_right')}),
j AS (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, {both} AS bo, a.sample_id IS NULL AS na, b.sample_id IS NULL AS nb, a.copies AS ca, b.copies AS cb,
 a.label_id AS ali, b.label_id AS bli, a.label_class AS alc, b.label_class AS blc, a.label_scheme AS a_scheme, b.label_scheme AS b_scheme, a.split AS a_split, b.split AS b_split,
 a.subject_id AS a_subject, b.subject_id AS b_subject, a.session_id AS a_session, b.session_id AS b_session,
 {stems.format("coalesce(a.source_file, '')")} AS sa, {stems.format("coalesce(b.source_file, '')")} AS sb FROM a FULL JOIN b ON a.sample_id = b.sample_id),
r AS (SELECT sample_id, bo AS common, list_filter([CASE WHEN nb THEN 'only_left' END, CASE WHEN na THEN 'only_right' END, CASE WHEN ca > 1 THEN 'duplicate_left' END,
 CASE WHEN cb > 1 THEN 'duplicate_right' END, CASE WHEN bo AND (ali <> bli OR alc <> blc) THEN 'label_mismatch' END, {rest}], lambda x: x IS NOT NULL) AS codes FROM j)
{head}""")


_ROWS = "SELECT sample_id, common, array_to_string(codes, ';') AS codes FROM r"


def _report_sql(strict: bool) -> str:
    names = [c for c in pairing._CHECK_CODES if strict or c != "label_scheme_mismatch"]
    counts = ", ".join(f"count(*) FILTER (WHERE list_contains(codes, '{c}')) AS {c}_count" for c in names)
    total = " + ".join(f"{c}_count" for c in names)
    return f"""SELECT *, CASE WHEN left_empty_ids + right_empty_ids + {total} = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
SELECT count(*) FILTER (WHERE common) AS common_samples, {counts}, (SELECT count(*) FROM v_meta_left) AS left_rows, (SELECT count(*) FROM v_meta_left WHERE sample_id = '') AS left_empty_ids,
 (SELECT count(*) FROM v_meta_right) AS right_rows, (SELECT count(*) FROM v_meta_right WHERE sample_id = '') AS right_empty_ids FROM r)"""


@query("pair_check_strict_rows", _check_sql(True, _ROWS))
def pair_check_strict_rows(spark, d):
    return pairing.pair_check_rows(v_meta_left(spark, d), v_meta_right(spark, d)).withColumn("codes", F.array_join("codes", ";"))


@query("pair_check_strict", _check_sql(True, _report_sql(True)))
def pair_check_strict(spark, d):
    return pairing.pair_check_report(v_meta_left(spark, d), v_meta_right(spark, d))


@query("pair_check_lenient_rows", _check_sql(False, _ROWS))
def pair_check_lenient_rows(spark, d):
    return pairing.pair_check_rows(v_meta_left(spark, d), v_meta_right(spark, d), strict=False).withColumn("codes", F.array_join("codes", ";"))


@query("pair_check_lenient", _check_sql(False, _report_sql(False)))
def pair_check_lenient(spark, d):
    return pairing.pair_check_report(v_meta_left(spark, d), v_meta_right(spark, d), strict=False)


# -- J7 ------------------------------------------------------------------------------

_COHORT = ("subject_id", "session_id", "window_start_ms", "window_end_ms", "duration_ms", "label_start_ms", "label_end_ms", "label_class", "label_id", "kss_score")


@query("cohort_equivalence", sql("v_video v_tele", """
WITH w AS (SELECT v.* EXCLUDE (sample_id), printf('ULDD_%s_%09d_%09d', session_id, window_start_ms, window_end_ms) AS sample_id,
  printf('ULDD_%s_%09d_%09d', session_id, label_start_ms, label_end_ms) AS parent_id, 0.98::DOUBLE AS valid_ratio FROM v_video v),
par AS (SELECT parent_id, split FROM w GROUP BY ALL HAVING list_sort(list((window_start_ms - label_start_ms) // 30000)) = range(8) AND bool_and(valid)),
a AS (SELECT * FROM w SEMI JOIN par USING (parent_id)), b AS (SELECT *, CASE WHEN lines = 1 THEN 0.97 ELSE 0.98 END::DOUBLE AS valid_ratio FROM v_tele),
j AS (SELECT coalesce(a.split, b.split) AS split, a.k IS NULL AS only_pair, b.k IS NULL AS only_window,
  a.k IS NOT NULL AND b.k IS NOT NULL AND (a.kss_score <> b.kss_score OR a.label_id <> b.label_id OR a.label_class <> b.label_class OR a.session_id <> b.session_id) AS im,
  a.k IS NOT NULL AND b.k IS NOT NULL AND abs(a.valid_ratio - b.valid_ratio) > 1e-6 AS fm FROM a FULL JOIN b ON a.split = b.split AND a.sample_id = b.sample_id),
c AS (SELECT split, count(*) FILTER (WHERE NOT only_pair) AS effective_windows, count(*) FILTER (WHERE NOT only_window) AS paired_windows,
  count(*) FILTER (WHERE only_window OR only_pair) AS sample_id_difference_count, count(*) FILTER (WHERE im) AS identity_mismatch_count, count(*) FILTER (WHERE fm) AS feature_mismatch_count FROM j GROUP BY split),
p AS (SELECT split, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS parent_id_difference_count FROM (SELECT split, parent_id, 1 AS x FROM par) FULL JOIN (SELECT DISTINCT split, parent_id, 1 AS y FROM v_tele) USING (split, parent_id) GROUP BY split)
SELECT * FROM c JOIN p USING (split)"""))
def cohort_equivalence(spark, d):
    windows = v_video(spark, d).withColumn("sample_id", ids.window_id(F.col("session_id"), F.col("window_start_ms"), F.col("window_end_ms")))
    windows = windows.withColumn("parent_id", ids.window_id(F.col("session_id"), F.col("label_start_ms"), F.col("label_end_ms"))).withColumns({
        "window_index": ((F.col("window_start_ms") - F.col("label_start_ms")) / 30_000).cast("int"), "valid_ratio": F.lit(0.98),
        "qc_reason_codes": F.array().cast("array<string>")})
    parents = grid.parent_manifest(windows, order="window_start_ms")
    pairs = v_tele(spark, d).withColumn("valid_ratio", F.when(F.col("lines") == 1, 0.97).otherwise(0.98))
    return pairing.cohort_equivalence(windows, parents, pairs, _COHORT, ["valid_ratio"])


# -- J14-J16, J11 ------------------------------------------------------------------------

@query("inventory_diff", sql("v_files v_recorded", """
WITH r AS (SELECT path, count(*) AS n, min(size_bytes) AS s1, max(size_bytes) AS s2, min(sha256) AS h1, max(sha256) AS h2 FROM v_recorded GROUP BY path),
j AS (SELECT path, list_filter([CASE WHEN n > 1 THEN 'duplicate_record' END, CASE WHEN f.size_bytes IS NULL THEN 'missing_file' END, CASE WHEN n IS NULL THEN 'unrecorded_file' END,
  CASE WHEN s1 <> f.size_bytes OR s2 <> f.size_bytes THEN 'size_mismatch' END, CASE WHEN h1 <> f.sha256 OR h2 <> f.sha256 THEN 'hash_mismatch' END], lambda x: x IS NOT NULL) AS codes
 FROM r FULL JOIN v_files f USING (path))
SELECT path, array_to_string(codes, ';') AS codes FROM j WHERE len(codes) > 0"""))
def inventory_diff(spark, d):
    return pairing.inventory_diff(v_recorded(spark, d), v_files(spark, d)).withColumn("codes", F.array_join("codes", ";"))


@query("id_set_equal", """
SELECT count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right, count(*) FILTER (WHERE a > 1) AS duplicate_left,
 count(*) FILTER (WHERE b > 1) AS duplicate_right, count(*) FILTER (WHERE a IS NULL OR b IS NULL) = 0 AS equal
FROM (SELECT o_orderkey AS id, count(*) AS a FROM orders GROUP BY 1) FULL JOIN (SELECT l_orderkey AS id, count(*) AS b FROM lineitem GROUP BY 1) USING (id)""")
def id_set_equal(spark, d):
    left = table(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "id")
    right = table(spark, d, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "id")
    return pairing.id_set_difference(left, right, "id")


@query("label_source_agreement", """
WITH a AS (SELECT o_custkey AS session_id, year(o_orderdate) AS label_index, max(o_totalprice) AS a FROM orders GROUP BY ALL),
b AS (SELECT l_partkey AS session_id, year(l_shipdate) AS label_index, max(l_quantity) AS b FROM lineitem GROUP BY ALL),
j AS (SELECT session_id, count(a) AS sheet_scores, count(b) AS file_scores, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS differing FROM a FULL JOIN b USING (session_id, label_index) GROUP BY session_id)
SELECT *, CASE WHEN file_scores = 0 THEN 'missing' WHEN differing > 0 THEN 'differs' ELSE '' END AS code FROM j WHERE sheet_scores > 0""")
def label_source_agreement(spark, d):
    sheet = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").groupBy(
        F.col("o_custkey").alias("session_id"), F.year("o_orderdate").alias("label_index")).agg(F.max("o_totalprice").alias("kss_score"))
    files = table(spark, d, "lineitem", "l_partkey", "l_shipdate", "l_quantity").groupBy(
        F.col("l_partkey").alias("session_id"), F.year("l_shipdate").alias("label_index")).agg(F.max("l_quantity").alias("kss_score"))
    return pairing.label_source_agreement(sheet, files)


@query("assign_split", """
SELECT event_id, user_id AS subject_id, coalesce(CASE WHEN c_acctbal < 5000 THEN 'train' ELSE 'val' END, '') AS split FROM events LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON c_custkey = user_id""".replace("coalesce(CASE WHEN", "coalesce(CASE WHEN c_custkey IS NULL THEN NULL WHEN"))
def assign_split(spark, d):
    rows = table(spark, d, "events", "event_id", "user_id").withColumnRenamed("user_id", "subject_id")
    splits = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment").where("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").alias("subject_id"), F.when(F.col("c_acctbal") < 5000, "train").otherwise("val").alias("split"))
    return pairing.assign_split(rows, splits).select("event_id", "subject_id", "split")


# -- J9, J10: feature state of clips ---------------------------------------------------------

view("v_six", r"""
SELECT k, stem AS sample_id, CAST(left(stem, 2) AS INT) AS task, error, user_id AS u FROM (
 SELECT event_id AS k, user_id, lpad(CAST(event_id % 10 AS VARCHAR), 2, '0') || '_clip_' || event_id AS stem,
  CASE WHEN event_type = 'error' THEN 'EMPTY_AUDIO' WHEN event_type = 'click' THEN '' ELSE 'NO_FEATURES_YET' END AS error FROM events) WHERE left(stem, 2) IN ('01','03','04','05','07','08')""")
view("v_index", "SELECT sample_id, 'f/' || u || '-' || k % 3 || '.npz' AS path, CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM v_six WHERE u % 5 <> 0", "v_six")
view("v_facts", """
SELECT 'f/' || user_id || '-' || r || '.npz' AS path, CASE WHEN r = 1 AND user_id % 2 = 0 THEN 'fraction' ELSE '' END AS bundle_error,
 1.0::DOUBLE - (user_id % 12) / 100.0::DOUBLE AS coverage, '[5,2048]' AS shape, 'float32' AS dtype FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(2)) AS r)""")


def v_six(spark, d):
    k = F.col("event_id")
    stem = F.concat(F.lpad((k % 10).cast("string"), 2, "0"), F.lit("_clip_"), k)
    return table(spark, d, "events", "event_id", "user_id", "event_type").select(
        k.alias("k"), F.col("user_id").alias("u"), stem.alias("sample_id"),
        F.when(F.col("event_type") == "error", "EMPTY_AUDIO").when(F.col("event_type") == "click", "").otherwise(C.NO_FEATURES).alias("error"))


def v_index(spark, d):
    # sources whose number divides by five never delivered features
    return jobs._six_class(v_six(spark, d)).where("u % 5 <> 0").select(
        "sample_id", F.concat(F.lit("f/"), "u", F.lit("-"), F.col("k") % 3, F.lit(".npz")).alias("path"),
        F.when(F.col("k") % 7 == 0, "failed").otherwise("ok").alias("status"))


def v_facts(spark, d):
    users = table(spark, d, "events", "user_id").distinct().withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    return users.select(
        F.concat(F.lit("f/"), "user_id", F.lit("-"), "r", F.lit(".npz")).alias("path"),
        F.when((F.col("r") == 1) & (F.col("user_id") % 2 == 0), "fraction").otherwise("").alias("bundle_error"),
        (1.0 - (F.col("user_id") % 12) / 100.0).alias("coverage"), F.lit("[5,2048]").alias("shape"), F.lit("float32").alias("dtype"))


_LABEL6 = "CAST(list_position([1,3,4,5,7,8], task) - 1 AS INT) AS label_id"


@query("feature_status_strict", sql("v_six v_index v_facts", f"""
WITH j AS (SELECT s.*, i.path, i.status, f.bundle_error, f.coverage, f.shape, f.dtype FROM v_six s LEFT JOIN v_index i USING (sample_id) LEFT JOIN v_facts f USING (path)),
e AS (SELECT *, error AS e0, CASE WHEN error NOT IN ('', 'NO_FEATURES_YET') THEN error WHEN path IS NULL THEN 'NO_FEATURES_YET' WHEN status <> 'ok' THEN 'FEATURE_INDEX_NOT_OK'
 WHEN coalesce(bundle_error, 'missing') <> '' THEN 'FEATURE_FILE_INVALID' WHEN coverage < 0.95 THEN 'FEATURE_COVERAGE_BELOW_THRESHOLD' ELSE '' END AS e1 FROM j)
SELECT sample_id, {_LABEL6}, e1 AS error, e1 = '' AS valid, CASE WHEN e1 = '' THEN coverage ELSE 0 END AS valid_ratio, CASE WHEN e1 = '' THEN path || '::valid_mask' ELSE '' END AS mask,
 CASE WHEN e1 = '' THEN path ELSE '' END AS feature_path, CASE WHEN e1 = '' THEN shape ELSE '' END AS feature_shape, CASE WHEN e1 = '' THEN dtype ELSE '' END AS feature_dtype FROM e"""))
def feature_status_strict(spark, d):
    rows = clips.attach_features_strict(jobs._six_class(v_six(spark, d)), v_index(spark, d), v_facts(spark, d))
    return rows.select("sample_id", "label_id", "error", "valid", "valid_ratio", "mask", "feature_path", "feature_shape", "feature_dtype")


@query("feature_status_lenient", sql("v_six v_index v_facts", f"""
WITH j AS (SELECT s.*, i.path AS listed, coalesce(i.path, 'video_features_v1/' || s.sample_id || '.npz') AS path FROM v_six s LEFT JOIN v_index i USING (sample_id)),
f AS (SELECT j.*, CASE WHEN coverage IS NOT NULL THEN least(1.0, coverage) END AS c, shape, dtype FROM j LEFT JOIN v_facts USING (path))
SELECT sample_id, {_LABEL6}, CASE WHEN c IS NOT NULL THEN CASE WHEN c >= 0.95 THEN '' ELSE 'coverage_below_0.95' END WHEN listed IS NOT NULL THEN 'FEATURE_FILE_MISSING' ELSE 'NO_FEATURES_YET' END AS error,
 coalesce(c >= 0.95, false) AS valid, coalesce(c, 0) AS valid_ratio, CASE WHEN c IS NOT NULL THEN path || '::valid_mask' ELSE '' END AS mask,
 CASE WHEN c IS NOT NULL OR listed IS NOT NULL THEN path ELSE '' END AS feature_path, coalesce(shape, '') AS feature_shape, coalesce(dtype, '') AS feature_dtype FROM f"""))
def feature_status_lenient(spark, d):
    rows = clips.attach_features_lenient(jobs._six_class(v_six(spark, d)), v_index(spark, d), v_facts(spark, d))
    return rows.select("sample_id", "label_id", "error", "valid", "valid_ratio", "mask", "feature_path", "feature_shape", "feature_dtype")


@query("feature_index_problems", sql("v_six", """
WITH i AS (SELECT 'S' || u || '-' || k % 4 AS sample_id, CASE WHEN k % 9 = 0 THEN '/abs.npz' WHEN k % 8 = 0 THEN 'x.bin' ELSE 'x.npz' END AS path,
  CASE WHEN k % 11 = 0 THEN '' ELSE 'ok' END AS status, CASE WHEN k % 13 = 0 THEN 0 ELSE 5 END AS T, CASE WHEN k % 10 = 1 THEN NULL ELSE 4 END AS D FROM v_six)
SELECT code, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY sample_id) > 1 THEN 'duplicate' WHEN path = '/abs.npz' THEN 'path' WHEN path = 'x.bin' THEN 'suffix'
 WHEN status = '' THEN 'status' WHEN T < 1 THEN 'T' WHEN D < 1 THEN 'D' END AS code FROM i) WHERE code IS NOT NULL GROUP BY code"""))
def feature_index_problems(spark, d):
    k = F.col("k")
    index = jobs._six_class(v_six(spark, d)).select(
        F.concat(F.lit("S"), "u", F.lit("-"), k % 4).alias("sample_id"),
        F.when(k % 9 == 0, "/abs.npz").when(k % 8 == 0, "x.bin").otherwise("x.npz").alias("path"),
        F.when(k % 11 == 0, "").otherwise("ok").alias("status"), F.when(k % 13 == 0, 0).otherwise(5).alias("T"),
        F.when(k % 10 == 1, None).otherwise(4).alias("D"))
    return clips.index_problems(index).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# -- V11, A23, M3: clip quality -----------------------------------------------------------------

view("v_qc", """
SELECT *, CASE WHEN decode_error <> '' THEN [] ELSE list_filter([CASE WHEN samplerate <> 44100 THEN 'SAMPLE_RATE_DEVIATION' END, CASE WHEN channels <> 2 THEN 'CHANNELS_NOT_STEREO' END,
  CASE WHEN sample_width_bytes <> 2 THEN 'SAMPLE_WIDTH_NOT_16BIT' END, CASE WHEN nframes = 0 THEN 'EMPTY_AUDIO' END, CASE WHEN nframes > 0 AND sample_width_bytes = 2 AND nonzero_samples = 0 THEN 'ZERO_AUDIO' END,
  CASE WHEN nframes > 0 AND sample_width_bytes = 2 AND clipped_ratio > 1e-4 THEN 'POSSIBLE_CLIPPING' END, CASE WHEN m > 10.05 THEN 'LONGER_THAN_NOMINAL' END,
  CASE WHEN m < 10 AND sf <= 0.1 THEN 'MINOR_TAIL_SHORTFALL' END, CASE WHEN m < 10 AND sf > 0.1 THEN 'TAIL_SHORTFALL_EXCEEDS' END], lambda x: x IS NOT NULL) END AS flags FROM (
 SELECT *, CASE WHEN m > 0 THEN greatest(0, 10.0::DOUBLE - m) ELSE 10 END AS sf FROM (SELECT *, nframes / samplerate AS m FROM v_clip))""", "v_clip")
view("v_qcr", """
SELECT *, CASE WHEN decode_error <> '' THEN [decode_error] ELSE list_filter(flags, lambda f: f NOT IN ('POSSIBLE_CLIPPING', 'MINOR_TAIL_SHORTFALL')) END AS reason_codes,
 CASE WHEN decode_error = '' THEN round(m, 6) END AS measured_duration_s, CASE WHEN decode_error = '' THEN round(sf, 6) END AS tail_shortfall_s FROM v_qc""", "v_qc")
_STATUS = "CASE WHEN len(reason_codes) > 0 THEN 'pending' WHEN len(flags) > 0 THEN 'pass_with_flags' ELSE 'pass' END"


@query("clip_qc", sql("v_qcr", f"""
SELECT event_id, array_to_string(flags, ';') AS flags, array_to_string(reason_codes, ';') AS reason_codes, measured_duration_s, tail_shortfall_s,
 CASE WHEN decode_error = '' THEN round(least(m, 10) / 10, 6) END AS raw_observed_fraction, {_STATUS} AS qc_status, coalesce(reason_codes[1], '') AS primary_error FROM v_qcr"""))
def clip_qc(spark, d):
    return clips.clip_qc(v_clip(spark, d)).select(
        "event_id", F.array_join("flags", ";").alias("flags"), F.array_join("reason_codes", ";").alias("reason_codes"), "measured_duration_s",
        "tail_shortfall_s", "raw_observed_fraction", "qc_status", "primary_error")


view("v_named", rf"""
SELECT *, {_STATUS} AS qc_status, CASE WHEN ok THEN (['No task','Watching video','Playing game','Messaging','Phone call','Listening to radio','Reading','Eating','Chatting with passenger'])[CAST(task AS INT)] END AS label_class FROM (
 SELECT *, task BETWEEN '01' AND '09' AND regexp_full_match(subject, 'P(0[1-9]|[1-3][0-9]|40)') AS ok FROM (
  SELECT *, source_file[7:8] AS task, source_file[10:12] AS subject FROM v_qcr))""", "v_qcr")


@query("clip_metadata", sql("v_named", """
SELECT regexp_replace(source_file[7:], '\\.wav$', '') AS sample_id, subject AS subject_id, subject || '_' || source_file[14:21] || '_' || source_file[23:24] || source_file[26:27] || '_' || source_file[29:30] AS session_id,
 CAST(task AS INT) - 1 AS label_id, label_class, CASE WHEN coalesce(reason_codes[1], '') <> '' THEN reason_codes[1] ELSE 'NO_FEATURES_YET' END AS error, qc_status FROM v_named WHERE ok""".replace("\\\\", "\\")))
def clip_metadata(spark, d):
    rows, _ = jobs.build_clip_metadata(v_clip(spark, d))
    return rows.where("sample_id is not null").select("sample_id", "subject_id", "session_id", "label_id", "label_class", "error", "qc_status")


@query("clip_totals", sql("v_named", """
WITH o AS (SELECT * FROM v_named WHERE ok), x AS (SELECT measured_duration_s AS a, tail_shortfall_s AS b FROM o WHERE measured_duration_s IS NOT NULL)
SELECT 'files_total' AS metric, '' AS key, count(*)::DOUBLE AS value FROM v_named UNION ALL SELECT 'rows_total', '', count(*) FROM o UNION ALL SELECT 'unparsed_total', '', count(*) FROM v_named WHERE NOT ok
UNION ALL SELECT 'duration_count', '', count(*) FROM x UNION ALL SELECT 'duration_min_s', '', round(min(a), 6) FROM x UNION ALL SELECT 'duration_max_s', '', round(max(a), 6) FROM x
UNION ALL SELECT 'duration_mean_s', '', round(avg(a), 6) FROM x UNION ALL SELECT 'shortfall_count', '', count(*) FROM x UNION ALL SELECT 'shortfall_min_s', '', round(min(b), 6) FROM x
UNION ALL SELECT 'shortfall_max_s', '', round(max(b), 6) FROM x UNION ALL SELECT 'rows_by_class', label_class, count(*) FROM o GROUP BY label_class
UNION ALL SELECT 'rows_by_subject', subject, count(*) FROM o GROUP BY subject UNION ALL SELECT 'rows_by_qc_status', qc_status, count(*) FROM o GROUP BY qc_status
UNION ALL SELECT 'flag_counts', f, count(*) FROM (SELECT unnest(flags) AS f FROM o) GROUP BY f UNION ALL SELECT 'reason_counts', f, count(*) FROM (SELECT unnest(reason_codes) AS f FROM o) GROUP BY f"""))
def clip_totals(spark, d):
    _, totals = jobs.build_clip_metadata(v_clip(spark, d))
    return totals


# -- M4: six-class metadata --------------------------------------------------------------------------

view("v_audit6", """
SELECT regexp_replace(source_file[7:], '[.]wav$', '') AS sample_id, source_file, subject AS subject_id, subject || '_' || source_file[14:21] || '_' || source_file[23:24] || source_file[26:27] || '_' || source_file[29:30] AS session_id,
 CAST(task AS INT) AS task, CASE WHEN coalesce(reason_codes[1], '') <> '' THEN reason_codes[1] ELSE 'NO_FEATURES_YET' END AS error, event_id,
 'f/' || CAST(subject[2:] AS INT) || '-' || event_id % 3 || '.npz' AS path, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN CAST(subject[2:] AS INT) <= 24 THEN 'train' WHEN CAST(subject[2:] AS INT) <= 32 THEN 'val' ELSE 'test' END AS want
FROM v_named WHERE ok AND task IN ('01','03','04','05','07','08')""", "v_named")


def audit6(spark, d):
    """The audited clips as the audit job leaves them: a written table."""
    rows, _ = jobs.build_clip_metadata(v_clip(spark, d))
    return stage(rows.where("sample_id is not null"), "audit")


def index6(rows):
    number = F.substring("subject_id", 2, 2).cast("int")
    return rows.select(
        "sample_id", F.concat(F.lit("f/"), number, F.lit("-"), F.col("event_id") % 3, F.lit(".npz")).alias("path"),
        F.when(F.col("event_id") % 7 == 0, "failed").otherwise("ok").alias("status"))


def splits6(rows):
    number = F.substring("subject_id", 2, 2).cast("int")
    return rows.select("subject_id").distinct().withColumn(
        "split", F.when(number <= 24, "train").when(number <= 32, "val").otherwise("test"))


_SIX = ("sample_id", "subject_id", "session_id", "split", "source_file", "label_id", "label_class", "label_scheme", "valid", "valid_ratio", "feature_path", "error")
_SIX_SQL = """SELECT a.sample_id, subject_id, session_id, {split} AS split, '["' || source_file || '"]' AS source_file, CAST(list_position([1,3,4,5,7,8], task) - 1 AS INT) AS label_id,
 (['No task','Playing game','Messaging','Phone call','Reading','Eating'])[list_position([1,3,4,5,7,8], task)] AS label_class, 'dcpt_video_6c_v1' AS label_scheme, {state} FROM v_audit6 a LEFT JOIN v_facts f USING (path)"""
_STRICT = """CASE WHEN error <> 'NO_FEATURES_YET' THEN error WHEN status <> 'ok' THEN 'FEATURE_INDEX_NOT_OK' WHEN coalesce(bundle_error, 'missing') <> '' THEN 'FEATURE_FILE_INVALID' WHEN coverage < 0.95 THEN 'FEATURE_COVERAGE_BELOW_THRESHOLD' ELSE '' END"""


@query("build_audio_6c", sql("v_audit6 v_facts", _SIX_SQL.format(
    split="CASE WHEN want = 'test' THEN '' ELSE want END",
    state=f"({_STRICT}) = '' AS valid, CASE WHEN ({_STRICT}) = '' THEN coverage ELSE 0 END AS valid_ratio, CASE WHEN ({_STRICT}) = '' THEN path ELSE '' END AS feature_path, {_STRICT} AS error")))
def build_audio_6c(spark, d):
    rows = audit6(spark, d)
    # the test subjects are not in the map here, so they stay without a split
    known = splits6(rows).where("split <> 'test'")
    return jobs.build_audio_6c(rows, known, index6(rows), v_facts(spark, d)).select(*_SIX)


@query("build_video_6c", sql("v_audit6 v_facts", _SIX_SQL.format(
    split="want", state="""coalesce(coverage >= 0.95, false) AS valid, coalesce(coverage, 0) AS valid_ratio, path AS feature_path,
 CASE WHEN coverage IS NULL THEN 'FEATURE_FILE_MISSING' WHEN coverage < 0.95 THEN 'coverage_below_0.95' ELSE '' END AS error""")))
def build_video_6c(spark, d):
    rows = audit6(spark, d)
    return jobs.build_video_6c(rows, splits6(rows), index6(rows), v_facts(spark, d)).select(*_SIX)


# -- J12, J13: video windows, children, features ---------------------------------------------------

view("v_w30", """
SELECT *, list_aggregate(list_transform(range(6), lambda i: printf('video5__%s_IR_%013d_%013d', session_id, (window_start_ms + i * 5000) * 1000, (window_start_ms + i * 5000 + 5000) * 1000)), 'string_agg', '|') AS expected,
 CASE WHEN k % 50 = 3 THEN 'x|' ELSE '' END AS bad FROM v_video""", "v_video")
view("v_f30", """
SELECT k, sample_id, CASE WHEN k % 50 = 7 THEN 'features_30s/other.npz' ELSE 'features_30s/' || sample_id || '.npz' END AS relative_path,
 CASE WHEN k % 50 = 9 THEN '[6, 96]' ELSE '[6,96]' END AS feature_shape, 'h' || k AS feature_sha256, bad || expected AS video_subwindow_ids FROM v_w30 WHERE k % 50 <> 11""", "v_w30")
view("v_c5", """
SELECT k, i, printf('video5__%s_IR_%013d_%013d', session_id, (window_start_ms + i * 5000) * 1000, (window_start_ms + i * 5000 + 5000) * 1000) AS sample_id,
 CASE WHEN k % 50 = 13 AND i = 2 THEN 'val' ELSE split END AS split, kss_score + CASE WHEN k % 50 = 17 THEN 0.5 ELSE 0 END AS kss_score,
 window_start_ms + i * 5000 + CASE WHEN k % 50 = 19 AND i = 5 THEN 1 ELSE 0 END AS s, NOT (k % 50 = 21 AND i = 0) AS valid,
 'features_30s/' || w.sample_id || '.npz' AS feature_path, CASE WHEN k % 50 = 23 AND i = 1 THEN 'z' ELSE 'h' || k END AS feature_sha256
FROM v_w30 w, (SELECT CAST(unnest(range(6)) AS INT) AS i) WHERE NOT (k % 50 = 25 AND i = 4)""", "v_w30")


def v_w30(spark, d):
    k = F.col("k")
    expected = F.array_join(ids.video_child_ids(F.col("session_id"), F.col("window_start_ms")), "|")
    return v_video(spark, d).withColumn(
        "video_subwindow_ids", F.concat(F.when(k % 50 == 3, "x|").otherwise(""), expected))


def v_f30(spark, d):
    k = F.col("k")
    good = F.concat(F.lit("features_30s/"), "sample_id", F.lit(".npz"))
    # windows at slot 11 of fifty have no feature row
    return v_w30(spark, d).where("k % 50 <> 11").select(
        "sample_id", F.when(k % 50 == 7, "features_30s/other.npz").otherwise(good).alias("relative_path"),
        F.when(k % 50 == 9, "[6, 96]").otherwise("[6,96]").alias("feature_shape"), F.lit("float32").alias("feature_dtype"),
        F.concat(F.lit("h"), "k").alias("feature_sha256"), "video_subwindow_ids")


def v_c5(spark, d):
    k, i = F.col("k"), F.col("i")
    slot = k % 50
    rows = v_video(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).where("not (k % 50 = 25 and i = 4)")
    start = F.col("window_start_ms") + i * 5_000
    return rows.select(
        ids.video_child_id(F.col("session_id"), F.col("window_start_ms"), i).alias("sample_id"), "subject_id", "session_id",
        F.when((slot == 13) & (i == 2), "val").otherwise(F.col("split")).alias("split"),
        (start + F.when((slot == 19) & (i == 5), 1).otherwise(0)).alias("window_start_ms"), (start + 5_000).alias("window_end_ms"),
        "label_start_ms", "label_end_ms", (F.col("kss_score") + F.when(slot == 17, 0.5).otherwise(0.0)).alias("kss_score"),
        "label_class", "label_id", (~((slot == 21) & (i == 0))).alias("valid"),
        F.concat(F.lit("features_30s/"), F.col("sample_id"), F.lit(".npz")).alias("feature_path"),
        F.when((slot == 23) & (i == 1), "z").otherwise(F.concat(F.lit("h"), "k")).alias("feature_sha256"))


view("v_bound", """
SELECT sample_id, list_concat(own, flatten(list(child ORDER BY i))) AS codes FROM (
 SELECT w.sample_id, e.i, list_filter([CASE WHEN w.bad <> '' THEN 'source_5s_order_or_identity' END, CASE WHEN f.k IS NULL THEN 'source_feature_sample_id' END,
   CASE WHEN f.k IS NULL THEN 'source_feature_subwindow_ids' END,
   CASE WHEN f.k IS NULL OR f.relative_path <> 'features_30s/' || w.sample_id || '.npz' THEN 'source_feature_member' END,
   CASE WHEN f.k IS NULL OR f.feature_shape <> '[6,96]' THEN 'source_feature_shape_or_dtype' END], lambda x: x IS NOT NULL) AS own,
  list_filter([CASE WHEN c.k IS NULL THEN 'source_5s_missing_' || e.i END, CASE WHEN c.split <> w.split THEN 'source_5s_split_' || e.i END,
   CASE WHEN abs(c.kss_score - w.kss_score) > 1e-6 THEN 'source_5s_kss_score_' || e.i END,
   CASE WHEN c.s <> w.window_start_ms + e.i * 5000 THEN 'source_5s_time_' || e.i END, CASE WHEN NOT c.valid THEN 'source_5s_invalid_' || e.i END,
   CASE WHEN c.k IS NOT NULL AND (f.k IS NULL OR c.feature_path <> f.relative_path) THEN 'source_5s_feature_member_' || e.i END,
   CASE WHEN c.k IS NOT NULL AND (f.k IS NULL OR c.feature_sha256 <> f.feature_sha256) THEN 'source_5s_feature_hash_' || e.i END], lambda x: x IS NOT NULL) AS child
 FROM v_w30 w CROSS JOIN (SELECT CAST(unnest(range(6)) AS INT) AS i) e LEFT JOIN v_f30 f ON f.sample_id = w.sample_id LEFT JOIN v_c5 c ON c.k = w.k AND c.i = e.i)
GROUP BY sample_id, own""", "v_w30", "v_f30", "v_c5")


@query("child_binding", sql("v_bound", "SELECT sample_id, array_to_string(codes, ';') AS codes FROM v_bound"))
def child_binding(spark, d):
    return pairing.child_binding(v_w30(spark, d), v_f30(spark, d), v_c5(spark, d)).withColumn("codes", F.array_join("codes", ";"))


@query("pair_binding", sql("v_bound", """
SELECT printf('ULDD_%s_%s_%09d_%09d', w.subject_id, right(w.session_id, 1), w.window_start_ms, w.window_end_ms) AS paired_sample_id,
 array_to_string(list_concat(list_filter([CASE WHEN w.bad <> '' THEN 'pair_video_5s_order_or_identity' END], lambda x: x IS NOT NULL),
  CASE WHEN f.k IS NULL THEN ['pair_video_source_missing'] ELSE list_concat(list_filter([CASE WHEN w.k % 50 = 29 THEN 'pair_video_kss_score' END, CASE WHEN NOT w.valid THEN 'pair_video_source_invalid' END,
   CASE WHEN f.relative_path <> 'features_30s/' || w.sample_id || '.npz' THEN 'pair_video_feature_member' END, CASE WHEN f.feature_shape <> '[6,96]' THEN 'pair_video_feature_shape' END], lambda x: x IS NOT NULL), b.codes) END), ';') AS codes
FROM v_w30 w LEFT JOIN v_f30 f USING (sample_id) LEFT JOIN v_bound b USING (sample_id)"""))
def pair_binding(spark, d):
    windows = v_w30(spark, d)
    pairs = windows.select(
        ids.pair_id(F.col("subject_id"), F.col("session_id"), F.col("window_start_ms"), F.col("window_end_ms")).alias("paired_sample_id"),
        F.col("sample_id").alias("video_sample_id"), "subject_id", "session_id", "split", "window_start_ms", "window_end_ms", "label_start_ms", "label_end_ms",
        (F.col("kss_score") + F.when(F.col("k") % 50 == 29, 0.001).otherwise(0.0)).alias("kss_score"), "label_class", "label_id", "video_subwindow_ids",
        F.concat(F.lit("features_30s/"), "sample_id", F.lit(".npz")).alias("video_feature_member"), F.lit("[6,96]").alias("video_feature_shape"),
        F.lit("float32").alias("video_feature_dtype"), F.concat(F.lit("h"), "k").alias("video_feature_sha256"))
    return pairing.pair_binding(pairs, windows, v_f30(spark, d), v_c5(spark, d)).withColumn("codes", F.array_join("codes", ";"))


# -- M5 -----------------------------------------------------------------------------------------------

@query("build_pairs", sql("v_pair", """
SELECT complete8_exclude_reason, paired_valid, count(*) AS n FROM (
 SELECT paired_valid, CASE WHEN NOT paired_valid THEN 'pair_invalid'
  WHEN count(*) FILTER (WHERE paired_valid) OVER (PARTITION BY split, subject_id, session_id, label_start_ms) = 8 THEN '' ELSE 'incomplete_240s_parent' END AS complete8_exclude_reason FROM v_pair) GROUP BY ALL"""))
def build_pairs(spark, d):
    cohort = jobs.build_pairs(v_video(spark, d), v_tele(spark, d), v_sessions(spark, d), v_clips_of_session(spark, d), SYNC_TOLERANCE_MS, check=False)
    return cohort.pairs.groupBy("complete8_exclude_reason", "paired_valid").agg(F.count(F.lit(1)).alias("n"))


