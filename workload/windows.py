"""Grids, parents, orders, repeats and coverage over windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.operators import coverage, grid, jobs, ordering
from tidegrid.operators.metrics import majority_class
from tidegrid.operators.pairing import pair_modalities
from tidegrid.operators.pairing import union_splits as unite
from tidegrid.functions import ids
from tidegrid.plans.chunked import CHUNK_ROWS, cut, number_rows
from workload.registry import query, sql, table
from workload.views import SQL_LETTERS, WINDOW_H_MS, letter, sql_split, v_session_labels, v_tele, v_video, v_win

# -- T1, T16-T18 ------------------------------------------------------------------

@query("candidate_grid", sql("v_grid", """
SELECT session_id, subject_id, split, kss_score, label_id, label_class, window_index, label_index, label_start_ms, label_end_ms, window_start_ms, window_end_ms,
  printf('ULDD_%s_%09d_%09d', session_id, window_start_ms, window_end_ms) AS sample_id, printf('ULDD_%s_%09d_%09d', session_id, label_start_ms, label_end_ms) AS parent_id
FROM v_grid"""))
def candidate_grid(spark, d):
    return grid.candidate_grid(v_session_labels(spark, d), WINDOW_H_MS).drop("duration_ms")


@query("window_parent_rules", f"""
WITH w AS (SELECT o_orderkey % 8 AS i, o_orderkey, (o_orderkey % 8) * 30000 + CASE WHEN o_orderstatus = 'P' THEN 500 ELSE 0 END AS s,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 29000 ELSE 30000 END AS dur, CASE WHEN o_orderpriority = '2-HIGH' THEN 120000 ELSE 0 END AS p0, o_custkey FROM orders),
x AS (SELECT o_orderkey, list_filter([CASE WHEN dur <> 30000 THEN 'duration' END, CASE WHEN s < 0 OR s % 30000 <> 0 THEN 'off_grid' END,
  CASE WHEN p0 < 0 OR p0 % 240000 <> 0 THEN 'parent' END, CASE WHEN s < p0 OR s + dur > p0 + 240000 THEN 'outside_parent' END,
  CASE WHEN i <> CAST(trunc((s - p0) / 30000) AS BIGINT) THEN 'window_index' END], lambda v: v IS NOT NULL) AS codes FROM w)
SELECT array_to_string(codes, ';') AS codes, count(*) AS n FROM x GROUP BY 1""")
def window_parent_rules(spark, d):
    k = F.col("o_orderkey")
    start = (k % 8) * 30_000 + F.when(F.col("o_orderstatus") == "P", 500).otherwise(0)
    length = F.when(F.col("o_orderpriority") == "1-URGENT", 29_000).otherwise(30_000)
    first = F.when(F.col("o_orderpriority") == "2-HIGH", 120_000).otherwise(0)
    rows = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select(
        start.alias("window_start_ms"), (start + length).alias("window_end_ms"), length.alias("duration_ms"),
        first.alias("label_start_ms"), (first + 240_000).alias("label_end_ms"), (k % 8).alias("window_index"))
    return rows.groupBy(F.array_join(grid.window_rule_codes(), ";").alias("codes")).agg(F.count(F.lit(1)).alias("n"))


@query("stride_check", sql("v_tele", """
WITH s AS (SELECT DISTINCT subject_id, session_id, label_start_ms, window_start_ms AS w FROM v_tele),
l AS (SELECT *, w - lag(w) OVER (PARTITION BY subject_id, session_id, label_start_ms ORDER BY w) AS step FROM s)
SELECT subject_id, session_id, label_start_ms, count(*) AS distinct_starts, min(w) AS first_start, max(w) AS last_start, count(*) FILTER (WHERE step <> 30000) = 0 AS regular
FROM l GROUP BY ALL"""))
def stride_check(spark, d):
    return grid.stride_check(v_tele(spark, d), ["subject_id", "session_id", "label_start_ms"])


@query("full_grid", sql("v_video", """
SELECT session_id, count(*) AS window_count, list_sort(list(window_start_ms)) = range(0, 2400000, 30000) AS full_grid FROM v_video GROUP BY session_id"""))
def full_grid(spark, d):
    return grid.full_grid_check(v_video(spark, d), ["session_id"])


# -- A1, A2, A24, J8, J17 -------------------------------------------------------------

@query("parent_manifest", sql("v_win", """
SELECT parent_id, subject_id, session_id, split, label_start_ms, label_end_ms, kss_score, label_class, label_id, count(*) AS window_count,
  count(*) FILTER (WHERE valid) AS valid_window_count,
  list_sort(list(window_index)) = [0,1,2,3,4,5,6,7] AND count(*) FILTER (WHERE valid) = 8 AS complete_for_240s,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(qc_reason_codes)))), ';'), '') AS qc_reason_codes FROM v_win GROUP BY ALL"""))
def parent_manifest(spark, d):
    return grid.parent_manifest(v_win(spark, d), known=C.WINDOW_REASONS).withColumn("qc_reason_codes", F.array_join("qc_reason_codes", ";"))


_PAIRED = """
paired AS (SELECT v.*, printf('ULDD_%s_%s_%09d_%09d', v.subject_id, right(v.session_id, 1), v.window_start_ms, v.window_end_ms) AS paired_sample_id,
  v.valid AND t.k IS NOT NULL AND t.valid AND t.kss_score = v.kss_score AND t.split = v.split AS paired_valid FROM v_video v LEFT JOIN v_tele t USING (k)),
par AS (SELECT split, subject_id, session_id, label_start_ms, label_end_ms, min(kss_score) AS kss_score, min(label_class) AS label_class, min(label_id) AS label_id,
   printf('ULDD_%s_%s_%09d_%09d', subject_id, right(session_id, 1), label_start_ms, label_end_ms) AS parent_id,
   string_agg(paired_sample_id, '|' ORDER BY window_start_ms) AS paired_sample_ids, count(*) AS window_count
  FROM paired WHERE paired_valid GROUP BY split, subject_id, session_id, label_start_ms, label_end_ms
  HAVING list_sort(list(window_start_ms)) = [label_start_ms + i * 30000 for i in range(8)] AND count(DISTINCT kss_score) = 1)"""


def pairs(spark, d):
    return pair_modalities(v_video(spark, d), v_tele(spark, d))


@query("complete_parents", sql("v_video v_tele", f"WITH {_PAIRED} SELECT * FROM par"))
def complete_parents(spark, d):
    return grid.complete_parents(pairs(spark, d)).withColumn("paired_sample_ids", F.array_join("paired_sample_ids", "|"))


@query("complete8_eligibility", sql("v_video v_tele", f"""WITH {_PAIRED}
SELECT p.paired_sample_id, CASE WHEN p.paired_valid AND par.parent_id IS NOT NULL THEN par.parent_id ELSE '' END AS parent_id,
  p.paired_valid AND par.parent_id IS NOT NULL AS complete8_eligible,
  CASE WHEN NOT p.paired_valid THEN 'pair_invalid' WHEN par.parent_id IS NULL THEN 'incomplete_240s_parent' ELSE '' END AS complete8_exclude_reason
FROM paired p LEFT JOIN par USING (split, subject_id, session_id, label_start_ms, label_end_ms)"""))
def complete8_eligibility(spark, d):
    rows = pairs(spark, d)
    return grid.mark_eligible(rows, grid.complete_parents(rows)).select(
        "paired_sample_id", "parent_id", "complete8_eligible", "complete8_exclude_reason")


@query("merge_reasons", sql("v_win", """
SELECT subject_id, array_to_string(list_sort(list_distinct(flatten(list(qc_reason_codes)))), ';') AS codes FROM v_win GROUP BY subject_id"""))
def merge_reasons(spark, d):
    return v_win(spark, d).groupBy("subject_id").agg(grid.merged_codes(F.col("qc_reason_codes"), C.WINDOW_REASONS).alias("c")).select(
        "subject_id", F.array_join("c", ";").alias("codes"))


@query("restrict_to_complete", sql("v_video v_tele", """
WITH l AS (SELECT DISTINCT printf('ULDD_%s_%09d_%09d', session_id, label_start_ms, label_end_ms) AS parent_id FROM v_video),
w AS (SELECT * FROM v_tele SEMI JOIN l USING (parent_id)),
s AS (SELECT parent_id, list_sort(list((window_start_ms - label_start_ms) // 30000)) = range(8) AS ok, count(DISTINCT label_id) AS labels FROM w GROUP BY parent_id)
SELECT CASE WHEN ok IS NULL THEN 'missing' WHEN NOT ok THEN 'window_indices' WHEN labels > 1 THEN 'labels' ELSE 'complete' END AS state, count(*) AS parents,
  (SELECT count(*) FROM w) AS kept_windows FROM l LEFT JOIN s USING (parent_id) GROUP BY 1"""))
def restrict_to_complete(spark, d):
    listed = v_video(spark, d).select(ids.window_id(F.col("session_id"), F.col("label_start_ms"), F.col("label_end_ms")).alias("parent_id"))
    windows = v_tele(spark, d).withColumn("window_index", ((F.col("window_start_ms") - F.col("label_start_ms")) / 30_000).cast("int"))
    kept, problems = grid.restrict_to_complete(windows, listed)
    states = listed.distinct().join(problems, "parent_id", "left").groupBy(F.coalesce("code", F.lit("complete")).alias("state")).agg(
        F.count(F.lit(1)).alias("parents"))
    return states.withColumn("kept_windows", kept.agg(F.count(F.lit(1)).alias("n")).select("n").scalar())


@query("missing_source", sql("v_grid", """
SELECT session_id, window_index, 'SOURCE_TELEMETRY_MISSING' AS error, 'FAIL' AS qc_status, false AS valid FROM v_grid
WHERE session_id NOT IN (SELECT 'U' || user_id FROM events)"""))
def missing_source(spark, d):
    lattice = grid.candidate_grid(v_session_labels(spark, d), WINDOW_H_MS)
    have = table(spark, d, "events", "user_id").select(F.concat(F.lit("U"), "user_id").alias("session_id"))
    return grid.missing_source_windows(lattice, have).select("session_id", "window_index", "error", "qc_status", "valid")


# -- W1-W4, W6, W7, O1-O3, U1-U3 -------------------------------------------------------

@query("flag_repeats", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) > 1 AS is_repeat FROM orders""")
def flag_repeats(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("year", F.year("o_orderdate"))
    return ordering.flag_repeats(rows, ["o_custkey", "year"], "o_orderkey").select("o_orderkey", "is_repeat")


@query("duplicate_keys", "SELECT o_custkey, o_orderdate::DATE::VARCHAR AS day, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    rows = table(spark, d, "orders", "o_custkey", "o_orderdate").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return ordering.duplicate_keys(rows, ["o_custkey", "day"])


@query("split_leakage", """
SELECT o_orderkey, coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> o_orderstatus, false) AS changed FROM orders""")
def split_leakage(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return ordering.changed_from_previous(rows, ["o_custkey"], "o_orderstatus", "o_orderkey").select("o_orderkey", "changed")


@query("label_conflict", f"""
SELECT count(*) AS conflicts, subject_id FROM (
 SELECT subject_id, lag(score) OVER (PARTITION BY o_custkey, p ORDER BY o_orderkey) <> score AS c FROM (
  SELECT o_orderkey, o_custkey, o_custkey // 50 AS p, ({SQL_LETTERS})[o_custkey % 16 + 1] AS subject_id, CASE WHEN o_totalprice > 300000 THEN 7.5 ELSE 2.0 END AS score FROM orders))
WHERE c GROUP BY subject_id""")
def label_conflict(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    rows = rows.withColumn("subject_id", letter(F.col("o_custkey"))).withColumn("score", F.when(F.col("o_totalprice") > 300_000, 7.5).otherwise(2.0))
    hits = ordering.changed_from_previous(rows, ["o_custkey"], "score", "o_orderkey").where("changed")
    return hits.groupBy("subject_id").agg(F.count(F.lit(1)).alias("conflicts"))


@query("even_sample", """
WITH r AS (SELECT o_orderkey, l, row_number() OVER (PARTITION BY l ORDER BY o_orderkey) - 1 AS rk, count(*) OVER (PARTITION BY l) AS n FROM (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS l FROM orders)),
q AS (SELECT DISTINCT l, n, CASE WHEN l < 2 THEN 17 ELSE 16 END AS q FROM r),
w AS (SELECT l, CASE WHEN i = q - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1)::DOUBLE / (q - 1))) AS BIGINT) END AS rk FROM q, (SELECT unnest(range(17)) AS i) WHERE i < q)
SELECT o_orderkey, l AS label_id FROM r JOIN w USING (l, rk)""")
def even_sample(spark, d):
    status = F.col("o_orderstatus")
    rows = table(spark, d, "orders", "o_orderkey", "o_orderstatus").select(
        "o_orderkey", F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("label_id"))
    return ordering.stratified_even_sample(rows, "label_id", 50, 3, "o_orderkey")


@query("first_eligible", sql("v_win", "SELECT sample_id FROM v_win WHERE valid ORDER BY session_id, window_start_ms LIMIT 16"))
def first_eligible(spark, d):
    return ordering.first_n_eligible(v_win(spark, d), F.col("valid"), ["session_id", "window_start_ms"], 16).select("sample_id")


@query("manifest_order", sql("v_win", """
SELECT sample_id, row_number() OVER (PARTITION BY split ORDER BY subject_id, session_id, window_start_ms) AS place FROM v_win"""))
def manifest_order(spark, d):
    # The place inside the split shows the order. A split or subject may hold most
    # rows, so the chunks follow subject, session and stretches of the start.
    session = F.ascii("subject_id").cast("bigint") * 2 + F.when(F.endswith("session_id", F.lit("D")), 1).otherwise(0)
    chunk = session * (1 << 40) + cut("window_start_ms", CHUNK_ROWS * 30_000)
    placed = number_rows(v_win(spark, d), ["split"], ["subject_id", "session_id", "window_start_ms"], chunk, "place")
    return ordering.manifest_order(placed).select("sample_id", (F.col("place") + 1).alias("place"))


@query("pair_order", sql("v_video", "SELECT subject_id, session_id, window_start_ms, sample_id FROM v_video"))
def pair_order(spark, d):
    return ordering.pair_order(v_video(spark, d)).select("subject_id", "session_id", "window_start_ms", "sample_id")


@query("examples", """
WITH e AS (SELECT o_orderpriority AS code, 'C' || o_custkey AS sample, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY sample) AS r FROM e)
SELECT code, CAST(sum(n) AS BIGINT) AS n, string_agg(sample, ',' ORDER BY sample) FILTER (WHERE r <= 5) AS examples FROM r GROUP BY code""")
def examples(spark, d):
    rows = table(spark, d, "orders", "o_custkey", "o_orderpriority").select(
        F.col("o_orderpriority").alias("code"), F.concat(F.lit("C"), "o_custkey").alias("sample"))
    return ordering.examples(rows, "code", "sample").withColumn("examples", F.array_join("examples", ","))


@query("union_splits", sql("v_win", "SELECT split, count(*) AS n FROM v_win WHERE split <> 'test' GROUP BY split"))
def union_splits(spark, d):
    rows = v_win(spark, d)
    return unite(rows.where("split = 'train'"), rows.where("split = 'val'")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("common_and_one_sided_ids", """
SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS common,
 (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_documents,
 (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_labels""")
def common_and_one_sided_ids(spark, d):
    docs, labels = table(spark, d, "documents", "doc_id"), table(spark, d, "labels", "doc_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = (count(ordering.minus_ids(docs, labels, "doc_id"), "n"), count(ordering.minus_ids(labels, docs, "doc_id"), "n"))
    return count(ordering.intersect_ids(docs, labels, "doc_id"), "common").withColumns({
        "only_documents": parts[0].select("n").scalar(), "only_labels": parts[1].select("n").scalar()})


@query("partition_valid", sql("v_win", """
SELECT 'usable' AS part, '' AS error, count(*) AS n FROM v_win WHERE valid GROUP BY ALL
UNION ALL SELECT 'rejected', CASE WHEN role = 'user' THEN 'short' ELSE 'INVALID_WITHOUT_ERROR' END, count(*) FROM v_win WHERE NOT valid GROUP BY ALL"""))
def partition_valid(spark, d):
    text = v_win(spark, d).select(
        "sample_id", F.when(F.col("valid"), " True ").otherwise("0").alias("valid"),
        F.when(F.col("valid"), "").when(F.col("role") == "user", "short").otherwise("").alias("error"), F.lit("f.npz").alias("feature_path"))
    usable, rejected = ordering.partition_valid(text)
    return usable.withColumn("part", F.lit("usable")).unionByName(rejected.withColumn("part", F.lit("rejected"))).groupBy(
        "part", "error").agg(F.count(F.lit(1)).alias("n"))


# -- A17, A18, A20-A22, A31 --------------------------------------------------------------

@query("split_summary", sql("v_win", """
WITH p AS (SELECT parent_id, split, list_sort(list(window_index)) = [0,1,2,3,4,5,6,7] AND bool_and(valid) AS c FROM v_win GROUP BY ALL)
SELECT split, count(DISTINCT subject_id) AS subject_count, count(DISTINCT session_id) AS session_count, count(*) AS candidate_windows, count(*) FILTER (WHERE valid) AS valid_windows,
  count(*) FILTER (WHERE NOT valid) AS excluded_windows, count(*) FILTER (WHERE valid AND label_class = 'low') AS valid_low,
  count(*) FILTER (WHERE valid AND label_class = 'medium') AS valid_medium, count(*) FILTER (WHERE valid AND label_class = 'high') AS valid_high,
  (SELECT count(*) FROM p WHERE c AND p.split = v_win.split) AS complete_parents FROM v_win GROUP BY split"""))
def split_summary(spark, d):
    windows = v_win(spark, d)
    return coverage.split_summary(windows, grid.parent_manifest(windows))


@query("reason_counts", sql("v_win", "SELECT code, count(*) AS n FROM (SELECT unnest(qc_reason_codes) AS code FROM v_win) GROUP BY code"))
def reason_counts(spark, d):
    # through the exported text form and back
    text = v_win(spark, d).select(F.array_join("qc_reason_codes", ";").alias("t"))
    return coverage.reason_counts(text.withColumn("codes", coverage.split_codes(F.col("t"))), "codes")


@query("label_class_counts", sql("v_win", "SELECT label_class, count(*) AS all_windows, count(*) FILTER (WHERE valid) AS valid_windows FROM v_win GROUP BY 1"))
def label_class_counts(spark, d):
    return coverage.label_class_counts(v_win(spark, d))


@query("subject_table", sql("v_win", f"""
SELECT s AS subject_id, {sql_split('s')} AS split, count(DISTINCT session_id) AS session_count, count(session_id) AS window_count, count(*) FILTER (WHERE valid) AS valid_window_count
FROM (SELECT unnest({SQL_LETTERS}) AS s) LEFT JOIN v_win ON subject_id = s GROUP BY s"""))
def subject_table(spark, d):
    return coverage.subject_table(v_win(spark, d))


@query("subject_sessions", sql("v_win", "SELECT DISTINCT subject_id, session_id FROM v_win"))
def subject_sessions(spark, d):
    return coverage.subject_sessions(v_win(spark, d))


@query("dataset_coverage", sql("v_win", """
SELECT split, count(*) AS windows, count(DISTINCT parent_id) AS parents, count(DISTINCT subject_id) AS subjects, count(DISTINCT session_id) AS sessions,
  count(*) FILTER (WHERE label_id = 0) AS class_low, count(*) FILTER (WHERE label_id = 1) AS class_medium, count(*) FILTER (WHERE label_id = 2) AS class_high FROM v_win GROUP BY split"""))
def dataset_coverage(spark, d):
    return coverage.dataset_coverage(v_win(spark, d), ["split"])


@query("expected_counts", """
SELECT o_orderstatus AS name, a AS actual, e AS expected FROM (SELECT o_orderstatus, count(*) AS a FROM orders GROUP BY 1)
FULL JOIN (SELECT l_linestatus AS o_orderstatus, count(*) AS e FROM lineitem GROUP BY 1) USING (o_orderstatus) WHERE a IS DISTINCT FROM e""")
def expected_counts(spark, d):
    actual = table(spark, d, "orders", "o_orderstatus").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    frozen = table(spark, d, "lineitem", "l_linestatus").groupBy(F.col("l_linestatus").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return coverage.count_differences(actual, frozen, "name", "n")


@query("acceptance_report", sql("v_win", """
SELECT split, count(*) AS windows, count(DISTINCT parent_id) AS parents, count(DISTINCT subject_id) AS subjects, count(DISTINCT session_id) AS sessions,
  count(*) FILTER (WHERE label_id = 0) AS class_low, count(*) FILTER (WHERE label_id = 1) AS class_medium, count(*) FILTER (WHERE label_id = 2) AS class_high,
  count(*) FILTER (WHERE NOT valid) AS problem_samples, CASE WHEN bool_and(valid) THEN 'PASS' ELSE 'FAIL' END AS status FROM v_win GROUP BY split"""))
def acceptance_report(spark, d):
    windows = v_win(spark, d)
    problems = windows.select("split", "sample_id", F.explode("qc_reason_codes").alias("code"))
    return coverage.acceptance_report(windows, problems)


@query("split_freeze", sql("v_win", """
WITH p AS (SELECT parent_id, split, list_sort(list(window_index)) = [0,1,2,3,4,5,6,7] AND bool_and(valid) AS c FROM v_win GROUP BY ALL)
SELECT split, count(*) FILTER (WHERE valid) AS valid_windows, count(*) FILTER (WHERE NOT valid) AS excluded_windows,
  (SELECT count(*) FROM p WHERE c AND p.split = v_win.split) AS complete_parents FROM v_win GROUP BY split"""))
def split_freeze(spark, d):
    """The freeze job on exported text rows; the counts come from its outputs."""
    rows = v_win(spark, d).select(
        "row_no", "sample_id", "parent_id", "subject_id", "session_id", "split", F.col("window_index").cast("string").alias("window_index"),
        "label_start_ms", "label_end_ms", F.col("kss_score").cast("string").alias("kss_score"), "label_class",
        F.col("label_id").cast("string").alias("label_id"), F.col("valid").cast("string").alias("valid"),
        F.array_join("qc_reason_codes", ";").alias("qc_reason_codes"), F.array_join("qc_reason_codes", ";").alias("error"),
        F.when(F.col("valid"), "PASS").otherwise("FAIL").alias("qc_status"), F.concat("sample_id", F.lit(".npz")).alias("feature_path"))
    valid, excluded, parents, _ = jobs.freeze_splits(rows)
    parts = [df.groupBy("split").agg(F.count(F.lit(1)).alias(n)) for df, n in (
        (valid, "valid_windows"), (excluded, "excluded_windows"), (parents, "complete_parents"))]
    return parts[0].join(parts[1], "split", "full").join(parts[2], "split", "full").na.fill(0)


@query("summary_report")
def summary_report(spark, d):
    windows = v_win(spark, d)
    return coverage.summary_report(
        splits=coverage.split_summary(windows, grid.parent_manifest(windows)),
        reasons=coverage.reason_counts(windows, "qc_reason_codes"), labels=coverage.label_class_counts(windows))


@query("majority_by_subject", sql("v_win", """
SELECT subject_id, label_id AS majority_class, n FROM (SELECT subject_id, label_id, count(*) AS n FROM v_win GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, label_id) = 1"""))
def majority_by_subject(spark, d):
    return majority_class(v_win(spark, d), ["subject_id"])


