"""Readers and writers: tables written out, read back and compared with the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions.parsing import is_sha256
from tidegrid.operators import grid
from tidegrid.operators import features as B
from tidegrid.operators import validators as V
from tidegrid.session import shared_folder
from tidegrid.sources import files, sinks, tables
from workload.joins import v_c5, v_f30, v_w30
from workload.registry import query, rounded, sql, table
from workload.scores import seeds
from workload.views import v_tel, v_tok, v_win


# -- S1, S9, S13, S18 ---------------------------------------------------------------

@query("read_manifest", """
SELECT o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(*) FILTER (WHERE o_orderstatus = 'P') AS empty_text,
 count(*) FILTER (WHERE o_orderstatus = 'F') AS broken_lines, (SELECT count(*) + 1 FROM orders) AS last_line, 0::BIGINT AS malformed
FROM orders GROUP BY o_orderpriority""")
def read_manifest(spark, d):
    """Orders as a CSV manifest in key order, a third of them with a line break inside quotes, numbered again on reading."""
    rows = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").withColumn(
        "note", F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "F", 'two\nlines, "both" noted').otherwise('say "hi", twice'))
    path = sinks.write_csv(rows, shared_folder(spark, "manifest"))
    back = tables.read_manifest(spark, path, ["o_orderkey", "note"])
    lines = back.agg((F.count(F.lit(1)) + 1).alias("n"))
    return back.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"), F.count_if(F.col("note") == "").alias("empty_text"),
        F.count_if(F.col("note") == 'two\nlines, "both" noted').alias("broken_lines"), F.count_if("malformed").alias("malformed")).withColumn("last_line", lines.select("n").scalar())


@query("telemetry_row_numbers", sql("v_tel", """
SELECT session_id, count(*) AS n, CAST(sum(row_no) AS BIGINT) AS rows_total, CAST(sum(row_no * timestamp_us % 1000003) AS BIGINT) AS order_check FROM v_tel GROUP BY session_id"""))
def telemetry_row_numbers(spark, d):
    """Dense numbering along the clock, as the telemetry reader gives it along a file."""
    return v_tel(spark, d).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("rows_total"),
        F.sum((F.col("row_no") * F.col("timestamp_us")) % 1_000_003).alias("order_check"))


@query("read_video_source", sql("v_w30 v_f30 v_c5", """
SELECT 'windows30' AS source, count(*) AS n, count(DISTINCT sample_id) AS ids FROM v_w30 UNION ALL SELECT 'windows5', count(*), count(DISTINCT sample_id) FROM v_c5 UNION ALL SELECT 'features', count(*), count(DISTINCT sample_id) FROM v_f30"""))
def read_video_source(spark, d):
    root = shared_folder(spark, "video")
    parts = {"windows30": v_w30(spark, d), "windows5": v_c5(spark, d), "features": v_f30(spark, d)}
    paths = {name: sinks.write_csv(df, f"{root}/{name}", "gzip") for name, df in parts.items()}
    read = tables.read_video_source(spark, paths["windows30"], paths["windows5"], paths["features"])
    out = None
    for name, df in zip(("windows30", "windows5", "features"), read):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("ids")).withColumn("source", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("read_id_list", "SELECT count(*) AS n, count(DISTINCT 'C' || o_custkey) AS ids FROM orders WHERE o_orderstatus <> 'P'")
def read_id_list(spark, d):
    """Ids one per line, blank lines between them."""
    blank = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit(" C"), "o_custkey"))
    lines = table(spark, d, "orders", "o_custkey", "o_orderstatus").select(blank.alias("value"))
    path = sinks.write_new(lines, shared_folder(spark, "ids"), "text")
    return tables.read_id_list(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("ids"))


# -- S3, J16 source, S4, S5 ------------------------------------------------------------

@query("read_label_sheet", """
WITH s AS (SELECT l_suppkey AS k, list_transform(range(10), lambda i: 1 + (l_suppkey * 7 + i) % 17 / 2.0::DOUBLE) AS v FROM (SELECT DISTINCT l_suppkey FROM lineitem))
SELECT chr(CAST(65 + k % 26 AS INT)) || (CASE WHEN k % 2 = 0 THEN '_A' ELSE '_D' END) AS session_id, i AS label_index, count(*) AS n, round(sum(v[i + 1]), 6) AS total FROM s, (SELECT CAST(unnest(range(10)) AS INT) AS i) GROUP BY ALL""")
def read_label_sheet(spark, d):
    k = F.col("l_suppkey")
    scores = [(1 + ((k * 7 + i) % 17) / 2.0).cast("string").alias(f"s{i}") for i in range(10)]
    name = F.concat(F.char(65 + k % 26), F.when(k % 2 == 0, "_Alert").otherwise("_Drowsy"))
    sheet = table(spark, d, "lineitem", "l_suppkey").distinct().select(name.alias("id"), *scores)
    path = sinks.write_new(sheet, shared_folder(spark, "labels"), "csv")
    # several suppliers share a letter here, so the uniqueness stop is left out
    return rounded(tables.read_label_sheet(spark, path, check=False).groupBy("session_id", "label_index").agg(
        F.count(F.lit(1)).alias("n"), F.sum("kss_score").alias("total")))


@query("read_feature_index", "SELECT count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, count(DISTINCT label) AS statuses, 64::BIGINT AS width FROM embeddings")
def read_feature_index(spark, d):
    rows = table(spark, d, "embeddings", "vec_id", "embedding", "label").select(
        F.concat(F.lit("v"), "vec_id").alias("sample_id"), F.concat(F.lit("f\\"), "vec_id", F.lit(".npz")).alias("path"),
        F.concat(F.lit("s"), "label").alias("status"), F.lit(1).alias("T"), F.size("embedding").alias("D"))
    path = sinks.write_new(rows, shared_folder(spark, "index"), "json")
    back = tables.read_feature_index(spark, path)
    number = F.regexp_extract("path", r"\Af/([0-9]+)\.npz\z", 1).cast("bigint")
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("ids"), F.count_distinct("status").alias("statuses"), F.max("D").alias("width"))


@query("read_feature_index_lenient", """
SELECT 'C' || o_custkey AS sample_id, 'f/' || max(o_orderkey) || '.npz' AS path FROM orders GROUP BY o_custkey""")
def read_feature_index_lenient(spark, d):
    """Several lines per id in key order, over files named in that order; the last one wins."""
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey").orderBy("o_orderkey").select(
        F.concat(F.lit("C"), "o_custkey").alias("sample_id"), F.concat(F.lit("processed\\f\\"), "o_orderkey", F.lit(".npz")).alias("path"))
    path = sinks.write_new(rows, shared_folder(spark, "index"), "json")
    return tables.read_feature_index_lenient(spark, path)


# -- S6, S7 (fixtures in tests), S8, J14 -----------------------------------------------

@query("file_inventory", """
SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, true AS all_hashed, true AS all_dated FROM documents""")
def file_inventory(spark, d):
    """The texts written as files; the inventory must find every byte."""
    root = sinks.write_new(table(spark, d, "documents", "text"), shared_folder(spark, "files"), "text")
    found = files.file_inventory(spark, root)
    return found.agg(
        F.sum("size_bytes").alias("bytes"), F.bool_and(is_sha256(F.col("sha256"))).alias("all_hashed"),
        F.bool_and(F.col("modified").isNotNull()).alias("all_dated"))


# -- S10, S14, S15 ----------------------------------------------------------------------

@query("read_predictions", sql("v_seed", """
SELECT seed, split, count(*) AS n, count(*) FILTER (WHERE prediction = 0) AS low, round(sum(p0), 4) AS total FROM v_seed GROUP BY seed, split"""))
def read_predictions(spark, d):
    """Exported predictions, read back from text, with the exact doubles."""
    rows = sinks.export_predictions(seeds(spark, d), "run-1")
    path = sinks.write_csv(rows, shared_folder(spark, "predictions"), "gzip")
    back = tables.read_predictions(spark, path, "window_30s", "val", 11, check=False)
    return rounded(back.groupBy("seed", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == 0).alias("low"),
        F.sum(F.get("probabilities", F.lit(0))).alias("total")), 4)


# -- S11 ---------------------------------------------------------------------------------

@query("read_subject_splits", "SELECT c_custkey AS subject, CASE WHEN c_custkey % 10 < 6 THEN 'train' WHEN c_custkey % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM customer")
def read_subject_splits(spark, d):
    """Blocks of customers as one JSON object each, read back as rows."""
    k = F.col("c_custkey")
    split = F.when(k % 10 < 6, "train").when(k % 10 < 8, "val").otherwise("test")
    entries = table(spark, d, "customer", "c_custkey").select(
        F.call_function("div", k, F.lit(50)).alias("block"), F.struct(k.cast("string").alias("key"), split.alias("value")).alias("e"))
    maps = entries.groupBy("block").agg(F.map_from_entries(F.collect_list("e")).alias("splits")).select("splits")
    path = sinks.write_new(maps, shared_folder(spark, "splits"), "json", maxRecordsPerFile=1)
    return tables.read_subject_splits(spark, path).select(F.col("subject_id").cast("bigint").alias("subject"), "split")


# -- S12, S13 --------------------------------------------------------------------------------

@query("write_split_manifests", sql("v_win", """
WITH p AS (SELECT parent_id, split, list_sort(list(window_index)) = [0,1,2,3,4,5,6,7] AND bool_and(valid) AS c FROM v_win GROUP BY ALL)
SELECT 'windows' AS part, split, count(*) AS n FROM v_win WHERE valid GROUP BY split UNION ALL SELECT 'parents', split, count(*) FROM p WHERE c GROUP BY split
UNION ALL SELECT 'excluded', split, count(*) FROM v_win WHERE NOT valid GROUP BY split UNION ALL SELECT 'complete_parents', split, count(*) FROM p WHERE c GROUP BY split"""))
def write_split_manifests(spark, d):
    windows = v_win(spark, d)
    parts = sinks.write_split_manifests(windows, grid.parent_manifest(windows), shared_folder(spark, "splits"))
    out = None
    for name, path in parts.items():
        rows = spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("split_manifest_contents", sql("v_win", """
WITH p AS (SELECT parent_id, list_sort(list(window_index)) = [0,1,2,3,4,5,6,7] AND bool_and(valid) AS c FROM v_win GROUP BY parent_id), n AS (
SELECT 'windows' AS output, count(*) AS n FROM v_win WHERE valid UNION ALL SELECT 'parents', count(*) FROM p WHERE c
UNION ALL SELECT 'excluded', count(*) FROM v_win WHERE NOT valid UNION ALL SELECT 'complete_parents', count(*) FROM p WHERE c)
SELECT output, n AS expected, n AS found, true AS same FROM n"""))
def split_manifest_contents(spark, d):
    """The four outputs of a set, read back and held against the rows and checksums of its manifest."""
    windows, out = v_win(spark, d), shared_folder(spark, "splits")
    parents = grid.parent_manifest(windows)
    sinks.write_split_manifests(windows, parents, out)
    return sinks.check_set(spark, out, {"windows": windows.schema, "excluded": windows.schema, "parents": parents.schema, "complete_parents": parents.schema})


# -- S16, S17, S19 ------------------------------------------------------------------------------

@query("export_feature_package", sql("v_tok", """
SELECT vec_id AS sample_id, count(*) AS tokens, round(min(t), 6) AS first_time, round(max(e), 6) AS last_end, CASE WHEN bool_and(coalesce(t > pt, true)) THEN '' ELSE 'time_not_strictly_increasing' END ||
 CASE WHEN bool_and(s >= 0 AND e <= 30 AND e > s AND t > s AND t < e) THEN '' ELSE CASE WHEN bool_and(coalesce(t > pt, true)) THEN '' ELSE ';' END || 'outside_sample_support' END AS codes
FROM (SELECT *, lag(t) OVER (PARTITION BY vec_id ORDER BY k) AS pt FROM v_tok) GROUP BY vec_id"""))
def export_feature_package(spark, d):
    """A request for every sample, half of them in session time."""
    key = F.col("vec_id")
    late = key % 2 == 0
    shift = F.when(late, key * 30.0).otherwise(0.0)
    features = v_tok(spark, d).select(
        F.concat(F.lit("f/"), key).alias("source_feature"), "x", F.transform("time_s", lambda t: t + shift).alias("time_s"), "valid_mask",
        F.transform("support_s", lambda s: F.struct((s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"))).alias("support_s"), "observed_fraction")
    request = table(spark, d, "embeddings", "vec_id").select(
        key.alias("sample_id"), (key * 30_000).alias("window_start_ms"), (key * 30_000 + 30_000).alias("window_end_ms"),
        F.concat(F.lit("f/"), key).alias("source_feature"), F.when(late, "session_relative").otherwise("sample_relative").alias("source_time_reference"))
    out = sinks.export_feature_package(request, features)
    return rounded(out.select(
        "sample_id", F.size("x").cast("bigint").alias("tokens"), F.array_min("time_s").alias("first_time"),
        F.array_max(F.transform("support_s", lambda s: s["end"])).alias("last_end"), F.array_join("package_codes", ";").alias("codes")))


@query("standardizer_state", sql("v_tok", """
SELECT split, count(*) AS tokens, round(avg(CAST((x0 - m) / dev AS DOUBLE)), 4) AS mean_x0 FROM v_tok, (SELECT avg(CAST(x0 AS DOUBLE)) AS m, stddev_pop(CAST(x0 AS DOUBLE)) AS dev FROM v_tok WHERE valid AND split = 'train') WHERE valid GROUP BY split"""))
def standardizer_state(spark, d):
    """Fitted on train, saved, loaded, applied to every split."""
    rows = v_tok(spark, d)
    state = B.collect_state(B.fit_statistics(rows), [f"x{i}" for i in range(4)])
    loaded = sinks.load_state(spark, sinks.save_state(spark, state, shared_folder(spark, "state")))
    out = B.standardize(rows, *B.state_vectors(loaded))
    valid = F.filter(F.arrays_zip(F.col("x").alias("v"), F.col("valid_mask").alias("ok")), lambda z: z["ok"])
    tokens = out.select("split", F.explode(valid).alias("z"))
    return rounded(tokens.groupBy("split").agg(
        F.count(F.lit(1)).alias("tokens"), F.avg(F.get("z.v", F.lit(0)).cast("double")).alias("mean_x0")), 4)


# -- P23, V12, V14 --------------------------------------------------------------------------------

@query("locked_split_read", sql("v_win", "SELECT split, count(*) AS n FROM v_win WHERE split = 'train' GROUP BY split"))
def locked_split_read(spark, d):
    return V.read_split(v_win(spark, d), "train", allow_test=True).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("forbidden_columns", """
SELECT count(*) AS rows, CAST(sum(len(CAST(doc_id AS VARCHAR))) AS BIGINT) AS digits, 'label_quality,label_toxic' AS refused FROM labels""")
def forbidden_columns(spark, d):
    rows = table(spark, d, "labels", "doc_id", "quality", "toxic").withColumnsRenamed({"quality": "label_quality", "toxic": "label_toxic"})
    refused = V.forbidden_columns(rows.columns)
    return rows.drop(*refused).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.col("doc_id").cast("string")).cast("bigint")).alias("digits")).withColumn("refused", F.lit(",".join(refused)))


@query("validate_video_features", sql("v_bound", """
WITH b AS (SELECT unnest(codes) AS code FROM v_bound), s AS (SELECT (SELECT count(*) FROM v_w30) <> (SELECT count(*) FROM v_f30) AS differ)
SELECT code, count(*) AS n FROM b GROUP BY code UNION ALL SELECT 'id_sets_differ', 1 FROM s WHERE differ
UNION ALL SELECT 'missing_feature', count(*) FROM v_f30 HAVING count(*) > 0"""))
def validate_video_features(spark, d):
    """A hand-off whose arrays were not delivered: sets, bindings and absences."""
    windows, features, children = v_w30(spark, d), v_f30(spark, d), v_c5(spark, d)
    arrays = v_tok(spark, d).select(F.concat(F.lit("v"), "vec_id").alias("sample_id"), F.lit("h").alias("actual_sha256"), *C.BUNDLE_DTYPES)
    return V.validate_video_features(windows, features, children, arrays).groupBy("code").agg(F.count(F.lit(1)).alias("n"))




@query("read_predictions_jsonl", sql("v_seed", """
SELECT seed, subject_id, count(*) AS n, count(*) FILTER (WHERE label_id = prediction) AS hits FROM v_seed GROUP BY seed, subject_id"""))
def read_predictions_jsonl(spark, d):
    """Predictions as JSON lines, read back with their checks."""
    path = shared_folder(spark, "prediction_lines")
    seeds(spark, d).select("subject_id", F.col("label_id").alias("label"), "prediction", "seed", "split").write.json(path)
    back = tables.read_predictions_jsonl(spark, path, 3)
    return back.groupBy("seed", "subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label_id") == F.col("prediction")).alias("hits"))
