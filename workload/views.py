"""Contract-shaped views over the given tables, in Spark and in SQL.

Every view reads its table whole. The two forms state the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids
from tidegrid.operators.telemetry import TokenSettings
from tidegrid.plans.chunked import bounded_chunks, cut, digits_of, number_rows
from workload.registry import micros, table, view

LETTERS = tuple(s for split in C.SPLITS for s in C.FATIGUE_SUBJECTS[split])
SQL_LETTERS = "[" + ",".join(f"'{s}'" for s in LETTERS) + "]"
HOUR_US = 3_600_000_000
# Events lie hours apart, so tokens, windows and limits are hours too.
EVENT_TOKENS = TokenSettings(
    window_us=90 * HOUR_US, token_us=9 * HOUR_US, min_raw_coverage=0.5, min_valid_ratio=0.7,
    max_unusable_s=18 * 3600.0, max_gap_s=24 * 3600.0, clock_jump_s=48 * 3600.0, strict=False)
EVENT_JUMP_S = EVENT_TOKENS.clock_jump_s


def letter(number: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in LETTERS]), (number % len(LETTERS)).cast("int"))


def div(column: str | Column, by: int) -> Column:
    return cut(column, by)


def sql_kss_id(x: str) -> str:
    return f"(CASE WHEN {x} < 4 THEN 0 WHEN {x} < 7 THEN 1 ELSE 2 END)"


def sql_kss_class(x: str) -> str:
    return f"(CASE WHEN {x} < 4 THEN 'low' WHEN {x} < 7 THEN 'medium' ELSE 'high' END)"


def sql_split(x: str) -> str:
    parts = " ".join(
        f"WHEN {x} IN ({','.join(repr(s) for s in C.FATIGUE_SUBJECTS[split])}) THEN '{split}'" for split in C.SPLITS)
    return f"(CASE {parts} END)"


# -- predictions ----------------------------------------------------------------

view("v_pred", f"""
SELECT l_orderkey AS parent_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id,
  'C' || o_custkey AS subject_id, 'C' || o_custkey || '_' || year(o_orderdate) AS session_id,
  CASE WHEN o_custkey % 10 < 6 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'val' ELSE 'test' END AS split,
  CAST(l_linenumber - 1 AS INT) AS window_index,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label_id,
  l_quantity / (l_quantity + 500 * l_discount + 600 * l_tax) AS p0,
  500 * l_discount / (l_quantity + 500 * l_discount + 600 * l_tax) AS p1,
  600 * l_tax / (l_quantity + 500 * l_discount + 600 * l_tax) AS p2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

view("v_pred1", """
SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction FROM v_pred""", "v_pred")

view("v_seed0", """
SELECT 11 AS seed, * FROM v_pred
UNION ALL SELECT 22, parent_id, sample_id, subject_id, session_id, split, window_index, label_id, p1, p2, p0 FROM v_pred
UNION ALL SELECT 33, parent_id, sample_id, subject_id, session_id, split, window_index, label_id, p2, p0, p1 FROM v_pred
""", "v_pred")

view("v_seed", """
SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction FROM v_seed0""", "v_seed0")


def v_pred(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                  "l_quantity", "l_discount", "l_tax")
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    q, a, b = F.col("l_quantity"), 500 * F.col("l_discount"), 600 * F.col("l_tax")
    total = q + a + b
    customer = F.concat(F.lit("C"), F.col("o_custkey"))
    turn = F.col("o_custkey") % 10
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("parent_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"),
        customer.alias("subject_id"),
        F.concat_ws("_", customer, F.year("o_orderdate")).alias("session_id"),
        F.when(turn < 6, "train").when(turn < 8, "val").otherwise("test").alias("split"),
        (F.col("l_linenumber") - 1).cast("int").alias("window_index"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label_id"),
        F.array(q / total, a / total, b / total).alias("probabilities"),
    )


#: Parents are pairs of lines: every line belongs to one, and what holds no whole pair is a problem that shows.
_PAIR = "* REPLACE (parent_id * 4 + window_index // 2 AS parent_id, CAST(window_index % 2 AS INT) AS window_index)"
view("v_pair", f"SELECT {_PAIR} FROM v_pred", "v_pred")
view("v_pair1", f"SELECT {_PAIR} FROM v_pred1", "v_pred1")
view("v_seed_pair", f"SELECT {_PAIR} FROM v_seed", "v_seed")


def paired(preds: DataFrame) -> DataFrame:
    line = F.col("window_index")
    return preds.withColumns({"parent_id": F.col("parent_id") * 4 + F.call_function("div", line, F.lit(2)), "window_index": line % 2})


def v_seed(spark: SparkSession, d: str) -> DataFrame:
    """Three runs over the same samples: the probabilities rotate with the seed."""
    p = [F.get("probabilities", F.lit(i)) for i in range(3)]
    runs = F.array(*[
        F.struct(F.lit(seed).alias("seed"), F.array(p[i % 3], p[(i + 1) % 3], p[(i + 2) % 3]).alias("p"))
        for i, seed in enumerate(C.SEEDS)])
    return (
        v_pred(spark, d).withColumn("run", F.explode(runs))
        .withColumn("seed", F.col("run.seed")).withColumn("probabilities", F.col("run.p")).drop("run")
    )


# -- windows from conversations -------------------------------------------------

view("v_win", f"""
SELECT conv_id * 100 + turn AS row_no, conv_id, CAST(turn AS INT) AS window_index, subject_id,
  subject_id || '_' || (CASE WHEN (conv_id // 16) % 2 = 0 THEN 'A' ELSE 'D' END) AS session_id,
  'conv-' || conv_id AS parent_id, 'conv-' || conv_id || '-' || turn AS sample_id,
  {sql_split('subject_id')} AS split,
  conv_id * 240000 AS label_start_ms, conv_id * 240000 + 240000 AS label_end_ms,
  conv_id * 240000 + turn * 30000 AS window_start_ms, conv_id * 240000 + turn * 30000 + 30000 AS window_end_ms,
  30000::BIGINT AS duration_ms, kss_score, {sql_kss_id('kss_score')} AS label_id, {sql_kss_class('kss_score')} AS label_class,
  length(text) AS n, length(text) >= 60 AS valid, role,
  list_filter([CASE WHEN length(text) < 60 THEN 'RAW_COVERAGE_BELOW_95_PERCENT' END,
   CASE WHEN length(text) < 50 THEN 'FEATURE_COVERAGE_BELOW_95_PERCENT' END,
   CASE WHEN length(text) < 60 AND role = 'user' THEN 'CONTINUOUS_UNUSABLE_GAP_EXCEEDS_1S' END], lambda v: v IS NOT NULL) AS qc_reason_codes
FROM (SELECT *, {SQL_LETTERS}[conv_id % 16 + 1] AS subject_id, 1 + (conv_id % 17) / 2.0::DOUBLE AS kss_score FROM conversations)""")


def v_win(spark: SparkSession, d: str) -> DataFrame:
    """Turns as 30 s windows, conversations as 240 s parents of two to eight windows."""
    conv, turn = F.col("conv_id"), F.col("turn")
    n = F.length("text")
    start = conv * 240_000 + turn * 30_000
    none = F.lit(None).cast("string")
    return (
        table(spark, d, "conversations", "conv_id", "turn", "role", "text")
        .withColumn("subject_id", letter(conv))
        .withColumn("kss_score", 1 + (conv % 17) / 2.0)
        .select(
            (conv * 100 + turn).alias("row_no"), "conv_id", turn.cast("int").alias("window_index"), "subject_id",
            F.concat_ws("_", "subject_id", F.when(div("conv_id", 16) % 2 == 0, "A").otherwise("D")).alias("session_id"),
            F.concat(F.lit("conv-"), conv).alias("parent_id"), F.concat(F.lit("conv-"), conv, F.lit("-"), turn).alias("sample_id"),
            ids.fatigue_split(F.col("subject_id")).alias("split"),
            (conv * 240_000).alias("label_start_ms"), (conv * 240_000 + 240_000).alias("label_end_ms"),
            start.alias("window_start_ms"), (start + 30_000).alias("window_end_ms"),
            F.lit(30_000).cast("bigint").alias("duration_ms"), "kss_score",
            ids.kss_label_id(F.col("kss_score")).alias("label_id"), ids.kss_label_class(F.col("kss_score")).alias("label_class"),
            n.alias("n"), (n >= 60).alias("valid"), "role",
            F.array_compact(F.array(
                F.when(n < 60, C.RAW_COVERAGE_LOW).otherwise(none),
                F.when(n < 50, C.FEATURE_COVERAGE_LOW).otherwise(none),
                F.when((n < 60) & (F.col("role") == "user"), C.UNUSABLE_GAP).otherwise(none))).alias("qc_reason_codes"),
        )
    )


# -- two modalities: orders as video windows, lineitem as telemetry windows -----

def _place(key: str) -> str:
    return f"""({SQL_LETTERS})[({key} // 8) % 16 + 1] AS subject_id,
  (CASE WHEN ({key} // 128) % 2 = 0 THEN 'A' ELSE 'D' END) AS condition,
  ({key} // 256) * 240000 AS label_start_ms, {key} % 8 AS slot, 1 + (({key} // 8) % 17) / 2.0::DOUBLE AS base_score"""


view("v_video", f"""
SELECT k, subject_id, session_id, split, window_start_ms, window_start_ms + 30000 AS window_end_ms,
  30000::BIGINT AS duration_ms, label_start_ms, label_start_ms + 240000 AS label_end_ms, kss_score,
  {sql_kss_class('kss_score')} AS label_class, {sql_kss_id('kss_score')} AS label_id, valid,
  printf('video30__%s__%010d_%010d', session_id, window_start_ms, window_start_ms + 30000) AS sample_id
FROM (SELECT o_orderkey AS k, subject_id, subject_id || '_' || condition AS session_id, {sql_split('subject_id')} AS split,
   label_start_ms + slot * 30000 AS window_start_ms, label_start_ms, base_score AS kss_score, o_totalprice >= 5000 AS valid
  FROM (SELECT *, {_place('o_orderkey')} FROM orders))""")

view("v_tele", f"""
SELECT k, subject_id, session_id, split, window_start_ms, window_start_ms + 30000 AS window_end_ms,
  30000::BIGINT AS duration_ms, label_start_ms, label_start_ms + 240000 AS label_end_ms, kss_score,
  {sql_kss_class('kss_score')} AS label_class, {sql_kss_id('kss_score')} AS label_id, valid,
  printf('ULDD_%s_%09d_%09d', session_id, window_start_ms, window_start_ms + 30000) AS sample_id,
  printf('ULDD_%s_%09d_%09d', session_id, label_start_ms, label_start_ms + 240000) AS parent_id, lines, quantity
FROM (SELECT k, subject_id, subject_id || '_' || condition AS session_id,
   CASE WHEN lines = 10 THEN 'val' ELSE {sql_split('subject_id')} END AS split,
   label_start_ms + slot * 30000 AS window_start_ms, label_start_ms,
   CASE WHEN lines = 9 THEN 9.0 ELSE base_score END AS kss_score, top >= 2 AS valid, lines, quantity
  FROM (SELECT *, {_place('k')} FROM (
    SELECT l_orderkey AS k, count(*) AS lines, max(l_quantity) AS top, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1)))""")


def _placed(rows: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    parent = div(key, 8)
    return (
        rows.withColumn("k", k)
        .withColumn("subject_id", letter(parent))
        .withColumn("session_id", F.concat_ws("_", "subject_id", F.when(div(key, 128) % 2 == 0, "A").otherwise("D")))
        .withColumn("label_start_ms", div(key, 256) * 240_000)
        .withColumn("label_end_ms", F.col("label_start_ms") + 240_000)
        .withColumn("window_start_ms", F.col("label_start_ms") + (k % 8) * 30_000)
        .withColumn("window_end_ms", F.col("window_start_ms") + 30_000)
        .withColumn("duration_ms", F.lit(30_000).cast("bigint"))
        .withColumn("split", ids.fatigue_split(F.col("subject_id")))
        .withColumn("kss_score", 1 + (parent % 17) / 2.0)
    )


_WINDOW = ["k", "subject_id", "session_id", "split", "window_start_ms", "window_end_ms", "duration_ms",
           "label_start_ms", "label_end_ms", "kss_score", "label_class", "label_id", "valid", "sample_id"]


def v_video(spark: SparkSession, d: str) -> DataFrame:
    rows = _placed(table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_orderkey")
    return (
        rows.withColumn("valid", F.col("o_totalprice") >= 5000)
        .withColumn("label_id", ids.kss_label_id(F.col("kss_score")))
        .withColumn("label_class", ids.kss_label_class(F.col("kss_score")))
        .withColumn("sample_id", ids.video_window_id(F.col("session_id"), F.col("window_start_ms"), F.col("window_end_ms")))
        .select(*_WINDOW)
    )


def v_tele(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.max("l_quantity").alias("top"),
        F.sum("l_quantity").cast("bigint").alias("quantity"))
    rows = _placed(lines, "l_orderkey")
    return (
        rows.withColumn("valid", F.col("top") >= 2)
        .withColumn("split", F.when(F.col("lines") == 10, "val").otherwise(F.col("split")))
        .withColumn("kss_score", F.when(F.col("lines") == 9, 9.0).otherwise(F.col("kss_score")))
        .withColumn("label_id", ids.kss_label_id(F.col("kss_score")))
        .withColumn("label_class", ids.kss_label_class(F.col("kss_score")))
        .withColumn("sample_id", ids.window_id(F.col("session_id"), F.col("window_start_ms"), F.col("window_end_ms")))
        .withColumn("parent_id", ids.window_id(F.col("session_id"), F.col("label_start_ms"), F.col("label_end_ms")))
        .select(*_WINDOW, "parent_id", "lines", "quantity")
    )


view("v_sessions", "SELECT subject_id, session_id, 1800 * count(*) AS source_rows FROM v_tele GROUP BY ALL", "v_tele")
view("v_clips_of_session", """
SELECT subject_id, session_id, 30.0::DOUBLE * count(*) AS video_duration_s FROM v_video
GROUP BY subject_id, session_id, CASE WHEN subject_id IN ('A', 'E') THEN label_id ELSE 0 END""", "v_video")
SYNC_TOLERANCE_MS = 240_000.0


def v_sessions(spark: SparkSession, d: str) -> DataFrame:
    return v_tele(spark, d).groupBy("subject_id", "session_id").agg((1800 * F.count(F.lit(1))).alias("source_rows"))


def v_clips_of_session(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("subject_id").isin("A", "E"), F.col("label_id")).otherwise(0)
    return v_video(spark, d).groupBy("subject_id", "session_id", part.alias("part")).agg(
        (30.0 * F.count(F.lit(1))).alias("video_duration_s")).drop("part")


# -- telemetry from events -------------------------------------------------------

view("v_tel", """
SELECT 'U' || user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_no,
  epoch_us(ts) AS timestamp_us, 3.6 * k AS heading_deg, value / 10 AS pitch_deg, k / 10.0::DOUBLE AS roll_deg,
  CASE WHEN event_type = 'error' AND k < 20 THEN 'nan'::DOUBLE ELSE value END AS speed_mps, 10 * value AS rpm, CAST(k % 6 AS DOUBLE) AS gear
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")


def v_tel(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    rows = events.select(
        F.concat(F.lit("U"), F.col("user_id")).alias("session_id"), "event_id", micros("ts").alias("timestamp_us"),
        (3.6 * k).alias("heading_deg"), (F.col("value") / 10).alias("pitch_deg"), (k / 10.0).alias("roll_deg"),
        F.when((F.col("event_type") == "error") & (k < 20), float("nan")).otherwise(F.col("value")).alias("speed_mps"),
        (10 * F.col("value")).alias("rpm"), (k % 6).cast("double").alias("gear"))
    clock = F.col("timestamp_us")
    parts = bounded_chunks(rows, ["session_id"], [
        cut(clock, HOUR_US), cut(F.pmod(clock, F.lit(HOUR_US)), 1_000_000), F.pmod(clock, F.lit(1_000_000)), *digits_of(F.col("event_id"))])
    return number_rows(parts, ["session_id"], ["timestamp_us", "event_id"], F.col("__part")).drop("event_id", "__part")


view("v_session_labels", f"""
SELECT 'U' || c_custkey AS session_id, ({SQL_LETTERS})[c_custkey % 16 + 1] AS subject_id, 0 AS label_index,
  1 + (c_custkey % 17) / 2.0::DOUBLE AS kss_score FROM customer""")


def v_session_labels(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer", "c_custkey").select(
        F.concat(F.lit("U"), key).alias("session_id"), letter(key).alias("subject_id"),
        F.lit(0).alias("label_index"), (1 + (key % 17) / 2.0).alias("kss_score"))


WINDOW_H_MS = 90 * 3_600_000
view("v_grid", f"""
SELECT session_id, subject_id, {sql_split('subject_id')} AS split, kss_score, {sql_kss_id('kss_score')} AS label_id,
  {sql_kss_class('kss_score')} AS label_class, w AS window_index, label_index,
  CAST(label_index AS BIGINT) * 8 * {WINDOW_H_MS} AS label_start_ms, (CAST(label_index AS BIGINT) + 1) * 8 * {WINDOW_H_MS} AS label_end_ms,
  CAST(label_index AS BIGINT) * 8 * {WINDOW_H_MS} + CAST(w AS BIGINT) * {WINDOW_H_MS} AS window_start_ms,
  CAST(label_index AS BIGINT) * 8 * {WINDOW_H_MS} + (CAST(w AS BIGINT) + 1) * {WINDOW_H_MS} AS window_end_ms
FROM v_session_labels, (SELECT CAST(unnest(range(8)) AS INT) AS w)""", "v_session_labels")


# -- interval, history, inventory -------------------------------------------------

def v_sup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(
        "l_orderkey", (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("end"))


view("v_hist", """
SELECT o_custkey AS seed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position,
  o_totalprice AS metric FROM orders""")


def v_hist(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rows = orders.select(F.col("o_custkey").alias("seed"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("metric"))
    parts = bounded_chunks(rows, ["seed"], [F.unix_date(F.to_date("o_orderdate")), *digits_of(F.col("o_orderkey"))])
    numbered = number_rows(parts, ["seed"], ["o_orderdate", "o_orderkey"], F.col("__part"), "position")
    return numbered.select("seed", "position", "metric")


view("v_files", "SELECT 'd/' || doc_id AS path, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256 FROM documents")
view("v_recorded", """
SELECT 'd/' || doc_id AS path, octet_length(encode(text)) + CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS size_bytes,
  CASE WHEN quality = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha256
FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'd/' || doc_id, octet_length(encode(text)), sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
UNION ALL SELECT 'b/' || item_id, octet_length(encode(text)), sha256(text) FROM benchmark""")


def v_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select(
        F.concat(F.lit("d/"), "doc_id").alias("path"), F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.sha2("text", 256).alias("sha256"))


def v_recorded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").join(table(spark, d, "labels", "doc_id", "quality", "toxic"), "doc_id")
    path, size = F.concat(F.lit("d/"), "doc_id"), F.octet_length("text").cast("bigint")
    text = F.when(F.col("quality") == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    edited = docs.select(path.alias("path"), (size + F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("size_bytes"),
                         F.sha2(text, 256).alias("sha256"))
    again = docs.where("toxic = 1").select(path.alias("path"), size.alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    gone = table(spark, d, "benchmark", "item_id", "text").select(
        F.concat(F.lit("b/"), "item_id").alias("path"), size.alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    return edited.unionByName(again).unionByName(gone)


# -- clips from events --------------------------------------------------------------

view("v_clip", """
SELECT event_id, 'clips/' || lpad(CAST(1 + event_id % 10 AS VARCHAR), 2, '0') || '_P' || lpad(CAST(user_id % 45 AS VARCHAR), 2, '0') || '_'
   || strftime(ts, '%Y%m%d_%H_%M_%S') || '_' || event_id || '.wav' AS source_file,
  CASE WHEN k % 10 = 0 THEN 16000 ELSE 44100 END AS samplerate, CASE WHEN user_id % 7 = 0 THEN 1 ELSE 2 END AS channels,
  CASE WHEN user_id % 11 = 0 THEN 1 ELSE 2 END AS sample_width_bytes,
  CASE WHEN event_type = 'error' THEN 0 ELSE 441000 + (k - 50) * 100 END::BIGINT AS nframes,
  CASE WHEN k = 33 THEN 0 ELSE 1000 END::BIGINT AS nonzero_samples, value / 200000 AS clipped_ratio,
  CASE WHEN event_type = 'signup' AND k < 10 THEN 'UNSUPPORTED_CONTAINER' ELSE '' END AS decode_error
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")


def v_clip(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props").withColumn("k", k)
    name = F.concat(
        F.lit("clips/"), F.lpad((1 + F.col("event_id") % 10).cast("string"), 2, "0"), F.lit("_P"),
        F.lpad((F.col("user_id") % 45).cast("string"), 2, "0"), F.lit("_"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HH_mm_ss"), F.lit("_"), F.col("event_id"), F.lit(".wav"))
    return events.select(
        "event_id", name.alias("source_file"),
        F.when(F.col("k") % 10 == 0, 16000).otherwise(44100).alias("samplerate"),
        F.when(F.col("user_id") % 7 == 0, 1).otherwise(2).alias("channels"),
        F.when(F.col("user_id") % 11 == 0, 1).otherwise(2).alias("sample_width_bytes"),
        F.when(F.col("event_type") == "error", 0).otherwise(441000 + (F.col("k") - 50) * 100).cast("bigint").alias("nframes"),
        F.when(F.col("k") == 33, 0).otherwise(1000).cast("bigint").alias("nonzero_samples"),
        (F.col("value") / 200000).alias("clipped_ratio"),
        F.when((F.col("event_type") == "signup") & (F.col("k") < 10), "UNSUPPORTED_CONTAINER").otherwise("").alias("decode_error"))


# -- feature bundles from embeddings: 16 tokens of 4 features over 10 s ---------------

TOKENS, WIDTH, STEP = 16, 4, 0.625
view("v_tok", """
SELECT vec_id, label, k, embedding[4*k+1] AS x0, embedding[4*k+2] AS x1, embedding[4*k+3] AS x2, embedding[4*k+4] AS x3,
  embedding[4*k+1] > -0.2::FLOAT AS valid, k * 0.625::DOUBLE AS s,
  (k + 1) * 0.625::DOUBLE + CASE WHEN label = 5 AND k = 15 THEN 1.0 ELSE 0.0 END AS e,
  CASE WHEN label = 4 THEN k * 0.625::DOUBLE WHEN label = 6 AND k = 7 THEN 6.5 * 0.625::DOUBLE ELSE (k + 0.5::DOUBLE) * 0.625::DOUBLE END AS t,
  CAST(CASE WHEN label = 3 AND k = 0 THEN 1.5 ELSE 1.0 END AS FLOAT) AS fraction,
  CASE WHEN label < 6 THEN 'train' WHEN label < 8 THEN 'val' ELSE 'test' END AS split
FROM embeddings, (SELECT CAST(unnest(range(16)) AS INT) AS k)""")


def v_tok(spark: SparkSession, d: str) -> DataFrame:
    """Bundles with one defect kind for each of the labels 3 to 6."""
    label = F.col("label")
    cells = F.sequence(F.lit(0), F.lit(TOKENS - 1))
    rows = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    centre = lambda k: F.when(label == 4, k * STEP).when((label == 6) & (k == 7), F.lit(6.5 * STEP)).otherwise((k + 0.5) * STEP)
    return rows.select(
        "vec_id", "label", F.when(label < 6, "train").when(label < 8, "val").otherwise("test").alias("split"),
        F.transform(cells, lambda k: F.slice("embedding", k * WIDTH + 1, WIDTH)).alias("x"),
        F.transform(cells, centre).alias("time_s"),
        F.transform(cells, lambda k: F.get("embedding", k * WIDTH) > F.lit(-0.2).cast("float")).alias("valid_mask"),
        F.transform(cells, lambda k: F.struct(
            (k * STEP).alias("start"), ((k + 1) * STEP + F.when((label == 5) & (k == 15), 1.0).otherwise(0.0)).alias("end"))).alias("support_s"),
        F.transform(cells, lambda k: F.when((label == 3) & (k == 0), 1.5).otherwise(1.0).cast("float")).alias("observed_fraction"),
    )


# -- scores ---------------------------------------------------------------------------

def v_kss(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey").withColumn("score", F.lit(0.5) + (F.col("c_custkey") % 19) / 2.0)
