"""Column functions over text built from the tables' own keys, dates and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids, parsing
from tidegrid.functions.numeric import circular, near, same_value
from tidegrid.functions.text import text_policy_codes
from tidegrid.operators.ordering import fatigue_subjects
from workload.registry import query, rounded, sql, table, view
from workload.views import LETTERS, SQL_LETTERS, letter, sql_kss_class, sql_kss_id, v_clip, v_kss, v_tel

# -- P1-P3, P5, P6: clip names ---------------------------------------------------

view("v_video_name", r"""
SELECT o_orderkey AS k, (CASE WHEN o_custkey % 3 = 0 THEN 'set\' ELSE 'set/' END) || lpad(CAST(o_custkey % 11 AS VARCHAR), 2, '0') || '_p' ||
  lpad(CAST(o_orderkey % 45 AS VARCHAR), 2, '0') || '_' || strftime(o_orderdate, '%Y%m%d') || '_09_31_' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '_' ||
  o_custkey || (CASE o_orderstatus WHEN 'F' THEN '.MP4' WHEN 'O' THEN '.avi' ELSE '.mkv' END) AS name FROM orders""")


def v_video_name(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return orders.select(F.col("o_orderkey").alias("k"), F.concat(
        F.when(F.col("o_custkey") % 3 == 0, "set\\").otherwise("set/"), two(F.col("o_custkey") % 11), F.lit("_P"),
        two(F.col("o_orderkey") % 45), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_09_31_"),
        two(F.col("o_orderkey") % 60), F.lit("_"), F.col("o_custkey"),
        F.when(F.col("o_orderstatus") == "F", ".MP4").when(F.col("o_orderstatus") == "O", ".avi").otherwise(".mkv")).alias("name"))


_NAME = r"""regexp_extract(replace(name, '\', '/'), '([^/]*)\z', 1)"""
_PARTS = "regexp_extract(base, '^(\\d{2})_(P\\d{2})_(\\d{8})_(\\d{2})_(\\d{2})_(\\d{2})_(\\d+)\\.([A-Za-z0-9]+)\\z', ['task','subject','date','h','m','s','takeover','ext'])"


@query("clip_names", sql("v_clip", rf"""
SELECT event_id, CAST(p.task AS INT) AS task_code, p.subject AS subject_id, p.date AS date, p.h || p.m || p.s AS start_hhmmss,
  CAST(p.takeover AS BIGINT) AS takeover_decisec, regexp_replace(base, '\.[^.]*$', '') AS stem, lower(p.ext) AS extension,
  p.subject || '_' || p.date || '_' || p.h || p.m || '_' || p.s AS session_id, CAST(p.task AS INT) - 1 AS label_id,
  (['No task','Watching video','Playing game','Messaging','Phone call','Listening to radio','Reading','Eating','Chatting with passenger'])[CAST(p.task AS INT)] AS label_class
FROM (SELECT *, {_PARTS} AS p FROM (SELECT *, {_NAME.replace('name', 'source_file')} AS base FROM v_clip))
WHERE p.task BETWEEN '01' AND '09' AND regexp_full_match(p.subject, 'P(0[1-9]|[1-3][0-9]|40)')"""))
def clip_names(spark, d):
    rows = v_clip(spark, d).select("event_id", ids.parse_clip_name(F.col("source_file")).alias("p")).where("p is not null")
    return rows.select(
        "event_id", "p.*", ids.clip_session_id(F.col("p.subject_id"), F.col("p.date"), F.col("p.start_hhmmss")).alias("session_id"),
        ids.nine_class_id(F.col("p.task_code")).alias("label_id"), ids.nine_class_name(F.col("p.task_code")).alias("label_class"))


@query("video_clip_names", sql("v_video_name", rf"""
SELECT k, CAST(p.task AS INT) AS task_code, p.subject AS subject_id, p.date || '' AS date, CAST(p.takeover AS BIGINT) AS takeover_decisec, lower(p.ext) AS extension,
  p.subject || '_' || p.date || '_' || p.h || p.m || '_' || p.s AS session_id,
  CAST(list_position([1,3,4,5,7,8], CAST(p.task AS INT)) - 1 AS INT) AS label_id,
  (['No task','Playing game','Messaging','Phone call','Reading','Eating'])[list_position([1,3,4,5,7,8], CAST(p.task AS INT))] AS label_class
FROM (SELECT *, {_PARTS} AS p FROM (SELECT k, {_NAME.replace('(name', "(replace(name, '_p', '_P')")} AS base FROM v_video_name))
WHERE p.task IN ('01','03','04','05','07','08') AND lower(p.ext) IN ('mp4','avi','mov') AND regexp_full_match(p.subject, 'P(0[1-9]|[1-3][0-9]|40)')"""))
def video_clip_names(spark, d):
    rows = v_video_name(spark, d).select("k", ids.parse_video_clip_name(F.col("name")).alias("p")).where("p is not null")
    return rows.select(
        "k", "p.task_code", "p.subject_id", "p.date", "p.takeover_decisec", "p.extension",
        ids.clip_session_id(F.col("p.subject_id"), F.col("p.date"), F.col("p.start_hhmmss")).alias("session_id"),
        ids.six_class_id(F.col("p.task_code")).alias("label_id"), ids.six_class_name(F.col("p.task_code")).alias("label_class"))


# -- P4, P18: scores -----------------------------------------------------------------

@query("kss_labels", f"""
SELECT c_custkey, CASE WHEN s BETWEEN 1 AND 9 THEN {sql_kss_id('s')} END AS label_id, CASE WHEN s BETWEEN 1 AND 9 THEN {sql_kss_class('s')} END AS label_class
FROM (SELECT c_custkey, 0.5 + (c_custkey % 19) / 2.0::DOUBLE AS s FROM customer)""")
def kss_labels(spark, d):
    score = F.col("score")
    return v_kss(spark, d).select("c_custkey", ids.kss_label_id(score).alias("label_id"), ids.kss_label_class(score).alias("label_class"))


@query("same_value", """
WITH t AS (SELECT p_retailprice AS a, p_retailprice + p_size / 1e7::DOUBLE AS b, p_size AS i, p_name AS n, p_brand AS r FROM part)
SELECT i AS p_size, count(*) FILTER (WHERE abs(a - b) <= 1e-8 + 1e-5 * abs(b)) AS relative, count(*) FILTER (WHERE abs(a - b) <= 1e-6) AS loose,
  count(*) FILTER (WHERE abs(a - b) <= 1e-9) AS tight, count(*) AS same_int, 0::BIGINT AS same_text FROM t GROUP BY i""")
def same_value_query(spark, d):
    a = F.col("p_retailprice")
    b = a + F.col("p_size") / 1e7
    return table(spark, d, "part", "p_retailprice", "p_size", "p_name", "p_brand").groupBy("p_size").agg(
        F.count_if(same_value(a, b, "score")).alias("relative"),
        F.count_if(near(a, b, 1e-6)).alias("loose"), F.count_if(near(a, b, 1e-9)).alias("tight"),
        F.count_if(same_value(F.col("p_size"), F.col("p_size").cast("string"), "int")).alias("same_int"),
        F.count_if(same_value(F.col("p_name"), F.col("p_brand"), "text")).alias("same_text"))


# -- P7-P9, P26: identifiers -----------------------------------------------------------

@query("session_from_file", f"""
SELECT count(*) AS n, session_id, label_session FROM (
 SELECT CASE WHEN t IN ('A','D') THEN s || '_' || t END AS session_id,
   CASE t WHEN 'A' THEN s || '_A' WHEN 'D' THEN s || '_D' END AS label_session
 FROM (SELECT ({SQL_LETTERS})[o_custkey % 16 + 1] AS s, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'D' ELSE 'X' END AS t FROM orders)) GROUP BY ALL""")
def session_from_file(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "D").otherwise("X")
    s = letter(F.col("o_custkey"))
    path = F.concat(F.lit("CSV_Files/"), s, F.lit("/"), s, F.lit("_Telemetry_"), kind, F.lit(".csv"))
    word = F.concat(s, F.when(kind == "A", "_Alert").when(kind == "D", "_Drowsy").otherwise("_Other"))
    return table(spark, d, "orders", "o_custkey", "o_orderstatus").select(
        ids.session_from_file(path).alias("session_id"), ids.session_from_label(word).alias("label_session"),
    ).groupBy("session_id", "label_session").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_ids", f"""
SELECT o_orderkey, printf('ULDD_%s_%09d_%09d', s || '_A', b, b + 30000) AS window_id, printf('ULDD_%s_%s_%09d_%09d', s, 'A', b, b + 30000) AS pair_id,
  printf('video30__%s__%010d_%010d', s || '_A', b, b + 30000) AS video_id,
  list_aggregate(list_transform(range(6), lambda i: printf('video5__%s_IR_%013d_%013d', s || '_A', (b + i * 5000) * 1000, (b + i * 5000 + 5000) * 1000)), 'string_agg', '|') AS child_ids
FROM (SELECT o_orderkey, ({SQL_LETTERS})[o_custkey % 16 + 1] AS s, o_orderkey * 30000 AS b FROM orders)""")
def canonical_ids(spark, d):
    s, start = F.col("s"), F.col("o_orderkey") * 30_000
    session = F.concat(s, F.lit("_A"))
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("s", letter(F.col("o_custkey")))
    return rows.select(
        "o_orderkey", ids.window_id(session, start, start + 30_000).alias("window_id"),
        ids.pair_id(s, session, start, start + 30_000).alias("pair_id"),
        ids.video_window_id(session, start, start + 30_000).alias("video_id"),
        F.array_join(ids.video_child_ids(session, start), "|").alias("child_ids"))


@query("named_features", """
SELECT vec_id, label, printf('video_feature_%03d', i) AS name, embedding[i + 1]::DOUBLE AS value
FROM embeddings, (SELECT unnest(range(64)) AS i)""")
def named_features(spark, d):
    rows = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    names = ids.feature_names(F.size("embedding"))
    zipped = F.arrays_zip(names.alias("name"), F.col("embedding").alias("value"))
    return rows.select("vec_id", "label", F.inline(zipped)).withColumn("value", F.col("value").cast("double"))


@query("id_patterns", sql("v_clip", """
SELECT count(*) FILTER (WHERE regexp_full_match(regexp_extract(source_file, '_(P\\d+)_', 1), 'P(0[1-9]|[1-3][0-9]|40)')) AS subjects,
  0::BIGINT AS sessions, count(*) FILTER (WHERE regexp_full_match(source_file, '[A-Za-z0-9_.-]+')) AS requests, count(*) AS rows FROM v_clip""".replace("\\\\", "\\")))
def id_patterns(spark, d):
    rows = v_clip(spark, d)
    subject = F.regexp_extract("source_file", r"_(P[0-9]+)_", 1)
    return rows.agg(
        F.count_if(ids.full_match(subject, ids.SUBJECT)).alias("subjects"),
        F.count_if(ids.full_match(F.col("source_file"), ids.CLIP_SESSION)).alias("sessions"),
        F.count_if(ids.full_match(F.col("source_file"), ids.REQUEST_ID)).alias("requests"), F.count(F.lit(1)).alias("rows"))


# -- P10-P17: strict parsers ------------------------------------------------------------

@query("strict_bool", """
SELECT o_orderpriority, count(*) FILTER (WHERE lower(trim(t)) IN ('true','1')) AS yes, count(*) FILTER (WHERE lower(trim(t)) IN ('false','0')) AS no,
  count(*) FILTER (WHERE lower(trim(t)) NOT IN ('true','1','false','0')) AS rejected
FROM (SELECT *, ([' TRUE ','1','0','False','yes','t',''])[o_custkey % 7 + 1] AS t FROM orders) GROUP BY o_orderpriority""")
def strict_bool(spark, d):
    words = F.array(*[F.lit(w) for w in (" TRUE ", "1", "0", "False", "yes", "t", "")])
    value = parsing.strict_bool(F.get(words, (F.col("o_custkey") % 7).cast("int")))
    return table(spark, d, "orders", "o_custkey", "o_orderpriority").groupBy("o_orderpriority").agg(
        F.count_if(value).alias("yes"), F.count_if(~value).alias("no"), F.count_if(value.isNull()).alias("rejected"))


@query("strict_int", r"""
SELECT o_orderpriority, count(v) AS accepted, CAST(sum(v) AS BIGINT) AS total FROM (
 SELECT o_orderpriority, CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN CAST(t AS BIGINT) END AS v FROM (
  SELECT *, (['','-','+',' '])[o_custkey % 4 + 1] || o_orderkey || (['','.0'])[o_orderkey % 2 + 1] AS t FROM orders)) GROUP BY o_orderpriority""")
def strict_int(spark, d):
    lead = F.get(F.array(*[F.lit(w) for w in ("", "-", "+", " ")]), (F.col("o_custkey") % 4).cast("int"))
    tail = F.get(F.array(F.lit(""), F.lit(".0")), (F.col("o_orderkey") % 2).cast("int"))
    value = parsing.strict_int(F.concat(lead, F.col("o_orderkey"), tail))
    return table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority").groupBy("o_orderpriority").agg(
        F.count(value).alias("accepted"), F.sum(value).alias("total"))


_PATHS = ("a/b.npz", "/abs/x", "C:/x", "C:\\x", "..\\up", "a/../b", "", "a..b/c", "\\\\host\\share", "ok\\..x", "./here")
_SQL_PATHS = "[" + ",".join("'" + p + "'" for p in _PATHS) + "]"


@query("path_safety", rf"""
SELECT p_size, count(*) FILTER (WHERE length(t) > 0 AND NOT regexp_matches(t, '^(.:|[\\/])') AND NOT list_contains(string_split(replace(t, '\', '/'), '/'), '..')) AS safe,
  count(*) FILTER (WHERE length(t) > 0 AND NOT starts_with(t, '/') AND NOT list_contains(string_split(t, '/'), '..')) AS safe_posix
FROM (SELECT p_size, ({_SQL_PATHS})[p_partkey % {len(_PATHS)} + 1] AS t FROM part) GROUP BY p_size""")
def path_safety(spark, d):
    path = F.get(F.array(*[F.lit(p) for p in _PATHS]), (F.col("p_partkey") % len(_PATHS)).cast("int"))
    return table(spark, d, "part", "p_partkey", "p_size").groupBy("p_size").agg(
        F.count_if(parsing.is_safe_relative_path(path)).alias("safe"),
        F.count_if(parsing.is_safe_relative_path(path, windows=False)).alias("safe_posix"))


@query("source_stems", r"""
SELECT page_id, array_to_string(list_transform(e, lambda v: regexp_replace(regexp_extract(replace(v, '\', '/'), '([^/]*)\z', 1), '\.[^.]*\z', '')), '|') AS stems
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN [url] ELSE [url, 'x\y.' || page_id || '.wav'] END AS e FROM pages)""")
def source_stems(spark, d):
    second = F.concat(F.lit("x\\y."), F.col("page_id"), F.lit(".wav"))
    text = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.to_json(F.array(F.col("url"), second)))
    return table(spark, d, "pages", "page_id", "url").select(
        "page_id", F.array_join(parsing.source_stems(text), "|").alias("stems"))


_MASK = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '::valid_mask' WHEN 1 THEN url || '::mask' WHEN 2 THEN url ELSE 'a::' || url || '::valid_mask' END AS t FROM pages"


@query("mask_reference", rf"""
SELECT page_id, CASE WHEN ends_with(t, '::valid_mask') THEN left(t, length(t) - 12) END AS path FROM ({_MASK})""")
def mask_reference(spark, d):
    kind, url = F.col("page_id") % 4, F.col("url")
    text = (F.when(kind == 0, F.concat(url, F.lit("::valid_mask"))).when(kind == 1, F.concat(url, F.lit("::mask")))
            .when(kind == 2, url).otherwise(F.concat(F.lit("a::"), url, F.lit("::valid_mask"))))
    return table(spark, d, "pages", "page_id", "url").select("page_id", parsing.mask_path(text).alias("path"))


@query("parse_shape", r"""
SELECT p_partkey, CASE WHEN regexp_full_match(t, '\s*\[\s*[1-9][0-9]*\s*,\s*[1-9][0-9]*\s*\]\s*') THEN CAST(trim(string_split(translate(t, '[]', ''), ',')[1]) AS INT) END AS rows,
  CASE WHEN regexp_full_match(t, '\s*\[\s*[1-9][0-9]*\s*,\s*[1-9][0-9]*\s*\]\s*') THEN CAST(trim(string_split(translate(t, '[]', ''), ',')[2]) AS INT) END AS columns
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '[' || p_size || ',9]' WHEN 1 THEN '[ ' || p_size || ' , 96 ]' WHEN 2 THEN '[' || p_size || ']'
  WHEN 3 THEN '[' || p_size || ',0]' ELSE '[6.0,' || p_size || ']' END AS t FROM part)""")
def parse_shape(spark, d):
    kind, size = F.col("p_partkey") % 5, F.col("p_size")
    text = (F.when(kind == 0, F.concat(F.lit("["), size, F.lit(",9]"))).when(kind == 1, F.concat(F.lit("[ "), size, F.lit(" , 96 ]")))
            .when(kind == 2, F.concat(F.lit("["), size, F.lit("]"))).when(kind == 3, F.concat(F.lit("["), size, F.lit(",0]")))
            .otherwise(F.concat(F.lit("[6.0,"), size, F.lit("]"))))
    dims = parsing.positive_shape(text)
    return table(spark, d, "part", "p_partkey", "p_size").select(
        "p_partkey", F.get(dims, F.lit(0)).alias("rows"), F.get(dims, F.lit(1)).alias("columns"))


@query("hash_and_version_text", r"""
SELECT lang, count(*) FILTER (WHERE regexp_full_match(lower(trim(h)), '[0-9a-f]{64}')) AS hashes, count(*) FILTER (WHERE lower(source) NOT IN ('latest','to_be_filled','')) AS versioned
FROM (SELECT *, CASE WHEN quality = 1 THEN ' ' || upper(sha256(text)) || ' ' WHEN quality = 0 THEN sha256(text) || '0' ELSE source END AS h
  FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang""")
def hash_and_version_text(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text", "lang", "source").join(
        table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    digest = F.sha2("text", 256)
    text = (F.when(F.col("quality") == 1, F.concat(F.lit(" "), F.upper(digest), F.lit(" ")))
            .when(F.col("quality") == 0, F.concat(digest, F.lit("0"))).otherwise(F.col("source")))
    return rows.groupBy("lang").agg(
        F.count_if(parsing.is_sha256(text)).alias("hashes"), F.count_if(parsing.is_versioned(F.col("source"))).alias("versioned"))


# -- P19, P24, split dimension -------------------------------------------------------------

@query("circular_encode", sql("v_tel", """
SELECT session_id, round(avg(sin(radians(heading_deg))), 6) AS heading_sin, round(avg(cos(radians(heading_deg))), 6) AS heading_cos,
  round(min(sin(radians(pitch_deg))), 6) AS pitch_sin, round(max(cos(radians(roll_deg))), 6) AS roll_cos FROM v_tel GROUP BY session_id"""))
def circular_encode(spark, d):
    heading, pitch, roll = (circular(F.col(c)) for c in ("heading_deg", "pitch_deg", "roll_deg"))
    return rounded(v_tel(spark, d).groupBy("session_id").agg(
        F.avg(heading[0]).alias("heading_sin"), F.avg(heading[1]).alias("heading_cos"),
        F.min(pitch[0]).alias("pitch_sin"), F.max(roll[1]).alias("roll_cos")))


_POLICY = r"""list_filter([
 CASE WHEN octet_length(encode(t)) > 100000 THEN 'oversize' END,
 CASE WHEN regexp_matches(t, '(^|[^A-Za-z0-9])[A-Za-z]:[\\/][^\s"'']+|/(home|Users)/[^\s"'']+') THEN 'machine_path' END,
 CASE WHEN regexp_matches(t, '(gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{32,}|-----BEGIN ([A-Z]+ )?PRIVATE KEY-----)') THEN 'access_token' END,
 CASE WHEN j AND NOT json_valid(t) THEN 'invalid_json' END], lambda v: v IS NOT NULL)"""


@query("text_policy_scan", rf"""
WITH t AS (SELECT 'documents' AS origin, doc_id AS id, text AS t, false AS j FROM documents UNION ALL SELECT 'pages', page_id, url || ' ' || html, false FROM pages
 UNION ALL SELECT 'events', event_id, CASE WHEN event_type = 'error' THEN props || ',' ELSE props END, true FROM events),
c AS (SELECT origin, id, {_POLICY} AS codes FROM t)
SELECT origin, code, count(*) AS n FROM (SELECT origin, unnest(codes) AS code FROM c) GROUP BY ALL""")
def text_policy_scan(spark, d):
    docs = table(spark, d, "documents", "text").select(F.lit("documents").alias("origin"), F.col("text").alias("t"), F.lit(False).alias("j"))
    pages = table(spark, d, "pages", "url", "html").select(F.lit("pages").alias("origin"), F.concat_ws(" ", "url", "html").alias("t"), F.lit(False).alias("j"))
    props = F.when(F.col("event_type") == "error", F.concat("props", F.lit(","))).otherwise(F.col("props"))
    events = table(spark, d, "events", "event_type", "props").select(F.lit("events").alias("origin"), props.alias("t"), F.lit(True).alias("j"))
    rows = docs.unionByName(pages).unionByName(events)
    codes = text_policy_codes(F.col("t"), F.col("j"), 100_000)
    return rows.select("origin", F.explode(codes).alias("code")).groupBy("origin", "code").agg(F.count(F.lit(1)).alias("n"))


@query("fixed_split_of_customers", f"""
SELECT s AS subject_id, CASE WHEN list_position({SQL_LETTERS}, s) <= 10 THEN 'train' WHEN list_position({SQL_LETTERS}, s) <= 13 THEN 'val' ELSE 'test' END AS split, count(*) AS customers
FROM (SELECT ({SQL_LETTERS})[c_custkey % 16 + 1] AS s FROM customer) GROUP BY ALL""")
def fixed_split_of_customers(spark, d):
    rows = table(spark, d, "customer", "c_custkey").select(letter(F.col("c_custkey")).alias("subject_id"))
    counted = rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("customers"))
    return fatigue_subjects(spark).join(counted, "subject_id")


assert len(LETTERS) == sum(len(v) for v in C.FATIGUE_SUBJECTS.values())
