"""Feature bundles from embeddings, against SQL over their exploded tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.numeric import array_mean
from tidegrid.operators import classifier, coverage, intervals
from tidegrid.operators import features as B
from workload.registry import query, rounded, sql
from workload.views import v_tok

DURATION_S = 10.0
_X = ("x0", "x1", "x2", "x3")
_LONG = "UNPIVOT (SELECT vec_id, k, {cols} FROM {src}) ON {names} INTO NAME f VALUE v"


def flat(df, *ids):
    """One row per sample, token and feature."""
    tokens = df.select(*ids, F.posexplode("x").alias("k", "row"))
    return tokens.select(*ids, "k", F.posexplode("row").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


# -- T12-T14 ---------------------------------------------------------------------

@query("rebase_time", sql("v_tok", """
SELECT vec_id, k, round(t + vec_id * 0.5::DOUBLE - (vec_id * 500) / 1000.0::DOUBLE, 6) AS t, round(s + vec_id * 0.5::DOUBLE - (vec_id * 500) / 1000.0::DOUBLE, 6) AS s,
 round(e + vec_id * 0.5::DOUBLE - (vec_id * 500) / 1000.0::DOUBLE, 6) AS e FROM v_tok"""))
def rebase_time(spark, d):
    shift = F.col("vec_id") * 0.5
    session = v_tok(spark, d).withColumns({
        "window_start_ms": F.col("vec_id") * 500, "time_s": F.transform("time_s", lambda t: t + shift),
        "support_s": F.transform("support_s", lambda s: F.struct((s["start"] + shift).alias("start"), (s["end"] + shift).alias("end")))})
    out = B.rebase_time(session)
    zipped = F.arrays_zip(F.col("time_s").alias("t"), F.col("support_s").alias("p"))
    return rounded(out.select("vec_id", F.posexplode(zipped).alias("k", "z")).select(
        "vec_id", "k", F.col("z.t").alias("t"), F.col("z.p.start").alias("s"), F.col("z.p.end").alias("e")))


_TIME = """SELECT vec_id, label, bool_and(coalesce(t > pt, true)) AS rising, bool_and(s >= 0 AND e <= 10 AND e > s AND t > s AND t < e) AS open_ok,
 bool_and(s >= 0 AND e <= 10 + 1e-9 AND e > s AND t >= s AND t < e) AS closed_ok, bool_and(abs(s - k * 0.625::DOUBLE) <= 1e-6 AND abs(e - (k + 1) * 0.625::DOUBLE) <= 1e-6) AS grid_ok,
 bool_and(abs(t - (k + 0.5::DOUBLE) * 0.625::DOUBLE) <= 1e-6) AS centre_ok FROM (SELECT *, lag(t) OVER (PARTITION BY vec_id ORDER BY k) AS pt FROM v_tok) GROUP BY ALL"""


@query("time_support_errors", sql("v_tok", f"""
SELECT vec_id, array_to_string(list_filter([CASE WHEN NOT rising THEN 'time_not_strictly_increasing' END, CASE WHEN NOT open_ok THEN 'outside_sample_support' END], lambda x: x IS NOT NULL), ';') AS open_codes,
 array_to_string(list_filter([CASE WHEN NOT rising THEN 'time_not_strictly_increasing' END, CASE WHEN NOT closed_ok THEN 'outside_sample_support' END], lambda x: x IS NOT NULL), ';') AS closed_codes FROM ({_TIME})"""))
def time_support_errors(spark, d):
    return v_tok(spark, d).select(
        "vec_id", F.array_join(B.time_support_codes(DURATION_S), ";").alias("open_codes"),
        F.array_join(B.time_support_codes(DURATION_S, closed_start=True), ";").alias("closed_codes"))


@query("grid_errors", sql("v_tok", f"""
SELECT vec_id, array_to_string(list_filter([CASE WHEN NOT grid_ok THEN 'support_not_contiguous_grid' END, CASE WHEN NOT centre_ok THEN 'time_not_grid_centers' END], lambda x: x IS NOT NULL), ';') AS codes FROM ({_TIME})"""))
def grid_errors(spark, d):
    return v_tok(spark, d).select("vec_id", F.array_join(B.fixed_grid_codes(16, 0.625), ";").alias("codes"))


# -- R1, R5, R6, T15 on arrays ------------------------------------------------------

@query("bundle_errors", sql("v_tok", """
SELECT vec_id, CASE WHEN NOT rising THEN 'time_increasing' WHEN NOT support_ok THEN 'support' WHEN NOT centre_ok THEN 'centre' WHEN NOT fraction_ok THEN 'fraction' ELSE '' END AS code FROM (
 SELECT vec_id, bool_and(coalesce(t > pt, true)) AS rising, bool_and(s >= 0 AND e <= 10 + 1e-9 AND e > s) AS support_ok, bool_and(t >= s AND t < e) AS centre_ok, bool_and(fraction BETWEEN 0 AND 1) AS fraction_ok
 FROM (SELECT *, lag(t) OVER (PARTITION BY vec_id ORDER BY k) AS pt FROM v_tok) GROUP BY vec_id)"""))
def bundle_errors(spark, d):
    return v_tok(spark, d).select("vec_id", B.first_bundle_error(B.bundle_rules(DURATION_S, (16, 4))).alias("code"))


@query("telemetry_value_rules", sql("v_tok", """
SELECT label, count(*) FILTER (WHERE NOT a) AS angle_range, count(*) FILTER (WHERE NOT g) AS gear_not_whole, count(*) FILTER (WHERE NOT c) AS raw_coverage FROM (
 SELECT vec_id, label, bool_and(greatest(abs(x0), abs(x1), abs(x2), abs(x3)) * 4 <= 1 + 1e-6) AS a, bool_and(NOT valid OR k < 15 OR label = 0) AS g, abs(avg(CAST(fraction AS DOUBLE)) - 1) <= 1e-6 AS c FROM v_tok GROUP BY ALL) GROUP BY label"""))
def telemetry_value_rules(spark, d):
    # four features become nine: six angles (scaled), two levels and a gear that is a half in the last token unless the label is 0
    wide = v_tok(spark, d).withColumn("x", F.transform("x", lambda r, k: F.concat(
        F.transform(r, lambda v: (v * 4).cast("float")), F.slice(F.transform(r, lambda v: (v * 4).cast("float")), 1, 2), F.slice(r, 1, 2),
        F.array(F.when((k == 15) & (F.col("label") != 0), 2.5).otherwise(2.0).cast("float"))))).withColumn("raw_coverage_ratio", F.lit(1.0))
    codes = wide.select("label", B.telemetry_value_codes().alias("c"))
    return codes.groupBy("label").agg(*[
        F.count_if(F.array_contains("c", n)).alias(n) for n in ("angle_range", "gear_not_whole", "raw_coverage")])


@query("mask_ratio", sql("v_tok", """
SELECT vec_id, array_to_string(list_filter([CASE WHEN NOT any_valid THEN 'no_valid_token' END, CASE WHEN abs(r - 0.9375::DOUBLE) > 1e-6 THEN 'valid_ratio' END, CASE WHEN NOT f THEN 'observed_fraction' END], lambda x: x IS NOT NULL), ';') AS codes, round(r, 6) AS ratio
FROM (SELECT vec_id, bool_or(valid) AS any_valid, avg(CAST(valid AS INT)) AS r, bool_and(fraction BETWEEN 0 AND 1) AS f FROM v_tok GROUP BY vec_id)"""))
def mask_ratio(spark, d):
    rows = v_tok(spark, d).withColumn("valid_ratio", F.lit(0.9375))
    return rounded(rows.select("vec_id", F.array_join(B.mask_ratio_codes(), ";").alias("codes"), B.mask_ratio(F.col("valid_mask")).alias("ratio")))


@query("covered_seconds", sql("v_tok", """
SELECT vec_id, round(least(1.0, sum(greatest(0, e - greatest(s, coalesce(reach, s)))) / 10), 6) AS ratio FROM (
 SELECT *, max(e) OVER (PARTITION BY vec_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_tok WHERE valid) GROUP BY vec_id
UNION ALL SELECT vec_id, 0 FROM v_tok GROUP BY vec_id HAVING NOT bool_or(valid)"""))
def covered_seconds(spark, d):
    return rounded(v_tok(spark, d).select("vec_id", intervals.coverage_ratio(F.col("support_s"), F.col("valid_mask")).alias("ratio")))


# -- A25-A27, A31, R2-R4 --------------------------------------------------------------

_TRAIN = f"SELECT * FROM ({_LONG.format(cols=', '.join(_X), src='v_tok', names=', '.join(_X))}) JOIN (SELECT vec_id, k, valid, split FROM v_tok) USING (vec_id, k)"
_STATS = f"""SELECT CAST(right(f, 1) AS INT) AS feature, avg(CAST(v AS DOUBLE)) AS mean, var_pop(CAST(v AS DOUBLE)) AS variance, count(*) AS valid_tokens
FROM ({_TRAIN}) WHERE valid AND split = 'train' GROUP BY 1"""


@query("standardizer_fit", sql("v_tok", f"""
SELECT feature, round(mean, 6) AS mean, round(CASE WHEN variance <= 1e-12 THEN 1 ELSE sqrt(variance) END, 6) AS scale, variance <= 1e-12 AS zero_variance, valid_tokens FROM ({_STATS})"""))
def standardizer_fit(spark, d):
    return rounded(B.fit_statistics(v_tok(spark, d)))


@query("standardize", sql("v_tok", f"""
WITH st AS (SELECT feature, CAST(mean AS FLOAT) AS m, CAST(CASE WHEN variance <= 1e-12 THEN 1 ELSE sqrt(variance) END AS FLOAT) AS s FROM ({_STATS}))
SELECT vec_id, k, feature, round(CAST(CASE WHEN valid THEN (v - m) / s ELSE 0 END AS DOUBLE), 4) AS value FROM ({_TRAIN}) t JOIN st ON st.feature = CAST(right(t.f, 1) AS INT)"""))
def standardize(spark, d):
    rows = v_tok(spark, d)
    mean, scale = B.state_columns(B.fit_statistics(rows))
    return rounded(flat(B.standardize(rows, mean, scale), "vec_id"), 4)


@query("masked_mean", sql("v_tok", f"""
SELECT vec_id, CAST(right(f, 1) AS INT) AS feature, round(avg(CAST(v AS DOUBLE)), 6) AS value FROM ({_TRAIN}) WHERE valid GROUP BY ALL"""))
def masked_mean(spark, d):
    out = B.masked_mean_pool(v_tok(spark, d))
    return rounded(out.select("vec_id", F.posexplode("pooled").alias("feature", "value")))


@query("mean_max_last", sql("v_tok", f"""
WITH t AS (SELECT vec_id, CAST(right(f, 1) AS INT) AS f, k, CAST(v AS DOUBLE) AS v FROM ({_TRAIN}) WHERE valid)
SELECT vec_id, f AS position, round(avg(v), 6) AS value FROM t GROUP BY ALL UNION ALL SELECT vec_id, f + 4, round(max(v), 6) FROM t GROUP BY vec_id, f
UNION ALL SELECT vec_id, f + 8, round(arg_max(v, k), 6) FROM t GROUP BY vec_id, f"""))
def mean_max_last(spark, d):
    out = B.masked_mean_max_last(v_tok(spark, d))
    return rounded(out.select("vec_id", F.posexplode("pooled").alias("position", "value")))


def ragged(spark, d):
    """Samples cut to 7 + label tokens, so that padding has work to do."""
    length = F.lit(7) + F.col("label")
    rows = v_tok(spark, d)
    return rows.withColumns({n: F.slice(n, 1, length) for n in ("x", "time_s", "valid_mask", "support_s", "observed_fraction")})


@query("pad_right", sql("v_tok", f"""
SELECT vec_id, k, round(CASE WHEN k < 7 + label AND valid THEN CAST(x0 AS DOUBLE) ELSE 0 END, 6) AS x0, round(CASE WHEN k < 7 + label AND valid THEN CAST(x3 AS DOUBLE) ELSE 0 END, 6) AS x3,
 valid AND k < 7 + label AS valid, CASE WHEN k < 7 + label THEN t ELSE 0 END AS t, CASE WHEN k < 7 + label THEN e ELSE 0 END AS e, CAST(CASE WHEN k < 7 + label THEN fraction ELSE 0 END AS DOUBLE) AS fraction
FROM v_tok WHERE k < (SELECT max(7 + label) FROM v_tok)"""))
def pad_right(spark, d):
    out = B.pad_right(ragged(spark, d))
    zipped = F.arrays_zip("x", "time_s", "valid_mask", "support_s", "observed_fraction")
    rows = out.select("vec_id", F.posexplode(zipped).alias("k", "z"))
    return rounded(rows.select(
        "vec_id", "k", F.get("z.x", F.lit(0)).alias("x0"), F.get("z.x", F.lit(3)).alias("x3"), F.col("z.valid_mask").alias("valid"),
        F.col("z.time_s").alias("t"), F.col("z.support_s.end").alias("e"), F.col("z.observed_fraction").alias("fraction")))


@query("model_input", sql("v_tok", """
SELECT vec_id AS sample_id, count(*) AS tokens, count(*) FILTER (WHERE valid) AS valid_tokens, round(sum(t), 6) AS time_total FROM v_tok WHERE split <> 'test' GROUP BY vec_id"""))
def model_input(spark, d):
    rows = v_tok(spark, d).withColumn("sample_id", F.col("vec_id"))
    both = B.model_input(rows, rows.where("split <> 'test'"))
    return rounded(both.select(
        "sample_id", F.size("video.x").cast("bigint").alias("tokens"), F.size(F.filter("can.valid_mask", lambda v: v)).cast("bigint").alias("valid_tokens"),
        F.aggregate("can.time_s", F.lit(0.0), lambda a, v: a + v).alias("time_total")))


@query("feature_dims", sql("v_tok", "SELECT split, 4 AS min_dim, 4 AS max_dim, count(DISTINCT vec_id) AS samples, true AS consistent FROM v_tok GROUP BY split"))
def feature_dims(spark, d):
    return coverage.feature_dims(v_tok(spark, d), ["split"])


@query("mean_observed", sql("v_tok", "SELECT vec_id, round(avg(CAST(fraction AS DOUBLE)), 6) AS mean FROM v_tok GROUP BY vec_id"))
def mean_observed(spark, d):
    return rounded(v_tok(spark, d).select("vec_id", array_mean(F.col("observed_fraction")).alias("mean")))


# -- M6 -----------------------------------------------------------------------------------

@query("pooled_classifier")
def pooled_classifier(spark, d):
    rows = v_tok(spark, d).withColumn("label_id", F.col("label") % 3).withColumnRenamed("vec_id", "sample_id")
    return classifier.pooled_classifier(rows)


@query("pooled_classifier_facts", sql("v_tok", """
SELECT split, label % 3 AS label_id, count(DISTINCT vec_id) AS n, count(DISTINCT vec_id) AS sound FROM v_tok GROUP BY ALL"""))
def pooled_classifier_facts(spark, d):
    """Every row scored once; its probabilities add up to one and the prediction is their largest."""
    scored = pooled_classifier(spark, d)
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    sound = (F.abs(total - 1) < 1e-9) & (F.get(p, F.col("prediction")) == F.array_max(p)) & (F.size(p) == 3)
    return scored.groupBy("split", "label_id").agg(
        F.count_distinct("sample_id").alias("n"), F.count_if(sound).alias("sound"))
