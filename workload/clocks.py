"""Clock audit, resampling and interval operators over events and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import coverage, grid, intervals, jobs
from tidegrid.operators import telemetry as T
from tidegrid.plans.medians import exact_median
from tidegrid.session import stage
from workload.registry import query, rounded, sql, table, view
from workload.views import EVENT_JUMP_S, EVENT_TOKENS, WINDOW_H_MS, v_clip, v_session_labels, v_sup, v_tel

S = EVENT_TOKENS
# numbers with a point are decimals in SQL, so the lengths are marked as doubles
TOKENS, TOKEN_S, WINDOW_S = S.tokens, f"{S.token_s}::DOUBLE", f"{S.window_s}::DOUBLE"
LIMIT_S = f"{S.max_gap_s}::DOUBLE"

# -- T2, T3, T4, A19 -----------------------------------------------------------------

view("v_step", "SELECT *, timestamp_us - lag(timestamp_us) OVER (PARTITION BY session_id ORDER BY row_no) AS step FROM v_tel", "v_tel")
view("v_audit0", f"""
SELECT session_id, count(*) AS source_rows, min(timestamp_us) AS start_us, count(*) FILTER (WHERE step <= 0 OR step / 1e6::DOUBLE > {EVENT_JUMP_S}) AS anomaly_count,
 median(step) FILTER (WHERE step > 0) / 1e6::DOUBLE AS median_dt_s, min(row_no) FILTER (WHERE step <= 0 OR step / 1e6::DOUBLE > {EVENT_JUMP_S}) AS bad FROM v_step GROUP BY session_id""", "v_step")
view("v_audit", """
SELECT a.*, bad - 1 AS first_anomaly_index, bad + 1 AS first_anomaly_row, (t.timestamp_us - a.start_us) / 1e6::DOUBLE AS first_anomaly_time_s,
 coalesce((t.timestamp_us - a.start_us) / 1e6::DOUBLE, 'inf'::DOUBLE) AS trust_end_s, CASE WHEN anomaly_count = 0 THEN 'stable' ELSE 'pending_after_discontinuity' END AS clock_status,
 CASE WHEN source_rows < 2 THEN 'fewer_than_two_rows' WHEN median_dt_s IS NULL THEN 'no_positive_steps' ELSE '' END AS clock_error
FROM v_audit0 a LEFT JOIN v_tel t ON t.session_id = a.session_id AND t.row_no = a.bad - 1""", "v_audit0", "v_tel")


def steps(spark, d):
    """The rows with their steps, written once: every later step reads them again."""
    return stage(T.clock_steps(v_tel(spark, d)), "steps")


def audited(spark, d):
    rows = steps(spark, d)
    return rows, stage(T.clock_audit(rows, EVENT_JUMP_S), "audit")


def audit(spark, d):
    return audited(spark, d)[1]


@query("clock_audit", sql("v_audit", """
SELECT session_id, source_rows, start_us, anomaly_count, round(median_dt_s, 9) AS median_dt_s, first_anomaly_index, first_anomaly_row,
 round(first_anomaly_time_s, 6) AS first_anomaly_time_s, round(CASE WHEN isinf(trust_end_s) THEN -1 ELSE trust_end_s END, 6) AS trust_end_s, clock_status, clock_error FROM v_audit"""))
def clock_audit(spark, d):
    out = T.clock_audit(v_tel(spark, d), EVENT_JUMP_S)
    # a middle of two microsecond steps has half a microsecond: nine digits hold it
    return rounded(out.withColumn("trust_end_s", F.when(F.col("trust_end_s") == float("inf"), -1.0).otherwise(F.col("trust_end_s"))), 9)


@query("clock_anomalies", sql("v_step", f"""
SELECT session_id, row_no - 1 AS anomaly_index, row_no + 1 AS anomaly_row, step / 1e6::DOUBLE AS delta_s FROM v_step WHERE step <= 0 OR step / 1e6::DOUBLE > {EVENT_JUMP_S}"""))
def clock_anomalies(spark, d):
    return T.clock_anomalies(v_tel(spark, d), EVENT_JUMP_S)


view("v_trust", """
SELECT t.*, timestamp_us - start_us AS relative_us, (timestamp_us - start_us) / 1e6::DOUBLE AS time_s FROM v_tel t JOIN v_audit USING (session_id)
WHERE first_anomaly_index IS NULL OR row_no <= first_anomaly_index""", "v_tel", "v_audit")


def trusted(spark, d):
    return T.trusted_prefix(*audited(spark, d))


@query("trusted_prefix", sql("v_trust", "SELECT session_id, row_no, relative_us, round(time_s, 6) AS time_s FROM v_trust"))
def trusted_prefix(spark, d):
    return rounded(trusted(spark, d).select("session_id", "row_no", "relative_us", "time_s"))


view("v_gate", """
SELECT g.*, trust_end_s, clock_status, CASE WHEN trust_end_s IS NULL THEN 'SOURCE_TELEMETRY_MISSING'
 WHEN window_end_ms / 1000.0::DOUBLE > trust_end_s + 1e-9 THEN 'CLOCK_MAPPING_PENDING_AFTER_DISCONTINUITY' ELSE 'open' END AS gate FROM v_grid g LEFT JOIN v_audit USING (session_id)""", "v_grid", "v_audit")


def lattice(spark, d):
    return grid.candidate_grid(v_session_labels(spark, d), WINDOW_H_MS)


@query("window_gate", sql("v_gate", "SELECT session_id, window_index, gate FROM v_gate"))
def window_gate(spark, d):
    return T.gate_windows(lattice(spark, d), audit(spark, d)).select("session_id", "window_index", "gate")


# -- T5-T11, T21 -----------------------------------------------------------------------

view("v_rows", f"""
SELECT *, CAST(relative_us // {S.window_us} AS BIGINT) AS window_no, CAST((relative_us % {S.window_us}) // {S.token_us} AS INT) AS token_no FROM v_trust WHERE NOT isnan(speed_mps)""", "v_trust")
view("v_lag", """
SELECT *, time_s - lag(time_s) OVER w AS step_s, lag(token_no) OVER w AS prev_token FROM v_rows WINDOW w AS (PARTITION BY session_id, window_no ORDER BY relative_us)""", "v_rows")
view("v_token", f"""
SELECT session_id, window_no, token_no, count(*) AS n, min(time_s) AS first_s, max(time_s) AS last_s, max(step_s) AS step_s,
 avg(sin(radians(heading_deg))) AS heading_sin, avg(cos(radians(heading_deg))) AS heading_cos, avg(sin(radians(pitch_deg))) AS pitch_sin, avg(cos(radians(pitch_deg))) AS pitch_cos,
 avg(sin(radians(roll_deg))) AS roll_sin, avg(cos(radians(roll_deg))) AS roll_cos, avg(speed_mps) AS speed_mps, avg(rpm) AS rpm, arg_max(gear, relative_us) AS gear,
 greatest(min(time_s) - (window_no * {WINDOW_S} + token_no * {TOKEN_S}), coalesce(max(step_s) FILTER (WHERE prev_token = token_no), 0), window_no * {WINDOW_S} + (token_no + 1) * {TOKEN_S} - max(time_s)) AS gap_s
FROM v_lag GROUP BY session_id, window_no, token_no""", "v_lag")


def tokens(spark, d):
    return T.resample_tokens(T.place_rows(trusted(spark, d), S), S)


_VALUES = ("heading_sin", "heading_cos", "pitch_sin", "pitch_cos", "roll_sin", "roll_cos", "speed_mps", "rpm")


@query("resample_tokens", sql("v_token", f"""
SELECT session_id, window_no, token_no, n, {', '.join(f'round({v}, 6) AS {v}' for v in _VALUES)}, gear, round(gap_s, 6) AS gap_s, gap_s <= {LIMIT_S} + 1e-9 AS filled FROM v_token"""))
def resample_tokens(spark, d):
    return rounded(tokens(spark, d).select("session_id", "window_no", "token_no", "n", *_VALUES, "gear", "gap_s", "filled"))


view("v_open", "SELECT DISTINCT session_id, CAST(window_index AS BIGINT) AS window_no FROM v_gate WHERE gate = 'open'", "v_gate")


def opened(spark, d, verdicts=None):
    verdicts = audit(spark, d) if verdicts is None else verdicts
    gated = T.gate_windows(lattice(spark, d), verdicts).where("gate = 'open'")
    return gated.select("session_id", F.col("window_index").cast("bigint").alias("window_no")).distinct()


@query("token_scaffold", sql("v_open v_token", f"""
SELECT o.session_id, o.window_no, k.token_no, coalesce(t.n, 0) AS n, k.token_no * {TOKEN_S} AS support_start_s, (k.token_no + 1) * {TOKEN_S} AS support_end_s, (k.token_no + 0.5::DOUBLE) * {TOKEN_S} AS center_s,
 coalesce(t.gap_s <= {LIMIT_S} + 1e-9, false) AS filled
FROM v_open o CROSS JOIN (SELECT CAST(unnest(range({TOKENS})) AS INT) AS token_no) k LEFT JOIN v_token t ON t.session_id = o.session_id AND t.window_no = o.window_no AND t.token_no = k.token_no"""))
def token_scaffold(spark, d):
    rows, verdicts = audited(spark, d)
    found = T.resample_tokens(T.place_rows(T.trusted_prefix(rows, verdicts), S), S)
    return T.token_scaffold(opened(spark, d, verdicts), found, S).select(
        "session_id", "window_no", "token_no", "n", "support_start_s", "support_end_s", "center_s", "filled")


view("v_median", """
SELECT session_id, median(step) / 1e6::DOUBLE AS dt FROM (SELECT session_id, relative_us - lag(relative_us) OVER (PARTITION BY session_id ORDER BY row_no) AS step FROM v_rows)
WHERE step IS NOT NULL GROUP BY session_id""", "v_rows")


@query("usable_median", sql("v_median", "SELECT session_id, round(dt, 9) AS usable_dt_s FROM v_median"))
def usable_median(spark, d):
    return rounded(T.usable_median(trusted(spark, d)), 9)


view("v_dense", f"""
SELECT o.session_id, o.window_no, k.token_no, coalesce(t.n, 0) AS n, t.first_s, t.last_s, t.step_s, coalesce(t.gap_s <= {LIMIT_S} + 1e-9, false) AS filled,
 CAST(least(1.0, coalesce(t.n, 0) * coalesce(m.dt, {TOKEN_S}) / {TOKEN_S}) AS FLOAT) AS observed_fraction,
 {', '.join(f't.{v}' for v in _VALUES)}, t.gear
FROM v_open o CROSS JOIN (SELECT CAST(unnest(range({TOKENS})) AS INT) AS token_no) k LEFT JOIN v_median m USING (session_id)
LEFT JOIN v_token t ON t.session_id = o.session_id AND t.window_no = o.window_no AND t.token_no = k.token_no""", "v_open", "v_median", "v_token")


@query("observed_fraction", sql("v_dense", "SELECT session_id, window_no, token_no, round(CAST(observed_fraction AS DOUBLE), 6) AS observed_fraction FROM v_dense"))
def observed_fraction(spark, d):
    rows, verdicts = audited(spark, d)
    kept = T.trusted_prefix(rows, verdicts)
    found = T.resample_tokens(T.place_rows(kept, S), S)
    frame = T.window_frame(opened(spark, d, verdicts), found, T.usable_median(kept))
    return rounded(T.with_observed_fraction(T.token_scaffold(frame, found, S), S).select(
        "session_id", "window_no", "token_no", "observed_fraction"))


# neighbour rows are looked up among all usable rows by time, independent of windows
view("v_near", f"""
SELECT d.*, b.time_s AS bt, a.time_s AS after_s, d.window_no * {WINDOW_S} + (d.token_no + 0.5::DOUBLE) * {TOKEN_S} AS center,
 b.heading_deg AS bh, a.heading_deg AS ah, b.pitch_deg AS bp, a.pitch_deg AS ap, b.roll_deg AS br, a.roll_deg AS ar, b.speed_mps AS bs, a.speed_mps AS asp, b.rpm AS brpm, a.rpm AS arpm, b.gear AS bg
FROM (SELECT *, window_no * {WINDOW_S} + token_no * {TOKEN_S} AS l FROM v_dense) d
ASOF LEFT JOIN v_rows b ON b.session_id = d.session_id AND d.l > b.time_s ASOF LEFT JOIN v_rows a ON a.session_id = d.session_id AND d.l <= a.time_s""", "v_dense", "v_rows")
view("v_final", f"""
SELECT *, n = 0 AND coalesce(after_s - bt <= {LIMIT_S} + 1e-9, false) AS interpolated, (center - bt) / (after_s - bt) AS w FROM v_near""", "v_near")
_MIX = {"heading_sin": "sin(radians(bh + w * (ah - bh)))", "heading_cos": "cos(radians(bh + w * (ah - bh)))", "pitch_sin": "sin(radians(bp + w * (ap - bp)))",
        "pitch_cos": "cos(radians(bp + w * (ap - bp)))", "roll_sin": "sin(radians(br + w * (ar - br)))", "roll_cos": "cos(radians(br + w * (ar - br)))",
        "speed_mps": "bs + w * (asp - bs)", "rpm": "brpm + w * (arpm - brpm)", "gear": "bg"}
_FINAL = ", ".join(f"round(CAST(CAST(CASE WHEN interpolated THEN {m} WHEN filled THEN {v} ELSE 0 END AS FLOAT) AS DOUBLE), 4) AS {v}" for v, m in _MIX.items())


def dense(spark, d):
    rows, verdicts = audited(spark, d)
    return T.dense_tokens(opened(spark, d, verdicts), T.trusted_prefix(rows, verdicts), S)


@query("interpolate_tokens", sql("v_final", f"SELECT session_id, window_no, token_no, interpolated, filled OR interpolated AS token_valid, {_FINAL} FROM v_final"))
def interpolate_tokens(spark, d):
    out = dense(spark, d).select("session_id", "window_no", "token_no", "interpolated", "token_valid", *_MIX)
    return rounded(out, 4)


view("v_quality", f"""
WITH f AS (SELECT *, filled OR interpolated AS ok, max(CASE WHEN filled OR interpolated THEN token_no END) OVER (PARTITION BY session_id, window_no ORDER BY token_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM v_final),
q AS (SELECT session_id, window_no, avg(CAST(ok AS INT)) AS valid_ratio, avg(CAST(observed_fraction AS DOUBLE)) AS raw_coverage_ratio, count(*) FILTER (WHERE interpolated) AS interpolated_token_count,
 greatest(coalesce(max(CASE WHEN ok THEN token_no - coalesce(pv, -1) - 1 END), 0), {TOKENS - 1} - coalesce(max(CASE WHEN ok THEN token_no END), -1)) * {TOKEN_S} AS max_unusable_gap_s,
 CASE WHEN max(n) = 0 THEN {WINDOW_S} ELSE greatest(min(first_s) - window_no * {WINDOW_S}, coalesce(max(step_s), 0), (window_no + 1) * {WINDOW_S} - max(last_s)) END AS max_raw_gap_s FROM f GROUP BY session_id, window_no)
SELECT *, list_filter([CASE WHEN raw_coverage_ratio + 1e-9 < {S.min_raw_coverage}::DOUBLE THEN 'RAW_COVERAGE_BELOW_95_PERCENT' END, CASE WHEN valid_ratio + 1e-9 < {S.min_valid_ratio}::DOUBLE THEN 'FEATURE_COVERAGE_BELOW_95_PERCENT' END,
 CASE WHEN max_unusable_gap_s > {S.max_unusable_s}::DOUBLE + 1e-9 THEN 'CONTINUOUS_UNUSABLE_GAP_EXCEEDS_1S' END], lambda x: x IS NOT NULL) AS codes FROM q""", "v_final")


@query("window_quality", sql("v_quality", """
SELECT session_id, window_no, round(valid_ratio, 6) AS valid_ratio, round(raw_coverage_ratio, 6) AS raw_coverage_ratio, interpolated_token_count, round(max_raw_gap_s, 6) AS max_raw_gap_s,
 max_unusable_gap_s, array_to_string(codes, ';') AS qc_reason_codes, CASE WHEN len(codes) = 0 THEN 'PASS' ELSE 'FAIL' END AS qc_status FROM v_quality"""))
def window_quality(spark, d):
    out = T.window_quality(dense(spark, d), S).withColumn("qc_reason_codes", F.array_join("qc_reason_codes", ";"))
    return rounded(out)


@query("longest_false_run", sql("v_final", f"""
SELECT session_id, window_no, max(run) AS longest FROM (SELECT session_id, window_no, CASE WHEN ok THEN 0 ELSE count(*) OVER (PARTITION BY session_id, window_no, island ORDER BY token_no) END AS run FROM (
 SELECT *, filled OR interpolated AS ok, row_number() OVER (PARTITION BY session_id, window_no ORDER BY token_no) - row_number() OVER (PARTITION BY session_id, window_no, filled OR interpolated ORDER BY token_no)
  + CASE WHEN filled OR interpolated THEN {TOKENS * 2} ELSE 0 END AS island FROM v_final)) GROUP BY ALL"""))
def longest_false_run(spark, d):
    return T.bundle_tokens(dense(spark, d)).select(
        "session_id", "window_no", T.longest_false_run(F.col("valid_mask")).cast("bigint").alias("longest"))


@query("token_bundles", sql("v_final", """
SELECT session_id, window_no, count(*) AS tokens, count(*) FILTER (WHERE filled OR interpolated) AS valid_tokens, round(sum(CAST(observed_fraction AS DOUBLE)), 4) AS observed FROM v_final GROUP BY ALL"""))
def token_bundles(spark, d):
    packed = T.bundle_tokens(dense(spark, d))
    total = F.aggregate("observed_fraction", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rounded(packed.select(
        "session_id", "window_no", F.size("x").cast("bigint").alias("tokens"),
        F.size(F.filter("valid_mask", lambda v: v)).cast("bigint").alias("valid_tokens"), total.alias("observed")), 4)


# -- T22, M1 --------------------------------------------------------------------------------

_JUDGED = sql("v_gate v_quality", f"""
SELECT g.session_id, g.window_index, CASE WHEN gate = 'open' THEN CASE WHEN len(codes) = 0 THEN 'PASS' ELSE 'FAIL' END WHEN gate = 'SOURCE_TELEMETRY_MISSING' THEN 'FAIL' ELSE 'PENDING' END AS qc_status,
 CASE WHEN gate = 'open' THEN array_to_string(codes, ';') ELSE gate END AS error, gate = 'open' AND len(codes) = 0 AS valid,
 CASE WHEN gate = 'SOURCE_TELEMETRY_MISSING' THEN 'source_missing' WHEN gate = 'open' AND clock_status <> 'stable' THEN 'trusted_before_discontinuity' ELSE clock_status END AS clock_status,
 CASE WHEN gate = 'open' THEN round(valid_ratio, 6) ELSE 0 END AS valid_ratio, CASE WHEN gate = 'open' THEN round(raw_coverage_ratio, 6) ELSE 0 END AS raw_coverage_ratio,
 CASE WHEN gate = 'open' THEN max_unusable_gap_s ELSE {WINDOW_S} END AS max_unusable_gap_s, CASE WHEN gate = 'open' THEN interpolated_token_count ELSE 0 END AS interpolated_token_count
FROM v_gate g LEFT JOIN v_quality q ON q.session_id = g.session_id AND q.window_no = g.window_index""")


def judged(spark, d):
    rows, verdicts = audited(spark, d)
    return rows, S, verdicts


@query("telemetry_windows", _JUDGED)
def telemetry_windows(spark, d):
    out = T.telemetry_windows(lattice(spark, d), *judged(spark, d))
    return rounded(out.select("session_id", "window_index", "qc_status", "error", "valid", "clock_status", "valid_ratio",
                              "raw_coverage_ratio", "max_unusable_gap_s", "interpolated_token_count"))


@query("telemetry_dataset", f"""WITH j AS ({_JUDGED}), g AS ({sql('v_grid', 'SELECT session_id, window_index, subject_id, split FROM v_grid')})
SELECT split, qc_status, error, count(*) AS n, count(DISTINCT session_id) AS sessions FROM j JOIN g USING (session_id, window_index) GROUP BY ALL""")
def telemetry_dataset(spark, d):
    built = jobs.build_telemetry_dataset(v_session_labels(spark, d), v_tel(spark, d), S)
    return built.windows.groupBy("split", "qc_status", "error").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"))


@query("telemetry_reason_counts", f"WITH j AS ({_JUDGED}) SELECT code, count(*) AS n FROM (SELECT unnest(string_split(error, ';')) AS code FROM j WHERE error <> '') GROUP BY code")
def telemetry_reason_counts(spark, d):
    return coverage.reason_counts(T.telemetry_windows(lattice(spark, d), *judged(spark, d)), "qc_reason_codes")


# -- T15, T19 ---------------------------------------------------------------------------------

@query("interval_union", """
WITH i AS (SELECT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity AS e FROM lineitem),
r AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT l_orderkey, sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS covered FROM r GROUP BY l_orderkey""")
def interval_union(spark, d):
    return intervals.covered_length(v_sup(spark, d), ["l_orderkey"], "start", "end")


@query("block_frames", sql("v_clip", """
SELECT event_id, b AS block_no, CAST(CASE WHEN least((b + 1) * 96000, nframes) - b * 96000 > 0 THEN (least((b + 1) * 96000, nframes) - b * 96000) / 96000.0::DOUBLE ELSE 0 END AS FLOAT) AS observed_fraction,
 CAST(CASE WHEN least((b + 1) * 96000, nframes) - b * 96000 > 0 THEN (least((b + 1) * 96000, nframes) - b * 96000) / 96000.0::DOUBLE ELSE 0 END AS FLOAT) >= 0.95::FLOAT AS block_valid
FROM v_clip, (SELECT CAST(unnest(range(5)) AS INT) AS b)"""))
def block_frames(spark, d):
    return intervals.block_frames(v_clip(spark, d), "nframes", 96_000).select("event_id", "block_no", "observed_fraction", "block_valid")


@query("exact_median_of_prices", "SELECT l_suppkey, median(CAST(round(l_extendedprice * 100) AS BIGINT)) AS median_cents FROM lineitem GROUP BY l_suppkey")
def exact_median_of_prices(spark, d):
    rows = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice").select(
        "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    return exact_median(rows, ["l_suppkey"], "cents", "median_cents")
