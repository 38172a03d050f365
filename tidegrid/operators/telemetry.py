"""Clock audit and resampling of irregular telemetry into regular tokens.

Telemetry rows hold session_id, row_no (dense, 0-based, in file order),
timestamp_us and the six signals. No step keeps a session in one task: steps
between rows are found inside (session, row chunk), everything later is keyed by
(session, window).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions.numeric import codes_where, is_finite
from tidegrid.plans.chunked import cut, with_history
from tidegrid.plans.medians import exact_median

SIGNALS = ("heading_deg", "pitch_deg", "roll_deg", "speed_mps", "rpm", "gear")
ANGLES = SIGNALS[:3]
LEVELS = SIGNALS[3:5]
FEATURES = C.TELEMETRY_FEATURES
KEY = ["session_id", "window_no"]


@dataclass(frozen=True)
class TokenSettings:
    """Lengths are whole microseconds; limits are seconds, as in the contract."""

    window_us: int = 30_000_000
    token_us: int = 100_000
    min_raw_coverage: float = 0.95
    min_valid_ratio: float = 0.95
    max_unusable_s: float = 1.0
    max_gap_s: float = 0.10
    clock_jump_s: float = 1.0
    strict: bool = True

    def __post_init__(self) -> None:
        if self.window_us % self.token_us:
            raise ValueError("the token must divide the window")
        if self.max_gap_s * 1e6 > self.window_us:
            raise ValueError("max_gap_s cannot exceed the window")
        if self.strict and self.max_gap_s > self.token_s + 1e-12:
            raise ValueError("max_gap_s cannot exceed one token")

    @property
    def token_s(self) -> float:
        return self.token_us / 1e6

    @property
    def window_s(self) -> float:
        return self.window_us / 1e6

    @property
    def tokens(self) -> int:
        return self.window_us // self.token_us


def usable(signals=SIGNALS) -> Column:
    """All six signals are finite numbers."""
    good = F.lit(True)
    for name in signals:
        good = good & is_finite(F.col(name))
    return good


# -- clock --------------------------------------------------------------------

def clock_steps(telemetry: DataFrame) -> DataFrame:
    """Adds ``step_us`` to the row before and ``usable_step_us`` to the last
    usable row before; null where there is none.

    On the trusted rows the clock rises, so the latest usable stamp is the
    largest one. Rows that carry the steps already, such as a staged table, are
    left as they are.
    """
    if "step_us" in telemetry.columns:
        return telemetry
    ok = usable()
    rows = with_history(
        telemetry, ["session_id"], ["row_no"], cut("row_no"), ["timestamp_us"], "previous_us",
        running={"__usable_us": F.when(ok, F.col("timestamp_us"))})
    return rows.withColumns({
        "step_us": F.col("timestamp_us") - F.col("previous_us"),
        "usable_step_us": F.when(ok, F.col("timestamp_us") - F.col("__usable_us")),
    }).drop("previous_us", "__usable_us")


def bad_step(threshold_s: float) -> Column:
    return (F.col("step_us") <= 0) | (F.col("step_us") / 1e6 > threshold_s)


def clock_audit(telemetry: DataFrame, threshold_s: float = 1.0) -> DataFrame:
    """One row per session: median step, bad steps, first bad row, trusted end.

    ``trust_end_s`` is infinite for a stable clock. ``clock_error`` names a
    session the audit cannot judge (a row without clock, under two rows, or no positive step).
    """
    steps = clock_steps(telemetry)
    bad = bad_step(threshold_s)
    first_bad = F.min(F.when(bad, F.struct("row_no", (F.col("timestamp_us") - F.col("step_us")).alias("previous_us"))))
    audit = steps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.min_by("timestamp_us", "row_no").alias("start_us"),
        F.count_if(bad).alias("anomaly_count"),
        F.count_if(F.col("step_us") > 0).alias("positive_steps"),
        F.count_if(F.col("timestamp_us").isNull()).alias("missing_clocks"),
        first_bad.alias("__bad"),
    )
    middle = exact_median(
        steps.select("session_id", F.when(F.col("step_us") > 0, F.col("step_us")).alias("step_us")),
        ["session_id"], "step_us", "median_step_us")
    end = (F.col("__bad.previous_us") - F.col("start_us")) / 1e6
    return (
        audit.join(middle, "session_id", "left")
        .select(
            "session_id", "source_rows", "start_us", "anomaly_count",
            (F.col("median_step_us") / 1e6).alias("median_dt_s"),
            # 0-based position of the bad step; its later row is line +2 of the file
            (F.col("__bad.row_no") - 1).alias("first_anomaly_index"),
            (F.col("__bad.row_no") + 1).alias("first_anomaly_row"),
            end.alias("first_anomaly_time_s"),
            F.coalesce(end, F.lit(float("inf"))).alias("trust_end_s"),
            F.when(F.col("anomaly_count") == 0, "stable")
            .otherwise("pending_after_discontinuity").alias("clock_status"),
            F.when(F.col("missing_clocks") > 0, "missing_clock")
            .when(F.col("source_rows") < 2, "fewer_than_two_rows")
            .when(F.col("positive_steps") == 0, "no_positive_steps")
            .otherwise("").alias("clock_error"),
        )
    )


def clock_anomalies(telemetry: DataFrame, threshold_s: float = 1.0) -> DataFrame:
    """One row per bad step (a session's list of them has no size bound)."""
    return clock_steps(telemetry).where(bad_step(threshold_s)).select(
        "session_id",
        (F.col("row_no") - 1).alias("anomaly_index"),
        (F.col("row_no") + 1).alias("anomaly_row"),
        (F.col("step_us") / 1e6).alias("delta_s"),
    )


def trusted_prefix(telemetry: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows up to and including the last one before the first bad step."""
    telemetry = clock_steps(telemetry)
    limits = audit.select("session_id", "start_us", "first_anomaly_index")
    return (
        telemetry.join(limits, "session_id")
        .where(F.col("first_anomaly_index").isNull() | (F.col("row_no") <= F.col("first_anomaly_index")))
        .withColumn("relative_us", F.col("timestamp_us") - F.col("start_us"))
        .withColumn("time_s", F.col("relative_us") / 1e6)
        .drop("start_us", "first_anomaly_index")
    )


def gate_windows(grid: DataFrame, audit: DataFrame) -> DataFrame:
    """Adds ``gate``: missing source, pending clock, or open."""
    ends = audit.select("session_id", "trust_end_s", "clock_status")
    late = F.col("window_end_ms") / 1000 > F.col("trust_end_s") + 1e-9
    return (
        grid.join(ends, "session_id", "left")
        .withColumn("gate", F.when(F.col("trust_end_s").isNull(), C.SOURCE_MISSING)
                    .when(late, C.CLOCK_PENDING).otherwise("open"))
    )


# -- tokens -------------------------------------------------------------------

def usable_median(trusted: DataFrame) -> DataFrame:
    """Median step of the usable trusted rows of each session that has two."""
    steps = clock_steps(trusted).select("session_id", "usable_step_us")
    return exact_median(steps, ["session_id"], "usable_step_us", "__m").select(
        "session_id", (F.col("__m") / 1e6).alias("usable_dt_s"))


def _token_at(time_s: Column, relative_us: Column, settings: TokenSettings, edges: str) -> tuple[Column, Column]:
    """Window and token of a stamp."""
    window = cut(relative_us, settings.window_us)
    guess = F.call_function("div", F.pmod(relative_us, F.lit(settings.window_us)), F.lit(settings.token_us)).cast("int")
    if edges == "integer":
        return window, guess
    left = window * settings.window_s + guess * settings.token_s
    right = window * settings.window_s + (guess + 1) * settings.token_s
    return window, (
        F.when((time_s < left) & (guess > 0), guess - 1)
        .when((time_s >= right) & (guess < settings.tokens - 1), guess + 1)
        .otherwise(guess))


def place_rows(trusted: DataFrame, settings: TokenSettings, edges: str = "float") -> DataFrame:
    """Usable rows with their window and token, and the step from the usable row before.

    ``edges='float'`` puts a row by comparing its seconds with the double token
    edges ``start + k*token``, as the contract's arithmetic does; the integer
    place is only the first guess. ``edges='integer'`` keeps the guess.

    The stamp of the row before follows from the step that a row carries, and so does its
    place: ``step_s`` is null in a window's first row, ``inner_s`` also in a token's.
    """
    rows = clock_steps(trusted).where(usable())
    window, token = _token_at(F.col("time_s"), F.col("relative_us"), settings, edges)
    before_us = F.col("relative_us") - F.col("usable_step_us")
    before_window, before_token = _token_at(before_us / 1e6, before_us, settings, edges)
    step = F.when(before_window == window, F.col("time_s") - before_us / 1e6)
    return rows.withColumns({
        "window_no": window, "token_no": token, "step_s": step, "inner_s": F.when(before_token == token, step)})


def resample_tokens(placed: DataFrame, settings: TokenSettings) -> DataFrame:
    """Observed tokens: means of the row values, last gear, largest inner gap.

    ``gap_s`` is the largest step of [left edge, rows, right edge]; ``step_s``
    the largest step to the row before in the same window. The first and last
    raw row stay on the token as neighbours for interpolation.

    Every row brings its own step, so a task's rows of a token fold to one summary (first, last,
    largest steps, sums) and summaries merge in any order: no window is put in order or held whole.
    """
    means = []
    for name in ANGLES:
        stem = name.removesuffix("_deg")
        means.append(F.avg(F.sin(F.radians(name))).alias(f"{stem}_sin"))
        means.append(F.avg(F.cos(F.radians(name))).alias(f"{stem}_cos"))
    left = F.col("window_no") * settings.window_s + F.col("token_no") * settings.token_s
    right = F.col("window_no") * settings.window_s + (F.col("token_no") + 1) * settings.token_s
    # One primitive column per neighbour value keeps the hash aggregate.
    edges = [
        pick(name, "relative_us").alias(f"__{side}_{name}")
        for side, pick in (("f", F.min_by), ("l", F.max_by)) for name in SIGNALS
    ]

    def row(side: str, time: str) -> Column:
        return F.struct(F.col(time).alias("time_s"), *[F.col(f"__{side}_{n}").alias(n) for n in SIGNALS])

    grouped = placed.groupBy(*KEY, "token_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("time_s").alias("first_s"),
        F.max("time_s").alias("last_s"),
        F.max("inner_s").alias("__inner"),
        F.max("step_s").alias("step_s"),
        *means,
        *[F.avg(name).alias(name) for name in LEVELS],
        *edges,
    )
    return (
        grouped
        .withColumn("gear", F.col("__l_gear"))
        .withColumn("gap_s", F.greatest(F.col("first_s") - left, F.col("__inner"), right - F.col("last_s")))
        .withColumn("filled", F.col("gap_s") <= settings.max_gap_s + 1e-9)
        .withColumn("first_row", row("f", "first_s"))
        .withColumn("last_row", row("l", "last_s"))
        .drop("__inner", *[f"__{side}_{n}" for side in "fl" for n in SIGNALS])
    )


def window_frame(windows: DataFrame, tokens: DataFrame, medians: DataFrame) -> DataFrame:
    """``windows`` (session_id, window_no) with what their tokens need from outside.

    That is the median step of the session and the nearest raw rows of the
    windows before and after. A gap no wider than a window can reach no further,
    so equi-joins on (session, window) find them.
    """
    borders = tokens.groupBy(*KEY).agg(
        F.min_by("first_row", "token_no").alias("__first"),
        F.max_by("last_row", "token_no").alias("__last"),
    )
    before = borders.select("session_id", (F.col("window_no") + 1).alias("window_no"),
                            F.col("__last").alias("row_before"))
    after = borders.select("session_id", (F.col("window_no") - 1).alias("window_no"),
                           F.col("__first").alias("row_after"))
    return (
        windows.join(medians, "session_id", "left")
        .join(before, KEY, "left").join(after, KEY, "left")
    )


def token_scaffold(frame: DataFrame, tokens: DataFrame, settings: TokenSettings) -> DataFrame:
    """Every token of every window, observed values where there are any."""
    k = F.col("token_no")
    cells = (
        frame.withColumn("token_no", F.explode(F.sequence(F.lit(0), F.lit(settings.tokens - 1))))
        .withColumn("support_start_s", k * settings.token_s)
        .withColumn("support_end_s", (k + 1) * settings.token_s)
        .withColumn("center_s", (F.col("support_start_s") + F.col("support_end_s")) / 2)
    )
    return (
        cells.join(tokens, [*KEY, "token_no"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
        .withColumn("filled", F.coalesce("filled", F.lit(False)))
    )


def with_observed_fraction(dense: DataFrame, settings: TokenSettings) -> DataFrame:
    """Adds the single-precision share of a token its rows account for."""
    dt = F.coalesce("usable_dt_s", F.lit(settings.token_s))
    share = F.least(F.lit(1.0), F.col("n") * dt / settings.token_s)
    return dense.withColumn("observed_fraction", share.cast("float"))


def interpolate_tokens(dense: DataFrame, settings: TokenSettings) -> DataFrame:
    """Fills an empty token whose two neighbour rows lie close enough.

    The neighbours are raw rows: the last before the token, the first after it.
    Gear is held from the row before; angles are interpolated in degrees, then
    encoded. Adds the final single-precision values and ``token_valid``.
    """
    order = W.partitionBy(*KEY).orderBy("token_no")
    back = order.rowsBetween(W.unboundedPreceding, -1)
    ahead = order.rowsBetween(1, W.unboundedFollowing)
    joined = (
        dense
        .withColumn("__b", F.coalesce(F.last("last_row", ignorenulls=True).over(back), "row_before"))
        .withColumn("__a", F.coalesce(F.first("first_row", ignorenulls=True).over(ahead), "row_after"))
    )
    gap = F.col("__a.time_s") - F.col("__b.time_s")
    fill = (F.col("n") == 0) & F.coalesce(gap <= settings.max_gap_s + 1e-9, F.lit(False))
    center = F.col("window_no") * settings.window_s + F.col("center_s")
    weight = (center - F.col("__b.time_s")) / gap
    mixed = {
        name: F.col(f"__b.{name}") + weight * (F.col(f"__a.{name}") - F.col(f"__b.{name}"))
        for name in SIGNALS[:5]
    }
    values: dict[str, Column] = {}
    for name in ANGLES:
        stem = name.removesuffix("_deg")
        values[f"{stem}_sin"] = F.sin(F.radians(mixed[name]))
        values[f"{stem}_cos"] = F.cos(F.radians(mixed[name]))
    values |= {name: mixed[name] for name in LEVELS}
    values["gear"] = F.col("__b.gear")
    marked = joined.withColumn("interpolated", fill)
    return marked.withColumns({
        name: F.when(F.col("interpolated"), value).when(F.col("filled"), F.col(name)).otherwise(0.0).cast("float")
        for name, value in values.items()
    }).withColumn("token_valid", F.col("filled") | F.col("interpolated")).drop(
        "first_row", "last_row", "row_before", "row_after", "__a", "__b")


def longest_false_run(mask: Column) -> Column:
    """Longest run of false in a boolean array."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, value: Column) -> Column:
        run = F.when(value, 0).otherwise(acc["run"] + 1)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(mask, start, step, lambda acc: acc["best"])


def window_quality(dense: DataFrame, settings: TokenSettings) -> DataFrame:
    """One row per window: ratios, gaps, counts, reasons and status.

    The longest run of invalid tokens is the widest distance between valid
    tokens, with the window borders as the outer ones.
    """
    tokens = settings.tokens
    earlier = W.partitionBy(*KEY).orderBy("token_no").rowsBetween(W.unboundedPreceding, -1)
    valid_at = F.when(F.col("token_valid"), F.col("token_no"))
    seen_at = F.when(F.col("n") > 0, F.col("token_no"))
    marked = dense.withColumn("__v", F.max(valid_at).over(earlier))
    run = F.when(F.col("token_valid"), F.col("token_no") - F.coalesce("__v", F.lit(-1)) - 1)
    origin = F.col("window_no") * settings.window_s
    stats = marked.groupBy(*KEY).agg(
        F.avg(F.col("token_valid").cast("double")).alias("valid_ratio"),
        F.avg(F.col("observed_fraction").cast("double")).alias("raw_coverage_ratio"),
        F.count_if("interpolated").alias("interpolated_token_count"),
        F.greatest(F.coalesce(F.max(run), F.lit(0)),
                   tokens - 1 - F.coalesce(F.max(valid_at), F.lit(-1))).alias("__run"),
        F.min("first_s").alias("__first"), F.max("last_s").alias("__last"),
        F.max("step_s").alias("__step"), F.max(seen_at).alias("__seen"),
    )
    end = (F.col("window_no") + 1) * settings.window_s
    gap = F.greatest(F.col("__first") - origin, F.col("__step"), end - F.col("__last"))
    reasons = codes_where(
        (C.RAW_COVERAGE_LOW, F.col("raw_coverage_ratio") + 1e-9 < settings.min_raw_coverage),
        (C.FEATURE_COVERAGE_LOW, F.col("valid_ratio") + 1e-9 < settings.min_valid_ratio),
        (C.UNUSABLE_GAP, F.col("max_unusable_gap_s") > settings.max_unusable_s + 1e-9),
    )
    return (
        stats
        .withColumn("max_raw_gap_s", F.when(F.col("__seen").isNull(), settings.window_s).otherwise(gap))
        .withColumn("max_unusable_gap_s", F.col("__run") * settings.token_s)
        .withColumn("qc_reason_codes", reasons)
        .withColumn("qc_status", F.when(F.size("qc_reason_codes") == 0, "PASS").otherwise("FAIL"))
        .drop("__run", "__first", "__last", "__step", "__seen")
    )


def dense_tokens(windows: DataFrame, trusted: DataFrame, settings: TokenSettings,
                 edges: str = "float") -> DataFrame:
    """All tokens of ``windows`` with final values, validity and share."""
    tokens = resample_tokens(place_rows(trusted, settings, edges), settings)
    frame = window_frame(windows, tokens, usable_median(trusted))
    dense = token_scaffold(frame, tokens, settings)
    return interpolate_tokens(with_observed_fraction(dense, settings), settings)


def bundle_tokens(dense: DataFrame) -> DataFrame:
    """Gathers the tokens of a window (a fixed number) into the five arrays."""
    token = F.struct(
        "token_no", F.array(*[F.col(n) for n in FEATURES]).alias("x"), "center_s", "token_valid",
        F.struct(F.col("support_start_s").alias("start"), F.col("support_end_s").alias("end")).alias("s"),
        "observed_fraction",
    )
    packed = dense.groupBy(*KEY).agg(F.array_sort(F.collect_list(token)).alias("t"))
    return packed.select(
        *KEY,
        F.transform("t", lambda t: t["x"]).alias("x"),
        F.transform("t", lambda t: t["center_s"]).alias("time_s"),
        F.transform("t", lambda t: t["token_valid"]).alias("valid_mask"),
        F.transform("t", lambda t: t["s"]).alias("support_s"),
        F.transform("t", lambda t: t["observed_fraction"]).alias("observed_fraction"),
    )


def telemetry_windows(grid: DataFrame, telemetry: DataFrame, settings: TokenSettings,
                      audit: DataFrame | None = None, edges: str = "float") -> DataFrame:
    """Every candidate window with its verdict; no candidate row is lost.

    The rows are read by the audit, the medians and the tokens. Pass a staged
    ``clock_steps`` table where that work should be done once.
    """
    telemetry = clock_steps(telemetry)
    audit = clock_audit(telemetry, settings.clock_jump_s) if audit is None else audit
    gated = gate_windows(grid, audit).withColumn(
        "window_no", F.call_function("div", F.col("window_start_ms") * 1000, F.lit(settings.window_us)))
    trusted = trusted_prefix(telemetry, audit)
    opened = gated.where("gate = 'open'").select(*KEY).distinct()
    quality = window_quality(dense_tokens(opened, trusted, settings, edges), settings)
    is_open = F.col("gate") == "open"
    blocked = F.array(F.col("gate"))
    status = F.when(is_open, F.col("qc_status")).when(F.col("gate") == C.CLOCK_PENDING, "PENDING").otherwise("FAIL")
    reasons = F.when(is_open, F.col("qc_reason_codes")).otherwise(blocked)
    clock = (
        F.when(F.col("gate") == C.SOURCE_MISSING, "source_missing")
        .when(is_open & (F.col("clock_status") != "stable"), "trusted_before_discontinuity")
        .otherwise(F.col("clock_status"))
    )

    def kept(name: str, blank: Column) -> Column:
        return F.when(is_open, F.col(name)).otherwise(blank)

    return (
        gated.join(quality, KEY, "left")
        .withColumns({
            "clock_status": clock,
            "valid_ratio": kept("valid_ratio", F.lit(0.0)),
            "raw_coverage_ratio": kept("raw_coverage_ratio", F.lit(0.0)),
            "max_raw_gap_s": kept("max_raw_gap_s", F.lit(settings.window_s)),
            "max_unusable_gap_s": kept("max_unusable_gap_s", F.lit(settings.window_s)),
            "interpolated_token_count": kept("interpolated_token_count", F.lit(0).cast("bigint")),
            "qc_status": status,
            "qc_reason_codes": reasons,
        })
        .withColumn("valid", F.col("qc_status") == "PASS")
        .withColumn("error", F.array_join("qc_reason_codes", ";"))
        .drop("gate", "trust_end_s", "window_no")
    )
