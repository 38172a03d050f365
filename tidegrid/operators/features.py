"""Feature bundles held as arrays, one sample per row.

A bundle has x ARRAY<ARRAY<FLOAT>>, time_s ARRAY<DOUBLE>, valid_mask
ARRAY<BOOLEAN>, support_s ARRAY<STRUCT<start,end>> and observed_fraction
ARRAY<FLOAT>. Work inside a sample uses array functions (samples have a fixed,
small number of tokens); work across samples explodes and aggregates.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions.numeric import all_finite, array_mean, codes_where, is_finite, near
from tidegrid.functions.parsing import is_safe_relative_path
from tidegrid.operators.intervals import covered_seconds
from tidegrid.plans.guards import ContractError, require_none
from tidegrid.plans.rules import Rule, first_broken, rule_name


# -- time ---------------------------------------------------------------------

def rebase_time(bundles: DataFrame, start_ms: str = "window_start_ms") -> DataFrame:
    """Session-relative times to sample-relative ones."""
    offset = F.col(start_ms) / 1000.0
    return bundles.withColumns({
        "time_s": F.transform("time_s", lambda t: t - offset),
        "support_s": F.transform("support_s", lambda s: F.struct(
            (s["start"] - offset).alias("start"), (s["end"] - offset).alias("end"))),
    })


def strictly_increasing(values: Column) -> Column:
    """True for an array whose every step is positive."""
    pairs = F.zip_with(values, F.slice(values, 2, F.greatest(F.size(values), F.lit(1))),
                       lambda a, b: b.isNull() | (b > a))
    return F.coalesce(F.forall(pairs, lambda p: p), F.lit(False)) | (F.size(values) == 0)


def _each(times: Column, supports: Column, test) -> Column:
    zipped = F.arrays_zip(times.alias("t"), supports.alias("s"))
    return F.coalesce(F.forall(zipped, lambda z: test(z["t"], z["s"]["start"], z["s"]["end"])), F.lit(False))


def time_support_codes(duration_s: float = 30.0, closed_start: bool = False) -> Column:
    """Codes of the time arrays.

    The pair rule wants ``start < t < end``; the metadata rule, chosen by
    ``closed_start``, allows ``t = start`` and 1e-9 of slack at the sample end.
    """
    t, s = F.col("time_s"), F.col("support_s")
    slack = 1e-9 if closed_start else 0.0

    def inside(x, a, b):
        low = (x >= a) if closed_start else (x > a)
        return (a >= 0) & (b <= duration_s + slack) & (b > a) & low & (x < b)

    finite = all_finite(t) & F.forall(s, lambda v: is_finite(v["start"]) & is_finite(v["end"]))
    codes = codes_where(
        ("nonfinite", ~finite),
        ("time_not_strictly_increasing", ~strictly_increasing(t)),
        ("outside_sample_support", ~_each(t, s, inside)),
    )
    return F.when(F.size(t) != F.size(s), F.array(F.lit("shape"))).otherwise(codes)


def _grid(values: Column, count: int, expected, tolerance: float) -> Column:
    want = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), expected)
    close = F.forall(F.zip_with(values, want, lambda v, w: near(v, w, tolerance)), lambda ok: ok)
    return (F.size(values) == count) & F.coalesce(close, F.lit(False))


def fixed_grid_codes(count: int = 6, step_s: float = 5.0, tolerance: float = 1e-6) -> Column:
    """Codes when supports and centres are not the exact contiguous grid.

    Telemetry uses 300 steps of 0.1 s at 1e-12, video six of 5 s at 1e-6.
    """
    starts = F.transform("support_s", lambda s: s["start"])
    ends = F.transform("support_s", lambda s: s["end"])
    k = lambda i: i.cast("double")
    support = _grid(starts, count, lambda i: k(i) * step_s, tolerance) & _grid(
        ends, count, lambda i: (k(i) + 1) * step_s, tolerance)
    centre = _grid(F.col("time_s"), count, lambda i: (k(i) + 0.5) * step_s, tolerance)
    return codes_where(("support_not_contiguous_grid", ~support), ("time_not_grid_centers", ~centre))


# -- bundle rules -------------------------------------------------------------

def bundle_rules(duration_s: float = 30.0, shape: tuple[int, int] | None = None) -> list[Rule]:
    """Array rules in reporting order, for a bundle already read into columns."""
    x, t, m, s, o = (F.col(n) for n in ("x", "time_s", "valid_mask", "support_s", "observed_fraction"))
    length, width = F.size(x), F.size(F.get(x, F.lit(0)))
    finite = (
        F.forall(x, all_finite) & all_finite(t) & all_finite(o)
        & F.forall(s, lambda v: is_finite(v["start"]) & is_finite(v["end"]))
    )
    rules = [
        Rule("arrays", x.isNotNull() & t.isNotNull() & m.isNotNull() & s.isNotNull() & o.isNotNull()),
        Rule("nonfinite", finite),
        Rule("x_shape", (length >= 1) & (width >= 1) & F.forall(x, lambda r: F.size(r) == width)),
        Rule("lengths", (F.size(t) == length) & (F.size(m) == length) & (F.size(s) == length) & (F.size(o) == length)),
    ]
    if shape:
        rules.append(Rule("expected_shape", (length == shape[0]) & (width == shape[1])))
    return rules + [
        Rule("time_increasing", strictly_increasing(t)),
        Rule("support", _each(t, s, lambda v, a, b: (a >= 0) & (b <= duration_s + 1e-9) & (b > a))),
        Rule("centre", _each(t, s, lambda v, a, b: (v >= a) & (v < b))),
        Rule("fraction", F.forall(o, lambda v: (v >= 0) & (v <= 1))),
    ]


def descriptor_rules() -> list[Rule]:
    """Rules between a metadata row and its bundle: path, mask, shape, dtype.

    The bundle's real shape comes as ``array_rows`` and ``array_columns``, the
    parsed texts as ``p_shape`` and ``p_mask``.
    """
    declared, masked = F.col("p_shape"), F.col("p_mask")
    real = F.array("array_rows", "array_columns")
    same_file = F.translate(masked, "\\", "/") == F.translate("feature_path", "\\", "/")
    return [
        Rule("path", is_safe_relative_path(F.col("feature_path"))),
        Rule("npz_suffix", F.lower("feature_path").endswith(".npz")),
        Rule("mask_reference", masked.isNotNull() & is_safe_relative_path(masked) & same_file),
        Rule("bundle_missing", F.col("array_rows").isNotNull()),
        Rule("shape_json", declared.isNotNull()),
        Rule("declared_shape", declared == real),
        Rule("declared_dtype", F.col("feature_dtype") == "float32"),
    ]


def first_bundle_error(rules: Sequence[Rule]) -> Column:
    return F.coalesce(rule_name(first_broken(rules), rules), F.lit(""))


def telemetry_value_codes(tolerance: float = 1e-6) -> Column:
    """Angle encodings within ±1, whole gears on valid tokens, stored coverage."""
    x, m = F.col("x"), F.col("valid_mask")
    angles = F.forall(x, lambda r: F.forall(F.slice(r, 1, 6), lambda v: F.abs(v) <= 1 + 1e-6))
    gears = F.forall(F.zip_with(x, m, lambda r, ok: ~ok | (
        F.abs(F.get(r, F.lit(8)) - F.rint(F.get(r, F.lit(8)))) <= tolerance)), lambda ok: ok)
    coverage = near(F.col("raw_coverage_ratio"), array_mean(F.col("observed_fraction")), tolerance)
    return codes_where(("angle_range", ~angles), ("gear_not_whole", ~gears), ("raw_coverage", ~coverage))


def mask_ratio(mask: Column) -> Column:
    return array_mean(F.transform(mask, lambda v: v.cast("int")))


def mask_ratio_codes(stored: str = "valid_ratio", tolerance: float = 1e-6) -> Column:
    """At least one valid token, stored ratio equals the mask's, shares in [0,1]."""
    return codes_where(
        ("no_valid_token", ~F.exists("valid_mask", lambda v: v)),
        ("valid_ratio", ~near(mask_ratio(F.col("valid_mask")), F.col(stored), tolerance)),
        ("observed_fraction", ~F.forall("observed_fraction", lambda v: (v >= 0) & (v <= 1))),
    )


def union_ratio(duration_s: float) -> Column:
    return covered_seconds(F.col("support_s"), F.col("valid_mask")) / duration_s


# -- normalisation ------------------------------------------------------------

@dataclass(frozen=True)
class StandardizerState:
    """The fitted vectors; as many numbers as there are features."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    valid_token_count: int
    zero_variance_indices: tuple[int, ...]
    feature_names: tuple[str, ...]
    source_sha256: str = ""
    fitted_split: str = "train"
    version: str = C.STATE_VERSION


def fit_statistics(bundles: DataFrame, split: str = "train", epsilon: float = 1e-12) -> DataFrame:
    """One row per feature over the valid tokens of the train split.

    Population variance; a variance of at most ``epsilon`` gets scale 1. Only
    partial sums per feature are shuffled.
    """
    if split != "train":
        raise ContractError("normalisation may only be fitted on the train split")
    train = bundles.where(F.col("split") == "train") if "split" in bundles.columns else bundles
    used = F.filter(F.arrays_zip(F.col("x").alias("v"), F.col("valid_mask").alias("ok")), lambda z: z["ok"])
    values = (
        train.select(F.explode(used).alias("t"))
        .select(F.posexplode("t.v").alias("feature", "value"))
    )
    value = F.col("value").cast("double")
    return values.groupBy("feature").agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.count(F.lit(1)).alias("valid_tokens"),
    ).select(
        "feature", "mean",
        F.when(F.col("variance") <= epsilon, 1.0).otherwise(F.sqrt("variance")).alias("scale"),
        (F.col("variance") <= epsilon).alias("zero_variance"), "valid_tokens")


def collect_state(statistics: DataFrame, names: Sequence[str], source_sha256: str = "") -> StandardizerState:
    """The fitted state on the driver: one row per feature, a fixed number."""
    rows = sorted(statistics.collect(), key=lambda r: r["feature"])
    if len(rows) != len(names):
        raise ContractError("feature names do not match the fitted width")
    return StandardizerState(
        tuple(r["mean"] for r in rows), tuple(r["scale"] for r in rows), rows[0]["valid_tokens"],
        tuple(r["feature"] for r in rows if r["zero_variance"]), tuple(names), source_sha256)


def state_columns(statistics: DataFrame) -> tuple[Column, Column]:
    """Mean and scale vectors as scalar subqueries, for a plan in one piece."""
    ordered = F.array_sort(F.collect_list(F.struct("feature", "mean", "scale")))
    packed = statistics.agg(ordered.alias("v"))
    mean = packed.select(F.transform("v", lambda r: r["mean"]).alias("m")).scalar()
    scale = packed.select(F.transform("v", lambda r: r["scale"]).alias("s")).scalar()
    return mean, scale


def standardize(bundles: DataFrame, mean: Column, scale: Column) -> DataFrame:
    """``(x-mean)/scale``; invalid tokens become 0; adds ``standardize_error``."""
    # Subqueries may not stand inside array functions, so they become columns first.
    rows = bundles.withColumns({"__mean": mean, "__scale": scale})
    one = lambda v: v.cast("float")
    centred = lambda r: F.zip_with(r, "__mean", lambda v, m: one(v) - one(m))
    scaled = lambda r: F.zip_with(centred(r), "__scale", lambda v, s: one(v / one(s)))
    blank = lambda r: F.transform(r, lambda v: F.lit(0).cast("float"))
    values = F.zip_with("x", "valid_mask", lambda r, ok: F.when(ok, scaled(r)).otherwise(blank(r)))
    return (
        rows.withColumn("x", values).drop("__mean", "__scale")
        .withColumn("standardize_error", ~F.forall("x", all_finite))
    )


def state_vectors(state: StandardizerState) -> tuple[Column, Column]:
    return (F.array(*[F.lit(v) for v in state.mean]), F.array(*[F.lit(v) for v in state.scale]))


def state_json(state: StandardizerState) -> str:
    return json.dumps({
        "version": state.version, "method": "zscore", "fitted_split": state.fitted_split,
        "mask_policy": "fit_valid_tokens_only_and_zero_invalid_after_transform",
        "source_manifest_sha256": state.source_sha256, "valid_token_count": state.valid_token_count,
        "feature_names": list(state.feature_names), "mean": list(state.mean), "scale": list(state.scale),
        "zero_variance_indices": list(state.zero_variance_indices),
    })


# -- pooling and batches ------------------------------------------------------

def _valid_tokens() -> Column:
    zipped = F.arrays_zip(F.col("x").alias("v"), F.col("valid_mask").alias("ok"))
    return F.transform(F.filter(zipped, lambda z: z["ok"]), lambda z: F.transform(z["v"], lambda v: v.cast("double")))


def _fold(rows: Column, combine) -> Column:
    """Element-wise fold of equal-length arrays; null for no rows."""
    first = F.get(rows, F.lit(0))
    rest = F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))
    return F.when(F.size(rows) > 0, F.aggregate(rest, first, lambda acc, r: F.zip_with(acc, r, combine)))


def masked_mean_pool(bundles: DataFrame, out: str = "pooled") -> DataFrame:
    """Mean of the valid tokens per sample; null when there is none."""
    with_tokens = bundles.withColumn("__t", _valid_tokens())
    count = F.size("__t")
    mean = F.transform(_fold(F.col("__t"), lambda a, b: a + b), lambda v: v / count)
    return with_tokens.withColumn(out, mean).drop("__t")


def masked_mean_max_last(bundles: DataFrame, out: str = "pooled") -> DataFrame:
    """Mean, maximum and last valid token, one after the other."""
    with_tokens = bundles.withColumn("__t", _valid_tokens())
    count = F.size("__t")
    mean = F.transform(_fold(F.col("__t"), lambda a, b: a + b), lambda v: v / count)
    top = _fold(F.col("__t"), lambda a, b: F.greatest(a, b))
    last = F.get("__t", count - 1)
    return with_tokens.withColumn(out, F.when(count > 0, F.concat(mean, top, last))).drop("__t")


def pad_right(bundles: DataFrame, length: int | None = None) -> DataFrame:
    """Pads all five arrays to ``length`` (default: the longest sample).

    Added tokens are zero with mask false, invalid tokens are zeroed too. Adds
    ``all_invalid`` for samples a batch must refuse.
    """
    target = F.lit(length) if length else bundles.agg(F.max(F.size("x")).alias("n")).select("n").scalar()
    width = F.size(F.get("x", F.lit(0)))
    extra = F.greatest(target - F.size("x"), F.lit(0))
    zero_row = F.array_repeat(F.lit(0.0).cast("float"), width)
    blank = F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    masked = F.zip_with("x", "valid_mask", lambda r, ok: F.when(ok, r).otherwise(zero_row))
    return bundles.withColumns({
        "x": F.concat(masked, F.array_repeat(zero_row, extra)),
        "time_s": F.concat("time_s", F.array_repeat(F.lit(0.0), extra)),
        "support_s": F.concat("support_s", F.array_repeat(blank, extra)),
        "observed_fraction": F.concat("observed_fraction", F.array_repeat(F.lit(0.0).cast("float"), extra)),
        "valid_mask": F.concat("valid_mask", F.array_repeat(F.lit(False), extra)),
        "all_invalid": ~F.exists("valid_mask", lambda v: v),
    })


def model_input(video: DataFrame, telemetry: DataFrame, key: str = "sample_id") -> DataFrame:
    """Only x, valid_mask and time_s of both modalities; both must be there."""
    pick = lambda name: F.struct("x", "valid_mask", "time_s").alias(name)
    return video.select(key, pick("video")).join(telemetry.select(key, pick("can")), key)


def require_no_error(bundles: DataFrame, flag: str, what: str) -> DataFrame:
    return require_none(bundles, F.col(flag), what)
