"""Number checks, probability vectors and tolerant comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(col: Column) -> Column:
    """Spark has no such function; null counts as not finite."""
    value = col.cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def all_finite(values: Column) -> Column:
    return F.forall(values, is_finite)


def near(left: Column, right: Column, absolute: float, relative: float = 0.0) -> Column:
    """``|left-right| <= absolute + relative*|right|``; equal infinities agree."""
    gap = F.abs(left - right) <= F.lit(absolute) + F.lit(relative) * F.abs(right)
    return F.coalesce((left == right) | (gap & is_finite(right)), F.lit(False))


def same_value(left: Column, right: Column, kind: str, absolute: float = 1e-8,
               relative: float = 1e-5) -> Column:
    """Equality of one identity field held as text or number.

    ``kind`` is ``int``, ``score`` (tolerant) or ``text``. The tolerances of the
    three comparison rules are (1e-8, 1e-5), (1e-6, 0) and (1e-9, 0).
    """
    if kind == "int":
        return F.coalesce(left.cast("bigint") == right.cast("bigint"), F.lit(False))
    if kind == "score":
        return near(left.cast("double"), right.cast("double"), absolute, relative)
    return F.coalesce(left.cast("string") == right.cast("string"), F.lit(False))


def field_kind(name: str) -> str:
    if name == "kss_score":
        return "score"
    if name.endswith("_ms") or name in ("label_id", "window_index"):
        return "int"
    return "text"


def circular(degrees: Column) -> tuple[Column, Column]:
    radians = F.radians(degrees)
    return F.sin(radians), F.cos(radians)


def argmax(values: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, array_sum(values) / F.size(values))


def one_hot(label: Column, classes: int) -> Column:
    return F.array(*[F.when(label == i, 1.0).otherwise(0.0) for i in range(classes)])


def valid_probabilities(values: Column, classes: int, tolerance: float = 1e-5,
                        cap_at_one: bool = False) -> Column:
    """Right width, finite, in range and summing to one.

    ``cap_at_one`` with a tolerance of 1e-6 is the stricter audit rule.
    """
    in_range = F.forall(values, lambda v: is_finite(v) & (v >= 0) & (v <= 1 if cap_at_one else F.lit(True)))
    good = (F.size(values) == classes) & in_range & (F.abs(array_sum(values) - 1.0) <= tolerance)
    return F.coalesce(good, F.lit(False))


def codes_where(*pairs: tuple[str | Column, Column]) -> Column:
    """Array of the codes whose condition holds, in the given order.

    A null condition counts as holding: a rule that cannot be evaluated is
    reported rather than passed over.
    """
    items = [
        F.when(F.coalesce(cond, F.lit(True)), code if isinstance(code, Column) else F.lit(code))
        for code, cond in pairs
    ]
    return F.array_compact(F.array(*items))
