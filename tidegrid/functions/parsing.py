"""Strict text parsers. A null result marks text the contract rejects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.ids import base_name, drop_extension, full_match


def strict_bool(col: Column) -> Column:
    text = F.lower(F.trim(col))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def strict_int(col: Column) -> Column:
    """Digits with an optional minus; no blanks, plus sign or decimals."""
    return F.when(full_match(col, "-?[0-9]+"), col).try_cast("bigint")


def strict_double(col: Column) -> Column:
    """Number text; ``nan`` and ``inf`` parse and are caught by range rules."""
    return F.trim(col).try_cast("double")


def is_safe_relative_path(col: Column, windows: bool = True) -> Column:
    """Non-empty, relative, no parent step.

    ``windows=True`` also takes backslashes as separators and refuses drive
    letters; ``False`` is the plain POSIX reading.
    """
    if windows:
        rooted = col.rlike(r"(?s)\A(?:.:|[\\/])")
        parts = F.split(F.translate(col, "\\", "/"), "/")
    else:
        rooted = col.startswith("/")
        parts = F.split(col, "/")
    good = (F.length(col) > 0) & ~rooted & ~F.array_contains(parts, "..")
    return F.coalesce(good, F.lit(False))


def source_list(col: Column) -> Column:
    """The entries of a JSON list, or the bare text as the one entry."""
    return F.when(col.startswith("["), F.from_json(col, "array<string>")).otherwise(F.array(col))


def source_stems(col: Column) -> Column:
    """Base names without extension of every non-empty source entry."""
    entries = F.filter(source_list(col), lambda e: e.isNotNull() & (e != ""))
    return F.transform(entries, lambda e: drop_extension(base_name(e)))


def mask_path(col: Column) -> Column:
    """Path before the last ``::`` when the part after it is ``valid_mask``."""
    return F.when(col.rlike(r"(?s)::valid_mask\z"), F.regexp_extract(col, r"(?s)\A(.*)::valid_mask\z", 1))


_JSON_INT = r"-?(?:0|[1-9][0-9]*)"


def int_list(col: Column) -> Column:
    """A JSON list of integers; null for any other text."""
    shape = full_match(col, rf"\s*\[\s*(?:{_JSON_INT}\s*(?:,\s*{_JSON_INT}\s*)*)?\]\s*")
    inner = F.regexp_replace(col, r"[\[\]\s]", "")
    numbers = F.transform(F.split(inner, ","), lambda v: v.try_cast("int"))
    return F.when(shape, F.when(inner == "", F.array().cast("array<int>")).otherwise(numbers))


def positive_shape(col: Column, rank: int = 2) -> Column:
    """``int_list`` kept only when it has ``rank`` positive entries."""
    dims = int_list(col)
    return F.when((F.size(dims) == rank) & F.forall(dims, lambda d: d > 0), dims)


def is_sha256(col: Column) -> Column:
    return F.coalesce(full_match(F.lower(F.trim(col)), "[0-9a-f]{64}"), F.lit(False))


def is_versioned(col: Column) -> Column:
    text = F.lower(col)
    return F.coalesce((text != "") & ~text.isin("latest", "to_be_filled"), F.lit(False))
