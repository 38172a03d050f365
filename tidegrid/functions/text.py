"""Text policy rules, applied to whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions.numeric import codes_where

# -- patterns of the text policy (fixed values) ------------------------------
MACHINE_PATH = r"""(?<![A-Za-z0-9])[A-Za-z]:[\\/][^\s"']+|/(?:home|Users)/[^\s"']+"""
ACCESS_TOKEN = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{32,}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)"


_END = "tidegrid:end-of-text"


def is_json(text: Column) -> Column:
    """One JSON value and nothing after it.

    The parser stops after the first value, so the text is put in front of a
    marker in a list: only a lone value leaves exactly the two.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    entries = listed.try_cast("array<variant>")
    marker = F.try_variant_get(listed, "$[1]", "string")
    return F.coalesce((F.size(entries) == 2) & (marker == _END), F.lit(False))


def text_policy_codes(text: Column, expect_json: Column | None = None,
                      size_limit: int = C.TEXT_SIZE_LIMIT) -> Column:
    """Codes of one text, whatever its size; ``oversize`` is one more code."""
    oversize = F.octet_length(text) > size_limit
    bad_json = ~is_json(text) if expect_json is not None else F.lit(False)
    wanted = expect_json if expect_json is not None else F.lit(False)
    return codes_where(
        ("oversize", oversize),
        ("machine_path", text.rlike(MACHINE_PATH)),
        ("access_token", text.rlike(ACCESS_TOKEN)),
        ("invalid_json", wanted & bad_json),
    )
