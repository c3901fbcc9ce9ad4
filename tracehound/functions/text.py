"""Small text helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = "\x1f"
_BLANK = " \t\n\r\f\x0b ﻿  "


def trim_blank(col: Column) -> Column:
    return F.btrim(col, F.lit(_BLANK))


def bind(col: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``col`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(col), lambda text: body(text)), 1)


def capture(col: Column, pattern: str, groups: int) -> Column:
    """Groups of the first match at positions 1..groups of an array.

    The pattern runs once per row instead of once per group: the match is rewritten
    to its groups with a separator and split. Text that holds the separator itself
    takes the group-by-group path. Use ``captured`` to test for a match.
    """
    anchored = pattern if pattern.startswith("^") else "^(?s:.*?)" + pattern
    anchored = anchored if anchored.endswith("$") else anchored + "(?s:.*)$"
    joined = F.regexp_replace(
        col, anchored, "".join(f"{_UNIT}${i}" for i in range(1, groups + 1))
    )
    by_group = F.array(
        F.lit(""), *[F.regexp_extract(col, pattern, i) for i in range(1, groups + 1)]
    )
    return F.when(
        F.contains(col, F.lit(_UNIT)), F.when(F.regexp_like(col, F.lit(pattern)), by_group)
    ).otherwise(F.split(joined, _UNIT))


def captured(match: Column, groups: int) -> Column:
    return F.coalesce(F.size(match) == groups + 1, F.lit(False))


def leading_int(col: Column) -> Column:
    """Leading integer of a text; text without digits and overflow give NULL."""
    return F.regexp_extract(col, r"^\s*([+-]?\d+)", 1).try_cast("int")


def sql_literal(text: str) -> str:
    """SQL string literal; large expressions are cheaper to build as one SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
