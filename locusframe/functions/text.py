"""Text helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(c: Column, delimiter: str, keep_empty: bool = False) -> Column:
    """Tokens between a literal delimiter, by default without empty ones."""
    parts = F.split(c, re.escape(delimiter))
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def split_last(c: Column, delimiter: str) -> Column:
    """What stands before and after the last delimiter; all of it before, where there is none."""
    n = F.length(F.substring_index(c, delimiter, -1))
    has = F.instr(c, delimiter) > 0
    return F.when(has, F.array(F.substring(c, F.lit(1), F.length(c) - n - len(delimiter)), F.substring_index(c, delimiter, -1))).otherwise(F.array(c, F.lit("")))


def remove_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def squeeze_whitespace(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))
