"""Identifier columns: compared and returned trimmed and in lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outer blanks that identifiers may carry.
BLANKS = " \t\r\n "


def ident(c: Column | str) -> Column:
    """``c`` without outer blanks, in lower case; null stays null, blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def minute_text(c: Column | str) -> Column:
    """A timestamp as ``yyyy-MM-dd HH:mm`` by its own wall clock, whatever the session zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c.cast("string"), 1, 16)


def month_text(c: Column | str) -> Column:
    """A timestamp's ``yyyy-MM``; ``unknown`` if null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.substring(c.cast("string"), 1, 7), F.lit("unknown"))
