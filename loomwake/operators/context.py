"""Each message with everything known about its receiver, group, account and media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sides of a context: their key columns, which messages have too.
SIDES = {"users": ["user_id"], "groups": ["group_id"], "members": ["group_id", "user_id"], "accounts": ["business_id"], "relations": ["user_id", "business_id"], "media": ["media_type", "media_id"]}


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest row of each key (by its other columns in their order), so that no join can multiply rows."""
    rest = [c for c in df.columns if c not in keys]
    known = df.where(" and ".join(f"{k} is not null" for k in keys))
    return known.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__x")).select(*keys, *[F.col("__x")[c].alias(c) for c in rest])


def daily_lists(days: DataFrame, user: str, day: str, values: list[str]) -> DataFrame:
    """Per user the ordered list of days with their values, as ``summaries``; null days are left out.

    A list is as long as the calendar covered, whatever the number of messages.
    """
    return days.where(F.col(day).isNotNull() & F.col(user).isNotNull()).groupBy(user).agg(F.array_sort(F.collect_list(F.struct(day, *values))).alias("summaries"))


def build_context(messages: DataFrame, sides: dict[str, DataFrame], summaries: DataFrame | None = None) -> DataFrame:
    """``messages`` with a struct column for each of ``sides`` (see ``SIDES``), null where nothing is known, and ``summaries``.

    Every side has at most one row per key (see ``one_per_key``). Null keys meet nothing, every
    message stays, repeated ones too. Which sides are broadcast is left to their size, and skewed
    groups and users to adaptive execution, which splits them.
    """
    out = messages
    for name, df in sides.items():
        keys = SIDES[name]
        out = out.join(df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name)), keys, "left")
    return out if summaries is None else out.join(summaries, "user_id", "left")
