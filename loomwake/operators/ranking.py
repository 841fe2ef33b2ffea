"""Choosing among scored options, with stated ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: dict[str, Column]) -> Column:
    """The name of the greatest score; of equal ones the first named. Null scores count as lowest."""
    n = len(scores)
    return F.array_max(F.array(*[F.struct(F.coalesce(c.cast("double"), F.lit(float("-inf"))).alias("score"), F.lit(n - i).alias("turn"), F.lit(k).alias("name")) for i, (k, c) in enumerate(scores.items())]))["name"]


def margin(scores: list[Column]) -> Column:
    """The greatest score less the next."""
    s = F.sort_array(F.array(*[c.cast("double") for c in scores]), asc=False)
    return s[0] - s[1]
