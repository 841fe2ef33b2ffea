"""Rolling totals over trailing calendar periods, quiet days included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_day(df: DataFrame, entity: str, day: str, values: Sequence[str], version: str | None = None) -> DataFrame:
    """One row per entity and day: the last version, or the day's sum if ``version`` is None.

    The aggregate combines on the map side, so an entity with a third of all rows sends at
    most one row per day and input split. Of versions received at the same time the one with
    the greater values holds. A null version is older than any other; null values count 0.
    """
    vs = [F.coalesce(F.col(v), F.lit(0)).cast("bigint" if dict(df.dtypes)[v] in ("int", "smallint", "tinyint", "bigint") else "double").alias(v) for v in values]
    rows = df.where(F.col(day).isNotNull()).select(F.col(entity).alias("__e"), F.to_date(F.col(day)).alias("__d"), *([F.col(version).alias("__v")] if version else []), F.struct(*vs).alias("__x"))
    if version:
        return rows.groupBy("__e", "__d").agg(F.max(F.struct("__v", "__x"))["__x"].alias("__x"))
    return rows.groupBy("__e", "__d").agg(F.struct(*[F.sum(F.col("__x")[v]).alias(v) for v in values]).alias("__x"))


def rolling_totals(df: DataFrame, entity: str, day: str, values: Sequence[str], periods: Sequence[int] = (7, 30), version: str | None = None) -> DataFrame:
    """Totals and averages of ``values`` over the last ``periods`` calendar days.

    Result: ``entity``, ``day``, ``nth_day`` (1 on the entity's first day), each value of the
    day itself, and ``{value}_sum_{n}`` and ``{value}_avg_{n}``; one row for every calendar day
    between the entity's first and last day. Averages divide by the full period.

    Plan: daily aggregate (partial before the shuffle); the entity-calendar product is laid out
    by letting each day emit itself and the quiet days up to the entity's next one, which needs
    neither a join nor a driver-side calendar; then sums over ROWS frames, which after filling
    equal calendar frames. Filling and sums share one partitioning by entity.

    Null days are ignored, a null entity is an entity of its own, null values count 0, an empty
    table gives an empty result; other columns of ``df`` are not read, so their names can't clash.
    """
    whole = Window.partitionBy("__e").orderBy("__d")
    last = F.coalesce(F.date_sub(F.lead("__d").over(whole), 1), F.col("__d"))
    dense = (
        latest_per_day(df, entity, day, values, version)
        .withColumn("__to", last)
        .select("__e", F.col("__d").alias("__own"), "__x", F.explode(F.sequence("__d", "__to")).alias("__d"))
        .select("__e", "__d", *[F.when(F.col("__d") == F.col("__own"), F.col("__x")[v]).otherwise(F.lit(0)).alias(f"__{i}") for i, v in enumerate(values)])
    )
    cols = [F.col("__e").alias(entity), F.col("__d").alias(day), F.row_number().over(whole).alias("nth_day")]
    for i, v in enumerate(values):
        cols.append(F.col(f"__{i}").alias(v))
        for n in periods:
            total = F.sum(f"__{i}").over(whole.rowsBetween(1 - n, 0))
            cols += [total.alias(f"{v}_sum_{n}"), (total / F.lit(float(n))).alias(f"{v}_avg_{n}")]
    return dense.select(*cols)
