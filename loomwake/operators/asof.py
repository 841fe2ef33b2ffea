"""Attributes as known at event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time slices that split a hot entity, in seconds.
SLICE_S = 14 * 86_400
#: Ties at one instant: what was carried in, then attribute changes, then events.
CARRIED, CHANGE, EVENT = 0, 1, 2


def known_at(events: DataFrame, changes: DataFrame, keys: Sequence[str], event_time: str, change_time: str, payload: Sequence[str], values: Sequence[str], slice_s: int = SLICE_S) -> DataFrame:
    """Pair each event with the attribute values in force at its time.

    ``events`` has ``keys``, ``event_time`` and ``payload``; ``changes`` has ``keys``,
    ``change_time`` (when the values became known) and ``values``. The result has every event
    with non-null keys and time: ``keys``, ``event_time``, ``payload``, ``known_since`` and
    ``values`` (null if nothing was known yet) and ``latest_change``, the entity's last change
    at any time, which shows whether a join to the latest values would have leaked.

    Method: events and changes are united and sorted by entity, time and priority (a change at
    the event's own instant is in force), and the last change is carried forward. An entity may
    hold a third of all rows, so its history is cut into time slices: a summary with one row per
    entity and slice (combined before the shuffle) tells what each slice inherits, that row is
    put at the head of the slice, and every slice is carried forward on its own.

    Of changes at one instant the one with the greater values holds. Changes with a null key or
    time are ignored. Repeated events stay repeated. Empty tables give an empty result or no
    known values. Only the named columns are read, so others may have any name.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(a) for k, a in zip(keys, ks)]
    at = lambda c: F.col(c).cast("timestamp_ntz").alias("__t")
    have = lambda df: df.where(" and ".join(f"{k} is not null" for k in [*ks, "__t"]))
    ev = have(events.select(*named, at(event_time), F.struct(*[F.col(p) for p in payload]).alias("__p")))
    ch = have(changes.select(*named, at(change_time), F.struct(F.col(change_time).cast("timestamp_ntz").alias("since"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("__v")))
    p_type, v_type = ev.schema["__p"].dataType, ch.schema["__v"].dataType
    rows = ev.withColumns({"__o": F.lit(EVENT), "__v": F.lit(None).cast(v_type)}).unionByName(ch.withColumns({"__o": F.lit(CHANGE), "__p": F.lit(None).cast(p_type)}))
    rows = rows.withColumn("__s", F.floor(F.unix_micros(F.col("__t").cast("timestamp")) / F.lit(slice_s * 1_000_000)))
    summary = rows.groupBy(*ks, "__s").agg(F.max("__v").alias("__last"))
    by_key = Window.partitionBy(*ks)
    before = by_key.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    heads = summary.select(*ks, "__s", F.max("__last").over(before).alias("__v"), F.max("__last").over(by_key)["since"].alias("__latest"))
    heads = heads.where("__latest is not null").withColumns({"__t": F.lit(None).cast("timestamp_ntz"), "__o": F.lit(CARRIED), "__p": F.lit(None).cast(p_type)})
    by_slice = Window.partitionBy(*ks, "__s").orderBy(F.col("__t").asc_nulls_first(), "__o", F.col("__v").asc_nulls_first())
    upto = by_slice.rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        rows.withColumn("__latest", F.lit(None).cast("timestamp_ntz"))
        .unionByName(heads)
        .withColumns({"__v": F.last("__v", ignorenulls=True).over(upto), "__latest": F.last("__latest", ignorenulls=True).over(upto)})
        .where(F.col("__o") == EVENT)
    )
    return carried.select(
        *[F.col(a).alias(k) for k, a in zip(keys, ks)],
        F.col("__t").alias(event_time),
        *[F.col("__p")[p].alias(p) for p in payload],
        F.col("__v")["since"].alias("known_since"),
        *[F.col("__v")[f"v{i}"].alias(v) for i, v in enumerate(values)],
        F.col("__latest").alias("latest_change"),
    )
