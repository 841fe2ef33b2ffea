"""References to records that do not exist, per table and period."""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwake.operators.bitmaps import Bitmap
from loomwake.session import parallelism

#: Distinct (key, period) rows that one key range holds on average.
ROWS_PER_RANGE = 200_000
#: A period name that no time belongs to: its rows survive unless the parent was there ``ALWAYS`` and stays.
UNKNOWN = "unknown"
#: When parents without a receipt time may be said to have come: before every period, the unknown one too.
ALWAYS = "0001-01-01 00:00:00"

_OUT = "domain string, relation string, key string, period string, parent_received timestamp_ntz, parent_deleted timestamp_ntz, parent_exists boolean"


def _survivors(t: pa.Table) -> pa.Table:
    """One key range: keys to codes, a bitmap per period, references AND-NOT parents, decoded.

    A parent is in a period's bitmap if it was received before the period began and was never
    deleted: a reference to it in that period can't be broken. What survives is missing or needs
    its exact times compared; the times of its parent are attached here, where both are at hand.
    """
    full = pa.compute.binary_join_element_wise(t["domain"].cast("string"), t["key"].cast("string"), "\x00").combine_chunks()
    coded = full.dictionary_encode()
    code, n = np.asarray(coded.indices), len(coded.dictionary)
    parent = np.asarray(t["is_parent"].combine_chunks().cast(pa.uint8())).astype(bool)
    received = np.asarray(t["received"].combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).max))
    deleted = np.asarray(t["deleted"].combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).max))
    never = np.iinfo(np.int64).max
    first, gone, there = np.full(n, never), np.full(n, never), np.zeros(n, bool)
    np.minimum.at(first, code[parent], received[parent])
    np.minimum.at(gone, code[parent], deleted[parent])
    there[code[parent]] = True
    stays = there & (gone == never)
    rel = pa.compute.binary_join_element_wise(t["relation"].cast("string").fill_null(""), t["period"].cast("string").fill_null(""), "\x00").combine_chunks().dictionary_encode()
    group = np.asarray(rel.indices)
    keep: list[np.ndarray] = []
    for g, name in enumerate(rel.dictionary.to_pylist()):
        mine = np.flatnonzero((group == g) & ~parent)
        if not len(mine):
            continue
        period = name.split("\x00")[1]
        since = np.datetime64(ALWAYS.replace(" ", "T") if period == UNKNOWN else f"{period}-01", "us").astype(np.int64)
        left = Bitmap.of(code[mine]).andnot(Bitmap.of(np.flatnonzero(stays & (first <= since))))
        alive = np.zeros(n, bool)
        alive[left.decode()] = True
        keep.append(mine[alive[code[mine]]])
    rows = np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64)
    took = t.select(["domain", "relation", "key", "period"]).take(pa.array(rows))
    c = code[rows]
    time = lambda x: pa.array(x, mask=x == never).cast(pa.timestamp("us"))
    return took.append_column("parent_received", time(first[c])).append_column("parent_deleted", time(gone[c])).append_column("parent_exists", pa.array(there[c]))


def unresolved(refs: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """Reference keys whose parent is missing, late or deleted in some period.

    ``refs``: ``domain`` (which parent table), ``relation`` (the referring field), ``key``,
    ``period`` (``yyyy-MM`` or ``unknown``). ``parents``: ``domain``, ``key``, ``received``
    and ``deleted`` (timestamps, nullable). The result holds each surviving (domain, relation,
    key, period) once, with ``parent_exists``, ``parent_received`` and ``parent_deleted``
    (earliest of the parent's rows). Survivors with an existing parent are candidates: the
    caller compares their exact times.

    References are reduced to distinct (key, period) before the shuffle, so a key with a third
    of all rows costs one row per period and input split. Key ranges are hash ranges with about
    ``ROWS_PER_RANGE`` rows each, whatever the tables' size; nothing is broadcast. A reference
    with null ``key`` is not a reference and is ignored; a null ``received`` counts as never,
    ``ALWAYS`` as before every period.
    Without parents every reference survives, without references the result is empty.
    """
    r = refs.where("domain is not null and key is not null").select("domain", "relation", "key", F.coalesce("period", F.lit(UNKNOWN)).alias("period"), F.lit(None).cast("timestamp_ntz").alias("received"), F.lit(None).cast("timestamp_ntz").alias("deleted"), F.lit(False).alias("is_parent"))
    p = parents.where("domain is not null and key is not null").select("domain", F.lit(None).cast("string").alias("relation"), "key", F.lit(None).cast("string").alias("period"), F.col("received").cast("timestamp_ntz").alias("received"), F.col("deleted").cast("timestamp_ntz").alias("deleted"), F.lit(True).alias("is_parent"))
    if ranges is None:
        ranges = max(parallelism(refs.sparkSession), math.ceil((refs.count() + parents.count()) / ROWS_PER_RANGE))
    rows = r.unionByName(p).withColumn("__range", F.pmod(F.xxhash64("domain", "key"), F.lit(ranges)))
    rows = rows.groupBy("__range", "domain", "relation", "key", "period", "is_parent").agg(F.min("received").alias("received"), F.min("deleted").alias("deleted"))
    return rows.groupBy("__range").applyInArrow(_survivors, _OUT)
