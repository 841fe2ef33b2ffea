"""Near-duplicate records by ProbMinHash signatures, banding and verification."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwake.llm.normalize import canonical
from loomwake.session import cut, drop_cut

#: Most likely miss of a pair that is just alike enough, by the bands and by the one-bit registers.
MISSED_BY_BANDS, MISSED_BY_BITS = 2e-4, 1e-5
#: Registers of a signature that bands may use, and bits of the sketch kept with each band row.
REGISTERS, BITS = 256, 192
#: Share of its bits in which sketches by parity may differ at most; of larger sets they would tell too little.
PARITY_SHARE = 0.3
#: Elements worked on at once.
ELEMENTS = 150_000

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(64)
def plan(threshold: float) -> tuple[int, int, int]:
    """Bands, registers a band, and how many one-bit registers must agree, for pairs alike from ``threshold`` on.

    Registers agree with the probability of the similarity, so a pair at the threshold ``t`` shares
    none of ``b`` bands of ``r`` with probability ``(1 - t**r)**b``; of one-bit registers ``(1 + t) / 2``
    agree. The bands are the most selective ones whose misses, and the agreement the highest whose
    misses, stay within the bounds above; pairs more alike are missed less.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    bands, rows = REGISTERS, 1
    for r in range(1, 33):
        t = min(threshold, 1 - 1e-9)
        b = max(1, math.ceil(math.log(MISSED_BY_BANDS) / math.log1p(-(t**r))))
        if b * r <= REGISTERS:
            bands, rows = b, r
    p, k, below = (1 + threshold) / 2, 0, 0.0
    while k < BITS and (below := below + math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k)) <= MISSED_BY_BITS:
        k += 1
    return bands, rows, k


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function on arrays (SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def prob_minhash(elements: np.ndarray, weights: np.ndarray | None, off: np.ndarray, m: int) -> np.ndarray:
    """Signatures of weighted sets: for each of ``m`` registers the element that arrives first.

    Each element is a Poisson process with its weight as rate and its own random stream; every
    arrival goes to a random register and the earliest one holds it. Two registers agree with
    the probability Jaccard similarity of the sets, which for equal weights is Jaccard's. The
    arrivals are made in rounds, one per element, for all sets at once; an element stops as soon
    as its next arrival is later than all registers of its set. ``elements`` must be distinct
    within a set and weights positive. An empty set has only zeros.
    """
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    elements = elements.astype(np.uint64)
    rate = np.ones(len(elements)) if weights is None else weights.astype(float)
    best, who = np.full((n, m), np.inf), np.zeros((n, m), np.uint64)
    flat, who_flat = best.reshape(-1), who.reshape(-1)
    active, time, state = np.arange(len(elements)), np.zeros(len(elements)), mix(elements + _GOLD)
    latest = np.full(n, np.inf)
    turn = 0
    while len(active):
        with np.errstate(over="ignore"):
            state = state + _GOLD
        r = mix(state)
        time = time - np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) / 2.0**40) / rate[active]
        o = owner[active]
        go = time < latest[o]
        if not go.all():
            active, time, state, r, o = active[go], time[go], state[go], r[go], o[go]
        at = o * m + ((r & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(flat, at, time)
        won = flat[at] == time
        who_flat[at[won]] = elements[active[won]]
        turn += 1
        if turn % 8 == 0:
            latest = best.max(axis=1)
    return who


def band_keys(who: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each set and band."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD), (len(who), bands)).copy()
        for j in range(rows):
            key = mix(key * _M1 + who[:, j : bands * rows : rows])
    return key


_SKETCH = [f"__b{i}" for i in range(BITS // 64)]


def _bits(who: np.ndarray) -> np.ndarray:
    """The lowest mixed bits of the first ``BITS`` registers, as 64-bit words."""
    who = who if who.shape[1] >= BITS else np.concatenate([who, np.zeros((len(who), BITS - who.shape[1]), np.uint64)], axis=1)
    low = (mix(who[:, :BITS]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(low, axis=1).view(np.uint64)


def parity_limit(threshold: float) -> tuple[float, float]:
    """Of two sets alike from ``threshold`` on: the share of the sum of their sizes that they may differ by, and the largest size of sets told by parity."""
    share = (1 - threshold) / (1 + threshold)
    return share, PARITY_SHARE * BITS / (2 * max(share, 1e-9))


def _parity(elements: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each set, whether each of ``BITS`` buckets has an odd number of its elements, as 64-bit words.

    An element that only one of two sets has turns one bit, so they differ by at least as many elements as bits.
    """
    n = len(off) - 1
    at = np.repeat(np.arange(n), np.diff(off)) * BITS + (mix(elements ^ _M2) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1).view(np.uint64)


def _band_rows(batches: Iterator[pa.RecordBatch], bands: int, rows: int, threshold: float) -> Iterator[pa.RecordBatch]:
    _, largest = parity_limit(threshold)
    for b in batches:
        sets = b.column("__set")
        off = np.asarray(sets.offsets).astype(np.int64)
        values = np.asarray(sets.values).astype(np.int64).view(np.uint64)
        weight = np.asarray(b.column("__weight").values).astype(float) if "__weight" in b.schema.names else None
        ids = np.asarray(b.column("__c"))
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + ELEMENTS, "right")) - 1)
            part = off[lo : hi + 1]
            who = prob_minhash(values[part[0] : part[-1]], None if weight is None else weight[part[0] : part[-1]], part - part[0], max(bands * rows, BITS))
            n = np.diff(part).astype(np.int32) if weight is None else np.add.reduceat(weight[part[0] : part[-1]], part[:-1] - part[0])
            keys = band_keys(who, bands, rows)
            by_parity = n <= largest if weight is None else np.zeros(hi - lo, bool)
            by_registers = n >= threshold * largest - 1e-6 if weight is None else ~by_parity
            for kind, which, sketch in ((0, by_parity, lambda part=part: _parity(values[part[0] : part[-1]], part - part[0])), (1, by_registers, lambda who=who: _bits(who))):
                if not which.any():
                    continue
                key = keys[which] & ~np.uint64(1) | np.uint64(kind)
                bits = [pa.array(np.tile(x, bands).view(np.int64)) for x in sketch()[which].T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.T.reshape(-1).view(np.int64)), pa.array(np.tile(ids[lo:hi][which], bands)), pa.array(np.tile(n[which], bands)), *bits],
                    ["__band", "__c", "__n", *_SKETCH],
                )
            lo = hi


def words(c: Column | str, one_form: bool = True) -> Column:
    """Words without letter case, outer punctuation and character variants, in order; empty ones left out."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.replace(F.lower(canonical(c)["text"] if one_form else c), F.lit("ß"), F.lit("ss"))
    bare = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", ""))
    return F.filter(bare, lambda w: w != "")


def shingles(ws: Column, k: int) -> Column:
    """Hashes of ``k`` consecutive words; a text with fewer words is one shingle."""
    if k == 1:
        return F.transform(ws, lambda w: F.xxhash64(w))
    n = F.size(ws)
    whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(ws, " "))))
    return F.when(n < k, whole).otherwise(F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, k), " "))))


def records(df: DataFrame, id_col: str, words_col: str, k: int = 5, repeats: bool = False) -> DataFrame:
    """``__id``, the class ``__c`` of records with the same shingles, and ``__set`` of every record, written once where it lies.

    Records without words have no class. With ``repeats`` a shingle weighs as often as it occurs
    (``__weight``, beside ``__set``), and a class has the same shingles as often. ``__check`` is a
    second hash of the same, by which two sets that share a class by chance are told (see ``representatives``).
    """
    if repeats:
        at = F.filter(F.sequence(F.lit(0), F.size("__all") - 1), lambda i: (i == 0) | (F.get("__all", i) != F.get("__all", i - 1)))
        d = df.select(F.col(id_col).alias("__id"), F.array_sort(shingles(F.col(words_col), k)).alias("__all")).where("__id is not null and size(__all) > 0")
        d = d.withColumn("__at", at).withColumn("__n", F.size("__all"))
        weight = F.transform("__at", lambda i, j: (F.coalesce(F.get("__at", j + 1), F.col("__n")) - i).cast("double"))
        d = d.select("__id", F.transform("__at", lambda i: F.get("__all", i)).alias("__set"), weight.alias("__weight"))
        named = ("__set", "__weight")
    else:
        d = df.select(F.col(id_col).alias("__id"), F.array_sort(F.array_distinct(shingles(F.col(words_col), k))).alias("__set")).where("__id is not null and size(__set) > 0")
        named = ("__set",)
    return cut(d.withColumns({"__c": F.xxhash64(*named), "__check": F.hash(*named)}))


def members(rows: DataFrame) -> DataFrame:
    """``__id`` and class of every record; ids that repeat with equal words are one record."""
    return rows.select("__id", "__c").distinct()


def representatives(rows: DataFrame) -> DataFrame:
    """One row a class: its shingles, once however many records have them.

    Copies are combined before the shuffle. An error tells of a class whose records' second
    hashes differ: different sets would be taken for equal. ``__c`` stays as it was grouped, so
    joins on it need no other shuffle.
    """
    rest = [c for c in ("__set", "__weight") if c in rows.columns]
    one = rows.where("__c is not null").groupBy("__c").agg(*[F.first(c).alias(c) for c in rest], F.min("__check").alias("x"), F.max("__check").alias("y"))
    sound = lambda c: F.when(F.col("x") == F.col("y"), F.col(c)).otherwise(F.raise_error(F.lit("two different sets have one class id")))
    return one.select("__c", *[sound(c).alias(c) for c in rest])


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``__a`` < ``__b`` of classes that may be alike from ``threshold`` on.

    Band rows are joined on the band key (a sort-merge join whose hot keys adaptive execution splits; nothing
    is capped). Chance candidates grow as the square of the classes, so nearly all must be dropped inside the
    join, before any shuffle: by the size ratio and by a sketch. Sketches of smaller sets are parities of
    their elements, which bound the difference of two sets and so miss none; those of larger sets are one-bit registers, of
    which enough must agree. Sets of sizes between have band rows of both kinds (the last bit of
    the band key), so that any two of near sizes meet in one.
    """
    bands, rows, agree = plan(threshold)
    share, _ = parity_limit(threshold)
    weighted = "__weight" in reps.columns
    sig = reps.mapInArrow(lambda it: _band_rows(it, bands, rows, threshold), f"__band long, __c long, __n {'double' if weighted else 'int'}, " + ", ".join(f"{c} long" for c in _SKETCH))
    a, b = sig.alias("a"), sig.alias("b")
    differ = reduce(operator.add, [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in _SKETCH])
    most = F.when(F.col("a.__band").bitwiseAND(F.lit(1)) == 0, (F.col("a.__n") + F.col("b.__n")) * F.lit(share) + 1e-6).otherwise(F.lit(float(BITS - agree)))
    near = (F.col("a.__c") < F.col("b.__c")) & (F.least("a.__n", "b.__n") >= F.lit(threshold) * F.greatest("a.__n", "b.__n") - 1e-9) & (differ <= most)
    return a.hint("merge").join(b, (F.col("a.__band") == F.col("b.__band")) & near).select(F.col("a.__c").alias("__a"), F.col("b.__c").alias("__b")).distinct()


def class_links(reps: DataFrame, threshold: float) -> DataFrame:
    """Links ``__a`` < ``__b`` with ``similarity`` >= ``threshold`` between classes, given their ``representatives``.

    Bands, registers and the agreement asked for follow from the threshold (``plan``); ``candidates`` are
    verified on the full sets.

    With a column ``__weight`` (weights of the shingles of ``__set``) the similarity is the
    weighted one, the sum of the lesser weights by that of the greater. Probability Jaccard
    similarity, by which signatures agree, is never less, so no more pairs are missed.
    """
    pairs = candidates(reps, threshold)
    if "__weight" in reps.columns:
        return _weighted_links(pairs, reps, threshold)
    both = pairs.join(reps.select(F.col("__c").alias("__a"), F.col("__set").alias("__sa")), "__a").join(reps.select(F.col("__c").alias("__b"), F.col("__set").alias("__sb")), "__b")
    common = F.size(F.array_intersect("__sa", "__sb"))
    similarity = common / (F.size("__sa") + F.size("__sb") - common)
    return both.select("__a", "__b", similarity.alias("similarity")).where(F.col("similarity") >= F.lit(threshold - 1e-12))


def _weighted_links(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Links of the pairs by weighted similarity, from one row per pair and common shingle."""
    total = F.aggregate("__weight", F.lit(0.0), lambda x, w: x + w)
    side = lambda c, x: reps.select(F.col("__c").alias(c), F.arrays_zip("__set", "__weight").alias(x), total.alias(f"{x}_total"))
    both = pairs.join(side("__a", "__x"), "__a").join(side("__b", "__y"), "__b")
    either = both.select("__a", "__b", (F.col("__x_total") + F.col("__y_total")).alias("__total"), F.explode(F.concat("__x", "__y")).alias("e"))
    each = either.groupBy("__a", "__b", "__total", "e.__set").agg(F.when(F.count("*") > 1, F.min("e.__weight")).otherwise(0.0).alias("w"))
    common = each.groupBy("__a", "__b", "__total").agg(F.sum("w").alias("w"))
    similarity = F.col("w") / (F.col("__total") - F.col("w"))
    return common.select("__a", "__b", similarity.alias("similarity")).where(F.col("similarity") >= F.lit(threshold - 1e-12))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Connected components: ``__c`` and ``__root``, the least class it is linked to.

    Large-star and small-star rounds on the edge table, cut after each round; the star centres
    are minima (combined before the shuffle), so a hub is never gathered in one place. Ends when
    a round leaves the edges as they were.
    """
    edges = cut(links.select(F.col("__a").alias("u"), F.col("__b").alias("v")).distinct())
    stamp = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1_000_003))).first()
    seen = stamp(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, cut(small)
        drop_cut(before)
        if (now := stamp(edges)) == seen:
            break
        seen = now
    roots = edges.groupBy("u").agg(F.min("v").alias("__root")).withColumnRenamed("u", "__c")
    return roots.unionByName(edges.select(F.col("v").alias("__c")).distinct().join(roots.select("__c"), "__c", "left_anti").withColumn("__root", F.col("__c")))


def near_duplicates(df: DataFrame, id_col: str, words_col: str, k: int = 5, threshold: float = 0.8, repeats: bool = False) -> DataFrame:
    """One row per id: ``id_col``, ``class_id``, ``group_id`` and ``n_links``.

    ``class_id`` is the least id of the records with equal shingles; ``group_id`` the least one of
    all classes connected by a similarity that reaches ``threshold``; ``n_links`` how many other
    classes this class is linked to. ``words_col`` is an array of words, see ``words``.

    Null ids and records without words are left out; an empty table gives an empty result;
    repeated rows count once. An id that comes with different words has a row for each. With
    ``repeats`` a shingle weighs as often as it occurs, see ``class_links``.
    """
    rows = records(df, id_col, words_col, k, repeats)
    links = cut(class_links(representatives(rows), threshold))
    degree = links.select(F.explode(F.array("__a", "__b")).alias("__c")).groupBy("__c").agg(F.count("*").alias("__links"))
    first = rows.groupBy("__c").agg(F.min("__id").alias("__first"))
    about = first.join(degree, "__c", "left").join(components(df.sparkSession, links), "__c", "left").withColumn("__root", F.coalesce("__root", "__c"))
    group = about.groupBy("__root").agg(F.min("__first").alias("__group"))
    about = about.join(group, "__root").select("__c", "__first", "__group", F.coalesce("__links", F.lit(0)).alias("__links"))
    out = members(rows).join(about, "__c")
    return out.select(F.col("__id").alias(id_col), F.col("__first").alias("class_id"), F.col("__group").alias("group_id"), F.col("__links").alias("n_links"))


def near_pairs(df: DataFrame, id_col: str, words_col: str, k: int = 5, threshold: float = 0.8, repeats: bool = False) -> DataFrame:
    """All pairs of ids, smaller first, whose similarity reaches ``threshold``.

    Links are found between classes and then given to their members; copies of one text pair
    among themselves; ``repeats`` as in ``near_duplicates``. Rows as many as the pairs, by definition; see ``near_duplicates`` for a
    result with a row per id.
    """
    rows = records(df, id_col, words_col, k, repeats)
    links = class_links(representatives(rows), threshold).select("__a", "__b")
    m = members(rows)
    left, right = m.select(F.col("__id").alias("x"), F.col("__c").alias("__a")), m.select(F.col("__id").alias("y"), F.col("__c").alias("__b"))
    across = links.join(left, "__a").join(right, "__b").where("x <> y")
    copied = m.groupBy("__c").agg(F.count("*").alias("n")).where("n > 1").select(F.col("__c").alias("__a"))
    within = left.join(copied, "__a", "left_semi").join(right.withColumnRenamed("__b", "__a"), "__a").where("x < y")
    return across.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).unionByName(within.select(F.col("x").alias(f"{id_col}_a"), F.col("y").alias(f"{id_col}_b"))).distinct()
