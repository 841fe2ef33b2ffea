"""Passages of held-out evaluation texts inside a corpus, by winnowed word fingerprints.

Of every ``W`` consecutive hashes of ``K`` words the least is kept as a fingerprint, on both
sides by the same rule, so any span of ``K + W - 1`` words shared with an item shares a
fingerprint. Both sides are tables of fingerprints, joined on them; hits are then extended on the
words themselves. Before the join a bit table of fixed size, set by the items' fingerprints, drops
nearly all of the corpus's, so its texts are read once and hardly anything of them is shuffled.

Items so short that the allowed edits may leave no such span have other fingerprints: all their
hashes of as many words as every leak of them must keep together, sought at every place of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwake.llm import codepoints as C
from loomwake.llm.words import MULTIPLIER, Words
from loomwake.llm.words import mix as _mix
from loomwake.session import cut

#: Words a fingerprint spans, and the window of which the least hash is kept: spans of 6 words are found.
K, W = 3, 4
#: What counts as a leak: so many consecutive words, or the whole item with this share of words changed.
RUN_WORDS, EDIT_SHARE = 16, 1 / 8
#: Share of an item's words that its hits must touch before its whole is aligned.
LEAST_COVER = 0.2
#: Bits of the table of the items' fingerprints. A full table drops nothing; the join is exact either way.
BITS = 1 << 21
#: Words compared at once when hits are extended.
AT_ONCE = 4_000_000
#: Kinds of fingerprints: winnowed ones, and all hashes of three, two or one word, for short items.
WINNOWED, THREE, TWO, ONE = 0, 3, 2, 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words; the array is ``k - 1`` shorter."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            g = _mix(g * np.uint64(MULTIPLIER) + h[j : len(h) - k + 1 + j])
    return g


def winnow(g: np.ndarray, row: np.ndarray, w: int = W) -> np.ndarray:
    """Positions kept: the last least hash of every ``w`` consecutive ones of one text, and all of texts with fewer."""
    n = len(g)
    if not n:
        return np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    best, at = g.copy(), np.arange(n)
    m = n - w + 1
    if m > 0:
        best, at = g[:m].copy(), np.arange(m)
        for j in range(1, w):
            less = g[j : m + j] <= best
            best[less] = g[j : m + j][less]
            at[less] = np.arange(j, m + j)[less]
        keep[at[row[:m] == row[w - 1 : m + w - 1]]] = True
    counts = np.bincount(row)
    keep |= counts[row] < w
    return np.flatnonzero(keep)


def edits_allowed(n_words: int, share: float = EDIT_SHARE) -> int:
    return int(n_words * share + 0.5)


def item_kind(n: int, n_words: int, run_words: int = RUN_WORDS, share: float = EDIT_SHARE) -> tuple[int, int]:
    """Kind of fingerprints an item of ``n`` words has, and how many of them any text that leaks it must share.

    With ``e`` words replaced, added or left out, the unchanged ones lie in ``e + 1`` stretches, of
    which the longest has at least ``(n - e) / (e + 1)``; that, or a run, decides the kind. All but one
    stretch may each be a word too short for any fingerprint. ``n_words`` counts words between blanks.
    """
    e = edits_allowed(n_words, share)
    run = min(run_words, n_words)
    longest = min(-(-(n - e) // (e + 1)), run) if n > e else 1
    if longest >= K + W - 1:
        spare = n - e - (K + W - 2) * (e + 1)
        return WINNOWED, max(1, min((run - K + 1) // W, (W - 1 + spare) // W))
    k = max(1, min(longest, 3))
    return k, max(1, min(run - k + 1, n - e - (k - 1) * (e + 1)))


def fingerprints(w: Words, kinds: list[int], bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and value of each fingerprint of these kinds, by text; only those whose bit is set."""
    rows, places, prints = [], [], []
    for kind in kinds:
        g, row, at = gram_rows(w, kind or K)
        if kind == WINNOWED:
            kept = winnow(g, row)
            g, row, at = g[kept], row[kept], at[kept]
        p = _mix(g ^ np.uint64((kind + 1) * 0x51ED270B))
        if bits is not None:
            ok = np.flatnonzero(bits[(p & np.uint64(BITS - 1)).astype(np.int64)])
            p, row, at = p[ok], row[ok], at[ok]
        rows.append(row)
        places.append(at)
        prints.append(p)
    row, at, p = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(prints or [np.zeros(0, np.uint64)])
    order = np.argsort(row, kind="stable") if len(kinds) > 1 else np.arange(len(row))
    return row[order], at[order], p[order]


def gram_rows(w: Words, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``k`` words within one text, the text and the place among its words."""
    g = grams(w.hash, k)
    same = w.row[: len(g)] == w.row[k - 1 : len(g) + k - 1] if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(same)
    return g[at], w.row[at], at - w.start[w.row[at]]


def short_words(w: Words) -> np.ndarray:
    """Half of each word's hash: enough to compare words whose fingerprints agree."""
    return (w.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def extend(item: np.ndarray, item_off: np.ndarray, blank: np.ndarray, doc: np.ndarray, doc_off: np.ndarray, pair: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hit (its pair and offset of the item in the text) the longest common run and the words in common.

    All hits are laid end to end and compared at once. ``item`` and ``doc`` hold the words of
    each pair's two sides; runs are counted in words between blanks that are in them whole.
    """
    n, m = np.diff(item_off)[pair], np.diff(doc_off)[pair]
    lo, hi = np.maximum(0, -shift), np.minimum(n, m - shift)
    size = np.maximum(hi - lo, 0)
    if size.sum() > AT_ONCE and len(pair) > 1:
        half = len(pair) // 2
        both = [extend(item, item_off, blank, doc, doc_off, pair[x], shift[x]) for x in (slice(None, half), slice(half, None))]
        return np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
    hit = np.repeat(np.arange(len(pair)), size)
    j = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lo[hit]  # place in the item
    at = item_off[pair][hit] + j
    eq = item[at] == doc[doc_off[pair][hit] + j + shift[hit]]
    common = np.bincount(hit, eq, len(pair)).astype(np.int64)
    new = np.ones(len(hit), bool)
    new[1:] = hit[1:] != hit[:-1]
    first = np.flatnonzero(eq & (new | ~np.append(False, eq[:-1])))
    last = np.flatnonzero(eq & (np.append(new[1:], True) | ~np.append(eq[1:], False)))
    a, b = at[first], at[last]  # of the run, both within the item
    begin, end = item_off[pair][hit[first]], item_off[pair + 1][hit[first]]
    before = (a > begin) & (blank[np.maximum(a - 1, 0)] == blank[a])
    after = (b + 1 < end) & (blank[np.minimum(b + 1, len(blank) - 1)] == blank[b])
    run = np.zeros(len(pair), np.int64)
    np.maximum.at(run, hit[first], blank[b] - blank[a] + 1 - before - after)
    return run, common


def edits(item: np.ndarray, doc: np.ndarray) -> int:
    """Fewest word edits between the item and any stretch of ``doc`` (Myers' bit-parallel distance)."""
    n = len(item)
    peq: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best = full, 0, n, n
    for x in doc.tolist():
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


def verify(item: np.ndarray, item_off: np.ndarray, blank: np.ndarray, doc: np.ndarray, doc_off: np.ndarray, pair: np.ndarray, shift: np.ndarray, run_words: int = RUN_WORDS, share: float = EDIT_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs are leaks, with the longest run and, where that isn't enough, the word edits of the whole."""
    pairs = len(item_off) - 1
    order = np.lexsort((shift, pair))
    pair, shift = pair[order], shift[order]
    once = np.append(True, (pair[1:] != pair[:-1]) | (shift[1:] != shift[:-1])) if len(pair) else np.zeros(0, bool)
    pair, shift = pair[once], shift[once]
    runs, commons = extend(item, item_off, blank, doc, doc_off, pair, shift)
    run = np.zeros(pairs, np.int64)
    np.maximum.at(run, pair, runs)
    common = np.bincount(pair, commons, pairs)
    n = np.diff(item_off)
    n_words = np.where(n > 0, blank[np.maximum(item_off[1:] - 1, 0)] - blank[np.minimum(item_off[:-1], max(len(blank) - 1, 0))] + 1, 0) if len(blank) else n
    leak = (run >= np.minimum(run_words, n_words)) & (n > 0)
    wrong = np.where(leak, np.where(run >= run_words, 0, n), n)
    most = np.floor(n_words * share + 0.5).astype(np.int64)
    slack = n // 2 + 8
    new = np.append(True, (pair[1:] != pair[:-1]) | (shift[1:] - shift[:-1] > slack[pair[1:]])) if len(pair) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    of, lo, hi = pair[head], shift[head], shift[np.append(head[1:], len(pair)) - 1] if len(head) else shift[head]
    some = (run[of] < run_words) & (common[of] >= LEAST_COVER * n[of]) & (n[of] > 0)
    of, lo, hi = of[some], lo[some], hi[some]
    near = n[of] - _near(item, item_off, doc, doc_off, of, lo - most[of], hi + most[of]) <= most[of]
    for k, x, y in zip(of[near], lo[near], hi[near]):
        mine, text = item[item_off[k] : item_off[k + 1]], doc[doc_off[k] : doc_off[k + 1]]
        wrong[k] = min(wrong[k], edits(mine, text[max(0, x - slack[k]) : min(len(text), y + len(mine) + slack[k])]))
        leak[k] |= wrong[k] <= most[k]
    return leak, run, wrong


def _near(item: np.ndarray, item_off: np.ndarray, doc: np.ndarray, doc_off: np.ndarray, pair: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many words of each pair's item stand in the text at some offset from ``lo`` to ``hi``: no alignment there keeps more."""
    n = np.diff(item_off)[pair]
    if n.sum() > AT_ONCE and len(pair) > 1:
        half = len(pair) // 2
        return np.concatenate([_near(item, item_off, doc, doc_off, pair[x], lo[x], hi[x]) for x in (slice(None, half), slice(half, None))])
    owner = np.repeat(np.arange(len(pair)), n)
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    word = item[item_off[pair][owner] + j]
    begin, end = doc_off[pair][owner], doc_off[pair + 1][owner]
    at, last = begin + j + lo[owner], begin + j + hi[owner]
    seen, open_ = np.zeros(len(word), bool), np.arange(len(word))
    while len(open_):  # words not yet seen, one offset further at a time
        x = at[open_]
        inside = (x >= begin[open_]) & (x < end[open_])
        hit = inside & (doc[np.minimum(np.maximum(x, 0), max(len(doc) - 1, 0))] == word[open_])
        seen[open_[hit]] = True
        at[open_] += 1
        open_ = open_[~hit & (at[open_] <= last[open_]) & (at[open_] < end[open_])]
    return np.bincount(owner, seen, len(pair)).astype(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``values``, end to end, as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words]]:
    """Ids and words of the batches' rows, in slices of some size."""
    for b in batches:
        texts = b.column("t")
        sizes = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64))))
        for lo, hi in C.slices(sizes):
            yield b.column("i").slice(lo, hi - lo), Words(texts.slice(lo, hi - lo))


def _numbers(n: int, start: int) -> np.ndarray:
    """Numbers that no other task gives."""
    return (TaskContext.get().partitionId() << 40) + start + np.arange(n)


def _item_rows(batches: Iterator[pa.RecordBatch], run_words: int, share: float) -> Iterator[pa.RecordBatch]:
    seen = 0
    for ids, w in _sides(batches):
        n = np.diff(w.start)
        fresh = np.append(True, (w.blank[1:] != w.blank[:-1]) | (w.row[1:] != w.row[:-1])) if len(w.blank) else np.zeros(0, bool)
        nth = np.cumsum(fresh) - 1
        ordinal = nth - np.repeat(nth[np.minimum(w.start[:-1], max(len(nth) - 1, 0))], n) if len(nth) else nth
        n_words = np.bincount(w.row[fresh], minlength=w.n_texts)
        kinds = [item_kind(int(a), int(b), run_words, share) if a else (WINNOWED, 1) for a, b in zip(n, n_words)]
        kind = np.array([x for x, _ in kinds], np.int64)
        parts = [(r[m], a[m], q[m]) for k in sorted(set(kind.tolist())) for r, a, q in [fingerprints(w, [k])] for m in [kind[r] == k]]  # each of its own kind
        row, at, p = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(row, kind="stable")
        row, at, p = row[order], at[order], p[order]
        counts = np.bincount(row, minlength=w.n_texts)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(_numbers(w.n_texts, seen)), _lists(short_words(w).view(np.int32), n, pa.int32()), _lists(ordinal.astype(np.int32), n, pa.int32()), pa.array(kind.astype(np.int32)), pa.array(np.array([x for _, x in kinds], np.int32)), pa.array(np.floor(n_words * share + 0.5).astype(np.int32)), _lists(p.view(np.int64), counts, pa.int64()), _lists(at.astype(np.int32), counts, pa.int32())],
            ["item", "item_row", "item_words", "blank", "kind", "need", "spread", "p", "at"],
        )
        seen += w.n_texts


def _doc_rows(batches: Iterator[pa.RecordBatch], kinds: list[int], bits: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    seen = 0
    for ids, w in _sides(batches):
        row, at, p = fingerprints(w, kinds, bits)
        counts = np.bincount(row, minlength=w.n_texts)
        some = np.flatnonzero(counts >= least)
        held, n = np.isin(row, some), np.diff(w.start)
        words = short_words(w)[np.isin(w.row, some)]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(some)), pa.array(_numbers(w.n_texts, seen)[some]), _lists(words.view(np.int32), n[some], pa.int32()), _lists(p[held].view(np.int64), counts[some], pa.int64()), _lists(at[held].astype(np.int32), counts[some], pa.int32())],
            ["doc", "doc_row", "doc_words", "p", "at"],
        )
        seen += w.n_texts


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    off = np.asarray(a.offsets).astype(np.int64)
    return np.asarray(a.values)[off[0] : off[-1]], off - off[0]


def _verified(batches: Iterator[pa.RecordBatch], run_words: int, share: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        item, item_off = _flat(b.column("item_words"))
        blank, _ = _flat(b.column("blank"))
        doc, doc_off = _flat(b.column("doc_words"))
        shift, shift_off = _flat(b.column("shifts"))
        pair = np.repeat(np.arange(b.num_rows), np.diff(shift_off))
        leak, run, wrong = verify(item, item_off, blank.astype(np.int64), doc, doc_off, pair, shift.astype(np.int64), run_words, share)
        at = pa.array(np.flatnonzero(leak))
        yield pa.RecordBatch.from_arrays([b.column("doc").take(at), b.column("item").take(at), pa.array(run[leak].astype(np.int32)), pa.array(wrong[leak].astype(np.int32))], names)


def _together(hits: str, need: str, spread: str) -> Column:
    """Whether so many hits lie on offsets that differ by at most ``spread``: edits move the rest of an item by no more."""
    s = F.array_sort(F.col(f"{hits}.shift"))
    far = F.transform(F.slice(s, F.col(need), F.greatest(F.size(s) - F.col(need) + 1, F.lit(0))), lambda x, i: x - F.get(s, i) <= F.col(spread))
    return (F.size(s) >= F.col(need)) & F.exists(far, lambda x: x)


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run_words: int = RUN_WORDS, share: float = EDIT_SHARE) -> DataFrame:
    """Documents that contain passages of items: ``doc_id``, ``item_id``, ``run_words``, ``word_edits``.

    A document leaks an item if it has ``run_words`` consecutive words of it (all of a shorter
    item), or the item from start to end with at most the given share of words changed, rounded to
    the nearest word. Documents and items of any length and number are read whole, each once:
    fingerprints of both are tables that are joined (which side is broadcast, if any, is left to
    its size). What comes to the driver are the set bits of a table of ``BITS``, at most that many.

    Null or empty texts leak nothing, repeated rows give repeated results, null ids come out as
    null, a document may leak several items. Empty tables give an empty result.
    """
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}[doc_id]
    kind_i = {f.name: f.dataType.simpleString() for f in items.schema.fields}[item_id]
    names = [doc_id, item_id, "run_words", "word_edits"]
    side = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    known = cut(side.mapInArrow(lambda it: _item_rows(it, run_words, share), f"item {kind_i}, item_row long, item_words array<int>, blank array<int>, kind int, need int, spread int, p array<long>, at array<int>"))
    prints = known.select("item_row", "need", "spread", F.explode(F.arrays_zip("p", "at")).alias("x")).select("item_row", "need", "spread", "x.p", F.col("x.at").alias("item_at"))
    set_bits = prints.select(F.col("p").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("b")).distinct().toPandas().b
    bits = np.zeros(BITS, bool)
    bits[set_bits.to_numpy(np.int64)] = True
    told = known.where(F.size("p") > 0).groupBy("kind").agg(F.min("need").alias("need")).collect()
    kinds, least = sorted(r.kind for r in told), min((r.need for r in told), default=1)
    source = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    hits = cut(source.mapInArrow(lambda it: _doc_rows(it, kinds, bits, least), f"doc {kind}, doc_row long, doc_words array<int>, p array<long>, at array<int>"))
    each = hits.select("doc_row", F.explode(F.arrays_zip("p", "at")).alias("x")).select("doc_row", "x.p", F.col("x.at").alias("doc_at"))
    pairs = each.join(prints, "p").groupBy("doc_row", "item_row").agg(F.max("need").alias("need"), F.max("spread").alias("spread"), F.collect_set(F.struct("doc_at", (F.col("doc_at") - F.col("item_at")).alias("shift"))).alias("hits"))
    pairs = pairs.where(_together("hits", "need", "spread")).select("doc_row", "item_row", F.array_distinct(F.col("hits.shift")).alias("shifts"))
    whole = pairs.join(hits.select("doc_row", "doc", "doc_words"), "doc_row").join(known.select("item_row", "item", "item_words", "blank"), "item_row")
    found = whole.select("doc", "item", "doc_words", "item_words", "blank", "shifts")
    return found.mapInArrow(lambda it: _verified(it, run_words, share, names), f"`{doc_id}` {kind}, `{item_id}` {kind_i}, run_words int, word_edits int")
