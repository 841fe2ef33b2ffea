"""Language of each text and of each stretch of a text, by cross-parsing.

For every language a suffix automaton is built over text labelled with it. A sentence is cut
greedily into the longest phrases that occur in that text; the language whose phrases, each worth
the logarithm of its training text's length, cost least per letter wins, and by how much tells the
confidence. A sentence that changes its language is parted between words where the costs of its
words, plus a price for each change, are least. All sentences of a batch walk through an automaton
in step, one letter at a time, as array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwake.llm import codepoints as C

# The languages told apart, and the forms in which labels name them.
LANGUAGES = ("en", "es", "fr", "de", "pt", "hi", "ru")
LABELS = {
    "en": "en eng english",
    "es": "es spa spanish",
    "fr": "fr fra fre french",
    "de": "de deu ger german",
    "pt": "pt por portuguese",
    "hi": "hi hin hindi",
    "ru": "ru rus russian",
}

#: Bounds of the training sample: labelled texts a language, characters of a text that may be in it,
#: letters a language that its automaton is built over.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_LETTERS = 1500, 10_000, 40_000
#: Longer sentences are not trained on, as they may be run-on and change their language.
TRAIN_WORDS = 25
#: Sentences with fewer words take the language of the stretch they stand in.
LEAST_WORDS = 3
#: Least relative difference to the next language for a sentence to be sure of its own.
LEAST_MARGIN = 0.2
#: Letters that sentences walk through an automaton without a stop; a longer one goes in parts of so
#: many, side by side (a phrase that a stop parts counts as one, in every language alike).
WALK = 512
#: Code points whose sentences are walked at once: the more, the fewer steps in all.
AT_ONCE = 1 << 21
#: Price of a change of language inside a sentence, in phrases, and the margin a stretch of a parted sentence needs.
CHANGE, PART_MARGIN = 7.0, 0.35
#: Share of capitalised words from which a sentence, or a stretch of a parted one, is a list of
#: names, and the margins that a sentence of names and one wholly in capitals need to be sure.
NAMES, NAMES_PARTED, NAMES_MARGIN, CAPITALS_MARGIN = 0.8, 0.5, 0.5, 0.4
_STOP = np.array([ord(c) for c in ".!?।…"], np.uint32)


def label_language(c):
    """The language a label names: codes, region tags, names; null if it names none."""
    base = F.lower(F.split_part(F.replace(F.trim(c), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)))
    pairs = [F.lit(x) for lang, names in LABELS.items() for n in names.split() for x in (n, lang)]
    return F.element_at(F.create_map(*pairs), base)


@lru_cache(1)
def _fold() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letter of each code point, or a blank; which are letters or marks, white space, capitals."""
    t = C.tables()
    low = np.full(C.TOP, 32, np.uint32)
    letter = np.zeros(C.TOP, bool)
    for c in np.flatnonzero(t.word):
        s = chr(c)
        if not s.isnumeric():
            lo = s.lower()
            low[c] = ord(lo) if len(lo) == 1 else c
            letter[c] = True
    low[0x27], letter[0x27] = 0x27, True
    low[0x2019], letter[0x2019] = 0x27, True
    space = np.zeros(C.TOP, bool)
    space[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0x2028, 0x2029]] = True
    return low, letter, space, letter & (low != np.arange(C.TOP))


class Sentences:
    """Sentences of a batch of texts: folded letters, words, where each begins, and its text and place."""

    def __init__(self, texts: pa.Array):
        cp, off, _ = C.canonical_points(texts)
        low, letter, space, capital = _fold()
        n = len(off) - 1
        self.n_texts, self.lengths = n, np.diff(off)
        row = np.repeat(np.arange(n), self.lengths)
        c = np.minimum(cp, C.TOP - 1)
        blank, is_letter = space[c], letter[c]
        nxt = np.ones(len(cp), bool)
        nxt[:-1] = blank[1:]
        nxt[off[1:][off[1:] > off[:-1]] - 1] = True
        ends = (np.isin(cp, _STOP) & nxt) | (cp == 10)
        begin = np.zeros(len(cp) + 1, bool)
        begin[1:][ends] = True
        begin[off[:-1]] = True
        seg = np.cumsum(begin[: len(cp)]) - 1
        total = int(seg[-1]) + 1 if len(seg) else 0
        # words between white space, if they have a letter or digit
        head = ~blank
        head[1:] &= blank[:-1]
        heads = off[:-1][off[:-1] < len(cp)]
        head[heads] = ~blank[heads]
        at = np.flatnonzero(head)
        said = np.logical_or.reduceat(C.tables().word[c], at) if len(at) else head[:0]
        self.text_words = np.bincount(row[at[said]], minlength=n)
        wl = is_letter.copy()
        wl[1:] &= ~is_letter[:-1]
        first = np.flatnonzero(begin[: len(cp)])
        wl[first] = is_letter[first]
        # letters, and one blank before each word but the first of a sentence
        keep = is_letter.copy()
        keep[:-1] |= ~is_letter[:-1] & is_letter[1:] & (seg[1:] == seg[:-1])
        keep &= ~(begin[: len(cp)] & ~is_letter)
        s = seg[keep]
        self.letters = np.where(is_letter[keep], low[c[keep]], 32).astype(np.uint32)
        size = np.bincount(s, minlength=total)
        have = np.flatnonzero(size > 0)
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        self.start, self.size = start[have], size[have]
        words = np.bincount(seg[wl], minlength=total)[have]
        self.first_word = np.concatenate(([0], np.cumsum(words)))[:-1].astype(np.int64)
        self.words = words
        # per word: its first letter's place in the text and among the letters, capitals
        self.word_at = np.flatnonzero(wl)
        self.word_letter = np.flatnonzero((self.letters == 32) | _marked(len(self.letters), self.start)) if len(self.letters) else np.zeros(0, np.int64)
        upper = capital[c]
        self.word_title = upper[self.word_at] & ~np.append(upper[1:], False)[self.word_at] if len(cp) else np.zeros(0, bool)
        self.word_capitals = np.add.reduceat(upper, self.word_at, dtype=np.int64) if len(self.word_at) else np.zeros(0, np.int64)
        stop = np.append(first[1:], len(cp))
        self.row = row[first[have]] if len(first) else np.zeros(0, np.int64)
        self.word_at = self.word_at - off[np.repeat(self.row, self.words)] if len(self.row) else self.word_at
        self.begin, self.end = (first[have] - off[self.row], stop[have] - off[self.row]) if len(first) else (self.row, self.row)
        self.parted = np.zeros(len(self.row), bool)
        self._names()

    def _names(self) -> None:
        """Which sentences are mostly names, and which in capitals."""
        if not len(self.words):
            self.namely = self.capitals = np.zeros(0, bool)
            return
        self.namely = np.add.reduceat(self.word_title, self.first_word, dtype=np.int64) > np.where(self.parted, NAMES_PARTED, NAMES) * self.words
        self.capitals = np.add.reduceat(self.word_capitals, self.first_word) * 2 > self.size

    def part(self, new: np.ndarray) -> None:
        """Part the sentences before the words marked in ``new``, which marks first words too."""
        head = np.flatnonzero(new)
        owner = np.repeat(np.arange(len(self.words)), self.words)[head]
        several = np.bincount(owner, minlength=len(self.words)) > 1
        at_start = head == self.first_word[owner]
        self.begin = np.where(at_start, self.begin[owner], self.word_at[head])
        last = np.append(owner[1:] != owner[:-1], True)
        self.end = np.where(last, self.end[owner], np.append(self.begin[1:], 0))
        begin = self.word_letter[head] + ~at_start  # without the blank before it
        self.size = np.append(self.word_letter[head][1:], len(self.letters)) - begin
        self.start, self.row, self.parted = begin, self.row[owner], several[owner]
        self.words = np.append(head[1:], len(new)) - head
        self.first_word = head
        self._names()

    def text(self, i: int) -> str:
        return self.letters[self.start[i] : self.start[i] + self.size[i]].astype("<u4").tobytes().decode("utf-32-le")


def _marked(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


class Automaton:
    """The suffix automaton of one text as a dense table: state and letter to state, 0 for none."""

    def __init__(self, text: str):
        chars = np.unique(np.minimum(np.array([ord(c) for c in text], np.uint32), C.TOP - 1))
        self.symbol = np.zeros(C.TOP, np.int32)
        self.symbol[chars] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for c in self.symbol[[min(ord(c), C.TOP - 1) for c in text]].tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.table = np.zeros(len(nxt) * self.width, np.int32)
        at = np.array([s * self.width + c for s, m in enumerate(nxt) for c in m], np.int64)
        self.table[at] = np.array([t * self.width for m in nxt for t in m.values()], np.int32)
        self.table[0 :: self.width] = 0

    def phrases(self, letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """At each letter the phrases that end before it, or at it for a letter never met. ``size`` must not increase."""
        symbols = self.symbol[np.minimum(letters, C.TOP - 1)]
        state, ended = np.zeros(len(start), np.int32), np.zeros(len(letters), np.uint8)
        table = self.table
        live = len(start)
        for j in range(int(size[0]) if len(size) else 0):
            while live and size[live - 1] <= j:
                live = int(np.searchsorted(-size, -j, "left"))
            at = start[:live] + j
            c = symbols[at]
            to = table[state[:live] + c]
            miss = np.flatnonzero(to == 0)
            if len(miss):
                again = table[c[miss]]
                ended[at[miss]] = 1 + (again == 0)
                to[miss] = again
            state[:live] = to
        return ended


@lru_cache(2)
def automata(training: tuple[tuple[str, str], ...]) -> tuple[tuple[str, Automaton], ...]:
    return tuple((lang, Automaton(text)) for lang, text in training)


def judge(s: Sentences, training: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each sentence the index of its language in ``training`` and the confidence, 0 to 1.

    Sentences that change their language are parted in ``s``.
    """
    if not len(s.start):
        return np.zeros(0, np.int64), np.zeros(0)
    parts = -(-s.size // WALK)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(s.start, parts) + nth * WALK
    size = np.minimum(np.repeat(s.size, parts) - nth * WALK, WALK)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    cost = np.empty((len(training), len(s.word_at)), np.float32)
    most = max(len(text) for _, text in training)
    weight = np.array([np.log(len(text) + 1) / np.log(most + 1) for _, text in training], np.float32)
    for k, (_, a) in enumerate(automata(training)):
        cost[k] = np.add.reduceat(a.phrases(s.letters, start, size), s.word_letter, dtype=np.int64) * weight[k]
    s.part(_changes(s, cost))
    cost = (np.add.reduceat(cost, s.first_word, axis=1) + weight[:, None]) / s.size
    best = cost.argmin(axis=0)
    low = np.partition(cost, 1, axis=0)[:2] if len(training) > 1 else np.stack([cost[0], np.ones_like(cost[0])])
    return best, 1 - low[0] / np.maximum(low[1], 1e-9)


def _changes(s: Sentences, cost: np.ndarray) -> np.ndarray:
    """Words at which the cheapest path of languages through a sentence begins or changes.

    The path costs what its words cost and ``CHANGE`` for each change; all sentences with words
    enough for two stretches are walked in step, forwards for the costs and backwards for the path.
    """
    new = _marked(cost.shape[1], s.first_word)
    some = np.flatnonzero(s.words >= 2 * LEAST_WORDS)
    # no path is dearer than the best single language; none is cheaper than the least of each word
    single = np.add.reduceat(cost, s.first_word, axis=1).min(axis=0)
    floor = np.add.reduceat(cost.min(axis=0), s.first_word)
    some = some[(single - floor)[some] > CHANGE]
    if not len(some) or len(cost) < 2:
        return new
    some = some[np.argsort(-s.words[some], kind="stable")]
    first, n = s.first_word[some], s.words[some]
    steps = np.arange(int(n[0]))
    live = np.searchsorted(-n, -steps, "left")
    here = np.zeros((len(cost), len(some)), np.float32)
    came = np.zeros((int(live.sum()), len(cost)), np.int8)
    base = np.concatenate(([0], np.cumsum(live)))
    own = np.arange(len(cost), dtype=np.int8)[:, None]
    for j in steps:
        m = live[j]
        least = here[:, :m].min(axis=0) + CHANGE
        switch = here[:, :m] > least
        came[base[j] : base[j + 1]] = np.where(switch, here[:, :m].argmin(axis=0).astype(np.int8), own).T
        here[:, :m] = np.minimum(here[:, :m], least) + cost[:, first[:m] + j]
    lang = here.argmin(axis=0)
    for j in steps[::-1]:
        m = live[j]
        before = came[base[j] + np.arange(m), lang[:m]]
        if j:
            new[(first[:m] + j)[before != lang[:m]]] = True
        lang[:m] = before
    return new


def settle(s: Sentences, best: np.ndarray, margin: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Short or unsure sentences take the language most letters of their text have; which are sure."""
    need = np.where(s.namely, NAMES_MARGIN, np.where(s.capitals, CAPITALS_MARGIN, np.where(s.parted, PART_MARGIN, LEAST_MARGIN)))
    sure = (s.words >= LEAST_WORDS) & (margin >= need)
    weight = np.bincount(s.row * n_langs + best, s.size * np.where(sure, 1.0, 0.01 * (margin + 0.01)), s.n_texts * n_langs).reshape(s.n_texts, n_langs)
    main = weight.argmax(axis=1)
    return np.where(sure, best, main[s.row]), sure


def clean(rows: list[tuple[str, str]], letters: int | None = None) -> tuple[tuple[str, str], ...]:
    """Training text per language from texts whose labels may be wrong or name only one of two languages.

    Trigram counts over all sentences, each under its text's label, outvote wrong labels; each
    sentence is then labelled by them, twice over, and kept where both agree with a clear margin.
    Sentences differing in nothing but digits and punctuation are used once. Of a language with
    more than ``letters`` (``SAMPLE_LETTERS``) the sentences with the least hashes are taken.
    """
    s = Sentences(pa.array([t for _, t in rows], pa.string()))
    langs = sorted({x for x, _ in rows}, key=lambda x: LANGUAGES.index(x) if x in LANGUAGES else 99)
    if not langs or not len(s.start):
        return ()
    mine = np.array([langs.index(x) for x, _ in rows])[s.row]
    keep = (s.words >= 5) & (s.words <= TRAIN_WORDS)
    sentence = np.repeat(np.arange(len(s.start)), s.size)
    x = s.letters.astype(np.uint64)
    gram = np.zeros(len(x), np.int64)
    gram[2:] = (_mix(x[:-2] * np.uint64(1 << 42) ^ x[1:-1] * np.uint64(1 << 21) ^ x[2:]) & np.uint64(0x3FFF)).astype(np.int64)
    inner = np.arange(len(x)) - s.start[sentence] >= 2
    gram, owner = gram[inner], sentence[inner]
    label = mine
    for _ in range(3):
        used = keep[owner]
        counts = np.bincount(label[owner[used]] * 0x4000 + gram[used], minlength=len(langs) * 0x4000).reshape(len(langs), 0x4000) + 0.1
        logp = np.log(counts / counts.sum(axis=1, keepdims=True))
        score = np.stack([np.bincount(owner, logp[k][gram], len(s.start)) for k in range(len(langs))])
        label = score.argmax(axis=0)
    top = np.sort(score, axis=0)
    gap = (top[-1] - top[-2]) / np.maximum(s.size, 1) if len(langs) > 1 else np.ones(len(s.start))
    texts: dict[int, dict[str, None]] = {k: {} for k in range(len(langs))}
    names = np.add.reduceat(s.word_title, s.first_word, dtype=np.int64) > NAMES_PARTED * s.words
    for i in np.flatnonzero(keep & (gap > 0.15) & (label == mine) & ~names):
        texts[int(label[i])][s.text(i)] = None
    mixed = {k: sorted(texts[k], key=lambda x: hashlib.blake2b(x.encode(), digest_size=8).digest()) for k in texts}
    return tuple((lang, "\n".join(mixed[k])[: letters or SAMPLE_LETTERS]) for k, lang in enumerate(langs) if texts[k])


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))


def train(texts_df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, texts: int = SAMPLE_TEXTS, letters: int | None = None) -> tuple[tuple[str, str], ...]:
    """Training text per language from at most ``texts`` labelled rows of each language.

    The labelled ids with the least hashes are taken. Counts per language set a hash bound that
    lets about twice as many through, so no task gets more than that; the ids, bounded in number,
    then fetch their texts in one scan. What comes to the driver is bounded by ``texts`` and
    ``SAMPLE_CHARS``; an id with several labels or texts counts with each.
    """
    spark = texts_df.sparkSession
    span = 1 << 31
    known = labels.select(F.col(id_col).alias("i"), label_language(F.col(label_col)).alias("l")).where("i is not null and l is not null")
    known = known.withColumn("h", F.pmod(F.xxhash64("i"), F.lit(span)))
    counts = known.groupBy("l").count().collect()
    if not counts:
        return ()
    bound = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r.l, min(span, span * (2 * texts + 100) // r["count"]))]), F.col("l"))
    rows = known.where(F.col("h") < bound).distinct().collect()
    chosen: list[tuple[str, str]] = []
    for lang in sorted({r.l for r in rows}):
        chosen += [(r.i, r.l) for r in sorted((r for r in rows if r.l == lang), key=lambda r: (r.h, r.i))[:texts]]
    ids = spark.createDataFrame(chosen, "i string, l string")
    got = texts_df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.length("t").between(21, SAMPLE_CHARS)).join(F.broadcast(ids), "i").select("l", "t").distinct().collect()
    return clean(sorted((r.l, r.t) for r in got), letters)


def label(s: Sentences, training: tuple[tuple[str, str], ...]) -> list[pa.Array]:
    """Segments (stretches of one language), language, confidence and words of each text."""
    names = np.array([x for x, _ in training] + ["und"], object)
    best, margin = judge(s, training) if training else (np.zeros(len(s.start), np.int64), np.zeros(len(s.start)))
    k = max(len(training), 1)
    lang, sure = settle(s, best, margin, k)
    new = np.ones(len(lang), bool)
    new[1:] = (s.row[1:] != s.row[:-1]) | (lang[1:] != lang[:-1])
    head = np.flatnonzero(new)
    seg_row = s.row[head]
    size = np.add.reduceat(s.size, head) if len(head) else np.zeros(0)
    conf = np.add.reduceat(margin * s.size, head) / size if len(head) else np.zeros(0)
    any_sure = np.maximum.reduceat(sure, head) if len(head) else np.zeros(0, bool)
    last = np.append(head[1:], len(lang)) - 1
    counts = np.bincount(seg_row, minlength=s.n_texts)
    weight = np.bincount(seg_row * k + lang[head], size, s.n_texts * k).reshape(s.n_texts, k)
    main, share = weight.argmax(axis=1), weight.max(axis=1) / np.maximum(weight.sum(axis=1), 1)
    overall = np.bincount(seg_row, conf * size * (lang[head] == main[seg_row]), s.n_texts) / np.maximum(weight.max(axis=1), 1) * share
    none = weight.sum(axis=1) == 0
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    seg = pa.StructArray.from_arrays([pa.array(s.begin[head].astype(np.int32)), pa.array(s.end[last].astype(np.int32)), pa.array(names[lang[head]] if training else names[[-1] * len(head)], pa.string()), pa.array(conf.astype(np.float32)), pa.array(any_sure.astype(bool))], ["begin", "end", "lang", "confidence", "sure"])
    return [pa.ListArray.from_arrays(pa.array(offsets), seg), pa.array(np.where(none | (not training), "und", names[main]), pa.string()), pa.array(np.where(none, 0, overall).astype(np.float32)), pa.array(s.text_words.astype(np.int32))]


def with_language(df: DataFrame, text_col: str, training: tuple[tuple[str, str], ...], keep: list[str]) -> DataFrame:
    """``keep`` columns with ``segments``, ``lang``, ``confidence`` and ``words`` of ``text_col``.

    ``segments`` lists the stretches of one language in order with begin and end in characters
    of the text's one form (see ``normalize``). Texts without letters and nulls have no segments,
    language ``und`` and confidence 0; ``words`` are those between white space that have a letter or
    digit. Texts of any length are read whole. ``training`` is what
    ``train`` returns, of bounded size; workers build their automata from it once.
    """
    fields = df.select(*keep).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "segments array<struct<begin: int, end: int, lang: string, confidence: float, sure: boolean>>", "lang string", "confidence float", "words int"])
    if {"segments", "lang", "confidence", "words"} & set(keep):
        raise ValueError("keep must not have columns segments, lang, confidence or words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("__text")
            sizes = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.binary_length(text).fill_null(0)).astype(np.int64))))
            for lo, hi in C.slices(sizes, AT_ONCE):
                p = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[p.column(c) for c in keep], *label(Sentences(p.column("__text")), training)], [*keep, "segments", "lang", "confidence", "words"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
