"""Reading level of documents by regularised ordinal regression."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwake.llm import codepoints as C
from loomwake.llm import langid
from loomwake.llm.words import Words, mix
from loomwake.session import cut

#: Bound of the graded sample the model is fitted on.
SAMPLE_DOCS = 4000
#: Buckets of the corpus's word counts: words are counted by hash, in a table of fixed size.
BUCKETS = 1 << 17
#: Strength of the L2 penalty on standardised features.
PENALTY = 0.3
#: Quantiles of the sample at which a feature's slope may change.
KNOTS = (0.2, 0.4, 0.6, 0.8, 0.92)
#: A public vocabulary in order of frequency; its place is a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# English words that join clauses, and those only older or formal texts join them with.
CONNECTIVES = """although though because since unless while whereas whereby wherein whereof whether if when after before until as that which who whom whose
so however therefore moreover furthermore nevertheless nonetheless consequently thus hence accordingly otherwise instead but and or nor yet""".split()
FORMAL = """notwithstanding albeit inasmuch insofar lest ere wherein whereof whereby whereupon thereof therein thereto thereby hereby herein hereof forasmuch
provided save nor hence thus thereupon hitherto heretofore aforesaid ostensibly viz shall""".split()
SUBORDINATORS = """that which who whom whose whereof whereby wherein although though because unless until if when while whereas ere lest notwithstanding albeit""".split()
FUNCTION = """the a an of to in on at by for from with and or but is are was were be been am do does did has have had will would can could may might must shall should not no
i you he she it we they me him her us them my your his its our their this that these those there here what who which when where how why if then so as than""".split()
ENDINGS = ("tion", "sion", "ment", "ness", "ity", "ism", "ance", "ence", "ical", "ous", "ive", "ist", "ology", "isation", "ization", "ary")

NAMES = [
    "letters_per_word", "long_words", "very_long_words", "words_per_sentence", "longest_sentence", "short_sentences", "diversity", "repeated",
    "vocabulary_rank", "rare_words", "split_words", "rare_short_words", "rare_long_words", "corpus_rarity", "connectives", "formal", "clauses_per_sentence", "deepest", "commas", "list_marks", "function_words", "endings",
]


@lru_cache(1)
def _ranks(path: str) -> dict[bytes, int]:
    import base64

    try:
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    except OSError:
        return {}


class Lexicon:
    """Properties of words by hash, looked up once per distinct word of a worker.

    A word that the vocabulary holds whole has its rank as its rarity; another is as rare as the
    vocabulary is long, and more so the fewer of its letters the longest known beginning covers.
    """

    COLUMNS = 7

    def __init__(self, path: str):
        self.ranks = _ranks(path)
        self.known = np.zeros(0, np.uint64)
        self.values = np.zeros((0, self.COLUMNS), np.float32)
        self.sets = [frozenset(x) for x in (CONNECTIVES, FORMAL, SUBORDINATORS, FUNCTION)]

    def _of(self, word: str) -> list[float]:
        raw = word.encode()
        rank = min((self.ranks[b] for b in (b" " + raw, raw) if b in self.ranks), default=None)
        split = rank is None and bool(self.ranks)
        if rank is None:
            most = next((k for k in range(len(raw) - 1, 0, -1) if b" " + raw[:k] in self.ranks), 0)
            rank = len(self.ranks) * (1 + (len(raw) - most) / max(len(raw), 1))
        return [float(np.log1p(rank)), float(split), *(float(word in s) for s in self.sets), float(len(word) > 5 and word.rstrip("s").endswith(ENDINGS))]

    def __call__(self, distinct: np.ndarray, spelled) -> np.ndarray:
        """A row for each of the ``distinct`` hashes, in order; ``spelled`` says how one of them is written."""
        new = np.flatnonzero(~np.isin(distinct, self.known))
        if len(new):
            if len(self.known) > 400_000:  # memory stays bounded; values don't depend on what is kept
                self.known, self.values = self.known[:0], self.values[:0]
                new = np.arange(len(distinct))
            got = np.array([self._of(spelled(i)) for i in new], np.float32).reshape(-1, self.COLUMNS)
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known)
            self.known, self.values = known[order], np.concatenate([self.values, got])[order]
        return self.values[np.searchsorted(self.known, distinct)]


@lru_cache(2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def buckets(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(7)) & np.uint64(BUCKETS - 1)).astype(np.int64)


CORPUS_RARITY = NAMES.index("corpus_rarity")


def measure(w: Words, some: np.ndarray, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the texts ``some`` of ``w``, in the order of ``NAMES``, all but the corpus rarity, which is 0.

    Beside them each text's words between white space (those with a letter or digit), and the
    hash bucket of every word that bears on the rarity, with the number of such words a text.

    Words with digits and capitalised words inside a sentence (names) don't count as vocabulary,
    unless the text is mostly in capitals. Means are taken over a text's own words, so length
    itself plays no part.
    """
    n = len(some)
    out, words = np.zeros((n, len(NAMES))), np.zeros(n, np.int64)
    place = np.full(w.n_texts, -1)
    place[some] = np.arange(n)
    mine = np.flatnonzero(place[w.row] >= 0)
    if not len(mine):
        return out, words, np.zeros(0, np.int64), words
    row, cp, hashes, begin, end, blank = place[w.row[mine]], w.cp, w.hash[mine], w.begin[mine], w.end[mine], w.blank[mine]
    sum_of = lambda v, r=row: np.bincount(r, v, n)
    stretch = np.concatenate(([True], (blank[1:] != blank[:-1]) | (row[1:] != row[:-1])))
    words = np.bincount(row[stretch], minlength=n)
    size = end - begin
    upper = (cp >= 65) & (cp <= 90)

    def running(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=out[1:])
        return out

    caps, alpha, digit = running(upper), running(upper | ((cp >= 97) & (cp <= 122))), running((cp >= 48) & (cp <= 57))
    shouted = (sum_of(caps[end] - caps[begin]) > 0.5 * sum_of(alpha[end] - alpha[begin]))[row]
    stop = running((cp == 46) | (cp == 33) | (cp == 63) | (cp == 10) | (cp == 59))
    new_sentence = np.concatenate(([True], (stop[begin[1:]] > stop[end[:-1]]) | (row[1:] != row[:-1])))
    numeric = digit[end] > digit[begin]
    capital = upper[begin] & ~shouted
    plain = ~numeric & ~(capital & ~new_sentence) & (size > 0)
    sentence = np.cumsum(new_sentence) - 1
    per = np.bincount(sentence, plain).astype(float)
    s_row = row[new_sentence]
    many = np.maximum(np.bincount(s_row, per > 1, n), 1)
    vocabulary = np.flatnonzero(plain)  # names and numbers need no lexicon
    distinct, first, code = np.unique(hashes[vocabulary], return_index=True, return_inverse=True)
    v = np.zeros((len(mine), Lexicon.COLUMNS), np.float32)
    v[vocabulary] = lexicon(path)(distinct, lambda i: w.spelled(mine[vocabulary[first[i]]]))[code]
    total = np.maximum(sum_of(plain), 1)
    share = lambda mask: sum_of(mask & plain) / total
    # diversity: distinct words and repeated ones, on a scale free of length
    key = np.sort(row[vocabulary] * max(len(distinct), 1) + code)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    types = np.bincount(key // max(len(distinct), 1), minlength=n)
    diversity = np.log(np.maximum(types, 2)) / np.log(np.maximum(total, 3))
    rank, split, conn, formal, sub, function, ending = (v[:, j] for j in range(Lexicon.COLUMNS))
    content = plain & (function == 0)
    n_content = np.maximum(sum_of(content), 1)
    rare = rank > np.log1p(12_000)
    deep = np.bincount(sentence, sub * plain)
    commas, colons = running(cp == 44), running(cp == 58)
    between = lambda x: (x[w.off[1:]] - x[w.off[:-1]])[some]
    longest, deepest = np.zeros(n), np.zeros(n)
    np.maximum.at(longest, s_row, per)
    np.maximum.at(deepest, s_row, deep)
    out[:] = np.stack(
        [
            sum_of(size * plain) / total, share(size >= 7), share(size >= 11), np.log1p(np.bincount(s_row, per, n) / many), np.log1p(longest), np.bincount(s_row, (per > 1) & (per < 7), n) / many, diversity, 1 - types / total,
            sum_of(rank * content) / n_content, sum_of(rare & content) / n_content, sum_of((split > 0) & content) / n_content, sum_of(rare & content & (size < 8)) / n_content, sum_of(rare & content & (size >= 8)) / n_content,
            np.zeros(n), share(conn > 0), share(formal > 0), np.bincount(s_row, deep, n) / many, deepest, between(commas) / total, (between(commas) + between(colons)) / total, share(function > 0), share(ending > 0),
        ],
        axis=1,
    )
    return out, words, buckets(distinct)[code[content[vocabulary]]], sum_of(content).astype(np.int64)


# ---------------------------------------------------------------- ordinal regression


class Ordinal:
    """Proportional-odds regression, piecewise linear in standardised features, with an L2 penalty."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, knots: np.ndarray, weight: np.ndarray, cuts: np.ndarray):
        self.mean, self.scale, self.knots, self.weight, self.cuts = mean, scale, knots, weight, cuts

    @staticmethod
    def _expand(z: np.ndarray, knots: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip(z, -4, 6), *(np.clip(z - k, 0, 6) for k in knots)], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, bands: int = 4, penalty: float = PENALTY) -> Ordinal:
        """``y`` counts from 1. Quasi-Newton (BFGS) on the penalised likelihood."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        knots = np.quantile((x - mean) / scale, KNOTS, axis=0)
        z = cls._expand((x - mean) / scale, knots)
        d = z.shape[1]
        share = np.array([weight[y <= k].sum() for k in range(1, bands)]) / weight.sum()
        start = np.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99)))
        step = np.diff(start, prepend=start[0])
        theta = np.concatenate([np.zeros(d), [start[0]], np.log(np.maximum(step[1:], 0.1))])

        def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
            w, c = t[:d], np.cumsum(np.concatenate([[t[d]], np.exp(t[d + 1 :])]))
            eta = z @ w
            up = np.concatenate([c, [np.inf]])[y - 1] - eta
            lo = np.concatenate([[-np.inf], c])[y - 1] - eta
            sig = lambda v: 0.5 * (1 + np.tanh(v / 2))
            a, b = sig(up), sig(lo)
            p = np.maximum(a - b, 1e-12)
            da, db = a * (1 - a), b * (1 - b)
            g_eta = weight * (da - db) / p
            value = -(weight * np.log(p)).sum() + penalty * (w @ w) / 2
            gc = np.zeros(bands - 1)
            for k in range(bands - 1):
                gc[k] = -(weight * (da * (y == k + 1) - db * (y == k + 2)) / p).sum()
            tail = np.cumsum(gc[::-1])[::-1]
            return value, np.concatenate([z.T @ g_eta + penalty * w, [tail[0]], tail[1:] * np.exp(t[d + 1 :])])

        value, grad = loss(theta)
        inverse = np.eye(len(theta)) / max(weight.sum(), 1)
        for _ in range(400):
            move = -inverse @ grad
            if grad @ move >= 0:
                inverse, move = np.eye(len(theta)) / max(weight.sum(), 1), -grad / max(weight.sum(), 1)
            size = 1.0
            while size > 1e-10:
                got, slope = loss(theta + size * move)
                if got <= value + 1e-4 * size * (grad @ move):
                    break
                size /= 2
            else:
                break
            s, g = size * move, slope - grad
            theta, done, value, grad = theta + s, value - got, got, slope
            if (sg := s @ g) > 1e-12:
                rho, eye = 1 / sg, np.eye(len(theta))
                inverse = (eye - rho * np.outer(s, g)) @ inverse @ (eye - rho * np.outer(g, s)) + rho * np.outer(s, s)
            if done < 1e-7 * max(1, abs(value)):
                break
        return cls(mean, scale, knots, theta[:d], np.cumsum(np.concatenate([[theta[d]], np.exp(theta[d + 1 :])])))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._expand((x - self.mean) / self.scale, self.knots) @ self.weight

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        eta = self.score(x)[:, None]
        below = 0.5 * (1 + np.tanh((self.cuts[None, :] - eta) / 2))
        return np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1), axis=1)

    def level(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(axis=1) + 1 if len(x) else np.zeros(0, np.int64)


# ---------------------------------------------------------------- on DataFrames


def bare(c):
    """A text without the time and sender at the head of chat lines."""
    return F.regexp_replace(c, r"(?m)^\[[^\]\n]{1,24}\] [^\s:]{1,40}: ", "")


#: Columns ``survey`` adds; ``b`` and ``n`` are filled in rows of counts only.
SURVEYED = {"words": "int", "features": "array<float>", "content": "array<int>", "b": "array<int>", "n": "array<long>"}


def survey(docs: DataFrame, keep: list[str], text: str, told: str, training: tuple[tuple[str, str], ...], path: str = VOCABULARY) -> DataFrame:
    """One reading of every document, written once: ``keep``, its words, features and the buckets of its content words.

    ``told`` is a document's language, or null; those without get one by ``langid`` with
    ``training``. Rows come out for English documents only; the words of all documents, whole, are
    counted in a table of ``BUCKETS`` hash buckets a task, which it sends as one row at its end.

    Null and empty texts have 0 words; texts of any length are read whole; repeated rows get equal
    results. ``keep`` must not name the results.
    """
    if set(SURVEYED) & set(keep):
        raise ValueError(f"keep must not have columns {sorted(SURVEYED)}")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{k} {v}" for k, v in SURVEYED.items())])

    def rows(own: list[pa.Array], values: list[pa.Array | None], size: int) -> pa.RecordBatch:
        types = [pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([*own, *[pa.nulls(size, t) if v is None else v for v, t in zip(values, types)]], [*keep, *SURVEYED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, types = np.zeros(BUCKETS, np.int64), None
        for batch in batches:
            types = [batch.column(k).type for k in keep]
            texts = batch.column("__t")
            sizes = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64))))
            english = np.asarray(pa.compute.equal(batch.column("__told"), "en").fill_null(False)).copy()
            silent = np.flatnonzero(np.asarray(batch.column("__told").is_null()))
            ends = np.concatenate(([0], np.cumsum(np.diff(sizes)[silent])))
            for lo, hi in C.slices(ends, langid.AT_ONCE) if training else ():  # together, as each walk has as many steps as its longest sentence
                heard = langid.label(langid.Sentences(texts.take(pa.array(silent[lo:hi]))), training)[1]
                english[silent[lo:hi]] = np.asarray(pa.compute.equal(heard, "en"))
            for lo, hi in C.slices(sizes):
                b = batch.slice(lo, hi - lo)
                cp, off, _ = C.canonical_points(b.column("__t"))
                w = Words.of(cp, off)
                table += np.bincount(buckets(w.hash), minlength=BUCKETS)
                some = np.flatnonzero(english[lo:hi])
                x, words, content, counts = measure(w, some, path)
                lists = lambda v, n, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(v, kind))
                own = [b.column(k).take(pa.array(some)) for k in keep]
                yield rows(own, [pa.array(words.astype(np.int32)), lists(x.astype(np.float32).reshape(-1), np.full(len(some), len(NAMES)), pa.float32()), lists(content.astype(np.int32), counts, pa.int32()), None, None], len(some))
        if types:
            met = np.flatnonzero(table)
            yield rows([pa.nulls(1, t) for t in types], [None, None, None, pa.array([met.astype(np.int32)], pa.list_(pa.int32())), pa.array([table[met]], pa.list_(pa.int64()))], 1)

    return cut(docs.select(*keep, F.col(told).alias("__told"), bare(F.col(text)).alias("__t")).mapInArrow(run, schema))


def word_counts(surveyed: DataFrame) -> np.ndarray:
    """Rarity of each hash bucket: minus the logarithm of its share of all words surveyed.

    At most ``BUCKETS`` rows come to the driver.
    """
    each = surveyed.where("b is not null").select(F.explode(F.arrays_zip("b", "n")).alias("x")).groupBy("x.b").agg(F.sum("x.n").alias("n")).toPandas()
    table = np.ones(BUCKETS)
    table[each.b] += each.n
    return (-np.log(table / table.sum())).astype(np.float32)


def with_levels(surveyed: DataFrame, keep: list[str], rarity: np.ndarray, model: Ordinal | None) -> DataFrame:
    """``keep`` with ``words`` and, without a model, whole ``features``, else ``band``, ``score`` and ``confidence``.

    Documents without words have, lacking evidence, band 1 with confidence 0.
    """
    results = ["words", "features"] if model is None else ["words", "band", "score", "confidence"]
    kinds = {f.name: f.dataType.simpleString() for f in surveyed.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "words int", *(["features array<double>"] if model is None else ["band int", "score double", "confidence double"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("features").flatten()).astype(float).reshape(-1, len(NAMES))
            content = b.column("content")
            off = np.asarray(content.offsets).astype(np.int64)
            values = np.concatenate(([0.0], np.cumsum(rarity[np.asarray(content.values)], dtype=np.float64)))
            x[:, CORPUS_RARITY] = (values[off[1:]] - values[off[:-1]]) / np.maximum(np.diff(off), 1)
            words = np.asarray(b.column("words"))
            if model is None:
                got = [pa.array(list(x), pa.list_(pa.float64()))]
            else:
                p, some = model.probabilities(x), words > 0
                got = [pa.array(np.where(some, p.argmax(axis=1) + 1, 1).astype(np.int32)), pa.array(np.where(some, model.score(x), 0.0)), pa.array(np.where(some, p.max(axis=1), 0.0))]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], b.column("words"), *got], [*keep, *results])

    return surveyed.where("b is null").select(*keep, "words", "features", "content").mapInArrow(run, schema)


def fit(surveyed: DataFrame, doc_id: str, grades: DataFrame, band: str, rarity: np.ndarray, sample: int = SAMPLE_DOCS) -> Ordinal | None:
    """The model from at most ``sample`` graded documents, those with the least hashes of their id.

    Each grade is an observation, so a document with two grades counts with both; grades that
    are null are left out. None if there are fewer than two bands.
    """
    spark = surveyed.sparkSession
    graded = grades.where(F.col(band).isNotNull()).select(F.col(doc_id).alias("i"), F.col(band).cast("int").alias("y"))
    chosen = graded.select("i").distinct().orderBy(F.xxhash64("i")).limit(sample)
    ids = chosen.toPandas()
    if not len(ids):
        return None
    few = spark.createDataFrame(ids, chosen.schema)
    got = with_levels(surveyed.join(F.broadcast(few), surveyed[doc_id] == few["i"]), [doc_id], rarity, None).toPandas()
    y = graded.join(F.broadcast(few), "i").toPandas()
    x = dict(zip(got[doc_id], got["features"]))
    pairs = sorted((i, b) for i, b in zip(y["i"], y["y"]) if i in x)
    bands = np.array([b for _, b in pairs])
    if len(set(bands.tolist())) < 2:
        return None
    return Ordinal.fit(np.array([x[i] for i, _ in pairs]), bands, np.ones(len(pairs)), int(bands.max()))
