"""Leaks against brute force over random texts, and hand-made edits."""

import random

import numpy as np
import pytest

from loomwake.llm import leakage as K

RNG = random.Random(11)
VOCAB = [f"word{i}" for i in range(200)]
ITEM = [RNG.choice(VOCAB) for _ in range(60)]


def noise(n):
    return [f"other{RNG.randrange(500)}" for _ in range(n)]


def found(spark, texts, items=None):
    """Run and edits by (place of the text, item)."""
    texts = [t if isinstance(t, str) or t is None else " ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(items or [(7, " ".join(ITEM))], "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.run_words, r.word_edits) for r in K.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}


def test_consecutive_words_whatever_their_place(spark):
    texts, want = [], {}
    for n in range(10, 25):
        for at in range(0, 60 - n, 3):
            if n >= 16:
                want[len(texts), 7] = n
            texts.append(noise(at % 7 + 20) + ITEM[at : at + n] + noise(30))
    got = found(spark, texts)
    assert {k: v[0] for k, v in got.items()} == want


def test_changed_words_case_punctuation_and_variants(spark):
    changed = list(ITEM)
    for i in range(4, 60, 9):
        changed[i] = "changed"
    more = list(changed)
    for i in range(0, 60, 4):
        more[i] = "changed"
    added = [w for i, w in enumerate(ITEM) for w in ([w, "also"] if i % 9 == 4 else [w])]
    texts = [noise(20) + changed + noise(20), noise(20) + added + noise(20), noise(20) + more + noise(20), ",\n ".join(w.upper() for w in ITEM), " ".join(w.replace("o", "\u043e") + "\u200b" for w in ITEM)]
    got = found(spark, texts)
    assert set(got) == {(0, 7), (1, 7), (3, 7), (4, 7)} and got[0, 7][1] == 7


@pytest.mark.parametrize("n", range(1, 40))
def test_kinds_hold_for_every_way_to_change_an_item(n):
    """Whichever words are changed, enough fingerprints of the item stay."""
    rng = random.Random(n)
    kind, need = K.item_kind(n, n)
    e = K.edits_allowed(n)
    k = kind or K.K
    for _ in range(400):
        wrong = set(rng.sample(range(n), e)) if n > e else set()
        whole = [i for i in range(n - k + 1) if not wrong & set(range(i, i + k))]
        if kind == K.WINNOWED:
            stretches = np.diff(sorted([-1, n, *wrong])) - 1
            whole = [0] * sum(max(0, (s - K.K - K.W + 2 + K.W - 1) // K.W) for s in stretches)
        assert len(whole) >= need or n < k, (n, wrong)


def test_short_items_with_edits_are_all_found(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"t{rng.randrange(4000)}" for _ in range(n))) for i, n in enumerate([n for n in range(1, 41) for _ in range(12)])]
    texts, want = [], set()
    for i, t in items:
        words = t.split()
        for how in range(4):
            w = list(words)
            for _ in range(K.edits_allowed(len(w))):
                at = rng.randrange(len(w))
                w[at : at + (how != 1)] = [["changed"], ["added"], [], ["changed"]][how] if how != 2 or len(w) > 1 else ["changed"]
            want.add((len(texts), i))
            texts.append(noise(9) + w + noise(9))
        over = list(words)
        for at in rng.sample(range(len(over)), min(len(over), K.edits_allowed(len(over)) + 1)):
            over[at] = "changed"
        texts.append(noise(9) + over + noise(9))
    got = set(found(spark, texts, items))
    long = {(d, i) for d, i in got - want if len(items[i][1].split()) < 17}
    assert want <= got and not {x for x in long if len(items[x[1]][1].split()) > 8}


def test_short_items_and_edges(spark):
    got = found(spark, ["well known saying here", "known well saying", "", None, "x"], [(1, "Well-known, saying!"), (2, ""), (3, None)])
    assert set(got) == {(0, 1)}


def test_edit_distance():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(100):
        a, b = [RNG.randrange(4) for _ in range(RNG.randrange(1, 90))], [RNG.randrange(4) for _ in range(RNG.randrange(120))]
        assert K.edits(np.array(a), np.array(b, dtype=int)) == plain(a, b)


def test_runs_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    for limit in (4_000_000, 50):
        monkeypatch.setattr(K, "AT_ONCE", limit)
        for _ in range(40):
            sides = [[rng.integers(0, 3, rng.integers(1, 12)) for _ in range(5)] for _ in range(2)]
            off = [np.concatenate(([0], np.cumsum([len(x) for x in s]))) for s in sides]
            blank = np.concatenate([np.cumsum(rng.integers(0, 2, len(x))) for x in sides[0]])
            pair, shift = np.repeat(np.arange(5), 3), rng.integers(-5, 6, 15)
            run, common = K.extend(np.concatenate(sides[0]), off[0], blank, np.concatenate(sides[1]), off[1], pair, shift)
            for p, s, r, c in zip(pair, shift, run, common):
                item, doc, bl = sides[0][p], sides[1][p], blank[off[0][p] : off[0][p + 1]]
                eq = [0 <= j + s < len(doc) and item[j] == doc[j + s] for j in range(len(item))]
                best = 0
                for a in range(len(item)):
                    for b in range(a + 1, len(item) + 1):
                        if all(eq[a:b]):
                            best = max(best, sum(all(a <= j < b for j in range(len(item)) if bl[j] == x) for x in set(bl)))
                assert (r, c) == (best, sum(eq))


def test_many_items(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"v{rng.randrange(30_000)}" for _ in range(24))) for i in range(60_000)]
    texts = [noise(4) + items[i][1].split()[2:20] + noise(4) for i in range(0, 60_000, 300)]
    assert set(found(spark, texts, items)) == {(k, i) for k, i in enumerate(range(0, 60_000, 300))}


def test_on_columns(spark):
    docs = spark.createDataFrame([(1, " ".join(noise(5) + ITEM[:20])), (2, None), (3, ""), (4, " ".join(noise(50_000) + ITEM[10:40])), (1, " ".join(ITEM)), (None, " ".join(ITEM))], "doc_id long, text string")
    items = spark.createDataFrame([("x", " ".join(ITEM)), ("y", None), ("z", "something else entirely that nobody wrote")], "item string, text string")
    found = K.find_leaks(docs, "doc_id", "text", items, "item", "text")
    assert found.columns == ["doc_id", "item", "run_words", "word_edits"]
    assert {(r.doc_id, r.item) for r in found.collect()} == {(1, "x"), (4, "x"), (None, "x")} and found.count() == 4
    assert K.find_leaks(docs.limit(0), "doc_id", "text", items, "item", "text").count() == 0
    assert K.find_leaks(docs, "doc_id", "text", items.limit(0), "item", "text").count() == 0
