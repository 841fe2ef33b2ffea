"""Suffix automata against brute force, languages on held-out sentences."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwake.llm import langid as L

TEXT = {
    "en": "the garden is behind the house and we go there every morning. please bring the keys before noon because the door is locked. our neighbour said that the bus was late again. you can see the river from this window.",
    "es": "el jardín está detrás de la casa y vamos allí todas las mañanas. por favor trae las llaves antes del mediodía porque la puerta está cerrada. nuestro vecino dijo que el autobús llegó tarde otra vez. se puede ver el río desde esta ventana.",
    "ru": "сад находится за домом и мы ходим туда каждое утро. пожалуйста принесите ключи до полудня потому что дверь закрыта. наш сосед сказал что автобус опять опоздал. из этого окна видна река.",
}
ROWS = [(k, s + ".") for k, v in TEXT.items() for s in v.split(".") if s.strip()]


def phrases(text, letters):
    n, i = 0, 0
    while i < len(letters):
        k = 1
        while i + k <= len(letters) and letters[i : i + k] in text:
            k += 1
        n += 1
        i += max(k - 1, 1)
    return n


def test_phrases_equal_brute_force():
    rng = random.Random(5)
    text = "".join(rng.choice("ab c") for _ in range(400))
    tests = ["".join(rng.choice("abcx ") for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    tests.sort(key=len, reverse=True)
    size = np.array([len(t) for t in tests])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    got = np.add.reduceat(L.Automaton(text).phrases(np.array([ord(c) for t in tests for c in t], np.uint32), start, size), start, dtype=int) + 1
    for t, g in zip(tests, got):
        assert g >= phrases(text, t) and (g == phrases(text, t) or "x" in t)


def test_sentences_and_mixed_text():
    training = L.clean(ROWS)
    assert [k for k, _ in training] == ["en", "es", "ru"]
    a = pa.array(["We go to the house every morning. El autobús llegó tarde por la puerta. Ok.", None, "", "12345 !!", "Сосед сказал что дверь закрыта"])
    seg, lang, conf, words = (x.to_pylist() for x in L.label(L.Sentences(a), training))
    assert [s["lang"] for s in seg[0]][:2] == ["en", "es"] and all(s["sure"] for s in seg[0][:2])
    assert seg[0][0]["begin"] == 0 and seg[0][0]["end"] <= seg[0][1]["begin"] + 1
    assert lang[1:4] == ["und"] * 3 and conf[1:4] == [0, 0, 0] and lang[4] == "ru"
    assert words == [15, 0, 0, 1, 5]  # marks are no words


def test_run_on_text_is_parted_where_the_language_changes():
    training = L.clean(ROWS)
    mixed = "please bring the keys before noon because the door is locked nuestro vecino dijo que el autobús llegó tarde otra vez"
    [seg] = L.label(L.Sentences(pa.array([mixed])), training)[0].to_pylist()
    assert [(x["lang"], mixed[x["begin"] : x["end"]].strip()) for x in seg] == [("en", mixed[:60].strip()), ("es", mixed[60:].strip())]
    one = " ".join(r[1].rstrip(".") for r in ROWS if r[0] == "en")
    [seg] = L.label(L.Sentences(pa.array([one])), training)[0].to_pylist()
    assert [x["lang"] for x in seg] == ["en"]


def test_changes_equal_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(20):
        n = rng.integers(6, 8)
        cost = rng.integers(0, 12, (2, n)).astype(np.float32)
        s = L.Sentences(pa.array(["word " * int(n)]))
        new = L._changes(s, cost)
        price = lambda p: sum(cost[k, i] for i, k in enumerate(p)) + L.CHANGE * sum(a != b for a, b in zip(p, p[1:]))
        best = min(map(price, itertools.product((0, 1), repeat=int(n))))
        cuts = np.flatnonzero(new)
        path = [min((0, 1), key=lambda k: cost[k, a:b].sum()) for a, b in zip(cuts, [*cuts[1:], n])]
        assert price(np.repeat(path, np.diff([*cuts, n]))) <= best + 1e-4


def test_long_sentences_walk_in_parts(monkeypatch):
    training = L.clean(ROWS)
    texts = pa.array([" ".join(r[1].rstrip(".") for r in ROWS if r[0] == k) for k in ("en", "es", "ru")])
    whole = [[x["lang"] for x in seg] for seg in L.label(L.Sentences(texts), training)[0].to_pylist()]
    monkeypatch.setattr(L, "WALK", 40)
    parts = [[x["lang"] for x in seg] for seg in L.label(L.Sentences(texts), training)[0].to_pylist()]
    assert whole == parts == [["en"], ["es"], ["ru"]]


def test_training_text_is_not_the_alphabets_beginning(monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_LETTERS", 120)
    words = "apple bread candle door evening forest garden house island jacket kitchen ladder market number orange pencil river summer table window yellow".split()
    rows = [("en", f"{w} stands behind the old {v} of this town.") for w in words for v in words[:3]] + [("ru", "сад находится за старым домом и рекой.")]
    heads = [x.split()[0] for x in dict(L.clean(rows))["en"].split("\n")]
    assert heads != sorted(heads) or len(heads) < 3


def test_wrong_labels_are_outvoted():
    rows = [r for r in ROWS for _ in range(5)] + [("en", ROWS[4][1]), ("es", ROWS[0][1])]
    training = dict(L.clean(rows))
    assert "jardín" not in training["en"] and "garden" not in training["es"]


def test_on_columns(spark):
    rows = [(str(i), t, k) for i, (k, t) in enumerate(ROWS)] + [("x", None, "en"), ("y", "hi", None)]
    df = spark.createDataFrame(rows, "id string, t string, label string")
    training = L.train(df, df, "id", "t", "label")
    out = {r.id: r for r in L.with_language(df.withColumn("lang_", F.lit(1)), "t", training, ["id"]).collect()}
    assert all(out[str(i)].lang == k for i, (k, _) in enumerate(ROWS))
    assert out["x"].lang == "und" and out["x"].segments == []
    assert L.with_language(df.limit(0), "t", training, ["id"]).count() == 0
    assert L.train(df.limit(0), df.limit(0), "id", "t", "label") == ()
    labels = spark.createDataFrame([("EN-gb", "en"), ("Hindi", "hi"), ("por", "pt"), ("und", None), ("", None), (None, None)], "l string, w string")
    assert all(r.g == r.w for r in labels.withColumn("g", L.label_language(F.col("l"))).collect())
