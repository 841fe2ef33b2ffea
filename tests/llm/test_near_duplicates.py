"""Signatures against exact similarity, links and groups against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwake.llm import neardup as N


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 1 << 60, 40), rng.integers(1, 1 << 60, 40)
    y[:30] = x[:30]
    a = N.prob_minhash(np.concatenate([x, y]), None, np.array([0, 40, 80]), 2000)
    assert abs((a[0] == a[1]).mean() - 30 / 50) < 0.05
    w = np.ones(80)
    w[:30] = w[40:70] = 5
    b = N.prob_minhash(np.concatenate([x, y]), w, np.array([0, 40, 80]), 2000)
    assert abs((b[0] == b[1]).mean() - 150 / 170) < 0.05
    assert (N.prob_minhash(x[:0], None, np.array([0, 0]), 10) == 0).all()


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    while len(out) < n:
        base = rng.sample(words, 30)
        out.append((f"d{len(out):04d}", base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(30)] = rng.choice(words)
            rng.shuffle(copy)
            out.append((f"d{len(out):04d}", copy))
    return out


def test_pairs_equal_brute_force(spark):
    docs = corpus()
    want = {(a, b) for i, (a, x) in enumerate(docs) for b, y in docs[i + 1 :] if len({*x} & {*y}) / len({*x} | {*y}) >= 0.7}
    df = spark.createDataFrame(docs, "id string, words array<string>").withColumn("__c", F.lit(1))
    got = {(r.id_a, r.id_b) for r in N.near_pairs(df, "id", "words", 1, 0.7).collect()}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.8, 0.9, 0.95])
def test_recall_at_other_thresholds(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words, docs = [f"w{i}" for i in range(5000)], []
    for _ in range(60):
        base = rng.sample(words, 40)
        docs += [(f"d{len(docs) + i:04d}", [w if rng.random() > (1 - threshold) * 0.45 else rng.choice(words) for w in base]) for i in range(4)]
    want = {(a, b) for i, (a, x) in enumerate(docs) for b, y in docs[i + 1 :] if len({*x} & {*y}) / len({*x} | {*y}) >= threshold}
    got = {(r.id_a, r.id_b) for r in N.near_pairs(spark.createDataFrame(docs, "id string, words array<string>"), "id", "words", 1, threshold).collect()}
    assert got <= want and len(got) >= 0.999 * len(want) and len(want) > 30


def test_plan_keeps_its_bounds():
    for t in np.linspace(0.2, 1, 33):
        bands, rows, agree = N.plan(float(t))
        assert bands * rows <= N.REGISTERS and (t < 0.21 or (1 - t**rows) ** bands <= N.MISSED_BY_BANDS * 1.01)
    rng = np.random.default_rng(1)
    for t in (0.5, 0.7, 0.9):
        assert (rng.binomial(N.BITS, (1 + t) / 2, 200_000) >= N.plan(t)[2]).mean() > 0.9999
    with pytest.raises(ValueError):
        N.plan(0)


def test_two_sets_of_one_class_are_an_error(spark):
    df = spark.createDataFrame([(1, 10, [1]), (2, 11, [2])], "__c long, __check int, __set array<long>")
    assert N.representatives(df).count() == 2
    with pytest.raises(Exception, match="two different sets"):
        N.representatives(df.withColumn("__c", F.lit(5))).collect()


def test_groups_and_links(spark):
    docs = [*corpus(2, 60), ("none", None), ("empty", []), (None, ["x"]), ("twin_a", ["q", "r"]), ("twin_b", ["r", "q"]), ("twin_b", ["r", "q"])]
    df = spark.createDataFrame(docs, "id string, words array<string>")
    rows = {r.id: r for r in N.near_duplicates(df, "id", "words", 1, 0.7).collect()}
    assert "none" not in rows and "empty" not in rows and None not in rows
    assert rows["twin_a"].class_id == rows["twin_b"].class_id == rows["twin_b"].group_id == "twin_a" and rows["twin_a"].n_links == 0
    assert all(r.group_id == min(i for i, x in rows.items() if x.group_id == r.group_id) for r in rows.values())
    pairs = [(r.id_a, r.id_b) for r in N.near_pairs(df, "id", "words", 1, 0.7).collect()]
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = {}
    for i in rows:
        groups.setdefault(root(i), set()).add(i)
    mine = {}
    for i, r in rows.items():
        mine.setdefault(r.group_id, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    assert N.near_duplicates(df.limit(0), "id", "words").count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "__a long, __b long")
    got = {r["__c"]: r["__root"] for r in N.components(spark, links).collect()}
    assert {got[i] for i in range(61)} == {0} and got[100] == got[101] == 100


def test_words_and_shingles(spark):
    df = spark.createDataFrame([("*Hello,  WORLD!* роwer \n ...",), ("",)], "t string")
    assert [r.w for r in df.select(N.words("t").alias("w")).collect()] == [["hello", "world", "power"], []]
    n = df.select(N.words("t").alias("w")).select(F.size(N.shingles(F.col("w"), 2)).alias("n"), F.size(N.shingles(F.col("w"), 5)).alias("m")).collect()
    assert [(r.n, r.m) for r in n] == [(2, 1), (0, 0)]


def test_repeated_shingles_weigh_as_often_as_they_occur(spark):
    rng = random.Random(5)
    docs = [(i, [w for w in ws for _ in range(int(w[1:]) % 6 + rng.choice([1, 1, 2]))]) for i, ws in corpus(4, 240)]
    docs += [("one", ["q", "r"]), ("often", ["q"] * 9 + ["r"]), ("often_too", ["r"] + ["q"] * 9), ("heavy_a", ["z"] * 20 + ["a", "b"]), ("heavy_b", ["z"] * 20 + ["c", "d"])]
    count = {i: Counter(ws) for i, ws in docs}
    like = lambda x, y: (x & y).total() / (x | y).total()
    want = {(a, b) for n, a in enumerate(count) for b in list(count)[n + 1 :] if like(count[a], count[b]) >= 0.7}
    plain = {(a, b) for n, a in enumerate(count) for b in list(count)[n + 1 :] if len({*count[a]} & {*count[b]}) / len({*count[a]} | {*count[b]}) >= 0.7}
    df = spark.createDataFrame(docs, "id string, words array<string>")
    got = {(r.id_a, r.id_b) for r in N.near_pairs(df, "id", "words", 1, 0.7, repeats=True).collect()}
    assert got == {tuple(sorted(p)) for p in want} and len(want) > 20 and want - plain and plain - want and ("often", "often_too") in got
    rows = {r.id: r for r in N.near_duplicates(df, "id", "words", 1, 0.7, repeats=True).collect()}
    assert rows["often"].class_id == rows["often_too"].class_id != rows["one"].class_id and rows["one"].n_links == 0


def test_sets_alike_in_common_words_are_no_candidates(spark):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(70)]
    docs = [(i, rng.sample(common, 50) + [f"r{i}_{j}" for j in range(30)]) for i in range(600)]
    docs += [(1000 + i, ws[4:]) for i, ws in docs[:40]]
    reps = N.representatives(N.records(spark.createDataFrame(docs, "id int, words array<string>"), "id", "words", 1))
    assert N.class_links(reps, 0.7).count() == 40
    assert N.candidates(reps, 0.7).count() <= 45  # chance pairs, a quarter to a third alike, grow as the square of the table


def test_parities_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(9)
    for n in (5, 80, 400):
        for new in (0, 1, n // 5, n):
            x = rng.integers(1, 1 << 62, n, dtype=np.uint64)
            y = np.concatenate([x[new:], rng.integers(1, 1 << 62, new, dtype=np.uint64)])
            a, b = N._parity(np.concatenate([x, y]), np.array([0, n, 2 * n]))
            assert np.bitwise_count(a ^ b).sum() <= 2 * new
    assert (N._parity(x[:0], np.array([0, 0])) == 0).all()


def test_pairs_across_sizes_equal_brute_force(spark):
    rng = random.Random(8)
    words, docs = [f"w{i}" for i in range(9000)], []
    for size in range(60, 300, 4):  # parities to 163 words, registers from 114
        base = rng.sample(words, size)
        docs += [(f"d{len(docs) + i:04d}", base[: int(size * part)] + rng.sample(words, int(size * more))) for i, (part, more) in enumerate([(1, 0), (0.95, 0.1), (0.72, 0), (1, 0.35), (0.68, 0)])]
    sets = [{*x} for _, x in docs]
    want = {(docs[i][0], docs[j][0]) for i in range(len(docs)) for j in range(i + 1, len(docs)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    got = {(r.id_a, r.id_b) for r in N.near_pairs(spark.createDataFrame(docs, "id string, words array<string>"), "id", "words", 1, 0.7).collect()}
    assert got == want and len(want) > 200
