"""Rolling totals, attributes at event time and orphan references on small hand-made tables."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from loomwake.operators import context, references
from loomwake.operators.asof import known_at
from loomwake.operators.bitmaps import Bitmap
from loomwake.operators.references import unresolved
from loomwake.operators.rolling import rolling_totals
from loomwake.plans import pipeline, registry

DAY = dt.date(2026, 1, 1)
DAYS = "user string, d date, n int, got timestamp_ntz, nth_day string, __e string"


def at(day, minute=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day, minutes=minute)


def test_rolling_fills_quiet_days_and_takes_the_last_version(spark):
    rows = [("a", DAY, 5, at(0), "x", "y"), ("a", DAY, 7, at(1), "x", "y"), ("a", DAY, 7, at(1), "x", "y"), ("a", DAY + dt.timedelta(3), None, at(4), "x", "y"), ("a", None, 9, at(4), "x", "y"), (None, DAY, 1, None, "x", "y")]
    out = rolling_totals(spark.createDataFrame(rows, DAYS), "user", "d", ["n"], (2, 4), "got").collect()
    a = sorted((r for r in out if r.user == "a"), key=lambda r: r.d)
    assert [(r.nth_day, r.n, r.n_sum_2, r.n_sum_4) for r in a] == [(1, 7, 7, 7), (2, 0, 7, 7), (3, 0, 0, 7), (4, 0, 0, 7)]
    assert a[0].n_avg_4 == 7 / 4
    assert [(r.d, r.n) for r in out if r.user is None] == [(DAY, 1)]


def test_rolling_ties_and_empty(spark):
    rows = [("a", DAY, 5, at(0), "", ""), ("a", DAY, 8, at(0), "", ""), ("a", DAY, 9, None, "", "")]
    assert rolling_totals(spark.createDataFrame(rows, DAYS), "user", "d", ["n"], (7,), "got").collect()[0].n == 8
    assert rolling_totals(spark.createDataFrame([], DAYS), "user", "d", ["n"], (7,), "got").count() == 0
    assert rolling_totals(spark.createDataFrame(rows, DAYS), "user", "d", ["n"], (7,)).collect()[0].n == 22


def test_known_at_equals_brute_force(spark):
    rng = random.Random(7)
    ev = [(rng.choice(["hot", "hot", "a", None]), at(rng.randrange(90), rng.randrange(3)) if rng.random() > 0.1 else None, i) for i in range(300)]
    ch = [(rng.choice(["hot", "a", "b", None]), at(rng.randrange(90), rng.randrange(3)) if rng.random() > 0.1 else None, str(rng.randrange(5))) for _ in range(60)]
    e = spark.createDataFrame(ev, "k string, t timestamp_ntz, i int").withColumns({"since": F.lit(1), "v": F.lit("clash")})
    c = spark.createDataFrame(ch, "k string, c timestamp_ntz, v string").withColumn("t", F.lit(0))
    got = {r.i: (r.known_since, r.v, r.latest_change) for r in known_at(e, c, ["k"], "t", "c", ["i"], ["v"], slice_s=10 * 86_400).collect()}
    want = {}
    for k, t, i in ev:
        if k is None or t is None:
            continue
        past = [(x, v) for kk, x, v in ch if kk == k and x is not None and x <= t]
        every = [x for kk, x, v in ch if kk == k and x is not None]
        want[i] = (*max(past, default=(None, None)), max(every, default=None))
    assert got == want


def test_known_at_empty_sides_and_equal_times(spark):
    e = spark.createDataFrame([("a", at(1), 1), ("a", at(1), 1)], "k string, t timestamp_ntz, i int")
    none = spark.createDataFrame([], "k string, c timestamp_ntz, v string")
    assert [r.known_since for r in known_at(e, none, ["k"], "t", "c", ["i"], ["v"]).collect()] == [None, None]
    assert known_at(e.limit(0), none, ["k"], "t", "c", ["i"], ["v"]).count() == 0
    c = spark.createDataFrame([("a", at(1), "now"), ("a", at(1), None)], "k string, c timestamp_ntz, v string")
    assert [r.v for r in known_at(e, c, ["k"], "t", "c", ["i"], ["v"]).collect()] == ["now", "now"]


@pytest.mark.parametrize("na,nb,top", [(0, 10, 100), (50, 0, 100), (9000, 9000, 20_000), (60_000, 10, 70_000), (10, 60_000, 70_000), (70_000, 70_000, 300_000)])
def test_bitmap_andnot(na, nb, top):
    rng = np.random.default_rng(na + nb)
    a, b = rng.integers(0, top, na), rng.integers(0, top, nb)
    left = Bitmap.of(a).andnot(Bitmap.of(b))
    assert left.decode().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert len(left) == len(left.decode())
    assert Bitmap.of(a).nbytes <= 2 * na + 8192


REFS, PARENTS = "domain string, relation string, key string, period string", "domain string, key string, received timestamp_ntz, deleted timestamp_ntz"


def test_unresolved(spark):
    refs = spark.createDataFrame([("m", "f", "gone", "2026-02"), ("m", "f", "gone", "2026-02"), ("m", "f", "ok", "2026-02"), ("m", "f", "late", "2026-01"), ("m", "f", "late", "2026-02"), ("m", "f", "cut", "2026-02"), ("m", "f", "ok", None), ("n", "f", "ok", "2026-02"), ("m", "f", None, "2026-02")], REFS)
    parents = spark.createDataFrame([("m", "ok", at(0), None), ("m", "late", at(20), None), ("m", "cut", at(0), at(99)), ("m", None, at(0), None)], PARENTS)
    got = {(r.domain, r.key, r.period, r.parent_exists) for r in unresolved(refs, parents, 3).collect()}
    assert got == {("m", "gone", "2026-02", False), ("m", "late", "2026-01", True), ("m", "cut", "2026-02", True), ("m", "ok", "unknown", True), ("n", "ok", "2026-02", False)}
    assert unresolved(refs.limit(0), parents).count() == 0
    assert unresolved(refs, parents.limit(0), 2).count() == 7


def test_parents_that_were_always_there_settle_every_period(spark):
    refs = spark.createDataFrame([("b", "f", "ok", "2026-02"), ("b", "f", "ok", None), ("b", "f", "gone", "2026-02"), ("b", "f", "gone", None)], REFS)
    parents = spark.createDataFrame([("b", "ok")], "domain string, key string").select("*", F.lit(references.ALWAYS).cast("timestamp_ntz").alias("received"), F.lit(None).cast("timestamp_ntz").alias("deleted"))
    assert {(r.key, r.period) for r in unresolved(refs, parents, 2).collect()} == {("gone", "2026-02"), ("gone", "unknown")}


def test_only_missing_businesses_survive_the_bitmaps(spark):
    refs, parents = pipeline._references(spark, "/root/testdata/sf0.001")
    left = unresolved(refs.where("relation = 'messages.business_id'"), parents, 2).collect()
    assert left and not [r.key for r in left if r.parent_exists]


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["quiet_hours", "message_load", "promotion_opt_outs", "message_context", "p5_found"])
def test_queries_without_texts_read_none(spark, name):
    plan = executed(registry.queries()[name](spark, DATA))
    assert "Scan parquet" in plan and "message_text" not in plan


def test_messages_are_scanned_for_both_attributes_together(spark):
    """Once for the slices' summaries and once to be carried through."""
    assert executed(registry.queries()["p5_found"](spark, DATA)).count("messages.parquet") <= 2


def test_context_keeps_every_message_and_multiplies_none(spark):
    kind = "message_id string, user_id string, group_id string"
    m = spark.createDataFrame([("a", "u", "g"), ("a", "u", "g"), ("b", None, None), ("c", "v", "h")], kind)
    members = spark.createDataFrame([("g", "u", "member"), ("g", "u", "admin"), ("h", None, "admin"), (None, "v", "x")], "group_id string, user_id string, role string")
    days = spark.createDataFrame([("u", 2, 5), ("u", 1, 7), ("u", None, 9), (None, 1, 1)], "user_id string, day int, sent int")
    c = context.build_context(m, {"members": context.one_per_key(members, context.SIDES["members"])}, context.daily_lists(days, "user_id", "day", ["sent"]))
    got = sorted((r.message_id, r.members and r.members.role, r.summaries and [tuple(s) for s in r.summaries]) for r in c.collect())
    assert got == [("a", "member", [(1, 7), (2, 5)]), ("a", "member", [(1, 7), (2, 5)]), ("b", None, None), ("c", None, None)]
    assert context.build_context(m.limit(0), {"members": members}).count() == 0
