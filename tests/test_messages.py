"""Text functions, sources, sinks, enrichment and streams on small hand-made inputs."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from loomwake.functions import text as X
from loomwake.functions.patterns import CUES
from loomwake.operators import enrich, evaluate, quality, ranking, retrieval
from loomwake.plans import registry
from loomwake.sources import csv as C
from loomwake.sources import media
from loomwake.streaming import load


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_values(spark):
    assert [one(spark, v, X.boolean) for v in ("1", "Yes", "", None, "no", "maybe")] == [True, True, False, False, False, None]
    assert [one(spark, v, X.count_number) for v in ("7", "", "99999999999", "-1", "x")] == [7, 0, 2**31 - 1, None, None]
    assert one(spark, " a\x00b\n ", X.clean) == "ab" and one(spark, None, X.clean) == ""


def test_texts(spark):
    assert one(spark, "  Straße ＡＢ​C\n x ", X.normalize) == "strasse abc x"
    assert one(spark, "Plain  TEXT ", X.normalize) == "plain text" and one(spark, None, X.normalize) == ""
    assert one(spark, "the cat, the cat a hat", X.tokens) == ["cat", "hat"]
    assert one(spark, "good morning, please send the otp now", lambda c: X.has_cue(c, "greeting")) is True
    assert one(spark, "call me now, it is urgent", lambda c: X.cue_count(c, "urgency")) == 2
    assert sum(map(len, CUES.values())) == 113


@pytest.mark.parametrize("filler", ["plain ", "schön "])
def test_long_texts_are_read_to_their_end(spark, filler):
    text = filler * 40_000 + "call me now, it is urgent"
    assert one(spark, text, X.normalize) == text
    assert one(spark, text, lambda c: X.cue_count(X.normalize(c), "urgency")) == 2
    got = load.flagged(spark.createDataFrame([(text,)], "x string"), "x", ["greeting", "urgency"]).first()
    assert got.cues == ["urgency"]


def test_links(spark):
    assert one(spark, "see https://User@WWW.Shop.example:80/x?y, or bit.ly/abc. mail a@b.com", X.hosts) == ["shop.example", "bit.ly"]
    assert one(spark, "mail.shop.example", lambda c: X.host_within(c, F.lit("shop.example"))) is True
    assert one(spark, "myshop.example", lambda c: X.host_within(c, F.lit("shop.example"))) is False
    assert one(spark, "hi @U_12, ok", lambda c: X.mentions(c, F.lit("u_12"))) is True
    assert one(spark, "hi @u_123", lambda c: X.mentions(c, F.lit("u_12"))) is False


@pytest.mark.parametrize("window,minute,want", [("22:00-07:00", 23 * 60, True), ("22:00-07:00", 7 * 60, False), ("09:00-10:00", 540, True), ("09:00-10:00", 600, False), ("05:00-05:00", 3, True), ("25:00-05:00", 3, False), (None, 3, False)])
def test_windows(spark, window, minute, want):
    at = dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)
    assert spark.createDataFrame([(at, window)], "t timestamp_ntz, w string").select(X.in_window("t", "w").alias("y")).first().y is want


def test_media(spark, tmp_path):
    assert one(spark, "a\\b.png", media.safe_path) == "a/b.png"
    assert [one(spark, p, media.safe_path) for p in ("/etc/x", "a/../b", "C:\\x", "")] == [None] * 4
    (tmp_path / "x.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"0" * 20)
    r = media.read_files(spark, str(tmp_path)).select("*", media.sniff(F.hex(F.substring("content", 1, 64))).alias("s"), media.data_url("content", F.lit("image/png")).alias("u")).first()
    assert r.s.format == "png" and r.u.startswith("data:image/png;base64,iVBOR") and len(r.sha256) == 64
    assert media.read_files(spark, str(tmp_path), 5).first().content is None


def test_csv_round_trip(spark, tmp_path):
    p = str(tmp_path / "users.csv")
    names = [c for c, _ in C.columns("users")]
    with open(p, "w", encoding="utf-8-sig", newline="") as f:
        f.write(",".join([*names, "extra"]) + '\r\nu_1,"22:00-07:00",1,,2,3,"a\nb"\r\nu_2,,0,0,0,0,\r\n')
    rows = C.read_table(spark, p, "users").orderBy("user_id").collect()
    assert rows[0].messages_replied_30d == 0 and rows[1].do_not_disturb_window is None and len(rows) == 2
    out = str(tmp_path / "out.csv")
    df = spark.createDataFrame([(2, "b", 0.5), (1, "a", None)], "pos int, message_id string, confidence double")
    assert C.write_ordered(df, out, ["message_id", "confidence"], "pos") == 2
    assert open(out).read() == "message_id,confidence\na,\nb,0.5\n"
    C.write_report({"b": 1, "a": "ü"}, str(tmp_path / "r.json"))
    assert list(json.load(open(tmp_path / "r.json"))) == ["a", "b"]
    assert not [x for x in os.listdir(tmp_path) if x.endswith(".tmp")]


@pytest.mark.parametrize("text", ["user_id,user_id\nu,1\n", "user_id\nu\n"])
def test_csv_bad_header(spark, tmp_path, text):
    p = tmp_path / "users.csv"
    p.write_text(text)
    with pytest.raises(ValueError):
        C.read_table(spark, str(p), "users")


def test_csv_bad_rows_and_missing_files(spark, tmp_path):
    names = [c for c, _ in C.columns("users")]
    p = tmp_path / "users.csv"
    p.write_text(",".join(names) + "\nu_1,,x,0,0,0\n")
    with pytest.raises(Exception, match="malformed"):
        C.read_table(spark, str(p), "users").collect()
    assert C.read_table(spark, str(tmp_path / "none.csv"), "images").count() == 0
    with pytest.raises(FileNotFoundError):
        C.read_table(spark, str(tmp_path / "none.csv"), "users")


def test_failed_write_leaves_the_old_file(spark, tmp_path):
    out = tmp_path / "out.csv"
    out.write_text("old")
    with pytest.raises(Exception):
        C.write_ordered(spark.createDataFrame([(1,)], "pos int"), str(out), ["missing"], "pos")
    assert out.read_text() == "old" and os.listdir(tmp_path) == ["out.csv"]


def test_quality(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert [(r.k, r.n_rows) for r in quality.duplicate_keys(df, ["k"]).collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        quality.require_unique(df, ["k"])
    assert one(spark, "A; b,a none", quality.parse_ids) == ["a", "b"]
    assert one(spark, [], quality.serialize_ids, "array<string>") == "none" and one(spark, ["b", "a", "b"], quality.serialize_ids, "array<string>") == "b;a"
    out = spark.createDataFrame([("m1", "notify", "event", "why", 0.5, "none"), ("m2", "shout", "event", "", 1.5, "x;x"), ("m2", "mute", "event", "y", None, "x")], "message_id string, action string, message_type string, reason string, confidence double, evidence_message_ids string")
    got = {(r.message_id, r.rule) for r in quality.output_violations(out).collect()}
    assert got == {("m2", r) for r in ("repeated_message", "action_domain", "reason_missing", "confidence_range", "evidence_not_canonical")}


def test_metrics(spark):
    p = spark.createDataFrame([("notify", "event", "notify", "event", 1.0, True), ("mute", "scam", "mute", "spam", 0.3, False)], "gold_action string, gold_message_type string, action string, message_type string, c double, hit boolean")
    a = evaluate.accuracy(p).first()
    assert (a.action_accuracy, a.type_accuracy, a.joint_accuracy) == (1.0, 0.5, 0.5)
    c = evaluate.calibration(p, "c", "hit").first()
    assert abs(c.brier - 0.045) < 1e-12 and abs(c.ece - 0.15) < 1e-12
    assert {(r.bin, r.n) for r in evaluate.calibration_bins(p, "c", "hit").collect()} == {(9, 1), (3, 1)}
    e = evaluate.evidence_metrics(spark.createDataFrame([(["a"], ["a", "b"]), ([], [])], "evidence array<string>, gold_evidence array<string>")).first()
    assert (e.exact_rate, e.mean_jaccard, e.precision, e.recall) == (0.5, 0.75, 1.0, 0.5)


def test_ranking(spark):
    r = spark.createDataFrame([(1.0, 1.0, None)], "a double, b double, c double").select(ranking.argmax({"x": F.col("a"), "y": F.col("b"), "z": F.col("c")}).alias("n"), ranking.margin([F.col("a"), F.lit(0.25)]).alias("m")).first()
    assert (r.n, r.m) == ("x", 0.75)


SIDE = "message_id string, user_id string, created_at timestamp_ntz, text string, conversation string, conversation_type string, media_type string"


def test_evidence_is_earlier_and_of_the_same_user(spark):
    day = lambda n: dt.datetime(2026, 7, n)
    rows = [("prior", "u1", day(1), "water tanker arrives soon"), ("other", "u2", day(1), "water tanker arrives soon"), ("later", "u1", day(9), "water tanker arrives soon"), ("none", "u1", day(1), "bread recipe"), ("undated", "u1", None, "water tanker arrives soon")]
    h = spark.createDataFrame([(*r, "g", "group", "") for r in rows], SIDE)
    q = spark.createDataFrame([("q", "u1", day(5), "water tanker arrives soon", "g", "group", ""), ("blank", "u1", day(5), "", "g", "group", "")], SIDE)
    got = retrieval.similar_prior(q, h).collect()
    assert [(r.message_id, r.evidence_id, r["rank"]) for r in got] == [("q", "prior", 1)] and got[0].score == 1.0
    events = spark.createDataFrame([("prior", True, False, False, True, False)], "message_id string, message_opened boolean, message_replied boolean, notification_dismissed boolean, muted_after_message boolean, message_reported boolean")
    f = retrieval.history_features(retrieval.similar_prior(q, h), events).first()
    assert f.rejected and abs(f.engagement - (0.5 + 0.5 * 0.55 - 0.6)) < 1e-9 and f.repetition == 1.0
    assert retrieval.similar_prior(q, h.limit(0)).count() == 0


def test_enrichment_asks_once_and_remembers(spark, tmp_path):
    def client():
        def ask(texts):
            if any(t == "down" for t in texts):
                raise OSError
            return ["not json" if t == "bad" else json.dumps({"n": len(t)}) for t in texts]

        return ask

    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "bad"), (4, "down"), (5, None), (6, "")], "i int, t string")
    asked = enrich.ask(enrich.distinct_contents(df, "t"), client, 4)
    assert {(r.error, r.n) for r in enrich.failure_counts(asked).collect()} == {("none", 1), ("malformed", 1), ("failed", 1)}
    r = enrich.report(asked).first()
    assert (r.n_contents, r.n_answered, r.n_failed, r.failed, r.malformed, r.timeout) == (3, 1, 2, 1, 1, 0) and r.n_attempts >= 7
    got = {r.i: (r.facts, r.error) for r in enrich.enrich(df, "t", client, cache).collect()}
    assert got[1] == got[2] == ('{"n": 3}', None) and got[3] == (None, "malformed") and got[4] == (None, "failed") and got[5] == got[6] == (None, None)

    def dead():
        def ask(texts):
            raise AssertionError("asked again")

        return ask

    again = {r.i: r.facts for r in enrich.enrich(df.where("i < 3"), "t", dead, "file:" + cache).collect()}
    assert again == {1: '{"n": 3}', 2: '{"n": 3}'}
    assert {r.i: r.facts for r in enrich.enrich(df, "t", lambda: lambda texts: ["{}"] * len(texts), cache).collect()} == {1: '{"n": 3}', 2: '{"n": 3}', 3: "{}", 4: "{}", 5: None, 6: None}


def test_answers_by_index_and_kinds_of_failure(spark):
    assert enrich.by_index(['{"index": 1, "a": 1}', '{"index": 0, "a": 2}'], 2) == ['{"index": 0, "a": 2}', '{"index": 1, "a": 1}']
    assert enrich.by_index(["x", "y"], 2) == ["x", "y"]
    assert [enrich.by_index(a, 2) for a in (["x"], ['{"index": 0}', '{"index": 0}'], ['{"index": 0}', '{"index": 2}'], ['{"index": 0}', "x"], ['{"index": true}', '{"index": 0}'])] == [None] * 5
    assert [enrich.failure(e) for e in (TimeoutError(), ConnectionResetError(), PermissionError(), BlockingIOError(), KeyError())] == ["timeout", "unreachable", "refused", "rate_limited", "failed"]
    df = spark.createDataFrame([("d", "a")], "digest string, content string")

    def slow():
        def ask(texts):
            raise TimeoutError

        return ask

    def never(seconds):
        if seconds not in (0.5, 1.0):
            raise SystemExit(f"waited {seconds}")

    r = enrich.ask(df, slow, sleep=never, wait=0.5).first()
    assert (r.error, r.facts, r.attempts) == ("timeout", None, 6)
    assert enrich.ask(df, lambda: lambda texts: ["{}"] * 2).first().error == "mismatched"


def test_first_pick_of_messages_that_speak_by_their_media(spark):
    e = spark.createDataFrame([("q", "a", 0.34, 1), ("q", "b", 0.33, 2), ("q", "c", 0.5, 3), ("r", "a", 0.34, 1)], "message_id string, evidence_id string, score double, rank int")
    seen = spark.createDataFrame([("a", True, False, False, False, False), ("b", True, False, False, False, False)], "message_id string, message_opened boolean, message_replied boolean, notification_dismissed boolean, muted_after_message boolean, message_reported boolean")
    assert {r.message_id: r.evidence_ids for r in retrieval.named_evidence(e, seen).collect()} == {"q": ["c"]}
    only = spark.createDataFrame([("q",), ("r",)], "message_id string")
    assert {r.message_id: r.evidence_ids for r in retrieval.named_evidence(e, seen, media_only=only).collect()} == {"q": ["a", "c"], "r": ["a"]}


def test_query_text_takes_what_media_say(spark):
    p = retrieval.FACTS_PREFIX
    rows = [("Look", p + '{"summary":"A Cat","signals":["x"]}'), ("", "plain words"), ("Only", None), ("T", p + "no json")]
    got = [r.t for r in spark.createDataFrame(rows, "a string, m string").select(retrieval.query_text("a", "m").alias("t")).collect()]
    assert got[:3] == ["look a cat x", "plain words", "only"] and got[3].endswith("no json")
    assert one(spark, "  ＡＢ ", lambda c: X.normalize(c)) == "ab"


def test_order_and_defence_of_evidence(spark):
    day = lambda n: dt.datetime(2026, 7, n)
    h = spark.createDataFrame([("b", "u", day(2)), ("a", "u", day(2)), ("c", "u", None), ("x", "v", day(1))], "message_id string, user_id string, created_at timestamp_ntz")
    assert [r.message_id for r in retrieval.history_order(h).collect()] == ["c", "x", "a", "b"]
    q = spark.createDataFrame([("q", "u", day(3)), ("a", "u", day(2))], h.schema)
    e = spark.createDataFrame([("q", x) for x in "abcx"] + [("a", "a"), ("a", "b")], "message_id string, evidence_id string")
    assert sorted(r.evidence_id for r in retrieval.same_user_evidence(e, q, h).collect()) == ["a", "b"]


def test_labels_and_predictions_must_match(spark):
    kind = "message_id string, action string"
    labels = spark.createDataFrame([("a", "mute"), ("b", "notify")], kind)
    assert {(r.message_id, r.action, r.gold_action) for r in evaluate.graded(labels, spark.createDataFrame([("b", "mute"), ("a", "mute")], kind)).collect()} == {("a", "mute", "mute"), ("b", "mute", "notify")}
    other = spark.createDataFrame([("b", "mute"), ("c", "mute")], kind)
    assert {tuple(r) for r in evaluate.unmatched(labels, other).collect()} == {("a", "label_only"), ("c", "prediction_only")}
    with pytest.raises(ValueError):
        evaluate.graded(labels, other)
    with pytest.raises(ValueError):
        evaluate.graded(labels.union(labels), labels)


def test_labelled_file(spark, tmp_path):
    names = [c for c, _ in C.columns("sample_messages")]
    row = lambda i, action: ",".join([i, "u", *[""] * 8, "0", action, "event", "why", "0.5", "none"])
    p = tmp_path / "s.csv"
    for rows, ok in (([row("m1", "mute"), row("m2", "notify")], True), ([row("m1", "mute")] * 2, False), ([row("m1", "shout")], False), ([], False)):
        p.write_text("\n".join([",".join(names), *rows]) + "\n")
        if ok:
            assert C.read_labelled(spark, str(p)).count() == 2
        else:
            with pytest.raises(ValueError):
                C.read_labelled(spark, str(p))


def test_rows_keep_their_position_and_number(spark, tmp_path):
    p = tmp_path / "images.csv"
    p.write_text("image_id,file_path\n" + "".join(f'i{9 - k},"a\nb"\n' for k in range(9)))
    t = C.read_table(spark, "file:" + str(p), "images", position="pos")
    assert [r.image_id for r in t.orderBy("pos").collect()] == [f"i{9 - k}" for k in range(9)]
    with pytest.raises(Exception, match="too many"):
        C.read_table(spark, str(p), "images", most_rows=8).collect()
    os.symlink(p, tmp_path / "link.csv")
    with pytest.raises(ValueError):
        C.read_table(spark, str(tmp_path / "link.csv"), "images")


def test_json_depth_and_nodes(spark):
    nest = lambda n, inner: "[" * n + inner + "]" * n
    ok = lambda text, **k: one(spark, text, lambda c: X.strict_json(c, **k)) is not None
    assert ok(nest(20, "1")) and not ok(nest(21, "1")) and ok(nest(21, "")) and not ok(nest(22, ""))
    assert ok('{"a":[1,2,{}]}', nodes=5) and not ok('{"a":[1,2,{}]}', nodes=4) and ok('{"a,[":"]],"}', nodes=2) and ok("[]", nodes=1)


def test_sniffed_heads(spark):
    heads = {
        "FFD8FFE000104A464946": "jpeg", "89504E470D0A1A0A0000": "png", "524946460000000057454250": "webp", "524946460000000057415645": "wav", "0000001C6674797061766966000000006D696631": "avif", "0000001C667479704D344120000000006D703432": "m4a",
        "49443303": "mp3", "FFFB9064": "mp3", "FFE39064": "mp3", "FFFBF064": "", "0000": "", "": "", "RIFF": "",
    }
    assert {h: one(spark, h, lambda c: media.sniff(c)["format"]) for h in heads} == heads


def test_files_beyond_the_bound_are_not_read(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"0" * 90)
    (tmp_path / "b.png").write_bytes(bytes.fromhex("89504E470D0A1A0A"))
    got = {r.path[-5:]: (r.length, r.content is None) for r in media.read_files(spark, str(tmp_path), 50).collect()}
    assert got == {"a.png": (98, True), "b.png": (8, False)}
    assert [tuple(r) for r in media.file_audit(spark, str(tmp_path)).collect()] == [("png", 2, 106, 2)]


def test_secrets(spark):
    texts = {"key app_live_" + "a" * 16: ["live_key"], "sk-" + "b" * 20: ["service_key"], "ghu_" + "c" * 20: ["forge_token"], "ASIA" + "D" * 16: ["cloud_key"], "-----BEGIN PRIVATE KEY-----": ["private_key"], "sk-short ghx_" + "c" * 30: []}
    assert {t: one(spark, t, X.secrets) for t in texts} == texts


def test_hosts_in_their_ascii_form(spark):
    assert [one(spark, h, X.ascii_host) for h in ("www.Example.test.", "exａmple．test", "bücher.test\u202f", "no host", "")] == ["example.test", "example.test", "xn--bcher-kva.test", None, None]


def test_cue_gates_never_hide_a_match():
    import random

    from loomwake.functions import cues

    s, rng = cues.scanner(tuple(CUES)), random.Random(4)
    words = sorted({w for _, p in s.patterns for w in cues.needed(__import__("re")._parser.parse(p.pattern))}) + ["5 min", "10:30 am", "me", "it", "the", "is", "pay", "₹ 5", "now"]
    texts = [" ".join(rng.choice(words).strip() for _ in range(rng.randrange(1, 9))) for _ in range(1500)] + [None, ""]
    got = s.counts(texts)
    want = [[sum(p.search(t or "") is not None for k, p in s.patterns if k == g) if t else 0 for t in texts] for g in range(s.n)]
    assert got.tolist() == want and got.sum() > 1000


def test_cut_tables_are_deleted(spark):
    from loomwake import session

    there = lambda: {f for f in os.listdir(session.shared_dir(spark)) if f.startswith("loomwake-")}
    before = there()
    with session.cuts_released(spark):
        kept = session.cut(spark.range(3))
        assert kept.count() == 3 and len(there()) == len(before) + 1
        gone = session.cut(spark.range(4))
        session.drop_cut(gone)
        assert len(there()) == len(before) + 1
    assert there() == before


def test_streams(spark, tmp_path):
    src, rows = str(tmp_path / "in"), [("m1", "u1", dt.datetime(2026, 7, 1, 10, 5), "good morning", "b1"), ("m1", "u1", dt.datetime(2026, 7, 1, 10, 5), "good morning", "b1"), ("m2", "u1", dt.datetime(2026, 7, 1, 10, 50), "urgent", "b2"), ("m3", "u2", None, "", None)]
    df = spark.createDataFrame(rows, "message_id string, user_id string, created_at timestamp, message_text string, business_id string")
    df.write.parquet(src)

    def drain(make, name, mode):
        s = make(spark.readStream.schema(df.schema).parquet(src))
        q = s.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert {(r.user_id, r.n_messages) for r in drain(load.hourly_messages, "hourly", "complete")} == {("u1", 3)}
    assert sorted(r.message_id for r in drain(lambda s: load.once_each(s.where("created_at is not null"), "message_id", "created_at"), "once", "append")) == ["m1", "m2"]
    cues = {r.message_id: r.cues for r in drain(lambda s: load.flagged(s, "message_text", ["greeting", "urgency"]), "cues", "append")}
    assert cues == {"m1": ["greeting"], "m2": ["urgency"], "m3": []}
    accounts = spark.createDataFrame([("b1", True)], "business_id string, verified boolean")
    assert sum(bool(r.verified) for r in drain(lambda s: load.with_accounts(s, accounts), "accounts", "append")) == 2


def test_flagship(spark):
    assert registry.flagship(spark, "/root/testdata/sf0.001").columns == ["message_id", "evidence_id", "lexical", "score", "rank"]


def test_facts(spark):
    raw = '{"summary":" a\\tb ","signals":["x","x",""],"confidence":7}'
    f = one(spark, raw, X.facts_normalized)
    assert (f.summary, f.signals, f.confidence, f.transcript) == ("a b", ["x"], 1.0, "")
    assert one(spark, "[1]", X.facts_normalized) is None and one(spark, "prose", X.facts_normalized) is None
    assert one(spark, "s", lambda c: X.facts_wrapper("facts: ", summary=c, language=F.lit("en"))) == 'facts: {"language":"en","summary":"s"}'


def test_output_file_is_read_back(spark, tmp_path):
    p = str(tmp_path / "output.csv")
    m = spark.createDataFrame([("m1", "u1", dt.datetime(2026, 7, 2)), ("m2", "u1", dt.datetime(2026, 7, 2))], "message_id string, user_id string, created_at timestamp")
    h = spark.createDataFrame([("h1", "u1", dt.datetime(2026, 7, 1)), ("h2", "u2", dt.datetime(2026, 7, 1)), ("h3", "u1", dt.datetime(2026, 7, 3))], m.schema)
    open(p, "w").write("message_id,action,message_type,reason,confidence,evidence_message_ids\nm1,notify,event,why,0.5,h1;h2\nm3,mute,spam,why,0.5,none\n")
    got = {(r.message_id, r.rule) for r in C.validate_output_file(spark, p, m, h).collect()}
    assert got == {("m1", "evidence_other_user"), ("m3", "unknown_message"), ("m2", "not_routed")}
    open(p, "w").write("action,message_id\n")
    with pytest.raises(ValueError):
        C.validate_output_file(spark, p, m, h)


@pytest.mark.parametrize("name,table,rows", [("media_formats", "media_files", 1), ("message_facts", "messages", 1), ("message_documents", "messages", 8)])
def test_sniffing_facts_and_json_run_over_whole_tables(spark, con, name, table, rows):
    n = con.execute(f"select {'count(*)' if table == 'media_files' else 'count(distinct nullif(lower(trim(message_id)), $$$$))'} from {table}").fetchone()[0]
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() == n * rows > 0


def test_long_json(spark):
    text = json.dumps({"a": "x" * 60_000, "b": '\\"' * 10_000})
    assert one(spark, text, X.strict_json) == text
    assert one(spark, text[:-1], X.strict_json) is None and one(spark, text[:-1] + ', "c": NaN}', X.strict_json) is None


def test_json_with_more_behind_it(spark):
    assert [one(spark, t, X.strict_json) for t in ("10 boxes came", '{"a":1} and {"b":2}', "[1],[2]", '"a","b"', '"a":"b"', "{}]}", "1 2")] == [None] * 7
    assert [one(spark, t, X.strict_json) for t in ("-1.5e3", '"a"', " [1, {}] ", "null")] == ["-1.5e3", '"a"', "[1, {}]", "null"]


def test_media_groups_and_users_are_checked(spark, con):
    got = {(r.check_name, r.parent): r.n_rows for r in registry.queries()["dangling_media_and_users"](spark, "/root/testdata/sf0.001").collect()}
    files = {(t.strip().lower(), i.strip().lower()) for t, i in con.execute("select media_type, media_id from media_files where media_id is not null").fetchall()}
    named = [(t.strip().lower(), i.strip().lower()) for t, i in con.execute("select media_type, media_id from messages where media_id is not null").fetchall()]
    for kind in ("image", "voice"):
        assert got[f"messages.media_id:{kind}", "media_files"] == sum(t == kind and (t, i) not in files for t, i in named)
    assert {k for k, _ in got} >= {"messages.group_id", "messages.user_id", "group_members.user_id", "user_business_history.user_id"} and len(got) == 7


def test_whole_dataset(spark, tmp_path):
    for name in C.TABLES:
        if name not in ("output", "message_history"):
            (tmp_path / f"{name}.csv").write_text(",".join(c for c, _ in C.columns(name)) + "\n" + ("i1,a.png\n" if name == "images" else ""))
    got = C.load_dataset(spark, str(tmp_path))
    assert set(got) == {*C.TABLES, "media_files"} - {"output"}
    assert [tuple(r) for r in got["media_files"].collect()] == [("image", "i1", "a.png")] and got["message_history"].columns == got["messages"].columns
    os.remove(tmp_path / "users.csv")
    with pytest.raises(FileNotFoundError):
        C.load_dataset(spark, str(tmp_path))
