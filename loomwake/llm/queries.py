"""Queries of the text problems and, where SQL can say it, their SQL."""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwake.functions.keys import ident
from loomwake.llm import langid, leakage, neardup, normalize, packing, pii, readability, sql
from loomwake.session import table


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every message text in its one form, with the kinds of variants it had; a row for each delivery, so that no text is shuffled."""
    m = table(spark, d, "messages").select(ident("message_id").alias("message_id"), "message_text")
    one = normalize.with_canonical(m, "message_text")
    return one.select("message_id", "canonical_text", F.array_join(normalize.kind_names("variant_kinds"), ",").alias("kinds"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages with character variants, and accounts whose sender domain imitates an official one.

    Accounts meet the official domains on what both look like, so no pairs are tried.
    """
    m = table(spark, d, "messages").select(ident("message_id").alias("record_key"), normalize.canonical("message_text")["kinds"].alias("k")).where("k > 0")
    b = table(spark, d, "business_accounts")
    sender = b.select(ident("business_id").alias("record_key"), normalize.host_form("domain_used_by_sender").alias("used"), normalize.host_skeleton("domain_used_by_sender").alias("seen")).where("used is not null")
    official = b.select(normalize.host_form("official_domain").alias("real"), normalize.host_skeleton("official_domain").alias("seen")).where("real is not null").distinct()
    own = official.select(F.col("real").alias("used"))
    fake = sender.join(official, "seen").where("used <> real").join(own, "used", "left_anti")
    rows = m.select(F.lit("messages").alias("table_name"), "record_key").unionByName(fake.select(F.lit("business_accounts").alias("table_name"), "record_key"))
    return rows.where("record_key is not null").distinct()


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "language_labels").select(ident("message_id").alias("message_id"), "lang")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select(ident("message_id").alias("message_id"), "message_text").where("message_id is not null")
    training = langid.train(m, _labels(spark, d), "message_id", "message_text", "lang")
    return langid.with_language(m.withColumn("text_hash", F.xxhash64("message_text")), "message_text", training, ["message_id", "text_hash"])


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every message text's stretches of one language, with the text's own language; an id that came with several texts has each."""
    t = _languages(spark, d).dropDuplicates(["message_id", "text_hash"])
    s = t.select("message_id", "text_hash", F.col("lang").alias("text_lang"), F.posexplode_outer("segments").alias("segment", "s"))
    return s.select("message_id", "text_hash", "text_lang", "segment", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"), F.coalesce("s.lang", F.lit("und")).alias("lang"), F.round("s.confidence", 3).alias("confidence"))


#: Texts with fewer words (with a letter or digit) have no language of their own.
P3_WORDS = 6


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages in which a text has a sentence and which its label does not name."""
    own = F.array_distinct(F.transform(F.filter("segments", lambda s: s["sure"]), lambda s: s["lang"]))
    found = _languages(spark, d).where(F.col("words") >= P3_WORDS).select("message_id", F.explode(own).alias("lang")).distinct()
    named = _labels(spark, d).select("message_id", langid.label_language(F.col("lang")).alias("lang")).where("lang is not null")
    return found.join(named, ["message_id", "lang"], "left_anti")


def _key(spark: SparkSession) -> bytes:
    """The secret key of the pseudonyms, from the session's ``spark.loomwake.pii.key``; one that nobody knows, and that links only this session's results, if it names none."""
    given = spark.conf.get("spark.loomwake.pii.key", None)
    return given.encode() if given else _own_key(spark.sparkContext.applicationId)


@lru_cache(4)
def _own_key(application: str) -> bytes:
    return secrets.token_bytes(32)


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select(ident("message_id").alias("message_id"), "message_text")
    return pii.redact(m, "message_text", ["message_id"], _key(spark))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every message text with typed, linked placeholders for personal information; a row for each delivery, so that no text is shuffled."""
    return _redacted(spark, d).select("message_id", "redacted", F.array_join("kinds", ",").alias("kinds"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages and the kinds of personal information in them."""
    return _redacted(spark, d).where("message_id is not null").select("message_id", F.explode("kinds").alias("kind")).distinct()


#: What the near-duplicate query compares: messages sent on, of so many words, by distinct words.
P6_WORDS, P6_SIMILARITY = 20, 0.7


def _forwarded(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("forwarded_count >= 1").select(ident("message_id").alias("message_id"), "message_text")
    return m.select("message_id", neardup.words("message_text").alias("words")).where(F.size("words") >= P6_WORDS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of forwarded messages that share 0.7 of their distinct words."""
    return neardup.near_pairs(_forwarded(spark, d), "message_id", "words", 1, P6_SIMILARITY)


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each forwarded message with its class of copies, its group and its links."""
    return neardup.near_duplicates(_forwarded(spark, d), "message_id", "words", 1, P6_SIMILARITY)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that quote evaluation items, with the longest run of words and the word edits."""
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items that leak into them."""
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_runs(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items of which they have as many consecutive words as make a leak, if an item is that long."""
    items = table(spark, d, "eval_items")
    long = items.where(F.size(F.filter(F.split("text", r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))) >= leakage.RUN_WORDS).select("item_id")
    return p9_leaks(spark, d).where(F.col("run_words") >= leakage.RUN_WORDS).select("doc_id", "item_id").distinct().join(long, "item_id", "left_semi").select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items by the number of documents they leak into."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pieces of all documents for every capacity, and the documents' tokens."""
    sizes = packing.with_tokens(table(spark, d, "documents"), ["doc_id", "source"], "text")
    limits = packing.read_limits(table(spark, d, "packing_limits"), "limit_name", "capacity_tokens")
    return packing.pack(sizes, "doc_id", "source", "n_tokens", limits), sizes


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container, for every capacity; in tokens of a public tokenizer."""
    return _packed(spark, d)[0]


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """For every capacity and document: all of it packed once, in one piece if it fits, in no overfull container."""
    packed, sizes = _packed(spark, d)
    return packing.wholeness(packed, sizes, "doc_id", "n_tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers of every capacity and how full they are."""
    return packing.fill(p8_packing(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source, and how far any window strays from the target."""
    return packing.deviations(p8_packing(spark, d), "source")


#: Documents with fewer words, parted by white space, are too short for a level.
P10_WORDS = 60
#: Labelled documents a language, and letters of them, from which the language of unlabelled ones is learnt.
P10_TEXTS, P10_LETTERS = 120, 12_000


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "doc_kind")
    training = langid.train(docs, docs.select("doc_id", "lang"), "doc_id", "text", "lang", P10_TEXTS, P10_LETTERS)
    told = docs.withColumns({"told": langid.label_language(F.col("lang")), "n_words": F.regexp_count("text", F.lit(r"\S+"))})
    keep = ["doc_id", "source", "doc_kind", "n_words"]
    read = readability.survey(told, keep, "text", "told", training)
    rarity = readability.word_counts(read)
    model = readability.fit(read, "doc_id", table(spark, d, "reading_labels"), "band", rarity)
    if model is None:
        return read.where("b is null").select(*keep, F.lit(None).cast("int").alias("band"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("confidence"))
    return readability.with_levels(read, keep, rarity, model).drop("words")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every English document with its reading band, its place on the scale and the confidence."""
    return _levels(spark, d).withColumns({"score": F.round("score", 4), "confidence": F.round("confidence", 4)})


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The most demanding English documents of some length."""
    return _levels(spark, d).where((F.col("n_words") >= P10_WORDS) & (F.col("band") == 4)).select("doc_id").distinct()


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """English documents and their words by kind and band."""
    return _levels(spark, d).where(F.col("n_words") >= P10_WORDS).groupBy("doc_kind", "band").agg(F.count("*").alias("n_documents"), F.sum("n_words").alias("n_words"))


QUERIES = {"p1_found": p1_found, "p1_texts": p1_texts, "p3_found": p3_found, "p3_segments": p3_segments, "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_found": p6_found, "p6_groups": p6_groups, "p10_found": p10_found, "p10_levels": p10_levels, "p10_profile": p10_profile, "p8_packing": p8_packing, "p8_whole": p8_whole, "p8_fill": p8_fill, "p8_mixture": p8_mixture, "p9_found": p9_found, "p9_items": p9_items, "p9_runs": p9_runs, "p9_leaks": p9_leaks}
ORACLES = sql.ORACLES
