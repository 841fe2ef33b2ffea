"""Constraints, audits and evidence lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts the ids of an evidence list.
SEPARATORS = r"[;,|\s]+"
# The domains of the output's columns.
ACTIONS = ("notify", "digest", "mute")
MESSAGE_TYPES = ("personal", "urgent", "event", "payment", "business_update", "promotion", "greeting", "forward", "spam", "scam", "unknown")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many rows; null is a key like any other."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error that names a key of several rows."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"repeated key {bad[0].asDict()}")
    return df


def duplicates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of their key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def dangling(child: DataFrame, parent: DataFrame, name: str, key: str, parent_key: str | None = None) -> DataFrame:
    """One row: references of ``child`` to keys that ``parent`` lacks, and how many keys those are."""
    refs = child.select(F.col(key).alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    left = refs.join(parent.select(F.col(parent_key or key).alias("k")).distinct(), "k", "left_anti")
    return left.agg(F.lit(name).alias("check_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def parse_ids(c: Column | str) -> Column:
    """The distinct ids of an evidence list in order; none for ``none``, nothing or null."""
    text = F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    return F.array_distinct(F.filter(F.split(text, SEPARATORS), lambda x: (x != "") & (x != "none")))


def serialize_ids(c: Column | str) -> Column:
    """The canonical list: ids parted by semicolons, or ``none``."""
    a = F.array_distinct(F.col(c) if isinstance(c, str) else c)
    return F.when(F.size(a) > 0, F.array_join(a, ";")).otherwise(F.lit("none"))


def output_violations(out: DataFrame) -> DataFrame:
    """``message_id`` and ``rule`` for every broken rule of the output's columns."""
    once = out.groupBy("message_id").agg(F.count("*").alias("n")).where("n > 1").select("message_id", F.lit("repeated_message").alias("rule"))
    text = F.coalesce("evidence_message_ids", F.lit(""))
    rules = [
        ("action_domain", ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))),
        ("type_domain", ~F.coalesce(F.col("message_type").isin(*MESSAGE_TYPES), F.lit(False))),
        ("reason_missing", F.trim(F.coalesce("reason", F.lit(""))) == ""),
        ("confidence_range", ~F.coalesce(F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), F.lit(False))),
        ("confidence_digits", F.coalesce(F.col("confidence") != F.format_string("%.9e", F.col("confidence")).try_cast("double"), F.lit(False))),  # more than ten
        ("evidence_not_canonical", text != serialize_ids(parse_ids("evidence_message_ids"))),
    ]
    named = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return out.select("message_id", F.explode(named).alias("rule")).unionByName(once).distinct()


def evidence_violations(out: DataFrame, messages: DataFrame) -> DataFrame:
    """``message_id``, ``evidence_id`` and ``rule``: evidence must exist, be the same user's and strictly earlier."""
    m = messages.select(F.col("message_id").alias("evidence_id"), F.col("user_id").alias("e_user"), F.col("created_at").alias("e_at"))
    e = out.select("message_id", F.explode(parse_ids("evidence_message_ids")).alias("evidence_id")).distinct()
    e = e.join(messages.select("message_id", "user_id", "created_at"), "message_id", "left").join(m, "evidence_id", "left")
    rule = F.when(F.col("e_user").isNull(), "missing").when(~F.coalesce(F.col("e_user") == F.col("user_id"), F.lit(False)), "other_user").when(~F.coalesce(F.col("e_at") < F.col("created_at"), F.lit(False)), "not_earlier")
    return e.withColumn("rule", rule).where("rule is not null").select("message_id", "evidence_id", "rule")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys only one side has, and which."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right_only")))
