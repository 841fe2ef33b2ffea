"""CSV tables with declared schemas: read strictly, write in order and atomically."""

from __future__ import annotations

import csv
import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwake.functions.text import boolean, clean, count_number
from loomwake.operators import quality

#: Most bytes and rows of one CSV file; a larger one is an error.
MOST_BYTES, MOST_ROWS = 128 << 20, 2_000_000

# The input tables, column by column. id: required, text: never null, int: at least 0, int?: may be null.
TABLES = {
    "messages": "message_id id, user_id id, conversation_type text, group_id id?, business_id id?, sender_user_id id?, created_at time, message_text text, media_type text, media_id id?, forwarded_count int",
    "users": "user_id id, do_not_disturb_window id?, messages_opened_30d int, messages_replied_30d int, notifications_dismissed_30d int, messages_reported_30d int",
    "groups": "group_id id, group_name text, group_type text, member_count int, admin_count int, created_at time, messages_30d int",
    "group_members": "group_id id, user_id id, role text, joined_at time, messages_sent_30d int, messages_read_30d int, replies_sent_30d int, notifications_dismissed_30d int, group_muted_by_user bool",
    "business_accounts": "business_id id, display_name text, brand_name text, category text, verified bool, official_domain id?, domain_used_by_sender id?, account_age_days int, messages_sent_30d int, user_reports_30d int, domain_used_by_sender_age_days int",
    "user_business_history": "user_id id, business_id id, why_user_knows_account text, last_activity_at time, allows_promotions bool, promotions_opted_out_at time, activity_count_180d int, messages_opened_30d int, messages_dismissed_30d int, messages_replied_30d int, last_reply_at time",
    "message_events": "user_id id, message_id id, message_opened bool, message_replied bool, reaction_time_minutes int?, notification_dismissed bool, muted_after_message bool, message_reported bool",
    "daily_notification_summary": "user_id id, date date, notifications_sent int, notifications_dismissed int",
    "images": "image_id id, file_path text",
    "voice_notes": "voice_note_id id, file_path text",
    "output": "message_id id, action text, message_type text, reason text, confidence float, evidence_message_ids text",
}
TABLES["message_history"] = TABLES["messages"]
TABLES["sample_messages"] = TABLES["messages"] + ", action text, message_type text, reason text, confidence float, evidence_message_ids text"
OPTIONAL = {"message_history", "sample_messages", "images", "voice_notes"}


def columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in TABLES[name].split(", ")]


def _typed(c: str, kind: str):
    text = clean(c)
    some = F.nullif(text, F.lit(""))
    if kind in ("id", "id?"):
        return some
    if kind == "text":
        return text
    if kind == "bool":
        return boolean(text)
    if kind == "int":
        return count_number(text)
    if kind == "int?":
        return some.try_cast("int")
    if kind == "float":
        return some.try_cast("double")
    if kind == "date":
        return some.try_cast("date")
    return some.try_cast("timestamp")


def _status(spark: SparkSession, path: str):
    """The file's status on whichever file system its path names, or None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return fs.getFileLinkStatus(p) if fs.supportsSymlinks() else fs.getFileStatus(p)


def _read(spark: SparkSession):
    return spark.read.option("multiLine", True).option("escape", '"').option("enforceSchema", True)


def read_table(spark: SparkSession, path: str, name: str, position: str | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """A typed table. Raises on missing or repeated columns, surplus fields, empty ids, malformed values, and files too large or with too many rows.

    Extra columns are tolerated and dropped. A missing optional table is empty. The path may lie on
    any file system. ``position`` names a column for the rows' order in the file (a file with
    quoted line breaks is read by one task, from its beginning), by which results can be put back in order.
    """
    want = columns(name)
    status = _status(spark, path)
    if status is None:
        if name in OPTIONAL:
            blank = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c, _ in want]))
            return blank.select(*[_typed(c, k).alias(c) for c, k in want], *([F.lit(0).cast("long").alias(position)] if position else []))
        raise FileNotFoundError(path)
    if status.isSymlink() or os.path.islink(path.removeprefix("file:")) or status.getLen() > MOST_BYTES:
        raise ValueError(f"{name}: a link or too large")
    first = _read(spark).option("header", False).csv(path).head(1)
    header = [h or "" for h in first[0]] if first else []
    if len(set(header)) != len(header) or not {c for c, _ in want} <= set(header):
        raise ValueError(f"{name}: header {header}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = _read(spark).schema(schema).option("header", True).option("mode", "FAILFAST").csv(path).withColumn("__at", F.monotonically_increasing_id())
    typed = raw.select("__at", *[_typed(c, k).alias(c) for c, k in want], *[F.nullif(clean(c), F.lit("")).alias(f"__raw_{c}") for c, _ in want])
    bad = F.col("__at") >= most_rows
    for c, k in want:
        if k == "id":
            bad = bad | F.col(c).isNull() | (F.length(c) > 512)
        elif k != "text":
            bad = bad | (F.col(f"__raw_{c}").isNotNull() & F.col(c).isNull())
    key, *rest = (c for c, _ in want)
    error = F.raise_error(F.concat(F.lit(f"{name}: malformed row, or too many, first id "), F.coalesce(F.col(key).cast("string"), F.lit("missing"))))
    return typed.select(F.when(bad, error).otherwise(F.col(key)).alias(key), *rest, *([F.col("__at").alias(position)] if position else []))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled messages: read like any table, and raises if there are none, an id is repeated or a label is outside its domain."""
    rows = quality.require_unique(read_table(spark, path, "sample_messages"), ["message_id"])
    bad = rows.where(~F.coalesce(F.col("action").isin(*quality.ACTIONS) & F.col("message_type").isin(*quality.MESSAGE_TYPES), F.lit(False))).select("message_id").limit(1).collect()
    if bad:
        raise ValueError(f"label outside its domain: {bad[0].message_id}")
    if not rows.limit(1).collect():
        raise ValueError("no labelled rows")
    return rows


def load_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every declared table of a folder, and media_files of images and voice notes with their type."""
    out = {n: read_table(spark, f"{folder}/{n}.csv", n) for n in TABLES if n != "output"}
    images = out["images"].select(F.lit("image").alias("media_type"), F.col("image_id").alias("media_id"), "file_path")
    voice = out["voice_notes"].select(F.lit("voice").alias("media_type"), F.col("voice_note_id").alias("media_id"), "file_path")
    return out | {"media_files": images.unionByName(voice)}


def write_ordered(df: DataFrame, path: str, names: list[str], order: str) -> int:
    """One CSV file in the order of ``order``, put in place only when complete; returns its rows.

    Rows stream through the driver partition by partition, so its memory doesn't grow with them.
    """
    folder = os.path.dirname(os.path.abspath(path))
    fd, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    n = 0
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(names)
            for r in df.orderBy(order).select(*names).toLocalIterator():
                w.writerow(["" if v is None else format(v, ".10g") if isinstance(v, float) else v for v in r])
                n += 1
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return n


def write_report(report: dict, path: str) -> None:
    """A JSON report with sorted keys, put in place only when complete."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(report, f, sort_keys=True, indent=2, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def validate_output_file(spark: SparkSession, path: str, messages: DataFrame, history: DataFrame) -> DataFrame:
    """Read an output file back: ``message_id`` and ``rule`` for all it breaks; its header must be exact."""
    names = [c for c, _ in columns("output")]
    with open(path, encoding="utf-8", newline="") as f:
        if next(csv.reader(f), []) != names:
            raise ValueError("header or its order")
    out = read_table(spark, path, "output")
    seen = messages.unionByName(history, allowMissingColumns=True)
    both = quality.evidence_violations(out, seen).select("message_id", F.concat(F.lit("evidence_"), "rule").alias("rule"))
    sides = quality.key_difference(out, messages, "message_id").select("message_id", F.when(F.col("side") == "left_only", "unknown_message").otherwise("not_routed").alias("rule"))
    return quality.output_violations(out).unionByName(both).unionByName(sides).distinct()
