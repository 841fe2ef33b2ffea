"""Enrichment by an outside client: each distinct content once, in batches, remembered between runs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A client: contents in, one JSON text or error per content out.
Client = Callable[[list[str]], list[str]]


def distinct_contents(df: DataFrame, content: str) -> DataFrame:
    """Each non-empty content once, with its SHA-256 as ``digest`` and how many rows have it."""
    c = df.where(F.col(content).isNotNull() & (F.col(content) != "")).select(F.sha2(F.col(content), 256).alias("digest"), F.col(content).alias("content"))
    return c.groupBy("digest").agg(F.first("content").alias("content"), F.count("*").alias("n_rows"))


# Kinds of failures, by the exceptions a client raises; what else goes wrong is "failed".
FAILURES = {TimeoutError: "timeout", ConnectionError: "unreachable", PermissionError: "refused", BlockingIOError: "rate_limited"}


def failure(e: BaseException) -> str:
    return next((name for kind, name in FAILURES.items() if isinstance(e, kind)), "failed")


def by_index(answers: list, n: int) -> list[str] | None:
    """Answers in the order of their questions; None unless every question has exactly one.

    Plain texts stand for the questions in order. JSON objects with an ``index`` may come in any order.
    """
    if len(answers) != n:
        return None
    at = []
    for a in answers:
        try:
            x = a if isinstance(a, dict) else json.loads(a)
        except (TypeError, ValueError):
            x = None
        at.append(x.get("index") if isinstance(x, dict) else None)
    text = [json.dumps({k: v for k, v in a.items() if k != "index"}) if isinstance(a, dict) else a for a in answers]
    if all(i is None for i in at):
        return text
    if any(not isinstance(i, int) or isinstance(i, bool) for i in at) or sorted(at) != list(range(n)):
        return None
    return [x for _, x in sorted(zip(at, text), key=lambda p: p[0])]


def ask(contents: DataFrame, make_client: Callable[[], Client], batch: int = 8, tries: int = 3, sleep: Callable[[float], None] = time.sleep, wait: float = 0.0) -> DataFrame:
    """``digest``, ``facts`` (JSON text), ``error`` and ``attempts`` of each distinct content.

    The client is made once per task, where it runs; a failed batch is asked again, after ``wait``
    seconds, twice as many each time, by ``sleep``, then item by item, so one bad content spoils no
    other. Errors are those of ``FAILURES``, ``failed``, ``mismatched`` (not one answer per question)
    and ``malformed`` (no JSON object).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def attempt(texts: list[str]) -> tuple[list[str] | None, str, int]:
            why = "failed"
            for k in range(tries):
                if k and wait:
                    sleep(wait * 2 ** (k - 1))
                try:
                    got = by_index(list(client(texts)), len(texts))
                    if got is not None:
                        return got, "", k + 1
                    why = "mismatched"
                except Exception as e:  # noqa: BLE001 - any failure of the outside is tried again
                    why = failure(e)
            return None, why, tries

        for p in parts:
            rows = []
            texts = p["content"].tolist()
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                got, _, n = attempt(part)
                each = [(g, "", n) for g in got] if got is not None else [((x[0] if x else None), why, n + m) for t in part for x, why, m in [attempt([t])]]
                for g, why, m in each:
                    try:
                        ok = isinstance(json.loads(g), dict)
                    except (TypeError, ValueError):
                        ok = False
                    rows.append((g if ok else None, None if ok else why or "malformed", m))
            yield pd.DataFrame({"digest": p["digest"], "facts": [r[0] for r in rows], "error": [r[1] for r in rows], "attempts": [r[2] for r in rows]})

    return contents.select("digest", "content").mapInPandas(run, "digest string, facts string, error string, attempts int")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, on whichever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def enrich(df: DataFrame, content: str, make_client: Callable[[], Client], cache: str | None = None, batch: int = 8) -> DataFrame:
    """``df`` with ``facts`` and ``error``; with a ``cache`` folder only contents new to it are asked.

    Answers and errors are kept in the cache as Parquet. A later run asks again for what failed;
    of several rows of a content its answer holds, else its last error.
    """
    spark = df.sparkSession
    todo = distinct_contents(df, content)
    if cache:
        if exists(spark, cache):
            todo = todo.join(spark.read.parquet(cache).where("facts is not null").select("digest"), "digest", "left_anti")
        ask(todo, make_client, batch).withColumn("asked_at", F.current_timestamp()).write.mode("append").parquet(cache)
        best = F.max(F.struct(F.col("facts").isNotNull().alias("ok"), "asked_at", "facts", "error")).alias("x")
        new = spark.read.parquet(cache).groupBy("digest").agg(best).select("digest", "x.facts", "x.error")
    else:
        new = ask(todo, make_client, batch).select("digest", "facts", "error")
    return df.withColumn("__d", F.sha2(F.col(content), 256)).join(new.withColumnRenamed("digest", "__d"), "__d", "left").drop("__d")


def failure_counts(asked: DataFrame) -> DataFrame:
    return asked.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


def report(asked: DataFrame) -> DataFrame:
    """One row: contents asked, answered, failed and tried more than once, attempts in all, and the failures by kind."""
    kinds = [*FAILURES.values(), "failed", "mismatched", "malformed"]
    return asked.agg(
        F.count("*").alias("n_contents"), F.count_if(F.col("facts").isNotNull()).alias("n_answered"), F.count_if(F.col("facts").isNull()).alias("n_failed"), F.count_if(F.col("attempts") > 1).alias("n_repeated"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("n_attempts"), *[F.count_if(F.col("error") == k).alias(k) for k in kinds],
    )
