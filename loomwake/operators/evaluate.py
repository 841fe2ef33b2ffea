"""Metrics of predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwake.operators import quality


def unmatched(labels: DataFrame, predictions: DataFrame, key: str = "message_id") -> DataFrame:
    """Keys that only the labels or only the predictions have: ``key`` and ``side``."""
    return quality.key_difference(labels, predictions, key).withColumn("side", F.when(F.col("side") == "left_only", "label_only").otherwise("prediction_only"))


def graded(labels: DataFrame, predictions: DataFrame, key: str = "message_id", strict: bool = True) -> DataFrame:
    """Predictions beside their labels, which come out as ``gold_`` columns.

    ``strict`` raises if either side has a key that the other lacks, or a key twice.
    """
    if strict:
        bad = unmatched(labels, predictions, key).limit(1).collect()
        if bad:
            raise ValueError(f"labels and predictions differ: {bad[0].asDict()}")
        labels, predictions = quality.require_unique(labels, [key]), quality.require_unique(predictions, [key])
    return predictions.join(labels.select(key, *[F.col(c).alias(f"gold_{c}") for c in labels.columns if c != key]), key)


def accuracy(p: DataFrame) -> DataFrame:
    """Accuracy of action, type and both. ``p`` has ``gold_`` and plain ``action`` and ``message_type``."""
    a, t = F.col("gold_action") == F.col("action"), F.col("gold_message_type") == F.col("message_type")
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return p.agg(F.count("*").alias("n"), rate(a).alias("action_accuracy"), rate(t).alias("type_accuracy"), rate(a & t).alias("joint_accuracy"))


def confusion(p: DataFrame, gold: str, predicted: str) -> DataFrame:
    return p.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def evidence_metrics(p: DataFrame) -> DataFrame:
    """Exact rate, mean Jaccard (1 for two empty lists) and micro precision, recall and F1 of ``evidence`` against ``gold_evidence``.

    Without any predicted or any labelled id the respective rate is 1 if the other side has none either, else 0.
    """
    both, every = F.size(F.array_intersect("evidence", "gold_evidence")), F.size(F.array_union("evidence", "gold_evidence"))
    s = p.select(both.alias("b"), every.alias("u"), F.size(F.array_distinct("evidence")).alias("p"), F.size(F.array_distinct("gold_evidence")).alias("g"))
    s = s.agg(F.count("*").alias("n"), F.avg((F.col("b") == F.col("u")).cast("int")).alias("exact_rate"), F.avg(F.when(F.col("u") == 0, 1.0).otherwise(F.col("b") / F.col("u"))).alias("mean_jaccard"), F.sum("b").alias("b"), F.sum("p").alias("p"), F.sum("g").alias("g"))
    precision = F.when(F.col("p") > 0, F.col("b") / F.col("p")).otherwise(F.when(F.col("g") == 0, 1.0).otherwise(0.0))
    recall = F.when(F.col("g") > 0, F.col("b") / F.col("g")).otherwise(F.when(F.col("p") == 0, 1.0).otherwise(0.0))
    s = s.withColumns({"precision": precision, "recall": recall})
    return s.select("n", "exact_rate", "mean_jaccard", "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"))


def _bin(confidence: str, bins: int):
    return F.size(F.filter(F.array(*[F.lit(i / bins) for i in range(1, bins)]), lambda edge: F.col(confidence) >= edge))


def calibration_bins(p: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Per bin of confidence: rows, mean confidence and share correct; 1 lies in the last bin.

    Bins are told by comparing with ``i / bins`` as doubles, as the edges are written.
    """
    return p.withColumn("bin", _bin(confidence, bins)).groupBy("bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("int")).alias("share_correct"))


def calibration(p: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error, both from sums per bin."""
    hit = F.col(correct).cast("int")
    b = p.withColumn("bin", _bin(confidence, bins)).groupBy("bin").agg(F.count("*").alias("n"), F.sum(confidence).alias("c"), F.sum(hit).alias("h"), F.sum((F.col(confidence) - hit) ** 2).alias("s"))
    return b.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"))
