"""Media files: confined paths, bounded reads, formats by leading bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def safe_path(c: Column | str) -> Column:
    """A relative path without steps upwards, with forward slashes; null otherwise."""
    p = F.replace(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("\\"), F.lit("/"))
    return F.when((p != "") & ~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\x00"), p)


def media_index(files: DataFrame, order: str) -> DataFrame:
    """One row per (media_type, media_id), the first by ``order``; later ones with the same id are ignored."""
    w = Window.partitionBy("media_type", "media_id").orderBy(F.col(order).asc_nulls_last(), "file_path")
    return files.where("media_id is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def read_files(spark: SparkSession, path: str, most: int = 32 << 20) -> DataFrame:
    """``path``, ``length``, ``content`` and its SHA-256 of files up to ``most`` bytes; longer ones without content.

    The bound is pushed to the source, and of longer files only name and length are read, so no
    task loads more than ``most`` bytes of a file.
    """
    f = spark.read.format("binaryFile").load(path)
    small = f.where(F.col("length") <= most).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))
    large = f.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"))
    return small.unionByName(large)


def file_audit(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of a folder by format of their leading bytes, and how many contents are distinct."""
    f = spark.read.format("binaryFile").load(path).select("length", sniff(F.hex(F.substring("content", 1, 64)))["format"].alias("format"), F.sha2("content", 256).alias("sha256"))
    return f.groupBy("format").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.countDistinct("sha256").alias("n_contents"))


# Leading bytes, in hexadecimal, and the brands of ISO media files.
_STARTS = [("FFD8FF", "image", "image/jpeg", "jpeg"), ("89504E470D0A1A0A", "image", "image/png", "png")]
_RIFF = [("57454250", "image", "image/webp", "webp"), ("57415645", "voice", "audio/wav", "wav")]
_AVIF, _M4A = ("61766966", "61766973"), ("4D344120", "4D344220", "6D703431", "6D703432", "69736F6D")


def sniff(c: Column | str) -> Column:
    """Struct of kind, MIME type and format of a file by the hexadecimal of its first 64 bytes."""
    h = F.upper(F.col(c) if isinstance(c, str) else c)
    what = lambda kind, mime, name: F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime"), F.lit(name).alias("format"))
    n = F.length(h) / 2
    four = lambda at: F.substring(h, at * 2 + 1, 8)
    brands = F.array(*[F.when(n >= at + 4, four(at)) for at in range(8, 64, 4)])
    any_of = lambda names: F.arrays_overlap(brands, F.array(*map(F.lit, names)))
    byte = lambda at: F.conv(F.substring(h, at * 2 + 1, 2), 16, 10).cast("int")
    b1, b2 = byte(1), byte(2)
    bits = lambda b, shift, mask: F.shiftright(b, shift).bitwiseAND(F.lit(mask))
    frame = (n >= 3) & (F.substring(h, 1, 2) == "FF") & (b1.bitwiseAND(F.lit(0xE0)) == 0xE0) & (bits(b1, 3, 3) != 1) & (bits(b1, 1, 3) != 0) & ~bits(b2, 4, 15).isin(0, 15) & (bits(b2, 2, 3) != 3)
    out = None
    for start, *rest in _STARTS:
        out = F.when(F.startswith(h, F.lit(start)), what(*rest)) if out is None else out.when(F.startswith(h, F.lit(start)), what(*rest))
    for brand, *rest in _RIFF:
        out = out.when((n >= 12) & (four(0) == "52494646") & (four(8) == brand), what(*rest))
    iso = (n >= 16) & (four(4) == "66747970")
    out = out.when(iso & F.coalesce(any_of(_AVIF), F.lit(False)), what("image", "image/avif", "avif")).when(iso & F.coalesce(any_of(_M4A), F.lit(False)), what("voice", "audio/mp4", "m4a"))
    return out.when(F.startswith(h, F.lit("494433")) | F.coalesce(frame, F.lit(False)), what("voice", "audio/mpeg", "mp3")).otherwise(what("unknown", "", ""))


def data_url(content: Column | str, mime: Column | str) -> Column:
    """``data:`` URL of binary content, for image and audio types only."""
    m = F.col(mime) if isinstance(mime, str) else mime
    return F.when(m.rlike(r"^(image|audio)/[a-z0-9.+-]+$"), F.concat(F.lit("data:"), m, F.lit(";base64,"), F.base64(F.col(content) if isinstance(content, str) else content)))
