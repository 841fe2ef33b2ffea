"""Session helpers: table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_SHIPPED: dict[str, bool] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session that runs on this machine alone (``local``, as in tests) gets a temporary one;
    on a cluster that names none it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomwake-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it by ``PYTHONPATH`` or the working folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    there = [os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if root in there or _SHIPPED.get(sc.applicationId):
        return
    folder = tempfile.mkdtemp(prefix="loomwake-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "loomwake"), "zip", root, "loomwake"))
    _SHIPPED[sc.applicationId] = True


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table replaces the lineage: later jobs read compressed, column-pruned
    Parquet instead of running the plan again, and a lost executor loses nothing. It lasts until
    ``release``, or until the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomwake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_release_at_exit, spark)
    _WRITTEN.append(path)
    out = spark.read.parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote for ``df``, which nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Delete the tables ``cut`` wrote in this process; call it when their readers are done."""
    n = 0
    while _WRITTEN:
        n += _delete(spark, _WRITTEN.pop())
    return n


@contextmanager
def cuts_released(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, the tables that ``cut`` wrote inside this block."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            _WRITTEN.remove(path)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True))


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001 - the session has ended; local folders can still be emptied
        for path in _WRITTEN:
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def parallelism(spark: SparkSession) -> int:
    """Tasks the session can run at once, at least its number of shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
