"""What the operators share: the shared folder, stored tables, byte files."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TASK_BYTES = 1 << 25


class _Made(threading.local):
    """The stored copies of a thread; queries that run side by side don't see each other's."""

    def __init__(self):
        self.paths: list[str] = []
        _ALL.append(self.paths)


_ALL: list[list[str]] = []
_MADE = _Made()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and set as the
    checkpoint folder if the master is local (tests on one machine); on a
    cluster that raises, as executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    This cuts the lineage; the copy outlives lost executors. ``made`` and
    ``release`` remove copies that are no longer wanted; what is left goes when
    the program ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    _MADE.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The folders of the stored copies of this thread so far."""
    return list(_MADE.paths)


def release(paths: list[str]) -> None:
    """Remove stored copies that nothing will read again."""
    for path in paths:
        with suppress(OSError, ValueError):  # a copy that can't be removed is only left over
            store, at = filesystem(path)
            store.delete_dir(at)
        if path in _MADE.paths:
            _MADE.paths.remove(path)


def release_since(begun: list[str], *keep: str) -> None:
    """Remove the stored copies made after ``begun``, but for those in ``keep``."""
    held = {*begun, *keep}
    release([p for p in made() if p not in held])


@atexit.register
def _release_all() -> None:
    release([path for paths in _ALL for path in paths])


def dealt(rows: DataFrame, file: str, place: str, size: Column, each: int = TASK_BYTES) -> DataFrame:
    """``rows`` in tasks of about ``each`` bytes of payload, in the order of (file, place).

    The bytes before a row are those of earlier files, from a table with a row
    a file, and those of its file's earlier rows. Tasks are cut by these bytes,
    so none has more than a task's share and one row. Small inputs are cut
    finer, into as many tasks as shuffles have, down to a sixteenth of ``each``.
    """
    spark = rows.sparkSession
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = stored(
        rows.groupBy(file).agg(F.sum(size).alias("_n")).select(file, "_n", before(Window.orderBy(file), "_n").alias("_base")), "files")
    total = files.agg(F.sum("_n")).head()[0] or 0
    tasks = max(1, -(-total // each), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (each // 16))))
    at = F.col("_base") + before(Window.partitionBy(file).orderBy(place), size)
    task = F.least(F.floor(at * tasks / max(1, total)), F.lit(tasks - 1)).cast("int")
    placed = rows.join(files.select(file, "_base"), file).withColumn("_task", task)
    return placed.repartitionById(tasks, "_task").sortWithinPartitions(file, place).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """Write a small file in one go."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def crc32_mod(column: str, n: int):
    """crc32 of an id as decimal text, modulo ``n``; ids that are null give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded_labels(labels: DataFrame, label: str, fold: int, of: int, most: int) -> DataFrame:
    """At most ``most`` labelled rows outside the held-out fold, as (doc_id, y).

    Rows come in the order of a hash of doc_id, so the choice is the same in
    each run. Rows with a null id or label, and repeats of an id, are left out.
    """
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (crc32_mod("doc_id", of) != fold))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
