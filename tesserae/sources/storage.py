"""Intermediate tables in the folder that all executors share, and the result sink."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


class _Made(threading.local):
    """The stored copies of a thread; queries that run side by side don't see each other's."""

    def __init__(self):
        self.paths: list[str] = []
        _ALL.append(self.paths)


_ALL: list[list[str]] = []
_MADE = _Made()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it names none, a temporary folder is set if the master is local
    (tests on one machine); on a cluster that raises, as executors would not
    see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """A copy of ``df`` in the shared folder; cuts the lineage and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; it goes when stored copies do."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.paths.append(path)
    return path


def written(df: DataFrame, name: str, kind: str = "json") -> str:
    """The folder of a copy of ``df`` in a format of its own."""
    path = new_folder(df.sparkSession, name)
    df.write.format(kind).save(path)
    return path


def made() -> list[str]:
    """The folders of the stored copies of this thread so far."""
    return list(_MADE.paths)


def release_since(begun: list[str], *keep: str) -> None:
    """Remove this thread's copies stored after ``begun``, but for those in ``keep``; nothing may read them again."""
    held = {*begun, *keep}
    release([p for p in made() if p not in held])


def release(paths: list[str]) -> None:
    """Remove stored copies that nothing will read again."""
    for path in paths:
        with suppress(OSError, ValueError):  # a copy that can't be removed is only left over
            store, at = filesystem(path)
            store.delete_dir(at)
        if path in _MADE.paths:
            _MADE.paths.remove(path)


@atexit.register
def _release_all() -> None:
    release([path for paths in _ALL for path in paths])


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def sink(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write a result as Parquet or JSON, in a folder for each value of ``by``."""
    w = df.write.mode(mode).format(kind)
    (w.partitionBy(*by) if by else w).save(path)
