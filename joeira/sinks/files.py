"""Folders and small files in whatever store the paths name, changed so that a failure leaves the former state.

All names that are not yet, or no longer, part of a result begin with ``_``,
which Spark's readers pass over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Store:
    """The file system that a path is in."""

    def __init__(self, spark: SparkSession, path: str):
        self.gateway = spark.sparkContext._gateway
        self.jvm = self.gateway.jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def matches(self, pattern: str) -> list[str]:
        """The paths, without scheme, that a pattern stands for."""
        return sorted(s.getPath().toUri().getPath() for s in self.fs.globStatus(self.at(pattern)) or [])

    def qualified(self, path: str) -> str:
        """``path`` without scheme, as ``matches`` gives it."""
        return self.fs.makeQualified(self.at(path)).toUri().getPath()

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{old!r} could not be renamed to {new!r}")

    def read(self, path: str) -> str | None:
        """A small text file, or None if there is none."""
        if not self.exists(path):
            return None
        stream = self.fs.open(self.at(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def swap_file(self, path: str, text: str) -> None:
        """Put ``text`` in the place of a file in one step: a reader sees the old or the new one whole."""
        staged = f"{path}.{uuid.uuid4().hex}"
        out = self.fs.create(self.at(staged), True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.at(staged), self.at(path), options)


def _names(path: str) -> tuple[str, str]:
    folder, _, name = path.rstrip("/").rpartition("/")
    return (f"{folder}/" if folder or path.startswith("/") else ""), name


def restore(spark: SparkSession, path: str) -> None:
    """Bring back the former table where a run was cut off between the two renames of ``replace``."""
    store = Store(spark, path)
    folder, name = _names(path)
    if not store.exists(path):
        for old in store.matches(f"{folder}_{name}.former-*"):
            store.rename(old, path)
            return


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a folder beside ``path``, and only when it is whole put it in the place of the former one.

    A ``write`` that fails leaves the former table as it is.  The former one is moved aside, not deleted, until the new one is in place.
    """
    restore(spark, path)
    store = Store(spark, path)
    folder, name = _names(path)
    run = uuid.uuid4().hex
    staged, former = f"{folder}_{name}.staged-{run}", f"{folder}_{name}.former-{run}"
    try:
        write(staged)
        had = store.exists(path)
        if had:
            store.rename(path, former)
        try:
            store.rename(staged, path)
        except BaseException:
            if had:
                store.rename(former, path)
            raise
    except BaseException:
        store.delete(staged)
        raise
    for old in store.matches(f"{folder}_{name}.former-*"):
        store.delete(old)
    return path
