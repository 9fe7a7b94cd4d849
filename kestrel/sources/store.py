"""Versioned tables: one folder per version, published by a log entry that only one writer can create.

``root/<name>/_log/<n>`` names the folder of version n.  A writer fills a
folder nobody reads yet and then creates the next entry, which fails where
another writer was first; the largest entry is the current version.  A failure
before that leaves the old version in place, and a repeated run starts from
it.  Tables that belong to a version (a search index, say) lie in its folder,
under names that Spark passes over when it reads the rows.

An error while the log is read is an error, never "there is no table".
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOG = "_log"


class Conflict(RuntimeError):
    """Another writer has published a version since this one read its base."""


def _file_system(spark: SparkSession, where: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, where: str) -> list[str]:
    path, fs = _file_system(spark, where)
    at = path(where)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def tables_in(spark: SparkSession, root: str) -> list[str]:
    """Names below a root that hold a versioned table, on whatever file system the root lies."""
    return [n for n in _children(spark, root) if LOG in _children(spark, f"{root.rstrip('/')}/{n}")]


class VersionedTable:
    """A table below ``root/<name>``; works on any file system Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark = spark
        self.base = f"{root.rstrip('/')}/{name}"

    # -- versions -------------------------------------------------------
    def versions(self) -> list[int]:
        return sorted(int(n) for n in _children(self.spark, f"{self.base}/{LOG}") if n.isdigit())

    def version(self) -> int | None:
        """The published version; None where none was ever published."""
        known = self.versions()
        return known[-1] if known else None

    def path(self, version: int) -> str:
        """The folder of a published version, as its log entry names it."""
        path, fs = _file_system(self.spark, self.base)
        stream = fs.open(path(f"{self.base}/{LOG}/{version}"))
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()
        if not name.startswith("v="):
            raise ValueError(f"unreadable log entry {version} of {self.base}")
        return f"{self.base}/{name}"

    def read(self, version: int | None = None) -> DataFrame | None:
        v = self.version() if version is None else version
        return None if v is None else self.spark.read.parquet(self.path(v))

    def side(self, name: str, version: int) -> DataFrame | None:
        """A table that was published with a version; None where it has none of that name."""
        where = f"{self.path(version)}/_{name}"
        path, fs = _file_system(self.spark, where)
        return self.spark.read.parquet(where) if fs.exists(path(where)) else None

    # -- publication ----------------------------------------------------
    def publish(
        self, df: DataFrame, base: int | None = None, side: dict[str, Callable[[DataFrame], DataFrame]] | None = None, fail_before_swap: Callable[[], None] | None = None,
    ) -> int:
        """Write df, and the tables made from what was written, as the version after ``base`` (the current one by default)."""
        base = (self.version() or 0) if base is None else base
        name = f"v={base + 1}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.base}/{name}")
        for key, make in (side or {}).items():
            make(self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")).write.parquet(f"{self.base}/{name}/_{key}")
        if fail_before_swap:
            fail_before_swap()
        return self._enter(base + 1, name)

    def republish(self, version: int) -> int:
        """The same rows under the next number: nothing has changed, nothing is written again."""
        return self._enter(version + 1, self.path(version).rsplit("/", 1)[1])

    def _enter(self, version: int, folder: str) -> int:
        path, fs = _file_system(self.spark, self.base)
        log = f"{self.base}/{LOG}"
        fs.mkdirs(path(log))
        tmp, dst = path(f"{log}/.{uuid.uuid4().hex}"), path(f"{log}/{version}")
        out = fs.create(tmp, False)
        out.write(folder.encode())
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.NONE  # fails where the entry exists
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, dst, how)
        except Exception as e:
            fs.delete(tmp, False)
            if fs.exists(dst):
                raise Conflict(f"version {version} of {self.base} was published by another writer") from e
            raise
        return version

    def drop_old(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` versions, and what failed runs up to the published version left behind."""
        path, fs = _file_system(self.spark, self.base)
        known = self.versions()
        for v in known[:-keep]:
            fs.delete(path(f"{self.base}/{LOG}/{v}"), False)
        used = {self.path(v).rsplit("/", 1)[1] for v in known[-keep:]}
        for n in _children(self.spark, self.base):
            if n.startswith("v=") and n not in used and known and int(n[2:].split("-")[0]) <= known[-1]:
                fs.delete(path(f"{self.base}/{n}"), True)
