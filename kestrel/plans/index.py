"""Indexing a repository: list, filter, hash, reuse, chunk, embed, publish a new version."""

from __future__ import annotations

import os
import subprocess
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators import chunking, embedding
from kestrel.operators import files as FL
from kestrel.operators import retrieval as R
from kestrel.operators.changes import changed, state_of, unchanged, without_output
from kestrel.session import materialized, release, ship_package, text_batches
from kestrel.sources.store import VersionedTable

INDEX_SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in (
        ("row_id", T.LongType()), ("path", T.StringType()), ("language", T.StringType()), ("kind", T.StringType()), ("name", T.StringType()),
        ("start_line", T.IntegerType()), ("end_line", T.IntegerType()), ("text", T.StringType()), ("parent", T.StringType()),
        ("vector", T.ArrayType(T.FloatType(), False)), ("file_hash", T.StringType()))]
)


def git_files(root: str) -> list[str] | None:
    """Tracked and untracked, not ignored files; None where git can't say."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return None
    return [p.decode("utf-8", "surrogateescape") for p in out.split(b"\0") if p]


def source_listing(root: str) -> list[str]:
    """Paths of a repository: what git lists, else what a walk finds (only the walk prunes directories)."""
    listed = git_files(root)
    return FL.walk_files(root) if listed is None else [p for p in listed if os.path.isfile(os.path.join(root, p))]


def _hashed(files: DataFrame, embedder: embedding.Embedder) -> DataFrame:
    return files.withColumn("file_hash", FL.file_hash(F.col("text"), FL.embed_tag(embedder)))


def _chunks(files: DataFrame) -> DataFrame:
    """Chunks of (path, text, file_hash), blank ones left out."""
    rows = chunking.chunk_files(files.select(F.xxhash64("path").alias("file_id"), F.lit("").alias("repo"), "path", "text"))
    return rows.join(files.select("path", "file_hash"), "path").drop("file_id", "repo")


class Indexed(NamedTuple):
    """What an index run did: chunks in the index, files carried over, files cut anew (those that gave a chunk)."""

    chunks: int
    reused_files: int
    changed_files: int


def update_index(spark: SparkSession, root: str, repo: str | None = None, embedder: embedding.Embedder | None = None, store: str = "store") -> Indexed:
    """Bring a repository's index up to date.

    Files whose hash is unchanged keep their rows and row numbers, only the
    others are read again, cut and embedded; files that are gone drop out.
    Files that gave no chunk are kept as known, so they aren't cut again either.
    A repository without any chunk leaves the old version as it is; one without
    any change gets its next version without writing anything again.
    """
    ship_package(spark)
    text_batches(spark)
    embedder = embedder or embedding.make_embedder()
    table = VersionedTable(spark, store, repo or os.path.basename(os.path.abspath(root)))
    base = table.version()
    listed = source_listing(root)
    seen = _hashed(FL.read_files(spark, root, listed), embedder).select("path", "file_hash").persist()  # no texts
    try:
        old = table.read(base) if base else spark.createDataFrame([], INDEX_SCHEMA)
        known = state_of(table, base, ["path"], "file_hash") if base else old.select("path", "file_hash")
        todo = [r.path for r in changed(seen, known, ["path"]).select("path").toLocalIterator()]  # names only, as many as were listed on the driver
        n_known = known.distinct().count()
        if base and not todo and n_known == seen.count():
            n = old.count()
            table.republish(base)
            return Indexed(n, old.select("path").distinct().count(), 0)
        files = _hashed(FL.read_files(spark, root, todo), embedder).persist()
        try:
            new = embedding.embed_column(_chunks(files), embedder)
            first = (old.agg(F.max("row_id")).first()[0] or 0) + 1 if base else 0
            # reused rows come first, in their old order; the order of rows breaks ties in searches
            fresh = new.orderBy("path", "start_line", "end_line", "kind").withColumn("row_id", F.monotonically_increasing_id() + F.lit(first))
            names = [f.name for f in INDEX_SCHEMA.fields]
            kept = unchanged(old, seen, ["path"]).select(*names)
            listing = seen.unionByName(files.select("path", "file_hash")).distinct()
            rows = materialized(kept.unionByName(fresh.select(*names)), "index")
            per = rows.groupBy("path").agg(F.count("*").alias("n")).join(spark.createDataFrame([(p,) for p in todo], "path string").withColumn("cut", F.lit(True)), "path", "left")
            n, n_files, n_cut = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count("cut")).first()
            if n:
                table.publish(rows, base or 0, {"empty": lambda w: without_output(listing, w, ["path"], "file_hash"), **R.search_tables()})
            release(rows)
            return Indexed(n, n_files - n_cut, n_cut)
        finally:
            files.unpersist()
    finally:
        seen.unpersist()


def index_repo(spark: SparkSession, root: str, repo: str | None = None, embedder: embedding.Embedder | None = None, store: str = "store") -> int:
    """update_index, for its number of chunks."""
    return update_index(spark, root, repo, embedder, store).chunks
