"""Processing only new or changed records: the target table is the state.

Every output row stores the key and the version (a content hash) of the source
record it was made from; records that gave no row are named in a table that is
published with the rows.  The work of a run is the source anti-joined with both
on key and version; rows of unchanged records are carried over; the new target
version is published with one atomic log entry, so a run that fails anywhere is
simply run again, and of two writers that start from the same version one gets
an error.

Defined results: a null version means the record could not be read, it counts
as not listed; records with a null in their key are left out; repeated rows
count once; when one run's rows of a key disagree, the latest ``scanned_at``
counts, then the latest ``received_at``, then the largest ``scan_id``; hashes
are compared in lower case; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import materialized, scratch_dir
from kestrel.sources.store import VersionedTable


def listed_only(source: DataFrame, keys: list[str], version: str = "file_hash") -> DataFrame:
    """Records that can be told apart: no null in key or version."""
    return source.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, version)]))


def changed(source: DataFrame, state: DataFrame, keys: list[str], version: str = "file_hash") -> DataFrame:
    """Source rows whose key and version are not in the state (left anti join, no broadcast hint: either side may be large)."""
    return listed_only(source, keys, version).join(state.select(*keys, version), [*keys, version], "left_anti")


def unchanged(target: DataFrame, source: DataFrame, keys: list[str], version: str = "file_hash") -> DataFrame:
    """Target rows whose key and version are still in the source."""
    return target.join(source.select(*keys, version), [*keys, version], "left_semi")


def without_output(source: DataFrame, rows: DataFrame, keys: list[str], version: str = "file_hash") -> DataFrame:
    """Key and version of the source records that have no row in the output."""
    return changed(source.select(*keys, version).distinct(), rows, keys, version)


def state_of(table: VersionedTable, version_no: int, keys: list[str], version: str = "file_hash") -> DataFrame:
    """Key and version of all records that a published version was made from, those without rows too."""
    rows, empty = table.read(version_no).select(*keys, version), table.side("empty", version_no)
    return rows if empty is None else rows.unionByName(empty)


def apply_changes(
    table: VersionedTable, source: DataFrame, make: Callable[[DataFrame], DataFrame], keys: list[str], version: str = "file_hash",
    fail_before_swap: Callable[[], None] | None = None, other: DataFrame | None = None, always: bool = False,
) -> int:
    """One run: make output for new and changed records only, carry over the rest, publish.

    ``make`` maps source rows to output rows that keep ``keys`` and ``version``.
    ``other`` names parts of the target that this run says nothing about (one
    row each, by some of the target's columns); their rows stay.  ``always``
    says that ``make`` gives every record a row.  Returns the published version.
    """
    base = table.version()
    old = None if base is None else table.read(base)
    todo = listed_only(source, keys, version) if old is None else changed(source, state_of(table, base, keys, version), keys, version)
    rows = make(todo)
    if old is not None:
        rows = unchanged(old, source, keys, version).unionByName(rows)
        rows = rows if other is None else rows.unionByName(old.join(other, other.columns, "left_semi"))

    def empty(written: DataFrame) -> DataFrame:
        none = without_output(source, written, keys, version)
        before = None if other is None or old is None else table.side("empty", base)
        return none if before is None else none.unionByName(before.join(other, other.columns, "left_semi"))

    return table.publish(rows, base or 0, {} if always else {"empty": empty}, fail_before_swap)


def successful_runs(runs: DataFrame) -> DataFrame:
    """Each successful run of a repository with its place among them (from 1)."""
    w = Window.partitionBy("repo").orderBy("run_no", "run_id")
    return runs.where("status = 'success'").select("run_id", "repo", F.row_number().over(w).alias("seq"))


def listings(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo, seq, run_id, path, file_hash): what each successful run listed."""
    ok = successful_runs(runs.select("run_id", "repo", "run_no", "status").distinct())
    rows = scans.select("run_id", "path", F.lower("file_hash").alias("file_hash"), "scanned_at", "received_at", "scan_id")
    last = rows.where("path is not null").join(ok, "run_id").groupBy("repo", "seq", "run_id", "path").agg(
        F.max(F.struct("scanned_at", "received_at", "scan_id", "file_hash"))["file_hash"].alias("file_hash")
    )
    return last.where("file_hash is not null")


def replay(scans: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings, work): the history of index runs taken through the target table, run by run.

    Round n is the n-th successful run of every repository at once: its listing
    is the source, the target's rows are the state, and the rows a round makes
    carry its run.  A version is published per round; ``work`` is what each
    version holds of its own round, read back from the published versions.
    Scans are read and shuffled once, into one folder per round.
    """
    spark = scans.sparkSession
    ok = successful_runs(runs.select("run_id", "repo", "run_no", "status").distinct())
    listed = materialized(listings(scans, runs), "listings", "seq")
    ok = materialized(ok, "runs")
    rounds = ok.agg(F.max("seq")).first()[0] or 0
    table = VersionedTable(spark, scratch_dir(spark), f"target-{uuid.uuid4().hex}")
    made = []
    for n in range(1, rounds + 1):
        source = listed.where(F.col("seq") == n).select("repo", "path", "file_hash", "run_id", "seq")
        silent = ok.groupBy("repo").agg(F.max("seq").alias("last")).where(F.col("last") < n).select("repo")
        v = apply_changes(table, source, lambda todo: todo, ["repo", "path"], other=silent, always=True)
        made.append(table.read(v).where(F.col("seq") == n).select("run_id", "path"))
    return listed, reduce(DataFrame.unionByName, made) if made else listed.select("run_id", "path").where("false")


def changed_paths(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, path) that each successful run must process."""
    return replay(scans, runs)[1]


def change_counts(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """Per successful run: paths listed, and how many of them were new or changed."""
    listed, work = replay(scans, runs)
    todo = work.groupBy("run_id").agg(F.count("*").alias("n_todo"))
    return (
        listed.groupBy("run_id").agg(F.count("*").alias("n_listed")).join(todo, "run_id", "left")
        .select("run_id", "n_listed", F.coalesce("n_todo", F.lit(0)).alias("n_todo"))
    )


FOUND_SQL = """
WITH ok AS (SELECT run_id, repo, row_number() OVER (PARTITION BY repo ORDER BY run_no, run_id) AS seq FROM (SELECT DISTINCT run_id, repo, run_no, status FROM index_runs) WHERE status = 'success'),
ranked AS (
  SELECT o.repo, o.seq, s.run_id, s.path, lower(s.file_hash) AS file_hash,
         row_number() OVER (PARTITION BY s.run_id, s.path ORDER BY s.scanned_at DESC NULLS LAST, s.received_at DESC NULLS LAST, s.scan_id DESC) AS k
  FROM file_scans s JOIN ok o ON s.run_id = o.run_id WHERE s.path IS NOT NULL),
listed AS (SELECT repo, seq, run_id, path, file_hash FROM ranked WHERE k = 1 AND file_hash IS NOT NULL)
"""
CHANGED_SQL = FOUND_SQL + """
SELECT a.run_id, a.path FROM listed a LEFT JOIN listed b ON a.repo = b.repo AND a.path = b.path AND a.seq = b.seq + 1
WHERE b.file_hash IS NULL OR b.file_hash <> a.file_hash
"""
COUNTS_SQL = FOUND_SQL + """
SELECT a.run_id, count(*) AS n_listed, sum(CASE WHEN b.file_hash IS NULL OR b.file_hash <> a.file_hash THEN 1 ELSE 0 END)::BIGINT AS n_todo
FROM listed a LEFT JOIN listed b ON a.repo = b.repo AND a.path = b.path AND a.seq = b.seq + 1 GROUP BY a.run_id
"""
