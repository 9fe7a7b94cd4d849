import datetime as dt

import pytest
from pyspark.sql import functions as F

from kestrel.operators.changes import apply_changes, change_counts, changed_paths
from kestrel.sources.store import Conflict, VersionedTable

T = dt.datetime(2026, 1, 1)
SCANS = "scan_id bigint, run_id bigint, repo string, path string, file_hash string, scanned_at timestamp, received_at timestamp, path2 string"
RUNS = "run_id bigint, repo string, run_no int, status string"


def _scan(i, run, path, h, minute=0):
    return (i, run, "r", path, h, T + dt.timedelta(minutes=minute), T, "clash")


def test_changed_paths(spark):
    runs = spark.createDataFrame([(1, "r", 1, "success"), (2, "r", 2, "crashed"), (3, "r", 3, "success"), (4, "r", 4, None), (5, "r", 5, "success")], RUNS)
    scans = spark.createDataFrame(
        [
            _scan(1, 1, "a", "AA"), _scan(2, 1, "b", "bb"), _scan(3, 1, "b", "bb"), _scan(4, 1, "c", None),
            _scan(5, 2, "a", "zz"),
            _scan(6, 3, "a", "aa"), _scan(7, 3, "b", "b2", 1), _scan(8, 3, "b", "bb", 2), _scan(9, 3, "d", "dd"), _scan(10, 3, None, "x"),
            _scan(11, 5, "a", "a2"), _scan(12, 5, "b", "bb", 1), _scan(13, 5, "b", None, 2), _scan(14, 5, "c", "cc"),
        ], SCANS,
    )
    got = sorted(tuple(r) for r in changed_paths(scans, runs).collect())
    assert got == [(1, "a"), (1, "b"), (3, "d"), (5, "a"), (5, "c")]
    assert sorted(tuple(r) for r in change_counts(scans, runs).collect()) == [(1, 2, 2), (3, 3, 1), (5, 2, 2)]


def test_empty(spark):
    assert changed_paths(spark.createDataFrame([], SCANS), spark.createDataFrame([], RUNS)).count() == 0


def test_runs_survive_failures(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "t")
    made = []

    def make(df):
        made.append(df.count())
        return df.withColumn("out", F.upper("path"))

    def src(*rows):
        return spark.createDataFrame(list(rows), "path string, file_hash string")

    assert apply_changes(table, src(("a", "1"), ("b", "1")), make, ["path"]) == 1

    def fail():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        apply_changes(table, src(("a", "2"), ("b", "1"), ("c", "1")), make, ["path"], fail_before_swap=fail)
    assert table.version() == 1 and sorted(r.path for r in table.read().collect()) == ["a", "b"]
    assert apply_changes(table, src(("a", "2"), ("b", "1"), ("c", "1")), make, ["path"]) == 2
    assert made == [2, 2, 2]
    assert sorted(tuple(r) for r in table.read().select("path", "file_hash").collect()) == [("a", "2"), ("b", "1"), ("c", "1")]
    apply_changes(table, src(("b", "1")), make, ["path"])
    assert [r.path for r in table.read().collect()] == ["b"] and made[-1] == 0
    table.drop_old(1)
    assert table.versions() == [3]


def test_nulls_are_not_listed(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "t")
    src = spark.createDataFrame([("a", "1"), (None, "1"), ("b", None)], "path string, file_hash string")
    made = []

    def make(df):
        made.append(sorted(r.path for r in df.collect()))
        return df

    for _ in range(2):
        apply_changes(table, src, make, ["path"])
    assert made == [["a"], []] and [tuple(r) for r in table.read().collect()] == [("a", "1")]


def test_records_without_rows_are_not_redone(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "t")
    made = []

    def make(df):
        made.append(sorted(r.path for r in df.collect()))
        return df.where("path <> 'blank'")

    def run(*rows):
        apply_changes(table, spark.createDataFrame(list(rows), "path string, file_hash string"), make, ["path"])

    for _ in range(3):
        run(("a", "1"), ("blank", "1"))
    run(("a", "1"), ("blank", "2"))
    run(("a", "1"))
    run(("a", "1"), ("blank", "2"))
    assert made == [["a", "blank"], [], [], ["blank"], [], ["blank"]]
    assert [r.path for r in table.read().collect()] == ["a"]


def test_parts_of_the_target_that_a_run_does_not_speak_of_stay(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "t")
    rows = "repo string, path string, file_hash string"
    apply_changes(table, spark.createDataFrame([("r", "a", "1"), ("s", "b", "1")], rows), lambda d: d, ["repo", "path"])
    apply_changes(table, spark.createDataFrame([("r", "c", "1")], rows), lambda d: d, ["repo", "path"], other=spark.createDataFrame([("s",)], "repo string"))
    assert sorted(tuple(r) for r in table.read().collect()) == [("r", "c", "1"), ("s", "b", "1")]


def test_two_writers_and_a_broken_log(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "t")
    base = table.publish(spark.range(3))
    assert table.publish(spark.range(4), base) == 2
    with pytest.raises(Conflict):
        table.publish(spark.range(5), base)
    assert table.version() == 2 and table.read().count() == 4
    (tmp_path / "t/_log/2").write_text("?")
    (tmp_path / "t/_log/.2.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        table.read()
    with pytest.raises(ValueError):
        apply_changes(table, spark.createDataFrame([("a", "1")], "path string, file_hash string"), lambda d: d, ["path"])
    assert table.versions() == [1, 2]


def test_the_work_comes_from_published_versions(spark, monkeypatch):
    """Without the target's state nothing would be left out."""
    from kestrel.operators import changes

    runs = spark.createDataFrame([(1, "r", 1, "success"), (2, "r", 2, "success")], RUNS)
    scans = spark.createDataFrame([_scan(1, 1, "a", "aa"), _scan(2, 2, "a", "aa")], SCANS)
    assert sorted(tuple(r) for r in changed_paths(scans, runs).collect()) == [(1, "a")]
    monkeypatch.setattr(changes, "state_of", lambda t, *_: t.read().where("false"))
    assert sorted(tuple(r) for r in changed_paths(scans, runs).collect()) == [(1, "a"), (2, "a")]


def test_each_once(spark):
    from kestrel.session import each_once

    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 1), (None, "c", 1), (3, "d", 1), (3, "d", 1)], "id bigint, text string, n int")
    assert sorted((r.id, r.text) for r in each_once(df, "id").collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert each_once(df.where("false"), "id").count() == 0 and each_once(df, "id").columns == df.columns


def test_batches_by_bytes():
    import pyarrow as pa

    from kestrel.session import by_bytes

    b = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["x" * (10 if i % 7 else 5000) for i in range(50)]})
    out = list(by_bytes([b], 6000))
    assert [i for x in out for i in x.column("id").to_pylist()] == list(range(50)) and len(out) > 5
    assert all(x.num_rows == 1 or x.nbytes <= 6000 for x in out) and list(by_bytes([b.slice(0, 0)])) != []
