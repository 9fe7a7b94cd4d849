import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = "p3_found language_detect file_filter dir_filter file_hash window_chunks incremental_union greedy_batches debounce_sessions tokenize_counts doc_freq bm25_zero_fill dense_topk rrf_ties code_prior name_match mmr_topk graph_expand hybrid_search recall_at_k".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[k]) for k in cols) for r in df.collect())
    rel = c.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(k) for k in cols]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_env_file(tmp_path, monkeypatch):
    from kestrel.sources.config import load_env

    monkeypatch.setenv("K_HELD", "process")
    monkeypatch.delenv("K_NEW", raising=False)
    f = tmp_path / ".env"
    f.write_text("# c\n\nK_NEW='a=b'\nK_HELD=file\nnothing\n")
    assert load_env(str(f)) == {"K_NEW": "a=b", "K_HELD": "file"}
    assert os.environ["K_NEW"] == "a=b" and os.environ["K_HELD"] == "process"
    monkeypatch.delenv("K_NEW")
    assert load_env(str(tmp_path / "none")) == {}
