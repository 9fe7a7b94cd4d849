import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = "embedded_topk rrf_fuse pool_cut graph_expand name_match name_boost lexical_rerank rank_proxy hybrid_search hybrid_no_graph hybrid_no_rerank format_hits".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_every_case_as_in_sql(spark, name):
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
    assert len({r[cols.index("qid")] for r in got}) == c.sql("select count(*) from eval_cases").fetchall()[0][0]
