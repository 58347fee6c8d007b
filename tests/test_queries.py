"""A sample of the registered queries against their SQL checks at the smallest scale."""

import os

import pytest

DIR = os.environ.get("TAINTGRID_TEST_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "flagship_document_gate", "join_prefix_longest", "join_calls", "bld_variable_to_sink", "pat_findings", "fwk_detection", "cls_consolidate_flows", "his_trend", "vrd_parse_batch", "rul_assign_ids",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def text(v):
    return "NULL" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want
