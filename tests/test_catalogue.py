"""Each query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tracewright.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(found):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert rows(df.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_keywords_of_odd_texts_equal_sql(spark, duck, tmp_path):
    texts = [None, "", "!? -- ...", "the and", "misc misc x", "\u4e2d\u6587\u4e2d a", "\u4e2d", "D\u0130GER d\u0130ger \u212aelvin", "B b a A c", "\u03a3 _x_ 1.5 1,5"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["doc_keywords"](spark, str(tmp_path)).select("doc_id", "token", "n", "rank_no")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(got.collect()) == rows(c.sql(ORACLES["doc_keywords"]).select("doc_id", "token", "n", "rank_no").fetchall())
