"""Every query with SQL gives the rows that DuckDB gives; operations work on streams."""

import duckdb
import pytest

from loomtab.operators import basic
from loomtab.plans import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    got = Q.queries()[name](spark, DATA).toPandas()
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_stream(spark, tmp_path):
    from loomtab.streaming.operations import write_stream

    source = spark.read.parquet(f"{DATA}/customer.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{DATA}/customer.parquet*")
    seen = []
    op = basic.mask(["c_name"], stream.columns)
    write_stream(stream, op, str(tmp_path / "out"), str(tmp_path / "check"), lambda n, s: seen.append(s)).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == source.count() == sum(s.rows_processed for s in seen)
    assert out.filter("c_name rlike '[^*]'").count() == 0


def test_without_the_other_queries():
    import __spark_entry__ as entry

    assert set(Q.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
