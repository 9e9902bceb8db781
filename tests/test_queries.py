"""Every registered query of the engine against DuckDB on the same tables."""

import duckdb
import pytest

from arbordoc import queries
from arbordoc.all_queries import QUERIES, SQL
from arbordoc.sources import documents as D

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else bytes(v) if isinstance(v, bytearray) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=str)
    assert got


def test_relational_and_walked_checks_agree(spark):
    e = D.elements(queries.event_documents(spark, SF), queries.EVENTS)
    walked = D.errors(queries.event_documents(spark, SF), queries.EVENTS)
    from arbordoc.operators import checks

    relational = {(r["code"], r["n"]) for r in checks.summary(checks.broken_runs(e)).collect()}
    assert relational == {(r["code"], r["n"]) for r in checks.summary(walked).collect()}


def test_odd_sources(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), (None, "x\n"), ("c", "a\n          b\n"), ("c", "a\n")], "source_id string, text string")
    assert D.documents(df).count() == 4 and D.compounds(df).count() == 3 and D.parse_errors(df).count() == 1
    assert D.elements(df.limit(0), queries.PART).count() == 0
    raw = spark.createDataFrame([("a", bytearray(b"k \xff\n"))], "source_id string, text binary")
    assert [r["code"] for r in D.parse_errors(raw).collect()] == ["E123"]


def test_no_shuffle_to_parse(spark):
    plan = D.elements(queries.part_documents(spark, SF), queries.PART)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_flagship(spark):
    assert queries.flagship(spark, SF).count() == 150
