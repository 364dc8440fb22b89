"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from recollect.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return db


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return str(value)


def rows(table):
    columns = sorted(table.column_names)
    return columns, sorted(([plain(r[c]) for c in columns] for r in table.to_pylist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, small, name):
    found = rows(entry.queries()[name](spark, small).toArrow())
    assert found == rows(duck.sql(entry.oracle_sql()[name]).to_arrow_table())


def test_flagship(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    out = entry.entry(spark)
    assert out.columns == ["qid", "id", "moment_id", "score", "label", "timestamp_ms", "source", "rank"]
    assert 0 < out.count() <= 5


def test_each_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
