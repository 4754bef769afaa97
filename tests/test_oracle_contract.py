"""Every SQL twin runs in DuckDB and has the Spark query's column names and types (sf0.001)."""

import os

import duckdb
import pytest

from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
EXACT = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_sql_twins_match_spark_schemas(spark, duck):
    import __spark_entry__ as se
    qs, sqls = se.queries(), se.oracle_sql()
    problems = []
    for name, sql in sorted(sqls.items()):
        rel = duck.execute(sql)
        duck_types = {d[0]: str(d[1]) for d in rel.description}
        spark_types = {f.name: f.dataType.simpleString() for f in qs[name](spark, SF001).schema.fields}
        if set(duck_types) != set(spark_types):
            problems.append((name, sorted(spark_types), sorted(duck_types)))
            continue
        bad = {c: (t, duck_types[c]) for c, t in spark_types.items() if EXACT.get(t, t) != duck_types[c]}
        if bad:
            problems.append((name, bad))
    assert not problems, problems
