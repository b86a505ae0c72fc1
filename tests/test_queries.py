"""Every query against its SQL at the smallest scale; those without SQL keep their rows."""

import glob
import os

import duckdb
import pytest
from textloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shown(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", [n for n, q in registry.CATALOG.items() if q.sql])
def test_query_equals_sql(spark, duck, name):
    query = registry.CATALOG[name]
    df = query.run(spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(query.sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", [n for n, q in registry.CATALOG.items() if not q.sql and not n.startswith(("oov_", "preset_", "speech_", "generic_"))])
def test_text_steps_keep_their_rows(spark, name):
    rows = registry.CATALOG[name].run(spark, SF).collect()
    assert rows and all(r[1] is not None for r in rows)


def test_entry_module():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).collect()[0]
    assert row["total"] == row["iv_total"] + row["oov_total"] and 0 < row["oov_rate"] < 1
