"""Every registered query against its SQL, and those without SQL for their shape."""

import math

import duckdb
import pytest

from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 7) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry_imports_without_the_optional_part():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "diversity_cap" in e.queries()
