"""Every core query with SQL, against DuckDB on the smallest data."""

import math
from pathlib import Path

import pytest

from papyrion.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings survey paper chunk emb tm parse_cache eval_item".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert ours == theirs


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, DATA).count() >= 0
