"""Each registered surface query against its SQL on the smallest tables."""

import duckdb
import pytest

from rugosa.plans import engine_queries, queries, shape_queries

ALL = (queries, engine_queries, shape_queries)
ORACLE_SQL = {k: v for m in ALL for k, v in m.ORACLE_SQL.items()}
QUERIES = {k: f for m in ALL for k, f in m.QUERIES.items()}

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v for v in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "lineitem events part".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLE_SQL[name]).df())
    assert len(got) == len(want)
    assert got == want
