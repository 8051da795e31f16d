"""Every catalogue query against its SQL, on the smallest tables."""

import duckdb
import pytest

from lexiloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(frame, names):
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    frame = frame[sorted(names)].astype(object)
    rows = frame.where(frame.notna(), None).itertuples(index=False)
    return sorted((tuple(norm(v) for v in r) for r in rows), key=lambda r: tuple(map(repr, r)))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA)
    found = con.execute(catalogue.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    assert _plain(got.toPandas(), names) == _plain(found.fetchdf(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_twice_alike(spark, name):
    a, b = (catalogue.QUERIES[name](spark, DATA).toPandas() for _ in range(2))
    assert len(a) and sorted(map(repr, a.itertuples(index=False))) == sorted(map(repr, b.itertuples(index=False)))
