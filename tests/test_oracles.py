"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from filecat.plans import content_queries, maintenance_queries, read_queries, source_queries, stream_queries

SF = "/root/testdata/sf0.001"
PARTS = (read_queries, content_queries, maintenance_queries, source_queries, stream_queries)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("part, name", [(p, n) for p in PARTS for n in p.QUERIES])
def test_same_rows(spark, duck, part, name):
    got = part.QUERIES[name](spark, SF)
    found = duck.execute(part.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert table(got.collect(), got.columns) == table(found.fetchall(), columns)
