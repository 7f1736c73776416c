"""Queries against their SQL on the smallest tables with one column changed to what larger tables hold by chance."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_oracles import SF, TABLES, table

BY_CHANCE = {
    "moved_nodes": ("orders", "TIMESTAMP '1999-01-01' - to_days(CAST(o_orderkey % 30 AS INTEGER)) AS o_orderdate"),  # files last changed at the batch's own moment
    "trash_nodes": ("orders", "TIMESTAMP '1999-01-01' AS o_orderdate"),  # files that went into the trash at the batch's own moment
    "detect_mime": ("documents", "concat(['The free ', 'far wide ', 'and skip ', 'left ftyp', 'to a new WAVE', 'a common WEBP'][CAST(doc_id % 6 AS INTEGER) + 1], text) AS text"),
    "pending_files": ("pages", "concat('https://a.example.net/en/', page_id // 7) AS url"),
    "stability": ("pages", "concat('https://a.example.net/en/', page_id // 7) AS url"),
    "upsert_import_entries": ("pages", "concat('https://a.example.net/en/', page_id // 7) AS url"),
}


def with_column(folder, changed, column):
    """The smallest tables, one of them with the column in place of its own."""
    for t in TABLES:
        if t != changed:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    duckdb.sql(f"copy (select * replace ({column}) from '{SF}/{changed}.parquet') to '{folder}/{changed}.parquet' (format parquet)")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", BY_CHANCE)
def test_same_rows_by_chance(spark, tmp_path, name):
    duck = with_column(tmp_path, *BY_CHANCE[name])
    got = entry.queries()[name](spark, str(tmp_path))
    found = duck.execute(entry.oracle_sql()[name])
    assert table(got.collect(), got.columns) == table(found.fetchall(), [c[0] for c in found.description])
