"""The registered queries: names, SQL twins and a cross-check on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, shaped

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "t8_chunk_by_tokens", "t11_hard_split", "b2_build_sections", "b7_guard_tokens", "g4_select_skills",
    "g9_route_documents", "o3_pages_from_blocks", "m5_sanitize_relations", "m9_dedup_exact", "v3_dedup_document",
    "s3_scan_samples", "w3_latest_status",
)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_operator_is_registered():
    have = {name.split("_")[0] for name in entry.queries()}
    counts = {"s": 8, "k": 5, "o": 7, "t": 12, "b": 10, "r": 3, "g": 11, "p": 9, "c": 2, "m": 16, "v": 10, "w": 4}
    assert {f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1)} <= have


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert shaped(df.columns, df.collect()) == shaped(columns, result.fetchall())
