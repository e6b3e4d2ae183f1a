"""The registered queries over the smallest tables, and figures that must hold there."""

import pytest

from draftloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_with_its_columns(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert df.columns and (rows or name in ("p8_found", "p8_restored", "p7_found", "p7_leaks"))


def test_each_listing_once_with_a_confidence(spark, sf_dir):
    rows = queries.p3_matches(spark, sf_dir).collect()
    assert len({r["listing_id"] for r in rows}) == len(rows) == spark.read.parquet(f"{sf_dir}/source_listings.parquet").count()
    assert all(0 <= r["probability"] <= 1.0001 for r in rows)


def test_containers_are_full(spark):
    d = "/root/testdata/sf0.01"
    for r in queries.p6_fill(spark, d).collect():
        assert r["used_share"] > 0.99 and r["containers"] == r["least_containers"]
