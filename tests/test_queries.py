"""Registered queries against their oracles on the smallest tables (the slow model fits run in parity.py only)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from parity import compare, connect

SF = "/root/testdata/sf0.001"
SLOW = {"star_round_trip", "star_orphans", "fact_clusters", "family_labels", "family_counts", "stream_dedupe"}
NAMES = sorted(set(entry.oracle_sql()) - SLOW)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "incident_id" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    text, ok = compare(spark, con, SF, name)
    assert ok, text
