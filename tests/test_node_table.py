from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from rackpulse.sources import node_table

BUCKETS = 8


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(f"node-{i:04d}", 720, float(i)) for i in range(200)] + [(None, 720, -1.0)]
    name, path = f"latest_{uuid.uuid4().hex}", str(tmp_path_factory.mktemp("lookup") / "t")
    node_table.save(spark.createDataFrame(rows, "node_id string, window_end_tick long, x double"), name, path, BUCKETS)
    return name, path


def rows_scanned(df):
    """Rows that the scan handed on before any filter."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_point_lookup_reads_one_bucket(spark, stored):
    found = node_table.row_of(spark.table(stored[0]), "node-0042")
    assert [tuple(r) for r in found.collect()] == [("node-0042", 720, 42.0)]
    # Eight files are dealt to several tasks; only the bucket's own file is left.
    assert spark.table(stored[0]).rdd.getNumPartitions() > 1 and found.rdd.getNumPartitions() == 1
    assert rows_scanned(found) < 200 / 2
    assert node_table.row_of(spark.table(stored[0]), "node-9999").count() == 0


def test_every_request_is_answered(spark, stored):
    asked = [(0, "node-0007"), (1, "node-0007"), (2, "node-9999"), (3, None)] + [(i, "node-0001") for i in range(4, 3004)]
    requests = spark.createDataFrame(asked, "id long, node_id string")
    got = {r.id: (r.found, r.x) for r in node_table.look_up(spark.table(stored[0]), requests, ["x"]).collect()}
    assert got == {i: (True, float(n[5:])) if n and n != "node-9999" else (False, None) for i, n in asked}
    assert node_table.look_up(spark.table(stored[0]), requests.limit(0), ["x"]).count() == 0


def test_stored_rows_are_not_exchanged(spark, stored):
    requests = spark.range(5000).select(F.format_string("node-%04d", F.col("id") % 300).alias("node_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        answers = node_table.look_up(spark.table(stored[0]), requests, ["x"])
        tree = answers._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, line in enumerate(tree) if "FileScan" in line)
        join = next(i for i, line in enumerate(tree) if "LeftSemi" in line)
        assert "Bucketed: true" in tree[scan]
        assert not [line for line in tree[join:scan] if "Exchange" in line]
        assert answers.filter("found").count() == sum(1 for i in range(5000) if i % 300 < 200)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_declaration_of_the_stored_files(spark, stored):
    table = node_table.attach(spark, f"again_{uuid.uuid4().hex}", stored[1], BUCKETS)
    assert table.count() == 200
    assert rows_scanned(node_table.row_of(table, "node-0001")) < 200 / 2


def test_clashing_columns_are_refused(spark, stored):
    with pytest.raises(ValueError, match="found"):
        node_table.look_up(spark.table(stored[0]), spark.createDataFrame([("n", True)], "node_id string, found boolean"), ["x"])
