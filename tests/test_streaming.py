from __future__ import annotations

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from rackpulse.operators import correlation as C
from rackpulse.streaming import alerts
from rackpulse.streaming.run import start

ORIGIN = datetime(2024, 1, 1)
SCHEMA = (
    "event_id long, ts timestamp, tick long, kind string, scope string, target string, severity string, benign boolean,"
    " parent_event_id string"
)


def make_events(n=600, last_tick=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        tick = rng.randint(0, last_tick)
        severity = rng.choices(["info", "warn", "critical"], [6, 3, 1])[0]
        rows.append(
            (i, ORIGIN + timedelta(seconds=tick * 300 + rng.randint(0, 299)), tick, rng.choice("ab"), "gpu",
             f"node-000{rng.randint(0, 2)}/gpu0", severity, severity == "info", None)
        )
    return sorted(rows, key=lambda r: r[1])


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_dedupe_over_several_batches_equals_the_batch_form(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = make_events()
    closing = [(10_000, ORIGIN + timedelta(days=30), 8640, "z", "gpu", "end", "info", True, None)]
    for part in (rows[:200], rows[200:350], rows[350:], closing):
        land(spark, folder, part)
        # A new query on the same checkpoint every time: state and progress survive the restart.
        events = spark.readStream.schema(SCHEMA).parquet(folder)
        start(alerts.dedupe_stream(events, 7), out, checkpoint).awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(out).collect())
    batch = C.dedupe(spark.createDataFrame(rows, SCHEMA), 7, ["event_id"])
    assert got == sorted(r.event_id for r in batch.collect())


class HeldValue:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_one_call_keeps_the_rule_for_many_keys_and_holds_open_ones_only():
    state = HeldValue()
    rule = alerts.KeepRule(7)
    rule.init(SimpleNamespace(getValueState=lambda name, schema: state))
    rng = random.Random(5)
    names = [("a", "x"), ("a", None), (None, "x"), ("b", "x"), ("b", "y")]
    cells = [(*rng.choice(names), tick, rng.choice([True, False, None]), rng.choice(["info", None, "critical"])) for tick in range(200) for _ in range(2)]
    cells = list({c[:3]: c for c in cells}.values()) + [("end", "end", 900, False, "info")]
    want, last = [], {}
    for kind, target, tick, critical, severity in cells:
        before = last.get((kind, target))
        survives = severity != "critical" and (before is None or tick - before > 7)
        want += [(kind, target, tick)] * survives
        if survives or critical:
            last[kind, target] = tick
    got = []
    for part in (cells[:90], cells[90:91], cells[91:-1], cells[-1:]):
        frame = pd.DataFrame(rng.sample(part, len(part)), columns=["kind", "target", "tick", "critical", "severity"]).assign(shard=3)
        for out in rule.handleInputRows((3,), iter([frame.iloc[:40], frame.iloc[40:]]), None):
            assert list(out.columns) == ["kind", "target", "tick", "severity"]
            got += out[["kind", "target", "tick"]].itertuples(index=False, name=None)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert state.value == (["end"], ["end"], [900])


def test_bursts_close_with_the_watermark_and_late_rows_are_dropped(spark, tmp_path, fleet):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def event(i, tick):
        return (i, ORIGIN + timedelta(seconds=tick * 300), tick, "k", "gpu", "node-0001/gpu0", "info", True, None)

    for part in ([event(0, 0), event(1, 14), event(2, 15)], [event(3, 60)], [event(4, 1), event(5, 200)]):
        land(spark, folder, part)
        events = spark.readStream.schema(SCHEMA).parquet(folder)
        stream = alerts.burst_stream(events, fleet, 15, int((ORIGIN - datetime(1970, 1, 1)).total_seconds()))
        start(stream, out, checkpoint).awaitTermination()
    got = {r.incident_id: r.member_count for r in spark.read.parquet(out).collect()}
    key = "burst:k|rack_id=rack-000|t"
    assert got == {f"{key}0": 2, f"{key}1": 1, f"{key}4": 1}


def test_hopping_statistics(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    land(spark, folder, make_events() + [(10_000, ORIGIN + timedelta(days=30), 8640, "z", "gpu", "end", "info", True, None)])
    samples = spark.readStream.schema(SCHEMA).parquet(folder).withColumn("value", F.col("tick").cast("double"))
    origin = int((ORIGIN - datetime(1970, 1, 1)).total_seconds())
    start(alerts.window_stats_stream(samples, "kind", "value", 12, 6, origin), out, checkpoint).awaitTermination()
    got = {(r.kind, r.window_end_tick): (r.n, r.max) for r in spark.read.parquet(out).collect()}
    rows = make_events()
    inside = [r[2] for r in rows if r[3] == "a" and 72 <= r[2] < 216]
    assert got["a", 216] == (len(inside), max(inside))
