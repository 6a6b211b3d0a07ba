"""Memory of deliveries: exact over the horizon, replays, what is read, what stays on disk."""

import random
from datetime import datetime, timedelta

from issuelens.plans.streaming_q import _files
from issuelens.sources import fixtures as FX
from issuelens.streaming.seen import SeenDeliveries
from issuelens.streaming.webhook_stream import ENVELOPE_SCHEMA, stream_dedup_horizon

START = datetime(2024, 1, 1)


def batch(spark, rows):
    return spark.createDataFrame([(i, START + timedelta(hours=h)) for i, h in rows], "delivery_id long, ts timestamp")


def test_equals_a_plain_memory(spark, tmp_path):
    rng, memory = random.Random(2), SeenDeliveries(spark, str(tmp_path / "m"), "48 hours", buckets=4, parts=3)
    last = {}
    for k in range(7):
        rows = [(rng.randrange(60), k * 20 + rng.randrange(20)) for _ in range(40)]
        first = {}
        for i, h in rows:
            first[i] = min(first.get(i, h), h)
        # An id counts as seen if a recorded delivery lies at most 48 hours before it; only fresh ids are recorded.
        want = {i: h for i, h in first.items() if not any(b >= h - 48 for b in last.get(i, []))}
        for i, h in want.items():
            last.setdefault(i, []).append(h)
        for _ in range(2):  # the second call is a replay of the same batch
            got = {r.delivery_id: int((r.ts - START).total_seconds() // 3600) for r in memory.fresh(batch(spark, rows), f"b{k}").collect()}
            assert got == want, k
        assert len(memory.log.manifest()["parts"]) <= 3


def test_new_ids_are_not_looked_up_and_old_ones_go(spark, tmp_path):
    memory = SeenDeliveries(spark, str(tmp_path / "m"), "10 hours", buckets=8)
    memory.fresh(batch(spark, [(i, 0) for i in range(5000)]), "a")
    some = batch(spark, [(i, 1) for i in range(4900, 9900)])
    maybe = memory._maybe(some, memory._paths("filter")[0]).count()
    assert 100 <= maybe < 100 + 100  # the hundred seen ones and few false alarms
    assert memory.fresh(some, "b").count() == 4900
    memory.fresh(batch(spark, [(20_000, 100)]), "c")
    memory.compact()
    assert [r.delivery_id for r in memory.ids().collect()] == [20_000]
    assert memory.fresh(batch(spark, [(1, 101), (20_000, 101), (None, 101)]), "d").count() == 1  # a null id is nobody's
    assert memory.fresh(batch(spark, []), "e").count() == 0


def test_bodies_are_not_held_and_files_follow_the_events(spark, tmp_path, monkeypatch):
    held = []
    kind, own = type(spark.range(1)), type(spark.range(1)).persist
    monkeypatch.setattr(kind, "persist", lambda df, *a, **k: (held.append(df.columns), own(df, *a, **k))[1])
    rows = [(i % 70, START + timedelta(minutes=i), "issues", None, "x" * 50) for i in range(100)]
    spark.createDataFrame(rows, ENVELOPE_SCHEMA).write.parquet(f"{tmp_path}/landing")
    out = stream_dedup_horizon(spark, f"{tmp_path}/landing", f"{tmp_path}/out", "1 hour")
    # An id that returns an hour and ten minutes later is fresh again unless its first delivery lies in the same batch.
    assert {r.delivery_id for r in out.collect()} == set(range(70)) and not any("raw" in c for c in held)
    spark.range(1000).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(FX, "EVENTS_A_TASK", 25)
    assert _files(spark, str(tmp_path)) == 10
