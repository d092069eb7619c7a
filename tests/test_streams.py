"""State and the latest-wins table across restarts, repeated and late events, and a kill between write and commit."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from depotlake.streaming import events as EV
from depotlake.streaming.state import LatestTable, track

T0 = datetime(2024, 1, 1)
EVENT = "delivery_id string, delivery_status string, event_time timestamp, due timestamp"


def test_tracked_states_equal_a_batch_answer_after_a_restart(spark, tmp_path):
    """Files in the order of time, each with repeated and somewhat late events; the stream stops after half of them."""
    rng = random.Random(6)
    events = []
    for k in range(60):
        start = T0 + timedelta(minutes=rng.randrange(0, 3000))
        due = start + timedelta(minutes=60)
        events.append((f"d{k}", "Assigned", start, due))
        if k % 4:
            events.append((f"d{k}", "Picked up", start + timedelta(minutes=10), due))
        if k % 5:
            events.append((f"d{k}", "Delivered" if k % 7 else "Failed", start + timedelta(minutes=rng.randrange(20, 120)), due))
    events += [(None, "Assigned", T0, T0), ("none", "Assigned", None, T0)]
    known = [e for e in events if e[0] and e[2]]
    arrival = {e: e[2] + timedelta(minutes=rng.randrange(0, 50)) for e in known}  # within the delay
    order = sorted(known, key=arrival.get)
    files = [order[i : i + 15] + rng.sample(order[: i + 1], min(3, i + 1)) for i in range(0, len(order), 15)]
    files[1] += [e for e in events if not e[0] or not e[2]]
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run(some):
        for part in some:
            spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
            track(stream).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()

    run(files[: len(files) // 2])
    run(files[len(files) // 2 :])
    rows = spark.read.parquet(out).collect()
    last = {}
    for d, s, t, _ in known:
        last[d] = max(last.get(d, (T0, "")), (t, s))
    seen = {}
    for r in rows:
        if r.kind == "status":
            seen[r.delivery_id] = max(seen.get(r.delivery_id, (T0, "")), (r.at, r.delivery_status))
    assert seen == last
    mark_at = max(t for _, _, t, _ in known) - timedelta(hours=1)
    ended = {d: min((t for x, s, t, _ in known if x == d and s in ("Delivered", "Failed")), default=None) for d in last}
    dues = {d: due for d, _, _, due in known}
    want = sorted((d, due) for d, due in dues.items() if due < mark_at and (ended[d] is None or ended[d] > due))
    assert sorted((r.delivery_id, r.at) for r in rows if r.kind == "alert") == want and want


def changes(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, at timestamp")


def test_latest_table_survives_a_kill_before_the_commit(spark, tmp_path):
    rng = random.Random(7)
    batches = [[(rng.choice(["a", "b", "c", "d", None]), 100 * n + i, T0 + timedelta(hours=rng.randrange(100), seconds=100 * n + i)) for i in range(20)] for n in range(4)]
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    killed = []

    def kill_once(batch_id):
        if batch_id == 2 and not killed:
            killed.append(batch_id)
            raise RuntimeError("killed")

    table = LatestTable(spark, str(tmp_path / "table"), ["k"], "at", buckets=4, before_commit=kill_once)
    for n, rows in enumerate(batches):
        changes(spark, rows).coalesce(1).write.mode("append").parquet(source)
        run = lambda: EV.for_each_batch(spark.readStream.schema("k string, v int, at timestamp").parquet(source), mark, table.write).awaitTermination()
        if n == 2:
            before = sorted(map(repr, table.read().collect()))
            with pytest.raises(Exception, match="killed"):
                run()
            assert sorted(map(repr, table.read().collect())) == before and table.ledger()["batch"] == 1  # nothing has changed yet
        run()
    want = {}
    for k, v, at in (r for b in batches for r in b):
        if k not in want or (at, v) > want[k]:
            want[k] = (at, v)
    assert {r.k: (r["at"], r.v) for r in table.read().collect()} == want and killed == [2]
    at_end = table.ledger()
    table.write(changes(spark, batches[0]), 0)  # a batch that is sent again
    table.write(changes(spark, batches[3]), 3)
    assert table.ledger() == at_end and table.read().count() == len(want)
    table.write(changes(spark, batches[0][:0]), 9)
    assert table.ledger()["batch"] == 9 and table.ledger()["buckets"] == at_end["buckets"]


def test_latest_table_rewrites_touched_buckets_only(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path / "t"), ["k"], "at", buckets=8)
    assert table.read() is None
    table.write(changes(spark, [(f"k{i}", i, T0) for i in range(50)]), 0)
    table.write(changes(spark, [("k1", 99, T0 + timedelta(1)), ("k1", 98, T0)]), 1)
    assert sorted(table.ledger()["buckets"].values()) == [0] * 7 + [1]
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 50 and rows["k1"] == 99
    table.write(changes(spark, [("k1", 5, T0 - timedelta(1))]), 2)  # an older row doesn't win
    assert {r.k: r.v for r in table.read().collect()} == rows


def test_stream_queries_leave_no_duplicates_in_batches(spark, tmp_path):
    """Redelivered rows in one batch and across a restart."""
    rows = [(str(k % 30), T0 + timedelta(minutes=k % 30)) for k in range(90)]
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for _ in range(2):
        spark.createDataFrame(rows, "k string, event_time timestamp").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, event_time timestamp").parquet(source)
        EV.dedup_redelivered(stream, ["k"], "2 hours").writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == 30 == found.select("k").distinct().count() and found.where(F.col("k").isNull()).count() == 0
