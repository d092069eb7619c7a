"""State by key, and a table in which the latest row of each key wins, whatever is sent again."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from depotlake.streaming.events import latest_into

#: States after which a delivery is no more late than it was.
ENDED = ("Delivered", "Failed", "Cancelled")
OUTPUT = "delivery_id string, kind string, delivery_status string, ms long"
COLUMNS = ["delivery_id", "kind", "delivery_status", "ms"]
STATES = pa.schema([("delivery_id", pa.string()), ("delivery_status", pa.string()), ("ms", pa.int64()), ("ended", pa.int64()), ("due", pa.int64()), ("alerted", pa.bool_())])


class DeliveryTracker(StatefulProcessor):
    """The latest status of each delivery, and one alert when its promised time passes without its end.

    Rows have delivery_id, delivery_status, ms and due_ms (milliseconds). Of a delivery's events the latest counts (ties: the later status by name), so
    repeated and late ones change nothing. A timer waits for the promised time; what ended by then, by the events' own times, gives no alert.

    The key is a shard of deliveries, whose states are one table (an Arrow stream): a batch reads and writes it once for each shard, and not once for each
    delivery, and one timer waits for the first promised time of the shard that is still open.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "states binary, timer long")

    def load(self) -> tuple[pd.DataFrame | None, int | None]:
        if not self.states.exists():
            return None, None
        packed, timer = self.states.get()
        return pa.ipc.open_stream(bytes(packed)).read_pandas().astype({"ended": "Int64", "due": "Int64"}).set_index("delivery_id"), timer

    def save(self, states: pd.DataFrame, timer: int | None) -> None:
        """Sees to it that a timer waits for the first open time; one that waits for an earlier time stays, and sets the next when it expires."""
        still = states.loc[waits(states), "due"]
        first = int(still.min()) if len(still) else None
        if first is not None and (timer is None or first < timer):
            self.handle.registerTimer(first)
            timer = first
        table, sink = pa.Table.from_pandas(states.reset_index(), STATES, preserve_index=False), io.BytesIO()
        with pa.ipc.new_stream(sink, STATES) as out:
            out.write_table(table)
        self.states.update((sink.getvalue(), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was, timer = self.load()
        new = pd.concat(list(rows), ignore_index=True)
        new = pd.DataFrame({
            "delivery_id": new["delivery_id"], "delivery_status": new["delivery_status"], "ms": new["ms"].astype("int64"), "ended": new["ms"].astype("Int64").where(new["delivery_status"].isin(ENDED)),
            "due": new["due_ms"].astype("Int64"), "alerted": False,
        })
        if was is not None:
            own = was[was.index.isin(new["delivery_id"])]
            new = pd.concat([own.reset_index(), new], ignore_index=True)
        last = new.assign(place=new["delivery_status"].fillna("")).sort_values(["ms", "place"], kind="stable").drop_duplicates("delivery_id", keep="last").set_index("delivery_id")[["delivery_status", "ms"]]
        of_id = new.groupby("delivery_id", sort=False)
        states = last.join(of_id.agg(ended=("ended", "min"), due=("due", "first"), alerted=("alerted", "max")))
        changed = last
        if was is not None:
            old = own.reindex(last.index)
            same = (old["ms"] == last["ms"]).fillna(False) & (old["delivery_status"].fillna("") == last["delivery_status"].fillna(""))
            changed = last[~same.astype(bool)]
            states = pd.concat([was[~was.index.isin(states.index)], states])
        self.save(states, timer)
        if len(changed):
            yield changed.reset_index().assign(kind="status")[COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        states, timer = self.load()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        # all times that the watermark has passed, each of which a timer of its own would have met by now
        late = waits(states) & ((states["due"] <= expired) | (states["due"] < timerValues.getCurrentWatermarkInMs())).fillna(False).astype(bool)
        states.loc[late, "alerted"] = True
        self.save(states, None if timer is not None and timer <= expired else timer)
        if late.any():
            yield states[late].drop(columns="ms").rename(columns={"due": "ms"}).reset_index().assign(kind="alert").astype({"ms": "int64"})[COLUMNS]

    def close(self) -> None:
        pass


def waits(states: pd.DataFrame) -> pd.Series:
    """Whether an alert can still come: the delivery has a promised time, no alert yet, and no end by that time."""
    by_then = (states["ended"] <= states["due"]).fillna(False).astype(bool)
    return states["due"].notna() & ~states["alerted"].astype(bool) & ~by_then


def track(events: DataFrame, delay: str = "1 hour", shards: int = 1024) -> DataFrame:
    """delivery_id, kind (status or alert), delivery_status and at, from a stream of delivery_id, delivery_status, event_time and due. Rows without an id or a time are left out.

    Needs the RocksDB state store, which is set for the session. shards must stay as it is when a stream goes on from its checkpoint.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.where("delivery_id is not null and event_time is not null").withWatermark("event_time", delay)
    shard = F.pmod(F.xxhash64("delivery_id"), F.lit(shards)).cast("int").alias("shard")
    rows = timed.select(shard, "delivery_id", "delivery_status", "event_time", F.unix_millis("event_time").alias("ms"), F.unix_millis("due").alias("due_ms"))
    out = rows.groupBy("shard").transformWithStateInPandas(DeliveryTracker(), OUTPUT, "Append", "EventTime")
    return out.select("delivery_id", "kind", "delivery_status", F.timestamp_millis("ms").alias("at"))


class LatestTable:
    """A table by key in which the latest row wins, written by micro-batches.

    Keys are dealt to buckets; a batch reads and rewrites only the buckets that it touches, into a folder of its own. A ledger then says, in one file that
    is renamed into place, which folder each bucket is in and which batch was the last: a batch that fails before that changes nothing, and one that is
    sent again after it is passed over. The ledger has one entry for each bucket, however large the table.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64, before_commit: Callable[[int], None] | None = None):
        self.spark, self.path, self.keys, self.order, self.buckets, self.before_commit = spark, path.rstrip("/"), keys, order, buckets, before_commit

    def hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def ledger(self) -> dict:
        """The last batch and the folder of each bucket."""
        folder, fs = self.hadoop(f"{self.path}/ledger")
        found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        last = max((int(n[:-5]) for n in found if n.endswith(".json")), default=None)
        if last is None:
            return {"batch": -1, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self.path}/ledger/{last}.json", wholetext=True).first()[0])

    def commit(self, entry: dict) -> None:
        final, fs = self.hadoop(f"{self.path}/ledger/{entry['batch']}.json")
        staged, _ = self.hadoop(f"{self.path}/ledger/{entry['batch']}.staged")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not fs.rename(staged, final):
            raise OSError(f"the ledger has {final} already")

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        held = {int(b): f for b, f in self.ledger()["buckets"].items() if only is None or int(b) in only}
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/batch={f}/bucket={b}" for b, f in sorted(held.items())]).drop("batch", "bucket") if held else None

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        ledger = self.ledger()
        if batch_id <= ledger["batch"]:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most one for each bucket
        if touched:
            merged = latest_into(self.read(touched), batch, self.keys, self.order)
            merged.withColumn("bucket", bucket).repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch_id}")
        if self.before_commit:
            self.before_commit(batch_id)
        self.commit({"batch": batch_id, "buckets": ledger["buckets"] | {str(b): batch_id for b in touched}})
