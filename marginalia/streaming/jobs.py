"""Streams: request intake, running job progress, stage counts by window."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import requests as req
from ..sources.json_io import parse_requests
from ..sources.tables import finished, remove

#: Batches of progress that are put together into one base.
COMPACT = 8
KEY = ["input_mode", "source_text", "file_name", "deck_purpose", "slide_count"]


#: What state with timers needs: RocksDB; and no batches for the sake of timers alone, without which available input would never be done.
TIMED_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the streams that start meanwhile, which take them along; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_intake(spark: SparkSession, source: str, out: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Validates and queues JSON requests as files arrive: accepted and rejected rows under ``out``, by batch.

    A request that comes again within ``delay`` of the file's time is dropped. A batch
    that is run again overwrites its own folders, so each request is written once.
    """
    lines = spark.readStream.text(source).select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    parsed = parse_requests(lines).withColumn("request_key", F.sha2(F.to_json(F.struct(*KEY, "type_errors")), 256))
    fresh = parsed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["request_key"])

    def route(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read twice, parsed once
        accepted, rejected = req.route_requests(req.validate_requests(batch))
        req.enqueue_jobs(accepted, "request_key").drop("type_errors").write.mode("overwrite").parquet(f"{out}/accepted/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
        batch.unpersist()

    return fresh.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Progress(StatefulProcessor):
    """A job's latest stage and number of events; forgotten once it has been idle for a while."""

    def __init__(self, idle_ms: int, id_type: str) -> None:
        self.idle_ms, self.id_type = idle_ms, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", f"ts timestamp, event_id {self.id_type}, stage string, n_events long, epoch long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        ts, event_id, stage, n, epoch, timer = self.state.get() or (None, None, None, 0, now, None)
        best = None if n == 0 else (pd.Timestamp(ts), event_id, stage)
        for part in rows:
            last = part.sort_values(["ts", "event_id"]).iloc[-1]
            n, found = n + len(part), (last["ts"], last["event_id"], last["stage"])
            best = found if best is None or found[:2] > best[:2] else best
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle_ms)
        event_id = best[1].item() if hasattr(best[1], "item") else best[1]
        self.state.update((best[0].to_pydatetime(), event_id, best[2], n, epoch, now + self.idle_ms))
        yield pd.DataFrame({"job": [key[0]], "epoch": [epoch], "ts": [best[0]], "event_id": [event_id], "stage": [best[2]], "n_events": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _latest(parts: DataFrame) -> DataFrame:
    """The last row of each job and epoch: that of most events."""
    last = parts.groupBy("job", "epoch").agg(F.max(F.struct("n_events", "ts", "event_id", "stage")).alias("r"))
    return last.select("job", "epoch", "r.*")


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    """Events added up, and the latest of them, by the columns."""
    return rows.groupBy(*by).agg(F.max(F.struct("ts", "event_id", "stage")).alias("r"), F.sum("n_events").alias("n_events")).select(*by, "r.*", "n_events")


def _parts(spark: SparkSession, out: str) -> DataFrame:
    """What the newest base and the batches after it say."""
    base = max((int(n) for n in finished(spark, f"{out}/base")), default=-1)
    paths = [f"{out}/base/{base}"] if base >= 0 else []
    paths += [f"{out}/batch/{n}" for n in finished(spark, f"{out}/batch") if int(n) > base]
    return spark.read.parquet(*paths)


def _compact(spark: SparkSession, out: str, batch_id: int) -> None:
    """All up to ``batch_id`` as one base: two rows a job at most, its last epoch, which may go on, and the ones before (epoch 0). A batch run again finds its base and only clears up."""
    if str(batch_id) not in finished(spark, f"{out}/base"):
        rows = _latest(_parts(spark, out))
        ends = rows.groupBy("job").agg(F.max("epoch").alias("last")).withColumnRenamed("job", "__job")
        closed = rows.join(ends, F.col("job").eqNullSafe(F.col("__job"))).withColumn("epoch", F.when(F.col("epoch") == F.col("last"), F.col("epoch")).otherwise(0))
        _summed(closed, "job", "epoch").write.mode("overwrite").parquet(f"{out}/base/{batch_id}")
    for kind, keep in (("base", batch_id), ("batch", batch_id + 1)):
        for name in finished(spark, f"{out}/{kind}"):
            if int(name) < keep:
                remove(spark, f"{out}/{kind}/{name}")


def stream_progress(events: DataFrame, out: str, checkpoint: str, redelivery: str = "1 day", idle_ms: int = 86_400_000) -> StreamingQuery:
    """Progress of jobs from a stream (job, stage, ts, event_id), for ``read_progress``: each batch writes the rows of the jobs that changed.

    An event_id that comes again within ``redelivery`` of its arrival is dropped; late
    events count whenever they come. State is bounded by the ids of that time and by the
    jobs seen within ``idle_ms``: a timer forgets an idle job, and if it goes on, its
    rows begin a new epoch, added to the ones before. Every COMPACT batches the rows so
    far become one base of two rows a job at most, so files and rows don't grow with
    batches. A batch that is run again overwrites its folder. Timers are looked at in
    batches with events.
    """
    spark, kinds = events.sparkSession, dict(events.dtypes)
    fresh = events.select("job", "stage", "ts", "event_id", F.current_timestamp().alias("arrived")).withWatermark("arrived", redelivery).dropDuplicatesWithinWatermark(["event_id"])
    schema = f"job {kinds['job']}, epoch long, ts timestamp, event_id {kinds['event_id']}, stage string, n_events long"
    changed = fresh.groupBy("job").transformWithStateInPandas(_Progress(idle_ms, kinds["event_id"]), schema, "Append", "ProcessingTime")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch/{batch_id}")
        if (batch_id + 1) % COMPACT == 0:
            _compact(spark, out, batch_id)

    with _settings(spark, TIMED_STATE):
        return changed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    """(job, stage, n_events): the latest stage of each job over all batches so far."""
    return _summed(_latest(_parts(spark, out)), "job").select("job", "stage", "n_events")


def stage_windows(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events per stage and tumbling window; in a stream, rows later than ``delay`` are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "stage", "n")


def stream_stage_windows(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stage_windows(events).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
