"""The review queue as keyed state of a stream, with a timer for the recheck of what was done."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loftline.operators.merge import last_writes

#: How long after it was done an entry is due again.
RECHECK = timedelta(days=3)
#: How far messages may be behind.
LATE = "1 hour"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "zpid long, action string, since long, version long"
_CHANGE = Row("zpid", "action", "since", "version")
#: At the same time asks come before marks; what is none of them comes last.
_ORDER = {"ask": 0, "known": 1, "done": 2}


class QueueKeeper(StatefulProcessor):
    """One entry's life: unknown, queued, known or done.

    An ask queues what is neither queued, known nor done, and the least ``since`` of its asks
    counts; ``known`` keeps asks from queueing, but leaves what is queued; ``done`` takes an
    entry out and sets a timer, which queues it again, due for a recheck.  A message that is
    repeated changes nothing, so a batch may be replayed.
    """

    def __init__(self, recheck_ms: int) -> None:
        self.recheck_ms = recheck_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "status string, since long, version long, done_at long")

    def _put(self, key: tuple, status: str, since: int | None, version: int, done_at: int | None) -> Row:
        self.entry.update((status, since, version, done_at))
        return _CHANGE(key[0], status, since, version)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        held = self.entry.get() if self.entry.exists() else None
        status, since, version, done_at = held or (None, None, 0, None)
        before = (status, since)
        # Few messages a key come in a batch: plain tuples, as a frame for each key costs more than all else.
        batch = sorted(((r["ms"], _ORDER.get(r["kind"], 3), r["since"] is None, r["since"] or 0, r["kind"], r["since"]) for r in rows), key=lambda m: m[:4])
        for ms, _, _, _, kind, asked in batch:
            if kind == "ask" and status in (None, "queued"):
                since = int(asked) if status is None else min(since, int(asked))
                status = "queued"
            elif kind == "known" and status is None:
                status = "known"
            elif kind == "done" and status != "recheck" and (status != "done" or ms > done_at):
                if status == "done":
                    self.handle.deleteTimer(done_at + self.recheck_ms)
                status, done_at = "done", ms
                self.handle.registerTimer(ms + self.recheck_ms)
            elif kind == "done" and status == "recheck" and ms > done_at:
                status, done_at = "done", ms
                self.handle.registerTimer(ms + self.recheck_ms)
        if (status, since) != before or status == "done":
            yield self._put(key, status, since, version + 1, done_at)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        status, since, version, done_at = self.entry.get()
        if status == "done":
            yield self._put(key, "recheck", since, version + 1, done_at)

    def close(self) -> None:
        pass


def queue_changes(messages: DataFrame, recheck: timedelta = RECHECK, late: str = LATE) -> DataFrame:
    """Changes of the queue's entries (zpid, action, since, version) from a stream of messages.

    ``messages``: zpid long, kind ('ask', 'known' or 'done'), since long, at timestamp.  Timers run
    by the messages' own time: an entry is due again when a message of ``recheck`` and ``late`` later
    has come.  Messages may be ``late`` behind the latest one of earlier batches; older ones are dropped.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = messages.where(F.col("zpid").isNotNull() & F.col("at").isNotNull()).withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return timed.groupBy("zpid").transformWithState(QueueKeeper(int(recheck.total_seconds() * 1000)), _OUT, "Update", "EventTime")


def follow_queue(messages: DataFrame, path: str, checkpoint: str, recheck: timedelta = RECHECK, late: str = LATE) -> StreamingQuery:
    """Append the queue's changes under ``path``, a folder a batch; a batch that runs again overwrites its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queue_changes(messages, recheck, late).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Each entry's last state: zpid, action and since."""
    return last_writes(spark.read.schema(_OUT).parquet(path), "zpid", ["version"]).select("zpid", "action", "since")


def queued(spark: SparkSession, path: str) -> DataFrame:
    """What waits now, and since when; entries due for a recheck wait as well."""
    return entries(spark, path).where("action IN ('queued', 'recheck')").select("zpid", "since")
