from pyspark.sql import functions as F

from loftline.streaming.queue import entries, follow_queue, queued
from loftline.streaming.upserts import event_counts, follow_changes, merged_log


def test_changes_are_followed_once(spark, tmp_path):
    source, log = f"{tmp_path}/in", f"{tmp_path}/log"
    schema = "zpid int, rating string, ts int"
    for rows in ([(1, "yes", 1), (1, "no", 2), (2, "yes", 1)], [(2, "", 5), (3, "maybe", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        follow_changes(spark.readStream.schema(schema).parquet(source), log, f"{tmp_path}/cp", "zpid", ["ts"]).awaitTermination()
    assert {r["zpid"]: r["rating"] for r in merged_log(spark, log, "zpid", ["ts"], "rating").collect()} == {1: "no", 3: "maybe"}


def test_windows_take_untyped_times(spark):
    events = spark.createDataFrame([("a", 1.0)], "event_type string, value double").withColumn("ts", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    assert event_counts(events).first()["n"] == 1


def _messages(spark, rows):
    return spark.createDataFrame([(z, k, s, f"2024-01-{d:02d} 00:00:00") for z, k, s, d in rows], "zpid long, kind string, since long, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1)


def test_queue_of_a_stream_with_a_repeated_batch_and_rechecks(spark, tmp_path):
    source, log = f"{tmp_path}/in", f"{tmp_path}/log"
    batches = [
        [(1, "ask", 5, 1), (1, "ask", 3, 1), (2, "known", None, 1), (3, "ask", 4, 1), (None, "ask", 1, 1)],
        [(2, "ask", 6, 2), (3, "done", None, 2), (4, "ask", 7, 2), (3, "ask", 9, 3)],
        [(1, "ask", 8, 4), (5, "ask", 9, 9)],
    ]
    for k in (0, 1, 1, 2):
        _messages(spark, batches[k]).write.mode("append").parquet(source)
        stream = spark.readStream.schema("zpid long, kind string, since long, at timestamp").parquet(source)
        follow_queue(stream, log, f"{tmp_path}/cp").awaitTermination()
        if k == 1:
            # Entry 3 is done, and asks for it don't queue it again before its time.
            assert {r["zpid"]: r["action"] for r in entries(spark, log).collect()} == {1: "queued", 2: "known", 3: "done", 4: "queued"}
    # The last batch's time is a week later: entry 3 is due for its recheck.
    assert {r["zpid"]: (r["action"], r["since"]) for r in entries(spark, log).collect()} == {1: ("queued", 3), 2: ("known", None), 3: ("recheck", 4), 4: ("queued", 7), 5: ("queued", 9)}
    assert sorted(r["zpid"] for r in queued(spark, log).collect()) == [1, 3, 4, 5]


def test_an_entry_takes_messages_as_plain_rows():
    """No frame is made for a key; messages are taken in time order, asks before marks."""
    from pyspark.sql import Row

    from loftline.streaming.queue import QueueKeeper

    class Held:
        state, timers = None, []

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def exists(self):
            return self.state is not None

        def get(self):
            return self.state

        def update(self, state):
            self.state = state

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

        def deleteTimer(self, ms):  # noqa: N802
            self.timers.remove(ms)

    keeper, held = QueueKeeper(100), Held()
    keeper.init(held)
    rows = lambda *some: iter([Row(zpid=7, kind=k, since=s, ms=m) for k, s, m in some])
    took = lambda *some: [tuple(r) for r in keeper.handleInputRows((7,), rows(*some), None)]
    assert took(("known", None, 5), ("ask", 9, 5), ("ask", 4, 6)) == [(7, "queued", 4, 1)]
    assert took(("ask", 4, 6)) == []
    assert took(("done", None, 20)) == [(7, "done", 4, 2)] and held.timers == [120]
    assert [tuple(r) for r in keeper.handleExpiredTimer((7,), None, None)] == [(7, "recheck", 4, 3)]
