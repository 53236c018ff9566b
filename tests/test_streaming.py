from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from insight_spark.session import fresh_path
from insight_spark.sources import chunk_store
from insight_spark.streaming import jobs, rollup


def message(i, conversation, minutes, content="hello"):
    return (i, conversation, content, datetime(2024, 1, 1) + timedelta(minutes=minutes))


SCHEMA = "message_id long, conversation_id long, content string, created_at timestamp"


def test_rollup_counts_once_and_continues(spark):
    path = fresh_path(spark, "rollup")
    stream = lambda: spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(f"{path}/in")
    first = [message(1, 7, 1, "first words"), message(2, 7, 2), message(2, 7, 2), message(3, 8, 1)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    rollup.start_rollup(stream(), f"{path}/out", f"{path}/cp", "1 hour").awaitTermination()
    # The second run sees a repeat, a new message, and continues from the checkpoint.
    second = [message(2, 7, 2), message(4, 7, 9, "later words")]
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    rollup.start_rollup(stream(), f"{path}/out", f"{path}/cp", "1 hour").awaitTermination()
    state = {r["conversation_id"]: (r["message_count"], r["title"], r["updated_at"].minute) for r in rollup.read_rollup(spark, f"{path}/out").collect()}
    assert state == {7: (3, "first words", 9), 8: (1, "hello", 1)}


def test_a_new_conversation_asks_the_state_little():
    import pandas as pd

    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        listTimers = lambda self: calls.append("list") or iter([5])
        deleteTimer = lambda self, at: calls.append("delete")
        registerTimer = lambda self, at: calls.append("register")

    one = rollup.Conversation(10, ["conversation_id", *[part.split()[0] for part in rollup.STATE.split(", ")], "closed"])
    one.handle, one.state = Handle(), State()
    frames = lambda *parts: iter([pd.DataFrame(p, columns=["message_id", "opening", "at"]) for p in parts])
    row = lambda *parts: next(one.handleInputRows((7,), frames(*parts), None)).values.tolist()
    assert row([(4, "b", 9000), (3, "a", 9000)], [(5, None, 9500)]) == [[7, 9000, 3, 9500, 9000, "3", "a", False]]
    assert calls == ["get", "update", "register"]
    assert row([(2, None, 8000)]) == [[7, 9000, 4, 9500, 8000, "2", None, False]]
    assert calls[3:] == ["get", "list", "delete", "update", "register"]


def stream_of(spark, path, parts):
    """Parts as files that a stream takes one by one."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    kind = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_quiet_conversations_leave_the_state(spark):
    path = fresh_path(spark, "rollup")
    # Every day twenty new conversations; those of the days before say nothing more.
    parts = [[message(1000 * day + i, 100 * day + i, 1440 * day + i, f"day {day}") for i in range(20)] for day in range(8)]
    query = rollup.start_rollup(stream_of(spark, path, parts), f"{path}/out", f"{path}/cp", "1 hour", "12 hours", compact_every=3)
    query.awaitTermination()
    live = [sum(int(s["numRowsTotal"]) for s in p["stateOperators"] if "transformWithState" in s["operatorName"]) for p in query.recentProgress]
    assert max(live) <= 60 and rollup.live_states(query) <= 60
    assert rollup.read_rollup(spark, f"{path}/out").count() == 160
    assert len(rollup._versions(spark, f"{path}/out", "bases", "base")) == 1
    assert len(rollup._versions(spark, f"{path}/out", "batches", "batch")) < 4


def test_a_conversation_may_come_back(spark):
    path = fresh_path(spark, "rollup")
    parts = [
        [message(1, 7, 0, "opening words"), message(2, 7, 5)], [message(3, 8, 3000, "other")], [message(4, 8, 6000)],
        [message(5, 7, 9000, "much later"), message(6, 7, 9001)], [message(7, 8, 12000)],
    ]
    rollup.start_rollup(stream_of(spark, path, parts), f"{path}/out", f"{path}/cp", "10 minutes", "1 hour", compact_every=2).awaitTermination()
    spans = rollup._spans(spark, f"{path}/out")
    assert spans.filter("conversation_id = 7").count() == 2
    state = {r["conversation_id"]: (r["message_count"], r["title"]) for r in rollup.read_rollup(spark, f"{path}/out").collect()}
    assert state == {7: (4, "opening words"), 8: (3, "other")}


def test_late_messages_are_counted(spark):
    path = fresh_path(spark, "rollup")
    parts = [[message(1, 7, 0)], [message(2, 7, 1000)], [message(3, 8, 1001)], [message(4, 7, 5), message(5, 8, 1002)]]
    query = rollup.start_rollup(stream_of(spark, path, parts), f"{path}/out", f"{path}/cp", "1 hour", "30 days")
    query.awaitTermination()
    state = {r["conversation_id"]: r["message_count"] for r in rollup.read_rollup(spark, f"{path}/out").collect()}
    assert rollup.late_messages(query) == 1 and state == {7: 2, 8: 2}
    assert rollup.read_rollup(spark, f"{path}/nothing").count() == 0


def test_ingest_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Some words. " * 300)
    (folder / "b.bin").write_bytes(b"x")
    path = fresh_path(spark, "ingest")
    run = lambda: jobs.stream_ingest_files(spark, str(folder), "c1", f"{path}/chunks", f"{path}/status", f"{path}/cp").awaitTermination()
    run()
    (folder / "c.txt").write_text("More words.")
    run()
    status = {r["filename"]: r["status"] for r in jobs.read_status(spark, f"{path}/status").collect()}
    assert status == {"a.txt": "ready", "b.bin": "skipped", "c.txt": "ready"}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert {r["source"] for r in chunks.select("source").distinct().collect()} == {"a.txt", "c.txt"}


def test_a_batch_that_stops_half_way(spark, tmp_path):
    """Its files are processing; run again they have one final state, and what was derived is dropped."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Some words about harbours.")
    (folder / "b.docx").write_bytes(b"no zip")
    path = fresh_path(spark, "ingest")
    from insight_spark.operators.postings import PostingIndex

    index = PostingIndex(spark, f"{path}/index", "string")
    index.add(spark.createDataFrame([("x", "old words", "c1"), ("y", "other words", "c2")], "doc_id string, text string, c string"), scope="c")
    calls = []

    def stop(conversation):
        calls.append(conversation)
        if len(calls) == 1:
            raise RuntimeError("stopped")

    def run():
        return jobs.stream_ingest_files(
            spark, str(folder), "c1", f"{path}/chunks", f"{path}/status", f"{path}/cp", derived=[index.delete, stop]
        )

    with pytest.raises(Exception, match="stopped"):
        run().awaitTermination()
    assert {r["status"] for r in jobs.read_status(spark, f"{path}/status").collect()} == {"processing"}
    run().awaitTermination()
    status = jobs.read_status(spark, f"{path}/status").collect()
    assert {(r["filename"], r["status"]) for r in status} == {("a.txt", "ready"), ("b.docx", "error")}
    steps = spark.read.parquet(f"{path}/status").groupBy("path", "step").count()
    assert {r["count"] for r in steps.collect()} == {1} and spark.read.parquet(f"{path}/chunks").count() == 1
    assert calls == ["c1", "c1"] and {r["scope"] for r in index.sizes().collect()} == {"c2"}


def test_ingest_stream_imports_tables(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "staff.csv").write_text("StaffID,Team\nS1,a\nS2,a\n")
    (folder / "note.txt").write_text("A note.")
    path = fresh_path(spark, "ingest")
    jobs.stream_ingest_files(
        spark, str(folder), "feedbeef-1", f"{path}/chunks", f"{path}/status", f"{path}/cp", table_folder=f"{path}/tables"
    ).awaitTermination()
    assert spark.table("upload_feedbeef_staff").count() == 2
    texts = {r["text"] for r in spark.read.parquet(f"{path}/chunks").collect()}
    assert "Staff S1 — Team: a." in texts and "A note." in texts


def test_classify_stream(spark):
    path = fresh_path(spark, "classify")
    df = spark.createDataFrame([("hello there", True, True, ["a.csv"]), ("plot sales", True, True, ["a.csv"])], "question string, has_docs boolean, has_csv boolean, files array<string>")
    df.write.parquet(f"{path}/in")
    out = jobs.classify_stream(spark.readStream.schema(df.schema).parquet(f"{path}/in"))
    query = out.writeStream.format("memory").queryName("routes").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["question"], r["route"]) for r in spark.table("routes").collect()} == {("hello there", "GENERAL"), ("plot sales", "SQL")}
