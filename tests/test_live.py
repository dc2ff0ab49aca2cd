"""Bounded state: redelivery, rows that wait for their handle, patience that ends."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatlake.operators.contacts import build_users
from chatlake.operators import conversations as CV, messages as M
from chatlake import schemas
from chatlake.session import scratch_path
from chatlake.streaming import live as L, sessions as SS
from test_stream import log, static  # noqa: F401  the fixture of the other stream tests

DAY0 = datetime(2024, 1, 1)


class Feed:
    """A folder of files, each with a day of arrival; read as a stream, file by file."""

    def __init__(self, spark, schema):
        self.spark, self.path, self.schema = spark, scratch_path(spark, "feed"), schema.add("arrived", "timestamp")
        spark.createDataFrame([], self.schema).write.parquet(self.path)

    def add(self, rows, day):
        rows.withColumn("arrived", F.lit(DAY0 + timedelta(days=day))).select(self.schema.fieldNames()).coalesce(1).write.mode(
            "append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def feeds(spark):
    from pyspark.sql.types import StructType
    return (Feed(spark, StructType(list(schemas.MESSAGE.fields))), Feed(spark, StructType(list(schemas.HANDLE.fields))))


def run(feeds, path, **how):
    messages, handles = feeds
    arrived = F.col("arrived")
    query = L.follow_messages(L.message_signals(messages.stream(), arrived), L.handle_signals(handles.stream(), arrived), path, **how)
    query.awaitTermination()
    return query


def wanted(spark, static, ids):
    return sorted(M.normalize_increment(log(spark, ids), build_users(*static)).collect())


def test_redelivery_and_any_order_give_the_same_table(spark, static, feeds):
    messages, handles = feeds
    path = scratch_path(spark, "live")
    handles.add(static[0], 0)
    for ids in (range(51, 100, 2), range(1, 50), range(51, 100, 2), range(50, 101, 2), range(1, 101)):
        messages.add(log(spark, ids), 0)
    run(feeds, path)
    assert sorted(L.synced_messages(spark, path).collect()) == wanted(spark, static, range(1, 101))
    # Nothing new: a second run writes nothing more, and a delivery of all rows neither.
    messages.add(log(spark, range(1, 101)), 1)
    run(feeds, path)
    assert L.synced_messages(spark, path).count() == len(wanted(spark, static, range(1, 101)))


def test_state_does_not_grow_with_the_table(spark, static, feeds):
    messages, handles = feeds
    path = scratch_path(spark, "live")
    handles.add(static[0], 0)
    for day in range(10):
        messages.add(log(spark, range(100 * day + 1, 100 * day + 101)), day)
    query = run(feeds, path, remember="2 days", lanes=2)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    ops = {o["operatorName"]: o for o in query.recentProgress[-1]["stateOperators"]}
    assert "dedupeWithinWatermark" in ops
    seen = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"] == "dedupeWithinWatermark"]
    per_day = len(wanted(spark, static, range(1, 101)))
    # Ten days came; no more than about four days of ids (two to remember, one on its way, handles) are ever held.
    assert len(held) >= 10 and max(seen) <= 5 * per_day + 20
    assert sorted(L.synced_messages(spark, path).collect()) == wanted(spark, static, range(1, 1001))


def test_late_handles_release_their_rows_and_patience_ends(spark, static, feeds):
    messages, handles = feeds
    path = scratch_path(spark, "live")
    handles.add(static[0].where("handle_id <= 2"), 0)
    messages.add(log(spark, range(1, 61)), 0)
    run(feeds, path, remember="1 day", patience_hours=24 * 5, lanes=3)
    users = {r["handle_id"]: r["user_id"] for r in build_users(*static).collect()}
    by_user = {u: h for h, u in users.items()}
    assert {by_user[r["user_id"]] for r in L.synced_messages(spark, path).collect()} == {1, 2}
    # Handle 3 comes in time: exactly its rows come out. Handle 4 comes after patience ended, 5 never.
    handles.add(static[0].where("handle_id = 3"), 3)
    run(feeds, path, remember="1 day", patience_hours=24 * 5, lanes=3)
    whole = wanted(spark, static, range(1, 61))
    assert sorted(L.synced_messages(spark, path).collect()) == [r for r in whole if by_user[r["user_id"]] <= 3]
    messages.add(log(spark, [61, 62, 63]), 9)  # moves the clock
    messages.add(log(spark, [67]), 10)
    run(feeds, path, remember="1 day", patience_hours=24 * 5, lanes=3)
    handles.add(static[0].where("handle_id = 4"), 11)
    run(feeds, path, remember="1 day", patience_hours=24 * 5, lanes=3)
    lost = L.rejected_messages(spark, path).collect()
    assert {r["message_id"] for r in lost} == {r["message_id"] for r in whole if by_user[r["user_id"]] in (4, 5)}
    assert {r["handle_id"] for r in lost} == {4, 5} and all("time to wait" in r["reason"] for r in lost)
    late = {r["message_id"] for r in L.synced_messages(spark, path).collect()}
    assert late == {r["message_id"] for r in wanted(spark, static, [*range(1, 64), 67]) if by_user[r["user_id"]] <= 3}


def test_a_batch_that_is_run_again_replaces_itself(spark, static, feeds):
    messages, handles = feeds
    path = scratch_path(spark, "live")
    handles.add(static[0], 0)
    messages.add(log(spark, range(1, 31)), 0)
    run(feeds, path)
    before = sorted(L.synced_messages(spark, path).collect())
    # As after a crash between the write and its commit: the last commit is gone.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    commits = hadoop.Path(f"{path}-checkpoint/commits")
    files = commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max((f.getPath() for f in files.listStatus(commits) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    files.delete(last, False)
    run(feeds, path)
    assert sorted(L.synced_messages(spark, path).collect()) == before == wanted(spark, static, range(1, 31))


def test_many_handles_cost_no_python_call_each(spark, feeds):
    messages, handles = feeds
    path = scratch_path(spark, "live")
    rows = spark.range(1, 6001).selectExpr("id AS rowid", "concat('m', id) AS text", "id % 5000 + 1 AS handle_id", "id AS date", "0 AS is_from_me")
    told = spark.range(2, 5001).selectExpr("id AS handle_id", "'a@b.com' AS id")
    new, known = (df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                              for f in feed.schema if f.name != "arrived"]) for df, feed in ((rows, messages), (told, handles)))
    handles.add(known, 0)
    messages.add(new, 0)
    query = run(feeds, path, remember="1 day", patience_hours=48, lanes=2)
    kinds = {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]}
    assert kinds == {"dedupeWithinWatermark", "dedupe", "symmetricHashJoin"}
    found = L.synced_messages(spark, path).count()
    # The same handles told again, long after they were forgotten as signals, double nothing.
    for day in (20, 21):
        handles.add(known, day)
        run(feeds, path, remember="1 day", patience_hours=48, lanes=2)
    assert found == L.synced_messages(spark, path).count() == 6000 - L.rejected_messages(spark, path).count()
    # No new message came: the clock of the handles alone gave up those of the handle that is not there.
    assert {r["message_id"] for r in L.rejected_messages(spark, path).collect()} == {5000}


CHAT = "chat_id bigint, message_id bigint, user_id string, created_at timestamp"


def told(rows):
    return sorted((r["chat_id"], r["start_message_id"], r["end_message_id"], r["message_count"], r["start_time"], r["end_time"],
                   r["initiated_by"]) for r in rows)


def talk(spark, path, source):
    stream = spark.readStream.schema(CHAT).option("maxFilesPerTrigger", 1).parquet(source)
    SS.follow_conversations(stream, path, late_by="2000 hours").awaitTermination()


def test_open_conversations_end_as_those_of_the_whole_log(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        # A third of the messages is in one chat; pauses lie around the limit.
        chat = 0 if i % 3 == 0 else rng.randrange(1, 25)
        rows.append((chat, i, f"u{rng.randrange(3)}", DAY0 + timedelta(seconds=rng.randrange(0, 60 * 24 * 3600, 3600 * 3))))
    source, path = scratch_path(spark, "talk"), scratch_path(spark, "updates")
    rng.shuffle(rows)
    for part in range(4):
        spark.createDataFrame(rows[part::4], CHAT).coalesce(1).write.mode("append").parquet(source)
    talk(spark, path, source)
    whole = CV.conversations(spark.createDataFrame(rows, CHAT)).collect()
    found = SS.current_conversations(spark, path).collect()
    assert told(found) == told(whole)
    assert {r["status"] for r in found} == {"open"}  # the watermark is far behind
    statuses = {r["status"] for r in spark.read.schema(SS._STORED).parquet(path).collect()}
    assert statuses == {"open", "replaced"}


def test_conversations_close_by_timer(spark):
    source, path = scratch_path(spark, "talk"), scratch_path(spark, "updates")
    at = lambda chat, i, hours: (chat, i, f"u{i}", DAY0 + timedelta(hours=hours))
    for batch in ([at(1, 1, 0), at(1, 2, 1), at(2, 3, 0)], [at(1, 4, 48.5), at(2, 5, 40)], [at(3, 6, 400)], [at(3, 7, 401)]):
        spark.createDataFrame(batch, CHAT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHAT).option("maxFilesPerTrigger", 1).parquet(source)
        SS.follow_conversations(stream, path, late_by="1 hour").awaitTermination()
    found = {(r["chat_id"], r["start_message_id"]): (r["message_count"], r["status"]) for r in
             SS.current_conversations(spark, path, 1).collect()}
    assert found == {(1, 1): (3, "closed"), (2, 3): (2, "closed"), (3, 6): (2, "open")}


def test_stretches_join_within_the_gap():
    frame = pd.DataFrame([(1, 0, 1, "a", 10, 2, 2), (1, 12, 3, "b", 12, 3, 1), (1, 5, 4, "c", 6, 4, 1), (1, 15, 5, "d", 15, 5, 1),
                          (2, 0, 6, "e", 0, 6, 1)], columns=["chat_id", *SS._STRETCH])
    got = [tuple(r) for r in SS.joined_stretches(frame, 3).itertuples(index=False)]
    assert got == [(1, 0, 1, "a", 12, 3, 4), (1, 15, 5, "d", 15, 5, 1), (2, 0, 6, "e", 0, 6, 1)]


def test_merging_tuples_gives_the_same_stretches():
    rng = random.Random(3)
    for _ in range(50):
        rows = [(at := rng.randrange(60), i, rng.choice("ab"), at + rng.randrange(5), 100 + i, rng.randrange(1, 4)) for i in range(rng.randrange(1, 15))]
        frame = pd.DataFrame(rows, columns=SS._STRETCH)
        frame.insert(0, "chat_id", 1)
        assert SS.merged_stretches(rows, 3) == [tuple(r)[1:] for r in SS.joined_stretches(frame, 3).itertuples(index=False)]


def test_one_timer_closes_all_that_the_watermark_passed():
    calls = []

    class Handle:
        rows = []

        def getListState(self, name, schema):
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

        def registerTimer(self, due):
            calls.append(due)

    class Clock:
        getExpiryTimeInMs, getCurrentWatermarkInMs = lambda self: 1, lambda self: 300

    chat = SS.OpenConversations(1000)
    chat.init(Handle())
    frame = pd.DataFrame([(i * 10_000, i, "a", i * 10_000, i, 1) for i in range(100)], columns=SS._STRETCH)
    [opened] = chat.handleInputRows((7,), iter([frame]), None)
    assert len(opened) == 100 and calls == [1]
    [closed] = chat.handleExpiredTimer((7,), Clock(), Clock())
    assert set(closed["status"]) == {"closed"} and len(closed) == 30 and calls == [1, 301] and len(chat.held.rows) == 70
