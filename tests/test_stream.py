from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.operators import conversations as CV, messages as M
from chatlake.operators.contacts import build_users
from chatlake.session import scratch_path
from chatlake.streaming import sessions as SS, sync as SY

BASE = 683140800000000000


@pytest.fixture(scope="module")
def static(spark):
    handle = spark.createDataFrame([(i, f"+1555000000{i}", "us", "SMS") for i in range(1, 6)], schemas.HANDLE)
    contacts = spark.createDataFrame(
        [("c", "Ann", "Lee", "(555) 000-0001", "", None, 1)],
        "user_id string, first_name string, last_name string, phone_number string, email string, handle_id bigint, load_order int")
    return handle, contacts


def log(spark, ids):
    rows = [(i, f"g{i}", None if i % 10 == 0 else f"text {i}", None, i % 6, BASE + i * 60_000_000_000, int(i % 3 == 0)) for i in ids]
    df = spark.createDataFrame(rows, "rowid bigint, guid string, text string, attributed_body binary, handle_id bigint, date bigint, is_from_me int")
    for f in schemas.MESSAGE:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(schemas.MESSAGE.fieldNames())


def follow(spark, source, target, static, **kw):
    handle, contacts = static
    query = SY.start_sync(spark, source, target, handle, contacts, **kw)
    query.awaitTermination()


def test_stream_equals_batch_over_increments(spark, static):
    source, target = scratch_path(spark, "log"), SY.SyncTarget(scratch_path(spark, "lake"))
    seen = []
    log(spark, range(1, 101)).coalesce(1).write.parquet(source)
    follow(spark, source, target, static, on_new_messages=lambda rows, n: seen.append((rows.count(), n)))
    log(spark, range(101, 111)).coalesce(1).write.mode("append").parquet(source)
    follow(spark, source, target, static, on_new_messages=lambda rows, n: seen.append((rows.count(), n)))
    follow(spark, source, target, static, on_new_messages=lambda rows, n: seen.append((rows.count(), n)))

    whole = log(spark, range(1, 111))
    wanted = M.normalize_increment(whole, build_users(*static))
    got = target.read(spark, "messages")
    assert sorted(got.collect()) == sorted(wanted.collect())
    users = target.read(spark, "users").collect()
    assert sorted(u["handle_id"] for u in users) == [1, 2, 3, 4, 5]
    state = SY.sync_state(spark, target).first()
    assert (state["last_processed_rowid"], state["total_messages_processed"], state["sync_status"]) == (110, got.count(), "idle")
    assert [n for n, _ in seen] == [100, 10]


def test_one_file_per_trigger_and_start_at_latest(spark, static):
    source, target = scratch_path(spark, "log"), SY.SyncTarget(scratch_path(spark, "lake"))
    for part in (range(1, 6), range(6, 11), range(11, 16)):
        log(spark, part).coalesce(1).write.mode("append").parquet(source)
    follow(spark, source, target, static, max_files=1, start_at=5)
    progress = target.read(spark, "progress").orderBy("batch_id").collect()
    assert [(r["rows_read"], r["last_rowid"]) for r in progress] == [(0, None), (5, 10), (5, 15)]
    assert target.read(spark, "messages").agg(F.min("message_id")).first()[0] > 5
    assert SY.latest_rowid(log(spark, [3, 9])) == 9


def test_replay_and_redelivery_write_once(spark, static):
    handle, contacts = static
    target = SY.SyncTarget(scratch_path(spark, "lake"))
    base = spark.createDataFrame([], schemas.USERS)
    rows = log(spark, range(1, 30))
    for batch_id in (0, 0, 1):
        SY.sync_batch(rows, batch_id, target, handle, contacts, base)
    ids = [r["message_id"] for r in target.read(spark, "messages").collect()]
    assert len(ids) == len(set(ids)) == M.normalize_increment(rows, build_users(*static)).count()
    assert target.read(spark, "users").groupBy("handle_id").count().where("count > 1").count() == 0
    assert SY.sync_state(spark, target).first()["total_messages_processed"] == len(ids)


def test_ids_in_any_order(spark, static):
    source, target = scratch_path(spark, "log"), SY.SyncTarget(scratch_path(spark, "lake"))
    for part in (range(51, 100, 2), range(50, 101, 2), range(1, 50)):
        log(spark, part).coalesce(1).write.mode("append").parquet(source)
        follow(spark, source, target, static)
    wanted = M.normalize_increment(log(spark, range(1, 101)), build_users(*static))
    assert sorted(target.read(spark, "messages").collect()) == sorted(wanted.collect())
    assert SY.sync_state(spark, target).first()["last_processed_rowid"] == 100


def test_messages_wait_for_their_handle(spark, static):
    handle, contacts = static
    folder, target = scratch_path(spark, "handles"), SY.SyncTarget(scratch_path(spark, "lake"))
    base = spark.createDataFrame([], schemas.USERS)
    handle.where("handle_id <= 3").coalesce(1).write.parquet(folder)
    now = lambda: spark.read.schema(schemas.HANDLE).parquet(folder)
    SY.sync_batch(log(spark, range(1, 31)), 0, target, now, lambda: contacts, base)
    assert {r["handle_id"] for r in target.read_batch(spark, "pending", 0).collect()} == {4, 5}
    handle.where("handle_id > 3").coalesce(1).write.mode("append").parquet(folder)
    # The same rows again, replayed; then a batch without rows changes nothing more.
    for batch_id, ids in ((1, range(1, 31)), (1, range(1, 31)), (2, [])):
        SY.sync_batch(log(spark, ids), batch_id, target, now, lambda: contacts, base)
    wanted = M.normalize_increment(log(spark, range(1, 31)), build_users(*static))
    assert sorted(target.read(spark, "messages").collect()) == sorted(wanted.collect())
    assert target.read_batch(spark, "pending", 2).count() == 0


def test_mark_moves_past_skipped_rows(spark, static):
    handle, contacts = static
    target = SY.SyncTarget(scratch_path(spark, "lake"))
    SY.sync_batch(log(spark, [6, 12, 60]), 0, target, handle, contacts, spark.createDataFrame([], schemas.USERS))
    state = SY.sync_state(spark, target).first()
    assert (state["last_processed_rowid"], state["total_messages_processed"]) == (60, 0)


def test_failing_hook_does_not_fail_the_batch(spark, static):
    handle, contacts = static
    target = SY.SyncTarget(scratch_path(spark, "lake"))

    def hook(rows, synced):
        raise RuntimeError("no listener")

    SY.sync_batch(log(spark, [1]), 0, target, handle, contacts, spark.createDataFrame([], schemas.USERS), on_new_messages=hook)
    assert target.read(spark, "messages").count() == 1


def test_empty_state(spark):
    state = SY.sync_state(spark, SY.SyncTarget(scratch_path(spark, "none"))).first()
    assert (state["last_processed_rowid"], state["total_messages_processed"], state["sync_status"]) == (None, 0, "idle")


def test_live_sessions_split_like_the_batch(spark):
    start = datetime(2024, 1, 1)
    hours = [0, 1, 49, 50, 97.9, 200, 201, 400]  # 1 -> 49 is exactly the gap
    rows = [(1, i, start + timedelta(hours=h)) for i, h in enumerate(hours)]
    source, out = scratch_path(spark, "rows"), scratch_path(spark, "found")
    df = spark.createDataFrame(rows, "chat_id bigint, message_id bigint, created_at timestamp")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    SS.stream_conversations(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = {(r["start_message_id"], r["end_message_id"], r["message_count"]) for r in spark.read.parquet(out).collect()}
    batch = CV.conversations(df.withColumn("user_id", F.lit("u")))
    assert got == {(r["start_message_id"], r["end_message_id"], r["message_count"]) for r in batch.collect()} == {
        (0, 1, 2), (2, 4, 3), (5, 6, 2)}
