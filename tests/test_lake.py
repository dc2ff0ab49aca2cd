from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.functions.body import encode_body
from chatlake.operators import chats as CH, lookups as L, messages as M, quality as Q, sendlog as SL
from chatlake.operators.contacts import handle_user_id
from chatlake.plans import lake as PL
from chatlake.session import scratch_path
from chatlake.sources import readers as R, sinks as S

START = 683140800000000000
MINUTE = 60_000_000_000


@pytest.fixture(scope="module")
def sources(spark):
    handle = spark.createDataFrame(
        [(1, "+15551234567", "us", "iMessage"), (2, "test@example.com", "us", "SMS"), (3, "+15559876543", "us", "SMS")], schemas.HANDLE)
    rows = [(1, "Hello", None, 1, 0, START), (2, None, "From blob", 2, 1, START + MINUTE), (3, " spaced ", None, 9, 0, START + 2 * MINUTE),
            (4, "", "\x00", 1, 0, START + 3 * MINUTE), (5, "none", None, None, 1, 0), (6, None, None, 1, 0, START), (7, "sys", None, 0, 0, START)]
    message = spark.createDataFrame(rows, "rowid bigint, text string, body string, handle_id bigint, is_from_me int, date bigint")
    message = message.withColumn("attributed_body", F.when(F.col("body") == "\x00", F.unhex(F.lit("0001"))).otherwise(encode_body(F.col("body"))))
    for f in schemas.MESSAGE:
        if f.name not in message.columns:
            message = message.withColumn(f.name, F.lit(None).cast(f.dataType))
    chat = spark.createDataFrame([(10, "Team"), (11, ""), (12, None), (13, "Chat 13"), (14, " ")], schemas.CHAT)
    joins = spark.createDataFrame([(10, 1, START), (10, 2, START + MINUTE), (11, 3, START), (12, 4, 0)], schemas.CHAT_MESSAGE_JOIN)
    members = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 2), (11, 3), (12, 3), (13, 77), (11, 0)], schemas.CHAT_HANDLE_JOIN)
    record = spark.createDataFrame([("a", 1, "Ann", "Lee"), ("a", 2, "Solo", None)], schemas.CONTACT_RECORD)
    phone = spark.createDataFrame([("a", 1, 1, "555-123-4567"), ("a", 2, 2, "555-987-6543")], schemas.CONTACT_PHONE)
    email = spark.createDataFrame([], schemas.CONTACT_EMAIL)
    return PL.Sources(message.select(schemas.MESSAGE.fieldNames()), handle, chat, joins, members, record, phone, email)


AS_OF = datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def lake(spark, sources):
    return PL.build_lake(sources, as_of=F.lit("2024-02-01").cast("timestamp"))


def user(spark, handle):
    return spark.range(1).select(handle_user_id(F.lit(handle).cast("bigint"))).first()[0]


def test_plans_and_written_tables_agree(sources, lake):
    plans = PL.plan_lake(sources, as_of=F.lit("2024-02-01").cast("timestamp"))
    for name in PL.TABLES:
        assert sorted(map(str, getattr(plans, name).collect())) == sorted(map(str, getattr(lake, name).collect()))


def test_users_keep_contact_and_handle_rows(lake):
    rows = {(r["handle_id"], r["first_name"], r["phone_number"], r["email"]) for r in lake.users.collect()}
    assert rows == {(None, "Ann", "(555) 123-4567", ""), (None, "Solo", "(555) 987-6543", ""), (1, "Ann", "5551234567", ""),
                    (2, "", "", "test@example.com"), (3, "Solo", "5559876543", "")}


def test_messages(spark, lake):
    rows = {r["message_id"]: (r["user_id"], r["contents"], r["is_from_me"], r["created_at"]) for r in lake.messages.collect()}
    assert set(rows) == {1, 2, 3, 5, 7}
    assert rows[1] == (user(spark, 1), "Hello", False, datetime(2022, 8, 25, 17, 20))
    assert rows[2][1:3] == ("From blob", True) and rows[3][:2] == ("unknown_user_9", "spaced")
    assert rows[5][0] == "unknown_user_none" and rows[5][3] == AS_OF and rows[7][0] == "unknown_user_0"


def test_increment_drops_system_and_unknown_rows(sources, lake):
    got = M.incremental_sync(sources.message, lake.users, 1).collect()
    assert [r["message_id"] for r in got] == [2] and got[0]["next_mark"] == 7
    assert M.incremental_sync(sources.message, lake.users, 1, limit=1).first()["next_mark"] == 2


def test_display_names(lake):
    names = {r["chat_id"]: r["display_name"] for r in lake.chats.collect()}
    # Both names -> full name; a first name alone is ignored; unknown handles show nothing here.
    assert names == {10: "Team", 11: "Ann Lee, test@example.com, 5559876543", 12: "5559876543", 13: "Chat 13", 14: "Chat 14"}


def test_names_show_three_and_an_ellipsis(spark):
    handle = spark.createDataFrame([(i, f"h{i}", "", "") for i in range(1, 6)], schemas.HANDLE)
    members = spark.createDataFrame([(1, i) for i in range(1, 6)] + [(2, 1), (2, 2)], schemas.CHAT_HANDLE_JOIN)
    users = spark.createDataFrame([("u4", "D", "Four", "", "", 4), ("u2", "", "", "222", "x", 2)], schemas.USERS)
    chats = spark.createDataFrame([(1, ""), (2, ""), (3, "")], schemas.CHAT)
    got = {r["chat_id"]: r["generated_name"] for r in CH.generated_names(chats, members, handle, users).collect()}
    assert got == {1: "222, D Four, h1...", 2: "222, h1", 3: "Chat 3"}


def test_members_and_counts(spark, lake, sources):
    got = {(r["chat_id"], r["user_id"]) for r in lake.chat_users.collect()}
    assert got == {(c, user(spark, h)) for c, h in [(10, 1), (10, 2), (11, 1), (11, 2), (11, 3), (12, 3)]}
    stats = CH.chat_users_stats(sources.chat_handle_join, lake.users, lake.chats).first()
    assert tuple(stats) == (8, 6, 6, 3, 2)


def test_busiest_chat_of_a_name_wins(spark):
    chats = spark.createDataFrame([(1, "N"), (2, "N"), (3, "N"), (4, "M"), (5, "M"), (6, "Lonely")], schemas.CHAT)
    links = spark.createDataFrame([(c, i, AS_OF) for i, c in enumerate([1, 2, 2, 2, 3, 3, 5])], schemas.CHAT_MESSAGES)
    users = spark.createDataFrame([(2, "b"), (2, "a"), (5, "z"), (1, "q")], schemas.CHAT_USERS)
    best = {r["display_name"]: (r["chat_id"], r["user_id"], r["message_count"], r["status"])
            for r in CH.best_chat_for_name(chats, links, users).collect()}
    assert best == {"N": (2, "a", 3, "ok"), "M": (5, "z", 1, "ok"), "Lonely": (6, None, 0, "no_users")}
    assert [r["chat_id"] for r in CH.chats_by_display_name(chats, links, "N").collect()] == [2, 3, 1]


def test_history_is_oldest_first_and_checks_the_id(lake):
    rows = CH.chat_history(lake.messages, lake.chat_messages, "10").collect()
    assert [r["contents"] for r in rows] == ["Hello", "From blob"]
    with pytest.raises(ValueError):
        CH.chat_history(lake.messages, lake.chat_messages, "ten")


def test_recent_messages_direction(sources):
    def ids(**kw):
        return [r["guid"] for r in L.recent_messages(sources.message, sources.handle, 10, **kw).collect()]
    assert len(ids()) == 7 and len(ids(include_sent=False)) == 5 and len(ids(include_received=False)) == 2
    assert ids(include_sent=False, include_received=False) == []


def test_scan_chats_and_stats(sources, lake):
    report = Q.chat_migration_report(sources.chat, lake.chats, lake.chat_users).first()
    assert (report["migration_rate"], report["warnings"]) == (100.0, "2 chats have no associated users")
    coverage = Q.migration_coverage(sources.message, lake.messages).first()
    assert (coverage["eligible_messages"], coverage["target_messages"]) == (6, 5)
    assert Q.user_stats(lake.users).first().asDict() == {
        "total_users": 5, "users_with_phone": 4, "users_with_email": 1, "users_with_both": 0}


def test_sinks(spark, lake):
    path = scratch_path(spark, "t")
    for _ in range(2):
        S.overwrite(lake.messages, path)
    assert spark.read.parquet(path).count() == 5
    batch = spark.createDataFrame([(1, "x"), (99, "a"), (99, "b")], schemas.CHAT)
    have = spark.createDataFrame([(1, "kept")], schemas.CHAT)
    assert [tuple(r) for r in S.insert_ignore(have, batch, ["chat_id"]).collect()] == [(99, "a")]
    assert S.insert_strict(have, batch, ["chat_id"]).count() == 0
    assert S.insert_strict(have, batch.where("display_name = 'a'"), ["chat_id"]).count() == 1
    assert S.insert_strict(have, spark.createDataFrame([(1, "y")], schemas.CHAT), ["chat_id"]).count() == 0
    changed = S.update_by_key(batch.limit(1), spark.createDataFrame([(1, None), (5, "q")], schemas.CHAT), "chat_id", "display_name")
    assert [tuple(r) for r in changed.collect()] == [(1, None, True)]
    pairs = spark.createDataFrame([(1, "u"), (1, "v")], schemas.CHAT_USERS)
    assert S.delete_by_key(pairs, pairs.where("user_id = 'u'"), ["chat_id", "user_id"]).collect() == pairs.where("user_id = 'v'").collect()


def test_unreadable_address_book_is_skipped(spark):
    root = scratch_path(spark, "books")
    table = spark.createDataFrame([(1, "Ann", "Lee")], "z_pk bigint, first_name string, last_name string")
    table.write.parquet(f"{root}/home")
    bad = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/work/part-0.parquet")
    stream = bad.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(bad)
    stream.writeUTF("not parquet")
    stream.close()
    rows = R.read_sources(spark, [f"{root}/home", f"{root}/work"], schemas.CONTACT_RECORD).collect()
    assert [(r["source"], r["first_name"]) for r in rows] == [("home", "Ann")]


def test_replica_freshness(spark):
    rows = [(i, "t", START + i * MINUTE) for i in range(1, 21)]
    source = spark.createDataFrame(rows, "rowid bigint, text string, date bigint")
    now = "2022-08-25 17:40:00"
    fresh = Q.replica_freshness(source, source, now).first()
    assert fresh["is_fresh"] and fresh["issues"] == "" and fresh["recent_messages_count"] == 5
    late = Q.replica_freshness(source, source.where("rowid <= 17"), now).first()
    assert (late["rowid_lag"], late["is_fresh"], late["recent_message_coverage"]) == (3, False, 0.4)
    assert Q.replica_freshness(source, source.where("rowid <= 17"), now, tolerated_gap=5).first()["is_fresh"]
    assert not Q.replica_freshness(source, source.limit(0), now).first()["is_fresh"]


def test_rate_limit_window_is_open_at_its_start(spark):
    at = [0, 1, 59.999999, 60, 61, 61.000001]
    log = spark.createDataFrame([(i, "s", datetime.fromtimestamp(1_700_000_000 + s), i != 1) for i, s in enumerate(at)],
                                "send_id bigint, sender string, sent_at timestamp, success boolean")
    got = {r["send_id"]: (r["recent_sends"], r["allowed"]) for r in SL.rate_limit_audit(log, limit=2).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (1, True), 3: (1, True), 4: (2, False), 5: (3, False)}


def test_rate_limit_matches_brute_force_for_a_busy_sender(spark):
    import random
    rng = random.Random(1)
    times = sorted(rng.randrange(600_000_000) for _ in range(900))
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", t, rng.random() < 0.7) for i, t in enumerate(times)]
    log = spark.createDataFrame(rows, "send_id bigint, sender string, us bigint, success boolean").withColumn(
        "sent_at", F.timestamp_micros("us"))
    got = {r["send_id"]: r["recent_sends"] for r in SL.rate_limit_audit(log, 60, 60).collect()}
    want = {i: sum(1 for j, s2, t2, ok in rows if s2 == s and ok and j != i and t - 60_000_000 < t2 <= t) for i, s, t, _ in rows}
    assert got == want


def test_text_quality_and_integrity(spark):
    rows = [(1, "u", "plain", True, AS_OF), (2, "", "é <b>", False, None), (2, "u", "  ", None, AS_OF), (4, "u", "bad \\x41", True, AS_OF)]
    df = spark.createDataFrame(rows, "message_id bigint, user_id string, contents string, is_from_me boolean, created_at timestamp")
    quality = Q.text_quality_report(df).first()
    assert (quality["messages_with_text"], quality["contains_emojis"], quality["contains_special_chars"]) == (3, True, True)
    assert (quality["suspicious_count"], quality["suspicious_ids"]) == (1, "4")
    report = Q.integrity_report(df).first()
    assert (report["unique_message_ids"], report["invalid_timestamp_count"], report["empty_contents_count"], report["empty_user_id_count"],
            report["invalid_boolean_count"]) == (False, 1, 1, 1, 1)
    assert Q.text_quality_report(df.limit(0)).first()["average_text_length"] == 0.0


def test_reports_on_empty_tables(spark):
    empty = spark.createDataFrame([], schemas.MESSAGE)
    stats = Q.text_extraction_stats(empty).first()
    assert stats["total_messages"] == 0 and stats["text_coverage_percent"] == 0
    assert Q.user_retention(spark.createDataFrame([], schemas.USERS), spark.range(3)).first()["verdict"] == "FAIL"
