"""Scans, sinks, lookups, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.functions import records as RC
from chatlake.functions.contact import normalize_phone
from chatlake.operators import chats as CH, contacts as CT, lookups as L, messages as M, quality as Q
from chatlake.session import scratch_path
from chatlake.sources import readers as R, sinks as S
from checks.inputs import (
    Inputs, sql_apple, sql_national, sql_normal_phone, sql_strip, sql_ts,
)
from checks.registry import check

USER = "user_id, first_name, last_name, phone_number, email, handle_id"
MESSAGE = f"message_id, user_id, contents, is_from_me, {sql_ts('created_at')} AS created_at"
LISTED = (f"rowid, guid, h.id AS handle, text, {sql_ts(sql_apple('date'))} AS date, "
          f"{sql_ts(sql_apple('date_read'))} AS date_read, {sql_ts(sql_apple('date_delivered'))} AS date_delivered, "
          "is_from_me <> 0 AS is_from_me, m.service")

# Scans.

check("scan_messages", lambda v: R.scan_messages(v.message), """
SELECT rowid, guid, text, extracted_text, handle_id, date, date_read, is_from_me <> 0 AS is_from_me, service,
  has_body AS has_attributed_body,
  CASE WHEN trim(text) <> '' THEN 'text_column' WHEN extracted_text <> '' AND has_body THEN 'attributed_body_decoded'
       WHEN has_body THEN 'attributed_body_failed' ELSE 'no_text_available' END AS text_source
FROM extracted""")
check("scan_handles", lambda v: R.scan_handles(v.handle), "SELECT handle_id, id FROM handle")
check("scan_chats", lambda v: R.scan_chats(v.chat), "SELECT chat_id, display_name FROM raw_chats")
check("scan_chat_messages", lambda v: R.scan_chat_messages(v.chat_message_join), f"""
SELECT chat_id, message_id, {sql_ts(sql_apple('message_date'))} AS message_date FROM chat_message_join""")
check("scan_chat_handles", lambda v: R.scan_chat_handles(v.chat_handle_join), "SELECT chat_id, handle_id FROM chat_handle_join")
check("scan_contacts", lambda v: CT.scan_contacts(*v.book), """
SELECT r.source, r.z_pk, r.first_name, r.last_name, p.kind, p.value FROM record r LEFT JOIN (
  SELECT source, owner, 'phone' AS kind, full_number AS value FROM phone WHERE full_number IS NOT NULL
  UNION ALL SELECT source, owner, 'email', address FROM email WHERE address IS NOT NULL
) p ON p.source = r.source AND p.owner = r.z_pk""")
check("scan_accounts", lambda v: R.scan_accounts(v.account), "SELECT * FROM account")
check("view_message_compat", lambda v: R.message_view(v.messages), f"""
SELECT message_id AS rowid, message_id, user_id, contents AS text, NULL::VARCHAR AS attributed_body,
  0::BIGINT AS handle_id, {sql_ts('created_at')} AS date, NULL::BIGINT AS date_read, is_from_me,
  'iMessage' AS service, NULL::VARCHAR AS guid FROM messages""")

# Sinks: write, write again, read back.


def _sink_overwrite(v: Inputs):
    path = scratch_path(v.spark, "overwrite")
    for _ in range(2):
        S.overwrite(v.messages, path)
    return R.read_table(v.spark, path, schemas.MESSAGES)


def _sink_insert_ignore(v: Inputs):
    """The replica first, then the whole log over it, then the whole log again."""
    path = scratch_path(v.spark, "ignore")
    S.overwrite(v.copy.select("rowid", "handle_id", "date"), path)
    whole = v.message.select("rowid", "handle_id", "date")
    for _ in range(2):
        S.append(S.insert_ignore(v.spark.read.parquet(path), whole.unionByName(whole), ["rowid"]), path)
    return v.spark.read.parquet(path)


def _sink_update(v: Inputs):
    root = scratch_path(v.spark, "update")
    S.publish(v.raw_chats, root, 1)
    current = S.read_version(v.spark, root, 1, schemas.CHATS)
    new = CH.generated_names(current, v.chat_handle_join, v.handle, v.users).where("chat_id < 1000000000").select(
        "chat_id", F.col("generated_name").alias("display_name"))
    S.publish(S.update_by_key(current, new, "chat_id", "display_name"), root, 2)
    return v.spark.read.parquet(f"{root}/version=2")


def _sink_delete(v: Inputs):
    """Remove each chat's smallest user."""
    gone = v.chat_users.groupBy("chat_id").agg(F.min("user_id").alias("user_id"))
    root = scratch_path(v.spark, "delete")
    S.publish(v.chat_users, root, 1)
    kept = S.delete_by_key(S.read_version(v.spark, root, 1, schemas.CHAT_USERS), gone, ["chat_id", "user_id"])
    S.publish(kept, root, 2)
    return S.read_version(v.spark, root, 2, schemas.CHAT_USERS)


check("sink_overwrite", _sink_overwrite, f"SELECT {MESSAGE} FROM messages")
check("sink_insert_ignore", _sink_insert_ignore, "SELECT rowid, handle_id, date FROM message")


def _sink_strict(v: Inputs):
    """A batch into a filled table, one that meets a taken key, and one that repeats a key."""
    path = scratch_path(v.spark, "strict")
    S.overwrite(v.raw_chats.where("chat_id % 2 = 0"), path)
    S.append_strict(v.raw_chats.where("chat_id % 2 <> 0"), path, ["chat_id"])
    S.append_strict(v.raw_chats.where("chat_id % 3 = 0").withColumn("display_name", F.lit("taken")), path, ["chat_id"])
    new = v.raw_chats.withColumn("chat_id", F.col("chat_id") + 5_000_000_000)
    return S.append_strict(new.unionByName(new.limit(1)), path, ["chat_id"])


def _sink_append_users(v: Inputs):
    path = scratch_path(v.spark, "users")
    S.overwrite(v.users, path)
    S.append(v.users.where("handle_id IS NOT NULL"), path)
    return v.spark.read.schema(v.users.schema).parquet(path)


check("sink_insert_strict", _sink_strict, "SELECT chat_id, display_name FROM raw_chats")
check("sink_append_users", _sink_append_users,
      f"SELECT {USER} FROM users UNION ALL SELECT {USER} FROM users WHERE handle_id IS NOT NULL")
check("update_by_key", _sink_update, """
SELECT c.chat_id, coalesce(g.generated_name, c.display_name) AS display_name, g.chat_id IS NOT NULL AS matched
FROM raw_chats c LEFT JOIN generated g USING (chat_id)""")
check("delete_by_key", _sink_delete, """
SELECT chat_id, user_id FROM chat_users
WHERE (chat_id, user_id) NOT IN (SELECT (chat_id, min(user_id)) FROM chat_users GROUP BY chat_id)""")
check("json_records", lambda v: v.direct.select(
    "chat_id", "message_id",
    RC.record_json(F.col("chat_id"), F.col("user_id"), F.col("contents")).alias("request_json")).withColumns({
        "parsed_chat_id": RC.parse_record(F.col("request_json"), schemas.REQUEST)["chat_id"],
        "parsed_contents": RC.parse_record(F.col("request_json"), schemas.REQUEST)["contents"]}), """
SELECT chat_id, message_id,
  to_json({'chat_id': chat_id, 'user_id': user_id, 'contents': contents})::VARCHAR AS request_json,
  chat_id AS parsed_chat_id, contents AS parsed_contents FROM direct""")

# Lookups and filters.

check("users_by_id", lambda v: L.users_by_id(v.users, v.handle.select(CT.handle_user_id(F.col("handle_id")))),
      f"SELECT {USER} FROM users WHERE user_id IN (SELECT md5('handle:' || handle_id) FROM handle)")
check("users_by_phone", lambda v: L.users_by_phone(v.users, v.handle.select(normalize_phone(F.col("id")))),
      f"SELECT {USER} FROM users WHERE phone_number IN (SELECT {sql_normal_phone('id')} FROM handle)")
check("users_by_email", lambda v: L.users_by_email(v.users, v.handle.select(F.upper("id"))),
      f"SELECT {USER} FROM users WHERE email IN (SELECT lower(upper(id)) FROM handle)")
check("users_by_handle", lambda v: L.users_by_handle(v.users, v.chat_handle_join.select("handle_id")),
      f"SELECT {USER} FROM users WHERE handle_id IN (SELECT handle_id FROM chat_handle_join)")
check("all_users", lambda v: L.all_users(v.users, 0), f"SELECT {USER} FROM users")
check("message_by_id", lambda v: L.messages_by_id(v.messages, v.chat_message_join.select("message_id")),
      f"SELECT {MESSAGE} FROM messages WHERE message_id IN (SELECT message_id FROM chat_message_join)")
check("messages_by_user", lambda v: L.newest_per_user(v.messages, 10), f"""
SELECT * FROM (SELECT {MESSAGE}, row_number() OVER (
  PARTITION BY user_id ORDER BY messages.created_at DESC, message_id DESC) AS position FROM messages) WHERE position <= 10""")
check("all_messages", lambda v: L.all_messages(v.messages), f"SELECT {MESSAGE} FROM messages")
check("recent_messages", lambda v: L.recent_messages(v.message, v.handle, 25, include_sent=False), f"""
SELECT {LISTED} FROM message m LEFT JOIN handle h USING (handle_id) WHERE is_from_me = 0
ORDER BY m.date DESC, rowid DESC LIMIT 25""")
check("search_messages", lambda v: L.search_messages(v.message, v.handle, 'CLICK%"K": 1', 100), f"""
SELECT {LISTED} FROM message m LEFT JOIN handle h USING (handle_id) WHERE lower(text) LIKE '%click%"k": 1%'
ORDER BY m.date DESC, rowid DESC LIMIT 100""")
check("search_any_term",
      lambda v: L.search_any_term(v.message, ["Click", "SIGN", '"k": 7']).select("rowid", "text", "term"), """
SELECT rowid, text, term FROM message, (VALUES ('Click'), ('SIGN'), ('"k": 7')) t(term)
WHERE lower(text) LIKE '%' || lower(term) || '%'""")
check("filter_has_body", lambda v: L.has_body(v.message).select("rowid", "text"),
      "SELECT rowid, text FROM message WHERE text IS NOT NULL OR has_body")
check("filter_needs_recovery",
      lambda v: L.needs_recovery(v.message.withColumn("extracted_text", F.lit(None).cast("string"))).select("rowid"),
      "SELECT rowid FROM message WHERE coalesce(text, '') = '' AND has_body")
check("filter_system_rows", lambda v: L.drop_system_rows(v.message).select("rowid", "handle_id"),
      "SELECT rowid, handle_id FROM message WHERE coalesce(handle_id, 0) <> 0")
check("filter_blank_contents", lambda v: L.drop_blank(v.message, "text").select("rowid", "text"),
      f"SELECT rowid, text FROM message WHERE {sql_strip('text')} <> ''")
check("recent_since", lambda v: L.recent_since(v.message, "2024-01-30 12:00:00", 24 * 60), f"""
SELECT rowid, left(coalesce(text, ''), 100) AS text, {sql_ts(sql_apple('date'))} AS timestamp,
  is_from_me <> 0 AS is_from_me, handle_id FROM message
WHERE date > (epoch_us(TIMESTAMP '2024-01-29 12:00:00') - 978307200000000) * 1000 ORDER BY rowid DESC LIMIT 100""")
check("created_after", lambda v: L.created_after(v.messages, "2024-01-15 00:00:00"),
      f"SELECT {MESSAGE} FROM messages WHERE messages.created_at > TIMESTAMP '2024-01-15'")
check("chat_by_id", lambda v: L.chat_by_id(v.chats, v.chat_users, v.chat_handle_join.select("chat_id")), """
SELECT c.chat_id, c.display_name, 0::BIGINT AS part, string_agg(u.user_id, '|' ORDER BY u.user_id) AS user_ids
FROM chats c JOIN chat_users u USING (chat_id) GROUP BY ALL""")

# Joins.

check("message_handle_left", lambda v: M.message_handle_left(v.message, v.handle).drop("attributed_body"), """
SELECT rowid AS message_id, text, m.handle_id, is_from_me, date, h.id AS handle_identifier
FROM message m LEFT JOIN handle h USING (handle_id)""")
check("messages_in_chat", lambda v: CH.newest_per_chat(v.messages, v.chat_messages, 20), f"""
SELECT chat_id, message_id, user_id, contents, is_from_me, {sql_ts('created_at')} AS created_at,
  {sql_ts('message_date')} AS message_date
FROM messages JOIN (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY message_date DESC, message_id DESC) AS rn
  FROM chat_messages) USING (message_id) WHERE rn <= 20""")
check("chat_history", lambda v: CH.chat_history(v.messages, v.chat_messages), f"""
SELECT chat_id, message_id, contents, is_from_me, {sql_ts('created_at')} AS created_at FROM in_chats""")
check("chats_for_message", lambda v: CH.chats_for_messages(v.chats, v.chat_messages, v.messages.select("message_id")),
      f"""SELECT message_id, chat_id, display_name, {sql_ts('message_date')} AS message_date
FROM chat_messages JOIN chats USING (chat_id) WHERE message_id IN (SELECT message_id FROM messages)""")
MEMBERS = """SELECT c.chat_id, c.display_name, 0::BIGINT AS part, string_agg(u.user_id, '|' ORDER BY u.user_id) AS user_ids
FROM chats c JOIN chat_users u USING (chat_id)"""


def _some_users(v: Inputs) -> list[str]:
    """Three users who are given by their place in the table."""
    return [r["user_id"] for r in v.chat_users.select("user_id").distinct().orderBy("user_id").limit(3).collect()]


check("chats_for_user", lambda v: CH.chats_for_user(v.chats, v.chat_users, _some_users(v)), MEMBERS + """
WHERE c.chat_id IN (SELECT chat_id FROM chat_users WHERE user_id IN (
  SELECT DISTINCT user_id FROM chat_users ORDER BY user_id LIMIT 3)) GROUP BY ALL""")
check("chats_for_users", lambda v: CH.chats_for_users(v.chats, v.chat_users, v.users.select("user_id")), """
SELECT u.user_id, c.chat_id, c.display_name, (SELECT count(*) FROM chat_users o WHERE o.chat_id = c.chat_id) AS members
FROM chat_users u JOIN chats c USING (chat_id)""")
check("chat_users_details", lambda v: CH.chat_users_details(v.chat_users, v.users), f"""
SELECT chat_id, {USER} FROM chat_users JOIN users USING (user_id)""")
check("chat_transcript", lambda v: M.chat_transcript(v.messages, v.users, v.chat_messages), f"""
SELECT chat_id, message_id, first_name, last_name, contents, is_from_me, {sql_ts('created_at')} AS created_at
FROM in_chats JOIN users USING (user_id)""")

LOOKUP = f""", points AS (
  SELECT source, owner, {sql_national('full_number')} AS key, source || ':0:' || lpad(point_id::VARCHAR, 12, '0') AS seen FROM phone
  UNION ALL SELECT source, owner, lower(address), source || ':1:' || lpad(point_id::VARCHAR, 12, '0') FROM email),
lookup AS (
  SELECT key, first_name, last_name, CASE WHEN first_name <> '' AND last_name <> '' THEN first_name || ' ' || last_name
    WHEN first_name <> '' THEN first_name WHEN last_name <> '' THEN last_name END AS full_name
  FROM (SELECT key, first_name, last_name, row_number() OVER (PARTITION BY key ORDER BY seen DESC) AS rn
    FROM points p JOIN record r ON r.source = p.source AND r.z_pk = p.owner WHERE key <> '') WHERE rn = 1),
hits AS (
  SELECT h.*, CASE WHEN a.key IS NOT NULL THEN 0 WHEN b.key IS NOT NULL THEN 1 WHEN c.key IS NOT NULL THEN 2 END AS level,
    a AS r0, b AS r1, c AS r2
  FROM handle h LEFT JOIN lookup a ON a.key = h.id
  LEFT JOIN lookup b ON h.id SIMILAR TO '.*[0-9].*' AND b.key = {sql_national('h.id')}
  LEFT JOIN lookup c ON c.key = lower(h.id)),
cascade AS (
  SELECT handle_id, id, country, service,
    CASE level WHEN 0 THEN r0.first_name WHEN 1 THEN r1.first_name WHEN 2 THEN r2.first_name END AS contact_first_name,
    CASE level WHEN 0 THEN r0.last_name WHEN 1 THEN r1.last_name WHEN 2 THEN r2.last_name END AS contact_last_name,
    CASE level WHEN 0 THEN r0.full_name WHEN 1 THEN r1.full_name WHEN 2 THEN r2.full_name END AS contact_full_name
  FROM hits)"""
WIDE = LOOKUP + """, wide AS (
SELECT rowid AS message_id, guid, text, date, date_read, date_delivered, is_from_me, is_read, is_delivered::BIGINT AS is_delivered,
  is_sent, m.service, account, error, m.handle_id, c.id AS contact_id, c.id AS phone_email, c.country,
  c.service AS service_type, contact_first_name, contact_last_name, contact_full_name
FROM message m LEFT JOIN cascade c ON c.handle_id = m.handle_id)"""


def wide(v: Inputs):
    return M.wide_messages(v.message, v.handle, *v.book)


check("contact_lookup_build", lambda v: CT.contact_lookup(*v.book), LOOKUP + " SELECT * FROM lookup")
check("contact_lookup_cascade", lambda v: CT.lookup_cascade(v.handle, CT.contact_lookup(*v.book)),
      LOOKUP + " SELECT * FROM cascade")
check("wide_messages", wide, WIDE + " SELECT * FROM wide")
check("wide_stats", lambda v: Q.wide_stats(wide(v)), WIDE + """
SELECT count(*) AS total_messages, count(*) FILTER (is_from_me = 1) AS sent_messages,
  count(*) FILTER (is_from_me = 0) AS received_messages, count(DISTINCT phone_email) AS unique_contacts FROM wide""")
check("wide_services", lambda v: Q.wide_services(wide(v)),
      WIDE + " SELECT service_type, count(*) AS messages FROM wide GROUP BY 1")
check("person_rows_left2", lambda v: CT.person_rows(*v.book), """
SELECT DISTINCT r.source, r.z_pk, first_name, last_name, full_number, address FROM named r
LEFT JOIN phone p ON p.source = r.source AND p.owner = r.z_pk
LEFT JOIN email e ON e.source = r.source AND e.owner = r.z_pk""")
check("resolve_handles", lambda v: CT.resolve_handles(v.handle, v.contacts),
      f"SELECT {USER}, match_kind FROM resolved")
check("resolve_handles_existing",
      lambda v: CT.resolve_handles(v.handle, v.contacts, v.users.where("handle_id IS NULL OR phone_number <> ''")), f"""
SELECT {USER}, CASE WHEN phone_number <> '' THEN 'existing' ELSE match_kind END AS match_kind FROM resolved""")
check("resolve_handle_from_source",
      lambda v: CT.resolve_handle_ids(v.message.select("handle_id").distinct(), v.handle, v.contacts),
      f"SELECT {USER}, match_kind FROM resolved WHERE handle_id IN (SELECT handle_id FROM message)")
check("map_message_user", lambda v: M.map_message_user(v.message, v.users).select("rowid", "handle_id", "user_id"), """
SELECT rowid, m.handle_id, coalesce(user_id, 'unknown_user_' || coalesce(m.handle_id::VARCHAR, 'none')) AS user_id
FROM message m LEFT JOIN users u ON u.handle_id = m.handle_id""")
check("chat_users_build", lambda v: CH.chat_users_build(v.chat_handle_join, v.users), "SELECT * FROM chat_users")
check("chats_without_users", lambda v: CH.chats_without_members(v.chats, v.chat_users).agg(F.count("*").alias("chats")),
      "SELECT count(*) AS chats FROM chats WHERE chat_id NOT IN (SELECT chat_id FROM chat_users)")
check("chats_with_users", lambda v: CH.chats_with_members(v.chats, v.chat_users).agg(F.count("*").alias("chats")),
      "SELECT count(*) AS chats FROM chats WHERE chat_id IN (SELECT chat_id FROM chat_users)")
check("active_contacts", lambda v: M.active_contacts(v.message, v.handle),
      "SELECT DISTINCT id FROM handle WHERE handle_id IN (SELECT handle_id FROM message)")
check("contact_conversation", lambda v: L.contact_conversations(v.message, v.handle, 15), f"""
SELECT {LISTED} FROM (SELECT *, row_number() OVER (PARTITION BY handle_id ORDER BY date DESC, rowid DESC) AS rn FROM message) m
JOIN handle h USING (handle_id) WHERE rn <= 15""")
check("recent_in_copy", lambda v: Q.recent_in_copy(v.message, v.copy), """
SELECT count(*) AS recent_messages_count, count(*) FILTER (rowid IN (SELECT rowid FROM copy)) AS recent_messages_in_copy
FROM message""")
check("orphan_messages", lambda v: M.orphan_messages(v.messages, v.users),
      f"SELECT {MESSAGE} FROM messages WHERE user_id NOT IN (SELECT user_id FROM users)")
check("chat_handles_named", lambda v: CH.chat_handles_named(v.chat_handle_join, v.handle), """
SELECT chat_id, handle_id, id AS handle_identifier FROM chat_handle_join JOIN handle USING (handle_id)""")

# Sorts and set operations.

check("topk_newest", lambda v: L.topk_newest(v.message, 50).select("rowid", "date"),
      "SELECT rowid, date FROM message ORDER BY date DESC, rowid DESC LIMIT 50")
check("topk_then_asc", lambda v: L.topk_then_asc(v.messages, 50),
      f"SELECT {MESSAGE} FROM messages ORDER BY messages.created_at DESC, message_id DESC LIMIT 50")
check("bounded_increment", lambda v: L.bounded_increment(v.message, 400, 100).select("rowid", "date"),
      "SELECT rowid, date FROM message WHERE rowid > 400 ORDER BY rowid LIMIT 100")


def _books(v: Inputs):
    """Each address book extracted on its own, then merged."""
    record, phone, email = v.book
    books = [
        CT.extract_contacts(*(t.where(F.col("source") == name) for t in (record, phone, email)))
        for name in ("book_0", "book_1", "book_2", "book_3")
    ]
    merged = CT.union_sources_dedup(*books)
    return merged.select("first_name", "last_name", "phone_number", "email", "load_order.source", "load_order.z_pk")


check("union_sources_dedup", _books, """
SELECT first_name, last_name, phone_number, email, split_part(load_order, ':', 1) AS source,
  split_part(load_order, ':', 2)::BIGINT AS z_pk FROM contacts""")
