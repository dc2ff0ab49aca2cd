"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions.body import with_best_text
from chatlake.operators import chats as CH, contacts as CT, quality as Q, sendlog as SL
from chatlake.plans import recovery as RV
from chatlake.sources.readers import scan_messages
from checks.inputs import Inputs, sql_apple, sql_strip, sql_ts
from checks.registry import check

TEXT, BODY = "coalesce(text, '') <> ''", "has_body"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(({part}) * 100.0::DOUBLE / {whole}, 2) ELSE 0.0 END"


check("user_stats", lambda v: Q.user_stats(v.users), """
SELECT count(*) AS total_users, count(*) FILTER (phone_number <> '') AS users_with_phone,
  count(*) FILTER (email <> '') AS users_with_email,
  count(*) FILTER (phone_number <> '') + count(*) FILTER (email <> '') - count(*) AS users_with_both FROM users""")
check("source_stats", lambda v: Q.source_stats(v.message), """
SELECT count(*) AS message_count, count(DISTINCT handle_id) AS contact_count, min(date) AS earliest_message,
  max(date) AS latest_message FROM message""")
check("text_extraction_stats", lambda v: Q.text_extraction_stats(v.message), f"""
SELECT *, {pct('has_text_column', 'total_messages')} AS text_coverage_percent,
  {pct('has_attributed_body', 'total_messages')} AS attributed_body_coverage_percent,
  {pct('recoverable_messages', 'needs_decoding')} AS decode_success_rate
FROM (SELECT count(*) AS total_messages, count(*) FILTER ({TEXT}) AS has_text_column,
  count(*) FILTER (NOT ({TEXT})) AS null_text_column, count(*) FILTER ({BODY}) AS has_attributed_body,
  count(*) FILTER (NOT ({TEXT}) AND {BODY}) AS needs_decoding,
  count(*) FILTER (NOT ({TEXT}) AND decoded IS NOT NULL) AS recoverable_messages FROM message)""")
check("decode_stats", lambda v: Q.decode_stats(v.message), f"""
SELECT *, {pct('success_count', 'total_attempts')} AS success_rate_percent
FROM (SELECT count(decoded) AS success_count, count(*) - count(decoded) AS failure_count, count(*) AS total_attempts
  FROM message WHERE has_body)""")

check("decode_stats_documents", lambda v: Q.decode_stats(v.long_message), f"""
SELECT *, {pct('success_count', 'total_attempts')} AS success_rate_percent
FROM (SELECT count(said) AS success_count, count(*) - count(said) AS failure_count, count(*) AS total_attempts
  FROM long_message WHERE has_body)""")
check("recover_text_documents", lambda v: RV.recover_text(v.long_message).select("rowid", "text", "extracted_text"), """
SELECT rowid, text, CASE WHEN coalesce(text, '') = '' AND has_body THEN said END AS extracted_text FROM long_message""")

# The log with part of the texts recovered before.
PARTIAL = "CASE WHEN rowid % 2 = 0 AND coalesce(text, '') = '' THEN decoded END"
RECOVERED = f"""
, recovered AS (SELECT rowid, text, {BODY} AS has_body, CASE WHEN coalesce(text, '') = '' THEN decoded END AS extracted_text
  FROM message)"""


def partly_recovered(v: Inputs):
    done = RV.recover_text(v.message)
    return done.withColumn("extracted_text", F.when(F.expr("rowid % 2 = 0"), F.col("extracted_text")))


check("recovery_scope", lambda v: Q.recovery_scope(partly_recovered(v)), f"""
SELECT *, needs_migration - already_migrated AS remaining_to_migrate FROM (
  SELECT count(*) AS total_messages, count(*) FILTER ({TEXT}) AS has_text_column,
    count(*) FILTER (NOT ({TEXT}) AND {BODY}) AS needs_migration, count(*) FILTER (NOT {BODY}) AS no_attributed_body,
    count({PARTIAL}) AS already_migrated FROM message)""")
check("recover_text", lambda v: RV.recover_text(RV.recover_text(v.message)).select("rowid", "text", "extracted_text"),
      RECOVERED + " SELECT rowid, text, extracted_text FROM recovered")
VALIDATION = f"""
SELECT total_messages, {pct('has_text', 'total_messages')} AS original_text_coverage_percent,
  {pct('has_text + messages_recovered', 'total_messages')} AS new_text_coverage_percent,
  round((has_text + messages_recovered) * 100.0::DOUBLE / total_messages - has_text * 100.0::DOUBLE / total_messages, 2)
    AS coverage_improvement_percent, messages_recovered, still_missing_text, has_extracted_text
FROM (SELECT count(*) AS total_messages, count(*) FILTER ({TEXT}) AS has_text, count(extracted_text) AS has_extracted_text,
  count(extracted_text) FILTER (NOT ({TEXT})) AS messages_recovered,
  count(*) FILTER (NOT ({TEXT}) AND extracted_text IS NULL AND has_body) AS still_missing_text FROM recovered)"""
check("recovery_validation", lambda v: Q.recovery_validation(RV.recover_text(v.message)), RECOVERED + VALIDATION)
check("refresh_report", lambda v: RV.refresh_report(v.message), RECOVERED + f"""
SELECT *, (SELECT count(*) FROM message WHERE NOT ({TEXT}) AND {BODY}) AS needs_decoding,
  (SELECT count(decoded) FROM message WHERE NOT ({TEXT})) AS recoverable_messages,
  (SELECT round(count(decoded) * 100.0::DOUBLE / count(*), 2) FROM message WHERE NOT ({TEXT}) AND {BODY}) AS decode_success_rate
FROM ({VALIDATION})""")
check("migration_coverage", lambda v: Q.migration_coverage(v.message, v.messages), """
SELECT *, round(target_messages::DOUBLE / greatest(eligible_messages, 1), 6) AS migration_coverage FROM (
  SELECT (SELECT count(*) FROM message) AS source_messages,
    (SELECT count(*) FROM message WHERE text IS NOT NULL OR has_body) AS eligible_messages,
    (SELECT count(*) FROM messages) AS target_messages)""")
check("chat_migration_report", lambda v: Q.chat_migration_report(v.chat, v.chats, v.chat_users), f"""
SELECT *, {pct('target_chats', 'source_chats')} AS migration_rate,
  chats_without_users || ' chats have no associated users' AS warnings, target_chats > 0 AS validation_passed
FROM (SELECT (SELECT count(*) FROM chat) AS source_chats, (SELECT count(*) FROM chats) AS target_chats,
  (SELECT count(*) FROM chats WHERE chat_id IN (SELECT chat_id FROM chat_users)) AS chats_with_users,
  (SELECT count(*) FROM chats WHERE chat_id NOT IN (SELECT chat_id FROM chat_users)) AS chats_without_users)""")
check("contact_extraction_stats", lambda v: CT.extraction_stats(*v.book), """
SELECT count(DISTINCT source) AS total_databases, count(*) AS total_records,
  (SELECT count(DISTINCT (r.source, r.z_pk)) FROM named r JOIN phone p ON p.source = r.source AND p.owner = r.z_pk) AS records_with_phone,
  (SELECT count(DISTINCT (r.source, r.z_pk)) FROM named r JOIN email e ON e.source = r.source AND e.owner = r.z_pk) AS records_with_email,
  (SELECT count(*) FROM (SELECT DISTINCT first_name, last_name, full_number, address FROM named r
    LEFT JOIN phone p ON p.source = r.source AND p.owner = r.z_pk
    LEFT JOIN email e ON e.source = r.source AND e.owner = r.z_pk)) AS unique_contacts FROM named""")
check("contact_name_completeness", lambda v: CT.name_completeness(*v.book), """
SELECT source, count(*) FILTER (first_name IS NOT NULL AND coalesce(last_name, '') = '') AS first_only,
  count(*) FILTER (coalesce(first_name, '') = '' AND last_name IS NOT NULL) AS last_only,
  count(*) FILTER (first_name IS NOT NULL AND last_name IS NOT NULL) AS both_names
FROM record r WHERE EXISTS (SELECT 1 FROM phone p WHERE p.source = r.source AND p.owner = r.z_pk AND full_number IS NOT NULL)
  OR EXISTS (SELECT 1 FROM email e WHERE e.source = r.source AND e.owner = r.z_pk AND address IS NOT NULL)
GROUP BY source""")
check("person_contacts", lambda v: CT.person_contact_sets(*v.book), """
SELECT source, z_pk, coalesce(first_name, '') AS first_name, coalesce(last_name, '') AS last_name, kind, 0::BIGINT AS part,
  string_agg(value, '|' ORDER BY value) AS values
FROM named r JOIN (SELECT DISTINCT * FROM (
  SELECT source, owner AS z_pk, 'phone' AS kind, full_number AS value FROM phone WHERE full_number <> ''
  UNION ALL SELECT source, owner, 'email', lower(address) FROM email WHERE address <> '')) USING (source, z_pk)
GROUP BY ALL""")
check("extract_contacts", lambda v: CT.extract_contacts(*v.book).drop("load_order"), """
SELECT user_id, first_name, last_name, phone_number, email, handle_id FROM contacts""")
check("chat_with_users", lambda v: _lists(v), """
SELECT c.chat_id, c.display_name, 0::BIGINT AS part, coalesce(string_agg(u.user_id, '|' ORDER BY u.user_id), '') AS user_ids
FROM chats c LEFT JOIN chat_users u USING (chat_id) GROUP BY ALL""")


def _lists(v: Inputs):
    from chatlake.operators.lookups import chats_with_users
    return chats_with_users(v.chats, v.chat_users)


COUNTS = """, counted AS (SELECT c.chat_id, c.display_name, count(cm.message_id) AS message_count
  FROM chats c LEFT JOIN chat_messages cm USING (chat_id) GROUP BY ALL)"""
check("chats_by_display_name", lambda v: CH.chats_by_display_name(v.chats, v.chat_messages), COUNTS + " SELECT * FROM counted")
check("busiest_chat", lambda v: CH.busiest_chats(v.chat_messages, 250), """
SELECT chat_id, count(*) AS message_count FROM chat_messages GROUP BY 1 HAVING count(*) >= 250""")
check("best_chat_for_name", lambda v: CH.best_chat_for_name(v.chats, v.chat_messages, v.chat_users), COUNTS + """
SELECT display_name, chat_id, user_id, message_count, CASE WHEN user_id IS NULL THEN 'no_users' ELSE 'ok' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY display_name ORDER BY message_count DESC, chat_id) AS rn FROM counted)
LEFT JOIN (SELECT chat_id, min(user_id) AS user_id FROM chat_users GROUP BY 1) USING (chat_id) WHERE rn = 1""")
check("handle_match_stats", lambda v: Q.handle_match_stats(CT.resolve_handles(v.handle, v.contacts)),
      "SELECT match_kind, count(*) AS handles FROM resolved GROUP BY 1")
check("chat_users_stats", lambda v: CH.chat_users_stats(v.chat_handle_join, v.users, v.chats), """
SELECT count(*) AS total_relationships_found, count(*) FILTER (handle_id <> 0) AS relationships_mapped,
  (SELECT count(*) FROM chat_users) AS relationships_created,
  (SELECT count(*) FROM chats WHERE chat_id IN (SELECT chat_id FROM chat_users)) AS chats_with_users,
  (SELECT count(*) FROM chats WHERE chat_id NOT IN (SELECT chat_id FROM chat_users)) AS chats_without_users
FROM chat_handle_join""")
check("chat_display_name", lambda v: CH.generated_names(v.raw_chats, v.chat_handle_join, v.handle, v.users),
      "SELECT chat_id, generated_name FROM enhanced")
check("enhance_display_names", lambda v: v.enhanced, """
SELECT chat_id, CASE WHEN better THEN generated_name ELSE old_name END AS display_name,
  CASE WHEN better THEN 'updated' WHEN needs THEN 'skipped' ELSE 'kept' END AS outcome FROM enhanced""")
check("display_name_stats", lambda v: CH.display_name_stats(v.enhanced), """
SELECT count(*) FILTER (needs) AS chats_checked, count(*) FILTER (better) AS chats_updated,
  count(*) FILTER (needs AND NOT better) AS chats_skipped FROM enhanced""")
check("null_counts", lambda v: Q.null_counts(
    v.message.selectExpr("rowid AS message_id", "account AS user_id", "text AS contents", "date_read AS created_at")), """
SELECT count(*) FILTER (rowid IS NULL) AS null_message_id, count(*) FILTER (account IS NULL) AS null_user_id,
  count(*) FILTER (text IS NULL) AS null_contents, count(*) FILTER (date_read IS NULL) AS null_created_at FROM message""")
check("integrity_report", lambda v: Q.integrity_report(v.messages), """
SELECT count(*) AS total_messages, 0::BIGINT AS invalid_timestamp_count, 0::BIGINT AS invalid_boolean_count,
  count(*) FILTER (trim(contents) = '') AS empty_contents_count, count(*) FILTER (trim(user_id) = '') AS empty_user_id_count,
  count(*) = count(DISTINCT message_id) AS unique_message_ids, true AS valid_timestamps, true AS non_empty_contents FROM messages""")
check("integrity_report_doubled", lambda v: Q.integrity_report(
    v.message.unionByName(v.message).selectExpr(
        "rowid AS message_id", "coalesce(account, '') AS user_id", "coalesce(text, '') AS contents",
        "is_from_me <> 0 AS is_from_me", "timestamp_micros(date_read) AS created_at")), """
SELECT 2 * count(*) AS total_messages, 2 * count(*) FILTER (date_read IS NULL) AS invalid_timestamp_count,
  0::BIGINT AS invalid_boolean_count, 2 * count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_contents_count,
  0::BIGINT AS empty_user_id_count, false AS unique_message_ids,
  count(*) FILTER (date_read IS NULL) = 0 AS valid_timestamps,
  count(*) FILTER (trim(coalesce(text, '')) = '') = 0 AS non_empty_contents FROM message""")
QUALITY = """
SELECT count(*) AS total_messages_analyzed, count(*) FILTER (filled) AS messages_with_text,
  round(avg(length(contents)) FILTER (filled), 6) AS average_text_length, bool_or(filled AND NOT regexp_full_match(contents, '[\\x00-\\x7f]*', 's')) AS contains_emojis,
  bool_or(filled AND regexp_matches(contents, '[''"&<>]')) AS contains_special_chars, 0::BIGINT AS encoding_error_count,
  count(*) FILTER (filled AND doubtful) AS suspicious_count,
  coalesce((SELECT string_agg(message_id::VARCHAR, ',' ORDER BY message_id) FROM (SELECT message_id FROM texts WHERE filled AND doubtful
    ORDER BY message_id LIMIT 10)), '') AS suspicious_ids FROM texts"""
DOUBTFUL = """contents LIKE '%\\x%' OR contents LIKE '%\\u%' OR contents LIKE '%' || chr(65533) || '%'
  OR regexp_full_match(left(contents, 10), '[\\x00-\\x1f]+') AS doubtful"""
check("text_quality_report", lambda v: Q.text_quality_report(v.messages), f"""
, texts AS (SELECT message_id, contents, {sql_strip('contents')} <> '' AS filled, {DOUBTFUL} FROM messages)""" + QUALITY)
check("text_quality_report_documents", lambda v: Q.text_quality_report(
    v.table("documents").selectExpr("doc_id AS message_id", "text AS contents")), f"""
, texts AS (SELECT doc_id AS message_id, text AS contents, {sql_strip('text')} <> '' AS filled,
  {DOUBTFUL.replace('contents', 'text')} FROM documents)""" + QUALITY)
check("completeness_report", lambda v: Q.completeness_report(v.message, scan_messages(v.message), v.messages), f"""
SELECT *, matching_texts AS matching_texts, CASE WHEN migration_coverage > 0.8 THEN 'PASS' ELSE 'PASS_WITH_WARNINGS' END AS overall_status
FROM (SELECT (SELECT count(*) FROM message WHERE text IS NOT NULL OR has_body) AS source_message_count,
  (SELECT count(*) FROM messages) AS target_message_count,
  round((SELECT count(*) FROM messages)::DOUBLE / (SELECT count(*) FROM message WHERE text IS NOT NULL OR has_body), 6) AS migration_coverage,
  (SELECT count(*) FROM extracted WHERE {sql_strip('extracted_text')} <> '') AS source_texts,
  (SELECT count(*) FROM extracted WHERE extracted_text IN (SELECT contents FROM messages)) AS matching_texts)""".replace(
    "SELECT *, matching_texts AS matching_texts,", "SELECT *,"))
check("user_retention", lambda v: Q.user_retention(v.users.where("handle_id IS NULL"), v.contacts), """
SELECT count(*) AS stored, count(*) AS extracted, 1.0::DOUBLE AS retention, 'PASS' AS verdict FROM contacts""")
check("user_field_check", lambda v: Q.user_field_check(v.users), """
SELECT count(*) FILTER (user_id = '') AS missing_id, count(*) FILTER (first_name = '' AND last_name = '') AS missing_name,
  count(*) FILTER (phone_number = '' AND email = '') AS missing_contact_point FROM users""")
check("user_link_stats", lambda v: Q.user_link_stats(v.users), """
SELECT count(handle_id) AS with_handle, count(*) - count(handle_id) AS without_handle FROM users""")
check("send_log_metrics", lambda v: SL.send_log_metrics(v.send_log), f"""
SELECT sender, count(*) AS total_attempts, count(*) FILTER (success) AS successful_sends,
  count(*) FILTER (NOT success) AS failed_sends, round(count(*) FILTER (success) / count(*), 6) AS success_rate,
  sum(retry_count)::BIGINT AS total_retries, round(coalesce(avg(duration_seconds) FILTER (success), 0), 6) AS average_duration_seconds,
  {sql_ts('max(sent_at) FILTER (success)')} AS last_send_time FROM send_log GROUP BY sender""")
check("rate_limit_audit", lambda v: SL.rate_limit_audit(v.send_log, limit=3, window_seconds=86_400), f"""
SELECT send_id, sender, {sql_ts('sent_at')} AS sent_at, success, recent_sends, recent_sends < 3 AS allowed FROM (
  SELECT *, (count(*) FILTER (success) OVER (PARTITION BY sender ORDER BY epoch_us(sent_at)
    RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)) - success::BIGINT AS recent_sends FROM send_log)""")
check("send_log_report", lambda v: SL.send_log_report(v.send_log, 12), f"""
SELECT regexp_full_match(recipient, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')
    OR regexp_full_match(regexp_replace(recipient, '[^0-9+]', '', 'g'), '\\+?1?[0-9]{{10,15}}') AS valid_recipient,
  CASE WHEN contents = '' THEN 'empty' WHEN length(contents) > 12 THEN 'too_long' WHEN trim(contents) = '' THEN 'blank' ELSE 'ok' END AS content_check,
  CASE WHEN error_message IS NULL THEN 'none' WHEN error_message IN ('Network timeout', 'Connection refused') THEN 'network'
    WHEN error_message = 'Permission denied' THEN 'auth' WHEN error_message = 'Rate exceeded' THEN 'rate' ELSE 'other' END AS error_class,
  count(*) AS attempts FROM send_log GROUP BY ALL""")
check("freshness_summary", lambda v: Q.freshness_summary(v.table("events").selectExpr(
    "event_type <> 'error' AS success", "value < 50 AS is_fresh", "value AS copy_seconds", "event_id % 7 AS rowid_lag")), """
SELECT count(*) AS tests, count(*) FILTER (event_type <> 'error' AND value < 50) AS fresh,
  round(count(*) FILTER (event_type <> 'error' AND value < 50) / count(*), 6) AS fresh_rate,
  round(avg(value) FILTER (event_type <> 'error'), 6) AS average_copy_seconds,
  max(event_id % 7) FILTER (event_type <> 'error') AS max_rowid_lag FROM events""")
check("replica_freshness", lambda v: Q.replica_freshness(
    v.message, v.copy, "2024-01-30 00:00:00", minutes=2880, copied_at="2024-01-29 23:59:00"), """
SELECT s.m AS source_max_rowid, c.m AS copy_max_rowid, recent AS recent_messages_count, found AS recent_messages_in_copy,
  60.0::DOUBLE AS copy_age_seconds, s.m - c.m AS rowid_lag, round(found::DOUBLE / recent, 6) AS recent_message_coverage,
  false AS is_fresh, 'Copy missing ' || (s.m - c.m) || ' recent ROWIDs; Copy is too old' AS issues
FROM (SELECT max(rowid) AS m FROM message) s, (SELECT max(rowid) AS m FROM copy) c,
  (SELECT count(*) AS recent, count(*) FILTER (rowid IN (SELECT rowid FROM copy)) AS found FROM message
   WHERE date > (epoch_us(TIMESTAMP '2024-01-28') - 978307200000000) * 1000)""")


def _expected_members(v: Inputs):
    expected = v.table("customer").selectExpr(
        "CASE WHEN c_custkey % 2 = 0 THEN concat('NATION_', (1 + c_custkey div 4) % 25) ELSE 'NATION_1' END AS display_name",
        "'customer' AS first_name", "c_mktsegment AS last_name").distinct()
    return Q.named_member_check(expected, v.chats, v.chat_users, v.users)


check("named_member_check", _expected_members, """
SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'NATION_' || ((1 + c_custkey // 4) % 25) ELSE 'NATION_1' END AS display_name,
  'customer' AS first_name, lower(c_mktsegment) AS last_name FROM customer
EXCEPT SELECT display_name, lower(first_name), lower(last_name) FROM chats JOIN chat_users USING (chat_id) JOIN users USING (user_id)""")
check("named_handle_check", lambda v: Q.named_handle_check(v.table("customer").selectExpr(
    "c_custkey AS handle_id", "'CUSTOMER' AS first_name", "c_mktsegment AS last_name"), v.users), """
SELECT c_custkey AS handle_id, 'customer' AS first_name, lower(c_mktsegment) AS last_name FROM customer
EXCEPT SELECT handle_id, lower(first_name), lower(last_name) FROM users WHERE handle_id IS NOT NULL""")
check("chat_samples", lambda v: CH.chat_samples(v.chats, v.chat_users, v.users, 5), """
SELECT c.chat_id, display_name, user_id, first_name || ' ' || last_name AS name, phone_number AS phone, email
FROM (SELECT * FROM chats ORDER BY chat_id LIMIT 5) c LEFT JOIN (chat_users JOIN users USING (user_id)) USING (chat_id)""")
check("notification_rows", lambda v: Q.notification_rows(with_best_text(v.message, "extracted_text"), v.users, 5), f"""
SELECT rowid, CASE WHEN is_from_me = 1 THEN 'You' WHEN coalesce(m.handle_id, 0) = 0 THEN 'Unknown'
    WHEN first_name <> '' OR last_name <> '' THEN trim(first_name || ' ' || last_name)
    WHEN phone_number <> '' THEN phone_number WHEN email <> '' THEN email ELSE 'Handle ' || m.handle_id END AS sender,
  strftime({sql_apple('date')}, '%I:%M:%S %p') AS time,
  trim(coalesce(nullif(extracted_text, ''), nullif(text, ''), '[No content]')) AS content,
  (SELECT count(*) FROM message) - 5 AS more
FROM (SELECT * FROM extracted ORDER BY rowid LIMIT 5) m LEFT JOIN users u ON u.handle_id = m.handle_id""")
