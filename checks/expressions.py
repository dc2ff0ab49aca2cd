"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions import contact as C, records as RC, text as X, time as TM
from chatlake.functions.body import with_best_text, with_marked_text
from chatlake.operators import quality as Q
from checks.inputs import (
    Inputs, sql_apple, sql_digits, sql_national, sql_normal_phone, sql_phone10, sql_strip, sql_ts,
)
from checks.registry import check

# Every phone, e-mail and handle of the inputs.
POINTS = """, points AS (SELECT full_number AS value FROM phone UNION ALL SELECT address FROM email
  UNION ALL SELECT id FROM handle)"""


def points(v: Inputs):
    return v.phone.select(F.col("full_number").alias("value")).unionByName(
        v.email.select(F.col("address").alias("value"))).unionByName(v.handle.select(F.col("id").alias("value")))


def over_points(name: str, expression, sql: str) -> None:
    check(name, lambda v: points(v).select("value", expression(F.col("value")).alias("result")),
          POINTS + f" SELECT value, {sql} AS result FROM points")


def spelled(d: str) -> list[str]:
    a, b, c = f"substr({d},1,3)", f"substr({d},4,3)", f"substr({d},7,4)"
    return [d, f"'(' || {a} || ') ' || {b} || '-' || {c}", f"{a} || '-' || {b} || '-' || {c}",
            f"{a} || '.' || {b} || '.' || {c}", f"'+1' || {d}", f"'1' || {d}"]


DIALLED = "regexp_replace(value, '[^0-9+]', '', 'g')"

over_points("normalize_phone", C.normalize_phone, sql_normal_phone("value"))
over_points("phone_digits", C.phone_digits, sql_national("value"))
over_points("phone_from_handle", C.phone_from_handle, sql_phone10("value"))
over_points("phone_formats", C.phone_formats,
            f"CASE WHEN coalesce(value, '') = '' THEN '' WHEN {sql_phone10('value')} IS NULL THEN value ELSE "
            + " || '|' || ".join(f"({s})" for s in spelled(sql_phone10("value"))) + " END")
over_points("looks_like_phone", C.looks_like_phone, f"length({sql_digits('value')}) >= 10")
over_points("looks_like_email", C.looks_like_email, "coalesce(value LIKE '%@%' AND value LIKE '%.%', false)")
over_points("normalize_email", C.normalize_email, f"coalesce(lower({sql_strip('value')}), '')")
over_points("format_e164", C.format_e164, f"""CASE WHEN {DIALLED} LIKE '+%' THEN {DIALLED}
  WHEN length({DIALLED}) = 10 THEN '+1' || {DIALLED}
  WHEN length({DIALLED}) = 11 AND {DIALLED} LIKE '1%' THEN '+' || {DIALLED} ELSE value END""")
over_points("valid_phone", C.valid_phone, f"""coalesce(CASE WHEN {DIALLED} LIKE '+%'
  THEN length({DIALLED}) >= 11 AND regexp_full_match(substr({DIALLED}, 2), '[0-9]+')
  ELSE length({DIALLED}) IN (10, 11) AND regexp_full_match({DIALLED}, '[0-9]+') END, false)""")
over_points("valid_recipient", C.valid_recipient, f"""coalesce(
  regexp_full_match({sql_strip('value')}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')
  OR regexp_full_match({DIALLED}, '\\+?1?[0-9]{{10,15}}'), false)""")
check("messaging_contact",
      lambda v: v.users.select("user_id", "phone_number", C.messaging_contact(F.col("phone_number")).alias("contact")), """
SELECT user_id, phone_number, CASE WHEN phone_number = '' THEN NULL WHEN d LIKE '+%' THEN d
  WHEN length(d) = 10 THEN '+1' || d WHEN length(d) = 11 AND d LIKE '1%' THEN '+' || d ELSE phone_number END AS contact
FROM (SELECT *, regexp_replace(phone_number, '[^0-9+]', '', 'g') AS d FROM users)""")
check("full_name", lambda v: v.record.select(
    "source", "z_pk", C.full_name(F.col("first_name"), F.col("last_name")).alias("full_name")), """
SELECT source, z_pk, CASE WHEN first_name <> '' AND last_name <> '' THEN first_name || ' ' || last_name
  WHEN first_name <> '' THEN first_name WHEN last_name <> '' THEN last_name END AS full_name FROM record""")
check("user_label", lambda v: v.users.select("user_id", C.user_label(
    F.col("first_name"), F.col("last_name"), F.col("phone_number"), F.col("email")).alias("label")), """
SELECT user_id, first_name || ' ' || last_name || CASE WHEN phone_number = '' AND email = '' THEN '' ELSE
  ' (' || concat_ws(', ', CASE WHEN phone_number <> '' THEN 'phone: ' || phone_number END,
                     CASE WHEN email <> '' THEN 'email: ' || email END) || ')' END AS label FROM users""")

# Text of every message, turn and document.

check("valid_content", lambda v: v.table("documents").select(
    "doc_id", X.content_check(F.col("text"), 1000).alias("result")), f"""
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN length(text) > 1000 THEN 'too_long'
  WHEN {sql_strip('text')} = '' THEN 'blank' ELSE 'ok' END AS result FROM documents""")
check("valid_content_log", lambda v: v.send_log.select(
    "send_id", X.content_check(F.col("contents"), 12).alias("result")), f"""
SELECT send_id, CASE WHEN contents = '' THEN 'empty' WHEN length(contents) > 12 THEN 'too_long'
  WHEN {sql_strip('contents')} = '' THEN 'blank' ELSE 'ok' END AS result FROM send_log""")
check("apple_ts", lambda v: v.message.select("rowid", TM.apple_ts(F.col("date")).alias("at")).withColumn(
    "back", TM.to_apple(F.col("at"))), f"""
SELECT rowid, {sql_ts(sql_apple('date'))} AS at, CASE WHEN date <> 0 THEN date // 1000 * 1000 END AS back FROM message""")
check("extract_text", lambda v: with_best_text(v.message, "extracted_text").select("rowid", "extracted_text"),
      "SELECT rowid, extracted_text FROM extracted")
check("marked_text", lambda v: with_marked_text(v.message, "attributed_body", "decoded").select("rowid", "decoded"),
      "SELECT rowid, decoded FROM message")
check("extract_text_documents", lambda v: with_best_text(v.long_message, "extracted_text").select("rowid", "extracted_text"),
      "SELECT rowid, extracted_text FROM long_extracted")
check("text_source", lambda v: with_best_text(v.message, "extracted_text").select(
    X.text_source(F.col("text"), F.col("attributed_body"), F.col("extracted_text")).alias("text_source")).groupBy(
        "text_source").agg(F.count("*").alias("messages")), """
SELECT CASE WHEN trim(text) <> '' THEN 'text_column' WHEN extracted_text <> '' AND has_body THEN 'attributed_body_decoded'
  WHEN has_body THEN 'attributed_body_failed' ELSE 'no_text_available' END AS text_source, count(*) AS messages
FROM extracted GROUP BY 1""")
check("truncate_ellipsis", lambda v: v.turns.select(
    "chat_id", "message_id", X.truncate_ellipsis(F.col("contents"), 100).alias("short")), f"""
SELECT chat_id, message_id, CASE WHEN coalesce(contents, '') = '' THEN '[No text content]'
  WHEN length({sql_strip('contents')}) > 100 THEN left({sql_strip('contents')}, 97) || '...'
  ELSE {sql_strip('contents')} END AS short FROM turns""")
check("sender_label", lambda v: v.direct.select(
    "message_id", X.sender_label(F.col("is_from_me")).alias("short_label"),
    X.sender_label(F.col("is_from_me"), F.concat(F.lit("Contact ("), "user_id", F.lit(")")), "Me").alias("long_label")), """
SELECT message_id, CASE WHEN is_from_me THEN 'You' ELSE 'Contact' END AS short_label,
  CASE WHEN is_from_me THEN 'Me' ELSE 'Contact (' || user_id || ')' END AS long_label FROM direct""")
check("suspicious_text", lambda v: v.table("pages").select("page_id", X.suspicious_text(F.col("html")).alias("suspicious")), """
SELECT page_id, html LIKE '%\\x%' OR html LIKE '%\\u%' OR html LIKE '%' || chr(65533) || '%'
  OR regexp_full_match(left(html, 10), '[\\x00-\\x1f]+') AS suspicious FROM pages""")
check("classify_send_error", lambda v: v.send_log.select(
    "send_id", X.send_error_class(F.col("error_message")).alias("error_class")), """
SELECT send_id, CASE WHEN error_message IS NULL THEN NULL
  WHEN lower(error_message) LIKE '%network%' OR lower(error_message) LIKE '%connection%' THEN 'network'
  WHEN lower(error_message) LIKE '%auth%' OR lower(error_message) LIKE '%permission%' THEN 'auth'
  WHEN lower(error_message) LIKE '%rate%' OR lower(error_message) LIKE '%limit%' THEN 'rate' ELSE 'other' END AS error_class
FROM send_log""")
check("clock_time", lambda v: v.direct.select("message_id", TM.clock_time(F.col("created_at")).alias("clock")),
      "SELECT message_id, strftime(created_at, '%I:%M:%S %p') AS clock FROM direct")
check("valid_iso8601", lambda v: v.direct.select("message_id", F.explode(F.array(
    TM.iso_text(F.col("created_at")), F.concat(TM.iso_text(F.col("created_at")), F.lit("Z")),
    F.date_format("created_at", "yyyy-MM-dd"), F.date_format("created_at", "dd/MM/yyyy"),
    F.concat(F.date_format("created_at", "yyyy-"), F.lit("13-40")))).alias("value")).select(
        "message_id", "value", TM.valid_iso8601(F.col("value")).alias("valid")), """
, stamps AS (SELECT message_id, CASE WHEN epoch_us(created_at) % 1000000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END AS iso, created_at FROM direct)
SELECT message_id, value, value NOT LIKE '%/%' AND value NOT LIKE '%-13-40' AS valid FROM (
  SELECT message_id, unnest([iso, iso || 'Z', strftime(created_at, '%Y-%m-%d'), strftime(created_at, '%d/%m/%Y'),
    strftime(created_at, '%Y-') || '13-40']) AS value FROM stamps)""")


def _sender_names(v: Inputs):
    linked = v.users.where("handle_id IS NOT NULL").withColumnRenamed("handle_id", "_h")
    rows = v.message.join(linked, v.message["handle_id"] == linked["_h"], "left")
    return rows.select("rowid", C.sender_name(F.col("is_from_me") != 0, F.col("handle_id"), F.col).alias("sender"))


check("sender_name", _sender_names, """
SELECT rowid, CASE WHEN is_from_me = 1 THEN 'You' WHEN coalesce(m.handle_id, 0) = 0 THEN 'Unknown'
  WHEN first_name <> '' OR last_name <> '' THEN trim(first_name || ' ' || last_name)
  WHEN phone_number <> '' THEN phone_number WHEN email <> '' THEN email ELSE 'Handle ' || m.handle_id END AS sender
FROM message m LEFT JOIN users u ON u.handle_id = m.handle_id""")

# Parsers over tables of answers.

check("parse_boundaries", lambda v: v.answers.select("chat_id", "turn", F.posexplode(RC.parse_boundaries(F.col("answer"))))
      .select("chat_id", "turn", "pos", "col.after_message_index", "col.reason", "col.confidence"), """
SELECT conv_id AS chat_id, turn, 0::BIGINT AS pos, turn AS after_message_index, 'topic' AS reason, 0.9::DOUBLE AS confidence
FROM conversations WHERE turn % 5 = 0
UNION ALL SELECT conv_id, turn, 0, turn, 'bye', 0.8 FROM conversations WHERE turn % 5 = 1
UNION ALL SELECT conv_id, turn, 0, 1, 'a', 0.8 FROM conversations WHERE turn % 5 = 4
UNION ALL SELECT conv_id, turn, 1, 3, 'b', 0.5 FROM conversations WHERE turn % 5 = 4""")
check("parse_responses", lambda v: v.replies.select("conv_id", "turn", RC.parse_responses(F.col("answer")).alias("r"))
      .select("conv_id", "turn", "r.*"), """
SELECT conv_id, turn, ['ok', 'bad_response_2', 'no_json', 'no_json'][turn % 4 + 1] AS status,
  CASE WHEN turn % 4 = 0 THEN 'a' || turn END AS response_1, CASE WHEN turn % 4 = 0 THEN 'b' END AS response_2,
  CASE WHEN turn % 4 = 0 THEN 'c' END AS response_3 FROM conversations""")


def _violations(v: Inputs):
    """Rule violations of requests, messages, history lines and users."""
    requests = v.direct.select("chat_id", F.lit("").alias("user_id"), "contents")
    lake = v.in_chats.withColumns({"c": TM.iso_text(F.col("created_at")), "d": TM.iso_text(F.col("message_date"))})
    found = [
        Q.violation_counts(requests, RC.request_rules(F.col("chat_id"), F.col("user_id"), F.col("contents"))
                           ).withColumn("record", F.lit("request")),
        Q.violation_counts(lake, RC.message_rules(*[F.col(c) for c in (
            "message_id", "user_id", "contents", "is_from_me", "chat_id", "c", "d")])).withColumn("record", F.lit("message")),
        Q.violation_counts(v.send_log, RC.history_rules(F.col("contents"), F.col("success"), F.col("recipient"))
                           ).withColumn("record", F.lit("history")),
        Q.violation_counts(v.record.join(v.phone.select("source", F.col("owner").alias("z_pk"), "full_number"), ["source", "z_pk"]),
                           RC.user_rules(F.col("source"), F.col("first_name"), F.col("last_name"), F.col("full_number"),
                                         F.lit(""), F.lit(None))).withColumn("record", F.lit("user")),
    ]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


check("validate_records", _violations, """
, broken AS (
  SELECT 'request' AS record, unnest([CASE WHEN NOT chat_id > 0 THEN 'chat_id' END, 'user_id',
    CASE WHEN contents = '' THEN 'contents' END]) AS rule FROM direct
  UNION ALL SELECT 'history', unnest([CASE WHEN contents = '' THEN 'contents' END, 'created_at']) FROM send_log
  UNION ALL SELECT 'user', unnest([CASE WHEN coalesce(first_name, '') = '' AND coalesce(last_name, '') = '' THEN 'name' END,
    CASE WHEN coalesce(full_number, '') = '' THEN 'contact_point' END])
  FROM record r JOIN phone p ON p.source = r.source AND p.owner = r.z_pk)
SELECT rule, count(*) AS rows, record FROM broken WHERE rule IS NOT NULL GROUP BY ALL""")
