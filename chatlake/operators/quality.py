"""Reports: coverage, integrity, completeness, freshness. Each is one or a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatlake.functions.body import with_decoded
from chatlake.functions.contact import sender_name
from chatlake.functions.records import violations
from chatlake.functions.text import not_blank, present, suspicious_text, truncate_ellipsis
from chatlake.functions.time import apple_ts, clock_time, to_apple
from chatlake.operators.chats import chats_with_members, chats_without_members
from chatlake.operators.contacts import one_user_per_handle
from chatlake.operators.keys import drop_keys, keep_keys


def rows_of(df: DataFrame) -> Column:
    """The row count as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def ratio(part: Column, whole: Column) -> Column:
    """NULL-free quotient: 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.bround(ratio(part * 100, whole), 2)


def user_stats(users: DataFrame) -> DataFrame:
    phone, email = present(F.col("phone_number")), present(F.col("email"))
    stats = users.agg(F.count(F.lit(1)).alias("total_users"), F.count_if(phone).alias("users_with_phone"),
                      F.count_if(email).alias("users_with_email"))
    return with_users_of_both(stats)


def with_users_of_both(counts: DataFrame) -> DataFrame:
    return counts.withColumn("users_with_both", F.expr("users_with_phone + users_with_email - total_users"))


def user_link_stats(users: DataFrame) -> DataFrame:
    linked = F.col("handle_id").isNotNull()
    return users.agg(F.count_if(linked).alias("with_handle"), F.count_if(~linked).alias("without_handle"))


def user_field_check(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count_if(~present(F.col("user_id"))).alias("missing_id"),
        F.count_if(~present(F.col("first_name")) & ~present(F.col("last_name"))).alias("missing_name"),
        F.count_if(~present(F.col("phone_number")) & ~present(F.col("email"))).alias("missing_contact_point"),
    )


def user_retention(users: DataFrame, contacts: DataFrame) -> DataFrame:
    """Stored contact users against extracted contacts."""
    counts = users.agg(F.count(F.lit(1)).alias("stored")).select("stored", rows_of(contacts).alias("extracted"))
    kept = ratio(F.col("stored"), F.col("extracted"))
    verdict = F.when((F.col("stored") == 0) | (F.col("extracted") == 0) | (kept > 1) | (kept < 0.5), "FAIL")
    return counts.select("stored", "extracted", kept.alias("retention"), verdict.otherwise("PASS").alias("verdict"))


def source_stats(message: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return message.agg(F.count(F.lit(1)).alias("message_count"), distinct("handle_id").alias("contact_count"),
                       F.min("date").alias("earliest_message"), F.max("date").alias("latest_message"))


def text_extraction_stats(message: DataFrame) -> DataFrame:
    """Text coverage, and the decode rate over every body that needs decoding."""
    return with_text_rates(text_flags(message).agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if("t").alias("has_text_column"),
        F.count_if(~F.col("t")).alias("null_text_column"), F.count_if("b").alias("has_attributed_body"),
        F.count_if("n").alias("needs_decoding"), F.count_if("d").alias("recoverable_messages")))


def text_flags(message: DataFrame) -> DataFrame:
    """Per row whether it has a text (t), a body (b), needs decoding (n) and was decoded (d)."""
    text, body = present(F.col("text")), F.col("attributed_body").isNotNull()
    needs = ~text & body
    rows = with_decoded(message.select("text", "attributed_body"), F.when(needs, F.col("attributed_body")))
    return rows.select(text.alias("t"), body.alias("b"), needs.alias("n"), F.col("decoded").isNotNull().alias("d"))


def with_text_rates(counts: DataFrame) -> DataFrame:
    total = F.col("total_messages")
    return counts.select(
        "*", percent(F.col("has_text_column"), total).alias("text_coverage_percent"),
        percent(F.col("has_attributed_body"), total).alias("attributed_body_coverage_percent"),
        percent(F.col("recoverable_messages"), F.col("needs_decoding")).alias("decode_success_rate"),
    )


def decode_stats(message: DataFrame) -> DataFrame:
    """Outcome of decoding every body."""
    return with_decode_rate(decode_flags(message).agg(
        F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failure_count"),
        F.count(F.lit(1)).alias("total_attempts")))


def decode_flags(message: DataFrame) -> DataFrame:
    bodies = message.where(F.length("attributed_body") > 0).select("attributed_body")
    return with_decoded(bodies, F.col("attributed_body")).select(F.col("decoded").isNotNull().alias("ok"))


def with_decode_rate(counts: DataFrame) -> DataFrame:
    return counts.withColumn("success_rate_percent", percent(F.col("success_count"), F.col("total_attempts")))


def recovery_scope(message: DataFrame) -> DataFrame:
    text, body, done = present(F.col("text")), F.col("attributed_body").isNotNull(), present(F.col("extracted_text"))
    scope = message.agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(text).alias("has_text_column"),
        F.count_if(~text & body).alias("needs_migration"), F.count_if(~body).alias("no_attributed_body"),
        F.count_if(done).alias("already_migrated"))
    return with_remaining(scope)


def with_remaining(counts: DataFrame) -> DataFrame:
    return counts.withColumn("remaining_to_migrate", F.col("needs_migration") - F.col("already_migrated"))


def recovery_validation(message: DataFrame, **more: Column) -> DataFrame:
    """Coverage before and after recovery; ``more`` are aggregates taken in the same pass."""
    text, body, done = present(F.col("text")), F.col("attributed_body").isNotNull(), present(F.col("extracted_text"))
    counts = message.agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(text).alias("has_text"),
        F.count_if(done).alias("has_extracted_text"), F.count_if(~text & done).alias("messages_recovered"),
        F.count_if(~text & ~done & body).alias("still_missing_text"),
        *[aggregate.alias(name) for name, aggregate in more.items()])
    return with_recovery_rates(counts, *more)


def with_recovery_rates(counts: DataFrame, *more: str) -> DataFrame:
    total, before = F.col("total_messages"), F.col("has_text")
    after = before + F.col("messages_recovered")
    return counts.select(
        "total_messages", percent(before, total).alias("original_text_coverage_percent"),
        percent(after, total).alias("new_text_coverage_percent"),
        F.bround(ratio(after * 100, total) - ratio(before * 100, total), 2).alias("coverage_improvement_percent"),
        "messages_recovered", "still_missing_text", "has_extracted_text", *more,
    )


def wide_stats(wide: DataFrame) -> DataFrame:
    sent = F.col("is_from_me") != 0
    return wide.agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(sent).alias("sent_messages"),
        F.count_if(~sent).alias("received_messages"), F.count_distinct("phone_email").alias("unique_contacts"))


def wide_services(wide: DataFrame) -> DataFrame:
    return wide.groupBy("service_type").agg(F.count(F.lit(1)).alias("messages"))


def migration_coverage(message: DataFrame, messages: DataFrame) -> DataFrame:
    eligible = F.col("text").isNotNull() | F.col("attributed_body").isNotNull()
    counts = message.agg(F.count(F.lit(1)).alias("source_messages"), F.count_if(eligible).alias("eligible_messages"))
    whole = F.greatest(F.col("eligible_messages"), F.lit(1))
    return counts.withColumn("target_messages", rows_of(messages)).withColumn(
        "migration_coverage", F.col("target_messages") / whole)


def chat_migration_report(chat: DataFrame, chats: DataFrame, chat_users: DataFrame) -> DataFrame:
    counts = chat.agg(F.count(F.lit(1)).alias("source_chats")).select(
        "source_chats", rows_of(chats).alias("target_chats"),
        rows_of(chats_with_members(chats, chat_users)).alias("chats_with_users"),
        rows_of(chats_without_members(chats, chat_users)).alias("chats_without_users"))
    source, target, lonely = F.col("source_chats"), F.col("target_chats"), F.col("chats_without_users")
    warnings = F.concat_ws(
        "; ",
        F.when((target > 0) & (target < source), F.concat(F.lit("Not all chats migrated: "), target, F.lit("/"), source)),
        F.when(lonely > 0, F.concat(lonely, F.lit(" chats have no associated users"))),
    )
    return counts.select("*", percent(target, source).alias("migration_rate"), warnings.alias("warnings"),
                         (target > 0).alias("validation_passed"))


def null_counts(messages: DataFrame) -> DataFrame:
    required = ["message_id", "user_id", "contents", "created_at"]
    return messages.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required])


def integrity_report(messages: DataFrame) -> DataFrame:
    """Uniqueness and field checks over the whole table."""
    # Repeated ids come from counts that combine before the shuffle.
    repeated = messages.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    checks = messages.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("created_at").isNull()).alias("invalid_timestamp_count"),
        F.count_if(F.col("is_from_me").isNull()).alias("invalid_boolean_count"),
        F.count_if(~not_blank(F.col("contents"))).alias("empty_contents_count"),
        F.count_if(~not_blank(F.col("user_id"))).alias("empty_user_id_count"))
    return checks.select(
        "*", (rows_of(repeated) == 0).alias("unique_message_ids"),
        (F.col("invalid_timestamp_count") == 0).alias("valid_timestamps"),
        (F.col("empty_contents_count") == 0).alias("non_empty_contents"))


def text_quality_report(messages: DataFrame) -> DataFrame:
    text = F.col("contents")
    flags = messages.select(
        "message_id", F.length(text).alias("length"), not_blank(text).alias("filled"),
        text.rlike(r"[^\x00-\x7f]").alias("wide"), text.rlike("['\"&<>]").alias("special"),
        F.is_valid_utf8(text).alias("valid"), suspicious_text(text).alias("doubtful"))
    filled = F.col("filled")
    first = flags.where("filled AND doubtful").orderBy("message_id").limit(10).agg(
        F.array_join(F.array_sort(F.collect_list("message_id")).cast("array<string>"), ",")).scalar()
    return flags.agg(
        F.count(F.lit(1)).alias("total_messages_analyzed"), F.count_if(filled).alias("messages_with_text"),
        F.coalesce(F.avg(F.when(filled, F.col("length"))), F.lit(0.0)).alias("average_text_length"),
        F.coalesce(F.bool_or(filled & F.col("wide")), F.lit(False)).alias("contains_emojis"),
        F.coalesce(F.bool_or(filled & F.col("special")), F.lit(False)).alias("contains_special_chars"),
        F.count_if(filled & ~F.col("valid")).alias("encoding_error_count"),
        F.count_if(filled & F.col("doubtful")).alias("suspicious_count"),
    ).withColumn("suspicious_ids", first)


def completeness_report(message: DataFrame, extracted: DataFrame, messages: DataFrame) -> DataFrame:
    """Coverage, content match of every source text, and the overall verdict.

    ``extracted`` holds the recovered text of the source rows as ``extracted_text``.
    """
    eligible = F.col("text").isNotNull() | F.col("attributed_body").isNotNull()
    source = message.agg(F.count_if(eligible))
    # Texts are compared by digest, so the shuffle carries 64 characters a row.
    texts = extracted.where(not_blank(F.col("extracted_text"))).select(F.sha2("extracted_text", 256).alias("digest"))
    stored = messages.select(F.sha2("contents", 256).alias("digest")).distinct().withColumn("stored", F.lit(1))
    compared = texts.join(stored, "digest", "left").agg(
        F.struct(F.count(F.lit(1)).alias("texts"), F.count("stored").alias("matching"))).scalar()
    # One pass over the stored rows: per id, then over the ids.
    by_id = messages.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("created_at").isNull()).alias("times"),
        F.count_if(~F.is_valid_utf8("contents")).alias("texts"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = by_id.agg(
        total("n").alias("target_message_count"), total("times").alias("_bad_times"), total("texts").alias("_bad_texts"),
        F.count_if(F.col("n") > 1).alias("_repeated"),
    ).select("*", source.scalar().alias("source_message_count"), compared.alias("_compared")).select(
        "*", F.col("_compared.texts").alias("source_texts"), F.col("_compared.matching").alias("matching_texts"))
    coverage = ratio(F.col("target_message_count"), F.col("source_message_count"))
    critical = (F.col("_repeated") == 0) & (F.col("_bad_times") == 0)
    verdict = F.when(~critical, "FAIL").when((coverage > 0.8) & (F.col("_bad_texts") == 0), "PASS")
    return counts.select(
        "source_message_count", "target_message_count", coverage.alias("migration_coverage"), "source_texts",
        "matching_texts", verdict.otherwise("PASS_WITH_WARNINGS").alias("overall_status"))


def handle_match_stats(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("match_kind").agg(F.count(F.lit(1)).alias("handles"))


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule."""
    broken = df.select(F.explode(violations(rules)).alias("rule"))
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def named_handle_check(expected: DataFrame, users: DataFrame) -> DataFrame:
    """Expected (handle_id, first_name, last_name) that no user of that handle has, in any case of letters."""
    def folded(df: DataFrame) -> DataFrame:
        return df.select("handle_id", *[F.lower(c).alias(c) for c in ("first_name", "last_name")])

    return drop_keys(folded(expected), folded(users.where("handle_id IS NOT NULL")), ["handle_id", "first_name", "last_name"])


def named_member_check(expected: DataFrame, chats: DataFrame, chat_users: DataFrame, users: DataFrame) -> DataFrame:
    """Expected (display_name, first_name, last_name) members that no chat of that name has."""
    members = chats.join(chat_users, "chat_id").join(users, "user_id").select(
        "display_name", F.lower("first_name").alias("first_name"), F.lower("last_name").alias("last_name"))
    wanted = expected.select("display_name", F.lower("first_name").alias("first_name"),
                             F.lower("last_name").alias("last_name"))
    return drop_keys(wanted, members, ["display_name", "first_name", "last_name"])


def recent_in_copy(recent: DataFrame, copy: DataFrame) -> DataFrame:
    """How many of the given rows the copy holds."""
    found = keep_keys(recent, copy, ["rowid"])
    return recent.agg(F.count(F.lit(1)).alias("recent_messages_count")).select(
        "recent_messages_count", rows_of(found).alias("recent_messages_in_copy"))


def replica_freshness(source: DataFrame, copy: DataFrame, as_of: str, minutes: int = 5, max_age_seconds: int = 30,
                      copied_at: str | None = None, tolerated_gap: int = 0) -> DataFrame:
    """Is a copy as fresh as its source? Largest ids, coverage of recent rows, age, verdict and issues."""
    now = F.lit(as_of).cast("timestamp")
    cutoff = to_apple(now - F.make_dt_interval(mins=F.lit(minutes)))
    # One pass over the recent rows, with a mark on those that the copy has.
    held = copy.select("rowid").distinct().withColumn("held", F.lit(1))
    recent = source.where(F.col("date") > cutoff).select("rowid").join(held, "rowid", "left").agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.count("held").alias("held"))).scalar()
    age = F.lit(0.0) if copied_at is None else (
        F.unix_micros(now) - F.unix_micros(F.lit(copied_at).cast("timestamp"))) / 1_000_000
    state = source.agg(F.max("rowid").alias("source_max_rowid")).select(
        "source_max_rowid", copy.agg(F.max("rowid")).scalar().alias("copy_max_rowid"),
        recent.alias("_recent"), age.alias("copy_age_seconds")).select(
        "source_max_rowid", "copy_max_rowid", F.col("_recent.rows").alias("recent_messages_count"),
        F.col("_recent.held").alias("recent_messages_in_copy"), "copy_age_seconds")
    lag = F.col("source_max_rowid") - F.col("copy_max_rowid")
    late, old = lag > tolerated_gap, F.col("copy_age_seconds") > max_age_seconds
    issues = F.concat_ws(
        "; ", F.when(late, F.concat(F.lit("Copy missing "), lag, F.lit(" recent ROWIDs"))),
        F.when(old, F.lit("Copy is too old")))
    coverage = F.when(F.col("recent_messages_count") == 0, F.lit(1.0)).otherwise(
        F.col("recent_messages_in_copy") / F.col("recent_messages_count"))
    return state.select("*", lag.alias("rowid_lag"), coverage.alias("recent_message_coverage"),
                        F.coalesce(~late & ~old, F.lit(False)).alias("is_fresh"), issues.alias("issues"))


def freshness_summary(history: DataFrame) -> DataFrame:
    """Over past checks (success, is_fresh, copy_seconds, rowid_lag)."""
    ok = F.col("success")
    return history.agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(ok & F.col("is_fresh")).alias("fresh"),
        ratio(F.count_if(ok & F.col("is_fresh")), F.count(F.lit(1))).alias("fresh_rate"),
        F.avg(F.when(ok, F.col("copy_seconds"))).alias("average_copy_seconds"),
        F.max(F.when(ok & (F.col("rowid_lag") >= 0), F.col("rowid_lag"))).alias("max_rowid_lag"))


def notification_rows(message: DataFrame, users: DataFrame, shown: int = 5, width: int = 100) -> DataFrame:
    """The first new rows as a person would read them, and how many more there are.

    ``message`` needs ``extracted_text``.
    """
    first = message.orderBy("rowid").limit(shown)
    linked = one_user_per_handle(users).withColumnRenamed("handle_id", "_h")
    rows = first.join(linked, first["handle_id"] == linked["_h"], "left")
    body = F.when(present(F.col("extracted_text")), F.col("extracted_text")).when(
        present(F.col("text")), F.col("text")).otherwise(F.lit("[No content]"))
    return rows.select(
        "rowid", sender_name(F.col("is_from_me") != 0, F.col("handle_id"), F.col).alias("sender"),
        clock_time(apple_ts(F.col("date"))).alias("time"), truncate_ellipsis(body, width).alias("content"),
        F.greatest(rows_of(message) - shown, F.lit(0)).alias("more"),
    )
