"""Reports from mergeable state, and text recovery that is cut off and goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatlake.operators import reportstate as RS
from chatlake.plans import recovery as RV, resume as RE
from chatlake.session import scratch_path
from checks.inputs import PRELUDE, Inputs
from checks.registry import SQL, check
from checks.reports import RECOVERED, partly_recovered
from checks.tables import WIDE, wide

BATCHES = 4


def by_batches(rows: DataFrame, report: RS.Report, key: str) -> DataFrame:
    """The report after batches of which one comes twice, with a fold on the way."""
    root = scratch_path(rows.sparkSession, "report")
    batch = F.pmod(F.xxhash64(key), F.lit(BATCHES))
    for number in (0, 1, 1, 2, 3):
        RS.record(rows.where(batch == number), report, root, number)
        if number == 2:
            RS.compact(rows, report, root, 1)
    return RS.current_report(rows, report, root)


def same_sql(name: str) -> str:
    """The SQL of the report that reads all rows at once."""
    return SQL[name].removeprefix(PRELUDE.rstrip())


def within_error(report: DataFrame, estimate: str, exact: DataFrame) -> DataFrame:
    """``estimate`` replaced by whether it lies within four standard errors of the exact number."""
    off = F.abs(F.col(estimate) - exact.scalar())
    return report.withColumn(estimate, off <= 4 * RS.SKETCH_ERROR * F.col(estimate) + 1)


check("user_stats_merged", lambda v: by_batches(v.users, RS.USERS, "user_id"), same_sql("user_stats"))
check("text_extraction_stats_merged", lambda v: by_batches(v.message, RS.TEXTS, "rowid"), same_sql("text_extraction_stats"))
check("decode_stats_merged", lambda v: by_batches(v.message, RS.BODIES, "rowid"), same_sql("decode_stats"))
check("recovery_scope_merged", lambda v: by_batches(partly_recovered(v), RS.SCOPE, "rowid"), same_sql("recovery_scope"))
check("recovery_validation_merged", lambda v: by_batches(RV.recover_text(v.message), RS.RECOVERY, "rowid"),
      same_sql("recovery_validation"))
check("eligible_messages_merged", lambda v: by_batches(v.message, RS.ELIGIBLE, "rowid"), """
SELECT count(*) AS source_messages, count(*) FILTER (text IS NOT NULL OR has_body) AS eligible_messages FROM message""")
check("wide_services_merged", lambda v: by_batches(wide(v), RS.SERVICES, "message_id"), same_sql("wide_services"))


def _wide_stats(v: Inputs) -> DataFrame:
    rows = wide(v)
    return within_error(by_batches(rows, RS.WIDE, "message_id"), "unique_contacts", rows.agg(F.count_distinct("phone_email")))


check("wide_stats_merged", _wide_stats, WIDE + """
SELECT count(*) AS total_messages, count(*) FILTER (is_from_me = 1) AS sent_messages,
  count(*) FILTER (is_from_me = 0) AS received_messages, true AS unique_contacts FROM wide""")


def _source_stats(v: Inputs) -> DataFrame:
    """A stream of files, followed in two runs."""
    feed, root = scratch_path(v.spark, "feed"), scratch_path(v.spark, "report")
    for part in (0, 1):
        v.message.where(F.col("rowid") % 2 == part).write.mode("append").parquet(feed)
        stream = v.spark.readStream.schema(v.message.schema).option("maxFilesPerTrigger", 4).parquet(feed)
        RS.follow_report(stream, RS.SOURCE, root).awaitTermination()
    return within_error(RS.current_report(v.message, RS.SOURCE, root), "contact_count", v.message.agg(F.count_distinct("handle_id")))


check("source_stats_live", _source_stats, """
SELECT count(*) AS message_count, true AS contact_count, min(date) AS earliest_message, max(date) AS latest_message FROM message""")


def _resumed(v: Inputs) -> DataFrame:
    """One lane, then a log that has grown inside finished ranges, to the end."""
    root, how = scratch_path(v.spark, "recovery"), {"range_rows": 500, "lane_ranges": 20}
    RE.recover_texts(v.message.where("rowid % 3 <> 0"), root, lanes=1, **how)
    RE.recover_texts(v.message, root, **how)
    return RE.recovered_message(v.message, root, how["range_rows"]).select("rowid", "text", "extracted_text")


check("recover_text_resumed", _resumed, RECOVERED + " SELECT rowid, text, extracted_text FROM recovered")
