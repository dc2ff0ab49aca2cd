"""Reports over a log of send attempts.

Log columns: ``send_id, sender, recipient, contents, sent_at, success,
error_message, retry_count, duration_seconds``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chatlake.functions.contact import valid_recipient
from chatlake.functions.text import content_check, send_error_class

RATE_LIMIT = 60
RATE_WINDOW_SECONDS = 60


def send_log_metrics(log: DataFrame) -> DataFrame:
    """Attempts, outcomes, retries, mean duration and time of the last success, per sender."""
    ok = F.col("success")
    return log.groupBy("sender").agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(ok).alias("successful_sends"),
        F.count_if(~ok).alias("failed_sends"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"),
        F.sum("retry_count").alias("total_retries"),
        F.coalesce(F.avg(F.when(ok, F.col("duration_seconds"))), F.lit(0.0)).alias("average_duration_seconds"),
        F.max(F.when(ok, F.col("sent_at"))).alias("last_send_time"),
    )


def rate_limit_audit(log: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Was each attempt within its sender's rate limit, counting successes in the window before it?

    Time is cut into cells of one window. Successes are first counted per
    instant, then each count is also shown to the following cell, so a running
    count per (sender, cell) sees everything it needs and a busy sender spreads
    over many groups.
    """
    span = window_seconds * 1_000_000
    micros = F.unix_micros("sent_at")
    per_instant = log.groupBy("sender", micros.alias("at")).agg(F.count_if("success").alias("sent"))
    cell = F.call_function("div", F.col("at"), F.lit(span))
    shown = per_instant.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    recent = Window.partitionBy("sender", "cell").orderBy("at").rangeBetween(-(span - 1), 0)
    seen = shown.withColumn("seen", F.sum("sent").over(recent)).where(F.col("cell") == cell)
    used = log.withColumn("at", micros).join(seen.select("sender", "at", "seen"), ["sender", "at"])
    usage = F.col("seen") - F.col("success").cast("bigint")
    return used.select("send_id", "sender", "sent_at", "success", usage.alias("recent_sends"),
                       (usage < limit).alias("allowed"))


def send_log_report(log: DataFrame, max_length: int = 1000) -> DataFrame:
    """Attempts by recipient validity, content check and error class."""
    return log.groupBy(
        valid_recipient(F.col("recipient")).alias("valid_recipient"),
        content_check(F.col("contents"), max_length).alias("content_check"),
        F.coalesce(send_error_class(F.col("error_message")), F.lit("none")).alias("error_class"),
    ).agg(F.count(F.lit(1)).alias("attempts"))
