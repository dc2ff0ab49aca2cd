"""The text-recovery job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatlake.functions.body import with_decoded
from chatlake.functions.text import not_blank, present, strip
from chatlake.operators.quality import percent, recovery_validation


def with_extracted_column(message: DataFrame) -> DataFrame:
    """Add an empty ``extracted_text`` unless the table has it."""
    if "extracted_text" in message.columns:
        return message
    return message.withColumn("extracted_text", F.lit(None).cast("string"))


def recover_text(message: DataFrame) -> DataFrame:
    """Fill ``extracted_text`` where text is blank, a body exists and nothing was extracted yet.

    Running it again changes nothing. Only bodies still to be read reach the decoder.
    """
    done = present(F.col("extracted_text"))
    wanted = F.when(~present(F.col("text")) & ~done, F.col("attributed_body"))
    rows = with_decoded(with_extracted_column(message), wanted)
    found = F.when(not_blank(F.col("decoded")), strip(F.col("decoded")))
    kept = F.when(done, F.col("extracted_text")).otherwise(F.coalesce(found, F.col("extracted_text")))
    return rows.withColumn("extracted_text", kept).drop("decoded")


def refresh_report(message: DataFrame) -> DataFrame:
    """Recover, then the coverage before and after beside the decode statistics."""
    recovered = recover_text(message)
    # A body needs decoding if its row has no text; it is decoded once, for both halves of the report.
    needs = ~present(F.col("text")) & F.col("attributed_body").isNotNull()
    found = needs & present(F.col("extracted_text"))
    report = recovery_validation(recovered, needs_decoding=F.count_if(needs), recoverable_messages=F.count_if(found))
    return report.withColumn(
        "decode_success_rate", percent(F.col("recoverable_messages"), F.col("needs_decoding")))
