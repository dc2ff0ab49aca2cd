"""A training corpus from raw documents: toxicity, near copies, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. As a stage's input is always a written table, scratch tables of the
stages before it are no longer read and are cleared when a stage begins.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatlake.llm import nearcopies, packing, personal, repeats, toxicity
from chatlake.llm.common import settled, wrapped
from chatlake.llm.queries import fold, tokenizer_path
from chatlake.session import clear_scratch, scratch_path, tune

# Hundredths of the union of their word shingles that near copies share.
NEAR_PERCENT = 80


def _begin(spark: SparkSession) -> None:
    clear_scratch(tune(spark))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not call toxic; learned from the labels outside the held-out fold."""
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels, fold("doc_id", 5, 0))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key per id and text: the id, or a number of its own for each further text of an id."""
    rows = wrapped(docs)
    reused = settled(rows.where("id IS NOT NULL").groupBy("id").agg(
        F.min("mark").alias("first"), F.max("mark").alias("last")).where("first <> last").select("id", "first"), "reused_ids")
    if reused.isEmpty():
        return rows.withColumn("key", F.col("id"))
    marked = rows.join(reused, "id", "left")
    further = F.col("mark") != F.col("first")
    for salt in count():
        number = F.xxhash64(F.lit(salt), "id", "mark")
        fresh = marked.where(further).select("id", "mark").distinct().select(number.alias("id"))
        taken = rows.where("id IS NOT NULL").select("id").distinct().unionAll(fresh)
        if taken.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return marked.withColumn("key", F.when(further, number).otherwise(F.col("id"))).drop("first")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id where ids are unique.

    Rows with the same id and text are one document; different texts under one id are
    documents of their own. Documents without an id all stay.
    """
    _begin(spark)
    rows = _keyed(docs)
    found = nearcopies.near_copies(rows.select("key", "text"), id_col="key", percent=NEAR_PERCENT)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct()
    again = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    again = settled(again, "repeated_keys")
    left = rows.select("key", "row").join(gone, "key", "left_anti")
    # Only rows that are there several times are grouped.
    one = left.join(again, "key", "left_semi").dropDuplicates(["key"])
    return left.join(again, "key", "left_anti").unionByName(one).select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too; others stay as they are."""
    _begin(spark)
    found = repeats.remove_repeats(docs, with_text=True).where("n_removed > 0").dropDuplicates(["doc_id", "mark"])
    found = found.select(F.col("doc_id").alias("found_id"), F.col("mark").alias("found_mark"), "kept_text")
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark"))
    joined = wrapped(docs).join(found, same, "left")
    text = F.coalesce("kept_text", "text")
    return _with_length(docs, joined.select(*[
        text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets."""
    _begin(spark)
    return _with_length(docs, personal.mask_texts(docs, personal.find_personal(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences."""
    _begin(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


def _with_length(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed texts, with n_chars, where there is one, as long as the text is now."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn(
            "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(
                docs.schema["n_chars"].dataType))
    return changed


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

# Trained classifiers and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # Beside the scratch tables that a stage clears.
        path = scratch_path(spark, name).replace("/chatlake/", "/chatlake-stages/", 1)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
