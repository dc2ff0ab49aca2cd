"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatlake.llm import alignment, langid, nearcopies, neighbours, outliers, packing, personal, pieces, repeats, tokencount, toxicity, turntrie, wordtable
from chatlake.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int, held: int) -> Column:
    """True for ids whose checksum falls into the fold ``held``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), fold("doc_id", 4, 2))


def op2_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordtable.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_texts=False)


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(personal.find_personal(table(spark, sf_dir, "documents")))


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5, 0))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_piece_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations"))


# The checksum of a decimal id is computed bit by bit: SQL has no function for it.
PREFIX_TRIE_SQL = """
WITH RECURSIVE own AS (
    SELECT conv_id AS c, row_number() OVER (
               PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
    SELECT c, c::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS v FROM (SELECT DISTINCT c FROM own)
    UNION ALL
    SELECT c, s, k + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
    FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(s[k // 8 + 1])::BIGINT) ELSE v END AS x
          FROM bits WHERE k < 8 * length(s))),
heads AS (SELECT c, c - c % 100 AS base, xor(v, 4294967295::BIGINT) % 6 AS h FROM bits WHERE k = 8 * length(s)),
rows_of AS (
    SELECT heads.c, 0 AS part, pos, role, text FROM heads JOIN own ON own.c = heads.base AND pos < h
    UNION ALL
    SELECT heads.c, 1, pos, role, text FROM heads JOIN own ON own.c = heads.c AND pos >= h),
built AS (
    SELECT heads.c, coalesce(turns, []) AS turns FROM heads LEFT JOIN (
        SELECT c, list({'role': role, 'text': text} ORDER BY part, pos) AS turns FROM rows_of GROUP BY c) AS r ON r.c = heads.c),
members AS (
    SELECT c, len(turns) AS own_depth, d AS depth, turns[1:d] AS node
    FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (
    SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (own_depth = depth), '') AS ends
    FROM members GROUP BY node, depth),
tied AS (
    SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children,
           (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE length(n.node[n.depth].text) END AS saved
    FROM nodes AS n
    LEFT JOIN nodes AS p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
    LEFT JOIN (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children
               FROM nodes WHERE depth > 0 GROUP BY ALL) AS k ON k.depth = n.depth AND k.node = n.node),
sums AS (
    SELECT d AS depth, node[1:d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM tied) GROUP BY ALL)
SELECT conv_id::BIGINT AS conv_id, depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs,
       n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
       sha256(ends) AS ends_sha256
FROM tied JOIN sums USING (depth, node)
"""


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_language_id, op2_word_bpe, op3_near_copies, op4_repeated_passages,
    op5_personal_data, op6_quality_outliers, op7_toxicity, op8_best_fit_packing, op9_collision_counting,
    op10_token_counts, op11_piece_words, op12_token_alignment, op13_prefix_trie)}
SQL: dict[str, str] = {"op13_prefix_trie": PREFIX_TRIE_SQL}
