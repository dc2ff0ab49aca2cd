"""Tables of queries answered from stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatlake.operators import indexes as IX, retrieval as RT
from checks.inputs import Inputs
from checks.registry import check

# Three words out of each of a hundred documents are the queries.
ASKED = "doc_id % 10 = 0 AND doc_id < 1000"


def _asked(v: Inputs) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(IX.TOKEN), F.lit(0))
    return v.table("documents").where(ASKED).select(
        F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 3, 3), " ").alias("text"))


SEARCHED = f"""
, toks AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
asked AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')[3:5]) AS term
  FROM documents WHERE {ASKED}),
hit AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
scored AS (SELECT query_id, id, list_sum(list(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))) ORDER BY term)) AS score
  FROM asked JOIN hit USING (term) JOIN dfs USING (term) JOIN toks USING (id), stats GROUP BY query_id, id),
best AS (SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10)"""


def _searched(v: Inputs) -> DataFrame:
    return IX.bm25_search(IX.build_text_index(v.table("documents")), _asked(v), 10)


check("bm25_search", lambda v: _searched(v).withColumn("score", F.round("score", 6)), SEARCHED + " SELECT * FROM best")
# Hits belong to customer nodes; each query walks from the node of its best hit.
check("rerank_by_query", lambda v: RT.rerank_by_query(
    _searched(v).withColumn("node", F.concat(F.lit("c"), F.col("id").cast("string"))), v.edges).withColumn(
    "score", F.round("score", 6)), SEARCHED + """
, ways AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
h0 AS (SELECT query_id, 'c' || id AS node, 0 AS hops FROM best WHERE rank = 1),
h1 AS (SELECT DISTINCT query_id, target AS node, 1 AS hops FROM ways JOIN h0 ON source = node),
h2 AS (SELECT DISTINCT query_id, target AS node, 2 AS hops FROM ways JOIN h1 ON source = node),
h3 AS (SELECT DISTINCT query_id, target AS node, 3 AS hops FROM ways JOIN h2 ON source = node),
reach AS (SELECT query_id, node, min(hops)::BIGINT AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1
  UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY ALL)
SELECT best.query_id, id, 'c' || id AS node, score, rank AS search_rank, hops,
  row_number() OVER (PARTITION BY best.query_id ORDER BY hops NULLS LAST, rank) AS rank
FROM best LEFT JOIN reach ON reach.query_id = best.query_id AND reach.node = 'c' || id""")


def _vector_queries(v: Inputs) -> DataFrame:
    return v.table("embeddings").where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


CLOSEST = """
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) QUALIFY rank <= 10"""

check("cosine_exact", lambda v: IX.cosine_exact(v.table("embeddings"), _vector_queries(v), 10).withColumn(
    "score", F.round("score", 6)), CLOSEST)
# With every cell looked at, the index gives all that an exact search does; tests measure fewer probes.
check("cosine_search", lambda v: IX.cosine_search(
    IX.build_vector_index(v.table("embeddings")), _vector_queries(v), 10, probes=IX.MOST_CELLS).withColumn("score", F.round("score", 6)), CLOSEST)
