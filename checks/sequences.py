"""Windows, conversations, context tables, jobs, streams and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatlake import schemas
from chatlake.operators import (
    contacts as CT, context as CX, conversations as CV, messages as M, retrieval as RT,
)
from chatlake.plans import conversations as PC, lake as PL
from chatlake.session import scratch_path
from chatlake.streaming import sessions as SS, sync as SY
from checks.inputs import Inputs, as_of, sql_ts
from checks.registry import check

# Gaps found by looking at neighbouring messages.

SEGMENTS = """
, gaps AS (SELECT *, row_number() OVER w - 1 AS idx, epoch_us(created_at) - epoch_us(lag(created_at) OVER w) AS pause
  FROM direct WINDOW w AS (PARTITION BY chat_id ORDER BY created_at, message_id)),
segments AS (SELECT *, sum(CASE WHEN pause >= 172800000000 THEN 1 ELSE 0 END) OVER (
    PARTITION BY chat_id ORDER BY created_at, message_id) AS segment FROM gaps),
found AS (SELECT chat_id, segment, count(*) AS message_count, min(idx) AS start_index, arg_min(message_id, idx) AS start_message_id,
    arg_max(message_id, idx) AS end_message_id, min(created_at) AS start_time, max(created_at) AS end_time,
    arg_min(user_id, idx) AS initiated_by, chat_id || ':' || arg_min(message_id, idx) AS conversation_id
  FROM segments GROUP BY chat_id, segment HAVING count(*) >= 2)"""
FOUND = f"""SELECT conversation_id, chat_id, start_message_id, end_message_id, message_count, {sql_ts('start_time')} AS start_time,
  {sql_ts('end_time')} AS end_time, NULL::VARCHAR AS title, 'completed' AS status, initiated_by, start_index FROM """

check("gap_boundaries", lambda v: CV.gap_boundaries(v.direct), SEGMENTS + """
SELECT chat_id, idx - 1 AS after_message_index,
  'Time gap of ' || round_even(pause / 3600000000.0::DOUBLE, 0)::BIGINT || ' hours' AS reason, 0.7::DOUBLE AS confidence
FROM gaps WHERE pause >= 172800000000""")
check("conversations", lambda v: CV.conversations(v.direct), SEGMENTS + FOUND + "found")
check("detect_conversations", lambda v: PC.detect_conversations(
    PC.chat_rows(v.messages, v.chat_messages), gap_hours=6), SEGMENTS.replace(
    "direct", "in_chats").replace("172800000000", "21600000000") + FOUND + "found")
check("detect_conversations_whole", lambda v: PC.detect_conversations(
    v.direct, detector=lambda m: m.where("false").selectExpr("chat_id", "0L AS after_message_index")),
    SEGMENTS.replace("172800000000", "9000000000000000000") + FOUND + "found")
check("conversation_messages", lambda v: CV.conversation_messages(v.direct), SEGMENTS + """
SELECT conversation_id, message_id, idx - start_index + 1 AS sequence_number FROM segments JOIN found USING (chat_id, segment)""")
check("conversation_members", lambda v: CV.conversation_members(
    v.direct.withColumn("user_id", F.expr("concat('w', message_id % 3)"))), SEGMENTS + """
SELECT DISTINCT conversation_id, 'w' || (message_id % 3) AS user_id FROM segments JOIN found USING (chat_id, segment)""")
check("conversation_records", lambda v: CV.conversation_records(v.direct.withColumn(
    "user_id", F.expr("concat('w', message_id % 3)"))), SEGMENTS.replace("arg_min(user_id, idx)", "'w' || (arg_min(message_id, idx) % 3)") + f"""
, members AS (SELECT conversation_id, string_agg(DISTINCT 'w' || (message_id % 3), '|' ORDER BY 'w' || (message_id % 3)) AS users
  FROM segments JOIN found USING (chat_id, segment) GROUP BY 1)
SELECT conversation_id, chat_id, 0::BIGINT AS part, users, {sql_ts('start_time')} AS created_at, {sql_ts('end_time')} AS completed_at,
  message_count AS count, NULL::VARCHAR AS summary, 'completed' AS status, initiated_by FROM found JOIN members USING (conversation_id)""")
check("conversation_metrics", lambda v: CV.conversation_metrics(CV.conversations(v.direct)), SEGMENTS + """
SELECT conversation_id, chat_id, message_count,
  round((epoch_us(end_time) - epoch_us(start_time)) / 60000000.0::DOUBLE, 6) AS duration_minutes FROM found""")

SUPPLIED = """
, indexed AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, message_id) - 1 AS idx FROM direct),
marked AS (SELECT i.*, c.chat_id IS NOT NULL AS cut FROM indexed i
  LEFT JOIN (SELECT DISTINCT chat_id, after_message_index FROM cuts) c ON c.chat_id = i.chat_id AND c.after_message_index = i.idx - 1),
segments AS (SELECT *, sum(cut::INT) OVER (PARTITION BY chat_id ORDER BY idx) AS segment FROM marked),
found AS (SELECT chat_id, segment, count(*) AS message_count, min(idx) AS start_index, arg_min(message_id, idx) AS start_message_id,
    arg_max(message_id, idx) AS end_message_id, min(created_at) AS start_time, max(created_at) AS end_time,
    arg_min(user_id, idx) AS initiated_by, chat_id || ':' || arg_min(message_id, idx) AS conversation_id
  FROM segments GROUP BY chat_id, segment HAVING count(*) >= 2)"""
check("detect_conversations_supplied", lambda v: PC.detect_conversations(
    v.direct, detector=lambda m: v.cuts), SUPPLIED + FOUND + "found")
check("conversations_from_boundaries", lambda v: CV.conversations_from_boundaries(v.direct, v.cuts), SUPPLIED + FOUND + "found")
check("detector_comparison", lambda v: CV.detector_comparison(v.direct, v.cuts), SEGMENTS + """
SELECT 'time_based' AS method, (SELECT count(*) FROM gaps WHERE pause >= 172800000000) AS boundaries,
  (SELECT count(*) FROM found) AS conversations
UNION ALL SELECT 'supplied', (SELECT count(*) FROM cuts), (""" + SUPPLIED.strip().replace(
    ", indexed", "WITH indexed", 1).replace("segments", "cut_segments").replace("found", "cut_found") + " SELECT count(*) FROM cut_found)")
check("message_index", lambda v: CV.message_index(v.direct).select("chat_id", "message_id", "message_index"), """
SELECT chat_id, message_id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, message_id) - 1 AS message_index FROM direct""")
check("message_index_sliced", lambda v: CV.message_index(
    v.direct, cell=F.date_trunc("hour", "created_at")).select(
    "chat_id", "message_id", "message_index"), """
SELECT chat_id, message_id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, message_id) - 1 AS message_index FROM direct""")


def chunk_sql(source: str, size: int, step: int) -> str:
    return f"""
, indexed AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, message_id) - 1 AS idx,
    count(*) OVER (PARTITION BY chat_id) AS n FROM {source}),
chunks AS (SELECT chat_id, n, unnest(generate_series(0, CASE WHEN n <= {size} THEN 0 ELSE ceil((n - {size}) / {step})::BIGINT END)) AS chunk
  FROM (SELECT DISTINCT chat_id, n FROM indexed)),
chunked AS (SELECT i.*, chunk, chunk * {step} AS chunk_start, idx - chunk * {step} AS chunk_position
  FROM indexed i JOIN chunks c ON c.chat_id = i.chat_id AND idx >= chunk * {step} AND idx < chunk * {step} + {size})"""


check("overlapping_chunks", lambda v: CV.overlapping_chunks(
    CV.message_index(v.direct), CV.chat_sizes(v.direct), 20, 5).select(
        "chat_id", "message_id", "chunk", "chunk_start", "chunk_position"),
    chunk_sql("direct", 20, 15) + " SELECT chat_id, message_id, chunk, chunk_start, chunk_position FROM chunked")
check("chunk_ranges", lambda v: CV.chunk_ranges(v.in_chats), chunk_sql("in_chats", 200, 170) + """
SELECT chat_id, chunk, chunk_start, count(*) AS rows FROM chunked GROUP BY ALL""")
HEAD, TAIL = (part.replace("'", "''") for part in CV.BOUNDARY_TEMPLATE.split("{messages}"))


def _chunk_boundaries(v: Inputs) -> DataFrame:
    def pauses(chunk):
        """Pauses of two days or more; more sure of itself in every other chunk."""
        import pandas as pd

        pause = chunk["created_at"].diff().shift(-1)
        at = [i for i in range(len(chunk) - 1) if pause[i] >= pd.Timedelta(hours=48)]
        return pd.DataFrame({"after_message_index": at, "reason": "pause", "confidence": 0.9 if chunk["chunk"][0] % 2 == 0 else 0.6})

    return CV.chunk_boundaries(v.direct, pauses, 40, 10, 0)


check("chunk_boundaries", _chunk_boundaries, SEGMENTS + """
, sizes AS (SELECT chat_id, count(*) AS n FROM direct GROUP BY 1),
seen AS (SELECT g.chat_id, idx - 1 AS place, unnest(range(0, CASE WHEN n <= 40 THEN 1 ELSE ceil((n - 40) / 30.0)::BIGINT + 1 END)) AS chunk
  FROM gaps g JOIN sizes USING (chat_id) WHERE pause >= 172800000000)
SELECT chat_id, place AS after_message_index, 'pause' AS reason, max(CASE WHEN chunk % 2 = 0 THEN 0.9 ELSE 0.6 END)::DOUBLE AS confidence
FROM seen WHERE chunk * 30 <= place AND place + 1 < chunk * 30 + 40 GROUP BY chat_id, place""")
check("boundary_prompts", lambda v: CV.boundary_prompts(v.turns, 4, 1), chunk_sql("turns", 4, 3) + f"""
SELECT chat_id, chunk, chunk_start, count(*) AS rows, '{HEAD}' || string_agg('[' || chunk_position || '] ' ||
  strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' - ' || CASE WHEN is_from_me THEN 'Me' ELSE 'Contact (' || user_id || ')' END
  || ': ' || contents, chr(10) ORDER BY chunk_position) || '{TAIL}' AS prompt FROM chunked GROUP BY ALL""")
check("shifted_boundaries", lambda v: PC.boundaries_from_answers(v.answers), """
SELECT conv_id AS chat_id, turn * 170 + turn AS after_message_index, 'topic' AS reason, 0.9::DOUBLE AS confidence FROM conversations WHERE turn % 5 = 0
UNION ALL SELECT conv_id, turn * 171, 'bye', 0.8 FROM conversations WHERE turn % 5 = 1
UNION ALL SELECT conv_id, turn * 170 + 1, 'a', 0.8 FROM conversations WHERE turn % 5 = 4
UNION ALL SELECT conv_id, turn * 170 + 3, 'b', 0.5 FROM conversations WHERE turn % 5 = 4""")

# Context tables.

LAST_N = """
SELECT * EXCLUDE (rn), rn AS position FROM (SELECT *, row_number() OVER (
  PARTITION BY chat_id ORDER BY message_date DESC, message_id DESC) AS rn FROM in_chats) WHERE rn <= """
check("last_n_context", lambda v: CX.last_n_context(v.messages, v.chat_messages, 30).select("chat_id", "message_id", "contents", "position"),
      f"SELECT chat_id, message_id, contents, position FROM ({LAST_N} 30)")
check("last_n_context_salted", lambda v: CX.last_n_context(v.messages, v.chat_messages).select(
    "chat_id", "message_id", "contents", "position"), f"SELECT chat_id, message_id, contents, position FROM ({LAST_N} 2000)")
check("last_wins_lookup", lambda v: CT.last_wins(v.contacts, F.col("last_name")), """
SELECT key, first_name, last_name FROM (SELECT last_name AS key, first_name, last_name, row_number() OVER (
  PARTITION BY last_name ORDER BY load_order DESC, first_name DESC, last_name DESC) AS rn FROM contacts) WHERE rn = 1 AND key <> ''""")
ISO = """CASE WHEN epoch_us(created_at) % 1000000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END"""
check("history_lines", lambda v: CX.history_lines(v.in_chats), f"""
SELECT chat_id, message_id, '[' || {ISO} || '] ' || CASE WHEN is_from_me THEN 'You' ELSE 'Contact' END || ': ' || contents AS history_line,
  CASE WHEN is_from_me THEN 'You' ELSE 'Contact' END || ': ' || contents AS short_line FROM in_chats""")
check("context_size", lambda v: CX.context_size(v.turns), """
SELECT chat_id, count(*) AS messages, sum(length(contents))::BIGINT AS characters, (sum(length(contents)) // 4)::BIGINT AS tokens
FROM turns GROUP BY 1""")
R_HEAD, R_REST = (part.replace("'", "''") for part in CX.REPLY_TEMPLATE.split("{chat_history}"))
R_MID, R_TAIL = R_REST.split("{new_message}")


def _prompts(v: Inputs) -> DataFrame:
    requests = v.table("documents").select(
        F.col("doc_id").alias("chat_id"), F.lit("me").alias("user_id"), F.concat("lang", F.lit(" "), "source").alias("contents"),
        as_of().alias("created_at"))
    turns = v.turns.select("message_id", "user_id", "contents", "is_from_me", "created_at")
    return CX.prompt_dataset(requests, turns, v.turns.select("chat_id", "message_id", "message_date"), 3)


check("prompt_dataset", _prompts, f"""
, lines AS (SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, message_id DESC) AS rn,
  '[' || {ISO} || '] ' || CASE WHEN is_from_me THEN 'You' ELSE 'Contact' END || ': ' || contents AS line FROM turns),
history AS (SELECT chat_id, string_agg(line, chr(10) ORDER BY rn DESC) AS chat_history, count(*) AS n FROM lines WHERE rn <= 3 GROUP BY 1)
SELECT doc_id AS chat_id, 'me' AS user_id, coalesce(n, 0) AS context_messages,
  '{R_HEAD}' || coalesce(chat_history, '(No previous chat history)') || '{R_MID}' || '[2024-02-01T00:00:00] Contact: ' || lang || ' ' || source
  || '{R_TAIL}' AS prompt FROM documents LEFT JOIN history ON chat_id = doc_id""")

# Jobs.


def _built(v: Inputs) -> DataFrame:
    return PL.lake_report(PL.build_lake(v.sources, as_of=as_of()))


check("build_lake", _built, """
SELECT 'users' AS table_name, count(*) AS rows FROM users UNION ALL SELECT 'chats', count(*) FROM chats
UNION ALL SELECT 'chat_users', count(*) FROM chat_users UNION ALL SELECT 'messages', count(*) FROM messages
UNION ALL SELECT 'chat_messages', count(*) FROM chat_messages""")
check("build_report", lambda v: PL.build_report(v.sources, v.lake), """
SELECT *, round(target_messages::DOUBLE / greatest(eligible_messages, 1), 6) AS migration_coverage FROM (
  SELECT (SELECT count(*) FROM message) AS source_messages,
    (SELECT count(*) FROM message WHERE text IS NOT NULL OR has_body) AS eligible_messages,
    (SELECT count(*) FROM messages) AS target_messages, (SELECT count(*) FROM chats) AS chats_migrated,
    (SELECT count(*) FROM chat_messages) AS chat_messages_migrated, (SELECT count(*) FROM chat_users) AS relationships_created)""")
check("normalize_messages", lambda v: M.normalize_messages(v.message, v.users, as_of()), f"""
SELECT message_id, user_id, contents, is_from_me, {sql_ts('created_at')} AS created_at FROM messages""")
SYNCED = f"SELECT message_id, user_id, contents, is_from_me, {sql_ts('created_at')} AS created_at"
KNOWN = " FROM messages WHERE user_id NOT LIKE 'unknown%' AND user_id <> md5('handle:0')"
check("normalize_increment", lambda v: M.normalize_increment(v.message, v.users, as_of()), SYNCED + KNOWN)
check("poll_once", lambda v: M.incremental_sync(v.message, v.users, 400, None, as_of()),
      SYNCED + ", (SELECT max(rowid) FROM message WHERE rowid > 400) AS next_mark" + KNOWN + " AND message_id > 400")


def _stream(v: Inputs) -> SY.SyncTarget:
    """Follow the events file as a message stream into an empty lake."""
    target = SY.SyncTarget(scratch_path(v.spark, "sync"))
    schema = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").schema
    query = SY.start_sync(
        v.spark, v.sf_dir, target, v.handle, v.contacts, as_of=as_of(),
        path_filter="events.parquet", transform=v.as_messages, source_schema=schema)
    query.awaitTermination()
    return target


check("poll_stream", lambda v: _stream(v).read(v.spark, "messages"), SYNCED + KNOWN)
check("stream_resolve_users", lambda v: _stream(v).read(v.spark, "users"), """
SELECT user_id, first_name, last_name, phone_number, email, handle_id FROM resolved
WHERE handle_id <> 0 AND handle_id IN (SELECT handle_id FROM message)""")
check("sync_state", lambda v: SY.sync_state(v.spark, _stream(v)).select(
    "last_processed_rowid", "total_messages_processed", "sync_status"), f"""
SELECT (SELECT max(rowid) FROM message) AS last_processed_rowid, (SELECT count(*) {KNOWN}) AS total_messages_processed,
  'idle' AS sync_status""")


def _idempotent(v: Inputs) -> DataFrame:
    """The whole log as batch 0, replayed, then delivered again as batch 1."""
    target = SY.SyncTarget(scratch_path(v.spark, "replay"))
    base = v.spark.createDataFrame([], schemas.USERS)
    for batch_id in (0, 0, 1):
        SY.sync_batch(v.message, batch_id, target, v.handle, v.contacts, base, as_of())
    return target.read(v.spark, "messages")


check("idempotent_write", _idempotent, SYNCED + KNOWN)


def _any_order(v: Inputs) -> DataFrame:
    """Three batches whose ids lie between those of earlier ones; the first comes again at the end."""
    target = SY.SyncTarget(scratch_path(v.spark, "order"))
    base = v.spark.createDataFrame([], schemas.USERS)
    for batch_id, part in enumerate((2, 0, 1, 2)):
        SY.sync_batch(v.message.where(F.col("rowid") % 3 == part), batch_id, target, v.handle, v.contacts, base, as_of())
    return target.read(v.spark, "messages")


def _late_handles(v: Inputs) -> DataFrame:
    """A third of the handles is added after the batch that brings their messages."""
    target, late = SY.SyncTarget(scratch_path(v.spark, "late")), []
    base = v.spark.createDataFrame([], schemas.USERS)

    def handles() -> DataFrame:
        return v.handle if late else v.handle.where("handle_id % 3 <> 0")

    for batch_id in (0, 1, 1):
        rows = v.message.where(F.col("rowid") % 2 == batch_id)
        SY.sync_batch(rows, batch_id, target, handles, lambda: v.contacts, base, as_of())
        late.append(batch_id)
    return target.read(v.spark, "messages")


check("sync_any_order", _any_order, SYNCED + KNOWN)
check("sync_late_handles", _late_handles, SYNCED + KNOWN)


def _notified(v: Inputs) -> DataFrame:
    """What the hook of a batch wrote."""
    target = SY.SyncTarget(scratch_path(v.spark, "notify"))
    path = scratch_path(v.spark, "notified")

    def hook(rows: DataFrame, synced: int) -> None:
        SY.notify_rows(v.users)(rows).withColumn("synced", F.lit(synced)).write.parquet(path)

    SY.sync_batch(v.message, 0, target, v.handle, v.contacts, v.users, as_of(), on_new_messages=hook)
    return v.spark.read.parquet(path).select("rowid", "content", "more", "synced")


check("on_new_messages", _notified, f"""
SELECT rowid, trim(coalesce(nullif(extracted_text, ''), nullif(text, ''), '[No content]')) AS content,
  (SELECT count(*) FROM message) - 5 AS more, (SELECT count(*) {KNOWN}) AS synced
FROM (SELECT * FROM extracted ORDER BY rowid LIMIT 5)""")


def _live_sessions(v: Inputs) -> DataFrame:
    schema = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").schema
    events = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    rows = events.select(F.col("user_id").alias("chat_id"), F.expr("event_id + 1").alias("message_id"),
                         F.col("ts").cast("timestamp").alias("created_at"))
    path = scratch_path(v.spark, "sessions")
    query = SS.stream_conversations(rows).writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return v.spark.read.parquet(path)


check("stream_conversations", _live_sessions, SEGMENTS + f"""
SELECT chat_id, start_message_id, end_message_id, message_count, {sql_ts('start_time')} AS start_time, {sql_ts('end_time')} AS end_time
FROM found WHERE epoch_us(end_time) + 172800000000 - 1 <= (SELECT epoch_us(max(ts)) FROM events) // 1000 * 1000 - 3600000000""")

# Retrieval.

WORDS = "the of und que"
TERMS = WORDS.split()
BM25 = """
, toks AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
hit AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks)
  WHERE term IN (""" + ", ".join(f"'{t}'" for t in TERMS) + """) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))) AS score
  FROM hit JOIN dfs USING (term) JOIN toks USING (id), stats GROUP BY id),
bm_top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm ORDER BY score DESC, id LIMIT 20)"""
COSINE = """
, q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
cos_top AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv) AS score,
  row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], qv) DESC, vec_id) AS rank
  FROM embeddings, q ORDER BY score DESC, id LIMIT 20)"""


def by_keyword(v: Inputs) -> DataFrame:
    return RT.bm25_topk(v.table("documents"), WORDS, 20)


def by_meaning(v: Inputs) -> DataFrame:
    vectors = v.table("embeddings")
    query = vectors.orderBy("vec_id").first()["embedding"]
    return RT.cosine_topk(vectors, query, 20)


check("episodes", lambda v: RT.episodes(v.table("documents").select(
    F.expr("concat('doc-', doc_id)").alias("name"), F.col("text").alias("content"), F.lit("text").alias("type"),
    F.lit(None).cast("string").alias("description"), F.lit(None).cast("timestamp").alias("reference_time")).unionByName(
        v.table("events").select(F.expr("concat('event-', event_id)").alias("name"), F.col("props").alias("content"),
                                 F.lit("json").alias("type"), F.col("event_type").alias("description"),
                                 F.col("ts").alias("reference_time"))), as_of()), f"""
SELECT 'doc-' || doc_id AS name, text AS episode_body, 'text' AS source, 'text episode' AS source_description,
  '2024-02-01 00:00:00.000000' AS reference_time FROM documents
UNION ALL SELECT 'event-' || event_id, props, 'json', event_type, {sql_ts('ts')} FROM events""")
check("bm25_topk", by_keyword, BM25 + " SELECT id, round(score, 6) AS score, rank FROM bm_top")
check("cosine_topk", by_meaning, COSINE + " SELECT id, round(score, 6) AS score, rank FROM cos_top")
check("hybrid_rrf", lambda v: RT.hybrid_rrf(by_keyword(v), by_meaning(v), 10), BM25 + COSINE + """
, fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT id, rank FROM bm_top UNION ALL SELECT id, rank FROM cos_top) GROUP BY id)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fused ORDER BY score DESC, id LIMIT 10""")
HOPS = """
, ways AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
h0 AS (SELECT center AS node, 0 AS hops FROM centers),
h1 AS (SELECT target AS node, 1 AS hops FROM ways JOIN h0 ON source = node),
h2 AS (SELECT DISTINCT target AS node, 2 AS hops FROM ways JOIN h1 ON source = node),
h3 AS (SELECT DISTINCT target AS node, 3 AS hops FROM ways JOIN h2 ON source = node),
reach AS (SELECT node, min(hops)::BIGINT AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2
  UNION ALL SELECT * FROM h3) GROUP BY node)"""
RERANK = """
SELECT id, 'c' || id AS node, round(score, 6) AS score, rank AS search_rank, hops,
  row_number() OVER (ORDER BY hops NULLS LAST, rank) AS rank FROM bm_top LEFT JOIN reach ON reach.node = 'c' || id"""


def located(v: Inputs) -> DataFrame:
    """Hits on facts; each fact belongs to a customer node."""
    return by_keyword(v).withColumn("node", F.concat(F.lit("c"), F.col("id").cast("string")))


check("graph_distance_rerank", lambda v: RT.graph_distance_rerank(
    located(v), v.edges, v.table("nation").orderBy("n_nationkey").limit(1).select(F.expr("concat('n', n_nationkey)"))),
    BM25 + ", centers AS (SELECT 'n' || min(n_nationkey) AS center FROM nation)" + HOPS + RERANK)
check("auto_center_rerank", lambda v: RT.auto_center_rerank(located(v), v.edges),
      BM25 + ", centers AS (SELECT 'c' || id AS center FROM bm_top WHERE rank = 1)" + HOPS + RERANK)
check("format_hits", lambda v: RT.format_hits(v.edges.select(
    F.concat("source", F.lit("-"), "target").alias("uuid"), F.concat("source", F.lit(" in "), "target").alias("fact"),
    F.col("source").alias("source_node_uuid"), F.col("target").alias("target_node_uuid"), as_of().alias("created_at"))), """
SELECT source || '-' || target AS uuid, source || ' in ' || target AS fact, source AS source_node_uuid, target AS target_node_uuid,
  '2024-02-01 00:00:00.000000' AS created_at, NULL::VARCHAR AS name, NULL::VARCHAR AS group_id, NULL::VARCHAR AS valid_at,
  NULL::VARCHAR AS invalid_at FROM edges""")
check("format_nodes", lambda v: RT.format_nodes(v.table("documents").select(
    F.expr("concat('doc-', doc_id)").alias("uuid"), F.col("source").alias("name"), F.col("text").alias("summary"),
    F.array("lang", "source").alias("labels"), as_of().alias("created_at"))), """
SELECT 'doc-' || doc_id AS uuid, source AS name, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS summary,
  lang || ', ' || source AS labels, '2024-02-01 00:00:00.000000' AS created_at, '{}' AS attributes FROM documents""")
