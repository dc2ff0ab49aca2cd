"""Chat-shaped tables derived from the given tables; ``PRELUDE`` derives the same in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatlake.functions.body import encode_body
from chatlake.functions.time import to_apple
from chatlake.operators import chats as CH, contacts as CT, messages as M
from chatlake.plans.lake import Lake, Sources
from chatlake.session import scratch_path, tune
from chatlake.sources import readers as R

AS_OF = "2024-02-01 00:00:00"
SEC = 1_000_000_000


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def case(expression: str) -> Column:
    return F.expr(f"CASE {expression} END")


# Lake tables written by this application: (application, data folder, table) -> path.
_WRITTEN: dict[tuple[str, str, str], str] = {}


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir
        self._schemas = {}

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        df = self.spark.read.schema(self._schemas[name]).parquet(path)
        return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else c for c, t in df.dtypes])

    def stored(self, name: str, build) -> DataFrame:
        """A lake table, built whole from the given tables once and read by every query."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            path = scratch_path(self.spark, f"lake-{name}")
            build().write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    # Source tables.

    @cached_property
    def handle(self) -> DataFrame:
        identifier = case("""
            WHEN c_custkey % 30 = 2 THEN concat('user', 2000000000 + c_custkey, '@example.com')
            WHEN c_custkey % 3 = 2 THEN concat(lower(c_name), '@example.com')
            WHEN c_custkey % 10 = 7 THEN concat('+44', 700000000 + c_custkey)
            ELSE concat('+1', 2000000000 + c_custkey)""")
        return self.table("customer").select(
            F.col("c_custkey").alias("handle_id"), identifier.alias("id"), F.lit("us").alias("country"),
            case("WHEN c_custkey % 4 = 0 THEN 'SMS' ELSE 'iMessage'").alias("service"))

    @cached_property
    def record(self) -> DataFrame:
        people = self.table("customer").select(
            F.expr("concat('book_', c_nationkey % 3)").alias("source"), F.col("c_custkey").alias("z_pk"),
            case("WHEN c_custkey % 11 <> 0 THEN 'Customer'").alias("first_name"),
            case("WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 17 <> 0 THEN c_mktsegment").alias("last_name"))
        firms = self.table("supplier").select(F.lit("book_3"), "s_suppkey", F.lit("Supplier"), "s_name")
        return people.union(firms)

    @cached_property
    def phone(self) -> DataFrame:
        n = "CAST(2000000000 + c_custkey AS STRING)"
        spelled = case(f"""
            WHEN c_custkey % 5 = 0 THEN NULL
            WHEN c_custkey % 4 = 0 THEN concat('(', substr({n},1,3), ') ', substr({n},4,3), '-', substr({n},7,4))
            WHEN c_custkey % 4 = 1 THEN concat(substr({n},1,3), '-', substr({n},4,3), '-', substr({n},7,4))
            WHEN c_custkey % 4 = 2 THEN concat(substr({n},1,3), '.', substr({n},4,3), '.', substr({n},7,4))
            ELSE concat('+1 ', substr({n},1,3), ' ', substr({n},4,3), ' ', substr({n},7,4))""")
        people = self.table("customer")
        source = F.expr("concat('book_', c_nationkey % 3)").alias("source")
        first = people.select(source, F.col("c_custkey").alias("owner"), F.col("c_custkey").alias("point_id"),
                              spelled.alias("full_number"))
        second = people.select(source, "c_custkey", F.expr("10000000000 + c_custkey"),
                               case("WHEN c_custkey % 6 = 0 THEN concat('1', 3000000000 + c_custkey)"))
        firms = self.table("supplier").select(F.lit("book_3"), "s_suppkey", F.expr("20000000000 + s_suppkey"),
                                              F.expr("concat('+1', 2000000000 + s_suppkey)"))
        return first.union(second).union(firms)

    @cached_property
    def email(self) -> DataFrame:
        people = self.table("customer").select(
            F.expr("concat('book_', c_nationkey % 3)").alias("source"), F.col("c_custkey").alias("owner"),
            F.col("c_custkey").alias("point_id"),
            case("WHEN c_custkey % 5 <> 0 THEN concat(c_name, '@Example.com')").alias("address"))
        firms = self.table("supplier").select(F.lit("book_3"), "s_suppkey", F.expr("20000000000 + s_suppkey"),
                                              F.expr("concat(s_name, '@Example.com')"))
        return people.union(firms)

    @cached_property
    def message(self) -> DataFrame:
        return self.as_messages(self.table("events"))

    @staticmethod
    def as_messages(events: DataFrame) -> DataFrame:
        """Events, at rest or streaming, as a message log."""
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
        said = F.concat("event_type", F.lit(" "), "props")
        date = F.when(F.expr("event_id % 29 = 0"), F.lit(0).cast("bigint")).otherwise(to_apple(F.col("ts")))
        body = (F.when(F.expr("event_id % 13 = 0"), F.unhex(F.lit("00010203")))
                .when(F.expr("event_id % 19 = 0"), F.lit(None).cast("binary")).otherwise(encode_body(said)))
        sent = F.expr("CAST(event_type = 'purchase' AS INT)")
        return events.select(
            F.expr("event_id + 1").alias("rowid"), F.expr("concat('guid-', event_id)").alias("guid"),
            F.when(F.expr("event_id % 7 = 0"), F.lit(None).cast("string")).when(F.expr("event_id % 11 = 0"), "")
            .when(F.expr("event_id % 23 = 0"), "   ").when(F.expr("event_id % 3 = 0"), F.concat(F.lit("  "), said))
            .otherwise(said).alias("text"),
            body.alias("attributed_body"),
            case("WHEN event_id % 17 <> 0 THEN user_id").alias("handle_id"), date.alias("date"),
            F.when(F.expr("event_id % 2 = 1"), date + 60 * SEC).alias("date_read"),
            (date + SEC).alias("date_delivered"), sent.alias("is_from_me"),
            F.expr("CAST(event_id % 2 AS INT)").alias("is_read"), F.lit(1).alias("is_delivered"), sent.alias("is_sent"),
            case("WHEN event_id % 4 = 0 THEN 'SMS' ELSE 'iMessage'").alias("service"),
            F.expr("concat('account-', event_id % 3)").alias("account"), F.lit(0).alias("error"))

    @cached_property
    def long_message(self) -> DataFrame:
        """Documents as messages whose text is in the body only, but for one in five."""
        said = F.col("text")
        return self.table("documents").select(
            (F.col("doc_id") + 1).alias("rowid"), F.when(F.col("doc_id") % 5 == 0, said).alias("text"),
            F.when(F.col("doc_id") % 9 != 0, encode_body(said)).alias("attributed_body"))

    @cached_property
    def chat(self) -> DataFrame:
        ids = self.table("customer").select(F.expr("1 + c_custkey div 4").alias("chat_id")).distinct()
        name = case("""WHEN chat_id % 3 = 0 THEN '' WHEN chat_id % 7 = 0 THEN NULL
            WHEN chat_id % 5 = 0 THEN concat('Chat ', chat_id) ELSE concat('NATION_', chat_id % 25)""")
        empty = self.table("region").select(F.expr("1000000000 + r_regionkey"), "r_name")
        return ids.select("chat_id", name.alias("display_name")).union(empty)

    @cached_property
    def chat_message_join(self) -> DataFrame:
        date = F.when(F.expr("event_id % 29 = 0"), F.lit(0).cast("bigint")).otherwise(to_apple(F.col("ts")))
        return self.table("events").select(F.expr("1 + user_id div 4").alias("chat_id"),
                                           F.expr("event_id + 1").alias("message_id"), date.alias("message_date"))

    @cached_property
    def chat_handle_join(self) -> DataFrame:
        return self.table("customer").select(F.expr("1 + c_custkey div 4").alias("chat_id"),
                                             F.col("c_custkey").alias("handle_id"))

    @cached_property
    def account(self) -> DataFrame:
        return self.table("nation").select(
            F.expr("concat('type-', n_regionkey)").alias("account_type"), F.col("n_name").alias("display_name"),
            F.expr("concat('ext-', n_nationkey)").alias("external_identifier"))

    @cached_property
    def copy(self) -> DataFrame:
        """A replica that stopped on 29 January."""
        stop = to_apple(F.lit("2024-01-29 00:00:00").cast("timestamp"))
        return self.message.where(F.col("date") < stop)

    @property
    def sources(self) -> Sources:
        return Sources(self.message, self.handle, self.chat, self.chat_message_join, self.chat_handle_join,
                       self.record, self.phone, self.email)

    @property
    def book(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.record, self.phone, self.email

    # Lake tables.

    @cached_property
    def contacts(self) -> DataFrame:
        return self.stored("contacts", lambda: CT.extract_contacts(*self.book))

    @cached_property
    def users(self) -> DataFrame:
        return self.stored("users", lambda: CT.build_users(self.handle, self.contacts))

    @cached_property
    def raw_chats(self) -> DataFrame:
        return R.scan_chats(self.chat)

    @cached_property
    def enhanced(self) -> DataFrame:
        return self.stored("chats", lambda: CH.enhance_display_names(
            self.raw_chats, self.chat_handle_join, self.handle, self.users))

    @cached_property
    def chats(self) -> DataFrame:
        return self.enhanced.select("chat_id", "display_name")

    @cached_property
    def chat_users(self) -> DataFrame:
        return self.stored("chat_users", lambda: CH.chat_users_build(self.chat_handle_join, self.users))

    @cached_property
    def messages(self) -> DataFrame:
        return self.stored("messages", lambda: M.normalize_messages(self.message, self.users, as_of()))

    @cached_property
    def chat_messages(self) -> DataFrame:
        return self.stored("chat_messages", lambda: R.scan_chat_messages(self.chat_message_join, as_of()))

    @property
    def lake(self) -> Lake:
        return Lake(self.users, self.chats, self.chat_users, self.messages, self.chat_messages)

    @cached_property
    def in_chats(self) -> DataFrame:
        return CH.in_chats(self.messages, self.chat_messages)

    # One chat per person, without the doctored dates: pauses of days occur here.

    @cached_property
    def direct(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("chat_id"), F.expr("event_id + 1").alias("message_id"),
            F.expr("concat('u', user_id)").alias("user_id"), F.expr("event_type = 'purchase'").alias("is_from_me"),
            F.col("ts").alias("created_at"), F.concat("event_type", F.lit(" "), "props").alias("contents"))

    @cached_property
    def turns(self) -> DataFrame:
        start = F.lit("2024-01-01 00:00:00").cast("timestamp")
        at = F.timestamp_micros(F.unix_micros(start) + (F.col("conv_id") * 3600 + F.col("turn") * 60) * 1_000_000)
        return self.table("conversations").select(
            F.col("conv_id").alias("chat_id"), F.expr("conv_id * 1000 + turn").alias("message_id"),
            F.expr("concat('p', conv_id)").alias("user_id"), F.expr("role = 'assistant'").alias("is_from_me"),
            at.alias("created_at"), at.alias("message_date"), F.col("text").alias("contents"))

    @cached_property
    def cuts(self) -> DataFrame:
        """Supplied boundaries, with repeats and some past the end."""
        return self.table("events").select(F.col("user_id").alias("chat_id"),
                                           F.expr("event_id % 97").alias("after_message_index"))

    @cached_property
    def answers(self) -> DataFrame:
        answer = case("""
            WHEN turn % 5 = 0 THEN concat('Sure: [{"after_message_index": ', turn, ', "reason": "topic", "confidence": 0.9}] ok')
            WHEN turn % 5 = 1 THEN concat('[{"after_message_index": ', turn, ', "reason": "bye"}]')
            WHEN turn % 5 = 2 THEN 'no boundaries here'
            WHEN turn % 5 = 3 THEN '[{"reason": "no index"}]'
            ELSE '[{"after_message_index": 3, "reason": "b", "confidence": 0.5}, {"after_message_index": 1, "reason": "a"}]'""")
        return self.table("conversations").select(
            F.col("conv_id").alias("chat_id"), "turn", F.expr("turn * 170").alias("chunk_start"), answer.alias("answer"))

    @cached_property
    def replies(self) -> DataFrame:
        answer = case("""
            WHEN turn % 4 = 0 THEN concat('Here: {"response_1": "a', turn, '", "response_2": "b", "response_3": "c"} bye')
            WHEN turn % 4 = 1 THEN '{"response_1": "a", "response_2": "  ", "response_3": "c"}'
            WHEN turn % 4 = 2 THEN 'nothing to say'
            ELSE '{"response_1": "a", "response_2": '""")
        return self.table("conversations").select("conv_id", "turn", answer.alias("answer"))

    @cached_property
    def send_log(self) -> DataFrame:
        recipient = case("""WHEN event_id % 5 = 0 THEN concat('user', user_id, '@example.com')
            WHEN event_id % 5 = 1 THEN concat('+1', 2000000000 + user_id)
            WHEN event_id % 5 = 2 THEN concat('(200) 000-', lpad(user_id, 4, '0'))
            WHEN event_id % 5 = 3 THEN 'nobody' ELSE ''""")
        contents = F.when(F.expr("event_id % 7 = 0"), "  ").when(F.expr("event_id % 11 = 0"), "").otherwise(
            F.concat("event_type", F.lit(" "), "props"))
        error = case("""WHEN event_type <> 'error' THEN NULL WHEN event_id % 5 = 0 THEN 'Network timeout'
            WHEN event_id % 5 = 1 THEN 'Permission denied' WHEN event_id % 5 = 2 THEN 'Rate exceeded'
            WHEN event_id % 5 = 3 THEN 'Connection refused' ELSE 'disk full'""")
        return self.table("events").select(
            F.col("event_id").alias("send_id"), F.expr("concat('u', user_id)").alias("sender"),
            recipient.alias("recipient"), contents.alias("contents"), F.col("ts").alias("sent_at"),
            F.expr("event_type <> 'error'").alias("success"), error.alias("error_message"),
            F.expr("event_id % 4").alias("retry_count"), F.col("value").alias("duration_seconds"))

    @cached_property
    def edges(self) -> DataFrame:
        people = self.table("customer").select(F.expr("concat('c', c_custkey)").alias("source"),
                                               F.expr("concat('n', c_nationkey)").alias("target"))
        return people.union(self.table("nation").select(F.expr("concat('n', n_nationkey)"),
                                                        F.expr("concat('r', n_regionkey)")))


def portable(df: DataFrame) -> DataFrame:
    """Plain column types that any checker reads the same way."""
    def plain(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind == "binary":
            c = F.hex(c)
        return c.alias(name)

    return df.select(*[plain(n, t) for n, t in df.dtypes])


# The same tables in SQL.

WS = "E' \\t\\n\\r'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def sql_national(x: str) -> str:
    d = sql_digits(x)
    return f"(CASE WHEN length({d}) = 11 AND {d} LIKE '1%' THEN substr({d}, 2) ELSE {d} END)"


def sql_phone10(x: str) -> str:
    return f"(CASE WHEN length({sql_national(x)}) = 10 THEN {sql_national(x)} END)"


def sql_normal_phone(x: str) -> str:
    n = sql_national(x)
    return (f"(CASE WHEN length({n}) = 10 THEN '(' || substr({n},1,3) || ') ' || substr({n},4,3) || '-' || "
            f"substr({n},7,4) ELSE coalesce({x}, '') END)")


def sql_apple(x: str, fallback: str = "NULL::TIMESTAMP") -> str:
    return (f"(CASE WHEN {x} <> 0 AND {x} // 1000 + 978307200000000 BETWEEN 0 AND 4102444800000000 "
            f"THEN make_timestamp({x} // 1000 + 978307200000000) ELSE {fallback} END)")


_N = "(2000000000 + c_custkey)::VARCHAR"
_AS_OF = f"TIMESTAMP '{AS_OF}'"

PRELUDE = f"""
WITH handle AS (
  SELECT c_custkey AS handle_id,
    CASE WHEN c_custkey % 30 = 2 THEN 'user' || (2000000000 + c_custkey) || '@example.com'
         WHEN c_custkey % 3 = 2 THEN lower(c_name) || '@example.com'
         WHEN c_custkey % 10 = 7 THEN '+44' || (700000000 + c_custkey)
         ELSE '+1' || (2000000000 + c_custkey) END AS id,
    'us' AS country, CASE WHEN c_custkey % 4 = 0 THEN 'SMS' ELSE 'iMessage' END AS service
  FROM customer),
record AS (
  SELECT 'book_' || (c_nationkey % 3) AS source, c_custkey AS z_pk,
    CASE WHEN c_custkey % 11 <> 0 THEN 'Customer' END AS first_name,
    CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS last_name
  FROM customer
  UNION ALL SELECT 'book_3', s_suppkey, 'Supplier', s_name FROM supplier),
phone AS (
  SELECT 'book_' || (c_nationkey % 3) AS source, c_custkey AS owner, c_custkey AS point_id,
    CASE WHEN c_custkey % 5 = 0 THEN NULL
      WHEN c_custkey % 4 = 0 THEN '(' || substr({_N},1,3) || ') ' || substr({_N},4,3) || '-' || substr({_N},7,4)
      WHEN c_custkey % 4 = 1 THEN substr({_N},1,3) || '-' || substr({_N},4,3) || '-' || substr({_N},7,4)
      WHEN c_custkey % 4 = 2 THEN substr({_N},1,3) || '.' || substr({_N},4,3) || '.' || substr({_N},7,4)
      ELSE '+1 ' || substr({_N},1,3) || ' ' || substr({_N},4,3) || ' ' || substr({_N},7,4) END AS full_number
  FROM customer
  UNION ALL SELECT 'book_' || (c_nationkey % 3), c_custkey, 10000000000 + c_custkey,
    CASE WHEN c_custkey % 6 = 0 THEN '1' || (3000000000 + c_custkey) END FROM customer
  UNION ALL SELECT 'book_3', s_suppkey, 20000000000 + s_suppkey, '+1' || (2000000000 + s_suppkey) FROM supplier),
email AS (
  SELECT 'book_' || (c_nationkey % 3) AS source, c_custkey AS owner, c_custkey AS point_id,
    CASE WHEN c_custkey % 5 <> 0 THEN c_name || '@Example.com' END AS address FROM customer
  UNION ALL SELECT 'book_3', s_suppkey, 20000000000 + s_suppkey, s_name || '@Example.com' FROM supplier),
message AS (
  SELECT event_id + 1 AS rowid, 'guid-' || event_id AS guid,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' WHEN event_id % 23 = 0 THEN '   '
         WHEN event_id % 3 = 0 THEN '  ' || event_type || ' ' || props ELSE event_type || ' ' || props END AS text,
    (event_id % 13 = 0 OR event_id % 19 <> 0) AS has_body,
    CASE WHEN event_id % 13 <> 0 AND event_id % 19 <> 0 THEN event_type || ' ' || props END AS decoded,
    CASE WHEN event_id % 17 <> 0 THEN user_id END AS handle_id,
    CASE WHEN event_id % 29 = 0 THEN 0 ELSE (epoch_us(ts) - 978307200000000) * 1000 END AS date,
    CASE WHEN event_id % 2 = 1 THEN
      CASE WHEN event_id % 29 = 0 THEN 0 ELSE (epoch_us(ts) - 978307200000000) * 1000 END + 60000000000 END AS date_read,
    CASE WHEN event_id % 29 = 0 THEN 0 ELSE (epoch_us(ts) - 978307200000000) * 1000 END + 1000000000 AS date_delivered,
    CASE WHEN event_type = 'purchase' THEN 1::BIGINT ELSE 0 END AS is_from_me, event_id % 2 AS is_read, 1 AS is_delivered,
    CASE WHEN event_type = 'purchase' THEN 1::BIGINT ELSE 0 END AS is_sent,
    CASE WHEN event_id % 4 = 0 THEN 'SMS' ELSE 'iMessage' END AS service, 'account-' || (event_id % 3) AS account,
    0::BIGINT AS error
  FROM events),
extracted AS (
  SELECT *, coalesce(nullif({sql_strip('text')}, ''), decoded) AS extracted_text FROM message),
long_message AS (
  SELECT doc_id + 1 AS rowid, CASE WHEN doc_id % 5 = 0 THEN text END AS text, doc_id % 9 <> 0 AND text IS NOT NULL AS has_body,
    nullif({sql_strip('text')}, '') AS said FROM documents),
long_extracted AS (
  SELECT rowid, text, has_body, CASE WHEN has_body OR coalesce({sql_strip('text')}, '') <> '' THEN said END AS extracted_text
  FROM long_message),
copy AS (SELECT * FROM extracted WHERE date < (epoch_us(TIMESTAMP '2024-01-29') - 978307200000000) * 1000),
chat AS (
  SELECT chat_id, CASE WHEN chat_id % 3 = 0 THEN '' WHEN chat_id % 7 = 0 THEN NULL
    WHEN chat_id % 5 = 0 THEN 'Chat ' || chat_id ELSE 'NATION_' || (chat_id % 25) END AS display_name
  FROM (SELECT DISTINCT 1 + c_custkey // 4 AS chat_id FROM customer)
  UNION ALL SELECT 1000000000 + r_regionkey, r_name FROM region),
chat_message_join AS (
  SELECT 1 + user_id // 4 AS chat_id, event_id + 1 AS message_id,
    CASE WHEN event_id % 29 = 0 THEN 0 ELSE (epoch_us(ts) - 978307200000000) * 1000 END AS message_date FROM events),
chat_handle_join AS (SELECT 1 + c_custkey // 4 AS chat_id, c_custkey AS handle_id FROM customer),
account AS (SELECT 'type-' || n_regionkey AS account_type, n_name AS display_name,
  'ext-' || n_nationkey AS external_identifier FROM nation),
named AS (SELECT * FROM record WHERE first_name IS NOT NULL OR last_name IS NOT NULL),
people AS (
  SELECT r.source || ':' || lpad(r.z_pk::VARCHAR, 12, '0') AS seen_at, coalesce(first_name, '') AS first_name,
    coalesce(last_name, '') AS last_name,
    (SELECT {sql_normal_phone('min(p.full_number)')} FROM phone p WHERE p.source = r.source AND p.owner = r.z_pk
       AND p.full_number <> '') AS phone_number,
    coalesce((SELECT min(lower(e.address)) FROM email e WHERE e.source = r.source AND e.owner = r.z_pk
       AND e.address <> ''), '') AS email
  FROM named r),
contacts AS (
  SELECT md5(concat_ws(':', 'contact', first_name, last_name, phone_number, email)) AS user_id, first_name, last_name,
    phone_number, email, NULL::BIGINT AS handle_id, min(seen_at) AS load_order
  FROM people WHERE (first_name <> '' OR last_name <> '') AND (phone_number <> '' OR email <> '')
  GROUP BY first_name, last_name, phone_number, email),
phone_keys AS (
  SELECT key, first_name, last_name FROM (
    SELECT {sql_phone10('phone_number')} AS key, first_name, last_name, row_number() OVER (
      PARTITION BY {sql_phone10('phone_number')} ORDER BY load_order DESC, first_name DESC, last_name DESC) AS rn
    FROM contacts) WHERE rn = 1 AND key IS NOT NULL),
email_keys AS (
  SELECT key, first_name, last_name FROM (
    SELECT lower({sql_strip('email')}) AS key, first_name, last_name, row_number() OVER (
      PARTITION BY lower({sql_strip('email')}) ORDER BY load_order DESC, first_name DESC, last_name DESC) AS rn
    FROM contacts) WHERE rn = 1 AND key <> ''),
resolved AS (
  SELECT md5('handle:' || h.handle_id) AS user_id,
    coalesce(p.first_name, e.first_name, '') AS first_name, coalesce(p.last_name, e.last_name, '') AS last_name,
    CASE WHEN p.key IS NOT NULL THEN p.key WHEN e.key IS NOT NULL THEN ''
         WHEN length({sql_digits('h.id')}) >= 10 THEN coalesce({sql_phone10('h.id')}, h.id)
         WHEN h.id LIKE '%@%' AND h.id LIKE '%.%' THEN '' WHEN h.id SIMILAR TO '.*[0-9].*' THEN h.id ELSE '' END AS phone_number,
    CASE WHEN p.key IS NOT NULL THEN '' WHEN e.key IS NOT NULL THEN h.id
         WHEN length({sql_digits('h.id')}) >= 10 THEN ''
         WHEN h.id LIKE '%@%' AND h.id LIKE '%.%' THEN h.id WHEN h.id SIMILAR TO '.*[0-9].*' THEN '' ELSE h.id END AS email,
    h.handle_id,
    CASE WHEN p.key IS NOT NULL THEN 'phone' WHEN e.key IS NOT NULL THEN 'email' ELSE 'fallback' END AS match_kind
  FROM handle h
  LEFT JOIN phone_keys p ON length({sql_digits('h.id')}) >= 10 AND p.key = {sql_phone10('h.id')}
  LEFT JOIN email_keys e ON h.id LIKE '%@%' AND h.id LIKE '%.%' AND e.key = lower({sql_strip('h.id')})),
users AS (
  SELECT user_id, first_name, last_name, phone_number, email, handle_id FROM contacts
  UNION ALL SELECT user_id, first_name, last_name, phone_number, email, handle_id FROM resolved),
messages AS (
  SELECT m.rowid AS message_id,
    coalesce(u.user_id, 'unknown_user_' || coalesce(m.handle_id::VARCHAR, 'none')) AS user_id,
    m.extracted_text AS contents, m.is_from_me <> 0 AS is_from_me,
    {sql_apple('m.date', _AS_OF)} AS created_at
  FROM extracted m LEFT JOIN users u ON u.handle_id = m.handle_id
  WHERE (m.text IS NOT NULL OR m.has_body) AND {sql_strip('m.extracted_text')} <> ''),
raw_chats AS (
  SELECT chat_id, CASE WHEN {sql_strip("coalesce(display_name, '')")} = '' THEN 'Chat ' || chat_id ELSE display_name END
    AS display_name FROM chat),
chat_messages AS (
  SELECT chat_id, message_id, {sql_apple('message_date', _AS_OF)} AS message_date FROM chat_message_join),
chat_users AS (
  SELECT DISTINCT j.chat_id, u.user_id FROM chat_handle_join j JOIN users u ON u.handle_id = j.handle_id
  WHERE u.handle_id <> 0),
name_parts AS (
  SELECT j.chat_id, j.handle_id, CASE WHEN label IS NULL THEN 1 ELSE 0 END AS bare, coalesce(label, h.id) AS label
  FROM chat_handle_join j JOIN handle h USING (handle_id) LEFT JOIN (
    SELECT handle_id, CASE WHEN first_name <> '' AND last_name <> '' THEN first_name || ' ' || last_name
      WHEN phone_number <> '' THEN phone_number WHEN email <> '' THEN email END AS label
    FROM users WHERE handle_id IS NOT NULL) u USING (handle_id)),
generated AS (
  SELECT chat_id, string_agg(label, ', ' ORDER BY bare, handle_id) FILTER (rn <= 3)
    || CASE WHEN count(*) > 3 THEN '...' ELSE '' END AS generated_name
  FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY bare, handle_id) AS rn FROM name_parts)
  GROUP BY chat_id),
enhanced AS (
  SELECT c.chat_id, c.display_name AS old_name, coalesce(g.generated_name, 'Chat ' || c.chat_id) AS generated_name,
    c.display_name LIKE 'Chat %' AS needs,
    c.display_name LIKE 'Chat %' AND coalesce(g.generated_name, 'Chat ' || c.chat_id) NOT LIKE 'Chat %' AS better
  FROM raw_chats c LEFT JOIN generated g USING (chat_id)),
chats AS (SELECT chat_id, CASE WHEN better THEN generated_name ELSE old_name END AS display_name FROM enhanced),
in_chats AS (SELECT cm.chat_id, m.message_id, m.user_id, m.contents, m.is_from_me, m.created_at, cm.message_date
  FROM messages m JOIN chat_messages cm USING (message_id)),
direct AS (
  SELECT user_id AS chat_id, event_id + 1 AS message_id, 'u' || user_id AS user_id, event_type = 'purchase' AS is_from_me,
    ts AS created_at, event_type || ' ' || props AS contents FROM events),
turns AS (
  SELECT conv_id AS chat_id, conv_id * 1000 + turn AS message_id, 'p' || conv_id AS user_id,
    role = 'assistant' AS is_from_me,
    make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (conv_id * 3600 + turn * 60) * 1000000) AS created_at,
    text AS contents FROM conversations),
cuts AS (SELECT user_id AS chat_id, event_id % 97 AS after_message_index FROM events),
send_log AS (
  SELECT event_id AS send_id, 'u' || user_id AS sender,
    CASE event_id % 5 WHEN 0 THEN 'user' || user_id || '@example.com' WHEN 1 THEN '+1' || (2000000000 + user_id)
      WHEN 2 THEN '(200) 000-' || lpad(user_id::VARCHAR, 4, '0') WHEN 3 THEN 'nobody' ELSE '' END AS recipient,
    CASE WHEN event_id % 7 = 0 THEN '  ' WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || props END AS contents,
    ts AS sent_at, event_type <> 'error' AS success,
    CASE WHEN event_type <> 'error' THEN NULL ELSE CASE event_id % 5 WHEN 0 THEN 'Network timeout'
      WHEN 1 THEN 'Permission denied' WHEN 2 THEN 'Rate exceeded' WHEN 3 THEN 'Connection refused'
      ELSE 'disk full' END END AS error_message,
    event_id % 4 AS retry_count, value AS duration_seconds FROM events),
edges AS (
  SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
"""
