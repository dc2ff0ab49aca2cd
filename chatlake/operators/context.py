"""Context tables for a text model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatlake.functions import text as X
from chatlake.functions.time import iso_text
from chatlake.operators.keys import keep_keys
from chatlake.operators.sequences import top_n_per_group

MAX_CONTEXT = 2000
CHARS_PER_TOKEN = 4

# The answer format is the one ``parse_responses`` reads.
REPLY_TEMPLATE = (
    "Suggest three natural replies to the new message, in the tone of the chat so far.\n\n"
    "Chat History:\n{chat_history}\n\nNew Message:\n{new_message}\n\n"
    'Answer as JSON: {"response_1": "...", "response_2": "...", "response_3": "..."}'
)


def last_n_context(messages: DataFrame, chat_messages: DataFrame, n: int = MAX_CONTEXT) -> DataFrame:
    """The latest ``n`` messages of each chat; ``position`` 1 is the newest.

    Rows are chosen on ids and dates alone; only the chosen ones fetch their text.
    """
    stored = keep_keys(chat_messages.select("chat_id", "message_id", "message_date"), messages, ["message_id"])
    newest = [F.col("message_date").desc(), F.col("message_id").desc()]
    chosen = top_n_per_group(stored, ["chat_id"], newest, n, "position")
    return messages.join(chosen, "message_id")


def history_lines(in_chats: DataFrame) -> DataFrame:
    """One formatted line per message."""
    when = iso_text(F.col("created_at"))
    return in_chats.select(
        "chat_id", "message_id",
        X.history_line(when, F.col("is_from_me"), F.col("contents")).alias("history_line"),
        X.short_line(F.col("is_from_me"), F.col("contents")).alias("short_line"),
    )


def _filled(template: str, **parts: Column) -> Column:
    """The template as a column expression, each ``{name}`` replaced by its column."""
    pieces: list[Column | str] = [template]
    for name, column in parts.items():
        mark = "{" + name + "}"
        split: list[Column | str] = []
        for piece in pieces:
            if isinstance(piece, str) and mark in piece:
                head, tail = piece.split(mark, 1)
                split += [head, column, tail]
            else:
                split.append(piece)
        pieces = split
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def history_texts(context: DataFrame) -> DataFrame:
    """The bounded context of each chat as one text, oldest line first."""
    line = X.history_line(iso_text(F.col("created_at")), F.col("is_from_me"), F.col("contents"))
    texts = context.groupBy("chat_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("position")).alias("p"), line.alias("line")))).alias("_lines"))
    joined = F.array_join(F.transform("_lines", lambda r: r["line"]), "\n")
    return texts.select("chat_id", joined.alias("chat_history"), F.size("_lines").alias("context_messages"))


def prompt_dataset(requests: DataFrame, messages: DataFrame, chat_messages: DataFrame, n: int = MAX_CONTEXT,
                   template: str = REPLY_TEMPLATE) -> DataFrame:
    """Prompt text per request (chat_id, user_id, contents, created_at) from the chat's last ``n`` messages."""
    wanted = keep_keys(chat_messages, requests, ["chat_id"])
    texts = history_texts(last_n_context(messages, wanted, n))
    new_message = X.history_line(iso_text(F.col("created_at")), F.lit(False), F.col("contents"))
    history = F.coalesce("chat_history", F.lit(X.NO_HISTORY))
    return requests.join(texts, "chat_id", "left").select(
        "chat_id", "user_id", F.coalesce("context_messages", F.lit(0)).alias("context_messages"),
        _filled(template, chat_history=history, new_message=new_message).alias("prompt"),
    )


def context_size(in_chats: DataFrame) -> DataFrame:
    """Characters and estimated tokens of each chat."""
    sizes = in_chats.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.length("contents")).alias("characters"))
    return sizes.withColumn("tokens", F.call_function("div", F.col("characters"), F.lit(CHARS_PER_TOKEN)))
