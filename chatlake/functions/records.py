"""Records exchanged with a text model: JSON round trip, parsing and field rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from chatlake import schemas
from chatlake.functions.text import not_blank, present
from chatlake.functions.time import valid_iso8601


def record_json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def parse_record(value: Column, schema: T.StructType) -> Column:
    return F.from_json(value, schema)


def parse_boundaries(answer: Column) -> Column:
    """Boundaries named in a free-text answer, ordered by index.

    The JSON array spans the first ``[`` to the last ``]``. Missing confidence
    means 0.8; an unusable answer gives an empty array.
    """
    raw_type = "array<struct<after_message_index:bigint,reason:string,confidence:string>>"
    raw = F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), raw_type)
    parsed = F.transform(
        raw,
        lambda b: F.struct(
            b["after_message_index"].alias("after_message_index"),
            b["reason"].alias("reason"),
            F.coalesce(b["confidence"], F.lit("0.8")).try_cast("double").alias("confidence"),
        ),
    )
    complete = F.forall(
        parsed,
        lambda b: b["after_message_index"].isNotNull() & b["reason"].isNotNull() & b["confidence"].isNotNull(),
    )
    ordered = F.array_sort(
        parsed, lambda a, b: F.signum(a["after_message_index"] - b["after_message_index"]).cast("int")
    )
    return F.when(F.coalesce(complete, F.lit(False)), ordered).otherwise(F.array().cast(schemas.BOUNDARIES))


def parse_responses(answer: Column) -> Column:
    """Struct of ``status`` and the three responses of a free-text answer."""
    found = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    parsed = F.from_json(found, schemas.RESPONSE)
    names = schemas.RESPONSE.fieldNames()
    status = F.when(~present(found), F.lit("no_json"))
    status = status.when(F.get_json_object(found, "$").isNull(), F.lit("invalid_json"))
    for name in names:
        status = status.when(~not_blank(parsed[name]), F.lit(f"bad_{name}"))
    status = status.otherwise(F.lit("ok"))
    return F.struct(
        status.alias("status"), *[F.when(status == "ok", parsed[n]).alias(n) for n in names]
    )


def violations(rules: dict[str, Column]) -> Column:
    """Names of the broken rules; each rule maps a name to 'is fine'."""
    flags = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*flags))


def request_rules(chat_id: Column, user_id: Column, contents: Column) -> dict[str, Column]:
    return {"chat_id": chat_id > 0, "user_id": present(user_id), "contents": present(contents)}


def response_rules(*responses: Column) -> dict[str, Column]:
    return {f"response_{i}": present(r) for i, r in enumerate(responses, 1)}


def history_rules(contents: Column, is_from_me: Column, created_at: Column) -> dict[str, Column]:
    return {
        "contents": present(contents),
        "is_from_me": is_from_me.isNotNull(),
        "created_at": valid_iso8601(created_at),
    }


def message_rules(message_id: Column, user_id: Column, contents: Column, is_from_me: Column,
                  chat_id: Column, created_at: Column, message_date: Column) -> dict[str, Column]:
    return {
        "message_id": message_id > 0,
        "user_id": present(user_id),
        "contents": present(contents),
        "is_from_me": is_from_me.isNotNull(),
        "chat_id": chat_id > 0,
        "created_at": present(created_at),
        "message_date": present(message_date),
    }


def user_rules(user_id: Column, first: Column, last: Column, phone: Column, email: Column,
               handle_id: Column) -> dict[str, Column]:
    """A handle-only user may have no name; every user needs a contact point."""
    return {
        "user_id": present(user_id),
        "name": present(first) | present(last) | handle_id.isNotNull(),
        "contact_point": present(phone) | present(email),
    }
