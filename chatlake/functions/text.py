"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Unicode counts as whitespace, plus the four
# separator controls.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0        "
    "        　"
)
NO_TEXT = "[No text content]"
NO_HISTORY = "(No previous chat history)"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def present(value: Column) -> Column:
    """Neither NULL nor ''."""
    return F.coalesce(value != "", F.lit(False))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def not_blank(value: Column) -> Column:
    return F.coalesce(strip(value) != "", F.lit(False))


def prefer_text(text: Column, decoded: Column) -> Column:
    """Stripped ``text`` unless blank, else the stripped ``decoded`` text, else NULL."""
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.nullif(strip(decoded), F.lit("")))


def text_source(text: Column, body: Column, extracted: Column) -> Column:
    has_body = F.coalesce(F.length(body) > 0, F.lit(False))
    return (
        F.when(not_blank(text), F.lit("text_column"))
        .when(present(extracted) & has_body, F.lit("attributed_body_decoded"))
        .when(has_body, F.lit("attributed_body_failed"))
        .otherwise(F.lit("no_text_available"))
    )


def truncate_ellipsis(value: Column, limit: int = 100) -> Column:
    short = strip(value)
    return (
        F.when(~present(value), F.lit(NO_TEXT))
        .when(F.length(short) > limit, F.concat(F.left(short, F.lit(limit - 3)), F.lit("...")))
        .otherwise(short)
    )


def content_check(value: Column, limit: int = 1000) -> Column:
    """'ok' or the reason a message may not be sent."""
    return (
        F.when(~present(value), F.lit("empty"))
        .when(F.length(value) > limit, F.lit("too_long"))
        .when(~not_blank(value), F.lit("blank"))
        .otherwise(F.lit("ok"))
    )


def send_error_class(message: Column) -> Column:
    lowered = F.lower(message)

    def mentions(*words: str) -> Column:
        return lowered.rlike("|".join(words))

    return (
        F.when(message.isNull(), F.lit(None).cast("string"))
        .when(mentions("network", "connection"), F.lit("network"))
        .when(mentions("auth", "permission"), F.lit("auth"))
        .when(mentions("rate", "limit"), F.lit("rate"))
        .otherwise(F.lit("other"))
    )


def suspicious_text(value: Column) -> Column:
    """Signs of a wrong decoding: escape sequences, replacement marks, control runs."""
    return (
        value.contains("\\x") | value.contains("\\u") | value.contains("\ufffd")
        | F.left(value, F.lit(10)).rlike("^[\\x00-\\x1f]+$")
    )


def _ascii_lower(value: Column) -> Column:
    return F.translate(value, _UPPER, _UPPER.lower())


def contains_term(value: Column, term: str) -> Column:
    """Substring test that ignores ASCII case; ``%`` and ``_`` in the term are wildcards."""
    lowered = "".join(c.lower() if c in _UPPER else c for c in term).replace("\\", "\\\\")
    return _ascii_lower(value).like(f"%{lowered}%")


def sender_label(is_from_me: Column, other: Column | str = "Contact", me: str = "You") -> Column:
    other = F.lit(other) if isinstance(other, str) else other
    return F.when(is_from_me, F.lit(me)).otherwise(other)


def short_line(is_from_me: Column, contents: Column) -> Column:
    return F.concat(sender_label(is_from_me), F.lit(": "), contents)


def history_line(created_at: Column, is_from_me: Column, contents: Column) -> Column:
    return F.concat(F.lit("["), created_at, F.lit("] "), short_line(is_from_me, contents))


def numbered_line(position: Column, created_at: Column, is_from_me: Column, user_id: Column,
                  contents: Column) -> Column:
    contact = F.concat(F.lit("Contact ("), user_id, F.lit(")"))
    return F.concat(
        F.lit("["), position.cast("string"), F.lit("] "), F.date_format(created_at, "yyyy-MM-dd HH:mm:ss"),
        F.lit(" - "), sender_label(is_from_me, contact, me="Me"), F.lit(": "), contents,
    )
