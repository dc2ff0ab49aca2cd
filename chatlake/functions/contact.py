"""Phone, e-mail and name expressions. Digits mean ASCII digits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chatlake.functions.text import present, strip


# Ten digits with anything between them, after an optional leading US country code.
# One pattern per value keeps plans small: nothing below repeats its argument often.
TEN_DIGITS = r"^[^0-9]*(?:1[^0-9]*)?" + r"([0-9])[^0-9]*" * 10 + "$"


def _spelled(value: Column, template: str) -> Column:
    """The ten digits written into ``template`` (one ``#`` each); other values unchanged."""
    for group in range(1, 11):
        template = template.replace("#", f"${group}", 1)
    return F.regexp_replace(value, TEN_DIGITS, template)


def _has_ten(value: Column) -> Column:
    return value.rlike(TEN_DIGITS)


def phone_digits(value: Column) -> Column:
    """Digits without a leading US country code; '' for a missing value."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")
    return F.regexp_replace(digits, "^1([0-9]{10})$", "$1")


def phone_from_handle(value: Column) -> Column:
    """The ten national digits, or NULL when there are not exactly ten."""
    return F.when(_has_ten(value), _spelled(value, "##########"))


def normalize_phone(value: Column) -> Column:
    """``(AAA) BBB-CCCC`` for ten national digits, else the value as it came."""
    return F.coalesce(_spelled(value, "(###) ###-####"), F.lit(""))


# The spellings under which a ten-digit number may be stored.
PHONE_SPELLINGS = (
    "##########", "(###) ###-####", "###-###-####", "###.###.####", "+1##########", "1##########",
)


def phone_formats(value: Column) -> Column:
    """Every spelling of a phone number; one that has no ten digits stands for itself."""
    return (
        F.when(_has_ten(value), F.array(*[_spelled(value, s) for s in PHONE_SPELLINGS]))
        .when(present(value), F.array(value))
        .otherwise(F.array().cast("array<string>"))
    )


def has_digit(value: Column) -> Column:
    return F.coalesce(value.rlike("[0-9]"), F.lit(False))


def looks_like_phone(value: Column) -> Column:
    return F.coalesce(value.rlike("(?:[0-9][^0-9]*){10}"), F.lit(False))


def looks_like_email(value: Column) -> Column:
    return F.coalesce(value.contains("@") & value.contains("."), F.lit(False))


def normalize_email(value: Column) -> Column:
    return F.coalesce(strip(F.lower(value)), F.lit(""))


def _dialled(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9+]", "")


def format_e164(value: Column) -> Column:
    dialled = _dialled(value)
    return (
        F.when(dialled.startswith("+"), dialled)
        .when(F.length(dialled) == 10, F.concat(F.lit("+1"), dialled))
        .when((F.length(dialled) == 11) & dialled.startswith("1"), F.concat(F.lit("+"), dialled))
        .otherwise(value)
    )


def valid_phone(value: Column) -> Column:
    return F.coalesce(_dialled(value).rlike(r"^(\+[0-9]{10,}|[0-9]{10,11})$"), F.lit(False))


def messaging_contact(phone: Column) -> Column:
    return F.when(present(phone), format_e164(phone))


def valid_recipient(value: Column) -> Column:
    """An e-mail address, or 10 to 16 digits once punctuation is dropped."""
    # The patterns of valid recipients.
    email = strip(value).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")
    phone = _dialled(value).rlike(r"^\+?1?[0-9]{10,15}$")
    return F.coalesce(email | phone, F.lit(False))


def full_name(first: Column, last: Column) -> Column:
    """The present name parts joined by a space, NULL when there are none."""
    parts = F.concat_ws(" ", F.when(present(first), first), F.when(present(last), last))
    return F.when(present(first) | present(last), parts)


def user_label(first: Column, last: Column, phone: Column, email: Column) -> Column:
    points = F.concat_ws(
        ", ",
        F.when(present(phone), F.concat(F.lit("phone: "), phone)),
        F.when(present(email), F.concat(F.lit("email: "), email)),
    )
    suffix = F.when(present(points), F.concat(F.lit(" ("), points, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(first, F.lit(" "), last, suffix)


def sender_name(is_from_me: Column, handle_id: Column, user) -> Column:
    """Who wrote a message; ``user`` maps a field name to its (nullable) column."""
    first, last = (F.coalesce(user(f), F.lit("")) for f in ("first_name", "last_name"))
    return (
        F.when(is_from_me, F.lit("You"))
        .when(F.coalesce(handle_id, F.lit(0)) == 0, F.lit("Unknown"))
        .when(present(first) | present(last), strip(F.concat(first, F.lit(" "), last)))
        .when(present(user("phone_number")), user("phone_number"))
        .when(present(user("email")), user("email"))
        .otherwise(F.concat(F.lit("Handle "), handle_id.cast("string")))
    )
