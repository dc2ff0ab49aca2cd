"""Text of a binary rich-text message body.

Most bodies carry the text behind one fixed marker; built-in expressions read
those. Only the bodies they cannot read are handed to Python.
"""

from __future__ import annotations

import plistlib
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chatlake.functions.text import not_blank, prefer_text, strip

# Fixed values of the body formats.
STREAM_HEADER = b"\x04\x0bstreamtyped"
STRING_CLASS = b"NSString"
TEXT_MARKER = b"\x94\x84\x01+"
PLIST_HEADER = b"bplist"
PLIST_TEXT_KEYS = ("NSString", "string", "text", "content")
FIXED_LENGTH_OFFSET = 21  # from the start of the class name to the length byte
CLASS_NAME_PARTS = (
    "nsstring", "nsattributed", "nsmutable", "nsarchive", "streamtyped", "nskeyedarchiver", "nsobject",
)
# A length below SHORT_LENGTH is one byte; these two announce one of two or four bytes, little-endian.
SHORT_LENGTH, LENGTH_2, LENGTH_4 = 0x81, 0x81, 0x82
# Control characters that are no white space: no text holds them.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_READABLE_RUN = re.compile(rb"[\t\n\r\x20-\x7e\x80-\xff]{4,}")


def _framed(body: bytes, at: int) -> bytes:
    """The bytes behind the length at ``at``; empty unless all are there."""
    wide = {LENGTH_2: 2, LENGTH_4: 4}.get(body[at], 0) if at < len(body) else 0
    start = at + 1 + wide
    if start >= len(body):
        return b""
    end = start + (int.from_bytes(body[at + 1:start], "little") if wide else body[at])
    return body[start:end] if end <= len(body) else b""


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return ""


def _stream_text(body: bytes) -> str:
    name = body.find(STRING_CLASS)
    if not body.startswith(STREAM_HEADER) or name < 0:
        return ""
    after = name + len(STRING_CLASS)
    marker, plus = body.find(TEXT_MARKER, after), body.find(b"+", after)
    marked = _utf8(_framed(body, marker + len(TEXT_MARKER))) if marker >= 0 else ""
    if marked.strip() and not _CONTROL.search(marked):
        return marked.strip()
    loose = _framed(body, plus + 1).decode("utf-8", "ignore") if plus >= 0 else ""
    loose = _CONTROL.sub("", loose).strip()
    return loose or _utf8(_framed(body, name + FIXED_LENGTH_OFFSET)).strip()


def _plist_strings(node):
    """Candidate texts of a property list, the well-known keys of a dict first."""
    if isinstance(node, str):
        yield node
    elif isinstance(node, dict):
        yield from (node[k] for k in PLIST_TEXT_KEYS if isinstance(node.get(k), str))
        for child in node.values():
            yield from _plist_strings(child)
    elif isinstance(node, list):
        for child in node:
            yield from _plist_strings(child)


def _plist_text(body: bytes) -> str:
    if not body.startswith(PLIST_HEADER):
        return ""
    try:
        return next((s for s in _plist_strings(plistlib.loads(body)) if s.strip()), "")
    except Exception:  # a damaged property list raises many kinds of errors
        return ""


def _longest_run(body: bytes) -> str:
    runs = (_utf8(m.group()).strip() for m in _READABLE_RUN.finditer(body))
    words = [
        s for s in runs
        if len(s) > 3 and any(map(str.isalpha, s)) and not any(p in s.lower() for p in CLASS_NAME_PARTS)
    ]
    return max(words, key=len, default="")


def body_text(body: bytes | None) -> str | None:
    """Text of one body, NULL when none is found."""
    if not body:
        return None
    body = bytes(body)
    return _stream_text(body) or _plist_text(body) or _longest_run(body) or None


# Executors need no copy of this package: the few functions above travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.StringType())
def _body_text_batch(bodies: pd.Series) -> pd.Series:
    return bodies.map(body_text, na_action="ignore")


# Keeps the optimizer from copying the call into filters above it.
_body_text_once = _body_text_batch.asNondeterministic()


def with_marked_text(df: DataFrame, body: str, name: str) -> DataFrame:
    """Add the text behind the fixed marker, by built-in expressions; NULL when not that simple.

    The steps are columns of their own so that no long expression is repeated.
    """
    latin, at, raw = F.col("_latin"), F.col("_at"), F.col("_raw")
    after_name = F.instr(latin, STRING_CLASS.decode()) + len(STRING_CLASS)
    marker = F.call_function("locate", F.lit(TEXT_MARKER.decode("latin-1")), latin, after_name)
    # The header ends before the name, so a name found at 0 or a marker at 0 means "none".
    is_stream = latin.startswith(STREAM_HEADER.decode("latin-1")) & (F.instr(latin, STRING_CLASS.decode()) > 0)
    byte = lambda i: F.ascii(F.substr(latin, at + i, F.lit(1))).cast("bigint")
    first = byte(0)
    # ``ascii`` gives the code of a Latin-1 character, hence the value of the byte.
    wide = F.when(first == LENGTH_2, 2).when(first == LENGTH_4, 4).otherwise(0)
    size = (
        F.when(first == LENGTH_2, byte(1) + 256 * byte(2))
        .when(first == LENGTH_4, byte(1) + 256 * (byte(2) + 256 * (byte(3) + 256 * byte(4)))).otherwise(first))
    start, length = F.col("_start"), F.col("_length")
    framed = (at > len(TEXT_MARKER)) & (length > 0) & (start + length - 1 <= F.length(latin))
    text = F.try_validate_utf8(F.substr(F.col(body), start.cast("int"), length.cast("int")).cast("string"))
    readable = not_blank(raw) & ~raw.rlike(_CONTROL.pattern)
    return (
        df.withColumn("_latin", F.decode(F.col(body), "ISO-8859-1"))
        .withColumn("_at", F.when(is_stream, marker + len(TEXT_MARKER)))
        .withColumn("_start", at + 1 + wide).withColumn("_length", size)
        .withColumn("_raw", F.when(framed, text))
        .withColumn(name, F.when(readable, strip(raw)))
        .drop("_latin", "_at", "_start", "_length", "_raw")
    )


def with_decoded(df: DataFrame, body: Column, name: str = "decoded") -> DataFrame:
    """Add the text of ``body``; Python reads only what built-in expressions cannot, and sees NULL for the rest.

    A filter in front of it would be pushed below the reading and repeat its long expression.
    """
    quick = with_marked_text(df.withColumn("_body", body), "_body", "_quick")
    rest = quick.withColumn("_slow", _body_text_once(F.when(F.col("_quick").isNull(), F.col("_body"))))
    return rest.withColumn(name, F.coalesce("_quick", "_slow")).drop("_body", "_quick", "_slow")


def with_best_text(df: DataFrame, name: str) -> DataFrame:
    """Add the stripped ``text`` of a source row, else the text of its body, else NULL."""
    blank = ~not_blank(F.col("text"))
    decoded = with_decoded(df, F.when(blank, F.col("attributed_body")), "_decoded")
    return decoded.withColumn(name, prefer_text(F.col("text"), F.col("_decoded"))).drop("_decoded")


def encode_body(text: Column) -> Column:
    """A marker-framed body around ``text`` of any length."""
    raw = F.encode(text, "UTF-8")
    head = STREAM_HEADER + b"\x81\xe8\x03\x84\x01@\x84\x84\x84" + STRING_CLASS + b"\x01" + TEXT_MARKER
    tail = b"\x86\x84\x02iI"
    size = F.length(raw)

    def little_endian(width: int) -> Column:
        big = F.lpad(F.hex(size), 2 * width, "0")
        return F.unhex(F.concat(*[F.substr(big, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(width))]))

    length = (
        F.when(size < SHORT_LENGTH, little_endian(1))
        .when(size < 1 << 16, F.concat(F.lit(bytearray([LENGTH_2])), little_endian(2)))
        .otherwise(F.concat(F.lit(bytearray([LENGTH_4])), little_endian(4))))
    return F.concat(F.lit(bytearray(head)), length, raw, F.lit(bytearray(tail)))
