import plistlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chatlake.functions import body as B
from chatlake.operators import quality as Q
from chatlake.plans.recovery import recover_text


def size_of(n: int) -> bytes:
    if n < 0x81:
        return bytes([n])
    return b"\x81" + n.to_bytes(2, "little") if n < 1 << 16 else b"\x82" + n.to_bytes(4, "little")


def framed(text: bytes, marker: bytes = B.TEXT_MARKER, length: int | None = None) -> bytes:
    size = size_of(len(text) if length is None else length)
    return B.STREAM_HEADER + b"\x81\xe8\x03" + B.STRING_CLASS + b"\x01" + marker + size + text + b"\x86\x84"


def test_marker():
    assert B.body_text(framed("Tést message".encode())) == "Tést message"


def test_plus_without_marker_drops_what_cannot_be_read():
    assert B.body_text(framed(b"Hello world", b"+")) == "Hello world"
    # A length that runs into the trailer keeps the readable part.
    assert B.body_text(framed(b"Hello world", b"+", 12)) == "Hello world"


def test_line_breaks_tabs_and_joiners_stay():
    for text in ("a\nb", "a\tb\r\nc", "👨‍👩", "a\u2028b\u00a0c"):
        assert B.body_text(framed(text.encode())) == text
    assert B.body_text(framed(b"a\x00b")) == "ab"  # no text holds control characters


def test_fixed_offset():
    body = B.STREAM_HEADER + B.STRING_CLASS + b"\x00" * 13 + b"\x04Test"
    assert B.body_text(body) == "Test"


def test_property_list():
    assert B.body_text(plistlib.dumps({"a": ["", {"NSString": "Strategy 1"}]}, fmt=plistlib.FMT_BINARY)) == "Strategy 1"
    assert B.body_text(plistlib.dumps({"x": "first", "text": "chosen"}, fmt=plistlib.FMT_BINARY)) == "chosen"


def test_longest_readable_run():
    assert B.body_text(b"\x00abcd\x01Embedded Text\x02NSString long class name here\x00") == "Embedded Text"


@pytest.mark.parametrize("body", [b"", None, b"\x00\x01\x02\x03", b"\x00123456\x00"])
def test_nothing_found(body):
    assert B.body_text(body) is None


def test_long_text_in_run():
    assert B.body_text(b"\x00" + b"A" * 1000 + b"\x00") == "A" * 1000


@pytest.mark.parametrize("n", [1, 127, 128, 129, 255, 256, 300, 1000, 65_535, 65_536, 200_000])
def test_lengths_of_one_two_and_four_bytes(n):
    assert B.body_text(framed(b"x" * n)) == "x" * n
    assert B.body_text(framed(b"x" * n, b"+")) == "x" * n


@given(st.text(max_size=60), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_frame_round_trip(text, times):
    raw = (text * times).encode("utf-8", "ignore")
    clean = raw.decode().strip()
    if clean and not B._CONTROL.search(raw.decode()):
        assert B.body_text(framed(raw)) == clean


def test_encoded_columns_read_back_whole(spark):
    texts = ["short", "é" * 70, "line\none\ttab " * 40, "x" * 70_000, "👨‍👩‍👧 " * 9000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = B.with_marked_text(df.withColumn("b", B.encode_body(F.col("t"))), "b", "got").orderBy("i")
    assert [r.got for r in found.collect()] == [t.strip() for t in texts]


def test_column_agrees_with_function(spark):
    texts = ["Test message", "Tést", "  hi 🎉 ", "a\nb", "x" * 200, "é" * 100, "👨‍👩‍👧", " ", " z ", "tab\there"]
    bodies = [framed(t.encode()) for t in texts] + [
        b"\x00\x01", b"", None, framed(b"Hello world", b"+"), framed(b"\xff\xfe"), framed(b"cut", length=200), framed(b"cut", length=70_000),
        B.STREAM_HEADER + B.TEXT_MARKER + b"\x03abc", plistlib.dumps(["deep"], fmt=plistlib.FMT_BINARY)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b binary")
    got = [r[0] for r in B.with_decoded(df, F.col("b")).orderBy("i").select("decoded").collect()]
    assert got == [B.body_text(b) for b in bodies]


def test_only_unread_bodies_reach_python(spark):
    df = spark.createDataFrame([(framed(b"quick"),), (framed(b"a\nb"),), (framed(b"a\x00b"),)], "b binary")
    quick = B.with_marked_text(df, "b", "t").select("t").collect()
    assert [r[0] for r in quick] == ["quick", "a\nb", None]
    plan = B.with_decoded(df, F.col("b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_recovery_is_idempotent_and_counts(spark):
    rows = [(1, "has text", framed(b"other")), (2, None, framed(b"found")), (3, "", b"\x00\x01"), (4, None, None), (5, "  ", framed(b"kept"))]
    log = spark.createDataFrame(rows, "rowid bigint, text string, attributed_body binary")
    once = recover_text(log)
    twice = recover_text(once)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r["rowid"]: r["extracted_text"] for r in once.collect()} == {1: None, 2: "found", 3: None, 4: None, 5: None}
    report = Q.recovery_validation(once).first()
    assert (report["messages_recovered"], report["still_missing_text"]) == (1, 1)
    assert (report["original_text_coverage_percent"], report["new_text_coverage_percent"]) == (40.0, 60.0)
