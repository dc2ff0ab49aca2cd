import pytest
from pyspark.sql import functions as F

from chatlake.functions import contact as C, records as RC, text as X, time as TM

TEN = "(555) 123-4567"


@pytest.mark.parametrize("value, wanted", [
    ("5551234567", TEN), ("15551234567", TEN), (TEN, TEN), ("+15551234567", TEN), ("", ""), ("123", "123"), (None, ""),
    ("25551234567", "25551234567"), ("555.123.4567 ", TEN), ("1 555 123 456", "(155) 512-3456"),
])
def test_normalize_phone(column, value, wanted):
    assert column([value], C.normalize_phone) == [wanted]


def test_phone_from_handle(column):
    inputs = ["+15555550123", "+44123456789", "", "invalid", None, "5555550123", "1555555012"]
    assert column(inputs, C.phone_from_handle) == ["5555550123", None, None, None, None, "5555550123", "1555555012"]


def test_phone_digits_keeps_any_length(column):
    assert column(["+1 (555) 555-0123", "12", "+", None, "22345678901"], C.phone_digits) == [
        "5555550123", "12", "", "", "22345678901"]


def test_phone_formats(column):
    spelled = {"5555550123", "(555) 555-0123", "555-555-0123", "555.555.0123", "+15555550123", "15555550123"}
    got = column(["5555550123", "15555550123", "", None, "12345"], C.phone_formats)
    assert set(got[0]) == set(got[1]) == spelled
    assert got[2:] == [[], [], ["12345"]]


def test_phone_and_email_shapes(column):
    phones = ["+15551234567", "5551234567", "(555) 123-4567", "123", "test@example.com", "", None, "a1234567890@b.c"]
    assert column(phones, C.looks_like_phone) == [True, True, True, False, False, False, False, True]
    emails = ["test@example.com", "a@b", "a.b", "", None, "user.name@host.org", "5551234567"]
    assert column(emails, C.looks_like_email) == [True, False, False, False, False, True, False]


def test_normalize_email(column):
    assert column(["  Test@Example.COM  ", " A@B.C\n", None], C.normalize_email) == ["test@example.com", "a@b.c", ""]


def test_e164_and_validity(column):
    inputs = ["(555) 123-4567", "555-123-4567", "+1 555 123 4567", "15551234567", "123", "", None]
    assert column(inputs, C.format_e164) == ["+15551234567"] * 4 + ["123", "", None]
    assert column(inputs, C.valid_phone) == [True] * 4 + [False] * 3
    recipients = ["+15551234567", "a@b.co", "a@b", "x", "", None, " a.b+c@d.org "]
    assert column(recipients, C.valid_recipient) == [True, True, False, False, False, False, True]


def test_names(spark):
    rows = spark.createDataFrame(
        [("A", "B", "1", "e"), ("A", "", "", "e"), ("", "B", "1", ""), ("", "", "", ""), (None, None, "", "")],
        "f string, l string, p string, e string")
    got = rows.select(C.full_name(F.col("f"), F.col("l")), C.user_label(*[F.col(c) for c in "flpe"])).collect()
    assert [r[0] for r in got] == ["A B", "A", "B", None, None]
    assert [r[1] for r in got][:4] == ["A B (phone: 1, email: e)", "A  (email: e)", " B (phone: 1)", " "]


def test_strip_is_unicode_aware(column):
    assert column([" \x1f a b　\x85", "\t\n", None], X.strip) == ["a b", "", None]


def test_truncate(column):
    assert column(["", None, "  a  ", "x" * 100, "x" * 101], X.truncate_ellipsis) == [
        X.NO_TEXT, X.NO_TEXT, "a", "x" * 100, "x" * 97 + "..."]


def test_content_check(column):
    assert column(["", None, " ", "x" * 1000, "x" * 1001, " " * 1001], X.content_check) == [
        "empty", "empty", "blank", "ok", "too_long", "too_long"]


def test_send_error_class(column):
    messages = ["Network down", "lost CONNECTION", "Auth failed", "no permission", "rate hit", "limit", "boom", None]
    assert column(messages, X.send_error_class) == ["network", "network", "auth", "auth", "rate", "rate", "other", None]


def test_search_ignores_ascii_case_only(column):
    texts = ["Hello World", "HELLO", "É", "a_b", "a\\b", None]
    assert column(texts, lambda c: X.contains_term(c, "hello")) == [True, True, False, False, False, None]
    assert column(texts, lambda c: X.contains_term(c, "é")) == [False, False, False, False, False, None]
    assert column(texts, lambda c: X.contains_term(c, "o%d")) == [True, False, False, False, False, None]
    assert column(texts, lambda c: X.contains_term(c, "\\")) == [False, False, False, False, True, None]


def test_suspicious_text(column):
    assert column(["ok", "a\\x41", "b\\u00e9", "c�", "\x01\x02", "\x01a"], X.suspicious_text) == [
        False, True, True, True, True, False]


def test_apple_time(spark):
    rows = spark.createDataFrame([(683140800000000000,), (0,), (None,), (5,), (10**19 // 2,), (-2 * 10**18,)], "d bigint")
    got = rows.select(TM.iso_text(TM.apple_ts(F.col("d")))).collect()
    assert [r[0] for r in got] == ["2022-08-25T17:20:00", None, None, "2001-01-01T00:00:00", None, None]
    back = rows.limit(1).select(TM.to_apple(TM.apple_ts(F.col("d")))).first()[0]
    assert back == 683140800000000000
    filled = rows.select(TM.iso_text(TM.apple_ts(F.col("d"), F.lit("2024-02-01")))).collect()
    assert filled[1][0] == filled[2][0] == "2024-02-01T00:00:00"


def test_iso8601(column):
    inputs = ["2024-01-01T10:00:00", "2024-01-01T10:00:00Z", "2024-01-01 10:00:00.5+02:00", "2024-13-01", "01/02/2024", "", None]
    assert column(inputs, TM.valid_iso8601) == [True, True, True, False, False, False, False]


def test_parse_boundaries(column):
    inputs = [
        'x [{"after_message_index": 5, "reason": "r", "confidence": 0.9}, {"after_message_index": 2, "reason": "q"}] y',
        "none", "[]", '[{"reason": "x"}]', "[{bad}]", None, 'a\n[{"after_message_index": 1,\n"reason": "z"}]\nb']
    got = [[tuple(b) for b in row] for row in column(inputs, RC.parse_boundaries)]
    assert got == [[(2, "q", 0.8), (5, "r", 0.9)], [], [], [], [], [], [(1, "z", 0.8)]]


def test_parse_responses(column):
    inputs = ['ok {"response_1": "a", "response_2": "b", "response_3": "c"} z', "none", "{}",
              '{"response_1": "a", "response_2": " ", "response_3": "c"}', "{bad}"]
    got = column(inputs, RC.parse_responses)
    assert [r["status"] for r in got] == ["ok", "no_json", "bad_response_1", "bad_response_2", "invalid_json"]
    assert got[0]["response_3"] == "c" and got[3]["response_1"] is None


def test_record_round_trip(spark):
    from chatlake import schemas

    rows = spark.createDataFrame([(7, "u", 'say "hi"\n')], schemas.REQUEST)
    back = rows.select(RC.parse_record(RC.record_json(*rows.columns and [F.col(c) for c in rows.columns]), schemas.REQUEST).alias("r"))
    assert back.select("r.*").collect() == rows.collect()
    prompt = spark.createDataFrame(
        [("s", "u", [("a", True, "2024-01-01T00:00:00")], ("n", "2024-01-02T00:00:00"))], schemas.PROMPT)
    again = prompt.select(RC.parse_record(RC.record_json(*[F.col(c) for c in prompt.columns]), schemas.PROMPT).alias("p"))
    assert again.select("p.*").collect() == prompt.collect()


def test_user_rules(spark):
    rows = spark.createDataFrame([("u", "", "", "1", "", 5), ("u", "", "", "1", "", None), ("", "a", "", "", "", None)],
                                 "u string, f string, l string, p string, e string, h bigint")
    got = rows.select(RC.violations(RC.user_rules(*[F.col(c) for c in "uflpeh"]))).collect()
    assert [r[0] for r in got] == [[], ["name"], ["user_id", "contact_point"]]


def test_response_rules(spark):
    rows = spark.createDataFrame([("a", "b", "c"), ("a", "", None)], "x string, y string, z string")
    got = rows.select(RC.violations(RC.response_rules(*[F.col(c) for c in "xyz"]))).collect()
    assert [r[0] for r in got] == [[], ["response_2", "response_3"]]


def test_lines(spark):
    row = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS t, true AS me, 'u1' AS u, 'Hey! How are you doing?' AS c")
    got = row.select(
        X.numbered_line(F.lit(0), F.col("t"), F.col("me"), F.col("u"), F.col("c")), X.short_line(~F.col("me"), F.lit("Hello")),
        X.history_line(TM.iso_text(F.col("t")), F.col("me"), F.lit("Hi")), TM.clock_time(F.col("t"))).first()
    assert list(got) == ["[0] 2024-01-01 10:00:00 - Me: Hey! How are you doing?", "Contact: Hello",
                         "[2024-01-01T10:00:00] You: Hi", "10:00:00 AM"]
