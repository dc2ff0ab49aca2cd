import hashlib
import random
import re
import time

from chatlake.llm import personal

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_base_spans():
    text = "a@b.co 1.2.3.4 1.2.3.256 01.2.3.4.5 x 4111 1111 1111 1111 +1 (389) 555-5010. +12 34 x 4111111111111112 é a@b"
    found = [(k, text[a:b]) for k, a, b in personal.base_spans(text)]
    assert found == [("email", "a@b.co"), ("ip", "1.2.3.4"), ("ip", "01.2.3.4"), ("card", "4111 1111 1111 1111"),
                     ("phone", "+1 (389) 555-5010")]
    assert personal.base_spans(None) == personal.base_spans("") == []
    assert [m.span() for m in re.finditer(EMAIL, text)] == [(0, 6)]


# The contract's patterns as they stand, searched by the library.
PLAIN = {"email": EMAIL, "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plainly(text):
    """Every match of the plain patterns that passes its check, by kind, then start."""
    def fine(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == "ip":
            return all(int(part) <= 255 for part in found.split("."))
        if kind == "card":
            doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if fine(k, m.group())]


def test_base_spans_as_the_plain_patterns_find_them():
    rng = random.Random(11)
    bits = ["a", "b.c", "@", "@x.y", ".", "..", "-", "1", "255", "256", "4111111111111111", "0", " ", "+1 ", "+", "(3)", "é", "%", "1.2.3.4",
            "555-0199", "\n", "@@", "a@b", "co.", "001"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert personal.base_spans(text) == plainly(text), text


def test_long_runs_take_no_square():
    begin = time.monotonic()
    for text in ("1" * 500_000, "a" * 500_000 + "@", "1." * 250_000, "a." * 250_000 + "@", "@" * 200_000, "a@" * 200_000,
                 "+1" + " " * 500_000, "word " + "x" * 500_000 + " 10.0.0.1"):
        personal.base_spans(text)
        for at in (len(text) - 8, 9):
            personal.patterns_before(text, at)
    assert time.monotonic() - begin < 20


def test_words_before_a_span():
    before = lambda text: personal.patterns_before(text, len(text))
    assert before("phone : ") == ["phone"] and before("call the phone : - ") == ["phone", "the phone"]
    long = "y" * 5000
    assert before(f"ring {long} ") == [long, f"ring {long}"] and before("") == before(" . ") == []


def test_found_identifiers_bring_new_patterns(documents):
    # Phones stand after "please ring"; the unseen ones found there also stand after "hotline is", where no seed stands.
    local = [f"389-555-77{i:02}" for i in range(6)]
    rows = seeds(20) + [(50 + i, f"please ring {n} today", None, None) for i, n in enumerate(local)]
    rows += [(80 + i, f"hotline is {n} ok", None, None) for i, n in enumerate(local)]
    rows += [(99, "hotline is 389-555-9999 ok", None, None)]
    found = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in personal.find_personal(documents(rows)).collect()}
    assert found[50] == [("phone", 12)] and found[80] == [("phone", 11)] and found[99] == [("phone", 11)]
    once = {r.doc_id: r.spans for r in personal.find_personal(documents(rows), rounds=1).collect()}
    assert once[99] == []


def test_luhn():
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")


def seeds(n=12):
    return [(i, f"please ring +1 (3{i:02}) 555-50{i:02} today, server 10.0.{i}.7 ok", None, None) for i in range(n)]


def test_contexts_of_seeds_find_what_the_base_patterns_miss(documents):
    rows = seeds() + [
        (50, "please ring 389-555-7788 today", None, None), (51, "they ring a bell", None, None),
        (52, "the code 389-555-7788 too", None, None), (53, "please ring AB12CD34 now", None, None)]
    found = {r.doc_id: r for r in personal.find_personal(documents(rows)).collect()}
    spans = {i: [(s.kind, s.start, s.end) for s in r.spans] for i, r in found.items()}
    assert spans[50] == [("phone", 12, 24)]  # in a context of phones
    assert spans[52] == []  # not a place where phones stand
    assert spans[51] == spans[53] == []  # no identifier; not the form of a phone
    assert all(list(found[i].base) == list(found[i].spans) for i in range(12))


def test_a_context_of_ordinary_words_is_worth_nothing(documents):
    rows = [(i, f"the +1 (3{i:02}) 555-50{i:02} and the word the other", None, None) for i in range(12)]
    rows += [(50, "the 389-555-7788 here", None, None)]
    found = {r.doc_id: r.spans for r in personal.find_personal(documents(rows)).collect()}
    assert found[50] == []


def test_every_pattern_is_looked_for_whatever_a_pass_holds(documents, monkeypatch):
    rows = seeds() + [(50, "please ring 389-555-7788 today, server 10:0:33:99 ok", None, None),
                      (51, "please ring the bell today, server down", None, None)]
    whole = {r.doc_id: r.spans for r in personal.find_personal(documents(rows)).collect()}
    assert [(s.kind, s.start) for s in whole[50]] == [("phone", 12), ("ip", 39)]
    monkeypatch.setattr(personal, "PATTERNS", 2)
    assert {r.doc_id: r.spans for r in personal.find_personal(documents(rows)).collect()} == whole


def test_report_of_messy_rows(documents, messy_rows):
    rows = messy_rows + seeds(3) + seeds(1) * 2
    found = personal.report(personal.find_personal(documents(rows))).collect()
    expected = []
    for doc_id, text, *_ in rows:
        spans = personal.base_spans(text)
        counts = [sum(s[0] == k for s in spans) for k in personal.KINDS]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((doc_id, *counts, hashlib.sha256(line.encode()).hexdigest(), line))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert personal.report(personal.find_personal(documents([]))).count() == 0


def test_masked_texts(documents):
    docs = documents(seeds(2) + [(9, None, "en", "s"), (10, "nothing here", "en", "s")])
    found = {r.doc_id: r for r in personal.mask_texts(docs, personal.find_personal(docs)).collect()}
    assert found[1].text == "please ring [PHONE] today, server [IP] ok"
    assert found[9].text is None and found[10].text == "nothing here" and found[10].mark == 7
    assert personal.masked("abcdef", [("ip", 1, 3), ("phone", 2, 5)]) == "a[IP]f"
