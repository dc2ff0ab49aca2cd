import pytest

from chatlake import schemas
from chatlake.functions.contact import phone_formats, phone_from_handle
from chatlake.operators import contacts as CT


@pytest.fixture
def book(spark):
    record = spark.createDataFrame([
        ("a", 1, "Ann", "Lee"), ("a", 2, "Bob", None), ("a", 3, None, "Cid"), ("a", 4, "", ""), ("a", 5, None, None),
        ("a", 6, "No", "Point"), ("b", 1, "Ann", "Lee"), ("b", 2, "Ann", "Later")], schemas.CONTACT_RECORD)
    phone = spark.createDataFrame([
        ("a", 1, 1, "+1 555 123 4567"), ("a", 1, 2, "555-999-0000"), ("a", 2, 3, "5550001111"), ("a", 4, 4, "5552223333"),
        ("a", 5, 5, "5554445555"), ("b", 1, 2, "+1 555 123 4567"), ("b", 2, 3, "555.123.4567"),
        ("a", 6, 9, None)], schemas.CONTACT_PHONE)
    email = spark.createDataFrame([
        ("a", 1, 1, "Ann@Example.COM"), ("a", 3, 2, "CID@x.org"), ("b", 1, 1, "ann@example.com")], schemas.CONTACT_EMAIL)
    return record, phone, email


def test_extract_contacts(book):
    got = {(r["first_name"], r["last_name"], r["phone_number"], r["email"]): r["load_order"]["source"]
           for r in CT.extract_contacts(*book).collect()}
    assert got == {
        ("Ann", "Lee", "(555) 123-4567", "ann@example.com"): "a",  # the same person in both books, once
        ("Bob", "", "(555) 000-1111", ""): "a", ("", "Cid", "", "cid@x.org"): "a",
        ("Ann", "Later", "(555) 123-4567", ""): "b"}


def test_person_sets(book):
    got = {(r["source"], r["z_pk"], r["kind"]): r["values"] for r in CT.person_contact_sets(*book).collect()}
    assert got[("a", 1, "phone")] == ["+1 555 123 4567", "555-999-0000"]
    assert got[("a", 1, "email")] == ["ann@example.com"]
    assert ("a", 5, "phone") not in got


def test_lookup_last_writer_wins(book):
    got = {r["key"]: r["full_name"] for r in CT.contact_lookup(*book).collect()}
    assert got["5551234567"] == "Ann Later" and got["ann@example.com"] == "Ann Lee" and got["5550001111"] == "Bob"
    assert got["5552223333"] is None


def test_cascade_prefers_raw_then_digits_then_lower(spark):
    lookup = spark.createDataFrame([("555", "raw", "", "raw"), ("5551234567", "digits", "", "digits"), ("a@b.c", "low", "", "low"),
                                    ("x1@b.c", "mail", "", "mail"), ("1", "one", "", "one")],
                                   "key string, first_name string, last_name string, full_name string")
    handles = spark.createDataFrame([(1, "555"), (2, "+1 (555) 123-4567"), (3, "A@B.C"), (4, "X1@B.C"), (5, None), (6, "none")],
                                    "handle_id bigint, id string")
    got = {r["handle_id"]: r["contact_full_name"] for r in CT.lookup_cascade(handles, lookup).collect()}
    assert got == {1: "raw", 2: "digits", 3: "low", 4: "one", 5: None, 6: None}


def resolve(spark, values, contacts, existing=None):
    handles = spark.createDataFrame(list(enumerate(values, 1)), "handle_id bigint, id string")
    users = None if existing is None else spark.createDataFrame(existing, schemas.USERS)
    return {r["handle_id"]: r for r in CT.resolve_handles(handles, contacts, users).collect()}


def test_resolution_order(spark, book):
    contacts = CT.extract_contacts(*book)
    got = resolve(spark, ["+15551234567", "ANN@example.com", "+15559999999", "who@example.com", "+44123456789",
                          "short1", "word", "", None, "a5551234567@x.org", "12"], contacts)
    rows = {h: (r["match_kind"], r["first_name"], r["last_name"], r["phone_number"], r["email"]) for h, r in got.items()}
    assert rows == {
        1: ("phone", "Ann", "Later", "5551234567", ""),
        2: ("email", "Ann", "Lee", "", "ANN@example.com"),
        3: ("fallback", "", "", "5559999999", ""), 4: ("fallback", "", "", "", "who@example.com"),
        5: ("fallback", "", "", "+44123456789", ""), 6: ("fallback", "", "", "short1", ""), 7: ("fallback", "", "", "", "word"),
        # An address with ten digits is taken for a phone.
        10: ("phone", "Ann", "Later", "5551234567", ""), 11: ("fallback", "", "", "12", "")}
    assert len({r["user_id"] for r in got.values()}) == len(got)


def test_existing_user_is_kept(spark, book):
    existing = [("old", "Old", "Name", "1", "", 1), ("none", "No", "Handle", "1", "", None)]
    got = resolve(spark, ["+15551234567", "+15551234567"], CT.extract_contacts(*book), existing)
    assert (got[1]["user_id"], got[1]["match_kind"], got[2]["match_kind"]) == ("old", "existing", "phone")


def test_resolution_is_deterministic(spark, book):
    contacts = CT.extract_contacts(*book)
    first, second = (resolve(spark, ["+15551234567", "q"], contacts) for _ in range(2))
    assert first == second


def test_one_join_on_digits_covers_every_spelling(column):
    """Two numbers share a spelling exactly when they share their ten digits."""
    values = ["5551234567", "15551234567", "+1 555.123.4567", "(555) 123-4567", "5551234568", "25551234567", "555"]
    formats = [set(f) for f in column(values, phone_formats)]
    digits = column(values, phone_from_handle)
    for f, d in zip(formats, digits):
        for g, e in zip(formats, digits):
            if d is not None and e is not None:
                assert bool(f & g) == (d == e)


def test_unknown_handle_gives_no_row(spark, book):
    handles = spark.createDataFrame([(1, "a@b.c")], "handle_id bigint, id string")
    wanted = spark.createDataFrame([(1,), (2,), (1,)], "handle_id bigint")
    assert CT.resolve_handle_ids(wanted, handles, CT.extract_contacts(*book)).count() == 1


def test_stats(book):
    stats = CT.extraction_stats(*book).first()
    assert (stats["total_records"], stats["records_with_phone"], stats["records_with_email"]) == (7, 6, 3)
    names = {r["source"]: tuple(r)[1:] for r in CT.name_completeness(*book).collect()}
    # An empty name is not a missing one: "" counts on both sides, as in the source query.
    assert names == {"a": (2, 2, 2), "b": (0, 0, 2)}
