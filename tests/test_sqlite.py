import sqlite3

import pytest

from chatlake import schemas
from chatlake.sources import sqlite as SQ


@pytest.fixture
def database(tmp_path):
    folder = tmp_path / "home"
    folder.mkdir()
    path = folder / "chat.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE handle (ROWID INTEGER PRIMARY KEY, id TEXT, country TEXT, service TEXT)")
        con.executemany("INSERT INTO handle VALUES (?, ?, 'us', 'SMS')", [(i, f"h{i}") for i in range(1, 1001) if i % 7])
        con.execute("CREATE TABLE ZABCDRECORD (Z_PK INTEGER PRIMARY KEY, ZFIRSTNAME, ZLASTNAME)")
        con.execute("INSERT INTO ZABCDRECORD VALUES (1, 'Ann', 5)")
        con.execute("CREATE TABLE blobs (b BLOB, t TEXT)")
        con.execute("INSERT INTO blobs VALUES (x'00ff', 'é')")
        con.execute("CREATE TABLE empty (x INTEGER)")
    return str(path)


def test_ranges_cover_every_row_once(spark, database):
    df = SQ.read_source_table(spark, "handle", database, rows_per_task=100)
    assert df.rdd.getNumPartitions() == 10
    assert sorted(r["handle_id"] for r in df.collect()) == [i for i in range(1, 1001) if i % 7]


def test_many_files_and_unreadable_ones(spark, database, tmp_path):
    bad = tmp_path / "bad.db"
    bad.write_bytes(b"not a database, only bytes" * 50)
    rows = SQ.read_source_table(spark, "record", [database, str(bad)], skip_unreadable=True).collect()
    assert [tuple(r) for r in rows] == [("home", 1, "Ann", "5")]
    with pytest.raises(Exception):
        SQ.read_source_table(spark, "record", [database, str(bad)]).collect()


def test_types_and_empty_table(spark, database):
    schema = schemas._schema("b binary, t string")
    row = SQ.read_sqlite(spark, database, "blobs", schema).first()
    assert (bytes(row["b"]), row["t"]) == (b"\x00\xff", "é")
    assert SQ.read_sqlite(spark, database, "empty", schemas._schema("x bigint")).count() == 0
