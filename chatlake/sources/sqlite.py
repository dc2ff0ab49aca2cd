"""Read SQLite files, the format chat databases and address books come in.

A table is split into ROWID ranges, one task each; every task opens the file
read-only, so the folder must be reachable from the executors.
"""

from __future__ import annotations

import sqlite3
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from chatlake import schemas

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 10_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class RowidRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _TableReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.arrow = to_arrow_schema(schema)
        self.table = options["table"]
        self.columns = options.get("columns", ", ".join(f'"{f}"' for f in schema.fieldNames()))
        self.paths = options["paths"].split("\n")
        self.rows_per_task = int(options.get("rowsPerTask", 1_000_000))
        self.skip_unreadable = options.get("skipUnreadable", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            try:
                with _open(path) as con:
                    first, last = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.Error:
                if not self.skip_unreadable:
                    raise
                continue
            if first is not None:
                found += [RowidRange(path, start, min(start + self.rows_per_task - 1, last))
                          for start in range(first, last + 1, self.rows_per_task)]
        return found or [RowidRange("", 1, 0)]

    def read(self, part: RowidRange) -> Iterator[pa.RecordBatch]:
        if part.last < part.first:
            return
        source = part.path.rsplit("/", 2)[-2] if part.path.count("/") > 1 else ""
        columns = self.columns.replace("{source}", "'" + source.replace("'", "''") + "'")
        with _open(part.path) as con:
            con.text_factory = lambda raw: raw.decode("utf-8", "replace")
            cursor = con.execute(
                f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (part.first, part.last))
            while rows := cursor.fetchmany(BATCH_ROWS):
                values = zip(*rows)
                arrays = [pa.array([_fit(v, f.type) for v in column], f.type) for column, f in zip(values, self.arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=self.arrow)


def _fit(value, kind: pa.DataType):
    """SQLite columns are untyped: bring a value to the column's type."""
    if value is None:
        return None
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if pa.types.is_integer(kind):
        return int(value)
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return value.encode() if isinstance(value, str) else value
    return value


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_sqlite"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TableReader(schema, self.options)


def read_sqlite(spark: SparkSession, paths: str | list[str], table: str, schema: T.StructType, columns: str | None = None,
                rows_per_task: int = 1_000_000, skip_unreadable: bool = False) -> DataFrame:
    """One table of one or many database files.

    ``columns`` are the SQL expressions behind the schema's fields; ``{source}``
    in them is the name of the file's folder.
    """
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("chat_sqlite").schema(schema).option("table", table)
    reader = reader.option("paths", paths if isinstance(paths, str) else "\n".join(paths))
    reader = reader.option("rowsPerTask", rows_per_task).option("skipUnreadable", str(skip_unreadable).lower())
    return (reader.option("columns", columns) if columns else reader).load()


# Table and column names of the source databases.
MESSAGE_COLUMNS = ("ROWID, guid, text, attributedBody, handle_id, date, date_read, date_delivered, is_from_me, is_read, "
                   "is_delivered, is_sent, service, account, error")
SOURCE_TABLES = {
    "message": ("message", schemas.MESSAGE, MESSAGE_COLUMNS),
    "handle": ("handle", schemas.HANDLE, "ROWID, id, country, service"),
    "chat": ("chat", schemas.CHAT, "ROWID, display_name"),
    "chat_message_join": ("chat_message_join", schemas.CHAT_MESSAGE_JOIN, "chat_id, message_id, message_date"),
    "chat_handle_join": ("chat_handle_join", schemas.CHAT_HANDLE_JOIN, "chat_id, handle_id"),
    "account": ("ZACCOUNTMODEL", schemas.ACCOUNT, "ZACCOUNTTYPE, ZDISPLAYNAME, ZEXTERNALIDENTIFIER"),
    "record": ("ZABCDRECORD", schemas.CONTACT_RECORD, "{source}, Z_PK, ZFIRSTNAME, ZLASTNAME"),
    "phone": ("ZABCDPHONENUMBER", schemas.CONTACT_PHONE, "{source}, ZOWNER, ROWID, ZFULLNUMBER"),
    "email": ("ZABCDEMAILADDRESS", schemas.CONTACT_EMAIL, "{source}, ZOWNER, ROWID, ZADDRESS"),
}


def read_source_table(spark: SparkSession, name: str, paths: str | list[str], **options) -> DataFrame:
    """A source table by its lake name, e.g. ``message`` or ``phone``."""
    table, schema, columns = SOURCE_TABLES[name]
    return read_sqlite(spark, paths, table, schema, columns, **options)
