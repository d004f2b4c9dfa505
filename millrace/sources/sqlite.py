"""SQLite table reader as a Python data source: one rowid range per task."""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def _table(con: sqlite3.Connection, name: str) -> str:
    if name:
        return name
    row = con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid LIMIT 1").fetchone()
    if row is None:
        raise ValueError("the file holds no table")
    return row[0]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowidRange(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as con:
            table = _table(con, self.options.get("table", ""))
            cols = con.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        kinds = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "NUME": "double"}
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper()[:4], 'string')}" for c in cols)

    def reader(self, schema) -> "SqliteReader":
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.want = options["path"], options.get("table", "")
        self.parts = int(options.get("partitions", "8"))
        self.types = [f.dataType.simpleString() for f in schema]

    def partitions(self):
        with _open(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(_table(con, self.want))}").fetchone()
        if low is None:
            return [RowidRange(0, -1)]
        step = max(-(-(high - low + 1) // self.parts), 1)
        return [RowidRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowidRange):
        cast = {"bigint": int, "double": float, "string": str}
        with _open(self.path) as con:
            sql = f"SELECT * FROM {_quoted(_table(con, self.want))} WHERE rowid BETWEEN ? AND ?"
            for row in con.execute(sql, (partition.low, partition.high)):
                yield tuple(None if v is None else cast[t](v) for v, t in zip(row, self.types))
