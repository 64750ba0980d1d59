"""Sources for spark.read.format(): folders of files (corpus_folder) and SQLite files (corpus_sqlite).

Spark plans their partitions, prunes by the schema that is given to the reader, and hands them filters; what they take over is
not evaluated again.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from corpusloom.functions.text import FILE_TYPES

#: Rows of an Arrow batch.
BATCH = 10_000
Predicate = Callable[[object], bool]


def registered(spark: SparkSession) -> SparkSession:
    """The session with the sources and sinks of this library, and filters handed to them."""
    from corpusloom.plans import sinks

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FolderSource, SqliteSource, sinks.NamedFiles, sinks.OneFile):
        spark.dataSource.register(source)
    return spark


_COMPARED: dict[type, Callable[[object, object], bool]] = {
    D.EqualTo: lambda x, y: x == y, D.GreaterThan: lambda x, y: x > y, D.GreaterThanOrEqual: lambda x, y: x >= y, D.LessThan: lambda x, y: x < y,
    D.LessThanOrEqual: lambda x, y: x <= y, D.StringStartsWith: lambda x, y: x.startswith(y), D.StringEndsWith: lambda x, y: x.endswith(y), D.StringContains: lambda x, y: y in x, D.In: lambda x, y: x in y,
}


@dataclass
class Folder(D.InputPartition):
    """A folder to list: with all below it, or its own files alone. real: the resolved folders on the way to it."""

    path: str
    real: tuple[str, ...]
    below: bool


class FolderSource(D.DataSource):
    """A row for each file of a folder: path, rel_path, ext, file_type, size. Options: path; exclude (names that are passed over, a
    line each); tasks (how many folders are looked for at least before tasks take over, 64 if not given)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_folder"

    def schema(self) -> str:
        return "path string, rel_path string, ext string, file_type string, size long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options, [f.name for f in schema.fields])


class FolderReader(D.DataSourceReader):
    """Folders are opened level by level until there are as many as tasks are wanted; each is then walked in a task. A link to a
    folder is followed, unless it leads to a folder of the walk or to one that holds or lies in it: so each file comes once.
    Filters on columns are applied as files are listed, and those that fix the beginning of rel_path close other folders."""

    def __init__(self, options: dict, columns: list[str]):
        from corpusloom.sources.files import EXCLUDED

        self.folder, self.columns, self.tasks = options["path"], columns, int(options.get("tasks", 64))
        self.excluded = set(options["exclude"].split("\n")) if options.get("exclude") else set(EXCLUDED)
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _COMPARED and column in ("path", "rel_path", "ext", "file_type", "size"):
                self.tests.append((column, type(f), f.value))
            elif not isinstance(f, D.IsNotNull):  # no column of a file is null
                yield f

    def _may_hold(self, rel: str) -> bool:
        """Whether files below this folder (path in the walked one, "" for itself) may pass the filters on rel_path."""
        for column, kind, value in self.tests:
            starts = [value] if kind in (D.EqualTo, D.StringStartsWith) else value if kind is D.In else None
            if column == "rel_path" and starts is not None and rel and not any(f"{rel}/".startswith(s) or s.startswith(f"{rel}/") for s in starts):
                return False
        return True

    def _opened(self, store, base: str, at: Folder) -> tuple[list, list[Folder]]:
        """The files and the folders in a folder. One that goes away meanwhile is empty."""
        from pyarrow import fs

        local = isinstance(store, fs.LocalFileSystem)
        files, folders = [], []
        try:
            there = store.get_file_info(fs.FileSelector(at.path, allow_not_found=True))
        except PermissionError:
            there = []
        for i in sorted(there, key=lambda i: i.base_name):
            if i.base_name in self.excluded:
                continue
            if i.type == fs.FileType.File:
                files.append(i)
            elif i.type == fs.FileType.Directory and self._may_hold(i.path[len(base) + 1 :]):
                real = at.real
                if local and os.path.islink(i.path):
                    to = os.path.realpath(i.path)
                    if any(os.path.commonpath([to, r]) in (to, r) for r in real):
                        continue
                    real = (*real, to)
                folders.append(_folder(i.path, real, True))
        return files, folders

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        from corpusloom.sources.files import _store

        store, base = _store(self.folder)
        if store.get_file_info(base).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no such folder: {self.folder}")
        level, opened = [_folder(base, (os.path.realpath(base),), True)], []
        while level and len(level) < self.tasks:
            below = []
            for at in level:
                files, folders = self._opened(store, base, at)
                opened += [_folder(at.path, at.real, False)] if files else []
                below += folders
            level = below
        return opened + level or [_folder(base, (os.path.realpath(base),), False)]

    def read(self, partition: Folder) -> Iterator:
        import pyarrow as pa

        from corpusloom.sources.files import _store

        store, base = _store(self.folder)
        types = {"size": pa.int64()}
        todo, rows = [partition], []
        while todo:
            at = todo.pop()
            files, folders = self._opened(store, base, at)
            todo += folders if partition.below else []
            for i in files:
                name = i.path[len(base) + 1 :]
                stem, dot, ext = posixpath.basename(name).rpartition(".")
                ext = f".{ext.lower()}" if dot and stem else ""
                row = {"path": i.path, "rel_path": name, "ext": ext, "file_type": FILE_TYPES.get(ext, "unsupported"), "size": i.size or 0}
                if all(_COMPARED[kind](row[column], value) for column, kind, value in self.tests):
                    rows.append(row)
            while len(rows) >= BATCH or (rows and not todo):
                yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows[:BATCH]], types.get(c, pa.string())) for c in self.columns})
                rows = rows[BATCH:]


def _folder(path: str, real: tuple[str, ...], below: bool) -> Folder:
    f = Folder(path, real, below)
    D.InputPartition.__init__(f, path)
    return f


@dataclass
class Rows(D.InputPartition):
    """Rows of a table from a key on, up to another: both of as many values as the key has columns (none: no bound)."""

    since: tuple | None
    upto: tuple | None


class SqliteSource(D.DataSource):
    """A table or view of a SQLite file. Options: path (one that all machines see), table, rows (a partition's, 50000 if not given),
    numbers (names of columns that are whole numbers, with commas; all others are text)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_sqlite"

    def schema(self) -> str:
        numbers = self.options.get("numbers", "").split(",")
        with _sqlite(self.options["path"]) as con:
            found = [r[1] for r in con.execute(f"pragma table_info({_quoted(self.options['table'])})")]
        if not found:
            raise ValueError(f"no table or view {self.options['table']!r} in {self.options['path']}")
        return ", ".join(f"`{c}` {'bigint' if c in numbers else 'string'}" for c in found)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, [(f.name, f.dataType.simpleString()) for f in schema.fields])


def _sqlite(path: str):
    import sqlite3
    from contextlib import closing

    con = sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return closing(con)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(D.DataSourceReader):
    """Only the columns of the schema are read. Partitions are ranges of the row's key: from the least rowid to the greatest; in tables
    without rowid, of the primary key, whose bounds are read from its own index. A view has no key and is one partition, read row
    by row. Filters on text by =, in and beginnings, and on whole numbers by = and order become part of the query."""

    def __init__(self, options: dict, columns: list[tuple[str, str]]):
        self.path, self.table, self.step, self.columns, self.tests = options["path"], options["table"], int(options.get("rows", 50_000)), columns, []

    def _value(self, column: str) -> str:
        kind = dict(self.columns)[column]
        name = _quoted(column)
        return f"case when typeof({name}) = 'integer' then {name} when cast(cast({name} as integer) as text) = trim(cast({name} as text)) then cast({name} as integer) end" if kind == "bigint" else f"cast({name} as text)"

    def pushFilters(self, filters):
        signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = dict(self.columns).get(column)
            if kind and isinstance(f, D.EqualTo) or (kind == "bigint" and type(f) in signs):
                self.tests.append((f"{self._value(column)} {signs[type(f)]} ?", (f.value,)))
            elif kind and isinstance(f, D.In):
                self.tests.append((f"{self._value(column)} in ({', '.join('?' * len(f.value))})", tuple(f.value)))
            elif kind and isinstance(f, D.IsNotNull):
                self.tests.append((f"{self._value(column)} is not null", ()))
            else:
                yield f

    def _key(self, con) -> list[str]:
        """What orders the table's rows: rowid, else the columns of the primary key; nothing for a view."""
        kind, said = con.execute("select type, coalesce(sql, '') from sqlite_master where name = ? and type in ('table', 'view')", (self.table,)).fetchone()
        if kind == "view":
            return []
        columns = con.execute(f"pragma table_info({_quoted(self.table)})").fetchall()
        named = {c[1].lower() for c in columns}
        alias = next((a for a in ("rowid", "_rowid_", "oid") if a not in named), None)
        if alias:
            try:
                con.execute(f"select {alias} from {_quoted(self.table)} limit 1")
                return [alias]
            except Exception:  # a table without rowid says that there is no such column
                pass
        return [_quoted(c[1]) for c in sorted((c for c in columns if c[5]), key=lambda c: c[5])]

    def partitions(self) -> list[Rows]:
        with _sqlite(self.path) as con:
            key = self._key(con)
            if not key:
                return [_rows(None, None)]
            if len(key) == 1 and not key[0].startswith('"'):
                least, most = con.execute(f"select min({key[0]}), max({key[0]}) from {_quoted(self.table)}").fetchone()
                many = 4 * (con.execute(f"select count(*) from {_quoted(self.table)}").fetchone()[0] // self.step + 1)
                near = least is None or (most - least) // self.step <= many  # if rowids lie far apart: bounds by counting rows
                edges = ([] if least is None else [(k,) for k in range(least + self.step, most + 1, self.step)]) if near else None
            else:
                edges = None
            if edges is None:
                listed, edges, last = ", ".join(key), [], None
                while True:
                    above = f"where ({listed}) > ({', '.join('?' * len(key))})" if last else ""
                    last = con.execute(f"select {listed} from {_quoted(self.table)} {above} order by {listed} limit 1 offset {self.step - bool(last)}", last or ()).fetchone()
                    if last is None:
                        break
                    edges.append(tuple(last))
        return [_rows(a, b) for a, b in zip([None, *edges], [*edges, None], strict=True)]

    def read(self, partition: Rows) -> Iterator:
        import pyarrow as pa

        with _sqlite(self.path) as con:
            key = self._key(con)
            marks = ", ".join("?" * len(key))
            bounds = [(f"({', '.join(key)}) {sign} ({marks})", x) for sign, x in ((">=", partition.since), ("<", partition.upto)) if x is not None]
            tests = [*bounds, *self.tests]
            where = f" where {' and '.join(f'({t})' for t, _ in tests)}" if tests else ""
            listed = ", ".join(self._value(c) for c, _ in self.columns) or "null"
            rows = con.execute(f"select {listed} from {_quoted(self.table)}{where}", [v for _, x in tests for v in x])
            while part := rows.fetchmany(BATCH):
                columns = list(zip(*part, strict=True))
                if not self.columns:
                    yield pa.RecordBatch.from_struct_array(pa.array([{}] * len(part), pa.struct([])))
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if t == "bigint" else pa.string()) for (_, t), v in zip(self.columns, columns, strict=True)], names=[c for c, _ in self.columns])


def _rows(since: tuple | None, upto: tuple | None) -> Rows:
    r = Rows(since, upto)
    D.InputPartition.__init__(r, (since, upto))
    return r
