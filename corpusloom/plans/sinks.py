"""Sinks for df.write.format(): files by name (corpus_files) and one file from many tasks (corpus_file).

Tasks write to a folder of their attempt beside the target; only when all have succeeded do the attempts that Spark committed
take their place. A task that is killed, or a job that fails, leaves nothing at the target.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import datasource as D

#: Bytes that are copied at once.
PIECE = 4 << 20


def _store(path: str):
    from corpusloom.sources.files import _store

    return _store(path)


@dataclass
class Attempt(D.WriterCommitMessage):
    """What a task has written: its place among the tasks, and the folder of its attempt."""

    part: int
    folder: str


class _Staged(D.DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.options = options["path"], overwrite, dict(options)
        _, base = _store(self.path)
        self.staging = posixpath.join(posixpath.dirname(base), f".{posixpath.basename(base)}.{uuid.uuid4().hex}")

    def _attempt(self) -> tuple[int, str]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        return part, f"{self.staging}/{part:07d}-{uuid.uuid4().hex}"

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        from pyarrow import fs

        if store.get_file_info(self.staging).type == fs.FileType.Directory:
            store.delete_dir(self.staging)


class NamedFiles(D.DataSource):
    """Rows (name, value) as files: the values of one name, in order, are one file of the folder `path` (or of one below it, where the
    name has slashes). A name's rows are in one task and come together. Mode overwrite replaces the folder, append adds to it (and replaces files of the same names)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def writer(self, schema, overwrite: bool) -> _NamedWriter:
        return _NamedWriter(self.options, overwrite)


class _NamedWriter(_Staged):
    def write(self, rows: Iterator) -> Attempt:
        part, folder = self._attempt()
        store, _ = _store(self.path)
        store.create_dir(folder, recursive=True)
        out, now = None, None
        for row in rows:
            if row["name"] != now:
                if out:
                    out.close()
                now = row["name"]
                if now.startswith("/") or ".." in now.split("/"):
                    raise ValueError(f"outside the folder: {now}")
                if "/" in now:
                    store.create_dir(posixpath.dirname(f"{folder}/{now}"), recursive=True)
                out = store.open_output_stream(f"{folder}/{now}")
            out.write(row["value"].encode())
        if out:
            out.close()
        return Attempt(part, folder)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        if self.overwrite and store.get_file_info(base).type == fs.FileType.Directory:
            store.delete_dir(base)
        store.create_dir(base, recursive=True)
        for m in filter(None, messages):
            for f in store.get_file_info(fs.FileSelector(m.folder, recursive=True)):
                to = f"{base}/{f.path[f.path.index(m.folder) + len(m.folder) + 1 :]}"
                if f.type == fs.FileType.Directory:
                    store.create_dir(to, recursive=True)
                else:
                    store.move(f.path, to)
        self.abort(messages)


class OneFile(D.DataSource):
    """Rows (value) as one file at `path`, in the order of the tasks and of each one's rows (sort before). Options: head and tail of the
    file, between (what stands between two values; a line end if not given). It replaces a file that is there."""

    @classmethod
    def name(cls) -> str:
        return "corpus_file"

    def writer(self, schema, overwrite: bool) -> _OneWriter:
        return _OneWriter(self.options, overwrite)


class _OneWriter(_Staged):
    def write(self, rows: Iterator) -> Attempt:
        part, folder = self._attempt()
        store, _ = _store(self.path)
        store.create_dir(folder, recursive=True)
        between, first = self.options.get("between", "\n").encode(), True
        with store.open_output_stream(f"{folder}/part") as out:
            for row in rows:
                out.write(row["value"].encode() if first else between + row["value"].encode())
                first = False
        if first:
            store.delete_file(f"{folder}/part")
        return Attempt(part, folder)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        store.create_dir(posixpath.dirname(base), recursive=True)
        whole = f"{self.staging}/whole"
        store.create_dir(self.staging, recursive=True)
        between, first = self.options.get("between", "\n").encode(), True
        with store.open_output_stream(whole) as out:
            out.write(self.options.get("head", "").encode())
            for m in sorted(filter(None, messages), key=lambda m: m.part):
                if store.get_file_info(f"{m.folder}/part").type != fs.FileType.File:
                    continue
                if not first:
                    out.write(between)
                first = False
                with store.open_input_stream(f"{m.folder}/part") as part:
                    while piece := part.read(PIECE):
                        out.write(piece)
            out.write(self.options.get("tail", "").encode())
        store.move(whole, base)
        self.abort(messages)
