"""Folders of mixed files as rows, and the readers that turn a file's bytes into Markdown.

A file that fails gives a row with the status failed; no file fails a task.
"""

from __future__ import annotations

import csv
import io
import json
import os
import posixpath
import re
import zipfile
from collections.abc import Callable
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import file_type
from corpusloom.sources.connect import registered
from corpusloom.sources.html import html_text

#: Folders and files that a scan passes over: fixed values.
EXCLUDED = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".DS_Store")
PREVIEW_ROWS = 25


#: About how many bytes of files one task reads.
PART = 128 << 20
#: How many converted files, or characters of them, a task hands on at once.
FILES, CHARS = 64, 16 << 20


def _store(folder: str):
    """The file system of a folder and the folder's path in it; on machines' local disks only if all see the same files there.
    Stores take their keys from the machines' environment, as pyarrow does."""
    from pyarrow import fs

    if "://" in folder and not folder.startswith("file:"):
        store, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))
    else:
        store, path = fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/*", "/", folder))
    return store, path.rstrip("/")


def is_folder(folder: str) -> bool:
    from pyarrow import fs

    if not folder:
        return False
    store, base = _store(folder)
    return store.get_file_info(base).type == fs.FileType.Directory


def scan(spark: SparkSession, folder: str, extensions: list[str], excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """path, rel_path, ext, file_type, size of a folder's files, names that begin with a dot or underscore too. Files of other
    extensions are kept if their type is unsupported, so that they are recorded.

    Listed by the source corpus_folder (sources/connect.py): folders are walked in tasks, each file comes once also where links lead
    back to a folder above. A folder that goes away meanwhile is empty; one that is not there at first is an error.
    """
    if not is_folder(folder):
        raise FileNotFoundError(f"no such folder: {folder}")
    source = registered(spark).read.format("corpus_folder").option("exclude", "\n".join(excluded)).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    rows = source.load(folder)
    return rows.filter((F.col("file_type") == "unsupported") | F.lower("ext").isin([e.lower() for e in extensions]))


def json_text(value, key: str | None = None, depth: int = 0) -> str:
    """A heading for each key, bullets for lists of scalars, items by number, nulls and empties said."""
    head = [f"{'#' * min(6, depth + 1)} {key}"] if key is not None else []
    if isinstance(value, dict):
        body = [json_text(v, str(k), depth + 1) for k, v in value.items()] or ["(empty object)"]
    elif isinstance(value, list):
        scalar = all(not isinstance(v, dict | list) for v in value)
        body = (["\n".join(f"- {_scalar(v)}" for v in value)] if scalar else [json_text(v, f"item {i}", depth + 1) for i, v in enumerate(value, 1)]) if value else ["(empty list)"]
    else:
        body = [_scalar(value)]
    return "\n\n".join(head + body)


def _scalar(v) -> str:
    return "(null)" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def csv_text(source: str, name: str = "", copy: str = "") -> str:
    """A title, counts and a table of the first rows. Rows are read one by one; only those that are shown are kept."""
    csv.field_size_limit(1 << 30)
    rows = csv.reader(io.StringIO(source))
    head = next(rows, None)
    if head is None:
        return "[CSV is empty.]"
    shown, n = [], 0
    for n, row in enumerate(rows, 1):
        if n <= PREVIEW_ROWS:
            shown.append(row)
    cell = lambda x: x.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    line = lambda r: "| " + " | ".join(cell(x) for x in (r + [""] * len(head))[: len(head)]) + " |"
    # The labels of the counts.
    facts = {"Row count": n, "Column count": len(head), "Columns": ", ".join(head) or "(none)"} | ({"Original copied to": f"`{copy}`"} if copy else {})
    table = "\n".join([f"## Preview (first {len(shown)} rows)\n", line(head), line(["---"] * len(head)), *map(line, shown)]) if shown else "[No data rows.]"
    return f"# CSV: {name}\n\n" + "\n".join(f"- **{k}:** {v}" for k, v in facts.items()) + "\n\n" + table


def docx_text(content: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p" and text(e):
            style = e.find(f"{w}pPr/{w}pStyle")
            level = "".join(filter(str.isdigit, style.get(f"{w}val", ""))) if style is not None and "eading" in style.get(f"{w}val", "") else ""
            out.append(("#" * max(1, min(6, int(level))) + " " if level else "") + text(e))
        elif e.tag == f"{w}tbl":
            out.append("\n".join("| " + " | ".join(text(c) for c in r.iter(f"{w}tc")) + " |" for r in e.iter(f"{w}tr")))
    return "\n\n".join(out)


def decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


#: Where the files that a document shows lie beside an export, by their path in the source folder.
ASSETS = "assets"


def _read(kind: str, content: bytes, name: str, image: Callable[[str], str] = str, copy: str = "") -> tuple[str, str, str]:
    try:
        if kind == "unsupported":
            return "", "skipped", "unsupported file type"
        if kind == "image":
            return f"# Image: {name}\n\n![{name}]({copy or name})", "ok", "image; no text is read from it"
        if kind == "docx":
            return docx_text(content), "ok", ""
        if kind in ("pdf", "xlsx"):
            return "", "failed", f"no reader for {kind} is installed"
        text = decoded(content)
        if kind == "html":
            return html_text(text, image), "ok", ""
        if kind == "csv":
            return csv_text(text, name, copy), "ok", ""
        return json_text(json.loads(text)) if kind == "json" else text, "ok", ""
    except Exception as e:  # any fault of a file is its row's status
        return "", "failed", f"{type(e).__name__}: {e}"


def convert(kind: Column, content: Column, name: Column) -> Column:
    """markdown, status (ok, skipped, failed) and notes of a file's bytes; Arrow batches of rows."""

    @F.pandas_udf("markdown string, status string, notes string")
    def read(kinds: pd.Series, contents: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [_read(k, bytes(c) if c is not None else b"", n or "") for k, c, n in zip(kinds, contents, names, strict=True)]
        return pd.DataFrame(rows, columns=["markdown", "status", "notes"])

    return read(kind, content, name)


class _Images:
    """The images of one page: those of the web stay; those in the source folder go by their copy; all others are missing."""

    def __init__(self, there: Callable[[str], bool], page: str):
        self.there, self.page, self.copied, self.notes = there, page, [], []

    def __call__(self, src: str) -> str:
        try:
            parts = urlsplit(src)
        except ValueError:
            parts = urlsplit("")
        if not src or parts.scheme in ("http", "https", "data", "mailto") or (parts.netloc and not parts.scheme):
            return src
        # An address from the root, or above the source folder, is not followed.
        path = posixpath.normpath(posixpath.join(posixpath.dirname(self.page), unquote(parts.path)))
        if not parts.path or parts.scheme or path.startswith(("/", "..")) or not self.there(path):
            self.notes.append(f"Missing image asset: {src}")
            return f"MISSING/{src}"
        self.copied.append(path)
        return f"{ASSETS}/{path}"


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """The scanned files of the folder with markdown, status, notes and assets (paths in the folder of what an export has to
    copy: images, those that pages show, CSV files). Each is opened and converted in a task, one at a time. A file that is
    gone or may not be read is failed; other faults of the store are errors, so that the task is tried again."""
    n_files, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n_files, max(cores, -(-size // PART))))

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = _store(folder)
        there = lambda rel: store.get_file_info(f"{base}/{rel}").type == fs.FileType.File

        def one(path, rel, kind):
            images, copy = _Images(there, rel), kind in ("image", "csv")
            content = b""
            if kind not in ("unsupported", "image", "pdf", "xlsx"):
                try:
                    with store.open_input_stream(path) as stream:
                        content = stream.read()
                except (FileNotFoundError, PermissionError) as e:
                    return "", "failed", f"{type(e).__name__}: {e}", []
            markdown, status, notes = _read(kind, content, posixpath.basename(rel), images, f"{ASSETS}/{rel}" if copy else "")
            assets = [rel] if copy else images.copied
            return markdown, status, "; ".join([*filter(None, [notes]), *images.notes]), assets if status == "ok" else []

        names = ["markdown", "status", "notes", "assets"]
        types = [pa.string()] * 3 + [pa.list_(pa.string())]
        def made(listed, rows):
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*listed.columns, *found], names=[*listed.schema.names, *names])

        for batch in batches:
            rows, chars, first = [], 0, 0
            for path, rel, kind in zip(*(batch.column(c).to_pylist() for c in ("path", "rel_path", "file_type")), strict=True):
                rows.append(one(path, rel, kind))
                chars += len(rows[-1][0])
                if len(rows) == FILES or chars > CHARS:
                    yield made(batch.slice(first, len(rows)), rows)
                    rows, chars, first = [], 0, first + len(rows)
            if rows:
                yield made(batch.slice(first, len(rows)), rows)

    listed = files.repartition(parts, "path")
    kinds = ", ".join(f"`{n}` {t}" for n, t in listed.dtypes)
    return listed.mapInArrow(read, f"{kinds}, markdown string, status string, notes string, assets array<string>")


def copy_assets(assets: DataFrame, folder: str, target: str) -> DataFrame:
    """assets (path in the folder; repeats count once) copied to the target in tasks, in pieces; path and size of each. A copy
    takes its name only once it is whole, so that tasks that are tried again or run twice do no harm; a file that is gone by
    then has no row."""

    def copied(batches):
        import uuid

        import pyarrow as pa

        (store, base), (to, root) = _store(folder), _store(target)
        for batch in batches:
            done = []
            for rel in batch.column(0).to_pylist():
                path = f"{root}/{rel}"
                part = f"{path}.{uuid.uuid4().hex}"
                try:
                    source = store.open_input_stream(f"{base}/{rel}")
                except FileNotFoundError:
                    continue
                to.create_dir(posixpath.dirname(path), recursive=True)
                size = 0
                with source, to.open_output_stream(part) as out:
                    while piece := source.read(1 << 22):
                        size += out.write(piece)
                to.move(part, path)
                done.append((rel, size))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "size"])

    return assets.select("path").distinct().mapInArrow(copied, "path string, size long")
