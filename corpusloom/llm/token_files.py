"""Token ids in files of fixed-width bits: written by Spark tasks, read back by row or by block."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import released, stored

#: The first and the last bytes of a file.
MAGIC = b"IDBITS01"
#: Ids of a block (a multiple of eight: blocks end at a byte), bytes of text that a file is made for, and files at least.
BLOCK, FILE_BYTES, LEAST_FILES = 8192, 128 << 20, 32
#: Documents are read in runs of about this many ids.
RUN = 1 << 20
_HEAD = np.dtype([("magic", "S8"), ("bits", "<u4"), ("block", "<u4")])
_TAIL = np.dtype([("ids", "<u8"), ("offsets", "<u8"), ("table", "<u8"), ("magic", "S8")])


def width(vocabulary: int) -> int:
    """The bits that tell `vocabulary` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, lowest first; the last byte is filled with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    ones = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(ones.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, skip: int = 0) -> np.ndarray:
    """`n` ids of packed bytes from the one at `skip` on: each is cut out of the eight bytes from its first on."""
    at = (np.arange(skip, skip + n, dtype=np.int64)) * bits
    padded = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    return ((eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def _opened(path: str):
    """The file system of a path or URI that all machines see, and the path in it (local, hdfs://, s3://, gs://, abfs://)."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


class Writer:
    """Writes one file: head, blocks, offsets of the blocks, a table of the documents (Arrow), tail. Holds one block at most."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        system, name = _opened(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out, self.bits, self.block = system.open_output_stream(name), bits, block
        self.out.write(np.array([(MAGIC, bits, block)], _HEAD).tobytes())
        self.offsets, self.held, self.waiting, self.ids, self.ends, self.keys = [_HEAD.itemsize], [], 0, 0, [], []

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        self.ends.append(self.ids)
        if self.waiting >= self.block:
            self._flush(self.waiting // self.block * self.block)

    def _flush(self, n: int) -> None:
        every = np.concatenate(self.held)
        for at in range(0, n, self.block):
            data = pack(every[at : min(n, at + self.block)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.waiting = [every[n:]], len(every) - n

    def close(self, keys) -> None:
        """`keys`: an Arrow array, the document's id of each add()."""
        import pyarrow as pa

        if self.waiting:
            self._flush(self.waiting)
        sink = pa.BufferOutputStream()
        table = pa.table({"key": keys, "end": pa.array(np.array(self.ends, np.int64))})
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        offsets = np.array(self.offsets, "<u8").tobytes()
        self.out.write(offsets)
        self.out.write(sink.getvalue())
        self.out.write(np.array([(self.ids, self.offsets[-1], self.offsets[-1] + len(offsets), MAGIC)], _TAIL).tobytes())
        self.out.close()


class Reader:
    """Random access to one file: ids(a, b) reads the blocks that hold them and no more."""

    def __init__(self, path: str):
        import pyarrow as pa

        system, name = _opened(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        head = np.frombuffer(self._at(0, _HEAD.itemsize), _HEAD)[0]
        tail = np.frombuffer(self._at(size - _TAIL.itemsize, _TAIL.itemsize), _TAIL)[0]
        if head["magic"] != MAGIC or tail["magic"] != MAGIC:
            raise ValueError(f"{path} is no whole file of token ids")
        self.bits, self.block, self.n_ids = int(head["bits"]), int(head["block"]), int(tail["ids"])
        middle, table = int(tail["offsets"]), int(tail["table"])
        self.offsets = np.frombuffer(self._at(middle, table - middle), "<u8")
        self.documents = pa.ipc.open_stream(self._at(table, size - _TAIL.itemsize - table)).read_all()
        self.edges = np.concatenate(([0], self.documents.column("end").to_numpy()))

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 of the file."""
        if b <= a:
            return np.zeros(0, "<u4")
        first, last = a // self.block, -(-b // self.block)
        data = self._at(int(self.offsets[first]), int(self.offsets[last] - self.offsets[first]))
        return unpack(data, self.bits, b - a, a - first * self.block)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.edges[k]), int(self.edges[k + 1]))

    def close(self) -> None:
        self.file.close()


def _written(folder: str, vocabulary: str, bits: int, end_id: int):
    """Encodes a task's rows (key, text; in order), writes them as one file and returns what is in it. A second attempt of a task
    writes a file of its own; only that of the attempt whose row Spark commits is ever read."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from corpusloom.llm.tokenize import spaced

        words, end = spaced(vocabulary), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        path, writer, keys = f"{folder.rstrip('/')}/ids-{part:07d}-{uuid.uuid4().hex}.bin", None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                writer = writer or Writer(path, bits)
                keys.append(some.column(0))
                for ids in words.many(some.column(1).to_pylist()):
                    writer.add(np.frombuffer(ids + end, "<u4"))
        if writer:
            writer.close(pa.chunked_array(keys))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [path], "docs": [len(writer.ends)], "ids": [writer.ids]})

    return run


def write(docs: DataFrame, folder: str, vocabulary: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of all documents to files below `folder` and returns their list: part, file, docs, ids, start (ids of all
    files before it). The list is also kept as Parquet in `folder`/files; only the files in it count.

    `vocabulary`: a tokenizer file's path; `size`: how many ids there are, which sets the bits of each. Documents lie in ascending
    order of id (null first; equal ids by a hash of the text; equal rows in any order), each followed by `end_id`. Null text: the end id
    alone. Empty input: no files. Texts are sorted into ranges, one file each, and encoded there: they are shuffled once and nothing
    else is stored. Rows that share an id are spread over files as any others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"), text.alias("t"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    by = ["key", "tie", "row"]
    ranges = rows.repartitionByRange(max(LEAST_FILES, -(-total // file_bytes)), *by).sortWithinPartitions(*by).select("key", "t")
    files = ranges.mapInArrow(_written(folder, vocabulary, width(size), end_id), "part int, file string, docs long, ids long")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = stored(files)  # a row for each file
    found.withColumn("start", before).write.parquet(f"{folder.rstrip('/')}/files")
    released(found)
    return docs.sparkSession.read.parquet(f"{folder.rstrip('/')}/files")


def _read(with_ids: bool):
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(file)
                edges, k = reader.edges, 0
                while k < len(edges) - 1:
                    upto = max(k + 1, int(np.searchsorted(edges, edges[k] + RUN, side="right")) - 1)
                    data = memoryview(reader.ids(int(edges[k]), int(edges[upto])).tobytes())
                    cuts = (4 * (edges[k : upto + 1] - edges[k])).tolist()
                    slices = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                    columns = {
                        "key": reader.documents.column("key").slice(k, upto - k).combine_chunks(), "start": pa.array(start + edges[k:upto]), "n": pa.array(np.diff(edges[k : upto + 1])),
                        "crc": pa.array([zlib.crc32(x) for x in slices], pa.int64()), "ids": pa.array([bytes(x) if with_ids else None for x in slices], pa.binary()),
                    }
                    yield pa.RecordBatch.from_pydict(columns)
                    k = upto
                reader.close()

    return run


def read(spark: SparkSession, folder: str, kind: str = "bigint", id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """The documents of the files in `folder`: id (of the SQL type `kind`), start (ids of all documents before it), n_tokens, ids_crc32
    and (if asked for) ids, binary: little-endian unsigned 32-bit, end id included. A task a file; it holds a run of documents."""
    files = spark.read.parquet(f"{folder.rstrip('/')}/files").select("file", "start")
    n = files.count()
    if not n:
        rows = spark.createDataFrame([], f"key {kind}, start long, n long, crc long, ids binary")
    else:
        rows = files.repartition(n).mapInArrow(_read(ids), f"key {kind}, start long, n long, crc long, ids binary")
    out = rows.select(F.col("key").alias(id_col), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "ids")
    return out if ids else out.drop("ids")
