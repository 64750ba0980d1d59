"""Blocks of whole documents, and questions that blocks put to buckets of hashes.

A block is a group of whole documents, chosen by the hash of id and text; a bucket is a range of hashes. A block sends each
distinct hash of its texts once, as sorted arrays cut by bucket; a bucket's task sees what all blocks sent it and sends
back an array in the same order. A hash that is everywhere costs a bucket one entry per block, never one per occurrence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.hashing import flat

BLOCK_BYTES, LEAST = 8 << 20, 64
LOWEST = -(1 << 63)


def blocked(docs: DataFrame, id_col: str, text_col: str, *more) -> tuple[DataFrame, int]:
    """Columns block, id (long), t (bytes of the whole text) and any more; and the number of blocks. Rows of one id (null
    or not) are spread over blocks by their texts."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(LEAST, -(-size // BLOCK_BYTES))
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int").alias("block"), key.alias("id"), text.cast("binary").alias("t"), *more), n


def in_order(block):
    """The block's rows by id (null first), then text; ids (null: the lowest); and the bytes and offsets of the texts."""
    import pyarrow.compute as pc

    block = block.combine_chunks()
    block = block.append_column("key", pc.fill_null(block.column("id"), LOWEST)).sort_by([("key", "ascending"), ("t", "ascending")])
    data, offsets = flat(block.column("t"))
    return block, block.column("key").to_numpy(), data, offsets


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key; in the keys' order."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sorted keys that have any, and the edges of their slices."""
    which, first = np.unique(buckets(keys, n), return_index=True)
    return which, np.append(first, len(keys))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, in as few bytes each as the largest needs; without loss."""
    steps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return keys[:1].tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[8]
    steps = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    with np.errstate(over="ignore"):
        return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.frombuffer(data, np.uint64, 1)[0]


def sent(block: int, keys: np.ndarray, of: int, **columns: np.ndarray):
    """An Arrow table: for each bucket, the block, its slice of the sorted keys, packed, and slices of other arrays, as
    binary columns."""
    import pyarrow as pa

    which, edges = cuts(keys, of)
    part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
    arrays = {"bucket": pa.array(which, pa.int32()), "block": pa.array(np.full(len(which), block), pa.int32())}
    arrays["keys"] = pa.array([packed(keys[a:b]) for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
    return pa.table(arrays | {k: part(v) for k, v in columns.items()})


def gathered(table, column: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's arrays, one after another, and how many entries each has."""
    read = unpacked if column == "keys" else lambda x: np.frombuffer(x, dtype)
    arrays = [read(x) for x in table.column(column).to_pylist()]
    sizes = np.array([len(x) for x in arrays], np.int64)
    return (np.concatenate(arrays) if arrays else np.zeros(0, dtype)), sizes


def answered(table, sizes: np.ndarray, **columns: np.ndarray):
    """An Arrow table: bucket and block of the rows of `table`, and each one's part of the arrays."""
    import pyarrow as pa

    edges = np.concatenate(([0], np.cumsum(sizes)))
    part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block")} | {k: part(v) for k, v in columns.items()})


def answer(table, column: str, dtype) -> np.ndarray:
    """What the buckets said about a block's sorted keys, in the keys' order."""
    return gathered(table.sort_by("bucket"), column, dtype)[0]
