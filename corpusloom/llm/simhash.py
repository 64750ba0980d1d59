"""SimHash near-dedup: links between fingerprints found with Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, hot_join, stored, words
from corpusloom.llm.components import components

#: The generator polynomial of the binary Golay code (23, 12, 7): a fixed value.
GOLAY = 0xC75
#: The three segments of 64 bits: place and width. Each is a shortened word of the code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The largest bucket whose pairs are compared one by one.
SMALL = 64


def shingle_hashes(text: Column, wide: int = 3) -> tuple[Column, Column]:
    """The words (to be put in column `w` first) and, from that column, the XXH64 (seed 42) of each run of `wide` words."""
    w, n = F.col("w"), F.size("w")
    runs = F.transform(F.sequence(F.lit(0), n - wide), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(wide)])))
    few = F.when(n > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.array().cast("array<bigint>"))
    return words(ascii_lower(text)), F.when(n >= wide, runs).otherwise(few)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: bit set if it is in over half of them."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ones = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part, who = hashes[at : at + (1 << 15)], owner[at : at + (1 << 15)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        ones[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_bits = np.packbits(ones * 2 > counts[:, None], axis=1, bitorder="little")
    return set_bits.reshape(-1).view("<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, fp (the 64 bits as a long; zero for a text without words) and carry (a struct of further columns) of every whole text."""
    import pyarrow as pa

    split, hashes = shingle_hashes(F.coalesce(F.col("t"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.struct(F.lit(0).alias("none"), *carry).alias("carry"))
    rows = rows.select("id", split.alias("w"), "carry").select("id", hashes.alias("h"), "carry")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "carry")}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at = lists.offsets.to_numpy()
            flat = lists.values.slice(at[0], at[-1] - at[0]).to_numpy().view(np.uint64)
            fp = majority(flat, np.diff(at))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], names=["id", "fp", "carry"])

    return rows.mapInArrow(fold, f"id {kinds['id']}, fp long, carry {kinds['carry']}")


class Golay:
    """Decodes 23-bit words to the number (12 bits) of the codeword within three errors."""

    def __init__(self):
        def rest(v: np.ndarray) -> np.ndarray:
            for bit in range(22, 10, -1):
                v = np.where(v >> bit & 1, v ^ (GOLAY << (bit - 11)), v)
            return v

        self.low, self.high = rest(np.arange(1 << 12)), rest(np.arange(1 << 11) << 12)
        one = 1 << np.arange(23)
        patterns = [np.zeros(1, np.int64), one]
        for _ in range(2):
            patterns.append(np.unique((patterns[-1][:, None] ^ one).ravel()))
        weight = np.array([bin(x).count("1") for x in range(1 << 12)])
        errors = np.unique(np.concatenate(patterns))
        errors = errors[weight[errors & 4095] + weight[errors >> 12] <= 3]
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self.low[errors & 4095] ^ self.high[errors >> 12]] = errors

    def decode(self, v: np.ndarray) -> np.ndarray:
        return (v ^ self.error[self.low[v & 4095] ^ self.high[v >> 12]]) >> 11

    def keys(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of fp and their keys. Two fingerprints at distance two or less share one: of three segments one has no
        error then, and the next has two at most, so some word is within one bit of both. A key is the segment without
        error, whole, and the codeword number of a word within one bit of the next segment (one or six numbers)."""
        part = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
        rows, found = [], []
        for k in range(3):
            near = np.concatenate(([0], 1 << np.arange(SEGMENTS[(k + 1) % 3][1])))
            number = np.sort(self.decode(part[(k + 1) % 3][:, None] ^ near), axis=1)
            new = np.concatenate((np.ones((len(fp), 1), bool), number[:, 1:] != number[:, :-1]), axis=1)
            row, column = np.nonzero(new)
            rows.append(row)
            found.append(k << 34 | part[k][row] << 12 | number[row, column])
        return np.concatenate(rows), np.concatenate(found)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs at distance 2 or less.

    In buckets of up to SMALL members each pair is compared. Members of larger ones are linked through the words within one
    bit of them: two fingerprints are at distance two or less just if they share such a word, and no word has over 65
    fingerprints around it. So no pair is lost and no bucket is paired out, however large.
    """
    import pyarrow as pa

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                fp = b.column(0).slice(at, 4000).to_numpy()
                row, key = golay.keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keys = stored(fps.select("fp").mapInArrow(spread, "key long, fp long"))
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = stored(hot_join(keys, sizes, "key", "n"))
    small = shared.filter(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("fp").alias("m"))
    m = F.col("m")
    near = lambda x, i: F.transform(F.filter(F.slice(m, i + 2, F.lit(SMALL)), lambda y: F.bit_count(x.bitwiseXOR(y)) <= 2), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))
    pairs = small.select(F.explode(F.flatten(F.transform("m", near))).alias("e"), F.size("m")).select("e.a", "e.b")
    large = shared.filter(F.col("n") > SMALL).select("fp").distinct()
    around = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    stars = large.select("fp", F.explode(around).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("m")).filter(F.size("m") > 1)
    stars = stars.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document's fingerprint (16 hex digits), component_id (the smallest id reachable over links) and kept.

    Fingerprints are linked at two or fewer differing bits; texts without words (null, empty, white space) have the
    fingerprint zero and are linked like any other. Repeated rows: a row each. A null id is never the smallest if there is
    another. Exactly one row of each component is kept: of those with the smallest id, any one. `carry`: further columns to
    return; no others are read. Copies of a fingerprint count once until the end, so a group of copies costs one row.
    """
    marked = stored(fingerprints(docs, id_col, text_col, carry).withColumn("row", F.monotonically_increasing_id()))
    least = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    fps = stored(marked.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")))
    linked = components(links(fps))
    named = fps.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named)
    roots = stored(named.groupBy("component").agg(F.min("least").alias("root"), F.count("*").alias("members")))
    of_fp = stored(hot_join(named.select("fp", "n", "component"), roots, "component", "members").select("fp", "n", "root"))
    return hot_join(marked, of_fp, "fp", "n").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("root.id").alias("component_id"), (F.col("row") == F.col("root.row")).alias("kept"), *[F.col("carry")[c].alias(c) for c in carry]
    )
