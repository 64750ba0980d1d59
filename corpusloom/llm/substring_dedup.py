"""Substring dedup: repeated windows of words found through difference-cover anchors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.llm import blocks
from corpusloom.llm.hashing import Hasher, runs

WINDOW = 20
#: A difference cover: any difference modulo PERIOD is one of two members. So two equal windows of WINDOW words hold, at
#: the same distance from their starts (below PERIOD), anchors that both begin at cover places of their documents.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1


class _Block:
    """A block's words and anchors, the same on each pass."""

    def __init__(self, table):
        self.table, self.ids, self.data, self.offsets = blocks.in_order(table)
        self.words, self.counts = Hasher(1).words(self.data, self.offsets)
        first = np.concatenate(([0], np.cumsum(self.counts)))
        self.first = first
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.words)) - first[:-1][self.owner]
        self.left = self.counts[self.owner] - self.place
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        self.at = np.flatnonzero(cover[self.place % PERIOD] & (self.left >= ANCHOR) & (self.counts[self.owner] >= WINDOW))
        self.anchors = runs(self.words, ANCHOR)[self.at]

    def windows(self, repeated: np.ndarray):
        """Starts of the windows around repeated anchors, in order; their two hashes; their order by hash (equal ones by
        start); and where in it a new sequence begins."""
        seen = np.zeros(len(self.words) + PERIOD + 1, np.int64)
        seen[self.at[repeated] + 1] = 1
        seen = np.cumsum(seen)
        start = np.flatnonzero(self.left >= WINDOW)
        start = start[seen[start + PERIOD] > seen[start]]
        one, two = runs(self.words, WINDOW)[start], runs(Hasher(2).words(self.data, self.offsets)[0], WINDOW)[start]
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return start, one, two, order, new


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's words, less those in a window of WINDOW words that also starts earlier in the corpus.

    Returns id, n_words, n_removed and kept (the kept words joined by a space). Earlier: smaller id, or the same document and
    an earlier start; windows are judged on the input. A null id (returned as it is) counts as the lowest; rows that share an
    id come in the order of the hash of id and text, then of their texts. Null or empty text: no words. Fewer than WINDOW words: nothing is removed. Other columns are not read.

    Anchors are told apart by a 64-bit hash of their words, windows by two independent ones (128 bits). One pass hashes windows of ANCHOR words at cover
    places and learns which anchors occur twice; a second extends around those to whole windows and learns which occurrence
    is the first; a third drops words. Texts are shuffled once, into blocks; all passes share that exchange.
    """
    import pyarrow as pa

    rows, n = blocks.blocked(docs, id_col, text_col)

    def anchors(key, table):
        keys, count = np.unique(_Block(table).anchors, return_counts=True)
        return blocks.sent(key[0].as_py(), keys, n, more=count > 1)

    def repeated(key, table):
        keys, sizes = blocks.gathered(table, "keys", np.uint64)
        more, _ = blocks.gathered(table, "more", bool)
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        return blocks.answered(table, sizes, twice=(count[back] > 1) | more)

    def found(table, said):
        block = _Block(table)
        _, back = np.unique(block.anchors, return_inverse=True)
        return block, *block.windows(blocks.answer(said, "twice", bool)[back])

    def windows(key, table, said):
        block, start, one, two, order, new = found(table, said)
        first = order[new]
        return blocks.sent(key[0].as_py(), one[first], n, two=two[first], id=block.ids[block.owner[start[first]]])

    def earliest(key, table):
        one, sizes = blocks.gathered(table, "keys", np.uint64)
        two, _ = blocks.gathered(table, "two", np.uint64)
        ids, _ = blocks.gathered(table, "id", np.int64)
        block = np.repeat(table.column("block").to_numpy(), sizes)
        order = np.lexsort((block, ids, two, one))
        lead = np.ones(len(order), bool)
        lead[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        first = np.zeros(len(order), bool)
        first[order[lead]] = True
        return blocks.answered(table, sizes, first=first)

    def drop(key, table, said, firsts):
        block, start, _, _, order, new = found(table, said)
        again = np.ones(len(start), bool)
        again[order[new]] = ~blocks.answer(firsts, "first", bool)
        cover = np.zeros(len(block.words) + 1, np.int64)
        np.add.at(cover, start[again], 1)
        np.add.at(cover, start[again] + WINDOW, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.bincount(block.owner[gone], minlength=len(block.counts))
        texts = []
        for k, cut in enumerate(removed.tolist()):
            words = block.data[block.offsets[k] : block.offsets[k + 1]].tobytes().split()
            if cut:
                words = [w for w, g in zip(words, gone[block.first[k] : block.first[k + 1]].tolist(), strict=True) if not g]
            texts.append(b" ".join(words))
        return pa.table({"id": block.table.column("id"), "n_words": pa.array(block.counts), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(texts, pa.binary()).cast(pa.string())})

    by = rows.groupBy("block")
    asked = by.applyInArrow(anchors, "bucket int, block int, keys binary, more binary")
    twice = asked.groupBy("bucket").applyInArrow(repeated, "bucket int, block int, twice binary")
    first_asked = by.cogroup(twice.groupBy("block")).applyInArrow(windows, "bucket int, block int, keys binary, two binary, id binary")
    first = first_asked.groupBy("bucket").applyInArrow(earliest, "bucket int, block int, first binary")
    replies = twice.selectExpr("block", "bucket", "twice", "cast(null as binary) first").unionByName(first.selectExpr("block", "bucket", "cast(null as binary) twice", "first"))

    def last(key, table, said):
        import pyarrow.compute as pc

        return drop(key, table, said.filter(pc.is_valid(said.column("twice"))), said.filter(pc.is_valid(said.column("first"))))

    out = by.cogroup(replies.groupBy("block")).applyInArrow(last, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
