"""Language-model scoring: a Katz backoff model of words, counted and normalised over the whole corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import blocks
from corpusloom.llm.common import remainder, stored
from corpusloom.llm.hashing import Hasher, joined

#: Counts up to DISCOUNTED are discounted (Good-Turing); larger ones are trusted.
DISCOUNTED = 5
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)


def discounts(of: np.ndarray) -> np.ndarray:
    """d for counts 0 to DISCOUNTED and, last, for all larger ones (1), from the numbers of n-grams found 1, 2, ... times.

    Katz: d_r = (r*/r - A) / (1 - A), r* = (r+1) n_(r+1) / n_r, A = (k+1) n_(k+1) / n_1. Where these numbers are too few or
    irregular to give 0 < d_r < 1, d_r = r / (r + 1)."""
    k, d = DISCOUNTED, np.ones(DISCOUNTED + 2)
    d[0] = 0
    n = np.concatenate(([0.0], of[: k + 1]))
    a = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
        d[r] = x if 0 < x < 1 else r / (r + 1)
    return d


class Unigrams:
    """P(w): discounted counts over all training tokens; what they leave is the probability of an unknown word."""

    def __init__(self, total: int, of: np.ndarray, large: float):
        """large: the tokens of words found more than DISCOUNTED times."""
        self.total, self.d = total, discounts(of)
        r = np.arange(1, DISCOUNTED + 1)
        seen = (float((self.d[1:-1] * r * of[:DISCOUNTED]).sum()) + large) / total if total else 0.0
        least = 1 / (total + 1)
        self.scale = (1 - least) / seen if seen > 1 - least else 1.0
        self.unknown = 1 - seen * self.scale

    def __call__(self, count: np.ndarray) -> np.ndarray:
        p = self.d[np.minimum(count, DISCOUNTED + 1)] * count * self.scale / max(self.total, 1)
        return np.where(count > 0, p, self.unknown)


class _Grams:
    """The n-grams that end at each token of a block: distinct keys, where each is first, and each token's."""

    def __init__(self, hashes: np.ndarray):
        self.keys, self.first, self.back = np.unique(hashes, return_index=True, return_inverse=True)


class _Block:
    """A block's tokens, with their n-grams up to `order` and the contexts before them: the same on each pass."""

    def __init__(self, table, order: int):
        self.table, self.ids, data, offsets = blocks.in_order(table)
        words, counts = Hasher().words(data, offsets, lower=True)
        self.counts = counts + 1
        ends = np.cumsum(self.counts) - 1
        self.first = ends - counts
        tokens = np.empty(len(words) + len(counts), np.uint64)
        last = np.zeros(len(tokens), bool)
        last[ends] = True
        tokens[~last], tokens[last] = words, _END
        self.train = np.repeat(self.table.column("train").to_numpy(zero_copy_only=False), self.counts)
        hashes, self.grams, self._before = tokens, {1: _Grams(tokens)}, {}
        for k in range(2, order + 1):
            before = np.concatenate(([_START], hashes[:-1]))
            before[self.first] = _START
            self._before[k] = before
            hashes = joined(before, tokens)
            self.grams[k] = _Grams(hashes)

    def contexts(self, k: int):
        """The distinct contexts of n-grams of length k, and each token's."""
        return np.unique(self._before[k], return_inverse=True)


def _bytes(n: np.ndarray, edges: np.ndarray) -> dict[str, list[bytes]]:
    """Counts in slices: a byte each, and those of 255 and more in full."""
    slices = [n[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    return {"low": [np.minimum(x, 255).astype(np.uint8).tobytes() for x in slices], "high": [x[x >= 255].astype(np.int64).tobytes() for x in slices]}


def _totals(said) -> np.ndarray:
    low = blocks.answer(said, "low", np.uint8).astype(np.int64)
    low[low == 255] = blocks.answer(said, "high", np.int64)
    return low


def _owned(said) -> np.ndarray:
    said = said.sort_by("bucket")
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(said.column("own").to_pylist(), said.column("low").to_pylist(), strict=True)]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


class _Model:
    """What a block has been told: counts of its n-grams, and the backoff weights and shares of its contexts."""

    def __init__(self, block: _Block, said, unigram: Unigrams, d: dict[int, np.ndarray]):
        import pyarrow.compute as pc

        self.block, self.unigram, self.d, self.said = block, unigram, d, said
        self.of = lambda kind, k: said.filter(pc.and_(pc.equal(said.column("kind"), kind), pc.equal(said.column("n"), k)))

    def counts(self, k: int) -> np.ndarray:
        """How often each distinct n-gram of length k was trained on."""
        return _totals(self.of("counts", k))

    def probability(self, k: int) -> np.ndarray:
        """P(token | the k - 1 before it) of each token: discounted if the n-gram was seen, else one word less of context."""
        gram, r = self.block.grams[k], self.counts(k)
        if k == 1:
            return self.unigram(r)[gram.back]
        said = self.of("weights", k)
        _, context = self.block.contexts(k)
        backoff, share = blocks.answer(said, "backoff", np.float64), blocks.answer(said, "share", np.float64)
        seen = (self.d[k][np.minimum(r, DISCOUNTED + 1)] * r)[gram.back] * share[context]
        return np.where(r[gram.back] > 0, seen, backoff[context] * self.probability(k - 1))


_TOLD = "kind string, n int, of string, bucket int, block int, keys binary, low binary, high binary, own binary, backoff binary, share binary, stats array<long>"


def _told(rows: int, **columns):
    """An Arrow table with all columns of _TOLD, null where not given."""
    import pyarrow as pa

    kinds = {"kind": pa.string(), "n": pa.int32(), "of": pa.string(), "bucket": pa.int32(), "block": pa.int32(), "stats": pa.list_(pa.int64())}
    names = [c.split()[0] for c in _TOLD.split(", ")]
    return pa.table({c: pa.array(columns.get(c, [None] * rows), kinds.get(c, pa.binary())) for c in names})


def score(docs: DataFrame, held_out_remainder: int = 1, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of every text under a Katz model of `order` words, with the base score of its words.

    Tokens: words of the text in lower case (A-Z), then one end. Trained on rows with crc32(id) mod 5 other than
    held_out_remainder. P(w|h) = d_r r / c(h) for an n-gram found r > 0 times, else a(h) P(w|h'), h' being h without its first
    word and P(w) a discounted unigram with all unknown words one class; a(h) makes the probabilities after h sum to one. A
    context none of whose n-grams is discounted gives up 1 / (c(h) + 1). An unknown context: P(w|h').

    Questions from blocks of texts to buckets of hashes: counts of n-grams, then for each length in turn the probability
    that each context has left (an n-gram counts in the one block that owns it), then the score of each token, recursively.
    Two tables are written: counts, with the key and count of every n-gram, and for each length weights, with the key, backoff
    weight and share (1 / c(h)) of every context, partitioned by length (`n`) and `of`: the model, or what blocks are told of
    it. N-grams are told apart by 64-bit hashes. Null or empty text: the end alone. Null id: a training row. Repeated rows: a
    row each, trained on each. Empty input: no rows. Other columns are not read.
    """
    import pyarrow as pa

    held = F.coalesce(remainder(F.col(id_col), 5) == held_out_remainder, F.lit(False))
    rows, n = blocks.blocked(docs, id_col, text_col, (~held).alias("train"))
    by = rows.groupBy("block")

    def ask(key, table):
        b, out = _Block(table, order), []
        for k, gram in b.grams.items():
            found = np.bincount(gram.back[b.train], minlength=len(gram.keys))
            sent = blocks.sent(key[0].as_py(), gram.keys, n)
            told = _bytes(found, blocks.cuts(gram.keys, n)[1])
            for column in ("low", "high"):
                sent = sent.append_column(column, pa.array(told[column], pa.binary()))
            out.append(sent.append_column("n", pa.array([k] * len(sent), pa.int32())))
        return pa.concat_tables(out).select(["n", "bucket", "block", "keys", "low", "high"])

    def count(key, table):
        keys, sizes = blocks.gathered(table, "keys", np.uint64)
        r = blocks.gathered(table, "low", np.uint8)[0].astype(np.int64)
        r[r == 255] = blocks.gathered(table, "high", np.int64)[0]
        known, first, back = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(back, r).astype(np.int64)
        own = np.zeros(len(keys), bool)
        own[first] = True
        edges = np.concatenate(([0], np.cumsum(sizes)))
        few = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
        stats = [int((total > 0).sum()), int(total.sum()), int(total[total > DISCOUNTED].sum()), *few.tolist()]
        m, trained = len(sizes), total > 0
        model = {"keys": [blocks.packed(known[trained])] if trained.any() else [None]} | _bytes(total[trained], np.array([0, trained.sum()]))
        replies = _told(
            m, kind=["counts"] * m, n=[key[0].as_py()] * m, of=["blocks"] * m, bucket=table.column("bucket").to_pylist(), block=table.column("block").to_pylist(),
            own=[np.packbits(own[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)], **_bytes(total[back], edges),
        )
        return pa.concat_tables([replies, _told(1, kind=["counts"], n=[key[0].as_py()], of=["model"], bucket=[key[1].as_py()], stats=[stats], **model)])

    asked = by.applyInArrow(ask, "n int, bucket int, block int, keys binary, low binary, high binary")
    told = stored(asked.groupBy("n", "bucket").applyInArrow(count, _TOLD), "n", "of").select(*[c.split()[0] for c in _TOLD.split(", ")])
    width = DISCOUNTED + 4
    sums = told.filter("of = 'model'").groupBy("n").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()
    sums = {x["n"]: np.array([x[f"s{i}"] for i in range(width)], np.int64) for x in sums}
    none = np.zeros(width, np.int64)
    distinct, total, large = (int(x) for x in sums.get(1, none)[:3])
    unigram = Unigrams(total, sums.get(1, none)[3:].astype(float), large)
    d = {k: discounts(sums.get(k, none)[3:].astype(float)) for k in range(2, order + 1)}

    def mass(k):
        def of_block(key, table, said):
            b = _Block(table, k)
            model, gram = _Model(b, said, unigram, d), b.grams[k]
            r = model.counts(k)
            mine = np.flatnonzero(_owned(model.of("counts", k)) & (r > 0))
            contexts, back = b.contexts(k)
            where = back[gram.first[mine]]
            add = lambda x: np.bincount(where, x, minlength=len(contexts))
            seen = d[k][np.minimum(r[mine], DISCOUNTED + 1)] * r[mine]
            return blocks.sent(key[0].as_py(), contexts, n, c=add(r[mine]), seen=add(seen), less=add(model.probability(k - 1)[gram.first[mine]]))

        return of_block

    def weigh(k):
        def of_bucket(key, table):
            keys, sizes = blocks.gathered(table, "keys", np.uint64)
            known, back = np.unique(keys, return_inverse=True)
            c, seen, less = (np.bincount(back, blocks.gathered(table, x, np.float64)[0]) for x in ("c", "seen", "less"))
            some = np.maximum(c, 1)
            whole = seen > c * (1 - 1e-9)  # nothing is discounted: all seen shrink by c / (c + 1)
            left = np.where(whole, 1 / (some + 1), 1 - seen / some)
            backoff = np.where(c > 0, left / np.maximum(1 - less, 1e-300), 1.0)
            share = np.where(c > 0, 1 / np.where(whole, some + 1, some), 0.0)
            edges, m = np.concatenate(([0], np.cumsum(sizes))), len(sizes)
            part = lambda x: [x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            replies = _told(m, kind=["weights"] * m, n=[k] * m, of=["blocks"] * m, bucket=table.column("bucket").to_pylist(), block=table.column("block").to_pylist(), backoff=part(backoff[back]), share=part(share[back]))
            seen = c > 0
            model = _told(1, kind=["weights"], n=[k], of=["model"], bucket=[key[0].as_py()], keys=[blocks.packed(known[seen]) if seen.any() else None], backoff=[backoff[seen].tobytes()], share=[share[seen].tobytes()])
            return pa.concat_tables([replies, model])

        return of_bucket

    for k in range(2, order + 1):
        parts = by.cogroup(told.filter("of = 'blocks'").groupBy("block")).applyInArrow(mass(k), "bucket int, block int, keys binary, c binary, seen binary, less binary")
        weights = stored(parts.groupBy("bucket").applyInArrow(weigh(k), _TOLD), "n", "of")
        told = told.unionByName(weights)

    def evaluate(key, table, said):
        b = _Block(table, order)
        model = _Model(b, said, unigram, d)
        r, words = model.counts(1), b.grams[1]
        base = np.log10((r + 0.5) / (total + 0.5 * (distinct + 1)))[words.back]
        per = lambda x: np.add.reduceat(x, b.first)
        return pa.table({
            "id": b.table.column("id"), "held_out": pa.array(~b.train[b.first]), "n_tokens": pa.array(b.counts), "n_known": pa.array(per((r > 0)[words.back].astype(np.int64))),
            "train_tokens": pa.array(np.full(len(b.counts), total)), "base_score": pa.array(per(base)), "score": pa.array(per(np.log10(model.probability(order)))),
        })

    out = by.cogroup(told.filter("of = 'blocks'").groupBy("block")).applyInArrow(evaluate, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
