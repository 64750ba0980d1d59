"""Keyword, vector and hybrid retrieval over chunk or document rows."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import WS, exploded, let, preview
from corpusloom.operators.bundling import scratch, stored

#: Latin letters with marks, and the letters that are left without: from Unicode's own decompositions.
_MARKED = [c for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
_BARE = [unicodedata.normalize("NFD", c)[0].lower() for c in _MARKED]
_MARKS = "[\u0300-\u036f]+"
#: BM25: saturation and length normalisation of the reference's index, its least idf, and the fusion's offset.
K1, B, LEAST_IDF, FUSION = 1.2, 0.75, 1e-6, 60
#: Rows, words and bytes of text that are embedded at a time.
EMBED_ROWS, EMBED_WORDS, EMBED_BYTES = 1024, 400_000, 2_400_000
#: Vector searches by many queries: rows and queries in a block at about most, and the least number of tasks; rows that are held at a
#: time where queries are read beside them.
BLOCK_ROWS, BLOCK_QUERIES, BLOCKS, HELD_ROWS = 16384, 2048, 16, 32768


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; Latin letters without marks."""
    bare = F.translate(F.lower(text), "".join(_MARKED), "".join(_BARE))
    return F.regexp_extract_all(F.regexp_replace(bare, _MARKS, ""), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _latin(kept: Callable[[str], str]) -> bytes:
    """A table for bytes.translate(): what is left of each character of Latin-1, a space for none; 0 and 1 stay."""
    each = [kept(chr(c)) for c in range(256)]
    return bytes([0, 1, *[ord(x) if len(x) == 1 and ord(x) < 256 else 32 for x in each[2:]]])


def _term_letter(c: str) -> str:
    bare = c.lower().translate(dict(zip(map(ord, _MARKED), _BARE, strict=True)))
    return bare if unicodedata.category(bare)[0] in "LN" else ""


#: terms() of a text in Latin-1, character by character; and lower-case words between white space.
LATIN_TERMS, LATIN_WORDS = _latin(_term_letter), _latin(lambda c: "" if c.isspace() else c.lower())
#: What a text has that these tables are not for.
OTHER_TERMS, OTHER_WORDS = r"[^\x02-\xff]", r"[^\x09-\x0d\x1c-\xff]"


def latin_words(texts: list[str], table: bytes):
    """The words of texts that are in Latin-1 without the character 0, by a table: an Arrow array of their bytes, and how many are each
    text's. Character 1 is a word without letters."""
    import numpy as np
    import pyarrow as pa

    a = np.frombuffer("\0".join(["", *texts, ""]).encode("latin-1").translate(table), np.uint8)
    kept = a > 32
    turns = np.diff(kept.view(np.int8))  # no word is at either end
    begins = np.flatnonzero(turns == 1) + 1
    long = np.flatnonzero(turns == -1) + 1 - begins
    if len(gaps := np.flatnonzero(a == 1)):
        at = np.searchsorted(begins, gaps)
        begins, long = np.insert(begins, at, gaps), np.insert(long, at, 0)
    sizes = np.diff(np.searchsorted(begins, np.flatnonzero(a == 0)))
    ends = np.concatenate(([0], np.cumsum(long))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(a[kept])]), sizes


def phrases(query: str) -> list[list[str]]:
    """The phrases that must all occur: each white-space part of the query, as terms; parts without terms are ignored."""
    found = []
    for part in query.replace('"', " ").split():
        bare = re.sub(_MARKS, "", part.lower().translate(dict(zip(map(ord, _MARKED), _BARE, strict=True))))
        words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in bare).split()
        if words:
            found.append(words)
    return found


def postings(docs: DataFrame, id_col: str, text_col: str, file_col: str | None = None) -> DataFrame:
    """term, id, tf, positions; and the document's length on each row. With file_col, terms of both columns: the text's
    places begin one after the file name's end, so that no phrase crosses."""
    t = docs.select(F.col(id_col).alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("w"), _of_file(file_col).alias("n"))
    t = exploded(t, F.concat("n", F.array(F.lit("")), "w"), "id", (F.size("n") + F.size("w")).alias("dl"), F.size("n").alias("of"), at="at", each="term")
    rows = t.filter("term <> ''").withColumn("at", F.when(F.col("of") > 0, F.col("at")).otherwise(F.col("at") - 1))
    return rows.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("positions"))


def _of_file(file_col: str | None) -> Column:
    return terms(F.coalesce(F.col(file_col), F.lit(""))) if file_col else F.array().cast("array<string>")


def lengths(docs: DataFrame, id_col: str, text_col: str, file_col: str | None = None) -> DataFrame:
    """One row: the number of documents and their mean length in terms (of both columns, with file_col)."""
    size = F.size(terms(F.coalesce(F.col(text_col), F.lit("")))) + F.size(_of_file(file_col))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(size).alias("avgdl"))


def searched(docs: DataFrame, id_col: str, text_col: str, query: str, file_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What postings() and lengths() would give bm25() for this query, from one pass over the documents without a shuffle: of
    each row its length and the places of the query's terms alone are kept."""
    every = sorted({w for p in phrases(query) for w in p})
    words = let(F.struct(_of_file(file_col).alias("n"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("w")), lambda t: F.struct(
        (F.size(t["n"]) + F.size(t["w"])).alias("dl"),
        F.filter(F.transform(F.when(F.size(t["n"]) > 0, F.concat(t["n"], F.array(F.lit("")), t["w"])).otherwise(t["w"]), lambda x, i: F.when(x.isin(every), F.struct(x.alias("term"), i.alias("at")))), lambda x: x.isNotNull()).alias("found"),
    ))
    rows = stored(docs.select(F.col(id_col).alias("id"), words.alias("x")).select("id", "x.dl", "x.found"))
    places = lambda w: F.transform(F.filter("found", lambda x: x["term"] == w), lambda x: x["at"])
    index = [rows.select(F.lit(w).alias("term"), "id", "dl", places(w).alias("positions")).filter(F.size("positions") > 0) for w in every]
    none = rows.filter("false").select(F.lit("").alias("term"), "id", "dl", F.array().cast("array<int>").alias("positions"))
    index = reduce(DataFrame.unionByName, index, none).withColumn("tf", F.size("positions").cast("long"))
    return index, rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25(index: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """id and score (more negative: better) of the documents that hold every phrase of the query."""
    wanted = phrases(query)
    spark = index.sparkSession
    if not wanted:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    every = sorted({w for p in wanted for w in p})
    rows = index.filter(F.col("term").isin(every))
    hits = None
    for k, p in enumerate(wanted):
        if len(p) == 1:
            one = rows.filter(F.col("term") == p[0]).select("id", "dl", "tf")
        else:  # the places at which each word of the phrase is in its turn
            back = lambda n: F.transform("positions", lambda x: x - n)
            at = [rows.filter(F.col("term") == w).select("id", "dl", back(i).alias(f"p{i}")) for i, w in enumerate(p)]
            met = at[0]
            for other in at[1:]:
                met = met.join(other.drop("dl"), "id")
            both = F.col("p0")
            for i in range(1, len(p)):
                both = F.array_intersect(both, F.col(f"p{i}"))
            one = met.select("id", "dl", F.size(both).cast("long").alias("tf")).filter("tf > 0")
        one = one.withColumn("k", F.lit(k))
        hits = one if hits is None else hits.unionByName(one)
    hits = stored(hits)
    df_ = hits.groupBy("k").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df_), "k").join(F.broadcast(stats))  # a row for each phrase, and one
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("id").agg(F.count("*").alias("m"), (-F.sum(part)).alias("score")).filter(F.col("m") == len(wanted)).select("id", "score")


def top(scored: DataFrame, k: int, best_first: Column, most: int = 100) -> DataFrame:
    """The k best rows (1 to `most`) with their rank; ties by id."""
    k = max(1, min(most, k))
    return scored.orderBy(best_first, "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(best_first, "id")))


def _few(batch, bytes_: bool = False):
    """A batch (w: arrays of words) in slices of EMBED_ROWS rows and EMBED_WORDS words at the most, or a row that has more: what a task
    holds does not grow with the batch. With `bytes_`, by the EMBED_BYTES of its texts (raw) in place of words."""
    import numpy as np
    import pyarrow.compute as pc

    ends, most = ([0, *np.cumsum(pc.binary_length(batch.column("raw")).to_numpy(), dtype=np.int64).tolist()], EMBED_BYTES) if bytes_ else (batch.column("w").offsets.to_pylist(), EMBED_WORDS)
    at = 0
    while at < len(batch):
        n = min(EMBED_ROWS, bisect_right(ends, ends[at] + most) - 1 - at)
        yield batch.slice(at, max(1, n))
        at += max(1, n)


def dense_embedding(docs: DataFrame, id_col: str, text_col: str, dims: int = 256) -> DataFrame:
    """id, v: what hash_embedding() gives, as one array a row; zeros for a text without words. No shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.when(text.rlike(OTHER_WORDS), F.array_remove(F.split(F.lower(text), WS + "+"), ""))  # of texts not in Latin-1

    def embed(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        def counts(names, codes, rows, n):
            """For each row what its words (by codes; names: their bytes) add at their places."""
            if not len(codes):
                return 0.0
            digests = np.frombuffer(b"".join([hashlib.md5(w, usedforsecurity=False).digest() for w in names]), np.uint8).reshape(-1, 16)
            places, signs = digests[:, :4].copy().view("<u4").ravel() % dims, (digests[:, 4] & 1) * 2.0 - 1.0
            return np.bincount(rows * dims + places[codes], weights=signs[codes], minlength=n * dims).reshape(n, dims)

        for batch in (part for whole in batches for part in _few(whole, bytes_=True)):
            n, hard = len(batch), batch.column("w")
            other = hard.is_valid().to_numpy(zero_copy_only=False)
            flat, sizes = latin_words(["" if o else t for t, o in zip(batch.column("raw").to_pylist(), other, strict=True)], LATIN_WORDS)
            flat = flat.dictionary_encode()
            m = np.zeros((n, dims)) + counts([w if w.isascii() else w.decode("latin-1").encode() for w in flat.dictionary.to_pylist()], flat.indices.to_numpy(), np.repeat(np.arange(n), sizes), n)
            if other.any():
                for part in _few(pa.RecordBatch.from_arrays([hard.filter(pa.array(other)), pa.array(np.flatnonzero(other))], names=["w", "at"])):
                    lists = part.column("w")
                    each = lists.flatten().dictionary_encode()
                    rows = np.repeat(part.column("at").to_numpy(), np.diff(lists.offsets.to_numpy()))
                    m += counts([w.encode() for w in each.dictionary.to_pylist()], each.indices.to_numpy(), rows, n)
            norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
            values = pa.array((m / np.where(norms > 0, norms, 1)).ravel())
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dims, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column("id"), v], names=["id", "v"])

    return docs.select(F.col(id_col).alias("id"), text.alias("raw"), words.alias("w")).mapInArrow(embed, f"id {id_type}, v array<double>")


def hash_embedding(docs: DataFrame, id_col: str, text_col: str, dims: int = 256) -> DataFrame:
    """id, dim, value: each lower-case word adds or takes one at a place that its MD5 gives; rows of a unit length, zeros left out."""
    return exploded(dense_embedding(docs, id_col, text_col, dims), F.col("v"), "id", at="dim", each="value").filter("value <> 0")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def vector_search(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k nearest by cosine, exactly: one pass that keeps k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), q), 6).alias("score"))
    return top(scored, k, F.col("score").desc())


def unit(column):
    """Vectors (an Arrow column of lists) as rows of length 1; null ones and those of length zero as zeros."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "chunks") else column
    sizes = np.diff(flat.offsets.to_numpy())
    if len(flat) and not flat.null_count and not flat.flatten().null_count and (sizes == sizes[0]).all():
        m = flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), sizes[0])
        norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(norms > 0, norms, 1)
    lists = column.to_pylist()
    width = max((len(x) for x in lists if x), default=0)
    m = np.array([x or [0.0] * width for x in lists], np.float64).reshape(len(lists), width)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > 0, norms, 1)


def nearest(k: int):
    """Of a block of rows (id, v) and one of queries (id, v, h): the k best rows of each query."""

    def nearest(left, right):
        import numpy as np
        import pyarrow as pa

        left = left.combine_chunks().sort_by([("id", "ascending")])
        out = {"query": [], "h": [], "id": [], "score": []}
        if len(left) and len(right):
            a, b, ids = unit(left.column("v")), unit(right.column("v")), left.column("id").to_pylist()
            asked_ids, hashes = right.column("id").to_pylist(), right.column("h").to_pylist()
            m = min(k, len(ids))
            for at in range(0, len(asked_ids), 256):
                part = b[at : at + 256]
                width = a.shape[1] if part.shape[1] == a.shape[1] else 0
                scores = np.round(part[:, :width] @ a[:, :width].T, 6) + 0.0
                least = np.partition(scores, len(ids) - m, axis=1)[:, len(ids) - m]
                for q, (row, low) in enumerate(zip(scores, least, strict=True)):
                    found = np.flatnonzero(row >= low)
                    found = found[np.argsort(-row[found], kind="stable")[:m]]  # rows are in the order of ids
                    out["query"] += [asked_ids[at + q]] * m
                    out["h"] += [hashes[at + q]] * m
                    out["id"] += [ids[x] for x in found]
                    out["score"] += row[found].tolist()
        of_id = left.schema.field("id").type
        return pa.table({"query": pa.array(out["query"], of_id), "h": pa.array(out["h"], pa.int64()), "id": pa.array(out["id"], of_id), "score": pa.array(out["score"], pa.float64())})

    return nearest


def parquet_files(folder: str):
    """A folder's Parquet files as pyarrow opens them, in the order of their names."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if folder.startswith("file:"):
        system, path = fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    else:
        system, path = (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
    for f in sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")):
        with system.open_input_file(f) as opened:
            yield pq.ParquetFile(opened)


def _beside(folder: str, k: int):
    """Of a task's rows (id, v) in order, the k best for each query in the folder (id, v, h). Queries are read again for each block of
    rows, in batches; what is kept are the k best of each so far."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        count = sum(f.metadata.num_rows for f in parquet_files(folder))
        best, where, ids, first = np.full((count, k), -np.inf), np.full((count, k), -1), [], 0

        def block(rows):
            """Scores are told roughly in single precision; those that may be among a query's k best are then worked out in double."""
            a, at = unit(rows.column("v")), 0
            rough, n = a.astype(np.float32), len(a)
            error = (a.shape[1] + 8) * 2.0**-24 + 1e-6  # of a rough product of vectors of length 1, and of six places
            for f in parquet_files(folder):
                for asked in f.iter_batches(256, columns=["v"]):
                    b = unit(asked.column("v"))
                    width = a.shape[1] if b.shape[1] == a.shape[1] else 0
                    scores = b[:, :width].astype(np.float32) @ rough[:, :width].T
                    least = best[at : at + len(b), -1] - error
                    if n > k and (least == -np.inf).any():
                        least = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k] - 2 * error)
                    q_of, row_of = np.divmod(np.flatnonzero(scores >= (least - 1e-6).astype(np.float32)[:, None]), max(1, n))
                    ends = np.searchsorted(q_of, np.arange(len(b) + 1))
                    for q in np.flatnonzero(np.diff(ends)):
                        kept, found = at + q, row_of[ends[q] : ends[q + 1]]
                        row = np.round(a[found, :width] @ b[q, :width], 6) + 0.0
                        better = row > best[kept, -1]  # a later row that ties with the last comes after it
                        found, row = found[better], row[better]
                        if len(found) > k:
                            most = row >= np.partition(row, len(found) - k)[len(found) - k]
                            found, row = found[most], row[most]
                        both, places = np.concatenate((best[kept], row)), np.concatenate((where[kept], first + found))
                        order = np.argsort(-both, kind="stable")[:k]
                        best[kept], where[kept] = both[order], places[order]
                    at += len(b)

        held = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= HELD_ROWS:
                block(rows := pa.Table.from_batches(held).combine_chunks())
                ids.append(rows.column("id"))
                held, first = [], first + len(rows)
        if held and sum(map(len, held)):
            block(rows := pa.Table.from_batches(held).combine_chunks())
            ids.append(rows.column("id"))
        if not ids:
            return
        ids, at = pa.chunked_array([c for x in ids for c in x.chunks]), 0
        for f in parquet_files(folder):
            for asked in f.iter_batches(4096, columns=["id", "h"]):
                places, scores = where[at : at + len(asked)], best[at : at + len(asked)]
                q, n = np.nonzero(places >= 0)
                of = ids.take(pa.array(places[q, n])).combine_chunks()
                of = of if isinstance(of, pa.Array) else pa.concat_arrays(of.chunks)
                yield pa.RecordBatch.from_arrays([asked.column("id").take(pa.array(q)), asked.column("h").take(pa.array(q)), of, pa.array(scores[q, n])], names=["query", "h", "id", "score"])
                at += len(asked)

    return run


def vector_search_all(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, most: int = 100) -> DataFrame:
    """query, id, score, rank: the k rows (1 to `most`) nearest to each query by cosine, exactly; ties by id.

    The queries are stored in the shared folder and read by each task beside its rows, so neither is copied for the other; a task gives
    its k best of each query, tasks do not grow in number with the input, and these are merged. Queries of one id count apart if their
    vectors differ. Null vectors and those of length zero have the score 0.
    """
    k = max(1, min(most, k))
    of_id, of_query = vectors.schema[id_col].dataType.simpleString(), queries.schema[id_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    folder = scratch(vectors.sparkSession)
    queries.select(F.col(id_col).alias("id"), v.alias("v")).dropDuplicates().withColumn("h", F.xxhash64("v")).write.parquet(folder)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    tasks = max(BLOCKS, 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    rows = rows.coalesce(tasks) if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
    rows = rows.sortWithinPartitions(F.col("id").asc_nulls_last())
    best = rows.mapInArrow(_beside(folder, k), f"query {of_query}, h long, id {of_id}, score double")
    place = F.row_number().over(Window.partitionBy("query", "h").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).drop("h")


def sparse_search(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k nearest of sparse unit vectors (id, dim, value) to one (dim, value)."""
    q = query.select(F.col("dim").alias("qd"), F.col("value").alias("qv"))
    scored = vectors.join(F.broadcast(q), F.col("dim") == F.col("qd")).groupBy("id").agg(F.round(F.sum(F.col("value") * F.col("qv")), 6).alias("score"))
    return top(scored, k, F.col("score").desc())


def fuse(*ranked: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of lists of (id, rank)."""
    rows = None
    for r in ranked:
        part = r.select("id", (1.0 / (FUSION + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return top(rows.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score")), k, F.col("score").desc())


def hybrid(keyword: DataFrame, vectors: DataFrame | None, query: DataFrame | None, k: int) -> DataFrame:
    """The k best of a keyword search (id, score: more negative is better) and a vector search fused; each gives the best
    max(5 k, 50). Without vectors or a query vector: the keyword search alone."""
    pool = max(5 * max(1, min(100, k)), 50)
    lists = [top(keyword, pool, F.col("score"), pool)]
    if vectors is not None and query is not None:
        q = query.select(F.col("dim").alias("qd"), F.col("value").alias("qv"))
        scored = vectors.join(F.broadcast(q), F.col("dim") == F.col("qd")).groupBy("id").agg(F.round(F.sum(F.col("value") * F.col("qv")), 6).alias("score"))  # `dims` rows at most
        lists.append(top(scored, pool, F.col("score").desc(), pool))
    return fuse(*lists, k=k)


def snippet(text: Column, query: str, before: int = 60, after: int = 160) -> Column:
    """The text on one line around the first term of the query, which is in brackets; its beginning where none is found. Terms
    are looked for as they are written, without regard to case."""
    every = sorted({w for p in phrases(query) for w in p}, key=len, reverse=True)
    flat = F.regexp_replace(text, WS + "+", " ")
    if not every:
        return preview(flat, after)
    word = rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(every)})(?![\p{{L}}\p{{N}}])"

    def around(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(word))
        start = F.greatest(F.lit(1), at - before)
        cut = F.substring(t, start, F.lit(before + after))
        marked = F.regexp_replace(cut, word, "[$1]")
        dots = F.concat(F.when(start > 1, "…").otherwise(""), marked, F.when(start + before + after <= F.length(t), "…").otherwise(""))
        return F.when(at > 0, dots).otherwise(preview(t, after))

    return let(flat, around)


def chunk(chunks: DataFrame, chunk_id: str, around: int = 0, id_col: str = "chunk_id", doc_col: str = "doc_id", order_col: str = "idx") -> DataFrame:
    """The chunk of an id, with so many before and after it in its document; no rows for an unknown id."""
    one = chunks.filter(F.col(id_col) == chunk_id).select(F.col(doc_col).alias("__d"), F.col(order_col).alias("__k")).limit(1)
    near = (F.col(doc_col) == F.col("__d")) & F.col(order_col).between(F.col("__k") - around, F.col("__k") + around)
    return chunks.join(F.broadcast(one), near).drop("__d", "__k").orderBy(order_col)


def neighbours(chunks: DataFrame, doc_col: str = "doc_id", order_col: str = "idx") -> DataFrame:
    """Each chunk with the places of those before and after it."""
    w = Window.partitionBy(doc_col).orderBy(order_col)
    return chunks.select(doc_col, order_col, F.lag(order_col).over(w).alias("previous"), F.lead(order_col).over(w).alias("next"))


def assembled(chunks: DataFrame) -> DataFrame:
    """Documents put together from their chunks, in order."""
    parts = F.sort_array(F.collect_list(F.struct("idx", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda c: c["text"]), "\n\n").alias("text"), F.count("*").alias("chunks"))


def listing(manifest: DataFrame, status: str | None = None, most: int = 0) -> DataFrame:
    """Manifest rows, the largest first, of one status if given; at most so many unless 0."""
    rows = manifest.filter(F.col("status") == status) if status else manifest
    rows = rows.orderBy(F.col("token_estimate").desc(), "doc_id")
    return rows.limit(most) if most else rows
