"""Searches by many queries at once, exactly: keywords from the stored index, vectors by blocks, and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import exploded
from corpusloom.operators import index
from corpusloom.operators.bundling import stored
from corpusloom.operators.retrieval import FUSION, LATIN_TERMS, OTHER_TERMS, dense_embedding, latin_words, terms, vector_search_all


def _counted(batches):
    """Of rows (query, raw; w: words, where terms() alone can tell them) each one's different terms and how often it has them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        hard = batch.column("w")
        other = hard.is_valid().to_numpy(zero_copy_only=False)
        words, sizes = latin_words(["" if o else t for t, o in zip(batch.column("raw").to_pylist(), other, strict=True)], LATIN_TERMS)
        for every, of, latin in ((words, sizes, True), (hard.flatten(), pc.list_value_length(hard).fill_null(0).to_numpy(), False)):
            every = every.dictionary_encode()
            pairs, n = np.unique((np.repeat(np.arange(len(of)), of) << 32) + every.indices.to_numpy(), return_counts=True)
            names = every.dictionary
            if latin:
                names = pa.array([w.decode("latin-1") for w in names.to_pylist()], pa.string())
            for at in range(0, len(pairs), 100_000):
                part = pairs[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(part >> 32)), names.take(pa.array(part & 0xFFFFFFFF)), pa.array(n[at : at + 100_000])], names=["query", "term", "n"])


def frequent_terms(docs: DataFrame, id_col: str, text_col: str, n: int, least: int) -> DataFrame:
    """query, terms: of each document the n terms of at least so many letters that it has most often (ties: the first by code
    point). No row for a document without any."""
    text, kind = F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("query"), text.alias("raw"), F.when(text.rlike(OTHER_TERMS), terms(text)).alias("w"))
    rows = rows.mapInArrow(_counted, f"query {kind}, term string, n long").filter(F.length("term") >= least)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("n").desc(), "term"))
    best = rows.groupBy("query", "term").agg(F.sum("n").alias("n")).withColumn("k", place).filter(F.col("k") <= n)
    return best.groupBy("query").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def _ranked(scored: DataFrame, k: int, best_first: Column) -> DataFrame:
    """The k best of each query with their rank; Spark keeps k a query in each task before it shuffles."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(best_first, F.col("id").asc_nulls_last()))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def as_parts(queries: DataFrame) -> DataFrame:
    """query and parts, as index.search() takes them, of query and terms (array; nulls are left out)."""
    return queries.select("query", F.transform(F.filter("terms", lambda t: t.isNotNull()), lambda t: F.array(t)).alias("parts"))


def frequent_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query and parts: of each document the two neighbouring terms it has most often (ties: the first by code point), as a phrase."""
    w = terms(F.coalesce(F.col(text_col), F.lit("")))
    rows = exploded(docs.select(F.col(id_col).alias("query"), w.alias("w")), F.arrays_zip(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - 1)).alias("a"), F.slice("w", 2, F.size("w")).alias("b")), "query", each="p")
    counts = rows.groupBy("query", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("n").desc(), "a", "b"))
    return counts.withColumn("k", place).filter("k = 1").select("query", F.array(F.array("a", "b")).alias("parts"))


def bm25_all(docs: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str, most: int = 100, file_col: str | None = None) -> DataFrame:
    """query, id, score, rank: for each query the k documents (1 to `most`) that hold all of its terms with the best BM25
    (more negative: better; rounded to nine places), ties by id.

    queries: query, terms (array of strings as terms() gives them; repeats count once, rows of one query are put together,
    those without a term find nothing). Null texts have no terms. Documents of one id are documents each. An index is
    built for this search; index.build() makes one for many.
    """
    asked = stored(as_parts(queries))
    return index.search(index.build(docs, id_col, text_col, file_col, placed=False, asked=asked), asked, k, most)


def hybrid_all(docs: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """query, id, score, rank: for each query the k documents (1 to 100) that a keyword and a vector search find best together,
    by reciprocal ranks; each search gives its best max(5 k, 50).

    queries: query (unique), terms, text (what is embedded; where null: the keyword search alone).
    """
    k = max(1, min(100, k))
    pool = max(5 * k, 50)
    queries = stored(queries)
    keyword = bm25_all(docs, queries.select("query", "terms"), pool, id_col, text_col, pool)
    vectors = stored(dense_embedding(docs, id_col, text_col))
    asked = stored(dense_embedding(queries.filter("text is not null"), "query", "text"))
    near = vector_search_all(vectors, asked, pool, "id", "v", pool)
    both = keyword.select("query", "id", "rank").unionByName(near.select("query", "id", "rank"))
    fused = both.groupBy("query", "id").agg(F.round(F.sum(1.0 / (FUSION + F.col("rank"))), 9).alias("score"))
    return _ranked(fused, k, F.col("score").desc())
