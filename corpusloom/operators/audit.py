"""Audits over chunk rows (doc_id, idx, text, token_estimate, reason, structure): each an aggregate of the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import matching_globs, strip


def statistics(chunks: DataFrame, budget: int) -> DataFrame:
    """One row: chunks, tokens, bytes, smallest, upper median, largest, over budget. The median comes from the counts of
    equal sizes, not from a sort of all chunks."""
    sizes = chunks.groupBy("token_estimate").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    run = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("token_estimate")))  # a row for each distinct size
    total = sizes.agg(F.sum("n").alias("all"))
    run = run.join(F.broadcast(total))
    half = F.floor(F.col("all") / 2)
    return run.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), F.coalesce(F.sum(F.col("n") * F.col("token_estimate")), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.min("token_estimate"), F.lit(0)).alias("smallest"), F.coalesce(F.min(F.when(F.col("upto") > half, F.col("token_estimate"))), F.lit(0)).alias("median"), F.coalesce(F.max("token_estimate"), F.lit(0)).alias("largest"),
        F.coalesce(F.sum(F.when(F.col("token_estimate") > budget, F.col("n")).otherwise(0)), F.lit(0)).alias("over_budget"),
    )


def reasons(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("reason").agg(F.count("*").alias("n"))


def size_histogram(chunks: DataFrame, budget: int) -> DataFrame:
    """Chunks by quarter of the budget (0 to 3), and those above it (4)."""
    part = F.when(F.col("token_estimate") > budget, 4).otherwise(F.least(F.floor(4 * F.col("token_estimate") / budget).cast("int"), F.lit(3)))
    return chunks.groupBy(part.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def size_buckets(chunks: DataFrame, budget: int) -> DataFrame:
    """As size_histogram(), with a row for each of the five buckets, empty ones too."""
    every = chunks.sparkSession.range(5).select(F.col("id").cast("int").alias("bucket"))
    return every.join(size_histogram(chunks, budget), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def per_document(chunks: DataFrame, budget: int) -> DataFrame:
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("token_estimate").alias("tokens"), F.max("token_estimate").alias("largest"),
        F.count_if(F.col("token_estimate") > budget).alias("over_budget"), F.sum(F.size("structure.headings")).alias("headings"), (F.count("*") == 1).alias("single"),
    )


def heading_matches(summary: DataFrame, globs: list[str]) -> DataFrame:
    """heading_summary() with matched_by: the patterns that exclude a heading, in their order."""
    return summary.withColumn("matched_by", matching_globs(F.col("heading"), globs))


def heading_summary(chunks: DataFrame) -> DataFrame:
    """Chunks by their first heading, ignoring case (the first seen is shown): chunks, tokens, documents, share of tokens."""
    h = strip(F.coalesce(F.get("structure.headings", F.lit(0)), F.lit("")))
    rows = chunks.select("doc_id", "idx", "token_estimate", h.alias("h"))
    by = rows.groupBy(F.lower("h").alias("heading_key")).agg(
        F.min_by("h", F.struct("doc_id", "idx")).alias("heading"), F.count("*").alias("chunk_count"), F.sum("token_estimate").alias("token_estimate"), F.count_distinct("doc_id").alias("document_count")
    )
    total = rows.agg(F.sum("token_estimate").alias("__all"))
    return by.join(F.broadcast(total)).withColumn("token_share", F.round(100 * F.col("token_estimate") / F.greatest(F.col("__all"), F.lit(1)), 4)).drop("__all")


def guidance(chunks: DataFrame, budget: int, strategy: str, target: str) -> DataFrame:
    """The codes of the tips that the corpus calls for, with the figures behind them; from one row of counts."""
    tiny = max(30, budget // 10)
    docs = chunks.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("token_estimate") > budget).alias("over"), F.sum(F.size("structure.headings")).alias("heads"), F.count_if(F.col("token_estimate") < tiny).alias("tiny")
    )
    c = docs.agg(F.count("*").alias("docs"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "over", "heads", "tiny")], F.count_if(F.col("n") == 1).alias("single"))
    rules = [
        ("over_budget", F.col("over") > 0, F.col("over")),
        ("heading_rich", F.lit(strategy != "headings") & (F.col("heads") >= 3 * F.col("docs")), F.col("heads")),
        ("tiny_chunks", F.lit(strategy == "headings") & (F.col("tiny") > F.floor(F.col("n") / 4)), F.col("tiny")),
        ("single_chunk_documents", (F.col("single") > F.floor(F.col("docs") / 2)) & (F.col("docs") > 1), F.col("single")),
        ("large_for_retrieval", F.lit(target == "rag" and budget > 1500), F.lit(budget)),
    ]
    tips = F.array(*[F.when(when & (F.col("n") > 0), F.struct(F.lit(code).alias("tip"), figure.cast("long").alias("figure"))) for code, when, figure in rules])
    return c.select(F.explode(F.filter(tips, lambda t: t.isNotNull())).alias("t")).select("t.tip", "t.figure")


def duplicate_names(paths: DataFrame, path_col: str, every: bool = False) -> DataFrame:
    """File names (lower case) that two or more paths share, with their number and the first and last path, or with the sorted
    list of all (which is as long as a name's paths are many)."""
    name = F.lower(F.regexp_extract(path_col, r"([^/]*)\z", 1))
    if every:
        lists = paths.groupBy(name.alias("name")).agg(F.sort_array(F.collect_set(path_col)).alias("every_path"))
        return lists.select("name", F.size("every_path").cast("long").alias("paths"), "every_path").filter("paths >= 2")
    return paths.groupBy(name.alias("name")).agg(F.count_distinct(path_col).alias("paths"), F.min(path_col).alias("first_path"), F.max(path_col).alias("last_path")).filter("paths >= 2")


def type_counts(files: DataFrame, type_col: str, kinds: list[str]) -> DataFrame:
    """The number of files of each kind, in the kinds' order, none included."""
    spark = files.sparkSession
    order = spark.createDataFrame([(k, i) for i, k in enumerate(kinds)], f"{type_col} string, place int")
    counts = files.groupBy(type_col).agg(F.count("*").alias("n"))
    return order.join(counts, type_col, "left").select(type_col, "place", F.coalesce("n", F.lit(0)).alias("n"))


def tier_counts(docs: DataFrame, order_col: str, category_col: str = "category") -> DataFrame:
    """Documents by category, in the order in which the categories are first met."""
    return docs.groupBy(category_col).agg(F.count("*").alias("documents"), F.min(order_col).alias("first_seen"))


def folder_listing(spark, folder: str, pattern: str = "*") -> DataFrame:
    """path, size and modification time of the files that an export wrote; names alone are read, not contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), "modificationTime")
