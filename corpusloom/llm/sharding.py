"""Sharding: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import hot_join, rank_in, stored, unit, with_copies


def interleave(docs: DataFrame, shards: int = 8, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A shard (0 to shards-1) and a gapless slot for every document; counts of shards differ by one at most.

    Rows of each source are shuffled by a seeded hash and ranked; row r of a source of n has the fractional rank
    (r + 0.5) / n. All rows are sorted by it and cut into equal runs, so each shard holds the same share of each source,
    within a row. Ranks come from counts of hash ranges (see rank_in), so a hot source is no hot task.
    Null source: a source of its own. Null text: no bytes. Repeated rows all get slots; ties go by id, then crc.
    Same rows and seed: same shards (rows that are wholly equal may swap). Empty input: no rows.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    # An array tells a null source from every text, and can be a key.
    rows = docs.select(
        F.col(id_col).alias("id"), F.array(F.col(source_col).cast("string")).alias("s"),
        (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
    )
    rows = stored(with_copies(rows, ["id", "text_crc32"]))  # rows that are equal are shuffled as any others
    key = F.when(F.col("copy") == 0, unit(seed, F.col("id"), F.col("text_crc32"))).otherwise(unit(seed, F.col("id"), F.col("text_crc32"), F.col("copy")))
    ranked = rank_in(rows, ["s"], key, ["id", "text_crc32", "copy"], "r")
    sizes = stored(rows.groupBy("s").agg(F.count("*").alias("n")))
    ranked = stored(hot_join(ranked, sizes, "s", "n").withColumn("f", (F.col("r") + 0.5) / F.col("n")))
    total = ranked.count()
    placed = rank_in(ranked.withColumn("all", F.lit(0)), ["all"], F.col("f"), ["s", "r"], "g")
    # Shard k takes the places from ceil(k * total / shards) on.
    shard = F.expr(f"(g * {shards}) div {max(total, 1)}").cast("int")
    start = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("g") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("f").alias("fractional_rank"),
    )
