"""Exact dedup: equal texts found by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, hot_join, stored

SALTS = 16


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """A row per digest and text: digest, norm (the text), keep_id, group_size.

    Spark's partial aggregation dedups each input partition first (grouped by digest and whole text); then the rows of a
    digest and salt meet, then the winners of all salts. Each stage groups by the text itself, so texts that only share
    a digest stay apart. A row of a group is sent once per input partition at most, so no task holds a hot group.
    """
    t = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    t = t.withColumn("digest", F.unhex(F.sha2("norm", 256))).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    local = t.groupBy("digest", "salt", "norm").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    merged = local.groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return merged


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with the one that stays of its equals (the largest id), their number, and its text's SHA-256.

    Texts are equal when they are the same after lower-casing A-Z. Null counts as empty; empty texts equal one another.
    Exactly one row of each group is kept: repeated ids are a row each, all counted, and of rows that tie for the largest id
    one (any) is kept. Null is the smallest id. `carry`: further columns of docs to return; no other column is read.
    The digests of rows are joined to their groups; groups of very many rows by broadcast (see hot_join).
    """
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    # A number for each row, fixed by being written: it decides between rows of one id.
    rows = stored(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0), *carry).alias("carry")))
    found = groups(docs, id_col, text_col, salts)
    sizes = found.groupBy("digest").agg(F.count("*").alias("variants"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    last = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("last"))
    by_digest = stored(sizes.join(last, "digest"))
    out = ["id", "keep_id", "group_size", "digest", "kept", "carry"]
    joined = hot_join(rows, by_digest, "digest", "group_size")
    done = joined.filter("variants = 1").withColumn("kept", F.col("row") == F.col("last.row")).select(*out)
    clashes = by_digest.filter("variants > 1").select("digest")
    if not clashes.isEmpty():  # texts that differ under one digest: told apart by the texts themselves
        texts = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"), F.struct(F.lit(0), *carry).alias("carry")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
        apart = texts.join(found.join(clashes, "digest", "left_semi"), ["digest", "norm"])
        first = F.row_number().over(Window.partitionBy("digest", "norm", "id").orderBy("id")) == 1
        done = done.unionByName(apart.withColumn("kept", first & F.col("id").eqNullSafe(F.col("keep_id"))).select(*out))
    return done.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"), *[F.col("carry")[c].alias(c) for c in carry])
