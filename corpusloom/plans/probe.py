"""Bundles with canary phrases, to find how much of a file or workspace a reader takes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import canary_code
from corpusloom.sources.connect import registered

FILLER = "The reviewer recorded the scope of the work and the office kept the papers for the next review of the case. "
TOKENS = 110_000
DEPTHS = (10, 30, 50, 70, 90, 110, 150)


def bundles(spark: SparkSession, n: int = 8, tokens: int = TOKENS) -> DataFrame:
    """place, code, location, text: a file of about `tokens` tokens for each place with a canary in its middle."""
    half = F.expr(f"rtrim(repeat('{FILLER}', {max(1, tokens // 2 // ((len(FILLER) + 3) // 4))}))")
    rows = spark.range(1, n + 1).withColumnRenamed("id", "place").withColumn("code", canary_code(F.col("place")))
    rows = rows.withColumn("location", F.concat(F.lit("bundle "), F.col("place").cast("string")))
    line = F.concat(F.lit("CANARY "), "code", F.lit(": the pass phrase for "), "location", F.lit(' is "'), "code", F.lit('-CONFIRMED".'))
    return rows.withColumn("text", F.concat_ws("\n\n", F.concat(F.lit("# Probe Bundle "), F.col("place").cast("string")), half, line, half))


def depths(spark: SparkSession) -> DataFrame:
    """percent and code of the canaries at growing depths of one file."""
    rows = spark.createDataFrame([(x,) for x in DEPTHS], "percent int")
    return rows.withColumn("code", canary_code(F.col("percent") + 1000))


def key(rows: DataFrame) -> DataFrame:
    """The answers that a reader who has seen a file must give: place, location, code."""
    return rows.select("place", "location", F.concat("code", F.lit("-CONFIRMED")).alias("answer"))


def depth_file(spark: SparkSession, tokens: int = TOKENS) -> DataFrame:
    """percent, code and text of one long file in the order of its canaries: before each as much filler as brings it to its depth, in
    percent of `tokens`."""
    words = max(1, (len(FILLER) + 3) // 4)
    rows = depths(spark).withColumn("before", F.coalesce(F.lag("percent").over(Window.orderBy("percent")), F.lit(0)))  # seven rows
    filler = F.expr(f"rtrim(repeat('{FILLER}', cast(greatest(1, (percent - before) * {tokens} / 100 / {words}) as int)))")
    line = F.concat(F.lit("CANARY "), "code", F.lit(": the pass phrase for depth "), F.col("percent").cast("string"), F.lit(' percent is "'), "code", F.lit('-CONFIRMED".'))
    return rows.select("percent", "code", F.concat_ws("\n\n", filler, line).alias("text"))


def write(spark: SparkSession, folder: str, n: int = 8, tokens: int = TOKENS) -> None:
    """The files of bundles(), a folder for each place, their key as CSV, and the file of growing depths with its key."""
    rows = bundles(spark, n, tokens)
    rows.select("place", F.col("text").alias("value")).write.mode("overwrite").partitionBy("place").text(f"{folder}/probe")
    key(rows).orderBy("place").write.mode("overwrite").option("header", True).csv(f"{folder}/probe_key")
    deep = depth_file(registered(spark), tokens).orderBy("percent")
    deep.select(F.col("text").alias("value")).write.format("corpus_file").options(head="# Probe Depth File\n\n", between="\n\n", tail="\n").mode("overwrite").save(f"{folder}/probe_depth.md")
    deep.select("percent", F.concat("code", F.lit("-CONFIRMED")).alias("answer")).write.mode("overwrite").option("header", True).csv(f"{folder}/probe_depth_key")
