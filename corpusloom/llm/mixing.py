"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, stored, unit, with_copies

#: Key ranges: at least so many for each doubling of the key, more where one would hold over PER_PART rows.
STEPS, PER_PART = 256, 200_000


def _numbered(sizes: DataFrame) -> DataFrame:
    """The sources with their place by code point, null last, from 0: ranges are numbered and their counts summed."""
    by = ["nameless", "name"]
    cut = sizes.withColumn("nameless", F.col("s")[0].isNull()).withColumn("name", F.col("s")[0]).repartitionByRange(*by)
    cut = stored(cut.withColumn("range", F.spark_partition_id()))
    counts = cut.groupBy("range").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1
    ranges = counts.select("range", before.alias("before"))  # a row for each range
    return cut.withColumn("nth", nth).join(F.broadcast(ranges), "range").select("s", "n", (F.col("before") + F.col("nth")).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Columns s, source_size, target and epochs of sources (s: array of the name, n: size): `share` of all sizes is shared by
    weight (repeating, by code point, null last), none above `most` times its size; what is cut is shared anew by weight
    among the rest until none is above. Sums alone reach the driver, so any number of sources will do."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    of = stored(_numbered(sizes).withColumn("w", weight).withColumn("cap", F.col("n") * float(most)))
    total = of.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    budget = share * (total["n"] or 0)
    left, open_, capped = budget, total["w"] or 0.0, 0
    while open_:
        above = F.lit(left) * F.col("w") / F.lit(open_) > F.col("cap")
        x = of.agg(F.sum(F.when(above, F.col("cap"))).alias("cut"), F.sum(F.when(~above, F.col("w"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        if x["n"] == capped:
            break
        left, open_, capped = budget - x["cut"], x["w"] or 0.0, x["n"]
    fair = F.lit(left) * F.col("w") / F.lit(open_) if open_ else F.col("cap")
    target = F.least(fair, F.col("cap"))
    epochs = F.when(F.col("n") > 0, F.floor(target / F.col("n"))).otherwise(F.lit(0)).cast("long")
    return of.select("s", F.col("n").alias("source_size"), target.alias("target"), epochs.alias("epochs"))


def quality_weight(text: Column, size: Column) -> Column:
    """0.1 to 1: less for texts with many characters that are neither letters (capitals count as odd), white space nor plain
    punctuation. An empty text has 0.1."""
    length = F.length(text)
    odd = F.length(F.regexp_replace(text, r"""[\p{Ll}\p{Lo}\p{Lm}\p{Lt}\p{M}\p{N}\s.,;:?'"()-]+""", ""))
    return F.when((length > 0) & (size > 0), 0.1 + 0.9 * F.greatest(F.lit(0.0), 1 - 4 * odd / length)).otherwise(F.lit(0.1))


def mix(
    docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = (), weight_col: str | None = None
) -> DataFrame:
    """Every document with how many of its words the mix takes, so that each source's taken words come near its target.

    Complete epochs come first: each document of a source is taken floor(target / source size) times. For the rest of
    the target documents are taken once more in the order of exponential keys -ln(u) / weight (u: seeded hash of the id),
    while the words before a document fall short of the rest by at least half its size. Sums over a source are made of
    sums over key ranges (equal steps of the key's logarithm, so that none holds over a thousandth of a source at any
    weights), joined back by range: no task holds a source.
    `weight_col`: a column of quality weights (a classifier's scores, say) to be used in place of quality_weight(); null, and what is not
    above 0: 0.1, so that no document is shut out. Null text: no words. Null source: a source of its own, last. Null id: kept. Repeated rows: each counts. Ties go by id,
    then by text hash; wholly equal rows have keys by their number. Empty input: no rows. `carry`: further columns to return; no others are read.
    """
    size = F.regexp_count(F.col("t"), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.array(F.col(source_col).cast("string")).alias("s"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.struct(F.lit(0), *carry).alias("carry"), *([F.col(weight_col).cast("double").alias("w")] if weight_col else []))
    weight = quality_weight(F.col("t"), F.col("size")) if weight_col is None else F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(0.1))
    rows = rows.withColumn("size", size).withColumn("weight", weight).withColumn("h", F.xxhash64("t")).drop("t", "w")
    u = F.when(F.col("copy") == 0, unit(seed, F.col("id"), F.col("h"))).otherwise(unit(seed, F.col("id"), F.col("h"), F.col("copy")))
    rows = stored(with_copies(rows, ["id", "h"]).withColumn("key", -F.log(u) / F.col("weight")))  # equal rows have keys of their own
    steps = max(STEPS, rows.count() // (4 * PER_PART))  # a step holds a quarter of a source's rows, divided by steps, at most
    rows = rows.withColumn("part", F.floor(F.log2("key") * steps).cast("long"))
    plan = targets(rows.groupBy("s").agg(F.sum("size").alias("n")), weights, share, most)
    parts = rows.groupBy("s", "part").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("s", "part", F.coalesce(before, F.lit(0)).alias("start")).join(plan, "s")
    run = F.sum("size").over(Window.partitionBy("s", "part").orderBy("key", "id", "h", "copy").rowsBetween(Window.unboundedPreceding, 0))
    taken = rows.withColumn("upto", run).join(parts, ["s", "part"])
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = F.when(F.col("start") + F.col("upto") - F.col("size") / 2 <= rest, F.col("size")).otherwise(F.lit(0))
    copies = F.col("epochs") + (extra > 0).cast("long")
    return taken.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"),
        copies.alias("copies"), F.col("weight").alias("quality_weight"), *[F.col("carry")[c].alias(c) for c in carry],
    )
