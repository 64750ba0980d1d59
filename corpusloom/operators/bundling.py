"""Documents packed in order into bundles within a token budget (next fit)."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import CATEGORIES, bundle_name, estimate_tokens, exploded, identity_header, strip
from corpusloom.operators.chunking import pack_sections


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared checkpoint folder (a temporary one where none is set and there is one machine only)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
    _written.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame) -> DataFrame:
    """The rows written to a scratch() folder and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The folders that stored() has written and that are still there.
_written: list[str] = []


def counted(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, int]]:
    """stored(), with aggregates of the rows that are taken as they are written (0 where there are none): no second pass."""
    seen = Observation()
    out = stored(df.observe(seen, *[F.coalesce(v, F.lit(0)).alias(k) for k, v in figures.items()]))
    found = seen.get
    return out, {k: found.get(k, 0) for k in figures}  # where Spark finds that there are no rows, it counts none


def cleared(spark: SparkSession) -> None:
    """Deletes all that stored() has written in this program: for when results have been written elsewhere, as they are read from it."""
    while _written:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _next(sums: np.ndarray, budget: int, tiers: np.ndarray) -> np.ndarray:
    """For each document the first one after it that a bundle beginning there no longer holds. sums: prefix sums from 0; tiers: equal
    ones stand together, and a bundle ends with its own."""
    n = len(sums) - 1
    edges = np.append(np.flatnonzero(tiers[1:] != tiers[:-1]) + 1, n)
    ends = edges[np.searchsorted(edges, np.arange(n), side="right")]
    return np.minimum(ends, np.maximum(np.arange(n) + 1, np.searchsorted(sums, sums[:-1] + budget, side="right") - 1))


#: About how many documents a range of a fold holds.
RANGE = 200_000


def _ends(after: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document at which a bundle begins: what is open at the end of the range, and how many bundles began. The
    chain of beginnings is followed by doubling its steps."""
    n = len(after)
    at, began = np.append(after, n), np.append(np.ones(n, np.int64), 0)
    last = np.append(np.arange(n), n)  # the last beginning on the way
    while (at < n).any():
        last = np.where(at < n, last[np.minimum(at, n)], last)
        began, at = began + began[at], at[at]
    return np.append(sums[n] - sums[:n], 0)[last], began


def _joining(sums: np.ndarray, first: int, open_: int | None, budget: int) -> int:
    """How many of a range's documents, `first` at the most, join the bundle that comes in with so many tokens (None: none does)."""
    return 0 if open_ is None else max(0, min(first, int(np.searchsorted(sums, budget - open_, side="right")) - 1))


def greedy(docs: DataFrame, budget: int, order: list[str], tokens_col: str = "token_estimate", tiers: bool = False) -> DataFrame:
    """docs with bundle (from 1): documents in order join the open bundle while it fits; one above the budget stands alone. With
    `tiers`, a bundle also ends where the first column of the order changes.

    Exact at any size: rows are range-partitioned in order, and each range says, for every document at which the bundle that
    comes in may break off, what stays open at its end and how many bundles began (as many entries as a bundle has documents).
    The driver chains these short lists; a second pass numbers the documents of each range. Only keys and tokens take part.
    Documents with equal keys come in any order, each once.
    """
    import pandas as pd

    names = [f"__o{i}" for i in range(len(order))]
    narrow = stored(docs.select(*[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("__t")))
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // RANGE))
    tied = not narrow.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    if tied:  # rows that tie are numbered on both sides, by their tokens
        narrow = narrow.withColumn("__tie", F.row_number().over(Window.partitionBy(*names).orderBy("__t")))
        names.append("__tie")
    ranged = stored(narrow.repartitionByRange(ranges, *names).withColumn("__r", F.spark_partition_id()))

    def tier(pdf: pd.DataFrame) -> np.ndarray:
        return pdf["__o0"].astype(str).to_numpy() if tiers else np.zeros(len(pdf), np.int8)

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names)
        of = tier(pdf)
        sums, first = np.concatenate(([0], np.cumsum(pdf["__t"].to_numpy()))), int((of == of[0]).argmin()) or len(of)
        still, began = _ends(_next(sums, budget, of), sums)
        few = min(first + 1, int(np.searchsorted(sums, budget, side="right")))
        lists = {"sums": [sums[:few].tolist()], "still": [still[:few].tolist()], "began": [began[:few].tolist()]}
        return pd.DataFrame({"r": [int(pdf["__r"].iloc[0])], "n": [len(pdf)], "first": [first], "opens": [str(of[0])], "closes": [str(of[-1])]} | lists)

    entries, still, count, last = {}, None, 0, None
    for x in ranged.groupBy("__r").applyInPandas(summary, "r int, n long, first long, opens string, closes string, sums array<long>, still array<long>, began array<long>").orderBy("r").toLocalIterator():
        still = still if x["opens"] == last else None
        entries[x["r"]] = (still, count)
        at = _joining(x["sums"], x["first"], still, budget)
        if still is not None and at == x["n"]:
            still += x["sums"][at]
        else:
            still, count = x["still"][at], count + x["began"][at]
        last = x["closes"]

    shape = ", ".join(f"{n} {t}" for n, t in ranged.dtypes if n in names) + ", bundle long"

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names)
        sums = np.concatenate(([0], np.cumsum(pdf["__t"].to_numpy())))
        of = tier(pdf)
        came, bundle = entries[int(pdf["__r"].iloc[0])]
        at = _joining(sums, int((of == of[0]).argmin()) or len(of), came, budget)
        begins, after = np.zeros(len(pdf), np.int64), _next(sums, budget, of)
        while at < len(pdf):  # a step for each bundle
            begins[at] = 1
            at = after[at]
        return pdf[names].assign(bundle=bundle + np.cumsum(begins))

    numbered = ranged.groupBy("__r").applyInPandas(number, shape)
    keys = [docs[c].eqNullSafe(numbered[n]) for c, n in zip(order, names, strict=False)]
    if tied:
        left = docs.withColumn("__own", F.row_number().over(Window.partitionBy(*order).orderBy(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)))))
        keys = [left[c].eqNullSafe(numbered[n]) for c, n in zip(order, names, strict=False)] + [left["__own"] == numbered["__tie"]]
        return left.join(numbered, keys).drop("__own", *names)
    return docs.join(numbered, keys).drop(*names)


def split_at_headings(docs: DataFrame, target: int, level: int = 2, digits: int | None = None) -> DataFrame:
    """Documents (doc_id, source_file, source_path, extension, body, notes, token_estimate) with those above the target cut
    into parts at headings: ids _p01, _p02, ..., _p100, notes and counts of their own; others as they are, with part 0. With `digits`, ids have the
    first so many of a part's number, so that several parts may share an id."""
    parts = docs.withColumn("__p", F.when(F.col("token_estimate") > target, pack_sections(strip(F.col("body")), target, level)))
    whole = F.col("__p").isNull() | (F.size("__p") <= 1)
    rows = parts.withColumn("__p", F.when(whole, F.array(F.struct(F.col("body").alias("text"), F.lit("").alias("reason")))).otherwise(F.col("__p")))
    rows = exploded(rows, F.col("__p"), "*", whole.alias("__whole"), F.size("__p").alias("__n")).withColumn("__i", F.col("__i") + 1)
    place = F.col("__i").cast("string")
    place = F.when(F.length(place) < 2, F.lpad(place, 2, "0")).otherwise(place if digits is None else F.substring(place, 1, digits))
    doc_id = F.when(F.col("__whole"), F.col("doc_id")).otherwise(F.concat("doc_id", F.lit("_p"), place))
    note = F.concat(F.lit("Part "), F.col("__i").cast("string"), F.lit(" of "), F.col("__n").cast("string"), F.lit(" (medium heading split)"))
    rows = rows.withColumn("doc_id", doc_id).withColumn("body", F.col("__c.text")).withColumn("notes", F.when(F.col("__whole"), F.col("notes")).otherwise(F.trim(F.concat(F.trim("notes"), F.lit(" "), note))))
    full = F.concat(identity_header(F.col("doc_id"), F.col("source_file"), F.col("source_path"), F.col("extension")), F.lit("\n"), F.col("body"))
    rows = rows.withColumn("token_estimate", F.when(F.col("__whole"), F.col("token_estimate")).otherwise(estimate_tokens(full)))
    return rows.withColumn("part", F.when(F.col("__whole"), 0).otherwise(F.col("__i"))).select(*docs.columns, "part")


def tiered(docs: DataFrame, budget: int, order: list[str], category_col: str = "category") -> DataFrame:
    """Greedy bundles of each category, in the fixed order of categories, numbered through: one fold over all of them."""
    tier = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col(category_col)).cast("int")
    rows = docs.withColumn("__tier", tier).filter("__tier > 0")
    return greedy(rows, budget, ["__tier", *order], tiers=True).drop("__tier")


def summary(bundled: DataFrame, budget: int, bytes_col: str, widest: int = 11) -> DataFrame:
    """A row per bundle: file name, documents, tokens, bytes, and whether it is above the budget. `widest`: see bundle_name()."""
    per = bundled.groupBy("bundle").agg(F.count("*").alias("doc_count"), F.sum("token_estimate").alias("tokens"), F.sum(bytes_col).alias("bytes"))
    total = per.agg(F.max("bundle").alias("__n"))
    named = per.join(F.broadcast(total))  # one row
    return named.select("bundle", bundle_name(F.col("bundle"), F.col("__n"), widest).alias("name"), "doc_count", "tokens", "bytes", (F.col("tokens") > budget).alias("over_budget"))


def rough_bundles(files: DataFrame, budget: int, order: list[str], size_col: str = "size") -> DataFrame:
    """One row: how many bundles files of these sizes would fill, at four bytes a token."""
    rough = files.select(*order, F.greatest(F.lit(1), F.floor(F.col(size_col) / 4)).cast("long").alias("token_estimate"))
    return greedy(rough, budget, order).agg(F.coalesce(F.max("bundle"), F.lit(0)).cast("long").alias("bundles"))
