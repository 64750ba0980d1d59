"""A pipeline from raw documents to packed sequences: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, mixing, packing, quality_rules, simhash
from corpusloom.llm.common import released, stored, table

#: No SQL expresses the packing stage; tests hold run() against a plain version.
ORACLE_SQL = None


#: Where a row is in the files it is read from: tells rows apart that are equal in everything else.
KEY = ("__file", "__place")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY. Rows that are not read from files are written to some first."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(KEY[0]), F.col("_metadata.row_index").alias(KEY[1]))
    except AnalysisException:
        return _keyed(stored(docs))


def _only(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept rows, told apart by KEY: of rows that share an id, those that are kept themselves."""
    return keyed.join(kept.filter("kept").select(*KEY), list(KEY), "left_semi").drop(*KEY)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed = _keyed(docs)
    return _only(keyed, quality_rules.judge(keyed, carry=KEY))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document: that with the largest id (any one of rows that tie)."""
    keyed = _keyed(docs)
    return _only(keyed, exact_dedup.exact_dedup(keyed, carry=KEY))


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one document: that with the smallest id (any one of rows that tie)."""
    keyed = _keyed(docs)
    return _only(keyed, simhash.near_dedup(keyed, carry=KEY))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (rows are repeated; not taken: no row)."""
    keyed = _keyed(docs)
    taken = stored(mixing.mix(keyed, carry=KEY).filter("copies > 0").select(*KEY, F.col("copies").alias("__copies")))
    joined = keyed.join(taken, list(KEY))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "__copies")).alias("__copy")).drop("__copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents (copies included) with their sequences."""
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", good_quality),
    ("exact dedup", distinct_texts),
    ("simhash near-dedup", distinct_fingerprints),
    ("mixing", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if k:  # what the stage read was written by the one before it, and is read no more
                released(before)
    return docs
