"""Chunks laid out for reading by document: a folder for each bucket of documents, sorted, with Bloom filters."""

from __future__ import annotations

import os
import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: About how many chunks a bucket holds.
PER_BUCKET = 200_000


@dataclass
class ChunkStore:
    """chunks: the stored table with its column bucket, which is the document's hash modulo `buckets`."""

    chunks: DataFrame
    buckets: int

    def _bucket(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(self.buckets)).cast("int")

    def document(self, doc_id: str) -> DataFrame:
        """The chunks of a document in order: of the folders one is listed, and of its row groups those whose filter may hold the id."""
        one = F.lit(str(doc_id))
        return self.chunks.filter((F.col("bucket") == self._bucket(one)) & (F.col("doc_id") == one)).drop("bucket").orderBy("idx")

    def chunk(self, chunk_id: str, around: int = 0) -> DataFrame:
        """The chunk of an id (DOCUMENT__cNNN), with so many before and after it in its document; no rows for an unknown id."""
        rows = self.document(chunk_id.rpartition("__c")[0])
        one = rows.filter(F.col("chunk_id") == chunk_id).select(F.col("idx").alias("__k")).limit(1)
        return rows.join(F.broadcast(one), F.col("idx").between(F.col("__k") - around, F.col("__k") + around)).drop("__k").orderBy("idx")  # one row

    def of(self, wanted: DataFrame) -> DataFrame:
        """The chunks of all documents in `wanted` (doc_id) with the places of those before and after. Buckets that none of them lies in
        are not read, if Spark finds the ids few enough to say so before it reads."""
        ids = wanted.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        ids = ids.withColumn("bucket", self._bucket(F.col("doc_id")))
        near = Window.partitionBy("bucket", "doc_id").orderBy("idx")
        rows = self.chunks.join(ids, ["bucket", "doc_id"], "left_semi")
        return rows.select(*[c for c in self.chunks.columns if c != "bucket"], F.lag("idx").over(near).alias("previous"), F.lead("idx").over(near).alias("next"))


def write(chunks: DataFrame, folder: str, buckets: int | None = None) -> ChunkStore:
    """Stores chunks (doc_id, idx and any more; chunk_id if chunk() is to find them). A bucket has a folder with one file, whose rows are
    sorted by document and place; buckets grow in number with the chunks."""
    n = max(1, buckets or -(-chunks.count() // PER_BUCKET))
    store = ChunkStore(chunks.withColumn("doc_id", F.col("doc_id").cast("string")), n)
    rows = store.chunks.withColumn("bucket", store._bucket(F.col("doc_id")))
    by = ["bucket", "doc_id", "idx"]
    out = rows.repartition(n, "bucket").sortWithinPartitions(*by).write.mode("overwrite").partitionBy("bucket")
    out.option("parquet.bloom.filter.enabled#doc_id", "true").option("parquet.bloom.filter.expected.ndv#doc_id", str(PER_BUCKET)).parquet(f"{folder.rstrip('/')}/buckets={n}")
    return load(chunks.sparkSession, folder, n)


def load(spark: SparkSession, folder: str, buckets: int) -> ChunkStore:
    return ChunkStore(spark.read.parquet(f"{folder.rstrip('/')}/buckets={buckets}"), buckets)


def asset(folder: str, name: str) -> str:
    """The path of a file of an export's folder by its name there. Names that lead out of the folder, by .., from the root, or over a
    link, are errors; so are files that are not there."""
    from corpusloom.sources.files import _store

    store, base = _store(folder)
    path = posixpath.normpath(posixpath.join(base, name.replace("\\", "/")))
    inside = path.startswith(f"{base}/") and not name.startswith(("/", "\\"))
    if inside and os.path.exists(base):
        inside = os.path.realpath(path).startswith(f"{os.path.realpath(base)}/")
    if not inside:
        raise ValueError(f"outside the folder: {name}")
    if store.get_file_info(path).type.name != "File":
        raise FileNotFoundError(name)
    return path
