"""A stored vector index: rows in clusters around centroids, of which a search leaves out those that cannot hold a near row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import exploded
from corpusloom.operators.bundling import stored
from corpusloom.operators.retrieval import BLOCK_QUERIES, BLOCK_ROWS, nearest, unit

#: Centroids are fitted on so many rows at the most (those with the least hashes), and are so many at the most.
SAMPLE, MOST, ROUNDS = 20_000, 1024, 8
#: Clusters of a query that are read first, to learn the score that others must reach; what a score's rounding hides.
FIRST, SLACK = 2, 1e-6
#: The cluster of rows without a direction: they have the score 0 with every query.
NONE = -1


@dataclass
class VectorIndex:
    """rows: cluster, salt, id, v (stored). clusters: cluster, n, salts, least and most distance of its rows to its centroid."""

    rows: DataFrame
    clusters: dict[int, tuple[int, int, float, float]]
    centroids: np.ndarray


def _fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """Centroids of length 1 by a few rounds of k-means; the first are spread over the sample in its order."""
    centroids = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def build(vectors: DataFrame, id_col: str, vector_col: str, clusters: int | None = None) -> VectorIndex:
    """The index of all rows. `clusters`: how many centroids (the square root of the number of rows if not given, MOST at the most);
    they are fitted on up to SAMPLE rows, but every row is in the index. Null vectors and those of length zero: a cluster of
    their own. The rows of a cluster are split by a salt into blocks of about BLOCK_ROWS, however many are alike."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    some = rows.filter(F.exists("v", lambda x: x != 0)).withColumn("h", F.xxhash64("v")).orderBy("h").limit(SAMPLE).select("v").collect()  # bounded
    sample = np.array([r["v"] for r in some], np.float64).reshape(len(some), len(some[0]["v"]) if some else 0)
    sample /= np.sqrt((sample * sample).sum(axis=1, keepdims=True)) if len(sample) else 1
    n = max(1, min(MOST, clusters or int(vectors.count() ** 0.5), len(sample)))
    centroids = _fitted(sample, n) if len(sample) else np.zeros((0, 0))

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            m = unit(batch.column("v"))
            zero = ~m.any(axis=1) if m.size else np.ones(len(batch), bool)
            own, far = np.full(len(batch), NONE, np.int32), np.zeros(len(batch))
            if not zero.all():
                near = m[~zero] @ centroids.T
                own[~zero] = np.argmax(near, axis=1)
                far[~zero] = np.sqrt(np.maximum(0, 2 - 2 * near.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(far)], names=["id", "v", "cluster", "far"])

    made = stored(rows.mapInArrow(placed, f"id {kind}, v array<double>, cluster int, far double"))
    found = made.groupBy("cluster").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect()  # a row for each centroid
    known = {r["cluster"]: (r["n"], -(-r["n"] // BLOCK_ROWS), r["least"], r["most"]) for r in found}
    salts = F.create_map(*[F.lit(x) for c, v in known.items() for x in (c, v[1])]) if known else F.lit(None).cast("map<int,int>")
    salted = made.withColumn("salt", F.pmod(F.xxhash64("id", "v"), salts[F.col("cluster")]).cast("int")).drop("far")
    parts = max(1, made.rdd.getNumPartitions())
    return VectorIndex(stored(salted.repartitionByRange(parts, "cluster", "salt", "id").sortWithinPartitions("cluster", "salt")), known, centroids)


def _bounds(index: VectorIndex):
    """Of queries (query, v, h), for each cluster (in the order of `index.clusters`) the least distance that a row in it can have."""
    names = list(index.clusters)
    least, most = (np.array([index.clusters[c][k] for c in names]) for k in (2, 3))
    centroids = index.centroids[[max(0, c) for c in names]] if len(index.centroids) else np.zeros((len(names), 0))
    none = np.array([c == NONE for c in names])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            m = unit(batch.column("v"))
            zero = ~m.any(axis=1) if m.size else np.ones(len(batch), bool)
            far = np.sqrt(np.maximum(0, 2 - 2 * (m @ centroids.T))) if m.shape[1] == centroids.shape[1] and m.size else np.zeros((len(batch), len(names)))
            low = np.maximum(0, np.maximum(far - most, least - far))
            low[:, none] = np.sqrt(2)
            low[zero] = 0  # such a query has the score 0 with every row
            order = np.argsort(np.where(none, 2, far), axis=1, kind="stable")
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(names)), pa.array(x)) for x in (low.ravel(), np.argsort(order, axis=1).astype(np.int32).ravel())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["query", "v", "h", "low", "nth"])

    return run


def _pairs(index: VectorIndex, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """query, v, h, cluster, nth (0: the nearest centroid's), low: a row for each query and cluster, stored."""
    names = list(index.clusters)
    asked = queries.select(F.col(id_col).alias("query"), F.col(vector_col).cast("array<double>").alias("v")).dropDuplicates().withColumn("h", F.xxhash64("v"))
    kind = asked.schema["query"].dataType.simpleString()
    wide = asked.mapInArrow(_bounds(index), f"query {kind}, v array<double>, h long, low array<double>, nth array<int>")
    rows = exploded(wide, F.arrays_zip("low", "nth"), "query", "v", "h", each="x")
    return stored(rows.select("query", "v", "h", F.get(F.array(*[F.lit(c) for c in names]), F.col("__i")).alias("cluster"), F.col("x.nth").alias("nth"), F.col("x.low").alias("low")))


def _read(index: VectorIndex, pairs: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query in each block of the clusters it is paired with (query, h, id, score)."""
    of_id, of_query = index.rows.schema["id"].dataType.simpleString(), pairs.schema["query"].dataType.simpleString()
    counts = pairs.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))  # a row for each centroid
    salts = F.create_map(*[F.lit(x) for c, v in index.clusters.items() for x in (c, v[1])])
    left = index.rows.join(F.broadcast(counts), "cluster").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cluster", "salt", "j", "id", "v")
    right = pairs.join(F.broadcast(counts), "cluster").withColumn("j", F.pmod(F.xxhash64("query", "v"), "parts").cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts[F.col("cluster")] - 1)))
    right = right.select("cluster", "salt", "j", F.col("query").alias("id"), "v", "h")
    by = ["cluster", "salt", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(nearest(k), f"query {of_query}, h long, id {of_id}, score double")


def search(index: VectorIndex, queries: DataFrame, k: int, id_col: str, vector_col: str, most: int = 100, report: list | None = None) -> DataFrame:
    """query, id, score, rank: what retrieval.vector_search_all() gives, exactly, by reading fewer rows.

    A query's nearest clusters are read first. A row of any other cluster is no nearer than the triangle inequality lets it be, from the
    query's distance to the centroid and those of the cluster's rows; a cluster is read only if that may reach the k-th score
    found. `report` gets the share of (query, row) pairs that were left out.
    """
    k = max(1, min(most, k))
    if not index.clusters:
        kind = queries.schema[id_col].dataType.simpleString()
        return index.rows.sparkSession.createDataFrame([], f"query {kind}, id {index.rows.schema['id'].dataType.simpleString()}, score double, rank int")
    pairs = _pairs(index, queries, id_col, vector_col)
    of = Window.partitionBy("query", "h")
    place = F.row_number().over(of.orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    early = stored(_read(index, pairs.filter(F.col("nth") < FIRST), k).withColumn("rank", place).filter(F.col("rank") <= k))
    reach = early.filter(F.col("rank") == k).select(F.col("query").alias("__q"), F.col("h").alias("__h"), F.col("score").alias("reach"))
    later = pairs.filter(F.col("nth") >= FIRST).join(reach, F.col("query").eqNullSafe(F.col("__q")) & (F.col("h").eqNullSafe(F.col("__h"))), "left")
    later = stored(later.filter(F.col("reach").isNull() | (F.col("low") <= F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("reach") + SLACK)) + 1e-9)).select("query", "v", "h", "cluster"))
    if report is not None:
        sizes = F.create_map(*[F.lit(x) for c, v in index.clusters.items() for x in (c, v[0])])[F.col("cluster")]
        read, every = (x.agg(F.sum(sizes)).first()[0] or 0 for x in (later.unionByName(pairs.filter(F.col("nth") < FIRST).select("query", "v", "h", "cluster")), pairs))
        report.append(1 - read / every if every else 0.0)
    found = early.drop("rank").unionByName(_read(index, later, k))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).drop("h")
