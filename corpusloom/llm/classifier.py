"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import remainder, stored
from corpusloom.llm.hashing import Hasher, flat

FEATURES, FOLDS, BINS = 256, 5, 2000
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
#: Classes of bytes: each string is one; then digits, capitals, small letters, bytes over 127 and all others.
CLASSES = (" ", "\n", "|", "#*$%&<>", "!?", ".,;:", "'\"()-")


def _classes() -> np.ndarray:
    kinds = np.full(256, len(CLASSES) + 4, np.int64)
    for k, chars in enumerate(CLASSES):
        kinds[[ord(c) for c in chars]] = k
    for k, (a, b) in enumerate(((48, 57), (65, 90), (97, 122), (128, 255))):
        kinds[a : b + 1] = len(CLASSES) + k
    return kinds


N_CLASSES = len(CLASSES) + 5
N_STATS = N_CLASSES + 7


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, kinds: np.ndarray) -> np.ndarray:
    """N_STATS numbers for each text: shares of byte classes; logarithms of bytes and words; mean length of words;
    shares of distinct words, of words equal to the one before, to the second before, and of lines a word."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    shares = np.zeros((n, N_CLASSES))
    for k in range(n):  # a text at a time: bincount is fast and small
        shares[k] = np.bincount(kinds[data[offsets[k] : offsets[k + 1]]], minlength=N_CLASSES)
    lines = shares[:, 1] + (sizes > 0)
    shares /= np.maximum(sizes, 1)[:, None]
    hashes, counts = hasher.words(data, offsets)
    owner = np.repeat(np.arange(n), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    per = lambda where, back: np.bincount(owner[back:][where], minlength=n)
    same = lambda back: per((hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back]), back)
    words = np.maximum(counts, 1)
    more = [np.log1p(sizes), np.log1p(counts), (sizes - shares[:, :2].sum(1) * sizes) / words, np.bincount(o[new], minlength=n) / words, same(1) / words, same(2) / words, lines / words]
    return np.column_stack([shares, *more])


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and f (the statistics) of every whole text; a null text counts as empty."""
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, kinds = Hasher(), _classes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                x = statistics(*flat(part.column(1)), hasher, kinds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "f"])

    return rows.mapInArrow(describe, f"id {rows.schema['id'].dataType.simpleString()}, f array<double>")


class Features:
    """Random Fourier features of standardised statistics: a Gaussian kernel, its width the root of their number."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(s @ self.w + self.b), np.ones(len(x))])


def _matrix(b) -> np.ndarray:
    return b.flatten().to_numpy().reshape(len(b), N_STATS)


def pool(n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of means total/n in the given order by pooling neighbours that fall: places (mean index) and levels."""
    blocks: list[list[float]] = []
    for k, (c, t) in enumerate(zip(n, total, strict=True)):
        if c:
            blocks.append([c, t, c * k])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([x[2] / x[0] for x in blocks]), np.array([x[1] / x[0] for x in blocks])


def _place(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1e-6)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Each document's calibrated score and prediction; fitted on labelled rows whose crc32(id) mod 5 is not 0.

    Partitions sum their normal equations, one for each of five folds; the sums meet by blocks of rows and their total
    (FEATURES squared numbers a fold, whatever the input) solves the ridge. The folds' sums also give the held-back errors
    that choose the penalty and the models that score each fold from the others for calibration, on counts in BINS bins.
    Null or empty text: scored like any other. Null labels: not used; several labels of one id: their mean. No labels at
    all: score 0.5. Repeated ids: a row each (and each trains). Null id: not held out, no label. Other columns are not read.
    """
    import pandas as pd
    import pyarrow as pa

    spark = docs.sparkSession
    rows = stored(described(docs, id_col, text_col).withColumn("held_out", F.coalesce(remainder(F.col("id"), 5) == 0, F.lit(False))).withColumn("fold", remainder(F.concat(F.lit("fold"), F.coalesce(F.col("id").cast("string"), F.lit(""))), FOLDS).cast("int")))
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y"))
    train = stored(rows.filter("not held_out").join(known, "id").select("f", "fold", "y"))

    def moments(batches):
        n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for b in batches:
            x = _matrix(b.column(0))
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n], "k": [0], "s": [s.tolist()], "q": [q.tolist()]})

    sums = train.select("f").mapInArrow(moments, "n long, k long, s array<double>, q array<double>")
    total = sums.agg(F.sum("n").alias("n"), *[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in "sq" for i in range(N_STATS)]).first()
    n = total["n"] or 0
    if not n:
        return rows.select(F.col("id").alias(id_col), "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean = np.array([total[f"s{i}"] for i in range(N_STATS)]) / n
    features = Features(mean, np.sqrt(np.maximum(0, np.array([total[f"q{i}"] for i in range(N_STATS)]) / n - mean**2)))
    width = FEATURES + 2  # the features, one, and the label

    def normal(batches):
        found = {}
        for b in batches:
            z = np.column_stack([features(_matrix(b.column(0))), b.column(2).to_numpy()])
            fold = b.column(1).to_numpy()
            for k in np.unique(fold).tolist():
                part = z[fold == k]
                found[k] = found.get(k, 0) + part.T @ part
        keys = [(k, r) for k in found for r in range(0, width, 32)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([r for _, r in keys], pa.int32()), pa.array([found[k][r : r + 32].tobytes() for k, r in keys], pa.binary())], names=["fold", "r", "m"])

    def add(batches):  # sums as they come: one matrix block in memory
        found = {}
        for b in batches:
            for k, r, m in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found[k, r] = found.get((k, r), 0) + np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([r for _, r in found], pa.int32()), pa.array([m.tobytes() for m in found.values()], pa.binary())], names=["fold", "r", "m"])

    shape = "fold int, r int, m binary"
    # Twice: first in as many tasks as there are partitions to spread them over, then a task for each block.
    parts = train.mapInArrow(normal, shape).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("fold", "r", "salt").drop("salt").mapInArrow(add, shape)
    by_fold = np.zeros((FOLDS, width, width))
    for x in parts.repartition("fold", "r").mapInArrow(add, shape).collect():
        block = np.frombuffer(bytes(x["m"])).reshape(-1, width)
        by_fold[x["fold"], x["r"] : x["r"] + len(block)] = block
    everything = by_fold.sum(0)

    def solve(m: np.ndarray, penalty: float) -> np.ndarray:
        a = m[:-1, :-1] + penalty * np.eye(width - 1) * max(1.0, m[-2, -2] / 1000)
        return np.linalg.solve(a, m[:-1, -1])

    def error(penalty: float) -> float:
        e = [np.append(solve(everything - m, penalty), -1.0) for m in by_fold]
        return sum(w @ m @ w for w, m in zip(e, by_fold, strict=True))

    penalty = min(PENALTIES, key=error)
    final, others = solve(everything, penalty), np.array([solve(everything - m, penalty) for m in by_fold])

    def binned(batches):
        count, label = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            at = _place((features(_matrix(b.column(0))) * others[b.column(1).to_numpy()]).sum(1)).astype(int)
            count += np.bincount(at, minlength=BINS)
            label += np.bincount(at, b.column(2).to_numpy(), BINS)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(label[used])], names=["bin", "n", "y"])

    bins = train.mapInArrow(binned, "bin long, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    count, label = np.zeros(BINS), np.zeros(BINS)
    for x in bins:
        count[x["bin"]], label[x["bin"]] = x["n"], x["y"]
    places, levels = pool(count, label)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = features(_matrix(b.column(1))) @ final
            calibrated = np.clip(np.interp(_place(raw) - 0.5, places, levels), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(calibrated), pa.array((calibrated >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "f", "held_out").mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
