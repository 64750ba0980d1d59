"""Best-fit packing of tokenised documents into sequences of a fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import released, stored

CAPACITY = 2048
#: About how many pieces and gaps a task of a sweep holds; the tasks grow with the input.
PER_TASK = 200_000
TASKS = 8


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32 and (if asked for) ids, binary: little-endian unsigned 32-bit.

    `vocabulary`: a tokenizer file's path. A document's ids end with `end_id`. One with more than `capacity` ids is cut so that
    all pieces but the first are full. Null text: empty.
    """
    import pyarrow as pa

    from corpusloom.llm.tokenize import encoder

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = rows.schema["id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                of, found = part.column(0), ([], [], [], [], [], [])
                for k in range(part.num_rows):
                    tokens = np.append(words.ids(part.column(1)[k].as_py()), np.uint32(end_id)).astype("<u4")
                    n = len(tokens)
                    edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        data = tokens[a:b].tobytes()
                        for column, value in zip(found, (k, p, a, b - a, zlib.crc32(data), data if ids else None), strict=True):
                            column.append(value)
                arrays = [of.take(pa.array(found[0], pa.int64())), pa.array(found[1], pa.int32()), *[pa.array(x, pa.int64()) for x in found[2:5]], pa.array(found[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    cut_ = rows.mapInArrow(cut, f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, ids binary")
    return cut_ if ids else cut_.drop("ids")


def matched(is_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of gaps and pieces in descending order of size: which piece takes which gap, what is left over, and at which level.

    A piece takes the nearest gap before it that no other has taken: the smallest that holds it. So gaps open and pieces
    close levels as brackets do, and at each level of nesting the two alternate."""
    depth = np.cumsum(np.where(is_piece, -1, 1))
    level = np.where(is_piece, depth + 1, depth)
    order = np.argsort(level, kind="stable")
    second = np.flatnonzero(level[order][1:] == level[order][:-1]) + 1
    second = second[is_piece[order[second]]]
    taking, taken = order[second], order[second - 1]
    free = np.ones(len(is_piece), bool)
    free[taking] = free[taken] = False
    rest = np.flatnonzero(free)
    return taking, taken, rest, level[rest]


def _swept(batches):
    """One range of a sweep: pieces with the gaps they take, then what is left for other ranges with its level."""
    import pyarrow as pa
    from pyspark import TaskContext

    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    taking, taken, rest, level = matched(rows.column("p").is_valid().to_numpy())
    part = TaskContext.get().partitionId()
    p, gap = rows.select(["p"]), rows.select(["seq", "gap", "slot"])
    pairs = [*p.take(pa.array(taking)).columns, *gap.take(pa.array(taken)).columns]
    names = ["part", "level", "p", "seq", "gap", "slot"]
    tables = [pa.Table.from_arrays([pa.array(np.full(len(taking), part, np.int32)), pa.nulls(len(taking), pa.int64()), *pairs], names)]
    kept = rows.select(["p", "seq", "gap", "slot"]).take(pa.array(rest))
    tables.append(pa.Table.from_arrays([pa.array(np.full(len(rest), part, np.int32)), pa.array(level), *kept.columns], names))
    for t in tables:
        yield from t.combine_chunks().to_batches()


def _round(left: DataFrame, gaps: DataFrame, longest: int, most: int, capacity: int, tasks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A sweep and its outcome: pieces without a gap, slots of all gaps with the pieces placed there, and the table under the first.

    A gap that holds the longest piece several times offers as many slots (`most` at the most) of equal size."""
    n = F.when(F.col("gap") >= longest, F.least(F.floor(F.col("gap") / longest), F.lit(most))).otherwise(F.lit(1)).cast("int")
    slots = gaps.withColumn("n", n).select("seq", "gap", F.expr("gap div n").cast("int").alias("size"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    items = left.select("p", "size").unionByName(slots, allowMissingColumns=True)
    items = items.withColumn("down", -F.col("size")).withColumn("kind", F.col("p").isNotNull()).withColumn("tie", F.xxhash64("p", "seq", "slot"))
    by = ["down", "kind", "tie"]
    ranges = items.repartitionByRange(tasks, *by).sortWithinPartitions(*by).select("p", "seq", "gap", "slot")
    p_type = left.schema["p"].dataType.simpleString()
    swept = stored(ranges.mapInArrow(_swept, f"part int, level long, p {p_type}, seq long, gap int, slot int"))

    # Between ranges: a range's net depth moves the levels of those after it; a level has two rows of a range at most.
    over = swept.filter("level is not null")
    nets = over.groupBy("part").agg(F.sum(F.when(F.col("p").isNull(), 1).otherwise(-1)).alias("net"))
    nets = nets.select("part", F.coalesce(F.sum("net").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    over = over.join(F.broadcast(nets), "part").withColumn("level", F.col("level") + F.col("base"))  # a row for each task of the sweep
    order = Window.partitionBy("level").orderBy("part", F.col("p").isNull())
    crossed = stored(over.select("p", "seq", "gap", "slot", F.lag(F.struct("seq", "gap", "slot")).over(order).alias("g"), F.lead(F.col("p").isNotNull()).over(order).alias("taken")))
    across = crossed.filter("p is not null and g is not null").select("p", "g.seq", "g.gap", "g.slot")
    free = crossed.filter("p is null and not coalesce(taken, false)").select("p", "seq", "gap", "slot")
    rows = swept.filter("level is null").select("p", "seq", "gap", "slot").unionByName(across).unionByName(free)
    of = Window.partitionBy("seq")
    used = F.coalesce(F.sum("p.length").over(of.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.coalesce(F.sum("p.length").over(of), F.lit(0))
    settled = stored(rows.select("p", "seq", "slot", (capacity - F.col("gap") + used).alias("offset"), (F.col("gap") - whole).cast("int").alias("rest")))
    released(swept)
    return crossed.filter("p is not null and g is null").select("p", F.col("p.length").cast("int").alias("size")), settled, crossed


def _needed(lengths: dict[int, int], capacity: int) -> int:
    """How many sequences pieces of these lengths need at least."""
    return max(-(-sum(k * n for k, n in lengths.items()) // capacity), sum(n for k, n in lengths.items() if 2 * k > capacity))


def _counts(left: DataFrame, settled: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Pieces by length and gaps by size: `capacity` numbers each at most, whatever the input."""
    sizes = left.select("size", F.lit(0).alias("kind")).unionByName(settled.filter("slot = 0").select(F.col("rest").alias("size"), F.lit(1).alias("kind")))
    found = sizes.groupBy("kind", "size").agg(F.count("*").alias("n")).collect()
    lengths = {r["size"]: r["n"] for r in found if r["kind"] == 0}
    return lengths, {r["size"]: r["n"] for r in found if r["kind"] == 1 and lengths and r["size"] >= min(lengths)}


def pack(cut: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """The pieces (length and any other columns) with sequence_id and offset.

    Rounds of best fit, each a sweep over pieces and gaps sorted together into ranges, largest first: a piece takes the
    smallest gap that holds it and that no piece before it (by size, then rank) has taken. A range's task matches its own
    rows; what is left over meets across ranges by its level of nesting. Gaps are then updated and the next round goes on with
    the pieces that got none. Pieces longer than any gap get new sequences, as many as their lengths need at least; so do all
    when a round places few and its longest piece stays. No task holds more than about `per_task` rows, and the driver sees counts by length only.
    Empty input: no rows. Equal pieces are placed each.
    """
    spark = cut.sparkSession
    # A number of its own for each piece: equal ones are spread over ranges as any others.
    table = left = stored(cut.select(F.struct(*cut.columns, F.monotonically_increasing_id().alias("__row")).alias("p"), F.col("length").cast("int").alias("size")))
    out = left.filter("false").select("p.*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    lengths = {r["size"]: r["n"] for r in left.groupBy("size").agg(F.count("*").alias("n")).collect()}
    open_, opened, settled, few = {}, 0, None, False
    while lengths:
        n, longest, largest = sum(lengths.values()), max(lengths), max(open_, default=0)
        new = _needed({k: c for k, c in lengths.items() if k > largest}, capacity)
        if few and not new:
            new = -(-_needed(lengths, capacity) // 2)
        gaps = spark.range(new).select((F.col("id") + opened).alias("seq"), F.lit(capacity).alias("gap"))
        if settled is not None:
            gaps = settled.filter(F.col("slot") == 0).filter(F.col("rest") >= min(lengths)).select("seq", F.col("rest").alias("gap")).unionByName(gaps)
        opened += new
        fitting = new + sum(c for k, c in open_.items() if k >= longest)
        tasks = max(TASKS, -(-(2 * n + new + sum(open_.values())) // per_task))
        before = table
        left, settled, table = _round(left, gaps, longest, -(-n // max(fitting, 1)), capacity, tasks)
        released(before)
        out = out.unionByName(settled.filter("p is not null").select("p.*", F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset")))
        lengths, open_ = _counts(left, settled)
        few = bool(lengths) and sum(lengths.values()) > 0.875 * n and max(lengths) > 0.75 * longest
    return out.drop("__row")


def best_fit(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed pieces of whole documents: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: empty (one piece with the end id). Null id: kept. Repeated rows are packed each. Empty input: no rows. Other columns
    are not read. The ids of the pieces come from pieces(), row by row under the same id, piece and start.
    """
    return pack(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, ids=False), capacity).withColumnRenamed("id", id_col)
