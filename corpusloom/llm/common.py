"""What the operators of this subpackage share: text expressions and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The separators between words, as a character class of a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"
#: A word: a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


#: The folders that stored() has written and that are still there.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the cluster's shared checkpoint folder. Where none is set: on one machine, as in tests, a
    temporary folder; on a cluster, whose machines would not share it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *partitions: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back: lineage ends, any executor can be lost."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(*partitions).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    _written.append(path)
    return out


def released(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these tables, once nothing that is still to run reads them."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def cleared(spark: SparkSession) -> None:
    """Deletes all that stored() has written in this program: for when its results have been written elsewhere. Results are
    read from these tables as long as they are not."""
    while _written:
        _delete(spark, _written[-1])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _written:
        _written.remove(folder)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; pure ASCII texts take the much faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo `of`."""
    return F.crc32(key.cast("string").cast("binary")) % of


def unit(*seeded: Column | str) -> Column:
    """A number in (0, 1) that only the arguments decide."""
    bits = F.shiftrightunsigned(F.xxhash64(*[F.lit(x) if isinstance(x, str) else x for x in seeded]), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


#: Groups of over one in HOTTEST rows are joined by broadcast: there can be at most HOTTEST of them.
HOTTEST = 10_000


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """The rows with the columns of their group (a row for each key, in a stored table; `size`: its number of rows).

    A group that holds over one in HOTTEST of all rows would be a hot key of the exchange. Such groups are HOTTEST at the
    most, whatever the input, so they are broadcast; all others are joined by key."""
    most = (groups.agg(F.sum(size)).first()[0] or 0) // HOTTEST
    hot = groups.filter(F.col(size) > F.greatest(F.lit(most), F.lit(1)))
    named = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"), F.struct(*[c for c in groups.columns if c != key]).alias("__g"))), key, "left")
    columns = [c for c in groups.columns if c != key]
    direct = named.filter("__hot").select(*rows.columns, *[F.col("__g")[c].alias(c) for c in columns])
    others = named.filter("__hot is null").drop("__hot", "__g").join(groups, key)
    return direct.unionByName(others.select(*rows.columns, *columns))


def with_copies(rows: DataFrame, keys: list[str], out: str = "copy") -> DataFrame:
    """The rows, stored, with the number of each among those that are equal in `keys`, from 0: numbered by the partition they are read
    in, whose counts are summed in order, so that no task holds all of a group. Which of equal rows gets which number is open."""
    kept = stored(rows.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    counts = kept.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.withColumn("__s", F.coalesce(F.sum("__n").over(over), F.lit(0))).filter("__s > 0").drop("__n")
    within = kept.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy("__m")).cast("long") - 1)
    same = [within[c].eqNullSafe(starts[c]) for c in (*keys, "__p")]
    return within.join(starts, same, "left").select(*[within[c] for c in rows.columns], (F.col("__k") + F.coalesce("__s", F.lit(0))).alias(out))


def rank_in(df: DataFrame, group: list[str], key: Column, ties: list[str], out: str, per_part: int = 200_000) -> DataFrame:
    """`out`: the row's place, from 0, in the order of `key` (0 to 1, spread evenly) and `ties` within its group.

    A group is cut at fixed steps of the key into parts: 1024, or more where the input has over `per_part` rows for each.
    Parts are counted (one row each), their counts summed in order, and rows are numbered within their part: no task holds a
    group, however large it is.
    """
    buckets = max(1024, -(-df.count() // per_part))
    cut = df.withColumn("__key", key).withColumn("__part", F.least(F.lit(buckets - 1), F.floor(F.col("__key") * buckets)).cast("int"))
    part = [*group, "__part"]
    counts = cut.groupBy(*part).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*part, F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*part).orderBy("__key", *ties)
    numbered = cut.withColumn("__row", F.row_number().over(within).cast("long") - 1)
    return numbered.join(starts, part).withColumn(out, F.col("__start") + F.col("__row")).drop("__start", "__row", "__part", "__key", "__n")
