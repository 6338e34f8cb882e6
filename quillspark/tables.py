"""Reading the project's tables and small helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.bloom import bloom_filter, might_contain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``. Only a session within this machine (tests) may do
    without: it gets a folder of its own, which is removed with the process; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for what is written between steps."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written once to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Shuffled by ``keys`` into as many partitions as the session has for a shuffle. They are not put together where they are
    small: for steps in which a row costs far more than its bytes."""
    return rows.repartition(width(rows.sparkSession), *keys)


def parallel(rows: DataFrame) -> DataFrame:
    """For steps in which a row costs far more than its bytes: a table of fewer parts than there are cores is dealt out to all of
    them; a larger one stays where it is."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row per ``key``, with only the repeated ones shuffled: keys alone are counted first, and a filter of bounded size
    tells the rows that may be repeated from the many that are not. Rows without a key are all kept."""
    repeated = cut(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNotNull() & (F.col("n") > 1)).select(key))
    maybe = F.col(key).isNotNull() & might_contain(bloom_filter(repeated, key, repeated.count()), F.col(key))
    return rows.filter(~maybe).unionByName(rows.filter(maybe).dropDuplicates([key]))


#: A key with more rows than this is spread over ``SALTS`` tasks: an absolute limit, whatever the number of rows in all.
HOT_ROWS, SALTS = 100_000, 64


class Hot:
    """Which keys of ``rows`` are hot. They are counted exactly, combined before the shuffle, and kept as a Bloom filter of
    bounded size; a key that it takes for a hot one is spread without need, which changes no result."""

    def __init__(self, rows: DataFrame, key: str, limit: int | None = None):
        counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        keys = cut(counts.filter(F.col("n") > (HOT_ROWS if limit is None else limit)).select(key))
        self.n = keys.count()
        self.bits = bloom_filter(keys, key, self.n) if self.n else None

    def test(self, key: Column) -> Column:
        return F.lit(False) if self.bits is None else key.isNotNull() & might_contain(self.bits, key)

    def salt(self, key: Column, *by: Column) -> Column:
        """Salt of a row: 0, or by the hash of other columns for a hot key."""
        return F.when(self.test(key), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")

    def salts(self, key: Column) -> Column:
        """All salts that rows with ``key`` may have."""
        return F.explode(F.when(self.test(key), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))


def lookup(rows: DataFrame, key: str, dim: DataFrame, limit: int | None = None) -> DataFrame:
    """Left join of ``rows`` with ``dim`` (one row per ``key``), safe against keys that hold any share of ``rows``: the rows of
    a hot key are salted, its row of ``dim`` stands once for each salt. Rows with a null key are spread as well."""
    extra = [c for c in dim.columns if c != key]
    hot = Hot(rows, key, limit)
    spread = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 30)).cast("int")).otherwise(hot.salt(F.col(key), *(F.col(c) for c in rows.columns)))
    left = rows.withColumn("__salt", spread)
    right = dim.withColumn("__salt", hot.salts(F.col(key))).select(F.col(key).alias("__key"), F.col("__salt").alias("__salt2"), F.struct(*extra).alias("__dim"))
    met = left.join(right, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__salt2")), "left")
    return met.select(*rows.columns, *(F.col("__dim")[c].alias(c) for c in extra))


def spread_join(left: DataFrame, right: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Inner join on ``key`` where both sides may hold a key often: the left rows of a hot key are salted, its right rows stand
    once for each salt, so that no task makes all pairs of a key. ``left`` is read twice."""
    hot = Hot(left, key, limit)
    salted = left.withColumn("__salt", hot.salt(F.col(key), *(F.col(c) for c in left.columns)))
    return salted.join(right.withColumn("__salt", hot.salts(F.col(key))), [key, "__salt"]).drop("__salt")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) in the total order of ``order``, without bringing them all into one task: rows are
    range-partitioned, numbered within their partition and shifted by the sizes of the partitions before."""
    parts = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(*order)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row per partition
    shift = sizes.withColumn("__shift", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = parts.withColumn("__rank", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(shift), "__part").withColumn("rank", F.col("__rank") + F.col("__shift")).drop("__part", "__rank", "__shift")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, each once (the earliest delivery)."""
    return _once(table(spark, sf_dir, "notes"), "note_id")


def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(table(spark, sf_dir, "frontmatter"), "note_id")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(table(spark, sf_dir, "refs"), "ref_id")


def _once(rows: DataFrame, key: str) -> DataFrame:
    """Redelivered rows differ in ``received_at`` only, so any of them stands for the record."""
    return spread(rows.drop("received_at"), key).dropDuplicates([key])
