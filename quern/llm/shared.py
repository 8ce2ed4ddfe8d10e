"""What several operators share: staged tables, heavy-hitter search, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counters of the frequent-item summary, and the most winners that are taken from it.
TRACKED, WINNERS, FAN_IN = 2048, 256, 256
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a session whose executors are threads of the driver (local[N], as in
    tests) may go without the setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quern-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, Arrow batches are small enough for workers with little memory, however long the rows."""
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, so that a long run doesn't pile them up."""
    for df in staged:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def frequent(df: DataFrame, key: str, tracked: int = TRACKED, winners: int = WINNERS) -> DataFrame:
    """_h: 64-bit hashes of at most `winners` candidate heavy hitters of the column `key`, by Misra-Gries.

    Each task keeps a summary of `tracked` counters; FAN_IN tasks merge them
    before the last one does, so no task reads more than its share. Whatever
    exceeds about 2 / tracked of the rows is among the candidates. Counts are
    estimates, and keys may share a hash: callers verify them exactly.
    """
    part = df.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_h")).groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("_g"))
    summaries = part.agg(F.expr(f"approx_top_k_accumulate(_h, {tracked})").alias("_s"))
    # Grouped by a constant: a global combine fails on tasks without a summary.
    merged = summaries.groupBy(F.lit(0).alias("_0")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_s, {tracked}), {winners})").alias("_t"))
    return merged.select(F.explode("_t").alias("_i")).where("_i.count > 1").select(F.col("_i.item").alias("_h"))


def among(df: DataFrame, key: str, candidates: DataFrame) -> DataFrame:
    """The rows whose key is a candidate of frequent(), a table of at most WINNERS rows."""
    return df.withColumn("_h", F.xxhash64(key)).join(F.broadcast(candidates), "_h", "left_semi").drop("_h")


def choose(df: DataFrame, key: str, order: Sequence[str], largest: bool, every: bool = True) -> DataFrame:
    """Adds keep (the largest or smallest `order`, a struct, among rows of equal `key`), size, and first (true on that row).

    `order` names columns that together tell rows apart; its first one should
    say whether the second is null, as a null is smaller than any value.
    Misra-Gries finds the frequent keys; their exact winners, WINNERS rows at
    most, are broadcast, so the rows of frequent keys are settled where they
    lie. For the other keys the winner and the size are aggregated, before the
    shuffle too, and joined back: no task holds the rows of a key together,
    and the join can be split where a key is skewed. Without `every`, rows
    whose key occurs once are left out. df is read several times and should be
    staged.
    """
    best = F.struct(*order)
    found = ((F.max if largest else F.min)(best).alias("keep"), F.count("*").alias("size"))
    heavy = stage(among(df, key, frequent(df, key)).groupBy(key).agg(*found).where("size > 1"), "winners")
    light = df.join(F.broadcast(heavy.select(key)), key, "left_anti")
    again = light.groupBy(key).agg(*found).where("size > 1")
    settled = light.join(again, key, "left" if every else "inner").unionByName(df.join(F.broadcast(heavy), key))
    return settled.select(
        *df.columns, F.coalesce("keep", best).alias("keep"), F.coalesce("size", F.lit(1).cast("long")).alias("size"), F.coalesce(F.col("keep") == best, F.lit(True)).alias("first")
    )


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z for comparison with ASCII words.

    lower() is fast but also maps two other letters to ASCII; these become
    another letter first, so no ASCII word can arise from them. Other letters
    beyond ASCII may change case, but stay beyond ASCII.
    """
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")), F.lit("\u0130"), F.lit("\u00e9")))
