"""Session helpers: reading tables and cutting lineage on storage that every executor shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; `sf_dir` may be any URI that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as there are cores, if the scan has fewer (one small file): for work that costs far more than moving its rows. Large inputs pass as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors share. It has no default: a folder of one machine would be lost with it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return path.rstrip("/")


def release(spark: SparkSession, path: str) -> None:
    """Files below `path` go when the session ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` as a table into the shared folder and return a scan of it.

    Lineage ends there, so a lost executor costs a re-read and no recomputation. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    release(spark, path)
    reader = spark.read
    return (reader if partition_by else reader.schema(df.schema)).parquet(path)


#: Bits of a membership sketch; its table has BITS / 64 rows at most, whatever it stands for.
BITS = 1 << 22


def sift(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split `df` by its bigint column `id`: rows that may be in `ids(id)`, and rows that surely are not. Nothing of `df` is shuffled.

    The sketch is a bitmap of hashed ids of at most BITS / 64 rows, so it may be broadcast whatever the size of `ids`. A join after it moves
    little more than the rows it keeps.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS))
    word, mask = F.floor(bit / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int"))
    sketch = ids.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    marked = df.withColumn("_word", word).withColumn("_mask", mask).join(F.broadcast(sketch), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) != 0, F.lit(False))
    drop = ("_word", "_mask", "_bits")
    return marked.where(hit).drop(*drop), marked.where(~hit).drop(*drop)


#: A value is hot if it holds more than 1/HOT_SHARE of the rows and more than HOT_ROWS of them, so fewer than HOT_SHARE values are; its rows are spread over SALTS.
HOT_SHARE, HOT_ROWS, SALTS = 256, 50_000, 64


def hot_values(df: DataFrame, key: str) -> list:
    """The hot values of a column: fewer than HOT_SHARE by definition. Counts combine before they shuffle."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    often = counts.where(F.col("_n") > HOT_ROWS)
    if often.isEmpty():
        return []
    total = df.count()
    return [r[0] for r in often.where(F.col("_n") * HOT_SHARE > total).select(key).collect()]


def skew_join(df: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`df` joined (inner or left) with `table`, which has a row or a few per value of `key`, where one value may hold a third of `df`: rows of hot values are spread over salts, the table's rows repeated for them."""
    hot = hot_values(df, key)
    if not hot:
        return df.join(table, key, how)
    is_hot = F.col(key).isin(hot)
    salted = df.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
