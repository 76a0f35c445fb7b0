"""Structured Streaming: score texts as files arrive, and keep a cache of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.plans.engine import Engine


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    """(candidate_id, text, arrived) of text files as they appear in a folder."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("candidate_id"), F.col("value").alias("text"), F.current_timestamp().alias("arrived"))


def score_stream(engine: Engine, stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Every new draft is scored once; a batch's folder is overwritten when it is retried, so results don't double."""

    def write(batch: DataFrame, number: int) -> None:
        engine.score(batch.dropDuplicates(["candidate_id"])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Texts and words per window of arrival; rows later than the watermark are dropped."""
    from scriptorium.functions.text import word_count

    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", width).alias("w")).agg(F.count(F.lit(1)).alias("texts"), F.sum(word_count(F.col("text"))).alias("words")).select("w.start", "w.end", "texts", "words")
