"""Curation of arriving documents: the row-local steps, exact duplicates by state, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Curation
from ..operators import curate, dedup
from ..session import checkpointed


def cleaned(stream: DataFrame, key: str, c: Curation = Curation()) -> DataFrame:
    """Normalized, masked texts that pass the quality rules. Works on streams and tables alike."""
    plain = stream.withColumn("text", curate.normalized(F.col("text"))).where("text <> ''")
    m = curate.measures(plain)
    good = (F.col("m.chars").between(c.min_chars, c.max_chars)) & (F.col("m.symbol_ratio") <= c.max_symbol_ratio) & (F.col("m.digit_ratio") <= c.max_digit_ratio) & (F.col("m.words") >= c.min_words)
    return m.where(good).drop("m").withColumn("text", curate.masked(F.col("text")))


def first_seen(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose text key was not seen within the watermark; state is kept no longer than `delay` after the newest row."""
    return stream.withColumn("__key", F.md5(dedup.text_key(F.col("text")))).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def event_counts(stream: DataFrame, time: str = "logged_at", delay: str = "2 hours", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows for each window and status, windows side by side or every `slide`; late rows beyond `delay` are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, size, slide), F.lower("status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, by: str = "run_id", time: str = "logged_at", delay: str = "2 hours", gap: str = "10 minutes") -> DataFrame:
    """Rows of each stretch of events of a key with no pause of `gap`; late rows beyond `delay` are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))


def near_duplicates(batch: DataFrame, index_path: str, order: str, threshold: float = 0.8) -> DataFrame:
    """For foreachBatch: rows of a batch that are near no row of the stored index or each other; they are then added to it."""
    spark = batch.sparkSession
    signed = checkpointed(dedup.signatures(batch, order))
    try:
        stored = spark.read.parquet(index_path)
    except Exception as error:  # the first batch has no index yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = signed.limit(0)
    # what is stored came earlier, whatever its key; only the batch is paired with itself
    known = dedup.near_pairs(signed, order, threshold=threshold, other=stored).select(F.col("b").alias(order)).distinct()
    new = checkpointed(signed.join(known, order, "left_anti"))
    dropped = checkpointed(known.unionByName(dedup.keep_near(new, order, threshold=threshold).select(F.col("d").alias(order))))
    new.join(dropped, order, "left_anti").write.mode("append").parquet(index_path)
    return batch.join(dropped, order, "left_anti")
