"""Overlap of documents with held-out items by word n-grams, and short items that stand whole in a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpointed


def item_grams(items: DataFrame, n: int = 13, least: int = 8, text: str = "text") -> DataFrame:
    """(gram, size): n-grams of items of at least n words, and whole items of `least` to n - 1 words. Shorter are ignored."""
    w = items.select(T.words(F.col(text)).alias("w"))
    long = w.select(F.explode(T.ngrams(F.col("w"), n)).alias("gram")).withColumn("size", F.lit(n))
    short = w.where(F.size("w").between(least, n - 1)).select(F.array_join("w", " ").alias("gram"), F.size("w").alias("size"))
    return long.unionByName(short).distinct()


def hits(docs: DataFrame, items: DataFrame, key: str, n: int = 13, least: int = 8, text: str = "text") -> DataFrame:
    """(key, shared_grams): documents that share an n-gram with an item or hold a short item whole, and how many grams.

    Grams of all sizes that occur among the items (at most n - least + 1) are joined by equality, so short items need no
    substring search of every pair. Spark broadcasts the items' grams only under its own size limit. A null key has no hits.
    """
    grams = checkpointed(item_grams(items, n, least, text))
    sizes = [r.size for r in grams.select("size").distinct().collect()]
    if not sizes:
        return docs.select(key).limit(0).withColumn("shared_grams", F.lit(0).cast("long"))
    w = docs.select(key, T.words(F.col(text)).alias("w")).where(F.size("w") >= least)
    # first by hashes of the runs of words, eight bytes each; then the few documents with a hit word by word
    places = lambda s: F.transform(F.sequence(F.lit(1), F.size("w") - s + 1), lambda i: F.xxhash64(F.slice("w", i, s)))
    none = F.array().cast("array<bigint>")
    hashes = F.concat(*[F.when(F.size("w") >= s, places(s)).otherwise(none) for s in sizes])
    marks = grams.select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct()
    likely = checkpointed(w.select(key, F.explode(hashes).alias("h")).join(marks, "h", "left_semi").select(key).distinct())
    near = docs.select(key, T.words(F.col(text)).alias("w")).join(likely, key, "left_semi")
    every = F.array_distinct(F.flatten(F.array(*[T.ngrams(F.col("w"), s) for s in sizes])))
    exploded = near.select(key, F.explode(every).alias("gram"))
    return exploded.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("shared_grams"))


def clean(docs: DataFrame, items: DataFrame, key: str, n: int = 13, least: int = 8, text: str = "text") -> DataFrame:
    return docs.join(hits(docs, items, key, n, least, text).select(key), key, "left_anti")
