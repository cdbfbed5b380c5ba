"""Exact and near duplicates: normalized keys, MinHash signatures, banding, and the ordered keep rule.

The keep rule follows input order: a text is dropped if it is near an earlier text that was kept. That is the first
maximal independent set of the similarity graph in that order, not its connected components. Only representatives of
exact copies take part, so large groups of copies never meet in a band.

Groups of near copies are not expanded into pairs. In each round a text that is the first undecided one in all of its
bands is kept, and only those firsts are compared with the other members of their bands, which are dropped if they are
near: as many comparisons as there are band entries. When the pairs that are left are no more than PAIRS_PER_ENTRY for
each entry, they are compared, and the rest is decided over these links, again in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpointed

PRIME = (1 << 61) - 1
MASK = (1 << 32) - 1
#: Pairs of undecided texts for each band entry up to which they are all compared.
PAIRS_PER_ENTRY = 8
#: Open edges that the driver walks in order instead of further rounds.
WALKED = 100_000


def text_key(text: Column) -> Column:
    """Lower case, letters, digits and underscores with single spaces."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def exact(docs: DataFrame, order: str, text: str = "text", source: str = "source") -> DataFrame:
    """(order, key, first, label): the first holder of each row's key; label is kept, exact_dup or exact_dup_cross.

    The holder is an aggregate by key that is combined before the shuffle, so a key that many rows share is not sorted in
    one task. Rows with a null text have no key and are kept.
    """
    return exact_keyed(docs.select(order, source, F.md5(text_key(F.col(text))).alias("key")), order, source)


def exact_keyed(keyed: DataFrame, order: str, source: str = "source") -> DataFrame:
    """As exact, for rows (order, source, key)."""
    firsts = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct(order, source)).alias("f"))
    both = keyed.join(firsts, "key", "left")
    label = F.when(F.col("f").isNull() | (F.col(f"f.{order}") == F.col(order)), "kept").when(F.col(f"f.{source}").eqNullSafe(F.col(source)), "exact_dup").otherwise("exact_dup_cross")
    return both.select(order, F.coalesce(F.col(f"f.{order}"), F.col(order)).alias("first"), label.alias("label"))


def shingle_hashes(key: Column, size: int = 5) -> Column:
    """Distinct 32-bit hashes of the runs of `size` words of a normalized text; of the whole if it is shorter."""
    ws = F.filter(F.split(key, " "), lambda w: w != "")
    grams = T.let(ws, lambda a: F.when(F.size(a) >= size, T.ngrams(a, size)).otherwise(F.array(F.array_join(a, " "))))
    return F.array_distinct(F.transform(grams, T.hash32))


def permutations(count: int = 128, seed: int = 1234) -> tuple[np.ndarray, np.ndarray]:
    """The multipliers and offsets of the universal hash functions."""
    rng = np.random.RandomState(seed)
    return rng.randint(1, (1 << 31) - 1, count).astype(np.uint64), rng.randint(0, (1 << 31) - 1, count).astype(np.uint64)


def least_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash of an array under each function. Products stay under 2^63; long texts go in slices."""
    best = np.full(len(a), MASK, np.uint64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096, None]
        best = np.minimum(best, (((part * a + b) % np.uint64(PRIME)) & np.uint64(MASK)).min(axis=0))
    return best.astype(np.int64)


def signatures(docs: DataFrame, order: str, text: str = "text", count: int = 128, size: int = 5, seed: int = 1234) -> DataFrame:
    """(order, sig) of the texts with at least one word."""
    a, b = permutations(count, seed)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({order: batch[order], "sig": [least_hashes(np.asarray(h, np.uint64), a, b) for h in batch["h"]]})

    key = docs.select(order, text_key(F.col(text)).alias("k")).where(F.length("k") > 0)
    kind = docs.schema[order].dataType.simpleString()
    return key.select(order, shingle_hashes(F.col("k"), size).alias("h")).mapInPandas(sign, f"{order} {kind}, sig array<bigint>")


def band_entries(signed: DataFrame, order: str, bands: int = 32) -> DataFrame:
    """(d, band): a hash for each band of each signature."""
    n = F.size("sig")
    hashed = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", (i * (n / bands)).cast("int") + 1, (n / bands).cast("int"))))
    return signed.select(F.col(order).alias("d"), F.explode(hashed).alias("band"))


def verified(candidates: DataFrame, signed: DataFrame, order: str, threshold: float) -> DataFrame:
    """(a, b, similarity): the candidate pairs that agree in at least `threshold` of their rows."""
    sig = signed.select(F.col(order).alias("__d"), "sig")
    both = candidates.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.select("a", "b", (same / F.size("sa")).alias("similarity")).where(F.col("similarity") >= threshold)


def near_pairs(signed: DataFrame, order: str, bands: int = 32, threshold: float = 0.8, other: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): pairs that share a band and agree in at least `threshold` of their rows: a < b within `signed`,
    or a of `other` and b of `signed`.

    Bands are joined on their hash with only the keys; signatures come in for the distinct pairs. With 128 rows, 32 bands
    and 0.8 no pair is missed: at most 25 rows differ, so at least 7 bands are whole. A hot band is split by AQE. The
    result has a row for every link; `keep_near` decides without them.
    """
    entries = band_entries(signed, order, bands)
    left = (entries if other is None else band_entries(other, order, bands)).withColumnRenamed("d", "a")
    candidates = left.join(entries.withColumnRenamed("d", "b"), "band").select("a", "b").distinct()
    if other is None:
        return verified(candidates.where("a < b"), signed, order, threshold)
    return verified(candidates, signed.select(order, "sig").unionByName(other.select(order, "sig")), order, threshold)


def keep_near(signed: DataFrame, order: str, bands: int = 32, threshold: float = 0.8, pairs_per_entry: float = PAIRS_PER_ENTRY) -> DataFrame:
    """(d, near): the dropped side of the ordered keep rule, with its smallest kept neighbour."""
    entries = band_entries(signed, order, bands)
    shared = entries.join(entries.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band"), "band", "left_semi")
    live = all_entries = checkpointed(shared)
    kept: DataFrame | None = None
    while True:
        sizes = live.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("d").alias("first"))
        entries_left, pairs_left = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2), F.lit(0.0))).first()
        if pairs_left <= pairs_per_entry * entries_left:
            break
        firsts = live.join(sizes.select("band", "first"), "band")
        heads = checkpointed(firsts.groupBy("d").agg(F.min(F.col("d") == F.col("first")).alias("is")).where("is").select("d"))
        of_heads = firsts.where("d <> first").join(heads.withColumnRenamed("d", "first"), "first", "left_semi")
        gone = verified(of_heads.select(F.col("first").alias("a"), F.col("d").alias("b")).distinct(), signed, order, threshold).select(F.col("b").alias("d")).distinct()
        kept = heads if kept is None else checkpointed(kept.unionByName(heads))
        live = checkpointed(live.join(heads.unionByName(gone), "d", "left_anti"))
    open_ids = live.select("d").distinct()
    rest = keep_first(near_pairs(signed.join(open_ids.withColumnRenamed("d", order), order, "left_semi"), order, bands, threshold))
    if kept is None:
        return rest
    # what was never dropped is kept; a dropped text's neighbours are its kept band members
    kept = checkpointed(kept.unionByName(open_ids.join(rest, "d", "left_anti")))
    dropped = all_entries.join(kept, "d", "left_anti")
    holders = all_entries.join(kept, "d", "left_semi").withColumnRenamed("d", "a")
    candidates = holders.join(dropped.withColumnRenamed("d", "b"), "band").where("a < b").select("a", "b").distinct()
    return verified(candidates, signed, order, threshold).groupBy(F.col("b").alias("d")).agg(F.min("a").alias("near"))


def _walk(open_edges: DataFrame) -> list:
    """The texts with later neighbours that the ordered keep rule keeps, by a walk in key order on the driver."""
    rows = open_edges.orderBy("b").collect()
    dropped = set()
    # all edges to earlier texts of a text come before any edge from it counts
    for b, edges in groupby(rows, lambda r: r.b):
        if any(r.a not in dropped for r in edges):
            dropped.add(b)
    return sorted({r.a for r in rows} - dropped)


def keep_first(pairs: DataFrame, walked: int = WALKED) -> DataFrame:
    """(d, near): the dropped side of the ordered keep rule over pairs a < b, with its smallest kept neighbour.

    Rounds go on until no edge is open; each decides at least the first open text. Once at most `walked` edges are open
    the driver walks them in order, with the same result: a chain would take a round for every two of its texts.
    """
    edges = checkpointed(pairs.select("a", "b"))
    spark, key = edges.sparkSession, edges.select(F.col("a").alias("d"))
    open_edges = edges
    kept: list[DataFrame] = []
    while (size := open_edges.count()) > 0:
        if size <= walked:
            kept.append(spark.createDataFrame([(d,) for d in _walk(open_edges)], key.schema))
            break
        # texts that have no open earlier neighbour are kept; their later neighbours go
        later = open_edges.select(F.col("b").alias("d")).distinct()
        heads = checkpointed(open_edges.select(F.col("a").alias("d")).distinct().join(later, "d", "left_anti"))
        kept.append(heads)
        if len(kept) == 20:
            kept = [checkpointed(reduce(DataFrame.unionByName, kept))]
        gone = open_edges.join(heads.withColumnRenamed("d", "a"), "a", "left_semi").select(F.col("b").alias("d")).distinct()
        # edges of dropped texts do not count any more; a text left without edges is kept by having no drop
        left = open_edges.join(heads.withColumnRenamed("d", "a"), "a", "left_anti").join(gone.withColumnRenamed("d", "a"), "a", "left_anti").join(gone.withColumnRenamed("d", "b"), "b", "left_anti")
        open_edges = checkpointed(left)
    if not kept:
        return edges.select(F.col("b").alias("d"), F.col("a").alias("near"))
    heads = reduce(DataFrame.unionByName, kept).withColumnRenamed("d", "a")
    # a text that became free of edges without being a head is kept, too; it has no kept earlier neighbour
    return edges.join(heads, "a", "left_semi").groupBy(F.col("b").alias("d")).agg(F.min("a").alias("near")).join(heads.withColumnRenamed("a", "d"), "d", "left_anti")


def near(docs: DataFrame, order: str, text: str = "text", source: str = "source", **settings) -> DataFrame:
    """(order, label, first): kept, exact_dup(_cross) or near_dup(_cross) for every row, with the row it repeats."""
    labels = exact(docs, order, text, source)
    firsts = docs.join(labels.where("label = 'kept'").select(order), order, "left_semi")
    signed = checkpointed(signatures(firsts, order, text, settings.get("count", 128), settings.get("size", 5), settings.get("seed", 1234)))
    return labelled(docs.select(order, source), labels, signed, order, source, settings.get("bands", 32), settings.get("threshold", 0.8))


def labelled(keys: DataFrame, labels: DataFrame, signed: DataFrame, order: str, source: str, bands: int, threshold: float) -> DataFrame:
    """As near, from the labels of exact copies and the signatures of the rows that they keep; no texts take part."""
    dropped = keep_near(signed, order, bands, threshold).withColumnRenamed("d", order)
    mine = keys.select(order, source).join(labels.select(order, "label", "first"), order).join(dropped, order, "left")
    theirs = keys.select(F.col(order).alias("near"), F.col(source).alias("__s"))
    both = mine.join(theirs, "near", "left")
    near_label = F.when(F.col("__s").eqNullSafe(F.col(source)), "near_dup").otherwise("near_dup_cross")
    return both.select(order, F.when((F.col("label") == "kept") & F.col("near").isNotNull(), near_label).otherwise(F.col("label")).alias("label"), F.coalesce("near", "first").alias("first"))
