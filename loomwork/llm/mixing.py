"""Mixing sources to target weights (problem 9).

Method. The total size is the largest at which every source that is there can reach its share within its cap on repeats
(or a given budget). Each source's need is divided by its size in tokens: the whole part is allocated as certain copies
of every document, and the rest by Pareto order sampling. A document's rank is its random odds divided by its inclusion
odds, Q = (U / (1 - U)) / (p / (1 - p)), and the documents of lowest Q are taken until the rest is filled. The inclusion
probability p is proportional to `weight` (by default the same for all documents of a source); documents whose p
reaches 1 are certain, and what they leave of the rest is spread over the others until no further p reaches 1, so that
the expected tokens are the rest.

Filling up needs no sort of a source in one task: Q is put in fine bins, tokens are summed by source and bin, bins are
cut at the source's rest, the bin at the cut is put in as many bins again, and only the documents of the one bin at that
cut, about one in 16 million, are ranked against each other.

Defined cases: a source of the documents without a target gets no copies; a target without documents, or with no tokens,
gets actual share 0 and the others keep their proportions; null texts have no tokens and are never taken; a null source
matches no target; equal rows are separate documents with separate draws if their keys differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins of log Q; their number is fixed, so the summed table has at most this many rows for each source.
BINS = 4096
#: Range of log Q.
LEAST, MOST = -40.0, 40.0


def plan(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """For each target: its tokens at hand, needed tokens, certain copies and the rest. `sizes`: source, tokens, docs."""
    one = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    both = one.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("docs", F.coalesce("docs", F.lit(0)))
    # a table of one row for each target: its size is that of the targets
    everyone = W.partitionBy(F.lit(1))
    there = (F.col("tokens") > 0) & (F.col("target_share") > 0)
    share = F.col("target_share") / F.sum(F.when(there, F.col("target_share"))).over(everyone)
    shared = both.withColumn("share", F.when(there, share).otherwise(0.0))
    reach = F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(everyone)
    total = reach if budget is None else F.lit(float(budget))
    need = F.least(F.col("share") * total, F.col("max_repeats") * F.col("tokens"))
    needed = shared.withColumn("need", need)
    copies = F.floor(F.coalesce(F.try_divide("need", "tokens"), F.lit(0.0)) + 1e-9)
    return needed.withColumn("copies", copies).withColumn("rest", F.greatest(F.lit(0.0), F.col("need") - copies * F.col("tokens")))


def mix(docs: DataFrame, targets: DataFrame, key: str, tokens: str = "tokens", weight: Column | None = None, seed: int = 7, budget: float | None = None) -> DataFrame:
    """`docs` (with a token count) and the number of `copies` that each document gets; documents without copies are left out."""
    w = F.lit(1.0) if weight is None else F.greatest(F.lit(0.0), F.coalesce(weight.cast("double"), F.lit(0.0)))
    mine = docs.where(F.col(tokens) > 0).withColumn("__w", w)
    sizes = mine.groupBy("source").agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("docs"))
    # as many rows as targets, which are a table of settings
    plans = plan(sizes, targets, budget).select("source", F.col("copies").alias("__copies"), F.col("rest").alias("__rest"))
    planned = mine.join(F.broadcast(plans), "source")
    factors = inclusion_factors(planned, tokens)
    table = docs.sparkSession.createDataFrame(sorted(factors.items()), "source string, __c double")
    p = F.least(F.lit(1.0), F.col("__c") * F.col("__w"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # log Q within LEAST and MOST; what is certain or impossible stands at the ends
    q = F.when(p >= 1, LEAST).when(p <= 0, MOST).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ln(u / (1 - u)) - F.ln(p / (1 - p)))))
    at = (F.col("__q") - LEAST) / (MOST - LEAST) * BINS
    ranked = planned.join(F.broadcast(table), "source").withColumn("__q", q)
    binned = ranked.withColumn("__bin", F.floor(at).cast("int")).withColumn("__fine", F.floor((at - F.floor(at)) * BINS).cast("int"))
    rests = plans.select("source", "__rest", F.lit(0).cast("long").alias("__before"))
    first = _cut(binned, "__bin", rests, tokens)
    edge = binned.join(F.broadcast(first.select("source", "__bin", "__before")), ["source", "__bin"])
    second = _cut(edge.drop("__before"), "__fine", first.select("source", "__rest", "__before"), tokens)
    cuts = first.select("source", F.col("__bin").alias("__cut")).join(second.select("source", F.col("__fine").alias("__cut2"), "__before"), "source", "left")
    cut = binned.join(F.broadcast(cuts), "source", "left")
    at_cut = F.coalesce((F.col("__bin") == F.col("__cut")) & (F.col("__fine") == F.col("__cut2")), F.lit(False))
    within = F.sum(tokens).over(W.partitionBy("source").orderBy("__q", key).rowsBetween(W.unboundedPreceding, 0))
    # the document at the cut is taken if that leaves the source nearer to its need
    ends = cut.where(at_cut).withColumn("__sum", within + F.col("__before")).withColumn("__in", F.col("__sum") - F.col(tokens) / 2.0 <= F.col("__rest")).drop("__sum")
    under = (F.col("__bin") < F.col("__cut")) | ((F.col("__bin") == F.col("__cut")) & (F.col("__fine") < F.col("__cut2")))
    others = cut.where(~at_cut).withColumn("__in", F.when(F.col("__cut").isNull(), (F.col("__rest") > 0) & (F.col("__q") < MOST)).otherwise(under & (F.col("__q") < MOST)))
    chosen = others.unionByName(ends).withColumn("copies", F.col("__copies") + F.coalesce(F.col("__in"), F.lit(False)).cast("long"))
    return chosen.where("copies > 0").select(*[c for c in docs.columns if c != "copies"], "copies")


def inclusion_factors(planned: DataFrame, tokens: str) -> dict[str, float]:
    """c of each source with sum of tokens * min(1, c * weight) = rest, over documents with a weight.

    Each round takes the documents that c makes certain off the rest; it ends when no source gets a new one. A round sums
    by source; nothing else goes to the driver.
    """
    spark = planned.sparkSession
    factors: dict[str, float] = {}
    certain: dict[str, int] = {}
    while True:
        known = spark.createDataFrame(sorted(factors.items()), "source string, __c double")
        sure = F.coalesce(F.col("__c") * F.col("__w") >= 1, F.lit(False))
        rows = planned.join(F.broadcast(known), "source", "left").groupBy("source").agg(
            F.first("__rest").alias("rest"),
            F.coalesce(F.sum(F.when(sure, F.col(tokens))), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~sure, F.col(tokens) * F.col("__w"))), F.lit(0.0)).alias("open"),
            F.count(F.when(sure, 1)).alias("certain"),
        ).collect()
        if factors and all(certain[r.source] == r.certain for r in rows):
            return factors
        for r in rows:
            left = max(0.0, r.rest - r.taken)
            new = left / r.open if r.open > 0 else 0.0
            # what is certain stays so
            factors[r.source] = max(factors.get(r.source, 0.0), new)
            certain[r.source] = r.certain
        if not rows:
            return factors


def _cut(rows: DataFrame, bin_: str, rests: DataFrame, tokens: str) -> DataFrame:
    """(source, bin, tokens before it, rest): the bin of each source in which its tokens reach its rest."""
    bins = rows.groupBy("source", bin_).agg(F.sum(tokens).alias("__t")).join(F.broadcast(rests), "source")
    before = F.col("__before") + F.coalesce(F.sum("__t").over(W.partitionBy("source").orderBy(bin_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = bins.withColumn("__before", before)
    return placed.where((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("__t") > F.col("__rest"))).select("source", bin_, "__before", "__rest")


def report(mixed: DataFrame, targets: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Target and actual share of each source, its tokens in the mix, documents taken and most repeats."""
    got = mixed.groupBy("source").agg(F.sum(F.col(tokens) * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.max("copies").alias("repeats"))
    out = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).join(got, "source", "left").na.fill(0, ["mixed_tokens", "docs", "copies", "repeats"])
    total = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))
    return out.select("source", "target_share", F.round(F.coalesce(F.try_divide(F.col("mixed_tokens"), total), F.lit(0.0)), 6).alias("actual_share"), "max_repeats", F.col("repeats"), "docs", "copies", "mixed_tokens")
