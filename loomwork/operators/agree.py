"""Agreement of candidate outputs: canonical forms, clusters, confidence and selection."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import retrieve


def canonical(text: Column) -> Column:
    """Lower case; letters, digits and %.- with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s%.\-]", " "), r"\s+", " "))


def plain(text: Column) -> Column:
    """The canonical form without blanks and stops at its ends."""
    return F.trim(canonical(text), F.lit(" ."))


def supported(fact: Column, source: Column, least: float = 0.9) -> Column:
    """Whether a fact stands in a source: its canonical form does, or enough of its key facts do."""
    mine, theirs = key_facts(fact), key_facts(source)
    covered = F.coalesce(F.try_divide(F.size(F.array_intersect(mine, theirs)), F.size(mine)), F.lit(0.0)) >= least
    return F.coalesce(((plain(fact) != "") & F.contains(plain(source), plain(fact))) | ((F.size(mine) > 0) & covered), F.lit(False))


def unknown_details(sentence: Column, source: Column) -> Column:
    """Numbers and, behind the first word, capitalized names of a sentence that its source does not have."""
    numbers = F.filter(F.transform(F.regexp_extract_all(sentence, F.lit(r"[0-9][0-9.,]*"), 0), lambda n: F.rtrim(n, F.lit(".,"))), lambda n: ~F.contains(source, n))
    names = F.filter(F.regexp_extract_all(sentence, F.lit(r"[\s(]([A-Z][A-Za-z]+)"), 1), lambda n: ~F.contains(F.lower(source), F.lower(n)))
    return F.array_distinct(F.concat(numbers, names))


def unsupported(stated: DataFrame, sources: DataFrame, key: str, body: str, source: str) -> DataFrame:
    """(key, stated, unsupported): canonical statements of each key, and those that its source does not hold."""
    both = stated.join(sources.select(key, source), key, "left")
    bad = (F.col(body) != "") & ~F.contains(F.coalesce(source, F.lit("")), F.col(body))
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("stated"), F.count(F.when(bad, 1)).alias("unsupported"))


def faults(rows: DataFrame, first: list[tuple[str, Column]], references: dict[str, tuple[str, DataFrame, str]], then: list[tuple[str, Column]] = ()) -> DataFrame:
    """The rows that break a rule, with `fault`, the first broken one: conditions of `first`, then references
    (name: column, table, its column) to rows that are not there, then conditions of `then`."""
    out, tests = rows, list(first)
    for i, (name, (column, other, its)) in enumerate(references.items()):
        out = out.join(other.select(F.col(its).alias(column), F.lit(True).alias(f"__r{i}")).distinct(), column, "left")
        tests.append((name, F.col(f"__r{i}").isNull()))
    fault = F.coalesce(*[F.when(broken, name) for name, broken in [*tests, *then]])
    return out.withColumn("fault", fault).where("fault IS NOT NULL").select(*rows.columns, "fault")


def canonical_json(text: str) -> Column:
    """JSON with sorted keys, canonical strings and numbers of four places; null where it is no JSON."""

    def walk(x):
        if isinstance(x, dict):
            return {form(k): walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return form(x) if isinstance(x, str) else round(x, 4) if isinstance(x, float) else x

    def form(s: str) -> str:
        kept = re.sub(r"[^\w\s%.\-]", " ", unicodedata.normalize("NFKC", s).lower())
        return " ".join(kept.split()).strip(" .")

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(walk(json.loads(t)), sort_keys=True, ensure_ascii=False) if t else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def formed(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return formed(F.col(text))


def key_facts(text: Column) -> Column:
    return F.array_distinct(F.filter(retrieve.content(text), lambda w: F.length(w) > 1))


def label_clusters(candidates: DataFrame, unit: str, order: str, key: Column) -> DataFrame:
    """`candidates` with `leader`: the smallest order of the unit with the same key."""
    return candidates.withColumn("leader", F.min(order).over(W.partitionBy(unit, key)))


def leader_clusters(candidates: DataFrame, unit: str, order: str, output: str, threshold: float = 0.6) -> DataFrame:
    """(unit, order, leader): in order, each candidate joins the first leader whose key facts overlap enough, or leads.

    The walk is ordered, so a unit is one group; its size is the number of candidates drawn for one decision.
    """
    kinds = dict(candidates.dtypes)
    facts = candidates.select(unit, order, key_facts(F.col(output)).alias("facts"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple] = []
        out = []
        for row in pdf.sort_values(order).itertuples(index=False):
            mine = set(row.facts)
            for name, theirs in leaders:
                if (len(mine & theirs) / len(mine | theirs) if mine | theirs else 1.0) >= threshold:
                    out.append((getattr(row, unit), getattr(row, order), name))
                    break
            else:
                leaders.append((getattr(row, order), mine))
                out.append((getattr(row, unit), getattr(row, order), getattr(row, order)))
        return pd.DataFrame(out, columns=[unit, order, "leader"])

    return facts.groupBy(unit).applyInPandas(walk, f"{unit} {kinds[unit]}, {order} {kinds[order]}, leader {kinds[order]}")


def soft_jaccard(a: str, b: str, least: float = 0.6) -> Column:
    """A pandas UDF on two arrays of items: one-to-one matches of items with enough common words, taken in sorted order."""

    @F.pandas_udf("double")
    def soft(left: pd.Series, right: pd.Series) -> pd.Series:
        def words(item: str) -> set[str]:
            return set(unicodedata.normalize("NFKC", item).lower().split())

        out = []
        for xs, ys in zip(left, right):
            # the words of each item once
            mine = [words(x) for x in sorted({x for x in xs if x})] if xs is not None else []
            free = [words(y) for y in sorted({y for y in ys if y})] if ys is not None else []
            n = len(free)
            hits = 0
            for a in mine:
                best = max(((len(a & b) / len(a | b), i) for i, b in enumerate(free) if a | b), key=lambda t: (t[0], -t[1]), default=(0, 0))
                if best[0] >= least:
                    hits += 1
                    del free[best[1]]
            out.append(1.0 if not mine and not n else hits / (len(mine) + n - hits))
        return pd.Series(out, dtype="float64")

    return soft(F.col(a), F.col(b))


def confidence(confidences: Column) -> Column:
    """Sum of ln(c / 100) with missing steps filled by the mean of the others (50 without any); c is kept in [0.001, 100]."""
    known = F.filter(confidences, lambda c: c.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, c: s + c)
    mean = F.coalesce(F.try_divide(total, F.size(known)), F.lit(50.0))
    return F.aggregate(confidences, F.lit(0.0), lambda s, c: s + F.ln(F.greatest(F.lit(0.001), F.least(F.lit(100.0), F.coalesce(c, mean))) / 100))


def selection(candidates: DataFrame) -> DataFrame:
    """One row for each unit: chosen candidate, its cluster's share of all candidates, low agreement and best score.

    Of the clusters with most valid candidates the one with the best member wins; members go by score, then mean
    confidence, shorter output and index.
    """
    vc = confidence(F.col("confidences"))
    length = F.aggregate(F.col("step_tokens"), F.lit(0).cast("long"), lambda s, x: s + x)
    score = F.round(F.when(vc == 0, -1.0).otherwise(vc) * F.when(length == 0, 1).otherwise(length), 4)
    known = F.filter("confidences", lambda c: c.isNotNull())
    mean = F.round(F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, c: s + c), F.size(known)), F.lit(50.0)), 4)
    made = candidates.select("unit_id", "cand_index", "is_valid", "cluster_no", score.alias("score"), mean.alias("mean"), F.length("output_text").alias("len"))
    k = made.groupBy("unit_id").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("is_valid"), 1)).alias("valid"))
    valid = made.where(F.col("is_valid") & F.col("cluster_no").isNotNull())
    best = F.min(F.struct((-F.col("score")).alias("a"), (-F.col("mean")).alias("b"), F.col("len").alias("c"), F.col("cand_index").alias("d")))
    clusters = valid.groupBy("unit_id", "cluster_no").agg(F.count(F.lit(1)).alias("votes"), best.alias("best"))
    winner = clusters.groupBy("unit_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("best").alias("best"), F.col("cluster_no").alias("cluster"))).alias("w"))
    joined = k.join(winner, "unit_id", "left")
    votes = -F.col("w.v")
    return joined.select("unit_id", F.col("w.best.d").alias("selected"), F.col("w.cluster").alias("cluster"), F.round(votes / F.col("k"), 4).alias("p_hat"), F.coalesce((votes == 1) & (F.col("valid") > 1), F.lit(False)).alias("low_agreement"), (-F.col("w.best.a")).alias("best_score"))


def canonical_nfkc(text: str) -> Column:
    """The canonical form after Unicode compatibility normalization, which has no built-in expression."""

    @F.pandas_udf("string")
    def formed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return canonical(formed(F.col(text)))
