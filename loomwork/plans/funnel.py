"""The curation plan as one lineage of tagged rows, with its report, review samples and splits."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Curation
from ..functions import text as T
from ..operators import curate, decontam, dedup, ngram_models
from ..session import checkpointed


def in_validation(key: Column, share: float) -> Column:
    return T.hash32(key.cast("string")) / 4294967295.0 < share


def tagged(docs: DataFrame, stage: str, reason: Column, text: str = "text") -> DataFrame:
    """(stage, source, reason, chars) of each row of a stage; nothing is joined."""
    return docs.select(F.lit(stage).alias("stage"), "source", reason.alias("reason"), F.coalesce(F.length(text), F.lit(0)).alias("chars"))


def report(rows: DataFrame) -> DataFrame:
    kept = F.col("reason").startswith("kept")
    return rows.groupBy("stage", "source").agg(
        F.count(F.lit(1)).alias("docs_in"),
        F.count(F.when(kept, 1)).alias("docs_out"),
        F.sum(F.col("chars").cast("long")).alias("chars_in"),
        F.sum(F.when(kept, F.col("chars")).otherwise(0).cast("long")).alias("chars_out"),
    )


def reasons_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("docs"))


def review(rows: DataFrame, key: str, k: int = 100, seed: int = 1234) -> DataFrame:
    """k rows of the kept and k of the removed, chosen by hash: the same for any order and partitioning.

    Only rows below a threshold on the hash, of which 16 k are expected, are ranked: neither side meets in one task.
    """
    seeded, kept = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), F.col("reason").startswith("kept")
    sizes = {r.kept: r.n for r in rows.groupBy(kept.alias("kept")).agg(F.count(F.lit(1)).alias("n")).collect() if r.kept is not None}
    below = F.when(kept, min(1.0, 16.0 * k / max(1, sizes.get(True, 1)))).otherwise(min(1.0, 16.0 * k / max(1, sizes.get(False, 1))))
    few = rows.where(T.hash32(seeded) / 4294967295.0 <= below)
    return few.withColumn("__r", F.row_number().over(W.partitionBy(kept).orderBy(F.md5(seeded)))).where(F.col("__r") <= k).drop("__r")


@dataclasses.dataclass
class Result:
    documents: DataFrame
    rows: DataFrame

    def report(self) -> DataFrame:
        return report(self.rows)


def language_step(docs: DataFrame, c: Curation) -> DataFrame:
    """Languages by the count model of all labelled texts, labels only as its evidence; without any label all is kept."""
    scores = checkpointed(ngram_models.score_languages(docs, ngram_models.train_languages(docs), "doc_id"))
    told = ngram_models.predict_languages(scores, "doc_id").select("doc_id", F.col("lang").alias("__told"))
    known = docs.join(told, "doc_id", "left").withColumn("lang", F.coalesce("__told", "lang")).drop("__told")
    return known.withColumn("reason", F.when(F.col("lang").isNull() | F.col("lang").isin(*c.languages), "kept").otherwise(F.concat(F.lit("lang_"), "lang")))


def quality_step(docs: DataFrame, c: Curation) -> DataFrame:
    """The quality rules, and the perplexity of what passes them under a model of the same texts."""
    ruled = checkpointed(docs.join(curate.quality_reason(docs, "doc_id", c=c), "doc_id"))
    good = ruled.where("reason = 'kept'").select("doc_id", "text")
    odd = ngram_models.Trigrams(good, "doc_id", hold=checkpointed).perplexity(good, "doc_id").where(F.col("perplexity") > c.max_perplexity).select("doc_id", F.lit("perplexity").alias("__odd"))
    return ruled.join(odd, "doc_id", "left").withColumn("reason", F.coalesce("__odd", "reason")).drop("__odd")


def curate_steps(docs: DataFrame, items: DataFrame, c: Curation):
    """(stage, function from documents to (documents with `reason`)) in order."""
    yield "normalize", lambda d: d.withColumn("text", curate.reread("text")).withColumn("text", curate.compatible("text")).withColumn("text", curate.normalized(F.col("text"))).withColumn("reason", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty_after_normalize").otherwise("kept"))
    yield "language", lambda d: language_step(d, c)
    yield "quality", lambda d: quality_step(d, c)
    yield "dedup", lambda d: d.join(dedup.near(d, "doc_id", count=c.permutations, bands=c.bands, threshold=c.near_dup, size=c.shingle, seed=c.seed).select("doc_id", F.col("label").alias("reason")), "doc_id")
    bad = curate.abusive_share(F.col("text")) > c.max_toxic_share
    yield "mask", lambda d: d.withColumn("reason", F.when(bad, "toxic").when(curate.masked(F.col("text")) != F.col("text"), "kept_scrubbed").otherwise("kept")).withColumn("text", curate.masked(F.col("text")))
    yield "decontaminate", lambda d: d.join(decontam.hits(d, items, "doc_id", c.decontam_ngram), "doc_id", "left").withColumn("reason", F.when(F.col("shared_grams").isNull(), "kept").otherwise("benchmark_overlap")).drop("shared_grams")


def curate_all(docs: DataFrame, items: DataFrame, c: Curation = Curation(languages=("en", "de", "fr", "es", "it", "pt", "nl"))) -> Result:
    """All stages. Keys (`doc_id`) must be unique and there.

    What a row tells by itself (normalized and masked text, language, quality rule, abusive words) is one projection over
    the normalized texts. Perplexity, duplicates and overlaps are found from tokens, hashes and signatures and come back as
    small tables of keys; texts meet the kept keys once, at the end.
    """
    t = F.col("text")
    plain = checkpointed(docs.withColumn("text", curate.readable("text")).withColumn("text", F.coalesce(curate.normalized(t), F.lit(""))))
    model = checkpointed(ngram_models.train_languages(plain.where("text <> ''")))
    told = ngram_models.language_in_row(model)
    if told is None:
        scored = ngram_models.predict_languages(ngram_models.score_languages(plain, model, "doc_id"), "doc_id").select("doc_id", F.col("lang").alias("__told"))
        rowed = plain.join(scored, "doc_id", "left")
    else:
        rowed = plain.withColumn("__told", F.when(t != "", told["lang"]))
    lang = F.coalesce("__told", "lang")
    right = lang.isNull() | lang.isin(*c.languages)
    rule = F.when((t != "") & right, curate.reason_of(t, c))
    rowed = rowed.withColumn("lang", lang).withColumn("__rule", rule).withColumn("__masked", F.when(F.col("__rule") == "kept", curate.masked(t)))
    rowed = rowed.withColumn("__toxic", F.col("__rule").isNotNull() & (curate.abusive_share(t) > c.max_toxic_share)).withColumn("__key", F.when(F.col("__rule") == "kept", F.md5(dedup.text_key(t))))
    rowed = checkpointed(rowed)

    passing = rowed.where("__rule = 'kept'")
    fitted = ngram_models.Trigrams(ngram_models.reference_slice(passing, c.reference_sources), "doc_id", hold=checkpointed)
    odd = checkpointed(fitted.perplexity(passing, "doc_id").where(F.col("perplexity") > c.max_perplexity).select("doc_id", F.lit(True).alias("__odd")))
    keys = passing.select("doc_id", "source", F.col("__key").alias("key")).join(odd, "doc_id", "left_anti")
    labels = checkpointed(dedup.exact_keyed(keys, "doc_id"))
    signed = dedup.signatures(passing.select("doc_id", "text"), "doc_id", count=c.permutations, size=c.shingle, seed=c.seed)
    signed = checkpointed(signed.join(labels.where("label = 'kept'").select("doc_id"), "doc_id", "left_semi"))
    repeated = dedup.labelled(keys, labels, signed, "doc_id", "source", c.bands, c.near_dup).select("doc_id", F.col("label").alias("__label"))
    hit = decontam.hits(passing.where("NOT __toxic").select("doc_id", F.col("__masked").alias("text")), items, "doc_id", c.decontam_ngram).select("doc_id", F.lit(True).alias("__hit"))

    small = rowed.select("doc_id", "source", "lang", "__rule", "__toxic", F.length("text").alias("__n"), F.length("__masked").alias("__m"), (F.col("__masked") != t).alias("__changed"))
    verdict = checkpointed(small.join(odd, "doc_id", "left").join(repeated, "doc_id", "left").join(hit, "doc_id", "left"))
    foreign = F.col("lang").isNotNull() & ~F.col("lang").isin(*c.languages)
    reasons = {
        "normalize": F.when(F.col("__n") == 0, "empty_after_normalize").otherwise("kept"),
        "language": F.when(foreign, F.concat(F.lit("lang_"), "lang")).otherwise("kept"),
        "quality": F.when(F.col("__odd"), "perplexity").otherwise(F.col("__rule")),
        "dedup": F.col("__label"),
        "mask": F.when(F.col("__toxic"), "toxic").when(F.col("__changed"), "kept_scrubbed").otherwise("kept"),
        "decontaminate": F.when(F.col("__hit"), "benchmark_overlap").otherwise("kept"),
    }
    entries, there = [], F.lit(True)
    for stage, reason in reasons.items():
        chars = F.col("__m") if stage in ("mask", "decontaminate") else F.col("__n")
        entries.append(F.when(there, F.struct(F.lit(stage).alias("stage"), "source", reason.alias("reason"), F.coalesce(chars, F.lit(0)).alias("chars"))))
        there = there & F.coalesce(reason.startswith("kept"), F.lit(False))
    rows = verdict.select(F.inline(F.array_compact(F.array(*entries))))
    kept = rowed.where("__rule = 'kept' AND NOT __toxic").withColumn("text", F.col("__masked")).join(verdict.where(there).select("doc_id"), "doc_id", "left_semi")
    return Result(kept.select(*docs.columns), rows)
