"""The queries of the training-data operators, by problem, and their SQL where SQL can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, spread, table
from . import budget, encode, language, leakage, mixing, mojibake, pii, prose, reservoir, toxic

RANKS = f"{encode.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
SAMPLE = 1000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_spans(spread(table(spark, sf_dir, "docs").select("id", "text"))).select("id", "kind", "pii_text").distinct()


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(spread(table(spark, sf_dir, "docs").select("id", "text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prose.verdicts(spread(table(spark, sf_dir, "docs").select("id", "text")), table(spark, sf_dir, "common_words"))
    return found.where("kind <> 'prose'").select("id", "kind").distinct()


def p2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.statistics(table(spark, sf_dir, "docs").select("id", "text"), table(spark, sf_dir, "common_words"))


def p2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prose.verdicts(spread(table(spark, sf_dir, "docs").select("id", "text")), table(spark, sf_dir, "common_words"))
    return found.select("id", "kind", "lang", F.round("prose_divergence", 4).alias("prose_divergence"), F.round("kind_divergence", 4).alias("kind_divergence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.score(spread(table(spark, sf_dir, "docs").select("id", "text"))).where("toxic").select("id").distinct()


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic.score(spread(table(spark, sf_dir, "docs").select("id", "source", "text")))
    return scored.select("id", "source", F.round("score", 4).alias("score"), "toxic", "passages")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.rates(toxic.score(spread(table(spark, sf_dir, "docs").select("source", "text")), key="source"))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.reservoir_sample(table(spark, sf_dir, "docs").select("id", "text"), SAMPLE)


def p4_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of all pieces but the newest (meta.batch), kept until the newest comes, and then merged with it."""
    docs = table(spark, sf_dir, "docs").select("id", "text", F.col("meta.batch").alias("piece"))
    newest = docs.agg(F.max("piece")).first()[0]
    late = F.coalesce(F.col("piece") == newest, F.lit(False))
    old, new = docs.where(~late).select("id", "text"), docs.where(late).select("id", "text")
    kept = checkpointed(reservoir.reservoir_sample(old, SAMPLE))
    return reservoir.merge(kept, old.count(), reservoir.reservoir_sample(new, SAMPLE, 20_25), new.count(), SAMPLE, 20_26)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "docs"), table(spark, sf_dir, "benchmark"))


def p6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "docs").select("id", "text", "source", language.code_of(F.col("meta.lang")).alias("lang"), F.col("meta.field").alias("field")))
    return budget.totals(budget.count_tokens(docs, "id"), {"source": F.col("source"), "lang": F.col("lang"), "field": F.col("field")})


def p6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "docs").select("id", "text"))
    return budget.count_tokens(docs, "id")


def p6_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals over characters, which SQL can count."""
    docs = table(spark, sf_dir, "docs").select("source", language.code_of(F.col("meta.lang")).alias("lang"), F.col("meta.field").alias("field"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    return budget.totals(docs, {"source": F.col("source"), "lang": F.col("lang"), "field": F.col("field")})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.corrections(language.identify(spread(table(spark, sf_dir, "docs").select("id", "text", "meta"))))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(spread(table(spark, sf_dir, "docs").select("id", "text", "meta"))).where("size(segments) > 1")
    return found.select("id", F.posexplode("segments").alias("n", "s")).select("id", "n", "s.lang", "s.text", F.round("s.confidence", 4).alias("confidence"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode.encode(docs, encode.read_ranks(RANKS)).select("doc_id", "ids")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put together again from their ids; null texts come back empty."""
    ranks = encode.read_ranks(RANKS)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode.decode(encode.encode(docs, ranks).drop("text"), ranks).select("doc_id", "text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # counts are used for sizes, bins and ranks; without the texts they are small
    return checkpointed(budget.count_tokens(docs, "doc_id"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.report(mixing.mix(_sized(spark, sf_dir), targets, "doc_id"), targets)


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id")


def p9_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with documents twice as likely where a field is known, and more so the longer they are."""
    targets = table(spark, sf_dir, "mix_targets")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "field", "text")
    sized = checkpointed(budget.count_tokens(docs, "doc_id"))
    weight = F.when(F.col("field").isNull(), 1.0).otherwise(2.0) * F.sqrt("tokens")
    mixed = mixing.mix(sized, targets, "doc_id", weight=weight)
    return mixed.select("doc_id", "source", "tokens", "copies")


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the mix over characters, which SQL can count."""
    sizes = table(spark, sf_dir, "documents").where("length(text) > 0").groupBy("source").agg(F.sum(F.length("text").cast("long")).alias("tokens"), F.count(F.lit(1)).alias("docs"))
    out = mixing.plan(sizes, table(spark, sf_dir, "mix_targets"))
    return out.select("source", F.round("share", 6).alias("share"), "tokens", F.round("need", 2).alias("need"), F.col("copies").cast("long").alias("copies"), F.round("rest", 2).alias("rest"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def _stats_sql() -> str:
    return r"""WITH lists AS (SELECT lang, list(DISTINCT word) AS cw FROM common_words WHERE lang IS NOT NULL GROUP BY lang),
    d AS (SELECT id, coalesce(text, '') AS t FROM docs),
    w AS (SELECT id, t, regexp_extract_all(lower(t), '\p{L}+', 0) AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM d),
    hits AS (SELECT w.id, max(len(list_filter(w, lambda x: list_contains(cw, x)))) AS hit FROM w CROSS JOIN lists GROUP BY w.id)
    SELECT id, len(w)::BIGINT AS words, round(CASE WHEN len(w) = 0 THEN 0 ELSE length(regexp_replace(t, '\P{L}', '', 'g')) / len(w) END, 6) AS mean_word_length,
    round(CASE WHEN t = '' THEN 0 ELSE length(regexp_replace(t, '[\p{L}\p{N}\s.,;:!?''"()\-]', '', 'g')) / length(t) END, 6) AS symbol_ratio,
    round(CASE WHEN len(l) = 0 THEN 0 ELSE len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '[.!?:;,]$'))) / len(l) END, 6) AS ended_lines,
    round(CASE WHEN len(w) = 0 THEN 0 ELSE coalesce(hit, 0) / len(w) END, 6) AS common_words FROM w LEFT JOIN hits USING (id)"""


def _code_sql(label: str) -> str:
    """The code of a label as language.code_of has it."""
    plain = f"regexp_replace(lower(trim({label}, ' ')), '[-_].*$', '')"
    names = " ".join(f"WHEN {plain} IN ({', '.join(repr(n) for n in ns)}) THEN '{code}'" for code, ns in language.LABELS.items())
    unknown = ", ".join(repr(u) for u in language.UNKNOWN)
    return f"CASE WHEN {label} IS NULL OR {plain} IN ({unknown}) THEN NULL {names} ELSE {plain} END"


def _chars_sql() -> str:
    names = ("source", "lang", "field")
    sets = [[n for i, n in enumerate(names) if k >> i & 1] for k in range(7, -1, -1)]
    parts = [f"""SELECT {', '.join(n if n in s else f'NULL AS {n}' for n in names)}, '{' x '.join(s) or 'all'}' AS slice, count(*) AS docs, sum(n)::BIGINT AS tokens FROM d{' GROUP BY ' + ', '.join(s) if s else ''}""" for s in sets]
    return f"WITH d AS (SELECT source, {_code_sql('meta.lang')} AS lang, meta.field AS field, coalesce(length(text), 0) AS n FROM docs) " + " UNION ALL ".join(parts)


PLAN_SQL = """WITH t AS (SELECT source, sum(target_share) AS s, min(max_repeats) AS r FROM mix_targets GROUP BY source),
    z AS (SELECT source, sum(length(text))::BIGINT AS tokens FROM documents WHERE length(text) > 0 GROUP BY source),
    j AS (SELECT t.source, s, r, coalesce(tokens, 0) AS tokens FROM t LEFT JOIN z USING (source)),
    h AS (SELECT *, CASE WHEN tokens > 0 AND s > 0 THEN s / (SELECT sum(s) FROM j WHERE tokens > 0 AND s > 0) ELSE 0 END AS share FROM j),
    n AS (SELECT *, least(share * (SELECT min(r * tokens / share) FROM h WHERE share > 0), r * tokens) AS need FROM h),
    c AS (SELECT *, floor(CASE WHEN tokens = 0 THEN 0 ELSE need / tokens END + 1e-9)::BIGINT AS copies FROM n)
    SELECT source, round(share, 6) AS share, tokens, round(need, 2) AS need, copies, round(greatest(0, need - copies * tokens), 2) AS rest FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"p2_stats": _stats_sql(), "p6_chars": _chars_sql(), "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents", "p9_plan": PLAN_SQL}
