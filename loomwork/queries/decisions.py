"""Training examples and shards."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import training
from ..plans.funnel import in_validation
from ..registry import query
from ..session import table

_TOK = r"len(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r]+'), lambda x: x <> ''))"
_SPLIT = "CASE WHEN ('0x'||substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295 < 0.02 THEN 'val' ELSE 'train' END"


def _sized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(in_validation(F.col("doc_id"), 0.02), "val").otherwise("train").alias("split"), (F.size(T.tokens(F.coalesce(F.col("text"), F.lit("")))) + 2).cast("long").alias("tokens"))


@query(f"SELECT {_SPLIT} AS split, count(*) AS docs, sum({_TOK} + 2)::BIGINT AS tokens FROM documents GROUP BY 1")
def shard_totals(spark, sf_dir):
    return training.shard_totals(_sized(spark, sf_dir), F.col("split"), "tokens")


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {_SPLIT} AS split, {_TOK} + 2 AS n FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS r FROM s),
w(split, r, doc_id, shard, filled) AS (SELECT split, r, doc_id, 0, n FROM o WHERE r = 1 UNION ALL SELECT o.split, o.r, o.doc_id, CASE WHEN w.filled >= 5000 THEN w.shard + 1 ELSE w.shard END, CASE WHEN w.filled >= 5000 THEN o.n ELSE w.filled + o.n END FROM w JOIN o ON o.split = w.split AND o.r = w.r + 1)
SELECT doc_id, split, shard::INT AS shard FROM w""")
def shard_assign(spark, sf_dir):
    return training.shard_numbers(_sized(spark, sf_dir), "doc_id", "split", "tokens", 5000)


@query("SELECT example_id, coalesce(string_agg(target_text, chr(10)||chr(10)) OVER (PARTITION BY meta.episode, meta.candidate ORDER BY meta.t, example_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM sft_examples")
def prefix_prompts(spark, sf_dir):
    steps = table(spark, sf_dir, "sft_examples").select("example_id", "target_text", "meta.episode", "meta.candidate", "meta.t")
    return training.prefix_prompts(steps, ["episode", "candidate"], ["t", "example_id"], "target_text").select("example_id", "history")


@query(r"""WITH f AS (SELECT example_id, regexp_extract_all(target_text, '(?s)```python\n(.*?)```', 1) AS c, regexp_extract_all(target_text, '"?confidence"?[ ]*[:=][ ]*([0-9]+(?:\.[0-9]+)?)', 1) AS k FROM sft_examples)
SELECT example_id, c[-1] AS code, CASE WHEN k[-1]::DOUBLE > 0 AND k[-1]::DOUBLE <= 100 THEN round(k[-1]::DOUBLE, 3) END AS confidence FROM f""")
def parse_steps(spark, sf_dir):
    return table(spark, sf_dir, "sft_examples").select("example_id", training.step_code(F.col("target_text")).alias("code"), training.step_confidence(F.col("target_text")).alias("confidence"))


@query("SELECT example_id, round(greatest(2.0, least(98.0, CASE WHEN NOT meta.is_valid AND meta.step_error THEN 5.0 WHEN NOT meta.is_valid THEN 12.0 WHEN meta.step_error THEN least(10.0, 100 * meta.correct) ELSE 100 * meta.correct END))::DOUBLE, 4) AS target FROM sft_examples WHERE meta.correct IS NOT NULL")
def confidence_targets(spark, sf_dir):
    e = table(spark, sf_dir, "sft_examples").where("meta.correct IS NOT NULL")
    return e.select("example_id", F.round(training.confidence_target(F.col("meta.is_valid"), F.col("meta.step_error"), F.col("meta.correct")), 4).alias("target"))


@query(r"""WITH w AS (SELECT example_id, list_filter(string_split_regex(lower(prompt), '[ \t\n\r]+'), lambda x: x <> '') AS p, list_slice(list_append(list_filter(string_split_regex(lower(target_text), '[ \t\n\r]+'), lambda x: x <> ''), '</s>'), 1, 64) AS g FROM sft_examples WHERE prompt IS NOT NULL AND target_text IS NOT NULL),
s AS (SELECT *, 64 - len(g) AS room FROM w), k AS (SELECT *, least(256, room // 2) AS keep FROM s)
SELECT example_id, array_to_string(list_concat(CASE WHEN len(p) <= room THEN p ELSE list_concat(list_slice(p, 1, keep), list_slice(p, len(p) - (room - keep) + 1, len(p))) END, g), ' ') AS ids, len(g)::BIGINT AS trained FROM k""")
def sft_encode(spark, sf_dir):
    e = table(spark, sf_dir, "sft_examples").where("prompt IS NOT NULL AND target_text IS NOT NULL")
    made = e.select("example_id", T.tokens(F.col("prompt")).alias("p"), T.tokens(F.col("target_text")).alias("g")).select("example_id", training.truncated(F.col("p"), F.col("g"), 64).alias("x"))
    return made.select("example_id", F.array_join("x.ids", " ").alias("ids"), F.aggregate("x.mask", F.lit(0), lambda a, m: a + m).cast("long").alias("trained"))


# a limit is the feature: a background sample of fixed size
@query("SELECT doc_id FROM documents WHERE length(text) > 200 AND length(text) < 3000 ORDER BY md5('7:'||doc_id::VARCHAR), doc_id LIMIT 100")
def background_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where((F.length("text") > 200) & (F.length("text") < 3000))
    return d.orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(100).select("doc_id")
