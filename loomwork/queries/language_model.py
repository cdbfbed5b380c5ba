"""Language identification by naive Bayes and the trigram language model."""

from pyspark.sql import functions as F

from ..operators import ngram_models as M
from ..registry import SQL, query
from ..session import checkpointed, spread, table
from . import curation  # noqa: F401, its SQL is used here

_GRAMS = r"list_transform(range(1, length(w) + 1), lambda i: substr(' '||w||' ', i, 3))"
_NB = rf"""words AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+', 0)) AS w FROM documents),
grams AS (SELECT doc_id, lang, unnest({_GRAMS}) AS gram FROM words),
model AS (SELECT lang, gram, count(*) AS n FROM grams WHERE lang IS NOT NULL GROUP BY ALL)"""


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _predicted(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    model = checkpointed(M.train_languages(docs))
    return M.told_languages(docs, model, "doc_id", stops=table(spark, sf_dir, "common_words"))


@query(f"WITH {_NB} SELECT lang, gram, n FROM model")
def lang_trigrams(spark, sf_dir):
    return M.train_languages(_docs(spark, sf_dir))


_SCORED = rf"""{_NB}, v AS (SELECT count(DISTINCT gram) + 1 AS v FROM model), base AS (SELECT lang, ln(0.5) - ln(sum(n) + 0.5 * any_value(v)) AS floor FROM model, v GROUP BY lang),
lens AS (SELECT d.doc_id, count(g.gram) AS len FROM documents d LEFT JOIN grams g ON g.doc_id = d.doc_id GROUP BY d.doc_id),
gains AS (SELECT g.doc_id, m.lang, sum(ln(m.n + 0.5) - ln(0.5)) AS gain FROM grams g JOIN model m ON m.gram = g.gram GROUP BY ALL),
hits AS (SELECT w.doc_id, c.lang, 3.0 * count(*) AS bonus FROM words w JOIN (SELECT DISTINCT lang, word FROM common_words) c ON c.word = w.w GROUP BY ALL),
scores AS (SELECT l.doc_id, b.lang, l.len * b.floor + coalesce(g.gain, 0) + coalesce(h.bonus, 0) AS score FROM lens l CROSS JOIN base b LEFT JOIN gains g ON g.doc_id = l.doc_id AND g.lang = b.lang LEFT JOIN hits h ON h.doc_id = l.doc_id AND h.lang = b.lang),
best AS (SELECT doc_id, max(score) AS top, first(lang ORDER BY score DESC, lang <> 'en', lang) AS lang FROM scores GROUP BY doc_id),
predicted AS (SELECT s.doc_id, b.lang, 1 / sum(exp(greatest(-50, s.score - b.top))) AS p FROM scores s JOIN best b ON b.doc_id = s.doc_id GROUP BY s.doc_id, b.lang)"""


@query(f"WITH {_SCORED} SELECT doc_id, lang, round(p, 3) AS p FROM predicted")
def langid_predict(spark, sf_dir):
    return _predicted(spark, sf_dir).withColumn("p", F.round("p", 3))


@query(f"WITH {_SCORED} SELECT d.lang AS label, p.lang AS predicted, count(*) AS docs FROM documents d JOIN predicted p ON p.doc_id = d.doc_id GROUP BY ALL")
def langid_confusion(spark, sf_dir):
    p = _predicted(spark, sf_dir).select("doc_id", F.col("lang").alias("predicted"))
    return _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label")).join(p, "doc_id").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("docs"))


@query(f"WITH {_SCORED} SELECT p.doc_id, CASE WHEN p.lang = 'en' THEN 'kept' ELSE 'lang_'||p.lang END AS reason FROM predicted p")
def lang_filter(spark, sf_dir):
    return _predicted(spark, sf_dir).select("doc_id", F.when(F.col("lang") == "en", "kept").otherwise(F.concat(F.lit("lang_"), "lang")).alias("reason"))


# the model is fitted on texts of these sources that pass the quality rules, and scores every text
_REFERENCE = ("mini-encyclopedia", "award-abstracts")
_RULE = SQL["quality_rule"]
_IN = ", ".join(repr(x) for x in _REFERENCE)
_SLICE = f"""passing AS (SELECT d.* FROM documents d JOIN ({SQL["quality_rule"]}) q USING (doc_id) WHERE q.reason = 'kept'),
slice AS (SELECT * FROM passing WHERE source IN ({_IN}) OR NOT EXISTS (SELECT 1 FROM passing WHERE source IN ({_IN})))"""
_TOKENS = r"list_append(regexp_extract_all(lower(text), '[a-z0-9'']+|[^ \t\n\ra-z0-9'']', 0), '</s>')"
_LM = rf"""{_SLICE}, raw AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE length(text) > 0),
vocab AS (SELECT w FROM (SELECT unnest({_TOKENS}) AS w FROM slice WHERE length(text) > 0) WHERE w <> '</s>' GROUP BY w ORDER BY count(*) DESC, w LIMIT 50000),
flat AS (SELECT doc_id, unnest(w) AS r, generate_subscripts(w, 1) AS i FROM raw),
tok AS (SELECT doc_id, i, CASE WHEN r = '</s>' OR v.w IS NOT NULL THEN r ELSE '<unk>' END AS w FROM flat LEFT JOIN vocab v ON v.w = r),
win AS (SELECT doc_id, i, coalesce(lag(w, 2) OVER o, '<s>') AS u, coalesce(lag(w, 1) OVER o, '<s>') AS v, w FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
tri AS (SELECT u, v, w, count(*) AS c FROM win WHERE doc_id IN (SELECT doc_id FROM slice) GROUP BY ALL)"""


def _passing(spark, sf_dir):
    from ..operators import curate

    docs = _docs(spark, sf_dir)
    return checkpointed(docs.where(curate.reason_of(F.col("text")) == "kept"))


@query(f"WITH {_SLICE} SELECT doc_id, source FROM slice")
def reference_slice(spark, sf_dir):
    return M.reference_slice(_passing(spark, sf_dir), _REFERENCE).select("doc_id", "source")


def _model(spark, sf_dir):
    return M.Trigrams(M.reference_slice(_passing(spark, sf_dir), _REFERENCE), "doc_id", hold=checkpointed)


@query(f"WITH {_LM} SELECT u, v, w, c FROM tri")
def lm_trigrams(spark, sf_dir):
    return _model(spark, sf_dir).tri


@query(f"WITH {_LM} SELECT v, w, count(*) AS cont_vw FROM tri GROUP BY ALL")
def lm_continuations(spark, sf_dir):
    return _model(spark, sf_dir).pair


_PPL = rf"""{_LM}, ctx AS (SELECT u, v, sum(c) AS ctx, count(*) AS fol FROM tri GROUP BY ALL), pair AS (SELECT v, w, count(*) AS cont_vw FROM tri GROUP BY ALL),
middle AS (SELECT v, sum(cont_vw) AS cont_v, count(*) AS foll_v FROM pair GROUP BY v), single AS (SELECT w, count(*) AS cont_w FROM pair GROUP BY w),
sizes AS (SELECT (SELECT sum(cont_w) FROM single) AS total, (SELECT count(*) + 2 FROM vocab) AS vsize),
p AS (SELECT doc_id, 0.9 * coalesce(cont_w, 0) / greatest(total, 1) + 0.1 / vsize AS uni, coalesce(cont_v, 0) AS cont_v, coalesce(cont_vw, 0) AS cont_vw, coalesce(foll_v, 0) AS foll_v, coalesce(ctx, 0) AS ctx, coalesce(c, 0) AS c, coalesce(fol, 0) AS fol
  FROM win LEFT JOIN tri USING (u, v, w) LEFT JOIN ctx USING (u, v) LEFT JOIN pair USING (v, w) LEFT JOIN middle USING (v) LEFT JOIN single USING (w) CROSS JOIN sizes),
b AS (SELECT *, CASE WHEN cont_v = 0 THEN uni ELSE greatest(cont_vw - 0.75, 0) / cont_v + 0.75 * foll_v / cont_v * uni END AS bi FROM p),
t AS (SELECT doc_id, CASE WHEN ctx = 0 THEN bi ELSE greatest(c - 0.75, 0) / ctx + 0.75 * fol / ctx * bi END AS tri FROM b),
ppl AS (SELECT doc_id, count(*)::BIGINT AS tokens, exp(avg(-ln(greatest(tri, 1e-12)))) AS perplexity FROM t GROUP BY doc_id)"""


def _perplexity(spark, sf_dir):
    return _model(spark, sf_dir).perplexity(_docs(spark, sf_dir), "doc_id")


@query(f"WITH {_PPL} SELECT doc_id, tokens, round(perplexity, 1) AS perplexity FROM ppl")
def perplexity(spark, sf_dir):
    return _perplexity(spark, sf_dir).select("doc_id", F.col("tokens").cast("long").alias("tokens"), F.round("perplexity", 1).alias("perplexity"))


@query(f"WITH {_PPL} SELECT q.doc_id, CASE WHEN q.reason = 'kept' AND perplexity > 3000 THEN 'perplexity' ELSE q.reason END AS reason FROM ({_RULE}) q LEFT JOIN ppl USING (doc_id)")
def quality_perplexity(spark, sf_dir):
    """The first failing quality rule, the perplexity rule last."""
    from ..operators import curate

    reasons = _docs(spark, sf_dir).select("doc_id", curate.reason_of(F.col("text")).alias("reason"))
    both = reasons.join(_perplexity(spark, sf_dir), "doc_id", "left")
    return both.select("doc_id", F.when((F.col("reason") == "kept") & (F.col("perplexity") > 3000), "perplexity").otherwise(F.col("reason")).alias("reason"))
