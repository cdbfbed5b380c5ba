"""Retrieval and evidence checks on texts."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agree, retrieve
from ..registry import query
from ..session import table, texts

_COMMON = ", ".join(f"'{w}'" for w in retrieve.COMMON)


def _content(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+', 0), lambda w: w NOT IN ({_COMMON}))"


@query(f"""WITH terms AS (SELECT company_id, term, count(*) AS qtf FROM (SELECT company_id, unnest({_content('clients')}) AS term FROM companies) GROUP BY ALL),
p AS (SELECT id, {_content('text')} AS w FROM docs), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM p),
ix AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM p) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
wt AS (SELECT ix.term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)) AS weight FROM ix JOIN df USING (term) CROSS JOIN s),
sc AS (SELECT company_id, id, round(sum(weight * qtf), 3) AS score FROM wt JOIN terms USING (term) GROUP BY ALL HAVING round(sum(weight * qtf), 3) > 0)
SELECT company_id, id, score, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 5""")
def bm25_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "companies").select("company_id", F.col("clients").alias("query"))
    return retrieve.bm25(texts(spark, sf_dir, "docs").select("id", "text"), asked, "id", "company_id", 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH w AS (SELECT example_id, list_distinct({_content('prompt')}) AS a, list_distinct({_content('target_text')}) AS b FROM sft_examples) SELECT example_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS overlap FROM w")
def token_overlap(spark, sf_dir):
    a, b = (F.array_distinct(retrieve.content(F.col(c))) for c in ("prompt", "target_text"))
    return table(spark, sf_dir, "sft_examples").select("example_id", F.round(retrieve.token_jaccard(a, b), 6).alias("overlap"))


@query(f"""WITH w AS (SELECT company_id, {_content('about')} AS w FROM companies), g AS (SELECT company_id, unnest(list_concat(w, CASE WHEN len(w) < 2 THEN [] ELSE list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1]) END)) AS g FROM w),
c AS (SELECT company_id, g, count(*) AS n, ('0x'||substr(md5(g), 1, 8))::BIGINT AS h FROM g GROUP BY company_id, g),
s AS (SELECT company_id, h % 512 AS bucket, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END * (1 + ln(n))) AS x FROM c GROUP BY ALL),
l AS (SELECT company_id, sqrt(sum(x * x)) AS len FROM s GROUP BY company_id)
SELECT company_id, bucket, round(x / len, 5) + 0.0 AS x FROM s JOIN l USING (company_id) WHERE len > 0""")
def hashed_embedding(spark, sf_dir):
    return retrieve.embedding(table(spark, sf_dir, "companies"), "company_id", "about").withColumn("x", F.round("x", 5) + F.lit(0.0))


# queries are the rows whose id is divisible by 50, against all rows
@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len FROM embeddings),
p AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * r.embedding[i]::DOUBLE)) / (q.len * r.len), 5) AS cosine FROM n q JOIN n r ON r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, cosine FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 5""")
def cosine_topk(spark, sf_dir):
    from pyspark.sql import Window as W

    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("len", F.sqrt(retrieve.dot(F.col("embedding"), F.col("embedding"))))
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("len").alias("qlen"))
    both = v.join(asked, F.col("vec_id") != F.col("query_id"))
    scored = both.select("query_id", "vec_id", F.round(retrieve.dot(F.col("embedding"), F.col("q")) / (F.col("len") * F.col("qlen")), 5).alias("cosine"))
    return scored.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where("r <= 5").drop("r")


_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1'||chr(10), 'g'), '\n+'), lambda x: trim(x, ' ')), lambda s: length(s) > 20)"


@query(f"SELECT id, i - 1 AS n, s[i] AS sentence FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, {_SENTENCES} AS s FROM docs WHERE text IS NOT NULL))")
def sentence_split(spark, sf_dir):
    s = texts(spark, sf_dir, "docs").where("text IS NOT NULL").select("id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    return s.withColumn("n", F.col("n").cast("long"))


_PIECES = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]) +([A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g'), '\n[ \t]*\n'), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(f"""WITH p AS (SELECT id, {_PIECES} AS p FROM docs WHERE text IS NOT NULL),
m AS (SELECT id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + 1 + length(x[1]) <= 600 THEN list_append(list_slice(a, 1, len(a) - 1), a[-1] || ' ' || x[1]) ELSE list_concat(a, x) END) AS m FROM p WHERE len(p) > 0)
SELECT id, i - 1 AS n, m[i] AS passage FROM (SELECT id, m, unnest(range(1, len(m) + 1)) AS i FROM m)""")
def passage_chunks(spark, sf_dir):
    return texts(spark, sf_dir, "docs").where("text IS NOT NULL").select("id", F.posexplode(retrieve.passages(F.col("text"))).alias("n", "passage")).withColumn("n", F.col("n").cast("long"))


@query("SELECT id, hit FROM (SELECT id, unnest(list_slice(regexp_extract_all(text, '.{0,150}(?:[0-9]+ (?:days|weeks|months)).{0,150}', 0), 1, 20)) AS hit FROM docs)")
def search_in_context(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", F.explode(retrieve.in_context(F.col("text"), "[0-9]+ (?:days|weeks|months)")).alias("hit"))


_CURRENT = r"length(s) BETWEEN 40 AND 320 AND NOT regexp_matches(lower(s), '(^|[^a-z])(history|historical|founded|formerly|originally|century|ancient|decades ago)([^a-z]|$)') AND len(regexp_extract_all(lower(s), '[a-z]{3,}ed([^a-z]|$)', 0)) <= 1 AND 2 * len(regexp_extract_all(s, '(^| )[A-Z]', 0)) < len(regexp_extract_all(s, '[^ ]+', 0))"


@query(f"SELECT id, s AS sentence FROM (SELECT id, unnest({_SENTENCES}) AS s FROM docs WHERE text IS NOT NULL) WHERE {_CURRENT}")
def current_statements(spark, sf_dir):
    keep = retrieve.is_current(F.col("sentence"))
    return texts(spark, sf_dir, "docs").where("text IS NOT NULL").select("id", F.explode(T.sentences(F.col("text"))).alias("sentence")).where(keep)


@query(f"WITH f AS (SELECT example_id, list_distinct(list_filter({_content('target_text')}, lambda w: length(w) > 1)) AS facts, list_distinct({_content('prompt')}) AS src FROM sft_examples) SELECT example_id, len(facts) = 0 OR len(list_intersect(facts, src)) >= 0.9 * len(facts) AS grounded FROM f")
def grounding_check(spark, sf_dir):
    facts, src = agree.key_facts(F.col("target_text")), F.array_distinct(retrieve.content(F.col("prompt")))
    return table(spark, sf_dir, "sft_examples").select("example_id", ((F.size(facts) == 0) | (F.size(F.array_intersect(facts, src)) >= 0.9 * F.size(facts))).alias("grounded"))


@query(r"""WITH f AS (SELECT example_id, target_text AS s, coalesce(prompt, '') AS src FROM sft_examples WHERE target_text IS NOT NULL),
d AS (SELECT example_id, list_filter(list_transform(regexp_extract_all(s, '[0-9][0-9.,]*', 0), lambda n: rtrim(n, '.,')), lambda n: NOT contains(src, n)) AS numbers, list_filter(regexp_extract_all(s, '[\s(]([A-Z][A-Za-z]+)', 1), lambda n: NOT contains(lower(src), lower(n))) AS names FROM f)
SELECT example_id, len(list_distinct(list_concat(numbers, names)))::BIGINT AS unknown FROM d""")
def unknown_details(spark, sf_dir):
    """How many numbers and names of a text its source does not have."""
    e = table(spark, sf_dir, "sft_examples").where("target_text IS NOT NULL")
    return e.select("example_id", F.size(agree.unknown_details(F.col("target_text"), F.coalesce("prompt", F.lit("")))).cast("long").alias("unknown"))
