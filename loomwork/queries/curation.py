"""Normalization, quality, masking, splits and the stage report on `documents` and `docs`."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curate as C
from ..plans import funnel
from ..registry import query
from ..session import table, texts

STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
BAD = ", ".join(f"'{w}'" for w in C.ABUSIVE)


def _tidy(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '{T.CONTROLS}', '', 'g'), '[ \t\x{{a0}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10)||chr(10), 'g'), '^[ \n\r]+|[ \n\r]+$', '', 'g')"


def _quote(s: str) -> str:
    return s.replace("'", "''")


def _strip(x: str) -> str:
    x = f"regexp_replace({x}, '(?is)<!--.*?-->', '', 'g')"
    for tag in C.DROPPED_TAGS:
        x = rf"regexp_replace({x}, '(?is)<{tag}([ \t\n][^<>]*)?>.*?</{tag}>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<[a-z/!][^<>]*>', chr(10), 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _furniture(x: str) -> str:
    bars = "(length(y) - length(replace(y, '|', '')))"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda z: trim(z, ' ')), lambda y: y = '' OR NOT ((length(y) < 120 AND regexp_matches(lower(y), '{_quote(C.FURNITURE)}')) OR ({bars} >= 2 AND length(y) / ({bars} + 1) < 20))), chr(10))"


@query(f"SELECT doc_id, {_tidy('text')} AS text FROM documents")
def tidy_text(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", T.tidy(F.col("text")).alias("text"))


@query(rf"SELECT id, coalesce(regexp_matches(lower(text), '{C.TAGS}'), false) AS html FROM docs")
def html_detect(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", F.coalesce(C.html_like(F.col("text")), F.lit(False)).alias("html"))


@query(rf"SELECT id, {_strip('text')} AS text FROM docs WHERE regexp_matches(lower(text), '{C.TAGS}')")
def html_strip(spark, sf_dir):
    return texts(spark, sf_dir, "docs").where(C.html_like(F.col("text"))).select("id", C.strip_tags(F.col("text")).alias("text"))


@query(f"SELECT id, {_furniture('text')} AS text FROM docs")
def boilerplate_lines(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", C.without_furniture(F.col("text")).alias("text"))


_PLAIN = rf"CASE WHEN regexp_matches(lower(text), '{C.TAGS}') THEN {_strip('text')} ELSE text END"


@query(f"SELECT id, {_tidy(_furniture(_tidy(_PLAIN)))} AS text FROM docs")
def normalize_text(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", C.normalized(F.col("text")).alias("text"))


@query()
def normalize_nfkc(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", C.compatible("text").alias("text"))


@query()
def reread_runs(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", C.reread("text").alias("text"))


@query()
def html_main_text(spark, sf_dir):
    return texts(spark, sf_dir, "docs").where(C.html_like(F.col("text"))).select("id", C.main_text_of("text").alias("text"))


_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r]+'), lambda x: x <> '')"
_MEASURES = rf"""
m AS (SELECT doc_id, source, coalesce(text, '') AS t, {_TOKENS} AS w,
        list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda z: trim(z, ' ')), lambda y: y <> '') AS l FROM documents),
q AS (SELECT doc_id, source, length(t) AS chars, w,
        CASE WHEN t = '' THEN 0 ELSE length(regexp_replace(t, '[^#$%&*@^~<>{{}}\[\]|\\_=+]', '', 'g')) / length(t) END AS symbol_ratio,
        CASE WHEN t = '' THEN 0 ELSE length(regexp_replace(t, '[^0-9]', '', 'g')) / length(t) END AS digit_ratio,
        CASE WHEN t = '' THEN 0 ELSE length(regexp_replace(t, '\P{{L}}', '', 'g')) / length(t) END AS alpha_ratio,
        len(l) AS lines, CASE WHEN len(l) = 0 THEN 0 ELSE 1 - len(list_distinct(l)) / len(l) END AS dup_lines,
        len(w) AS words, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: x IN ({STOPS}))) / len(w) END AS stop_share,
        CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w) END AS word_length FROM m)
"""
_REASON = rf"""WITH {_MEASURES.strip()},
g AS (SELECT doc_id, k, max(n) AS top FROM (SELECT doc_id, 2 AS k, w[i]||' '||w[i+1] AS g, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM q) GROUP BY ALL
      UNION ALL SELECT doc_id, 3, w[i]||' '||w[i+1]||' '||w[i+2], count(*) FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM q) GROUP BY ALL) GROUP BY ALL),
r AS (SELECT q.*, coalesce(a.top, 0) AS top2, coalesce(b.top, 0) AS top3 FROM q LEFT JOIN g a ON a.doc_id = q.doc_id AND a.k = 2 LEFT JOIN g b ON b.doc_id = q.doc_id AND b.k = 3),
reasons AS (SELECT doc_id, source, chars, CASE WHEN chars < 200 THEN 'too_short' WHEN chars > 100000 THEN 'too_long' WHEN symbol_ratio > 0.1 THEN 'symbol_ratio' WHEN digit_ratio > 0.15 THEN 'digit_ratio'
  WHEN alpha_ratio < 0.6 THEN 'low_alpha' WHEN lines >= 3 AND dup_lines > 0.3 THEN 'dup_lines' WHEN words < 30 THEN 'too_few_words' WHEN top2 > 2 AND top2 * 2 / words > 0.2 THEN 'top_2gram'
  WHEN top3 > 2 AND top3 * 3 / words > 0.2 THEN 'top_3gram' WHEN stop_share < 0.03 THEN 'no_stopwords' WHEN word_length < 2.5 OR word_length > 12 THEN 'word_length' ELSE 'kept' END AS reason FROM r)
"""


@query(f"WITH {_MEASURES} SELECT doc_id, chars, round(symbol_ratio, 6) AS symbol_ratio, round(digit_ratio, 6) AS digit_ratio, round(alpha_ratio, 6) AS alpha_ratio, lines, round(dup_lines, 6) AS dup_lines, words, round(stop_share, 6) AS stop_share, round(word_length, 6) AS word_length FROM q")
def quality_measures(spark, sf_dir):
    m = C.measures(texts(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "m.*")
    return m.select("doc_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in m.dtypes[1:]])


@query(_REASON + "SELECT doc_id, reason FROM reasons")
def quality_rule(spark, sf_dir):
    return C.quality_reason(texts(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(_REASON + "SELECT reason, count(*) AS docs FROM reasons GROUP BY reason")
def quality_reason(spark, sf_dir):
    return C.quality_reason(texts(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").groupBy("reason").agg(F.count(F.lit(1)).alias("docs"))


@query(f"WITH m AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id, words, max(n) AS top FROM (SELECT doc_id, len(w) AS words, w[i]||' '||w[i+1] AS g, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM m) GROUP BY doc_id, len(w), g) GROUP BY doc_id, words HAVING max(n) > 2")
def top_ngram_count(spark, sf_dir):
    return C.top_ngrams(texts(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 2).select("doc_id", F.col("words").cast("long").alias("words"), "top")


def _masking(kind: str) -> str:
    _, pattern, put = next(m for m in C.MASKS if m[0] == kind)
    return f"SELECT id, regexp_replace(text, '{_quote(pattern)}', '{put}', 'g') AS text FROM docs"


@query(_masking("email"))
def mask_email(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", C.mask_one(F.col("text"), "email").alias("text"))


@query(_masking("social"))
def mask_social(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", C.mask_one(F.col("text"), "social").alias("text"))


@query(_masking("iban"))
def mask_iban(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", C.mask_one(F.col("text"), "iban").alias("text"))


@query(_masking("ip"))
def mask_ip(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", C.mask_one(F.col("text"), "ip").alias("text"))


@query(_masking("address"))
def mask_address(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", C.mask_one(F.col("text"), "address").alias("text"))


_LUHN = "(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END)) % 10 = 0)"


def _checked(name: str, source: str, pattern: str, keep: str, put: str, d: str) -> str:
    """CTEs up to `name`, with the matches of `pattern` in `source` that do not keep(b, d) replaced."""
    return f"""{name}_s AS (SELECT id, string_split_regex(text, '{pattern}') AS parts, list_append(regexp_extract_all(text, '{pattern}', 0), '') AS found FROM {source} WHERE text IS NOT NULL),
{name}_p AS (SELECT id, i, a, b, {d} AS d FROM (SELECT id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS a, unnest(found) AS b FROM {name}_s)),
{name} AS (SELECT id, string_agg(a || CASE WHEN b = '' THEN '' WHEN {keep} THEN b ELSE '{put}' END, '' ORDER BY i) AS text FROM {name}_p GROUP BY id UNION ALL SELECT id, text FROM {source} WHERE text IS NULL)"""


def _card(name: str, source: str) -> str:
    return _checked(name, source, C.CARD, f"NOT (length(d) BETWEEN 13 AND 19 AND {_LUHN})", "<CARD>", "regexp_replace(b, '[ -]', '', 'g')")


def _phone(name: str, source: str) -> str:
    return _checked(name, source, C.PHONE, "length(d) < 9", "<PHONE>", "regexp_replace(b, '[^0-9]', '', 'g')")


@query(f"WITH {_card('m', 'docs')} SELECT id, text FROM m")
def mask_card(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", C.mask_one(F.col("text"), "card").alias("text"))


@query(f"WITH {_phone('m', 'docs')} SELECT id, text FROM m")
def mask_phone(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", C.mask_one(F.col("text"), "phone").alias("text"))


_replace = lambda x, kind: f"regexp_replace({x}, '{_quote(next(m[1] for m in C.MASKS if m[0] == kind))}', '{next(m[2] for m in C.MASKS if m[0] == kind)}', 'g')"
_COUNTS = " || ' ' || ".join(f"'{kind}:' || ((length(text) - length(replace(text, '{put}', ''))) / {len(put)})::INT::VARCHAR" for kind, _, put in C.MASKS)


@query(f"""WITH a AS (SELECT id, {_replace(_replace(_replace('text', 'email'), 'social'), 'iban')} AS text FROM docs), {_card('b', 'a')},
c AS (SELECT id, {_replace(_replace('text', 'ip'), 'address')} AS text FROM b), {_phone('e', 'c')} SELECT id, text, {_COUNTS} AS counts FROM e""")
def mask_all(spark, sf_dir):
    masked = texts(spark, sf_dir, "docs").select("id", C.masked(F.col("text")).alias("text"))
    return masked.withColumn("counts", F.concat_ws(" ", *[F.concat(F.lit(f"{kind}:"), F.regexp_count("text", F.lit(put)).cast("string")) for kind, _, put in C.MASKS])).withColumn("counts", F.when(F.col("text").isNotNull(), F.col("counts")))


@query(f"WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z]+', 0) AS w FROM documents) SELECT doc_id, round(CASE WHEN w IS NULL OR len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: x IN ({BAD}))) / len(w) END, 6) AS share FROM w")
def abusive_density(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.round(C.abusive_share(F.col("text")), 6).alias("share"))


@query("SELECT doc_id, (('0x'||substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295) < 0.02 AS validation FROM documents")
def hash_split(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", funnel.in_validation(F.col("doc_id"), 0.02).alias("validation"))


@query(_REASON + """, f AS (SELECT 'quality' AS stage, source, reason, chars FROM reasons)
SELECT stage, source, count(*) AS docs_in, count(*) FILTER (reason = 'kept') AS docs_out, sum(chars)::BIGINT AS chars_in, coalesce(sum(chars) FILTER (reason = 'kept'), 0)::BIGINT AS chars_out FROM f GROUP BY stage, source""")
def stage_report(spark, sf_dir):
    return funnel.report(funnel.tagged(texts(spark, sf_dir, "documents"), "quality", C.reason_of(F.col("text"))))


@query(_REASON + "SELECT doc_id, reason FROM reasons QUALIFY row_number() OVER (PARTITION BY reason = 'kept' ORDER BY md5('1234:'||doc_id::VARCHAR)) <= 100")
def review_sample(spark, sf_dir):
    reasons = C.quality_reason(texts(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return funnel.review(reasons, "doc_id", k=100, seed=1234)


@query()
def curation_funnel(spark, sf_dir):
    return funnel.curate_all(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).report()
