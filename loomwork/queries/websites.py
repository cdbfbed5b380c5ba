"""Search hits, pages and rule-based extraction."""

from pyspark.sql import functions as F

from ..operators import extract, web
from ..registry import query
from ..session import table, texts

_INNER = r"regexp_extract(url, '[?&](?:u|uddg)=([^&#]+)', 1)"
_URL = rf"CASE WHEN {_INNER} <> '' THEN replace(replace(replace(replace(replace({_INNER}, '%3A', ':'), '%2F', '/'), '%3F', '?'), '%3D', '='), '%26', '&') ELSE url END"
_HOST = r"nullif(regexp_replace(lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\.', ''), '')"
_HITS = rf"""u AS (SELECT *, {_URL} AS target FROM search_hits), h AS (SELECT *, {_HOST} AS site FROM u),
ok AS (SELECT DISTINCT hit_id, site, provider, country_hint, industry_hint, rank_no FROM h WHERE site IS NOT NULL AND NOT regexp_matches(site, '{web.EXCLUDED}'))"""


def _hits(spark, sf_dir):
    h = table(spark, sf_dir, "search_hits").withColumn("target", web.unwrapped(F.col("url"))).withColumn("site", web.domain(F.col("target")))
    return h.where(F.col("site").isNotNull() & ~F.col("site").rlike(web.EXCLUDED)).select("hit_id", "site", "provider", "country_hint", "industry_hint", "rank_no").distinct()


@query(rf"WITH u AS (SELECT DISTINCT hit_id, {_URL} AS target FROM search_hits) SELECT hit_id, target, {_HOST} AS site FROM u")
def hit_domains(spark, sf_dir):
    h = table(spark, sf_dir, "search_hits").select("hit_id", web.unwrapped(F.col("url")).alias("target")).distinct()
    return h.select("hit_id", "target", web.domain(F.col("target")).alias("site"))


@query(f"WITH {_HITS} SELECT hit_id, site, provider, country_hint, industry_hint, rank_no FROM ok")
def hit_filter(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"WITH {_HITS} SELECT site, min(hit_id) AS hit_id, count(*) AS hits FROM ok GROUP BY site")
def domain_dedup(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("site").agg(F.min("hit_id").alias("hit_id"), F.count(F.lit(1)).alias("hits"))


# a limit is the feature: hits are picked for a run of limited size
@query(f"""WITH {_HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY industry_hint, country_hint ORDER BY rank_no, hit_id) AS rank FROM ok WHERE industry_hint IS NOT NULL AND country_hint IS NOT NULL),
s AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY site ORDER BY rank, industry_hint, country_hint, rank_no, hit_id) = 1),
n AS (SELECT * FROM s WHERE site NOT IN (SELECT company FROM run_log WHERE company IS NOT NULL AND run_id = 'run-00-00001'))
SELECT site, rank, industry_hint, country_hint FROM n ORDER BY rank, industry_hint, country_hint, rank_no, hit_id, site LIMIT 50""")
def round_robin_pick(spark, sf_dir):
    hits = _hits(spark, sf_dir).where("industry_hint IS NOT NULL AND country_hint IS NOT NULL")
    seen = table(spark, sf_dir, "run_log").where("company IS NOT NULL AND run_id = 'run-00-00001'").select(F.col("company").alias("site"))
    return web.round_robin(hits, ["industry_hint", "country_hint"], ["rank_no", "hit_id"], "site", 50, seen)


@query("SELECT DISTINCT hit_id, company_name, web_domain FROM search_hits WHERE contains(lower(country_hint), 'ireland') AND contains(lower(industry_hint), 'water')")
def seed_search(spark, sf_dir):
    h = table(spark, sf_dir, "search_hits")
    return h.where(F.lower("country_hint").contains("ireland") & F.lower("industry_hint").contains("water")).select("hit_id", "company_name", "web_domain").distinct()


@query("SELECT company_id, company_name, web_domain FROM companies WHERE country = 'Spain' AND field = 'energy'")
def offline_search(spark, sf_dir):
    return table(spark, sf_dir, "companies").where("country = 'Spain' AND field = 'energy'").select("company_id", "company_name", "web_domain")


_TITLE = r"trim(regexp_extract(text, '(?is)<title[^<>]*>(.*?)</title>', 1), ' ')"
_LINKS = r"list_distinct(list_filter(regexp_extract_all(text, '(?i)<a [^<>]*href=[\"'']([^\"''#<>]+)', 1), lambda x: NOT regexp_matches(lower(x), '^(javascript|mailto|tel):|\.(pdf|jpg|png|zip)$')))"
_PAGES = "regexp_matches(lower(text), '<html')"


@query(rf"SELECT id, {_TITLE} AS title, lower(regexp_extract(text, '(?i)<html[^<>]* lang=[\"'']?([A-Za-z-]+)', 1)) AS lang, len({_LINKS})::BIGINT AS links FROM docs WHERE {_PAGES}")
def page_metadata(spark, sf_dir):
    pages = texts(spark, sf_dir, "docs").where(F.lower("text").rlike("<html"))
    return pages.select("id", web.title(F.col("text")).alias("title"), web.page_lang(F.col("text")).alias("lang"), F.size(web.links(F.col("text"))).cast("long").alias("links"))


_KEYS = ", ".join(f"list_filter({_LINKS.replace('list_distinct(', '(')}, lambda u: regexp_matches(lower(u), '{p}'))[1] AS {kind}" for kind, p in web.KEY_PAGES)


@query(f"SELECT id, {_KEYS} FROM docs WHERE {_PAGES}")
def page_key_links(spark, sf_dir):
    return texts(spark, sf_dir, "docs").where(F.lower("text").rlike("<html")).select("id", web.key_pages(web.links(F.col("text"))).alias("k")).select("id", "k.*")


def _best(scores, other):
    top = "greatest(" + ", ".join(s for _, s in scores) + ")"
    cases = " ".join(f"WHEN {s} = {top} THEN '{name}'" for name, s in scores)
    return f"CASE WHEN {top} = 0 THEN {other} {cases} END"


_FIELD = _best([(n, " + ".join(f"{2 if ' ' in w else 1} * len(regexp_extract_all(t, '(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)', 0))" for w in ws)) for n, ws in extract.FIELDS.items()], "'unknown'")
_COUNTRY = _best([(n, " + ".join(f"len(regexp_extract_all(t, '{w}', 0))" for w in (n, *al))) for n, al in extract.COUNTRIES.items()], "NULL")


@query(f"SELECT id, {_FIELD} AS field FROM (SELECT id, lower(coalesce(text, '')) AS t FROM docs)")
def classify_field(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", extract.field(F.col("text")).alias("field"))


@query(f"SELECT id, {_COUNTRY} AS country FROM (SELECT id, coalesce(text, '') AS t FROM docs)")
def find_country(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", extract.country(F.col("text")).alias("country"))


@query(rf"""WITH f AS (SELECT id, unnest(regexp_extract_all(text, '(?:[A-Z][a-z]+ ){{1,3}}{extract.LEGAL}', 0)) AS name FROM docs), c AS (SELECT id, name, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT id, name FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, name) = 1) SELECT d.id, b.name FROM docs d LEFT JOIN b ON b.id = d.id""")
def find_company(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", extract.company_name(F.col("text")).alias("name"))


@query(r"SELECT id, nullif(regexp_extract(text, '([0-9][0-9,.]*) (?:employees|staff|people|team members)', 1), '') AS size FROM docs")
def find_size(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", extract.size(F.col("text")).alias("size"))


_ITEMS = r"flatten(list_transform(regexp_extract_all(text, '(?:offers|provides|builds and maintains|services include) ([^.\n]{3,200})', 1), lambda x: string_split_regex(lower(x), '[;,]| and ')))"


@query(rf"""WITH s AS (SELECT id, list_filter(list_transform({_ITEMS}, lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 3 AND 80) AS a FROM docs WHERE text IS NOT NULL),
p AS (SELECT id, x, min(i) AS i FROM (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM s) GROUP BY id, x)
SELECT id, x AS service FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 8""")
def find_services(spark, sf_dir):
    return texts(spark, sf_dir, "docs").select("id", F.explode(extract.services(F.col("text"))).alias("service"))


@query(rf"""WITH f AS (SELECT id, unnest(regexp_extract_all(text, '(?:[A-Z][a-z]+ ){{1,3}}{extract.LEGAL}', 0)) AS name FROM docs), c AS (SELECT id, name, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT id, name FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, name) = 1),
p AS (SELECT id, list_filter(list_transform({_ITEMS}, lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 3 AND 80) AS a FROM docs WHERE text IS NOT NULL),
s AS (SELECT id, list_slice(list(x ORDER BY i), 1, 8) AS services FROM (SELECT id, x, min(i) AS i FROM (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM p) GROUP BY id, x) GROUP BY id)
SELECT d.id, b.name, k.country, g.field, coalesce(array_to_string(s.services, '|'), '') AS services, nullif(regexp_extract(d.text, '([0-9][0-9,.]*) (?:employees|staff|people|team members)', 1), '') AS size
FROM docs d LEFT JOIN b USING (id) LEFT JOIN s USING (id) LEFT JOIN (SELECT id, {_COUNTRY} AS country FROM (SELECT id, coalesce(text, '') AS t FROM docs)) k USING (id) LEFT JOIN (SELECT id, {_FIELD} AS field FROM (SELECT id, lower(coalesce(text, '')) AS t FROM docs)) g USING (id)""")
def extract_profile(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir, "docs").select("id", extract.company_name(t).alias("name"), extract.country(t).alias("country"), extract.field(t).alias("field"), F.coalesce(F.array_join(extract.services(t), "|"), F.lit("")).alias("services"), extract.size(t).alias("size"))
