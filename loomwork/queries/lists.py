"""Flattening, numbering, bands, replacement and weighted scores."""

from pyspark.sql import functions as F

from ..operators import agree, logs, records, retrieve
from ..functions import text as T
from ..registry import query
from ..session import table, texts
from .retrieval import _content


@query("""SELECT * FROM (SELECT company_id, unnest(['company_name', 'services', 'founded']) AS field, unnest([company_name, array_to_string(list_filter(services, lambda x: x IS NOT NULL), ' '), founded::INT::VARCHAR]) AS text FROM companies) WHERE text IS NOT NULL""")
def flat_fields(spark, sf_dir):
    c = table(spark, sf_dir, "companies").withColumn("founded", F.col("founded").cast("int"))
    return records.flattened(c, "company_id", ["company_name", "services", "founded"])


@query("SELECT company_id, substr(about, 11, 40) AS part, 'about: text, '||length(about)::VARCHAR||' chars' AS about, 'services: list, '||len(services)::VARCHAR||' items' AS services FROM companies")
def described_fields(spark, sf_dir):
    c = table(spark, sf_dir, "companies")
    return c.select("company_id", records.sliced(F.col("about"), 10, 50).alias("part"), records.described("about", F.col("about"), "string").alias("about"), records.described("services", F.col("services"), "array<string>").alias("services"))


@query("""WITH f AS (SELECT run_id, tool, min(struct_pack(a := logged_at, b := log_id)) AS first FROM run_log WHERE tool IS NOT NULL GROUP BY run_id, tool)
SELECT run_id, tool, 'S'||row_number() OVER (PARTITION BY run_id ORDER BY first, tool)::VARCHAR AS label FROM f""")
def citation_numbers(spark, sf_dir):
    return records.first_use_labels(table(spark, sf_dir, "run_log"), "run_id", "tool", ["logged_at", "log_id"])


# sizes of bands and their limits are settings of this query
_BANDS = [(10, 1.0, 2.0), (50, 2.0, 4.0), (250, 4.0, 8.0), (1e12, 8.0, 16.0)]


@query("""WITH n AS (SELECT company_id, TRY_CAST(nullif(regexp_extract(employees, '[0-9]+', 0), '') AS DOUBLE) AS size FROM companies)
SELECT company_id, size, CASE WHEN size IS NULL THEN 2.0 WHEN size <= 10 THEN 1.0 WHEN size <= 50 THEN 2.0 WHEN size <= 250 THEN 4.0 ELSE 8.0 END::DOUBLE AS low,
CASE WHEN size IS NULL THEN 4.0 WHEN size <= 10 THEN 2.0 WHEN size <= 50 THEN 4.0 WHEN size <= 250 THEN 8.0 ELSE 16.0 END::DOUBLE AS high FROM n""")
def size_band(spark, sf_dir):
    n = table(spark, sf_dir, "companies").select("company_id", F.regexp_extract("employees", "[0-9]+", 0).alias("s"))
    n = n.select("company_id", F.when(F.col("s") != "", F.col("s").cast("double")).alias("size"))
    return n.withColumn("band", records.band_of(F.col("size"), _BANDS, 1)).select("company_id", "size", "band.low", "band.high")


@query("""WITH b AS (SELECT p_size AS most, min(p_retailprice) AS price FROM part GROUP BY p_size)
SELECT l_orderkey, l_linenumber, l_quantity, (SELECT min(most) FROM b WHERE most >= l_quantity) AS band FROM lineitem WHERE l_returnflag = 'R'""")
def range_band(spark, sf_dir):
    """Each line's least part size that is not under its quantity: a range join of a large side with a side of any size."""
    bands = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("most")).agg(F.min("p_retailprice").alias("price")).withColumn("band", F.col("most"))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")
    return records.range_joined(rows, "l_quantity", bands.select("most", "band"), "most")


@query("""WITH w AS (SELECT user_id, ts, event_id, event_type FROM events), p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT w.event_id, (SELECT max(struct_pack(t := p.ts, e := p.event_id)).e FROM p WHERE p.user_id = w.user_id AND p.ts <= w.ts) AS last_event FROM w""")
def as_of_event(spark, sf_dir):
    """For each event the last event of the first kind of the same user that is not later."""
    e = table(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    first = e.where(F.col("event_type") == kind).groupBy("user_id", "ts").agg(F.max("event_id").alias("last_event"))
    return records.as_of(e.select("user_id", "ts", "event_id"), first, ["user_id"], "ts", ["last_event"]).select("event_id", "last_event")


_SKIPPED = "s AS (SELECT company, row_number() OVER (ORDER BY company) AS n FROM (SELECT DISTINCT company FROM run_log WHERE company IS NOT NULL AND lower(status) = 'error')), r AS (SELECT web_domain, row_number() OVER (ORDER BY best, web_domain) AS n FROM (SELECT web_domain, min(rank_no) AS best FROM search_hits WHERE web_domain IS NOT NULL AND web_domain NOT IN (SELECT company FROM run_log WHERE company IS NOT NULL) GROUP BY web_domain))"


@query(f"WITH {_SKIPPED} SELECT company, web_domain FROM s JOIN r USING (n)")
def reserve_replacement(spark, sf_dir):
    """Companies whose runs failed, each with the next site from the search hits that no run has had."""
    log = table(spark, sf_dir, "run_log").where("company IS NOT NULL")
    skipped = log.where(F.lower("status") == "error").select("company").distinct()
    hits = table(spark, sf_dir, "search_hits").where("web_domain IS NOT NULL").groupBy("web_domain").agg(F.min("rank_no").alias("best"))
    reserve = hits.join(log.select(F.col("company").alias("web_domain")), "web_domain", "left_anti")
    return records.replaced(skipped, reserve, ["company"], ["best", "web_domain"]).select("company", "web_domain")


@query("WITH l AS (SELECT DISTINCT * FROM run_log WHERE channel IS NULL OR channel <> 'errors') SELECT logged_at::DATE AS day, count(DISTINCT company) AS used, least(20, greatest(0, 60 - count(DISTINCT company)))::INT AS \"limit\" FROM l GROUP BY 1")
def daily_quota(spark, sf_dir):
    log = logs.once(table(spark, sf_dir, "run_log"))
    used = log.groupBy(F.to_date("logged_at").alias("day")).agg(F.count_distinct("company").alias("used"))
    return used.select("day", "used", records.run_limit(F.col("used"), 20, 60).cast("int").alias("limit"))


@query("""SELECT h.hit_id, round(0.7 * coalesce((lower(h.industry_hint) = lower(c.field))::INT, 0) + 0.3 * coalesce((lower(h.country_hint) = lower(c.country))::INT, 0), 6)::DOUBLE AS score
FROM (SELECT DISTINCT * FROM search_hits) h JOIN companies c ON c.web_domain = h.web_domain""")
def weighted_match(spark, sf_dir):
    """How well the hints of a hit agree with the truth record: 0.7 for the field, 0.3 for the country."""
    c = table(spark, sf_dir, "companies").select("web_domain", "field", "country")
    h = table(spark, sf_dir, "search_hits").distinct().join(c, "web_domain")
    same = lambda a, b: F.lower(a) == F.lower(b)
    return h.select("hit_id", F.round(records.weighted([(0.7, same("industry_hint", "field")), (0.3, same("country_hint", "country"))]), 6).alias("score"))


@query("""WITH h AS (SELECT unit_id, list(is_valid ORDER BY cand_index) AS hits FROM candidates GROUP BY unit_id)
SELECT unit_id, round(0.7 * hits[1]::INT + 0.3 * CASE WHEN len(hits) > 1 THEN len(list_filter(hits[2:3], lambda x: x)) / len(hits[2:3]) ELSE 0 END, 6) AS score FROM h""")
def ranked_score(spark, sf_dir):
    """0.7 for a valid first candidate of a unit and 0.3 for the share of valid ones among the next two."""
    ranked = table(spark, sf_dir, "candidates").groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("cand_index", "is_valid"))).alias("h"))
    return ranked.select("unit_id", F.round(records.lead_and_rest(F.transform("h", lambda x: x["is_valid"])), 6).alias("score"))


_WANTED = ("budget", "customers", "partners", "services", "savings", "training")


@query(f"""WITH s AS (SELECT example_id, len(list_distinct(list_intersect({_content('target_text')}, ['budget', 'customers', 'partners', 'services', 'savings', 'training']))) > 0 AS hit, meta.unit AS unit FROM sft_examples)
SELECT unit, round(count(*) FILTER (hit) / count(*), 6) AS share FROM s GROUP BY unit""")
def keyword_share(spark, sf_dir):
    """The share of a unit's texts that hold one of the wanted words."""
    hit = F.arrays_overlap(retrieve.content(F.col("target_text")), F.array(*[F.lit(w) for w in _WANTED]))
    rows = table(spark, sf_dir, "sft_examples").select(F.col("meta.unit").alias("unit"), hit.alias("hit"))
    return rows.groupBy("unit").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("share"))


_CANON = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s%.\-]', ' ', 'g'), '\s+', ' ', 'g'), ' .')"


@query(f"""WITH p AS (SELECT meta.unit AS unit, string_agg({_CANON.format('prompt')}, ' ' ORDER BY example_id) AS source FROM sft_examples GROUP BY meta.unit),
c AS (SELECT u.unit, {_CANON.format('output_text')} AS body FROM (SELECT split_part(unit_id, ':', 2) AS unit, output_text FROM candidates) u WHERE output_text IS NOT NULL AND output_text <> '')
SELECT c.unit, count(*) AS stated, count(*) FILTER (body <> '' AND NOT contains(coalesce(source, ''), body)) AS unsupported FROM c LEFT JOIN p USING (unit) GROUP BY c.unit""")
def unsupported_rate(spark, sf_dir):
    """Statements of a unit and how many of them do not stand in its sources."""
    source = table(spark, sf_dir, "sft_examples").select(F.col("meta.unit").alias("unit"), F.struct("example_id", agree.plain(F.col("prompt")).alias("t")).alias("x"))
    source = source.groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), " ").alias("source"))
    stated = table(spark, sf_dir, "candidates").where("output_text <> ''").select(F.split_part("unit_id", F.lit(":"), F.lit(2)).alias("unit"), agree.plain(F.col("output_text")).alias("body"))
    return agree.unsupported(stated, source, "unit", "body", "source")


@query(r"""WITH s AS (SELECT id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, ' ')), lambda x: length(x) > 20)) AS s FROM docs)
SELECT id, s AS sentence FROM s WHERE regexp_matches(lower(s), '\b(few|still|limited|bottleneck|barrier|remains|lack|manual|spreadsheets|whiteboards)\b')""")
def gap_sentences(spark, sf_dir):
    """Sentences that speak of something missing."""
    s = texts(spark, sf_dir, "docs").select("id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return s.where(F.lower("sentence").rlike(retrieve.GAP))


@query(r"""WITH s AS (SELECT id, list_slice(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, ' ')), lambda x: length(x) > 20), 1, 3) AS s FROM docs),
b AS (SELECT id, list_transform(s, lambda x: rtrim(x, '.')) AS s FROM s WHERE len(s) > 0)
SELECT id, 'Write a section from these facts:' || chr(10) || array_to_string(list_transform(s, lambda x, i: x || '. [S' || i::VARCHAR || ']'), chr(10)) AS prompt, array_to_string(list_transform(s, lambda x, i: x || ' [S' || i::VARCHAR || '].'), ' ') AS target FROM b""")
def section_examples(spark, sf_dir):
    from ..operators import training

    return training.section_examples(texts(spark, sf_dir, "docs").select("id", "text"), "id")


@query("""WITH f AS (SELECT DISTINCT field FROM companies WHERE field IS NOT NULL),
o AS (SELECT f.field, list(c.company_id ORDER BY c.company_id) AS ids FROM f JOIN companies c ON c.field <> f.field GROUP BY f.field)
SELECT field, ids[1 + (('0x'||substr(md5(field), 1, 8))::BIGINT % len(ids))] AS company_id FROM o""")
def off_field_pick(spark, sf_dir):
    """For each field one company of another field, chosen by the hash of the field."""
    from ..operators import training

    return training.distractors(table(spark, sf_dir, "companies"), "field", "company_id")


@query("WITH r AS (SELECT channel, log_id, logged_at, row_number() OVER (PARTITION BY channel ORDER BY logged_at DESC, log_id DESC) AS r FROM (SELECT DISTINCT * FROM run_log) WHERE channel <> 'errors' AND coalesce(step, '') <> 'srlm.step') SELECT channel, log_id FROM r WHERE r <= 50")
def log_tail(spark, sf_dir):
    return logs.tail(table(spark, sf_dir, "run_log").distinct(), 50, ("srlm.step",)).select("channel", "log_id")


@query("SELECT company_id, list_slice(list_transform(services, lambda x: CASE WHEN length(x) > 12 THEN substr(x, 1, 12)||'...[+'||(length(x) - 12)::VARCHAR||' chars]' ELSE x END), 1, 2) AS services FROM companies")
def list_shorten(spark, sf_dir):
    return table(spark, sf_dir, "companies").select("company_id", logs.shortened_list(F.col("services"), 12, 2).alias("services"))


@query("""SELECT meta.task AS task, count(*) AS n, round(sum(meta.step_error::INT) / sum(meta.is_valid::INT), 6) AS errors_per_valid, round(avg(meta.conf), 4) AS conf, count(*) FILTER (meta.is_valid AND NOT meta.step_error) AS clean FROM sft_examples GROUP BY meta.task""")
def variant_ratios(spark, sf_dir):
    from ..operators import evaluate

    rows = table(spark, sf_dir, "sft_examples").select("meta.*")
    return evaluate.summary(rows, "task", means={"conf": "conf"}, ratios={"errors_per_valid": ("step_error", "is_valid")}, counts={"clean": F.col("is_valid") & ~F.col("step_error")})


@query(r"""WITH c AS (SELECT unit_id, cand_index, output_text, is_valid, confidences, (SELECT count(*) FROM companies k WHERE k.web_domain = split_part(unit_id, ':', 2)) AS known FROM candidates)
SELECT unit_id, cand_index, CASE WHEN output_text IS NULL OR trim(output_text, ' ') = '' THEN 'empty' WHEN known = 0 THEN 'unknown unit' WHEN len(list_filter(confidences, lambda x: x IS NOT NULL)) = 0 THEN 'no confidence' END AS fault FROM c
WHERE output_text IS NULL OR trim(output_text, ' ') = '' OR known = 0 OR coalesce(len(list_filter(confidences, lambda x: x IS NOT NULL)), 0) = 0""")
def candidate_faults(spark, sf_dir):
    """The first fault of each faulty candidate: empty, of a unit that no truth record has, or without any confidence."""
    c = table(spark, sf_dir, "candidates").withColumn("domain", F.split_part("unit_id", F.lit(":"), F.lit(2)))
    rules = [("empty", F.coalesce(F.trim("output_text"), F.lit("")) == ""), ("no confidence", F.coalesce(F.size(F.array_compact("confidences")), F.lit(0)) <= 0)]
    return agree.faults(c, rules[:1], {"unknown unit": ("domain", table(spark, sf_dir, "companies"), "web_domain")}, rules[1:]).select("unit_id", "cand_index", "fault")
