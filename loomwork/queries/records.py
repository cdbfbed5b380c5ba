"""Event log, records from other formats, and merged evidence."""


from pyspark.sql import functions as F

from ..operators import logs
from ..registry import query
from ..session import table

_ONCE = "l AS (SELECT DISTINCT * FROM run_log WHERE channel IS NULL OR channel <> 'errors')"


@query(f"WITH {_ONCE} SELECT log_id, run_id, channel, step, status FROM l")
def log_once(spark, sf_dir):
    return logs.once(table(spark, sf_dir, "run_log")).select("log_id", "run_id", "channel", "step", "status")


# a limit is the feature: the newest rows
@query(f"WITH {_ONCE} SELECT log_id, step FROM l WHERE lower(status) = 'error' AND contains(lower(details), 'timeout') ORDER BY logged_at DESC, log_id DESC LIMIT 100")
def log_filter(spark, sf_dir):
    return logs.matching(logs.once(table(spark, sf_dir, "run_log")), status="error", text="timeout", newest=100).select("log_id", "step")


@query(f"WITH {_ONCE} SELECT logged_at::DATE AS day, lower(status) AS status, count(*) AS n, round(avg(duration), 2) AS mean_duration FROM l GROUP BY ALL")
def daily_counts(spark, sf_dir):
    log = logs.once(table(spark, sf_dir, "run_log"))
    return log.groupBy(F.to_date("logged_at").alias("day"), F.lower("status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 2).alias("mean_duration"))


@query("SELECT DISTINCT log_id, CASE WHEN length(details) > 200 THEN substr(details, 1, 200)||'...[+'||(length(details) - 200)::VARCHAR||' chars]' ELSE details END AS details FROM run_log")
def log_shorten(spark, sf_dir):
    return table(spark, sf_dir, "run_log").select("log_id", logs.shortened(F.col("details"), 200).alias("details")).distinct()


_LINES = "flatten(list_transform(string_split(details, chr(10)), lambda x: CASE WHEN length(x) <= 400 THEN [x] ELSE regexp_extract_all(x, '(?s).{1,400}', 0) END))"


@query(f"""WITH p AS (SELECT log_id, {_LINES} AS p FROM run_log WHERE details IS NOT NULL),
m AS (SELECT log_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + 1 + length(x[1]) <= 400 THEN list_append(list_slice(a, 1, len(a) - 1), a[-1] || chr(10) || x[1]) ELSE list_concat(a, x) END) AS m FROM p WHERE len(p) > 0)
SELECT log_id, i - 1 AS n, m[i] AS message FROM (SELECT log_id, m, unnest(range(1, len(m) + 1)) AS i FROM m)""")
def log_messages(spark, sf_dir):
    return table(spark, sf_dir, "run_log").where("details IS NOT NULL").select("log_id", F.posexplode(logs.message_chunks(F.col("details"), 400)).alias("n", "message")).withColumn("n", F.col("n").cast("long"))


@query("SELECT concat_ws(chr(10)||chr(10), nullif(trim(company_name, ' '), ''), nullif(trim(about, ' '), ''), nullif(trim(clients, ' '), '')) AS text, 'companies:truth:'||company_id::VARCHAR AS id FROM companies WHERE concat_ws('', trim(company_name, ' '), trim(about, ' '), trim(clients, ' ')) <> ''")
def record_to_document(spark, sf_dir):
    from ..sources.readers import to_documents

    c = table(spark, sf_dir, "companies")
    return to_documents(c, ["company_name", "about", "clients"], F.concat(F.lit("companies:truth:"), F.col("company_id").cast("string"))).select("id", "text")


@query("""WITH u AS (SELECT web_domain, about AS fact, 1 AS ord FROM companies WHERE about IS NOT NULL UNION SELECT web_domain, clients, 2 FROM companies WHERE clients IS NOT NULL)
SELECT web_domain, string_agg(fact, chr(10) ORDER BY ord, fact) AS text FROM u WHERE web_domain IS NOT NULL GROUP BY web_domain""")
def corpus_merge(spark, sf_dir):
    c = table(spark, sf_dir, "companies").where("web_domain IS NOT NULL")
    u = c.select("web_domain", F.col("about").alias("fact"), F.lit(1).alias("ord")).unionByName(c.select("web_domain", F.col("clients").alias("fact"), F.lit(2).alias("ord"))).where("fact IS NOT NULL").distinct()
    facts = F.sort_array(F.collect_list(F.struct("ord", "fact")))
    return u.groupBy("web_domain").agg(F.array_join(F.transform(facts, lambda x: x["fact"]), "\n").alias("text"))


@query("SELECT DISTINCT r.run_id, r.company FROM run_log r WHERE r.company IS NOT NULL AND NOT EXISTS (SELECT 1 FROM search_hits h WHERE h.web_domain = r.company)")
def unknown_references(spark, sf_dir):
    r = table(spark, sf_dir, "run_log").where("company IS NOT NULL").select("run_id", "company").distinct()
    return r.join(table(spark, sf_dir, "search_hits").select(F.col("web_domain").alias("company")), "company", "left_anti").select("run_id", "company")


@query("SELECT l.status, count(*) AS n FROM (SELECT coalesce(lower(status), 'none') AS status FROM run_log) l GROUP BY 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "run_log").groupBy(F.coalesce(F.lower("status"), F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query()
def parquet_checksum(spark, sf_dir):
    from ..sources.readers import checksums

    return checksums(spark, sf_dir)
