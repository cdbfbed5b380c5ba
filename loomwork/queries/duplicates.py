"""Exact and near duplicates, decontamination."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decontam, dedup
from ..registry import query
from ..session import checkpointed, table, texts

_KEY = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'), ' ')"
_EXACT = rf"""keyed AS (SELECT id, source, text, md5({_KEY}) AS key FROM docs),
firsts AS (SELECT key, min(id) AS first, arg_min(source, id) AS src FROM keyed WHERE key IS NOT NULL GROUP BY key),
labels AS (SELECT k.id, k.source, k.text, coalesce(f.first, k.id) AS first, CASE WHEN f.first IS NULL OR f.first = k.id THEN 'kept' WHEN f.src IS NOT DISTINCT FROM k.source THEN 'exact_dup' ELSE 'exact_dup_cross' END AS label
  FROM keyed k LEFT JOIN firsts f ON f.key = k.key)"""


@query(f"WITH {_EXACT} SELECT id, first, label FROM labels")
def exact_dedup(spark, sf_dir):
    return dedup.exact(texts(spark, sf_dir, "docs"), "id")


_SHINGLES = rf"""w AS (SELECT id, list_filter(string_split({_KEY}, ' '), lambda x: x <> '') AS w FROM KEPT WHERE length({_KEY}) > 0),
sh AS (SELECT id, list_distinct(list_transform(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END, lambda g: ('0x'||substr(md5(g), 1, 8))::BIGINT)) AS h FROM w)"""


@query(f"WITH {_SHINGLES.replace('KEPT', 'docs')} SELECT id, len(h) AS shingles, list_sum(h)::BIGINT AS hash_sum FROM sh")
def shingle_hashes(spark, sf_dir):
    docs = texts(spark, sf_dir, "docs").select("id", dedup.text_key(F.col("text")).alias("k")).where(F.length("k") > 0)
    hashed = docs.select("id", dedup.shingle_hashes(F.col("k")).alias("h"))
    return hashed.select("id", F.size("h").cast("long").alias("shingles"), F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x).alias("hash_sum"))


_A, _B = dedup.permutations(128, 1234)
_PERMS = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(zip(_A, _B)))
_SIGNED = rf"""{_SHINGLES}, perms(i, a, b) AS (VALUES {_PERMS}),
flat AS (SELECT id, unnest(h) AS x FROM sh),
sig AS (SELECT id, i, min((x * a + b) % {dedup.PRIME} & {dedup.MASK}) AS v FROM flat CROSS JOIN perms GROUP BY id, i)"""


@query(f"WITH {_SIGNED.replace('KEPT', 'docs')} SELECT id, sum(v)::BIGINT AS sig_sum, min(v) AS sig_min, sum(v * (i + 1) % 1000003)::BIGINT AS sig_check FROM sig GROUP BY id")
def minhash_signature(spark, sf_dir):
    s = dedup.signatures(texts(spark, sf_dir, "docs").select("id", "text"), "id")
    total = lambda f: F.aggregate(F.transform("sig", f), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("id", total(lambda x, i: x).alias("sig_sum"), F.array_min("sig").alias("sig_min"), total(lambda x, i: x * (i + 1) % 1000003).alias("sig_check"))


_PAIRS = rf"""{_EXACT}, firsts_only AS (SELECT id, text FROM labels WHERE label = 'kept'), {_SIGNED.replace('KEPT', 'firsts_only')},
bands AS (SELECT id, i // 4 AS band, list(v ORDER BY i) AS vs FROM sig GROUP BY ALL),
cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.vs = y.vs AND x.id < y.id),
pairs AS (SELECT a, b, count(*) FILTER (s.v = t.v) / 128 AS similarity FROM cand JOIN sig s ON s.id = a JOIN sig t ON t.id = b AND t.i = s.i GROUP BY a, b HAVING count(*) FILTER (s.v = t.v) / 128 >= 0.8)"""


def _signed(spark, sf_dir):
    docs = texts(spark, sf_dir, "docs").select("id", "text", "source")
    firsts = docs.join(dedup.exact(docs, "id").where("label = 'kept'").select("id"), "id", "left_semi")
    return checkpointed(dedup.signatures(firsts, "id"))


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def near_pairs(spark, sf_dir):
    """Pairs between representatives of exact copies; exact_dedup has the membership."""
    return dedup.near_pairs(_signed(spark, sf_dir), "id").withColumn("similarity", F.round("similarity", 6))


# the walk in input order, which the rounds must agree with
_WALK = f"""WITH RECURSIVE {_PAIRS}, nodes AS (SELECT d, row_number() OVER (ORDER BY d) AS n, list_filter(list(nb), lambda x: x IS NOT NULL) AS nbs FROM (SELECT b AS d, a AS nb FROM pairs UNION ALL SELECT a, NULL FROM pairs) GROUP BY d),
walk(n, kept) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT w.n + 1, CASE WHEN list_has_any(w.kept, x.nbs) THEN w.kept ELSE list_append(w.kept, x.d) END FROM walk w JOIN nodes x ON x.n = w.n + 1),
last AS (SELECT kept FROM walk ORDER BY n DESC LIMIT 1),
gone AS (SELECT d AS id, list_min(list_intersect(nbs, kept)) AS near FROM nodes, last WHERE NOT list_contains(kept, d))"""


@query(f"{_WALK} SELECT id, near FROM gone")
def near_dup_dropped(spark, sf_dir):
    return dedup.keep_near(_signed(spark, sf_dir), "id").select(F.col("d").alias("id"), "near")


@query(f"""{_WALK} SELECT l.id, CASE WHEN g.near IS NULL THEN l.label WHEN n.source IS NOT DISTINCT FROM l.source THEN 'near_dup' ELSE 'near_dup_cross' END AS label, coalesce(g.near, l.first) AS first
FROM labels l LEFT JOIN gone g ON g.id = l.id LEFT JOIN docs n ON n.id = g.near""")
def near_dedup(spark, sf_dir):
    return dedup.near(texts(spark, sf_dir, "docs").select("id", "text", "source"), "id")


_GRAMS = """iw AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+', 0) AS w FROM benchmark),
ig AS (SELECT DISTINCT array_to_string(w[i:i+12], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM iw) UNION SELECT array_to_string(w, ' ') FROM iw WHERE len(w) BETWEEN 8 AND 12),
sizes AS (SELECT DISTINCT len(string_split(g, ' ')) AS s FROM ig),
dw AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+', 0) AS w FROM docs),
dg AS (SELECT DISTINCT id, array_to_string(w[i:i+s-1], ' ') AS g FROM (SELECT id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM dw CROSS JOIN sizes)),
hits AS (SELECT id, count(*) AS shared_grams FROM dg SEMI JOIN ig ON dg.g = ig.g GROUP BY id)"""


@query(f"WITH {_GRAMS} SELECT id, shared_grams FROM hits")
def decontam_hits(spark, sf_dir):
    return decontam.hits(texts(spark, sf_dir, "docs").select("id", "text"), table(spark, sf_dir, "benchmark"), "id")


@query(f"WITH {_GRAMS} SELECT id, source FROM docs ANTI JOIN hits USING (id)")
def decontam_keep(spark, sf_dir):
    return decontam.clean(texts(spark, sf_dir, "docs"), table(spark, sf_dir, "benchmark"), "id").select("id", "source")


@query(f"WITH {_GRAMS} SELECT count(*) AS grams, count(*) FILTER (len(string_split(g, ' ')) < 13) AS short_items FROM ig")
def decontam_index(spark, sf_dir):
    return decontam.item_grams(table(spark, sf_dir, "benchmark")).agg(F.count(F.lit(1)).alias("grams"), F.count(F.when(F.col("size") < 13, 1)).alias("short_items"))
