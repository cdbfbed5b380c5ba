"""Agreement and selection among candidates, calibration and accuracy."""

from pyspark.sql import functions as F

from ..operators import agree, evaluate
from ..registry import query
from ..session import table

_CANON = r"trim(regexp_replace(regexp_replace(lower(output_text), '[^\p{L}\p{N}_\s%.\-]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


@query(f"SELECT unit_id, cand_index, {_CANON} AS canonical FROM candidates")
def canonical_text(spark, sf_dir):
    return table(spark, sf_dir, "candidates").select("unit_id", "cand_index", agree.canonical(F.col("output_text")).alias("canonical"))


@query(f"SELECT unit_id, cand_index, min(cand_index) OVER (PARTITION BY unit_id, {_CANON}) AS leader FROM candidates")
def label_clusters(spark, sf_dir):
    return agree.label_clusters(table(spark, sf_dir, "candidates"), "unit_id", "cand_index", agree.canonical(F.col("output_text"))).select("unit_id", "cand_index", "leader")


@query()
def leader_clusters(spark, sf_dir):
    return agree.leader_clusters(table(spark, sf_dir, "candidates"), "unit_id", "cand_index", "output_text")


@query()
def soft_item_overlap(spark, sf_dir):
    return table(spark, sf_dir, "companies").select("company_id", agree.soft_jaccard("services", "products").alias("overlap"))


_VC = "list_sum(list_transform(confidences, lambda c: ln(greatest(0.001, least(100.0, coalesce(c, mean))) / 100)))"
_SCORED = f"""m AS (SELECT *, coalesce(list_avg(list_filter(confidences, lambda c: c IS NOT NULL)), 50.0) AS mean FROM candidates),
v AS (SELECT *, coalesce({_VC}, 0) AS vc, coalesce(list_sum(step_tokens), 0)::BIGINT AS toks FROM m)"""


@query(f"WITH {_SCORED} SELECT unit_id, cand_index, round(vc, 4) AS vc, toks AS tokens FROM v")
def candidate_confidence(spark, sf_dir):
    return table(spark, sf_dir, "candidates").select("unit_id", "cand_index", F.round(agree.confidence(F.col("confidences")), 4).alias("vc"), F.aggregate("step_tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("tokens"))


_SELECT = f"""{_SCORED}, s AS (SELECT unit_id, cand_index, is_valid, cluster_no, round(CASE WHEN vc = 0 THEN -1.0 ELSE vc END * CASE WHEN toks = 0 THEN 1 ELSE toks END, 4) AS score, round(mean, 4) AS mean, length(output_text) AS len FROM v),
k AS (SELECT unit_id, count(*) AS k, count(*) FILTER (is_valid) AS valid FROM s GROUP BY unit_id),
c AS (SELECT *, count(*) OVER (PARTITION BY unit_id, cluster_no) AS votes FROM s WHERE is_valid AND cluster_no IS NOT NULL),
w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY votes DESC, score DESC, mean DESC, len, cand_index) = 1)
"""
_CHOSEN = "SELECT k.unit_id, w.cand_index AS selected, w.cluster_no AS cluster, round(votes / k, 4) AS p_hat, coalesce(votes = 1 AND valid > 1, false) AS low_agreement, score AS best_score FROM k LEFT JOIN w ON w.unit_id = k.unit_id"


@query(f"WITH {_SELECT} {_CHOSEN}")
def select_plurality(spark, sf_dir):
    return agree.selection(table(spark, sf_dir, "candidates"))


@query(f"WITH {_SELECT}, ch AS ({_CHOSEN}) SELECT unit_id FROM ch WHERE selected IS NULL OR (best_score < -500 AND p_hat < 0.5)")
def needs_retry(spark, sf_dir):
    chosen = agree.selection(table(spark, sf_dir, "candidates"))
    return chosen.where(F.col("selected").isNull() | ((F.col("best_score") < -500) & (F.col("p_hat") < 0.5))).select("unit_id")


_EDGES = ", ".join(repr(e) for e in evaluate.EDGES[1:-1])
_BINS = f"""b AS (SELECT conf / 100 AS c, correct, 1 + len(list_filter([{_EDGES}], lambda e: conf / 100 >= e)) AS bin FROM (SELECT meta.conf AS conf, meta.correct AS correct FROM sft_examples) WHERE conf IS NOT NULL AND correct IS NOT NULL),
r AS (SELECT bin, count(*) AS n, avg(c) AS conf, avg(correct) AS acc FROM b GROUP BY bin)"""


@query(f"WITH {_BINS} SELECT bin::INT AS bin, n, round(conf, 4) AS conf, round(acc, 4) AS acc FROM r")
def calibration_curve(spark, sf_dir):
    rows = table(spark, sf_dir, "sft_examples").select((F.col("meta.conf") / 100).alias("conf"), F.col("meta.correct").alias("correct"))
    return evaluate.curve(rows).select("bin", "n", F.round("conf", 4).alias("conf"), F.round("acc", 4).alias("acc"))


@query(f"WITH {_BINS} SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, (SELECT round(avg((c - correct) ** 2), 6) FROM b) AS brier FROM r")
def calibration_error(spark, sf_dir):
    rows = table(spark, sf_dir, "sft_examples").select((F.col("meta.conf") / 100).alias("conf"), F.col("meta.correct").alias("correct"))
    return evaluate.errors(rows).select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query("""WITH t AS (SELECT company_id, list_distinct(list_filter(services, lambda x: x IS NOT NULL)) AS a, list_distinct(list_filter(products, lambda x: x IS NOT NULL)) AS b FROM companies WHERE services IS NOT NULL AND products IS NOT NULL),
u AS (SELECT company_id, len(list_intersect(a, b)) AS hit, len(a) AS n, len(b) AS m FROM t)
SELECT company_id, round(CASE WHEN n = 0 THEN 0 ELSE hit / n END, 6) AS precision, round(CASE WHEN m = 0 THEN 0 ELSE hit / m END, 6) AS recall, round(CASE WHEN n + m = 0 THEN 0 ELSE 2 * hit / (n + m) END, 6) AS f1 FROM u""")
def set_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "companies").where("services IS NOT NULL AND products IS NOT NULL").select("company_id", F.array_compact("services").alias("a"), F.array_compact("products").alias("b"))
    return evaluate.set_scores(rows, "company_id", "a", "b")


@query("""SELECT meta.task AS task, count(*) AS n, round(avg(meta.correct), 6) AS correct, round(avg(meta.is_valid::INT), 6) AS valid, round(avg(meta.conf), 6) AS conf, count(*) FILTER (meta.step_error) AS errors FROM sft_examples GROUP BY meta.task""")
def variant_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "sft_examples").select("meta.*")
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), mean("correct").alias("correct"), mean("is_valid").alias("valid"), mean("conf").alias("conf"), F.count(F.when(F.col("step_error"), 1)).alias("errors"))
