"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from loomwork.llm import budget, encode, language, leakage, mixing, mojibake, pii, prose, queries, reservoir, toxic

LONG = "The committee compared the plan with the older copy of the report. " * 4000
ROWS = [("a", None), ("b", ""), ("c", "  \n "), ("d", LONG), ("e", "Plain words stand here, and that is all."), ("e", "Plain words stand here, and that is all."), ("f", "#\u0000퟿😀"), (None, "No key at all, yet a text.")]
SCHEMA = "id string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns with the names of results
    extra = ["kind", "lang", "score", "tokens", "copies", "masked", "pii", "ids", "label"]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", F.lit("s").alias("source"), *[F.lit("x").alias(c) for c in extra])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([("en", w) for w in "the of and that is all a to in with".split()] + [("de", "der"), (None, None)], "lang string, word string")


RANKS = encode.read_ranks(queries.RANKS)


def test_pii(docs, none):
    assert pii.found_spans(docs).count() == 0
    assert pii.found_spans(none).count() == 0
    out = pii.masked(docs).collect()
    assert sorted(str(r.text) for r in out) == sorted(str(t) for _, t in ROWS)
    assert all(r.pii == {} for r in out)


def test_prose(docs, none, common):
    out = prose.verdicts(docs, common).collect()
    assert len(out) == len(ROWS)
    assert all(r.kind is None for r in out if r.id in ("a", "b", "c"))
    assert prose.verdicts(none, common).count() == 0
    stats = {r.id: r for r in prose.statistics(docs, common, F.lit("en")).collect()}
    assert stats["a"].words == 0 and stats["e"].words == 8 and stats["b"].common_words == 0.0


def test_toxic(docs, none):
    out = toxic.score(docs).collect()
    assert len(out) == len(ROWS) and all(r.score == 0 and not r.toxic for r in out)
    assert toxic.score(none).count() == 0
    assert toxic.rates(toxic.score(docs)).collect()[0].toxic_rate == 0


def test_sample(docs, none):
    assert reservoir.reservoir_sample(docs, 3).count() == 3
    assert reservoir.reservoir_sample(docs, 100).count() == len(ROWS)
    assert reservoir.reservoir_sample(docs, 0).count() == 0
    assert reservoir.reservoir_sample(none, 3).count() == 0


def test_leakage(docs, none, spark):
    items = spark.createDataFrame([(1, "plain words stand here and that is all"), (2, None), (3, ""), (4, LONG[:80]), (1, "plain words stand here and that is all")], "item_id long, text string")
    assert sorted(map(tuple, leakage.leaks(docs, items).collect())) == [("d", 4), ("e", 1)]
    assert leakage.leaks(none, items).count() == 0
    assert leakage.leaks(docs, items.limit(0)).count() == 0


def test_leakage_without_broadcast(docs, spark):
    items = spark.createDataFrame([(1, "plain words stand here and that is all")], "item_id long, text string")
    assert leakage.leaks(docs, items, broadcast_shingles=0).collect() == leakage.leaks(docs, items).collect()


def test_tokens(docs, none):
    out = budget.count_tokens(docs, "id", chunk=1000).collect()
    enc = budget.encoder(queries.RANKS)
    assert sorted(r.tokens for r in out) == sorted(len(enc.encode_ordinary(t)) if t else 0 for _, t in ROWS)
    assert budget.count_tokens(none, "id").count() == 0
    total = budget.totals(budget.count_tokens(docs, "id"), {"source": F.col("source")}).where("slice = 'all'").collect()
    assert total[0].docs == len(ROWS) and total[0].tokens == sum(r.tokens for r in out)
    assert budget.totals(budget.count_tokens(none, "id"), {"source": F.col("source")}).count() == 0


def test_language(docs, none):
    assert language.identify(docs, label=F.lit(None).cast("string")).count() == 0
    assert language.identify(none, label=F.col("lang")).count() == 0


def test_encode(docs, none):
    enc = budget.encoder(queries.RANKS)
    out = encode.encode(docs, RANKS).collect()
    assert sorted(map(str, (r.ids for r in out))) == sorted(str(enc.encode_ordinary(t) if t else []) for _, t in ROWS)
    assert encode.encode(none, RANKS).count() == 0


def test_mix(docs, none, spark):
    sized = budget.count_tokens(docs.where("id IS NOT NULL"), "id")
    targets = spark.createDataFrame([("s", 0.5, 2.0), ("t", 0.5, 1.0), (None, 0.1, 1.0)], "source string, target_share double, max_repeats double")
    mixed = mixing.mix(sized, targets, "id")
    assert {r.copies for r in mixed.collect()} == {2}
    report = {r.source: r for r in mixing.report(mixed, targets).collect()}
    assert report["s"].actual_share == 1.0 and report["t"].actual_share == 0.0
    assert mixing.mix(sized.limit(0), targets, "id").count() == 0


def test_mojibake(docs, none):
    assert mojibake.repaired(docs, "id").count() == 0
    assert mojibake.repaired(none, "id").count() == 0
