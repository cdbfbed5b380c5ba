"""Core operators on small tables, with the cases that the tables at hand do not have."""

import glob
import json
import os
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork import config
from loomwork.functions import text as T
from loomwork.operators import agree, curate, decontam, dedup, evaluate, logs, ngram_models, records, retrieve, training, web
from loomwork.plans import funnel
from loomwork.queries import oracle_sql, queries
from loomwork.session import checkpointed
from loomwork.sources import readers, sinks
from loomwork.streaming import curation as stream

SF = "/root/testdata/sf0.001"


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).collect()[0].x


def _value(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_like_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr([_value(r[c]) for c in columns]) for r in df.collect())
    rel = con.sql(oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(repr([_value(r[i]) for i in at]) for r in rel.fetchall())


def test_normalized(spark):
    page = "<html><body><nav>Home | About</nav><p>First   line.</p><script>x()</script><footer>All rights reserved</footer></body></html>"
    assert _one(spark, page, curate.normalized(F.col("text"))) == "First line."
    assert _one(spark, "a​b\u0007\n\n\n\nc", curate.normalized(F.col("text"))) == "ab\n\nc"
    assert _one(spark, None, curate.normalized(F.col("text"))) is None


def test_main_text():
    page = "<body><header>x</header><div class='cookie-box'>ok?</div><main><p>One.</p><ul><li>Two</li></ul></main><aside>no</aside></body>"
    assert curate.main_text(page) == "One.\nTwo"
    assert curate.main_text("<p>a<b>b") == "a\nb" and curate.main_text(None) is None


def test_quality_reasons(spark):
    good = "The committee has seen that the report is good and it was sent to all of the members in the town. " * 4
    lines = "\n".join(["The same line of the text is here again and again for all to see and to read."] * 6)
    rows = [("good", good + "Another thing was said by them about this. " * 1), ("short", "too short"), ("null", None), ("symbols", "#$%&" * 100), ("digits", "12 words 3456 " * 40), ("lines", lines)]
    out = {r.k: r.reason for r in curate.quality_reason(spark.createDataFrame(rows, "k string, text string"), "k").collect()}
    assert out["short"] == out["null"] == "too_short" and out["symbols"] == "symbol_ratio" and out["digits"] == "digit_ratio" and out["lines"] == "dup_lines"


def test_masks(spark):
    text = "Mail a.b@c.example, SSN 123-45-6789, card 4539 5787 6362 1486, not 4539 5787 6362 1487 0000 1, host 10.0.0.1, in 1999, 12 Old Mill Road, call 555 123 4567 8."
    out = _one(spark, text, curate.masked(F.col("text")))
    assert all(tag in out for tag in ("<EMAIL>", "<ID>", "<CARD>", "<IP>", "<ADDRESS>")) and "1999" in out
    counts = spark.createDataFrame([(out,)], "text string").select(curate.mask_counts(F.col("text")).alias("c")).collect()[0].c
    assert counts["<EMAIL>"] == 1 and "<IBAN>" not in counts


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(1, base, "a"), (2, base.replace("word60", "other"), "b"), (3, " ".join(f"else{i}" for i in range(100)), "a"), (4, base + "  ", "c"), (5, None, "a"), (6, None, "a"), (7, "", "a")]
    out = {r.doc_id: (r.label, r.first) for r in dedup.near(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id").collect()}
    assert out[2] == ("near_dup_cross", 1) and out[4] == ("exact_dup_cross", 1)
    assert all(out[k][0] == "kept" for k in (1, 3, 5, 6, 7))


def test_keep_rule_is_ordered(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 9), (8, 9)], "a long, b long")
    assert sorted(map(tuple, dedup.keep_first(chain).collect())) == [(2, 1), (4, 3), (9, 7)]
    assert dedup.keep_first(chain.limit(0)).count() == 0


def test_order_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/docs.parquet").select("id", "text", "source")
    a = sorted(map(tuple, dedup.exact(docs.repartition(1), "id").collect()), key=str)
    assert a == sorted(map(tuple, dedup.exact(docs.repartition(17), "id").collect()), key=str)


def test_decontam(spark):
    words = [f"x{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:30])), (2, "nine short words make one small item right here"), (3, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before, " + " ".join(words[5:20]) + " after."), (2, "Say: Nine short words make one small item, right here!"), (3, " ".join(words[:12])), (4, "too short"), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontam.hits(docs, items, "doc_id").collect()) == [1, 2]
    assert sorted(r.doc_id for r in decontam.clean(docs, items, "doc_id").collect()) == [3, 4, 5]


def test_bm25(spark):
    p = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta"), (4, None)], "id long, text string")
    q = spark.createDataFrame([("q", "beta alpha")], "q string, query string")
    assert [r.id for r in retrieve.bm25(p, q, "id", "q", 5).orderBy("rank").collect()] == [1, 2]


def test_clusters_and_selection(spark):
    c = spark.createDataFrame([("u", 0, "alpha beta gamma"), ("u", 1, "alpha beta gamma delta"), ("u", 2, "other words here"), ("u", 3, None)], "unit string, i int, out string")
    assert {r.i: r.leader for r in agree.leader_clusters(c, "unit", "i", "out").collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    rows = [("u", 0, "aa", True, [90.0, None], [1, 1], 1), ("u", 1, "b", True, [80.0, 70.0], [1, 1], 1), ("u", 2, "c", True, [99.0], [1], 2), ("v", 0, "x", False, [50.0], [3], None)]
    s = {r.unit_id: r for r in agree.selection(spark.createDataFrame(rows, "unit_id string, cand_index int, output_text string, is_valid boolean, confidences array<double>, step_tokens array<int>, cluster_no int")).collect()}
    assert s["u"].selected == 0 and s["u"].p_hat == round(2 / 3, 4) and s["v"].selected is None


def test_calibration(spark):
    rows = spark.createDataFrame([(0.95, 1.0), (0.95, 0.0), (0.1, 0.0), (0.3, 0.0), (None, 1.0)], "conf double, correct double")
    assert {r.bin: r.n for r in evaluate.curve(rows).collect()} == {10: 2, 2: 1, 3: 1}


def test_shards(spark):
    docs = spark.createDataFrame([(i, "train" if i % 5 else "val", 30 + i % 7) for i in range(200)], "doc_id long, split string, tokens long")
    got = {(r.split, r.doc_id): r.shard for r in training.shard_numbers(docs, "doc_id", "split", "tokens", 100).collect()}
    for split in ("train", "val"):
        shard, filled = 0, 0
        for i in sorted(d for s, d in got if s == split):
            assert got[split, i] == shard
            filled += 30 + i % 7
            if filled >= 100:
                shard, filled = shard + 1, 0


def test_token_shards(spark, tmp_path):
    docs = spark.createDataFrame([(1, "train", 0, [5, 6]), (2, "train", 0, [7]), (3, "val", 0, [])], "doc_id long, split string, shard int, ids array<int>")
    out = {r.split: r for r in sinks.token_shards(docs, str(tmp_path / "s"), 1, 2, 50_000).collect()}
    assert out["train"].tokens == 7 and out["val"].tokens == 2
    content = spark.read.parquet(str(tmp_path / "s")).where("split = 'train'").collect()[0].content
    assert list(sinks.read_shard(bytes(content), 50_000)) == [1, 5, 6, 2, 1, 7, 2]


def test_steps(spark):
    raw = 'Think.\n```python\na = 1\n```\nMore\n```python\nb = 2\n```\n```json\n{"confidence": 88.5}\n```'
    assert _one(spark, raw, training.step_code(F.col("text"))) == "b = 2\n"
    assert _one(spark, raw, training.step_confidence(F.col("text"))) == 88.5
    assert _one(spark, "confidence: 0", training.step_confidence(F.col("text"))) is None


def test_web(spark):
    url = "https://link.example/out?u=https%3A%2F%2Fwww.firm.example%2Fabout&x=1"
    assert _one(spark, url, web.domain(web.unwrapped(F.col("text")))) == "firm.example"
    page = '<html lang="en-GB"><title> A b </title><a href="/about">x</a><a href="mailto:x@y">m</a><a href="/about#t">y</a>'
    assert _one(spark, page, web.title(F.col("text"))) == "A b" and _one(spark, page, web.links(F.col("text"))) == ["/about"]
    hits = spark.createDataFrame([("a", 1, "s1"), ("a", 2, "s2"), ("b", 1, "s1"), ("b", 2, "s3"), ("b", 3, None)], "bucket string, n int, site string")
    assert [r.site for r in web.round_robin(hits, ["bucket"], ["n"], "site", 10).collect()] == ["s1", "s2", "s3"]


def test_chunks(spark):
    assert _one(spark, "ab\ncd\nefghij", logs.message_chunks(F.col("text"), 5)) == ["ab\ncd", "efghi", "j"]
    assert _one(spark, "x" * 30, logs.shortened(F.col("text"), 10)) == "x" * 10 + "...[+20 chars]"
    assert _one(spark, "One. Two.\n\nThree.", retrieve.passages(F.col("text"), 10)) == ["One. Two.", "Three."]


def test_readers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "title;body\nA;one, two\nB;\n")
        z.writestr("y.xml", "<r><title>C</title><body>old</body><body>new</body></r>")
        z.writestr("z.xml", "<broken>")
    rows = readers.zipped_csv(spark, str(tmp_path / "a.zip"), ["title", "body"]).collect()
    assert [tuple(r) for r in rows] == [("A", "one, two"), ("B", "")]
    xml = readers.zipped_xml(spark, str(tmp_path / "a.zip"), ["title", "body"])
    assert [tuple(r) for r in xml.collect()] == [("C", "new")]
    (tmp_path / "l.jsonl").write_text('{"a": "x"}\nnot json\n{"a": "y"}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a string").collect()) == ["x", "y"]
    (tmp_path / "d.json").write_text(json.dumps([{"a": "1"}, {"a": "2"}]))
    assert readers.json_document(spark, str(tmp_path / "d.json"), "a string").count() == 2
    docs = readers.to_documents(xml, ["title", "body"], F.lit("zip:y:0"))
    assert docs.collect()[0].text == "C\n\nnew"
    assert len(readers.checksums(spark, str(tmp_path / "d.json")).collect()[0].sha256) == 64


def test_config(monkeypatch):
    monkeypatch.setenv("LOOMWORK__MIN_CHARS", "7")
    assert config.load({"max_chars": 9}).min_chars == 7
    with pytest.raises(ValueError):
        config.load({"nothing": 1})


def test_funnel_adds_up(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    result = funnel.curate_all(docs, items)
    by = {r.stage: r for r in result.report().groupBy("stage").agg(F.sum("docs_in").alias("i"), F.sum("docs_out").alias("o")).collect()}
    stages = ["normalize", "language", "quality", "dedup", "mask", "decontaminate"]
    assert by["normalize"].i == docs.count()
    assert all(by[a].o == by[b].i for a, b in zip(stages, stages[1:]))
    assert result.documents.count() == by["decontaminate"].o


def test_streams(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/run_log.parquet")
    log.write.parquet(str(tmp_path / "in"))
    counts = stream.event_counts(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM counts").collect()[0].n == log.count()


def test_near_duplicate_batches(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    first = spark.createDataFrame([(1, text), (2, "quite another text with many different words in it")], "doc_id long, text string")
    second = spark.createDataFrame([(3, text.replace("w40", "zz")), (4, "and again something new that was never seen before")], "doc_id long, text string")
    assert sorted(r.doc_id for r in stream.near_duplicates(first, str(tmp_path / "ix"), "doc_id").collect()) == [1, 2]
    assert sorted(r.doc_id for r in stream.near_duplicates(second, str(tmp_path / "ix"), "doc_id").collect()) == [4]


def test_text_functions(spark):
    assert _one(spark, "a b c", T.ngrams(T.tokens(F.col("text")), 2)) == ["a b", "b c"]
    assert _one(spark, "a", T.ngrams(T.tokens(F.col("text")), 2)) == []


def test_language_models_take_whole_texts(spark):
    docs = spark.createDataFrame([("x", "abc " * 1000 + "xyz " * 3000, None), ("a", "abc", "aa"), ("b", "xyz", "bb")], "doc_id string, text string, lang string")
    model = ngram_models.train_languages(docs.where("lang IS NOT NULL"))
    told = {r.doc_id: r.lang for r in ngram_models.predict_languages(ngram_models.score_languages(docs, model, "doc_id"), "doc_id").collect()}
    assert told == {"x": "bb", "a": "aa", "b": "bb"}
    counted = ngram_models.train_languages(docs.where("doc_id = 'x'").withColumn("lang", F.lit("cc")))
    assert {r.gram: r.n for r in counted.collect()}["xyz"] == 3000
    scored = {r.doc_id: r for r in ngram_models.Trigrams(docs, "doc_id").perplexity(docs, "doc_id").collect()}
    assert scored["x"].tokens == 4001 and scored["a"].tokens == 2


def test_keep_rule_reaches_the_end_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 241)], "a long, b long").coalesce(1)
    assert sorted(map(tuple, dedup.keep_first(chain).collect())) == [(i, i - 1) for i in range(2, 242, 2)]


def test_keep_rule_by_rounds_like_by_walk(spark):
    pairs = [(f"{a:03d}", f"{b:03d}") for a in range(60) for b in range(a + 1, 60) if (a * 7 + b * 13) % 17 == 0]
    edges = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    dropped = {}
    for b in sorted({b for _, b in pairs}):
        if near := [a for a, y in pairs if y == b and a not in dropped]:
            dropped[b] = min(near)
    for walked in (0, 100_000):
        assert sorted(map(tuple, dedup.keep_first(edges, walked).collect())) == sorted(dropped.items())


def test_funnel_repairs_tells_languages_and_rates_perplexity(spark):
    en, ru = "The report was sent to all of the members in the town. ", "Отчёт был отправлен всем жителям этого города вчера. "
    rows = [("a", "s", en, "en"), ("b", "s", ru * 3, "ru"), ("c", "s", en * 3, "en"), ("d", "s", ru * 3, "ru"), ("e", "s", ru, None), ("f", "s", en, "ru"), ("g", "s", "The cafÃ© of ﬁve members", "en")]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string, lang string")
    steps = dict(funnel.curate_steps(docs, docs.limit(0), config.Curation()))
    assert {r.doc_id: r.text for r in steps["normalize"](docs).collect()}["g"] == "The café of five members"
    told = {r.doc_id: r.reason for r in steps["language"](docs).collect()}
    assert told["e"] == "lang_ru" and told["f"] == told["a"] == "kept"
    assert {r.reason for r in steps["language"](docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"kept"}
    good = "The committee has seen that the report is good and it was sent to all of the members in the town. "
    other = " ".join(f"the {''.join(chr(97 + (i * k + k) % 26) for k in range(1, 8))} of" for i in range(40))
    texts = spark.createDataFrame([(f"k{i}", "s", good + good.replace("report", "paper of the year") + "Another thing was said by them about this one.", "en") for i in range(20)] + [("odd", "s", other, "en")], docs.schema)
    for most, reason in ((2.0, "perplexity"), (1e9, "kept")):
        step = dict(funnel.curate_steps(texts, texts.limit(0), config.Curation(max_perplexity=most, max_ngram_ratio=1.0)))["quality"]
        out = {r.doc_id: r.reason for r in step(texts).collect()}
        assert out["odd"] == reason and out["k1"] == "kept"


def _edges(signed, order):
    rows = {r[order]: r.sig for r in signed.collect()}
    return {(a, b) for a in rows for b in rows if a < b and sum(x == y for x, y in zip(rows[a], rows[b])) / len(rows[a]) >= 0.8}


def test_keep_near_like_the_walk(spark):
    import random

    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(60):
        base = random.Random(i // 12).choices(words, k=60)
        for _ in range(random.choice([0, 1, 2, 6])):
            base[random.randrange(60)] = random.choice(words)
        texts.append((i, " ".join(base)))
    signed = dedup.signatures(spark.createDataFrame(texts, "id long, text string"), "id")
    edges = _edges(signed, "id")
    kept, near = [], {}
    for i in range(60):
        mine = [a for a in kept if (a, i) in edges]
        if mine:
            near[i] = min(mine)
        else:
            kept.append(i)
    assert near
    for most in (0.0, 0.5, 1e9):
        assert {r.d: r.near for r in dedup.keep_near(signed, "id", pairs_per_entry=most).collect()} == near


def test_many_near_copies_stay_linear(spark, monkeypatch):
    base = " ".join(f"word{i}" for i in range(300))
    docs = spark.range(0, 5000, 1, 8).selectExpr("id", f"concat('{base} tail', id) AS text")
    compared = []
    real = dedup.verified
    monkeypatch.setattr(dedup, "verified", lambda candidates, *rest: (compared.append(candidates.count()), real(candidates, *rest))[1])
    dropped = dedup.keep_near(dedup.signatures(docs, "id"), "id").collect()
    assert len(dropped) > 4900 and sum(compared) < 20 * 5000


def test_stream_keeps_what_came_first(spark, tmp_path):
    a = "the quick brown fox jumps over the lazy dog and runs away from the old farm house in the evening rain"
    index = str(tmp_path / "index")
    one = stream.near_duplicates(spark.createDataFrame([(5, a)], "id long, text string"), index, "id")
    assert [r.id for r in one.collect()] == [5]
    # a smaller key that comes later is the copy
    two = stream.near_duplicates(spark.createDataFrame([(1, a + " again"), (2, "some quite different words stand in this other text of the batch")], "id long, text string"), index, "id")
    assert [r.id for r in two.collect()] == [2]


def test_masks_are_bounded(spark):
    for text in ("x123-45-67890", "ab12345-67-8901", "1.2.3.4.5.6.77777", "A12 Old Mill Roads", "GB82WEST1234569876543211234567890123456789"):
        out = _one(spark, text, curate.masked(F.col("text")))
        assert "<ID>" not in out and "<ADDRESS>" not in out and "<IBAN>" not in out, out
    out = _one(spark, "IBAN GB82 WEST 1234 5698 7654 32, tel. (0123) 456 78901 or +49 221 4710 788, 12 Old Mill Rd.", curate.masked(F.col("text")))
    assert out == "IBAN <IBAN>, tel. <PHONE> or <PHONE>, <ADDRESS>"


def test_reread_whole_or_runs():
    assert curate.reread_text("CafÃ© â€“ dÃ©jÃ\xa0 vu") == "Café – déjà vu"
    # what cannot be read as a whole is read run by run
    assert curate.reread_text("CafÃ© 東京") == "Café 東京" and curate.reread_text("plain") == "plain"


def test_links_and_crawl(spark):
    base = "https://firm.example/en/index.html"
    page = '<meta name="description" content="We build."><a href="/about#x">a</a><a href="services/">b</a><a href="//firm.example/p.pdf">c</a><a href="https://other.example/">d</a><a href="/about">e</a><a href="mailto:a@b">f</a>'
    got = _one(spark, page, web.site_links(F.col("text"), F.lit(base)))
    assert got == ["https://firm.example/about", "https://firm.example/en/services/"]
    assert _one(spark, page, web.description(F.col("text"))) == "We build."
    pages = spark.createDataFrame([(base, page + "<p>Home page text.</p>"), ("https://firm.example/about", "<p>" + "We have been here for a long time. " * 3 + "</p>"), ("https://firm.example/en/services/", "<p>short</p>")], "url string, html string")
    homes = spark.createDataFrame([(base,), ("https://gone.example/",)], "url string")
    assert {r.url for r in web.crawled(pages, homes).collect()} == {base, "https://firm.example/about"}


def test_canonical_json_and_grounding(spark):
    assert _one(spark, '{"B": [1.23456, "X  y!"], "a": null}', agree.canonical_json("text")) == '{"a": null, "b": [1.2346, "x y"]}'
    assert _one(spark, "{broken", agree.canonical_json("text")) is None
    source = F.lit("The plant in Velmere employs 120 people and sells pumps.")
    assert _one(spark, "the PLANT in Velmere", agree.supported(F.col("text"), source)) and not _one(spark, "A bridge in Ostrand", agree.supported(F.col("text"), source))
    assert _one(spark, "It employs 130 people in Ostrand.", agree.unknown_details(F.col("text"), source)) == ["130", "Ostrand"]


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a").mkdir()
    (tmp_path / "b" / "docs.jsonl").write_text('{"t": "3"}\n')
    (tmp_path / "a" / "docs.jsonl").write_text('{"t": "1"}\nbroken\n{"t": "2"}\n')
    assert [(r.ord, r.t) for r in readers.ordered_lines(spark, str(tmp_path / "*" / "docs.jsonl"), "t string").orderBy("ord").collect()] == [(1, "1"), (2, "2"), (3, "3")]
    records_ = spark.createDataFrame([(1, "x"), (2, ""), (3, "y"), (4, "z")], "n long, t string")
    assert [r.id for r in readers.indexed_documents(records_, ["t"], "set", "f", ["n"], 2).collect()] == ["set:f:0", "set:f:2"]
    import hashlib

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.bin").write_bytes(b"abc")
    (tmp_path / "c" / "x.bin.sha256").write_text(hashlib.sha256(b"abc").hexdigest() + "  x.bin\n")
    assert [r.ok for r in readers.verified(spark, str(tmp_path / "c")).collect()] == [True]
    log = spark.read.parquet(f"{SF}/run_log.parquet")
    sinks.event_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() >= log.count()
    sinks.state({"a": 1}, str(tmp_path / "state.json"))
    assert json.loads((tmp_path / "state.json").read_text()) == {"a": 1}


def test_language_model_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two three four"), ("b", "one two five")], "doc_id string, text string")
    model = ngram_models.Trigrams(docs, "doc_id")
    model.save(str(tmp_path / "lm"))
    again = ngram_models.Trigrams.load(spark, str(tmp_path / "lm"))
    score = lambda m: sorted((r.doc_id, round(r.perplexity, 6)) for r in m.perplexity(docs, "doc_id").collect())
    assert score(again) == score(model)


def test_report_before_and_after(spark, tmp_path):
    rows = spark.createDataFrame([("normalize", "s", "kept", 10), ("normalize", "s", "kept", 5), ("language", "s", "lang_de", 10), ("language", "s", "kept", 5)], "stage string, source string, reason string, chars int")
    as_json, as_text = sinks.combined_report(funnel.report(rows))
    assert json.loads(as_json)["sources"] == [{"source": "s", "docs_in": 2, "docs_out": 1, "chars_in": 15, "chars_out": 5}] and "| s |" in as_text
    sinks.stage_output(funnel.report(rows), rows, str(tmp_path))
    assert spark.read.json(str(tmp_path / "stats")).count() == 2


def test_stream_windows(spark):
    log = spark.createDataFrame([("r", "ok", "2025-01-01 00:05:00"), ("r", "ok", "2025-01-01 00:12:00"), ("r", "OK", "2025-01-01 01:30:00"), ("q", "ok", "2025-01-01 00:06:00")], "run_id string, status string, logged_at string")
    assert sorted(r.n for r in stream.sessions(log).collect()) == [1, 1, 2]
    assert sum(r.n for r in stream.event_counts(log, size="1 hour", slide="30 minutes").collect()) == 2 * log.count()


def test_range_join_has_a_row_for_each_value_and_no_frame_to_the_end(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(records, "checkpointed", lambda df: sizes.append((held := checkpointed(df)).count()) or held)
    values = [None, -1.0, 0.0, 5.0, 5.5, 6.0, 7.0, 40.0, 41.0, float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(i, 5.0) for i in range(10, 3000)], "id long, v double")
    limits = [(0, "a"), (6, "b"), (40, "c"), (None, "d")]
    bands = spark.createDataFrame(limits, "most int, band string")
    expected = {i: min(((m, b) for m, b in limits if m is not None and v is not None and m >= v), default=(0, None))[1] for i, v in enumerate(values)}
    for most in (100_000, 0):
        monkeypatch.setattr(records, "SENT_VALUES", most)
        joined = records.range_joined(rows, "v", bands, "most")
        assert sizes.pop() == 12
        assert joined.columns == ["id", "v", "band"]
        out = joined.collect()
        assert len(out) == 3000 and {r.id: r.band for r in out} == expected | {i: "b" for i in range(10, 3000)}
        assert "unboundedfollowing" not in joined._jdf.queryExecution().toString().lower()
    apart = spark.range(2000).select((F.col("id") % 997 + 0.5).alias("v"), "id")
    every = spark.range(0, 900, 7).select(F.col("id").alias("most"), F.col("id").alias("band"))
    assert {(r.v, r.band) for r in records.range_joined(apart, "v", every, "most").collect()} == {(i + 0.5, b if (b := -(-(i + 1) // 7) * 7) < 900 else None) for i in range(997)}


def _many_words(n, ends):
    """n different words of letters with one of the endings."""
    return [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{ends[i % len(ends)]}" for i in range(n)]


def test_language_scorer_with_more_words_than_it_keeps():
    grams = {g: i for i, g in enumerate(sorted({f" {w} "[i : i + 3] for w in _many_words(9000, ("ing", "ung")) for i in range(len(w))}))}
    gains = np.array([[i % 7 / 7, i % 5 / 5] for i in range(len(grams))])
    made = lambda: ngram_models.RowScorer(grams, gains, ["de", "en"], [-9.0, -9.0], {})
    words = _many_words(9000, ("ing", "ung"))
    texts = [" ".join(words), " ".join(words[:50]), " ".join(words[6000:]), " ".join(words[:50]), ""]

    def plain(text):
        total = np.zeros(2)
        for w in text.split():
            total += sum(gains[grams[f" {w} "[i : i + 3]]] for i in range(len(w))) - 9.0 * len(w)
        return total

    for most in (300_000, 100):
        scorer = made()
        scorer.most = most
        for text in texts:
            total = plain(text)
            lang, p = scorer.language(text)
            assert lang == ("de" if total[0] > total[1] else "en")
            assert p == pytest.approx(1 / np.exp(np.maximum(-50.0, total - total.max())).sum())


def _many_word_tables(spark, folder):
    """A scale folder whose documents hold more different words than the scorer has places at first, in one text."""
    de, en = " ".join(_many_words(6000, ("ung", "heit"))), " ".join(_many_words(6000, ("ing", "ness")))
    rows = [(1, de, "de", "s", "a"), (2, en, "en", "s", "b"), (3, de[:3000], None, "s", "c"), (4, en[:3000], None, "s", "d"), (5, None, None, "s", "e")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, site string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("de", "und"), ("en", "and")], "lang string, word string").write.parquet(f"{folder}/common_words.parquet")
    return str(folder)


def _like_sql(spark, folder, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}/*.parquet'")
    df = queries()[name](spark, folder)
    rel = con.sql(oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    assert sorted(repr([_value(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == sorted(repr([_value(r[i]) for i in at]) for r in rel.fetchall())


def test_langid_predict_with_many_words(spark, tmp_path):
    _like_sql(spark, _many_word_tables(spark, tmp_path), "langid_predict")


def test_lang_filter_with_many_words(spark, tmp_path):
    _like_sql(spark, _many_word_tables(spark, tmp_path), "lang_filter")


def test_langid_confusion_with_many_words(spark, tmp_path):
    _like_sql(spark, _many_word_tables(spark, tmp_path), "langid_confusion")


def test_letters_in_python_like_in_sql(spark):
    text = "5m² fã¼r ⅷ½ 一二三 a_b c3d o'neill été"
    assert ngram_models.letter_runs(text) == _one(spark, text, ngram_models.letter_words(F.col("text"))) == ["m", "fã", "r", "一二三", "a", "b", "c", "d", "o", "neill", "été"]


def test_funnel_with_many_words(spark, tmp_path):
    docs = spark.read.parquet(f"{_many_word_tables(spark, tmp_path)}/documents.parquet").withColumn("source", F.lit("s"))
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = {r.stage: r for r in funnel.curate_all(docs, items, config.Curation(languages=("en",))).report().collect()}
    assert (rows["normalize"].docs_in, rows["language"].docs_in, rows["language"].docs_out) == (5, 4, 2)


def _shuffled_rows(spark, run):
    """Rows that are written to shuffles while `run` runs."""
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before)


def test_perplexity_shuffles_its_windows_once(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a model that is too large to be sent
    rows = [(i, " ".join(f"w{(7 * i + j) % 500}" for j in range(200)) + (" w1 w3 new" if i % 10 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    model = ngram_models.Trigrams(docs.where("doc_id % 10 <> 0"), "doc_id", hold=lambda df: df.checkpoint())
    scored = []
    try:
        written = _shuffled_rows(spark, lambda: scored.extend(model.perplexity(docs, "doc_id").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert written < 2 * 300 * 201
    assert {r.doc_id: r.tokens for r in scored} == {i: len(t.split()) + 1 for i, t in rows}
    worst = sorted(scored, key=lambda r: -r.perplexity)[:30]
    assert {r.doc_id % 10 for r in worst} == {0}
