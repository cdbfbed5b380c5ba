"""What each operator finds, on small texts, against brute force, exact round trips or held-out rows."""

import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import budget, encode, language, leakage, mixing, mojibake, pii, prose, queries, reservoir, segments, toxic

RANKS = encode.read_ranks(queries.RANKS)


@given(st.lists(st.integers(-5, 5), max_size=40))
@settings(max_examples=200, deadline=None)
def test_segments_hold_the_best_sum(scores):
    found = segments.maximal_segments(scores)
    best = max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
    assert max([0, *(s for *_, s in found)]) == best
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


# ---- personal information

NAMES = {"mira", "halden", "orsa", "velt"}


def _found(text):
    return {(k, text[a:b]) for a, b, k in pii.spans(text, lambda w: pii.folded(w) in NAMES)}


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("Write to mira.halden@post.example today.", "email", "mira.halden@post.example"),
        ("Write to mira [at] post [dot] example today.", "email", "mira [at] post [dot] example"),
        ("Write to mira dot halden at post dot example today.", "email", "mira dot halden at post dot example"),
        ("Call +44 20 7946 0123 now.", "phone", "+44 20 7946 0123"),
        ("Call (312) 555-0199, ext. 4.", "phone", "(312) 555-0199"),
        ("SSN 912-34-5678 is on file.", "idno", "912-34-5678"),
        ("Le NIR 2 92 00 99 170 396 00.", "idno", "2 92 00 99 170 396 00"),
        ("The office is at 12 Old Mill Road, second floor.", "address", "12 Old Mill Road"),
        ("Bitte an Lindenallee 7a senden.", "address", "Lindenallee 7a"),
        ("Il est au 4 bis rue des Lilas. Le soir", "address", "4 bis rue des Lilas"),
        ("La oficina está en Calle de los Olmos 6, allí.", "address", "Calle de los Olmos 6"),
        ("Ask Dr Mira Halden-Velt.", "name", "Mira Halden-Velt"),
        ("Signed by HALDEN, MIRA on Monday.", "name", "HALDEN, MIRA"),
        ("M. Halden said so.", "name", "M. Halden"),
        ("Orsa van Halden said so.", "name", "Orsa van Halden"),
    ],
)
def test_pii_found(text, kind, value):
    assert (kind, value) in _found(text)


@pytest.mark.parametrize("text", ["Order 8242-96-3035-B covers parts.", "Build 10.3.2.188 fixed it.", "The number 978-0-00-895521-8.", "Halden & Sons Ltd came.", "The Halden Method works.", "Dear Mira, thank you.", "Values of 95 986 707 and 95 759 363 units.", "Between 1985 and 1991, 3 Lane roads were widened.", "Follow @dockplan today."])
def test_pii_not_found(text):
    assert not _found(text)


def test_pii_joined_form_agrees(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "Write to mira.halden@post.example or orsa.velt@post.example."), ("b", "Dr Mira Halden met Orsa Velt; mira.halden@x.example, orsa.velt@x.example.")], "id string, text string")
    one = sorted(map(tuple, pii.found_spans(docs).select("id", "kind", "pii_text").collect()))
    masked = {r.id: r.text for r in pii.masked(docs).collect()}
    monkeypatch.setattr(pii, "BROADCAST_PARTS", 0)
    assert sorted(map(tuple, pii.found_spans(docs).select("id", "kind", "pii_text").collect())) == one
    assert {r.id: r.text for r in pii.masked(docs).collect()} == masked
    assert masked["b"] == "Dr <NAME> met <NAME>; <EMAIL>, <EMAIL>."


def test_pii_joined_form_folds_names(spark, monkeypatch):
    mails = "jose.garcia@a.example, uwe.gross@a.example, sean.neil@a.example, mary.d'arcy@a.example"
    rows = [("a", mails), ("b", mails.replace("@a.", "@b.")), ("c", "José García met Uwe Groß, Sean O'Neil, Sean Neil and Mary D'Arcy."), ("d", None)]
    docs = spark.createDataFrame(rows, "id string, text string")
    one = sorted(map(tuple, pii.found_spans(docs).select("id", "kind", "pii_text").collect()))
    masked = {r.id: r.text for r in pii.masked(docs).collect()}
    monkeypatch.setattr(pii, "BROADCAST_PARTS", 0)
    assert sorted(map(tuple, pii.found_spans(docs).select("id", "kind", "pii_text").collect())) == one
    assert {r.id: r.text for r in pii.masked(docs).collect()} == masked
    assert {("c", "name", "José García"), ("c", "name", "Uwe Groß")} <= set(one)


def test_validators():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.dni("12345678Z") and not pii.dni("12345678A")


CHECKED = [
    ("DNI 12345678Z", "DNI 12345678A"),
    ("BSN 111222333", "BSN 111222334"),
    ("NIR 2 55 08 14 168 025 38", "NIR 2 55 08 14 168 025 39"),
    ("Steuer-ID 86095742719", "Steuer-ID 86095742710"),
    ("social insurance number 046 454 286", "social insurance number 046 454 287"),
    ("NIF 123456789", "NIF 123456780"),
]


@pytest.mark.parametrize(("right", "wrong"), CHECKED)
def test_checksums_count(right, wrong):
    scores = [max(x[3] for x in pii._numbers(f"The form holds {t}.") if x[0] == "idno") for t in (right, wrong)]
    assert scores[0] > scores[1] >= pii.ACCEPT  # a label outweighs a wrong digit


def test_checksums_without_label():
    assert ("idno", "12345678Z") in _found("It says 12345678Z here.") and not _found("It says 12345678A here.")
    assert pii.fiscale("RSSMRA85T10A562S") and not pii.fiscale("RSSMRA85T10A562T")
    assert pii.account("GB82WEST12345698765432") and not pii.account("GB82WEST12345698765433")
    assert not pii.luhn("not a number")
    # a card number in groups is no phone number
    assert pii.luhn("0453957876007") and not _found("It says 0453-957876007 here.") and ("phone", "0453-957876008") in _found("It says 0453-957876008 here.")


def test_typographic_spaces():
    assert ("phone", "+49\u00a0221\u00a04710\u00a0788") in _found("Tel. +49\u00a0221\u00a04710\u00a0788 oder per Post")


def test_bracketed_number():
    assert ("idno", "936 34 2310") in _found("A copy (936 34 2310) was left.") and not _found("Then 41 936 34 2310 77 came 12.")


def test_pii_joined_form_agrees_on_all_docs(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/docs.parquet").select("id", "text")
    one = sorted(map(tuple, pii.found_spans(docs).select("id", "kind", "pii_text").collect()))
    monkeypatch.setattr(pii, "BROADCAST_PARTS", 0)
    assert sorted(map(tuple, pii.found_spans(docs).select("id", "kind", "pii_text").collect())) == one
    assert any(not v.isascii() for _, k, v in one if k == "name")


# ---- structure


PLAIN = {
    "prose": "The committee compared the plan with the older report. It was found in the archive of the town, and the members asked for a copy of it. In the end they agreed to the terms.",
    "list": "\n".join(f"- {w} valve x{i}" for i, w in enumerate(("old", "spare", "new", "second", "short", "long"))),
    "table": "\n".join(f"valve {i};{i * 37};12.5;2019-04-0{i}" for i in range(1, 9)),
    "junk": "qxwv kdfjg zzrt plmk wrtgh bncx qwrt ghjkl mnbv sdfgh rtyp lkjh zxcv bnmq wrtp",
}
MORE_JUNK = ["4711 8823 19 277310 5 88120 347 12 99 31415 2718 16180 33988", "Sign in to read more.\n" * 20, "#$ %{ <> ][ ~^ *& @! +_ =| \\/ <{ }> $# %^ &* @@ ~~ []", "if(a>3){b()};.c{margin:3px;color:#fff};function d(e){return e[3]};var f=461;;" * 4]


def _kinds(spark, texts):
    common = spark.createDataFrame([("en", w) for w in "the of and that is all a to in with it was for they".split()] + [("de", w) for w in "der die das und in von ist".split()], "lang string, word string")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r.kind for r in prose.verdicts(docs, common).orderBy("id").collect()]


def test_kinds(spark):
    assert _kinds(spark, [*PLAIN.values(), *MORE_JUNK]) == [*PLAIN, *["junk"] * len(MORE_JUNK)]


def test_profiles_are_learnt(spark):
    # texts of one kind in a form that no profile starts with move it
    odd = ["\n".join(f"{i}/{j}::{i * j}::a" for j in range(12)) for i in range(60)]
    first = prose.Profiles({}, prose.Words({"en": {"the"}}))
    words = prose.Words({"en": {"the"}})
    vectors = [np.array(prose.counts_of(t) + words.counts(t), np.int32).tobytes() for t in odd]
    best = first.of(prose.Table(vectors, words.size))
    assert best[1].mean() > 0.1
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    docs = spark.createDataFrame(list(enumerate(odd)), "id long, text string")
    learnt = prose.verdicts(docs, common).agg(F.avg("kind_divergence")).first()[0]
    assert learnt < best[1].mean() / 3


def test_verdicts_do_not_depend_on_partitions(spark):
    common = spark.createDataFrame([("en", "the"), ("en", "of")], "lang string, word string")
    docs = spark.createDataFrame(list(enumerate([*PLAIN.values(), *MORE_JUNK] * 8)), "id long, text string")
    one, many = (prose.verdicts(docs.repartition(n), common).orderBy("id").collect() for n in (1, 16))
    assert one == many


def test_counts_of():
    n = dict(zip([*prose.CLASSES, *prose.UNITS], prose.counts_of("<p>A big cat, 3 dogs.</p>")))
    assert (n["words"], n["numbers"], n["commas"], n["d"], n["U"]) == (4, 1, 1, 1, 1)
    assert dict(zip([*prose.CLASSES, *prose.UNITS], prose.counts_of("- a\n- b\n- c")))["item marks"] == 3


def test_divergence():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert abs(prose.divergence(p, q) - 1) < 1e-9 and abs(prose.divergence(p, p)) < 1e-9


# ---- abusive language

TOXIC = ["You are a worthless idiot, shut up.", "What a br41nl3ss m0r0n you are.", "Listen, you i.d.i.o.t, go away.", "Du bist ein Arschloch, halt die Fresse.", "Go kill yourself."]
CLEAN = ["The operator had to kill the stuck process.", "Naked DNA was used in the study.", "The forum rules list words such as idiot and moron that lead to a warning.", "Zinc die casting needs a clean die.", "Les retards de livraison sont rares."]


def test_common_words_need_no_label(spark):
    lists = spark.createDataFrame([("en", "the"), ("en", "of"), ("de", "der"), ("de", "und")], "lang string, word string")
    docs = spark.createDataFrame([("a", "the end of it"), ("b", "der Anfang und das Ende"), ("c", None)], "id string, text string")
    shares = {r.id: r.common_words for r in prose.statistics(docs, lists).collect()}
    assert shares == {"a": 0.5, "b": 0.4, "c": 0.0}
    assert {r.common_words for r in prose.statistics(docs, lists.limit(0)).collect()} == {0.0}


def test_toxic(spark):
    filler = ["The committee compared the plan with the older report and the second copy of it."] * 400
    # other uses of a word lower its score, so the corpus has them
    rows = [(f"t{i}", t) for i, t in enumerate(TOXIC)] + [(f"c{i}", t) for i, t in enumerate(CLEAN * 30)] + [(f"f{i}", t) for i, t in enumerate(filler)]
    out = {r.id: r for r in toxic.score(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert [k for k, r in sorted(out.items()) if r.toxic] == [f"t{i}" for i in range(len(TOXIC))]


def _forum(n):
    """Documents with abuse that has no seed word of its own but stands with some, and reports with seeds."""
    filler = ["The committee compared the plan with the older report.", "A second copy of it went to the archive of the town.", "The members asked for a shorter version in spring."]
    rows = [(i, f"{filler[i % 3]} {filler[(i + 1) % 3]} The {i}th page follows.") for i in range(40 * n)]
    rows += [(100_000 + i, f"{filler[i % 3]} You people breed like locusts, go back under your rock. You {w}, nobody wants you here.") for i, w in enumerate(["idiot", "moron", "scum", "bitch"] * n)]
    rows += [(200_000 + i, f"{filler[i % 3]} The rules list words such as idiot and moron that lead to a warning.") for i in range(4 * n)]
    return rows + [(300_000, f"{filler[0]} You people breed like locusts, go back under your rock. {filler[1]}")]


def test_toxic_is_learnt(spark):
    docs = spark.createDataFrame(_forum(12), "id long, text string")
    found = {r.id for r in toxic.score(docs).where("toxic").collect()}
    assert found == {i for i, _ in _forum(12) if 100_000 <= i < 200_000 or i == 300_000}


def test_toxic_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(_forum(12), "id long, text string")
    one, *others = (toxic.score(docs.repartition(n)).orderBy("id").collect() for n in (1, 4, 64))
    assert all(o == one for o in others)


def test_plain_undoes_disguises():
    assert toxic.tokens("you i.d.i.o.t and m o r o n, br41nl3ss") == ["you", "idiot", "and", "moron", "brainless"]
    assert toxic.tokens("such an i  d  i o t") == ["such", "an", "idiot"]
    assert toxic.tokens("U.S. law of the E.U.") == ["u", "s", "law", "of", "the", "e", "u"]


# ---- samples and mixtures


def test_sample_is_uniform(spark):
    docs = spark.range(0, 60, 1, 3).withColumn("text", F.lit("x"))
    counts = np.zeros(60)
    for seed in range(60):
        for r in reservoir.reservoir_sample(docs, 10, seed).collect():
            counts[r.id] += 1
    assert counts.sum() == 600 and counts.min() >= 1 and counts.max() <= 24
    assert ((counts - 10) ** 2 / 10).sum() < 110  # chi-square with 59 degrees of freedom


def test_skips_are_uniform():
    rng = np.random.default_rng(1)
    counts = np.zeros(40)
    for _ in range(4000):
        slots = {}
        skips = reservoir.Skips(5, rng)
        for start in range(0, 40, 7):
            slots.update({s: i for i, s in skips.accepted(start, min(40, start + 7))})
        for i in slots.values():
            counts[i] += 1
    assert ((counts - 500) ** 2 / 500).sum() < 90


def test_draws_are_hypergeometric():
    counts = [5, 20, 75, 0]
    got = np.array([reservoir.split_draws(counts, 30, seed) for seed in range(4000)])
    assert (got.sum(axis=1) == 30).all() and (got <= counts).all()
    n, share = 100, np.array(counts) / 100
    assert np.allclose(got.mean(axis=0), 30 * share, atol=0.12)
    # the variance is that of draws without replacement
    assert np.allclose(got.var(axis=0), 30 * share * (1 - share) * (n - 30) / (n - 1), rtol=0.1, atol=0.01)


def test_draws_from_many():
    got = reservoir.split_draws([10**13, 3 * 10**13, 1], 1000, 5)
    assert sum(got) == 1000 and abs(got[0] - 250) < 70


def test_sample_needs_the_counted_rows(spark, monkeypatch):
    docs = spark.range(0, 60, 1, 3)
    monkeypatch.setattr(reservoir, "counted", lambda records: {0: 20, 1: 20, 2: 19})
    with pytest.raises(Exception, match="checkpoint the records first"):
        reservoir.reservoir_sample(docs, 10).collect()


def test_merge(spark):
    a, b = spark.range(0, 100).withColumn("text", F.lit("a")), spark.range(100, 400).withColumn("text", F.lit("b"))
    out = reservoir.merge(reservoir.reservoir_sample(a, 20), 100, reservoir.reservoir_sample(b, 20), 300, 20, 3)
    assert out.count() == 20 and out.distinct().count() == 20


def test_mix_reaches_targets(spark):
    random.seed(2)
    rows = [(i, "a" if i % 3 else "b", random.randint(5, 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1.0), ("b", 0.6, 3.0)], "source string, target_share double, max_repeats double")
    mixed = mixing.mix(docs, targets, "id")
    report = {r.source: r for r in mixing.report(mixed, targets).collect()}
    assert abs(report["a"].actual_share - 0.4) < 0.002 and abs(report["b"].actual_share - 0.6) < 0.002
    assert report["a"].repeats <= 1 and report["b"].repeats <= 3


def test_mix_by_weight(spark):
    random.seed(3)
    rows = [(i, "a", 10, 1.0 + 9.0 * (i % 10 == 0)) for i in range(4000)] + [(9000 + i, "b", 10, 0.0 if i % 2 else 1.0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "id long, source string, tokens long, w double")
    targets = spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.5, 1.0)], "source string, target_share double, max_repeats double")
    mixed = mixing.mix(docs, targets, "id", weight=F.col("w")).collect()
    a, b = [r for r in mixed if r.source == "a"], [r for r in mixed if r.source == "b"]
    assert len(a) == len(b) == 1600
    # 400 heavy documents are certain; the 1200 others come from 3600 light ones, spread evenly
    assert sum(r.w > 1 for r in a) == 400
    assert all(r.w > 0 for r in b)
    light = sorted(r.id for r in a if r.w == 1)
    assert abs(sum(i < 2000 for i in light) - 600) < 90


def test_mix_factors_converge(spark):
    # each round makes some more documents certain
    rows = [(i, "a", 1, 2.0**-i, 0, 9.5) for i in range(12)]
    docs = spark.createDataFrame(rows, "id long, source string, tokens long, __w double, __copies long, __rest double")
    c = mixing.inclusion_factors(docs, "tokens")["a"]
    assert abs(sum(min(1.0, c * r[3]) for r in rows) - 9.5) < 1e-6


# ---- leakage


def test_leaks_like_brute_force(spark):
    random.seed(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, "Answer the question with one word only. " + " ".join(random.choices(vocab, k=random.randint(6, 25)))) for i in range(12)]
    docs = []
    for d in range(60):
        body = random.choices(vocab, k=40)
        if d % 2:
            words = items[d % 12][1].split()[7:]
            n = random.randint(8, len(words)) if len(words) > 8 else len(words)
            at = random.randint(0, len(words) - n)
            body[10:10] = words[at : at + n]
        docs.append((f"d{d}", ", ".join(w.upper() if d % 3 else w for w in body)))
    want = set()
    for k, text in docs:
        w = " " + " ".join(leakage.words(text)) + " "
        for i, item in items:
            x = leakage.words(item)[7:]
            n = min(13, len(x))
            if any(f" {' '.join(x[a : a + n])} " in w for a in range(len(x) - n + 1)):
                want.add((k, i))
    got = leakage.leaks(spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert set(map(tuple, got.collect())) == want and want


def test_short_items_leak(spark):
    items = spark.createDataFrame([(1, "crooked brass teapot"), (2, "zinc"), (3, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([("a", "A Crooked, brass TEAPOT."), ("b", "crooked teapot of zinc"), ("c", "one two three four five six"), (None, "zinc")], "id string, text string")
    want = [("a", 1), ("b", 2), (None, 2)]
    for few in (10, 0):
        assert sorted(map(tuple, leakage.leaks(docs, items, broadcast_shingles=few).collect()), key=str) == sorted(want, key=str)


def test_items_on_one_passage(spark):
    passage = "The quarry sold eleven slabs of grey slate to the bakery before the bridge was closed in the cold spring."
    items = spark.createDataFrame([(i, f"{passage} What was sold in case {i}, and to whom did it go?") for i in range(3)], "item_id long, text string")
    docs = spark.createDataFrame([("a", f"Then {passage.lower()} And so on.")], "id string, text string")
    assert {r.item_id for r in leakage.leaks(docs, items).collect()} == {0, 1, 2}


def test_leaks_agree_without_broadcast_on_all_docs(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("docs", "benchmark"))
    one, other = (sorted(map(tuple, leakage.leaks(docs, items, broadcast_shingles=n).collect())) for n in (leakage.BROADCAST_SHINGLES, 10))
    assert one == other and one


# ---- tokens


def _reference():
    import public_tokenizers as P

    return tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.text(max_size=400), st.integers(3, 60))
@settings(max_examples=300, deadline=None)
def test_cut_keeps_counts(text, size):
    enc = budget.encoder(queries.RANKS)
    parts = budget.cut(text, size)
    assert "".join(parts) == text
    assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


def test_cut_at_line_ends():
    assert budget.cut("ab\ncd\tef gh", 1) == ["ab", "\ncd", "\tef", " gh"]
    assert budget.cut("ab \n cd\n\nef", 1) == ["ab", " \n cd\n\nef"]


@given(st.text(alphabet="ab1!é\u4e00 \n\t\r\u00a0\u2003'", max_size=120), st.integers(1, 12))
@settings(max_examples=400, deadline=None)
def test_cut_keeps_counts_at_white_space(text, size):
    enc = budget.encoder(queries.RANKS)
    assert [x for p in budget.cut(text, size) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_token_totals(spark):
    rows = [("a", "en", "x", 3), ("a", "en", None, 4), ("b", "de", "x", 5), (None, "en", "y", 6)]
    counts = spark.createDataFrame(rows, "source string, lang string, field string, tokens long")
    out = {(r.slice, r.source, r.lang, r.field): (r.docs, r.tokens) for r in budget.totals(counts, {k: F.col(k) for k in ("source", "lang", "field")}).collect()}
    assert out["all", None, None, None] == (4, 18)
    assert out["lang", None, "en", None] == (3, 13) and out["field", None, None, None] == (1, 4) and out["field", None, None, "x"] == (2, 8)
    assert out["source x lang", "a", "en", None] == (2, 7) and out["source", None, None, None] == (1, 6)
    assert sum(n for (s, *_), (n, _) in out.items() if s == "source x lang x field") == 4


def test_encode_and_decode(spark):
    random.seed(7)
    odd = ["<|endoftext|>", "naïve café — 東京 😀🏽", "a" * 3000, " \t\n  x y z", "I'll we've it's", "12345 678,9", "́combining", "=" * 500 + "!?" * 300]
    odd += ["".join(chr(random.choice([random.randint(32, 126), random.randint(160, 0x24F), random.randint(0x400, 0x4FF), random.randint(0x4E00, 0x4EFF)])) for _ in range(80)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(odd)), "id long, text string")
    out = encode.encode(docs, RANKS).collect()
    enc = _reference()
    assert all(r.ids == enc.encode_ordinary(odd[r.id]) for r in out)
    back = encode.decode(encode.encode(docs, RANKS).drop("text"), RANKS).collect()
    assert all(r.text == odd[r.id] for r in back)
    # without a dictionary every piece is folded in place
    assert {r.id: r.ids for r in encode.encode(docs, RANKS, dictionary_rows=0).collect()} == {r.id: r.ids for r in out}


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyzéß漢", max_size=400))
@settings(max_examples=200, deadline=None)
def test_heap_merges_like_the_tokenizer(text):
    # letters are one piece
    assert encode.merged(text.encode(), RANKS) == _reference().encode_ordinary(text)


def test_long_pieces(spark):
    random.seed(8)
    blobs = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=16_000)), "ab" * 4000 + " and words", "=" * 1200, " " * 900 + "x", None, "", "plain words"]
    docs = spark.createDataFrame(list(enumerate(blobs)), "id long, text string")
    enc = _reference()
    out = {r.id: r.ids for r in encode.encode(docs, RANKS).collect()}
    assert all(out[i] == (enc.encode_ordinary(t) if t else []) for i, t in enumerate(blobs))
    # the fold gives the same for a piece of either length
    short = spark.createDataFrame([(1, blobs[0][:300] + " " + "=" * 90)], "id long, text string")
    assert encode.encode(short, RANKS, long_piece=50).first().ids == encode.encode(short, RANKS).first().ids


# ---- languages

SAY = {
    "en": "The council of the town checked the {} in {} and wrote a short report about it for the members.",
    "de": "Die Gemeinde hat das {} im Jahr {} geprüft und einen kurzen Bericht für die Mitglieder geschrieben.",
    "fr": "La commune a vérifié le {} en {} et elle a écrit un petit rapport pour les membres du conseil.",
    "es": "El ayuntamiento revisó el {} en {} y escribió un informe breve para los miembros del consejo.",
}


def test_languages(spark):
    rows = []
    for lang, say in SAY.items():
        rows += [(f"{lang}{i}", " ".join(say.format(w, 1990 + i) for w in ("museum", "hotel", "garage", "radio")), lang) for i in range(20)]
    rows += [("wrong", SAY["de"].format("Haus", 1950), "fr"), ("missing", SAY["fr"].format("port", 1950), "und"), ("spelled", SAY["en"].format("shop", 1950), "en-GB")]
    rows += [("mixed", SAY["en"].format("shop", 1951) + " " + SAY["es"].format("barco", 1952), "en"), ("digits", "12 34 56 78 90 11", None)]
    docs = spark.createDataFrame(rows, "id string, text string, lang string")
    found = set(map(tuple, language.corrections(language.identify(docs, label=F.col("lang"))).collect()))
    assert found == {("wrong", "de"), ("missing", "fr"), ("mixed", "en"), ("mixed", "es")}


MORE = {
    "sv": "Kommunen har kontrollerat {} under {} och skrivit en kort rapport om det för medlemmarna i rådet.",
    "pl": "Gmina sprawdziła {} w roku {} i napisała krótki raport dla członków rady miasta oraz mieszkańców.",
    "ro": "Comuna a verificat {} în anul {} și a scris un scurt raport pentru membrii consiliului orașului.",
}


def test_languages_beyond_seven(spark):
    words = ["museum", "hotel", "garage", "radio", "port", "bus"]
    rows = [(f"{x}{i}", " ".join(say.format(w, 1950 + i) for w in words[i % 3 :]), x) for x, say in (SAY | MORE).items() for i in range(25)]
    held_out = [(f"?{x}{i}", f"{say.format('kino', 1900 + i)} {say.format('park', 1800 + i)}", None) for x, say in MORE.items() for i in range(10)]
    found = language.corrections(language.identify(spark.createDataFrame(rows + held_out, "id string, text string, lang string"), label=F.col("lang"))).collect()
    assert sum((f"?{r.lang}{i}" == r.id) for r in found for i in range(10)) >= 0.9 * len(held_out)
    assert all(r.id[0] == "?" for r in found)


def test_no_language(spark):
    rows = [(f"{x}{i}", " ".join(say.format(w, 1950 + i) for w in ("museum", "hotel")), x) for x, say in SAY.items() for i in range(20)]
    odd = ["win 🔥 win $$$ " * 20, "vgawfuszqt himr irpp rhnrwqo bt ud qcfsekwd acbwezrf", "if(a>3){b()};var c=461;" * 9, "0xff 12 99 -- ##"]
    docs = spark.createDataFrame(rows + [(f"?{i}", t, None) for i, t in enumerate(odd)], "id string, text string, lang string")
    assert language.corrections(language.identify(docs, label=F.col("lang"))).count() == 0


def test_labels(spark):
    rows = [("en-GB", "en"), ("ENG", "en"), ("Deutsch", "de"), ("pt_BR", "pt"), ("und", None), (" ", None), (None, None), ("klingon", "klingon")]
    out = spark.createDataFrame(rows, "a string, b string").select(language.code_of(F.col("a")).alias("c"), "b").collect()
    assert all(r.c == r.b for r in out)


# ---- garbled text


def test_garbled(spark):
    plain = ["Le musée décrit une pièce très chère à l’entrée.", "Der Prüfer erwähnt die Größe der Straße.", "Una oferta más pequeña está aquí, señora.", "It’s “good enough” – they said…", "ÀÉÎÕÜ is a test line.", "Åland and Łódź are places."]
    rows = [(i, t) for i, t in enumerate(plain * 60)]
    bad = {}
    for n, (enc, times) in enumerate([("cp1252", 1), ("latin-1", 1), ("mac-roman", 1), ("cp437", 1), ("latin-1", 2)]):
        for j in (0, 1, 2):
            t = plain[j]
            for _ in range(times):
                t = t.encode().decode(enc, "ignore" if enc == "cp1252" else "strict")
            bad[10_000 + n * 10 + j] = (t, plain[j])
    docs = spark.createDataFrame(rows + [(k, v[0]) for k, v in bad.items()], "doc_id long, text string")
    out = {r.doc_id: r.restored for r in mojibake.repaired(docs).collect()}
    assert set(out) == set(bad)
    assert sum(out[k] == v[1] for k, v in bad.items()) >= len(bad) - 1


def test_pairs_of_far_characters_are_few(spark):
    # every ideograph of a block is another character, but not another pair
    text = "".join(chr(c) for c in range(0x4E00, 0x9FFF))
    rows = mojibake.pair_counts(spark.createDataFrame([(1, text), (2, text[::-1])], "doc_id long, text string")).collect()
    assert len(rows) < 1000 and sum(r.n for r in rows if r.b == "") == 2 * len(text)
    assert mojibake.near("aé漢–字") == "aé" + chr(ord("漢") & ~0x7F) + "–" + chr(ord("字") & ~0x7F)


def test_garbled_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, many = (sorted(map(tuple, mojibake.repaired(docs.repartition(n)).collect())) for n in (1, 16))
    assert one == many and one
