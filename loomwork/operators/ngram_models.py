"""Count-based models as tables: a naive Bayes language identifier and a trigram language model with Kneser-Ney
smoothing. Training and scoring are joins and aggregations, so models of any size stay distributed."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ALPHA = 0.5
DISCOUNT = 0.75
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)


def word_trigrams(word: Column) -> Column:
    """Character trigrams of a word, padded with a space on each side."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.concat(F.lit(" "), word, F.lit(" ")), i, F.lit(3)))


def trigrams(text: Column) -> Column:
    """Character trigrams of all words (letters only) of the text."""
    return F.flatten(F.transform(letter_words(text), word_trigrams))


def train_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n). Words are counted first, so trigrams are made once for each word of a language."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    words = labelled.select(F.col(lang).alias("lang"), F.explode(letter_words(F.col(text))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    return words.select("lang", "n", F.explode(word_trigrams(F.col("w"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


STOP_BONUS = 3.0
#: The language of a text in which nothing tells one.
PREFERRED = "en"


def score_languages(docs: DataFrame, model: DataFrame, key: str, text: str = "text", stops: DataFrame | None = None) -> DataFrame:
    """(key, scores): each language of the model with the log-likelihood of the text, and STOP_BONUS for each of its words
    in `stops` (lang, word; a table of settings).

    The model becomes one row for a trigram with the gains of all languages over unseen trigrams, so the join does not
    multiply rows, and a text's sums are combined before they are shuffled.
    """
    totals = model.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()
    size = model.select("gram").distinct().count() + 1
    if not totals:
        return docs.select(key, F.array().cast("array<struct<lang:string,score:double>>").alias("scores"))
    langs = [r.lang for r in totals]
    floors = [math.log(ALPHA) - math.log(r.total + ALPHA * size) for r in totals]
    gains = model.groupBy("gram").pivot("lang", langs).agg(F.first(F.ln(F.col("n") + ALPHA) - math.log(ALPHA)))
    names = [f"__g{i}" for i in range(len(langs))]
    grams = docs.select(key, F.explode(trigrams(F.col(text))).alias("gram"))
    sums = grams.join(gains.toDF("gram", *names), "gram").groupBy(key).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0), F.array().cast("array<string>"))
    counted = docs.select(key, words.alias("__w")).select(key, "__w", F.aggregate("__w", F.lit(0), lambda n, w: n + F.length(w)).alias("__len"))
    if stops is not None:
        lists: dict[str, list[str]] = {}
        for r in stops.where(F.col("lang").isin(*langs)).select("lang", "word").distinct().collect():
            lists.setdefault(r.lang, []).append(r.word)
        hits = lambda ws: F.size(F.filter("__w", lambda w: w.isin(*ws)))
        bonus = [STOP_BONUS * hits(sorted(lists[x])) if x in lists else F.lit(0.0) for x in langs]
    else:
        bonus = [F.lit(0.0)] * len(langs)
    lengths = counted.select(key, "__len", *[b.alias(f"__b{i}") for i, b in enumerate(bonus)])
    score = lambda i: F.col("__len") * floors[i] + F.coalesce(F.col(names[i]), F.lit(0.0)) + F.col(f"__b{i}")
    return lengths.join(sums, key, "left").select(key, F.array(*[F.struct(F.lit(x).alias("lang"), score(i).alias("score")) for i, x in enumerate(langs)]).alias("scores"))


def told_languages(docs: DataFrame, model: DataFrame, key: str, text: str = "text", stops: DataFrame | None = None) -> DataFrame:
    """(key, lang, p) of each row: in the row if the model is small enough, else by joins; the same either way."""
    told = language_in_row(model, text, stops)
    if told is None:
        return predict_languages(score_languages(docs, model, key, text, stops), key)
    return docs.select(key, told.alias("__t")).select(key, "__t.lang", "__t.p")


def predict_languages(scores: DataFrame, key: str) -> DataFrame:
    """(key, lang, p): the best language, ties to PREFERRED and then by name, and its posterior."""
    best = F.array_min(F.transform("scores", lambda x: F.struct((-x["score"]).alias("s"), (x["lang"] != PREFERRED).alias("o"), x["lang"].alias("lang"))))
    top = scores.select(key, "scores", best.alias("__b"))
    z = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(F.greatest(F.lit(-50.0), x["score"] + F.col("__b.s"))))
    return top.where(F.col("__b").isNotNull()).select(key, F.col("__b.lang").alias("lang"), (1 / z).alias("p"))


#: Trigrams of a model that is sent to the workers, at most; larger ones are joined.
SENT_GRAMS = 2_000_000


def letter_runs(text: str) -> list[str]:
    """As letter_words: what Python's class holds besides letters (such as fractions and raised digits) parts words."""
    runs = []
    for word in _LETTERS.findall(text):
        if word.isalpha():
            runs.append(word)
        else:
            runs += "".join(c if c.isalpha() else " " for c in word).split()
    return runs


class RowScorer:
    """The language model as tables in memory: a word's gains are summed once and kept."""

    #: Words whose gains are kept from one piece of text to the next, at most.
    most = 300_000

    def __init__(self, grams: dict[str, int], gains: np.ndarray, langs: list[str], floors: list[float], stops: dict[str, list[int]]):
        self.grams, self.gains, self.langs, self.floors, self.stops = grams, gains, langs, np.array(floors), stops
        self.order = sorted(range(len(langs)), key=lambda i: (langs[i] != PREFERRED, langs[i]))
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, len(langs)))

    def at(self, word: str) -> int:
        found = self.index.get(word)
        if found is None:
            found = self.index[word] = len(self.index)
            if found >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            padded = f" {word} "
            known = [g for i in range(len(word)) if (g := self.grams.get(padded[i : i + 3])) is not None]
            self.rows[found] = self.gains[known].sum(axis=0) + len(word) * self.floors
            self.rows[found, self.stops.get(word, [])] += STOP_BONUS
        return found

    def language(self, text: str) -> tuple[str, float]:
        words = letter_runs(text.lower())
        total = np.zeros(len(self.langs))
        for start in range(0, len(words), 100_000):
            # rows are forgotten only between pieces, and looked up once all words of a piece have theirs
            if len(self.index) > self.most:
                self.index.clear()
            at = [self.at(w) for w in words[start : start + 100_000]]
            total += self.rows[at].sum(axis=0)
        best = max(self.order, key=lambda i: total[i])
        return self.langs[best], float(1 / np.exp(np.maximum(-50.0, total - total[best])).sum())


def language_in_row(model: DataFrame, text: str = "text", stops: DataFrame | None = None) -> Column | None:
    """An expression for (lang, p) as score_languages and predict_languages give them, in one pass and without a shuffle;
    a null text counts as an empty one. None if the model is empty or has more than SENT_GRAMS trigrams."""
    totals = model.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()
    size = model.select("gram").distinct().count()
    if not totals or size > SENT_GRAMS:
        return None
    langs = [r.lang for r in totals]
    table = model.select("gram", "lang", "n").toPandas()
    grams = {g: i for i, g in enumerate(sorted(table["gram"].unique()))}
    gains = np.zeros((len(grams), len(langs)))
    gains[table["gram"].map(grams).to_numpy(), table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = np.log(table["n"].to_numpy() + ALPHA) - math.log(ALPHA)
    floors = [math.log(ALPHA) - math.log(r.total + ALPHA * (size + 1)) for r in totals]
    lists: dict[str, list[int]] = {}
    if stops is not None:
        for r in stops.where(F.col("lang").isin(*langs) & F.col("word").isNotNull()).select("lang", "word").distinct().collect():
            lists.setdefault(r.word, []).append(langs.index(r.lang))
    shared = model.sparkSession.sparkContext.broadcast((grams, gains, langs, floors, lists))

    @F.pandas_udf("lang string, p double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = RowScorer(*shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.language(t or "") for t in texts], columns=["lang", "p"])

    return told(F.col(text))


# ---- trigram model


def model_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+|[^ \\t\\n\\ra-z0-9']"), 0)


def vocabulary(docs: DataFrame, text: str = "text", size: int = 50_000) -> DataFrame:
    counts = docs.select(F.explode(model_tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "w").limit(size).select("w")


def windows(docs: DataFrame, vocab: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, u, v, w): every token with the two before it; words outside of the vocabulary are <unk>.

    Windows are made within the row. The vocabulary has at most the rows of its `size`, so it is sent to the workers, and
    nothing is shuffled.
    """
    padded = F.concat(F.array(F.lit("<s>"), F.lit("<s>")), model_tokens(F.col(text)), F.array(F.lit("</s>")))
    raw = docs.where(F.length(text) > 0).select(key, padded.alias("t"))
    each = raw.select(key, F.inline(F.transform(F.sequence(F.lit(1), F.size("t") - 2), lambda i: F.struct(F.get("t", i - 1).alias("u"), F.get("t", i).alias("v"), F.get("t", i + 1).alias("w")))))
    known = F.broadcast(vocab.select(F.col("w").alias("__k")).unionByName(docs.sparkSession.createDataFrame([("<s>",), ("</s>",)], "__k string")).distinct())
    for name in ("u", "v", "w"):
        each = each.join(known, F.col(name) == F.col("__k"), "left").withColumn(name, F.coalesce("__k", F.lit("<unk>"))).drop("__k")
    return each


def reference_slice(passing: DataFrame, sources: tuple[str, ...], source: str = "source") -> DataFrame:
    """The passing texts of reference sources; all passing texts if there are none of these."""
    there = passing.where(F.col(source).isin(*sources)) if sources else passing.limit(0)
    return there if not there.isEmpty() else passing


class Trigrams:
    """The count tables of the model. `hold` may store the two that all others come from; `save` and `load` keep them."""

    def __init__(self, docs: DataFrame, key: str, text: str = "text", size: int = 50_000, hold: Callable[[DataFrame], DataFrame] = lambda df: df):
        vocab = hold(vocabulary(docs, text, size))
        self._from(vocab, hold(windows(docs, vocab, key, text).groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("c"))))

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.tri.write.mode("overwrite").parquet(f"{path}/tri")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trigrams:
        self = cls.__new__(cls)
        self._from(spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/tri"))
        return self

    def _from(self, vocab: DataFrame, tri: DataFrame) -> None:
        self.vocab, self.tri = vocab, tri
        self.context = self.tri.groupBy("u", "v").agg(F.sum("c").alias("ctx"), F.count(F.lit(1)).alias("fol"))
        self.pair = self.tri.groupBy("v", "w").agg(F.count(F.lit(1)).alias("cont_vw"))
        self.middle = self.pair.groupBy("v").agg(F.sum("cont_vw").alias("cont_v"), F.count(F.lit(1)).alias("foll_v"))
        self.single = self.pair.groupBy("w").agg(F.count(F.lit(1)).alias("cont_w"))

    def _rated(self, grams: DataFrame) -> DataFrame:
        """`grams` (u, v, w, their count c in the model, and others) with `nll`, the negative logarithm of w after u and v."""
        sizes = self.single.agg(F.sum("cont_w").alias("total")).crossJoin(self.vocab.agg((F.count(F.lit(1)) + 2).alias("vsize")))
        # these have at most a row for each word of the vocabulary, and their keys are the hot ones
        joined = grams.join(self.context, ["u", "v"], "left").join(self.pair, ["v", "w"], "left").join(F.broadcast(self.middle), "v", "left").join(F.broadcast(self.single), "w", "left").crossJoin(F.broadcast(sizes))
        z = lambda c: F.coalesce(F.col(c), F.lit(0))
        uni = 0.9 * z("cont_w") / F.greatest(F.col("total"), F.lit(1)) + 0.1 / F.col("vsize")
        bi = F.when(z("cont_v") == 0, uni).otherwise(F.try_divide(F.greatest(z("cont_vw") - DISCOUNT, F.lit(0.0)), z("cont_v")) + F.try_divide(DISCOUNT * z("foll_v"), z("cont_v")) * uni)
        tri = F.when(z("ctx") == 0, bi).otherwise(F.try_divide(F.greatest(z("c") - DISCOUNT, F.lit(0.0)), z("ctx")) + F.try_divide(DISCOUNT * z("fol"), z("ctx")) * bi)
        return joined.withColumn("nll", -F.ln(F.greatest(tri, F.lit(1e-12))))

    def perplexity(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, tokens, perplexity) over all tokens of the text and the end.

        The model's trigrams are rated once each, and windows meet them in one join. Only windows that the model has not
        seen are joined further; both branches read the same shuffled windows.
        """
        each, names = windows(docs, self.vocab, key, text), ["u", "v", "w"]
        seen = each.join(self._rated(self.tri).select(*names, "nll"), names)
        unseen = self._rated(each.join(self.tri.select(*names), names, "left_anti").withColumn("c", F.lit(0)))
        sums = [part.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum("nll").alias("nll")) for part in (seen, unseen)]
        return sums[0].unionByName(sums[1]).groupBy(key).agg(F.sum("k").alias("tokens"), F.exp(F.sum("nll") / F.sum("k")).alias("perplexity"))
