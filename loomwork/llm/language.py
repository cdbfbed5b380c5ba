"""Missing or wrong language labels, and the languages of mixed texts (problem 7).

Method. Hierarchical discrimination with linear support vector machines: one-versus-one machines tell the language
family, then one-versus-one machines tell the languages of the family apart and vote. Families and languages are those
that have labels. Features of a sentence are its words and their
character n-grams up to three, hashed and averaged over its words. As everything is linear, a word's scores under all
machines are the sum of its features' weights and are kept by word, so that scoring a text costs one look-up for each
word. The machines are fitted by coordinate descent in the dual on sentences of at most `per_language` labelled rows of each
language (those of the least hashes), a documented bound; labels are partly wrong, so the machines are fitted twice, the
second time without the sentences that the first fit contradicts. Every row is then classified, over its whole text.

A word is taken for one of a language if most of its character trigrams stood in the fit's words, which hardly depends on
the size of the fit. A sentence that a text repeats counts once.

A text's sentences are classified one by one; neighbours of one language are a segment. The main language is that of
the summed scores; another language counts if it has a whole sentence of `least_words` words with a clear margin.

Defined cases: null, empty and blank texts, and texts without at least DISTINCT_WORDS different words of a language
(symbols, digits, random characters, code), have no language and give no rows; languages without labels are not told; ties go to the first language by name; repeated rows are classified alike; an
empty table, or one without labels of two languages, gives no rows.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAMILIES = {
    "germanic": ("da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "uk"),
    "finnic": ("et", "fi"),
    "baltic": ("lt", "lv"),
    "hungarian": ("hu",),
    "greek": ("el",),
    "turkic": ("tr",),
}
FAMILY = {x: f for f, members in FAMILIES.items() for x in members}
#: Labelled rows of each language that the machines are fitted on, at most.
PER_LANGUAGE = 250
DIMENSIONS = 1 << 16
LEAST_WORDS = 4
#: Different words of a language that a text needs.
DISTINCT_WORDS = 3
#: Share of a word's trigrams that must be known.
KNOWN_TRIGRAMS = 0.75
#: Codes and names of the languages as they are written in labels; a region after - or _ is cut off first.
LABELS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "da": ("da", "dan", "danish", "dansk"),
    "no": ("no", "nor", "nb", "nob", "nn", "nno", "norwegian", "norsk"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "ca": ("ca", "cat", "catalan", "català"),
    "ro": ("ro", "ron", "rum", "romanian", "română"),
    "bg": ("bg", "bul", "bulgarian"),
    "cs": ("cs", "ces", "cze", "czech", "čeština"),
    "hr": ("hr", "hrv", "croatian", "hrvatski"),
    "pl": ("pl", "pol", "polish", "polski"),
    "ru": ("ru", "rus", "russian", "русский"),
    "sk": ("sk", "slk", "slo", "slovak", "slovenčina"),
    "sl": ("sl", "slv", "slovenian", "slovenščina"),
    "uk": ("uk", "ukr", "ukrainian", "українська"),
    "et": ("et", "est", "estonian", "eesti"),
    "fi": ("fi", "fin", "finnish", "suomi"),
    "lt": ("lt", "lit", "lithuanian", "lietuvių"),
    "lv": ("lv", "lav", "latvian", "latviešu"),
    "hu": ("hu", "hun", "hungarian", "magyar"),
    "el": ("el", "ell", "gre", "greek", "ελληνικά"),
    "tr": ("tr", "tur", "turkish", "türkçe"),
}
#: What stands in labels for no language.
UNKNOWN = ("", "und", "unknown", "unk", "none", "null", "n/a", "na", "xx", "zxx", "mul", "mis", "?", "-", "other", "undefined", "undetermined")

_TAG = re.compile(r"<[^<>]{0,300}>")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_WORDS = re.compile(r"[@\d/\\_=<>{}]")
_WRAP = re.compile(r"(?<=[^\s.!?:;])[ \t]*\n[ \t]*(?=[^\W\d_A-Z])")
_END = re.compile(r"[.!?][\"'”’»)]*\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+|\n+")


def code_of(label: Column) -> Column:
    """The two-letter code of a label; null if it is missing or stands for no language; as it is if not known."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    table = F.create_map(*[F.lit(x) for code, names in LABELS.items() for name in names for x in (name, code)])
    return F.when(plain.isNull() | plain.isin(*UNKNOWN), None).otherwise(F.coalesce(F.try_element_at(table, plain), plain))


def sentences(text: str) -> list[str]:
    """The sentences and lines of a text, without tags, with hard line breaks inside of sentences removed."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    return [s for s in _SENTENCE.split(_WRAP.sub(" ", text)) if s and not s.isspace()]


def token_words(token: str) -> list[str]:
    """The words of a stretch without white space; none if it looks like an address, a number or code."""
    return [] if _NOT_WORDS.search(token) else _WORD.findall(token.lower())


def sentence_words(sentence: str) -> list[str]:
    return [w for token in sentence.split() for w in token_words(token)]


def features(word: str) -> list[int]:
    padded = f"<{word}>"
    grams = [padded, *(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))]
    return [zlib.crc32(g.encode()) % DIMENSIONS for g in grams]


def trigrams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


Row = tuple[np.ndarray, np.ndarray]


def _row(words: list[str]) -> Row:
    """Distinct feature numbers and their weights, of length 1."""
    x, n = np.unique([f for w in words for f in features(w)], return_counts=True)
    return x, n / np.sqrt((n * n).sum())


def _fit(rows: list[Row], y: np.ndarray, epochs: int = 5, c: float = 1.0, seed: int = 5) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss) by coordinate descent in the dual; rows have length 1."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(DIMENSIONS), np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i]
            a = min(c, max(0.0, alpha[i] + 1 - y[i] * (w[x] @ v)))
            if a != alpha[i]:
                w[x] += (a - alpha[i]) * y[i] * v
                alpha[i] = a
    return w


class Model:
    """The machines' weights as columns, and the trigrams of the fit's words."""

    def __init__(self, languages: list[str], weights: np.ndarray, machines: list[tuple], known: set[str]):
        self.languages, self.weights, self.machines, self.known = languages, weights.astype(np.float32), machines, known
        self.clear()

    def clear(self) -> None:
        # a word's row: its scores under the machines, its number of features, whether it is known and longer than a letter
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, len(self.machines) + 3), np.float32)
        self.tokens: dict[str, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"index": {}, "tokens": {}, "rows": self.rows[:1]}

    def at(self, word: str) -> int:
        found = self.index.get(word)
        if found is None:
            found = self.index[word] = len(self.index)
            if found >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(4096, len(self.rows)), self.rows.shape[1]), np.float32)])
            x = features(word)
            self.rows[found, :-3] = self.weights[x].sum(axis=0)
            grams = trigrams(word)
            self.rows[found, -3:] = len(x), sum(g in self.known for g in grams) >= KNOWN_TRIGRAMS * len(grams), len(word) > 1
        return found

    def ids(self, sentence: str) -> list[int]:
        """The rows of the words of a sentence."""
        out: list[int] = []
        get = self.tokens.get
        for token in sentence.split():
            found = get(token)
            if found is None:
                found = self.tokens[token] = [self.at(w) for w in token_words(token)]
            out += found
        return out

    def sums(self, parts: list[list[int]]) -> np.ndarray:
        """The summed rows of each list; none may be empty."""
        starts = list(accumulate(map(len, parts[:-1]), initial=0))
        return np.add.reduceat(self.rows[list(chain.from_iterable(parts))], starts, axis=0)

    def predict(self, margins: list[float]) -> tuple[str, float]:
        """Language and confidence: votes of families first, then of the family's languages."""
        p = [1 / (1 + math.exp(min(50.0, max(-50.0, -2.5 * m)))) for m in margins]
        family, sure = self._voted("", p) or (FAMILY[self.languages[0]], 1.0)
        lang, surer = self._voted(family, p) or (next(x for x in FAMILIES[family] if x in self.languages), 1.0)
        return lang, sure * surer

    def _voted(self, group: str, p: list[float]) -> tuple[str, float] | None:
        """The member of a group with most votes (ties: the least doubtful, then by name), and its least probability."""
        votes: dict[str, list] = {}
        for q, (kind, a, b) in zip(p, self.machines):
            if kind == group:
                for x, r in ((a, q), (b, 1 - q)):
                    v = votes.setdefault(x, [0, 1.0])
                    v[0] += r >= 0.5
                    v[1] = min(v[1], r)
        if not votes:
            return None
        best = max(sorted(votes), key=lambda x: votes[x])
        return best, votes[best][1]


def fit(samples: list[tuple[str, str]]) -> Model | None:
    """The model from (text, language) rows."""
    rows, langs, seen = [], [], Counter()
    for text, lang in samples:
        parts = [sentence_words(s) for s in sentences(text)]
        everything = [w for words in parts for w in words]
        seen.update({g for w in set(everything) for g in trigrams(w)})
        # lists have few sentences: the whole text is a row, too
        for words in (*parts, everything[:200]):
            if sum(len(w) > 1 for w in words) >= LEAST_WORDS:
                rows.append(_row(words))
                langs.append(lang)
    y = np.array(langs)
    languages = sorted(set(langs))
    if len(languages) < 2:
        return None
    names = [f for f in FAMILIES if any(FAMILY[x] == f for x in languages)]
    # the machines of group "" tell families
    machines: list[tuple] = [("", a, b) for a, b in combinations(names, 2)]
    machines += [(f, a, b) for f in names for a, b in combinations([x for x in FAMILIES[f] if x in languages], 2)]
    known = {g for g, n in seen.items() if n >= 2}
    keep = np.ones(len(y), bool)
    for last in (False, True):
        weights = []
        for kind, a, b in machines:
            side = np.array([FAMILY[x] for x in y]) if kind == "" else y
            use = np.flatnonzero(keep & ((side == a) | (side == b)))
            weights.append(_fit([rows[i] for i in use], np.where(side[use] == a, 1.0, -1.0)))
        model = Model(languages, np.stack(weights, axis=1), machines, known)
        if not last:
            keep = np.array([model.predict((v @ model.weights[x]).tolist())[0] == lang for (x, v), lang in zip(rows, y)])
    return model


def segments(text: str, model: Model, least_words: int = LEAST_WORDS, clear: float = 0.9) -> tuple[str | None, float, list[tuple[str, str, float]]]:
    """The text's main language, its confidence, and the segments (language, text, confidence) in order."""
    if len(model.tokens) > 300_000:
        model.clear()
    parts = [(s, model.ids(s)) for s in dict.fromkeys(sentences(text))]
    told = [ws for _, ws in parts if ws]
    if not told:
        return None, 0.0, []
    sums = model.sums(told)
    total = sums.sum(axis=0)
    if total[-2] < 2 or total[-2] < 0.4 * sum(map(len, told)):
        return None, 0.0, []
    different: set[int] = set()
    for ws in told:
        different.update(w for w in set(ws) if model.rows[w, -2] and model.rows[w, -1])
        if len(different) >= DISTINCT_WORDS:
            break
    else:
        return None, 0.0, []
    # the length of a row of the fit is near the root of its number of features
    margins = (sums[:, :-3] / np.sqrt(sums[:, -3:-2])).tolist()
    main, sure = model.predict((total[:-3] / np.sqrt(total[-3])).tolist())
    counts = iter(zip(margins, sums[:, -2].tolist(), sums[:, -1].tolist()))
    out: list[tuple[str, str, float]] = []
    waiting = ""
    for s, ws in parts:
        lang, p = "", 0.0
        if ws:
            margin, known, long = next(counts)
            if long >= least_words and known >= 0.6 * len(ws):
                found, q = model.predict(margin)
                if found == main or (q >= clear and (_END.search(s) is not None or len(ws) > 2 * least_words)):
                    lang, p = found, q
        # a stretch that tells no language goes with its neighbour
        if not lang and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + s, out[-1][2])
        elif not lang:
            waiting += s + " "
        elif out and out[-1][0] == lang:
            out[-1] = (lang, out[-1][1] + " " + s, max(out[-1][2], p))
        else:
            out.append((lang, waiting + s, p))
            waiting = ""
    if not out:
        out = [(main, waiting.strip(), sure)]
    # the main language is the one with the most words in its segments
    sizes = Counter()
    for lang, s, _ in out:
        sizes[lang] += len(s)
    main = max(sorted(sizes), key=lambda x: sizes[x])
    return main, max(p for lang, _, p in out if lang == main), out


def model_for(docs: DataFrame, text: str, label: Column, key: str, per_language: int = PER_LANGUAGE) -> Model | None:
    labelled = docs.select(F.col(text).alias("text"), code_of(label).alias("code"), F.xxhash64(F.col(key)).alias("h")).where(F.col("code").isin(*FAMILY))
    # few rows of each language are ranked, however many have its label: first a threshold on the hash (at least 8 times
    # as many as are wanted are expected below it), then the least hashes
    sizes = labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    if len(sizes) < 2:
        return None
    below = F.create_map(*[F.lit(x) for r in sizes for x in (r.code, min(1.0, 8.0 * per_language / r.n))])
    near = labelled.where((F.col("h") / float(1 << 64) + 0.5 <= F.element_at(below, F.col("code"))) & (F.length("text") > 80))
    picked = near.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("h", "text"))).where(F.col("r") <= per_language)
    return fit([(r.text, r.code) for r in picked.select("text", "code").orderBy("code", "text").collect()])


SCHEMA = "label string, code string, lang string, confidence double, segments array<struct<lang:string,text:string,confidence:double>>"


def identify(docs: DataFrame, key: str = "id", text: str = "text", label: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """key, label, its code, main language, confidence and segments of every row with a language."""
    label = F.col("meta.lang") if label is None else label
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {SCHEMA}"
    model = model_for(docs, text, label, key, per_language)
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = []
            for k, t, raw, code in zip(batch["k"], batch["t"], batch["label"], batch["code"]):
                main, sure, found = segments(t, model)
                if main:
                    out.append((k, raw, code, main, sure, [{"lang": a, "text": b, "confidence": c} for a, b, c in found]))
            yield pd.DataFrame(out, columns=[key, "label", "code", "lang", "confidence", "segments"])

    named = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), label.alias("label"), code_of(label).alias("code"))
    return named.where(F.col("t").rlike(r"\p{L}{2}")).mapInPandas(scan, schema)


def corrections(identified: DataFrame, key: str = "id", clear: float = 0.85) -> DataFrame:
    """(key, lang): every language of the rows whose label is missing or wrong or whose text mixes languages."""
    langs = F.array_distinct(F.concat(F.array("lang"), F.transform("segments", lambda s: s["lang"])))
    rows = identified.select(key, "code", "confidence", langs.alias("langs"))
    # a label that contradicts a doubtful verdict is believed
    wrong = F.col("code").isNull() | (F.size("langs") > 1) | ((F.col("code") != F.get("langs", F.lit(0))) & (F.col("confidence") >= clear))
    return rows.where(wrong).select(key, F.explode("langs").alias("lang")).distinct()
