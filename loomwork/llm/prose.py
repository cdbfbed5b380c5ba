"""Text quality statistics of each document and its structural kind: prose, list, table or junk (problem 2).

Method. A text gives four distributions: its function words (the common words of its nearest language, or rest), its
character classes, the units that runs of these classes make (words, numbers, ended sentences, commas, field separators,
line breaks, item marks, ...), and how much of it is new (its bytes after compression, against the rest). Each is
compared by Jensen-Shannon divergence with structural profiles; the kind is that of the profile with the least sum.

Profiles are learnt from the corpus. Basic counts (SEEDS) name the plain cases of each profile; the means of their
distributions are the first profiles, and ROUNDS times every text goes to its nearest profile and the profiles become
the means of what came to them. Prose has a profile for each language. PRIOR typical texts a profile stand in for a
corpus that has few or none of its kind.

Scale. One pass over the texts writes a vector of counts for each document (about 0.3 KB) to the checkpoint folder; all
else works on vectors in numpy. Sums are of whole numbers, so they do not depend on partitions; a partition sends a sum
for each profile and dimension only.

Defined cases: null, empty and blank texts have zero counts and no kind; short texts have less weight on their function
words, and so have texts in other alphabets none; a null label takes the nearest language; repeated rows have the same
verdict; columns of `docs` with the names of results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

ROUNDS = 3
#: Typical texts that each profile starts with.
PRIOR = 10
#: Pseudo-words against which a text's words count for the weight of its function words.
FEW_WORDS = 40
#: Bytes that are compressed at a time, so that the share of new text does not fall with its length.
PIECE = 1500
#: Millionths, for sums of whole numbers.
UNIT = 1_000_000

_ROW_TAG = re.compile(r"</?(?:tr|p|br|li|ul|ol|div|table|h\d)\b[^<>]*>", re.I)
_CELL_TAG = re.compile(r"</t[dh]>\s*<t[dh][^<>]*>", re.I)
_TAG = re.compile(r"<[/a-zA-Z!][^<>]{0,200}>")

#: Character classes: vowel, other small letter, capital, digit, space, line break, field separator, stop, comma, mark,
#: bracket or code sign, symbol, other.
CLASSES = "vcUd nfskmbyo"
UNITS = ("words", "numbers", "ended", "commas", "separators", "breaks after a stop", "breaks", "item marks", "marks", "code signs", "symbols")
_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ"
_OTHER_VOWEL, _OTHER_LETTER, _OTHER = b"\x81", b"\x8d", b"\x8f"  # bytes that the Windows alphabet leaves free


def _class_of(byte: int) -> str:
    raw = bytes([byte])
    if raw in (_OTHER_VOWEL, _OTHER_LETTER, _OTHER):
        return {_OTHER_VOWEL: "v", _OTHER_LETTER: "c", _OTHER: "o"}[raw]
    c = raw.decode("cp1252", "replace")
    if c.isalpha():
        return "v" if c in _VOWELS else "U" if c.isupper() else "c"
    groups = (("n", "\n\r"), ("f", "|\t;"), ("s", ".!?…"), ("k", ","), ("b", "{}=<>[]/\\_#"), ("m", ":'\"()-–—“”‘’„«»¿¡"))
    return "d" if c.isdigit() else next((k for k, members in groups if c in members), " " if c.isspace() else "y")


_CLASS = bytes(ord(_class_of(i)) for i in range(256))
_LETTERS = bytes(i if chr(i) in "vcU" else 32 for i in range(256))
_DIGITS = bytes(i if chr(i) == "d" else 32 for i in range(256))
_ORDS = np.frombuffer(CLASSES.encode(), np.uint8)
_GAP = re.compile(rb" {3,}")
#: A mark at the start of a line: a sign, a number or a letter with a stop or bracket, an empty box.
_ITEM = re.compile(rb"(?:\A|n) *(?:[myo] |d{1,3}[sm] |[cvU]m |m[cvd]{1,2}m |b ?b )")


def _beyond(error: UnicodeEncodeError) -> tuple[bytes, int]:
    """Letters of other alphabets are letters, two of five of them vowels."""
    part = error.object[error.start : error.end]
    return b"".join((_OTHER_VOWEL if ord(c) * 7 % 5 < 2 else _OTHER_LETTER) if c.isalpha() else _OTHER for c in part), error.end


codecs.register_error("loomwork-classes", _beyond)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of the rows of p and q (or of each row and one distribution)."""
    m = (p + q) / 2
    h = lambda x: (x * np.log2(np.maximum(x, 1e-30))).sum(axis=-1)
    return np.maximum(0.0, (h(p) + h(q)) / 2 - h(m))


def visible(text: str) -> str:
    """The text with tags turned into lines and fields."""
    if "<" in text:
        text = _TAG.sub("", _ROW_TAG.sub("\n", _CELL_TAG.sub("\t", text)))
    return html.unescape(text) if "&" in text else text


def counts_of(text: str) -> list[int]:
    """Counts of CLASSES, of UNITS, letters beyond the Windows alphabet, and the share of new bytes in UNITs."""
    text = visible(text)
    raw = text.encode("cp1252", "loomwork-classes")
    c = raw.translate(_CLASS)
    other = 0 if text.isascii() else raw.count(_OTHER_VOWEL) + raw.count(_OTHER_LETTER)
    if b"   " in c:
        c = _GAP.sub(b"f", c)
    items = 0
    if b"n" in c:
        c, items = _ITEM.subn(b"n", c)
    by = np.bincount(np.frombuffer(c, np.uint8), minlength=128)[_ORDS].tolist()
    n = dict(zip(CLASSES, by))
    after, commas = c.count(b"sn") + c.count(b"nn"), c.count(b"k ") + c.count(b"kn")
    units = [
        len(c.translate(_LETTERS).split()),
        len(c.translate(_DIGITS).split()) if n["d"] else 0,
        c.count(b"s ") + c.count(b"sn") + c.endswith(b"s"),
        commas,
        n["f"] + n["k"] - commas,
        after,
        max(0, n["n"] - after),
        items,
        n["m"],
        n["b"],
        n["y"] + n["o"],
    ]
    plain = text.encode("utf-8", "replace")
    packer = zstandard.ZstdCompressor(level=1)
    # 9 bytes are the frame's own
    size = sum(len(packer.compress(plain[i : i + PIECE])) - 9 for i in range(0, len(plain), PIECE))
    return [*by, *units, other, min(UNIT, size * UNIT // max(1, len(plain)))]


N_CLASS, N_UNIT = len(CLASSES), len(UNITS)
N_COUNTS = N_CLASS + N_UNIT + 2


class Words:
    """Function words by language."""

    def __init__(self, common: dict[str, set[str]]):
        self.langs = sorted(common)
        self.index = [{w: k for k, w in enumerate(sorted(common[x]))} for x in self.langs]
        self.size = max(map(len, self.index), default=0) + 1
        self.of: dict[str, list[int]] = {}
        for i, words in enumerate(self.index):
            for w in words:
                self.of.setdefault(w, []).append(i)

    def counts(self, text: str) -> list[int]:
        """The nearest language (-1 for none), counts of its words, and of other words at the end."""
        words = text.lower().split()
        used = Counter(filter(self.of.__contains__, words))
        out = [0] * (self.size + 1)
        shares = [0] * len(self.langs)
        for w, n in used.items():
            for i in self.of[w]:
                shares[i] += n
        # ties go to the first language by name
        best = max(range(len(shares)), key=shares.__getitem__) if used else -1
        hits = 0
        if used:
            for w, n in used.items():
                if (k := self.index[best].get(w)) is not None:
                    out[1 + k] = n
                    hits += n
        out[0], out[-1] = best, len(words) - hits
        return out


class Table:
    """The vectors of a batch of documents as distributions."""

    def __init__(self, vectors: list[bytes], size: int):
        rows = np.frombuffer(b"".join(vectors), np.int32).reshape(len(vectors), N_COUNTS + size + 1).astype(float)
        share = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
        self.classes, self.units = rows[:, :N_CLASS], rows[:, N_CLASS : N_CLASS + N_UNIT]
        self.lang, self.counted = rows[:, N_COUNTS].astype(int), rows[:, N_COUNTS + 1 :]
        new = rows[:, N_COUNTS - 1] / UNIT
        self.new = np.stack([new, 1 - new], axis=1)
        self.words, self.chars, self.parts = share(self.counted), share(self.classes), share(self.units)
        letters = np.maximum(self.classes[:, :3].sum(axis=1), 1)
        total = self.counted.sum(axis=1)
        self.weight = np.where(rows[:, N_COUNTS - 2] * 2 > letters, 0.0, total / (total + FEW_WORDS))

    def seeds(self) -> np.ndarray:
        """The profile of each plain case by basic counts; "" for the others."""
        by = {k: self.classes[:, i] / np.maximum(self.classes.sum(axis=1), 1) for i, k in enumerate(CLASSES)}
        u = dict(zip(UNITS, self.units.T))
        words, lines, ended = u["words"], u["breaks"] + 1, u["ended"]
        length = self.classes[:, :3].sum(axis=1) / np.maximum(words, 1)
        function = 1 - self.words[:, -1]
        vowels = self.classes[:, 0] / np.maximum(self.classes[:, :3].sum(axis=1), 1)
        rules = (
            ("junk: repeated", (self.new[:, 0] < 0.15) & (words > 20) & (u["separators"] < 0.1 * words)),
            ("table", (u["separators"] >= 1.4 * lines) & (lines >= 2) & (words < 8 * lines) & (words > 0.5 * lines) & (length < 15)),
            ("junk: digits", by["d"] > 0.6),
            ("junk: symbols", by["b"] + by["y"] > 0.4),
            ("junk: signs", by["o"] > 0.15),
            ("junk: code", (by["b"] > 0.05) & (by[" "] < 0.08)),
            ("junk: blob", (by[" "] < 0.05) & ((by["d"] > 0.3) | ((length > 9) & (by["U"] > 0.2)))),
            ("junk: random", (function < 0.02) & (vowels < 0.33) & (words > 10) & (lines < 3)),
            ("list: marked", (lines >= 3) & (u["item marks"] >= 0.5 * lines) & (words < 10 * lines)),
            ("list: lines", (lines >= 3) & (words < 8 * lines) & (ended < 0.3 * lines) & (length < 12)),
            ("list: commas", (u["commas"] > 0.2 * words) & (ended <= 2) & (lines < 3)),
            ("prose", (function > 0.2) & (words < 40 * ended) & (words >= 12) & (ended > 0.2 * lines)),
        )
        return np.select([m for _, m in rules], [k for k, _ in rules], "").astype(object)


#: Where a profile starts: shares of CLASSES and UNITS in percent, of function words and of new bytes.
START = {
    "prose": ((31, 46, 2, 1, 15, 1, 0, 1, 1, 2, 0, 0, 0), (84, 2, 4, 4, 0, 1, 1, 0, 4, 0, 0), 0.35, 0.5),
    "list: marked": ((30, 45, 3, 3, 12, 5, 0, 0, 0, 2, 0, 0, 0), (66, 5, 0, 0, 0, 1, 12, 12, 4, 0, 0), 0.1, 0.4),
    "list: lines": ((31, 47, 3, 2, 11, 4, 0, 0, 0, 2, 0, 0, 0), (75, 4, 0, 0, 0, 1, 14, 0, 6, 0, 0), 0.1, 0.4),
    "list: commas": ((31, 46, 3, 2, 13, 0, 0, 0, 4, 1, 0, 0, 0), (71, 4, 1, 22, 0, 0, 0, 0, 2, 0, 0), 0.1, 0.5),
    "table": ((16, 24, 4, 26, 6, 3, 10, 3, 3, 4, 0, 1, 0), (28, 28, 0, 0, 27, 1, 6, 0, 8, 0, 2), 0.05, 0.5),
    "junk: digits": ((0, 0, 0, 80, 20, 0, 0, 0, 0, 0, 0, 0, 0), (0, 100, 0, 0, 0, 0, 0, 0, 0, 0, 0), 0.0, 0.6),
    "junk: symbols": ((1, 1, 0, 0, 18, 0, 4, 4, 0, 6, 40, 26, 0), (1, 0, 3, 0, 6, 0, 0, 0, 8, 48, 34), 0.0, 0.7),
    "junk: signs": ((5, 9, 0, 0, 18, 0, 0, 11, 0, 0, 0, 12, 45), (8, 0, 5, 0, 0, 0, 0, 0, 0, 0, 87), 0.0, 0.25),
    "junk: code": ((18, 32, 0, 17, 2, 0, 8, 2, 0, 9, 12, 0, 0), (34, 16, 0, 0, 13, 0, 0, 0, 16, 20, 1), 0.0, 0.5),
    "junk: blob": ((10, 35, 18, 35, 0, 2, 0, 0, 0, 0, 0, 0, 0), (48, 48, 0, 0, 0, 0, 3, 0, 0, 1, 0), 0.0, 0.75),
    "junk: random": ((20, 67, 0, 0, 13, 0, 0, 0, 0, 0, 0, 0, 0), (100, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), 0.0, 0.75),
    "junk: repeated": ((30, 50, 2, 0, 15, 1, 0, 1, 1, 0, 0, 0, 0), (86, 0, 4, 3, 0, 1, 6, 0, 0, 0, 0), 0.2, 0.05),
}


class Profiles:
    """Means of distributions by profile; those of prose by language."""

    def __init__(self, sums: dict[tuple[str, int], np.ndarray], words: Words):
        self.names: list[tuple[str, int]] = [("prose", i) for i in range(len(words.langs))] + [(k, -1) for k in START if k != "prose"]
        if not words.langs:
            self.names.append(("prose", -1))
        width = N_CLASS + N_UNIT + 2
        prose = np.zeros((len(words.langs) + 1, words.size))
        prose[-1, -1] = 1.0
        self.mean, self.function = {}, {}
        for name, lang in self.names:
            classes, units, function, new = START[name]
            start = np.array([*np.array(classes) / sum(classes), *np.array(units) / sum(units), new, function]) * PRIOR
            total = sums.get((name, lang))
            got = start if total is None else start + total[1 : 1 + width] / UNIT
            self.mean[name, lang] = got[:-1] / (PRIOR + (0 if total is None else total[0]))
            self.function[name, lang] = got[-1] / (PRIOR + (0 if total is None else total[0]))
            if name == "prose" and lang >= 0:
                # function words of a language: the corpus's counts behind a flat start of PRIOR words
                known = len(words.index[lang])
                flat = np.zeros(words.size)
                flat[:known], flat[-1] = function / max(1, known), 1 - function
                counted = flat * PRIOR + (0 if total is None else total[1 + width :])
                prose[lang] = counted / counted.sum()
        self.prose = prose

    def of(self, t: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest profile, its divergence, divergence from the language's prose in function words)."""
        base = self.prose[t.lang]
        n = len(t.lang)
        apart = divergence(t.words, base)
        sums = np.empty((n, len(self.names)))
        for k, (name, lang) in enumerate(self.names):
            mean = self.mean[name, lang]
            chars, parts, new = mean[:N_CLASS], mean[N_CLASS : N_CLASS + N_UNIT], np.array([mean[-1], 1 - mean[-1]])
            if name == "prose":
                words = np.where((t.lang == lang) | ((t.lang < 0) & (lang <= 0)), apart, 1e6)
                words = np.where(words < 1e6, words * t.weight, words)
            else:
                # the language's words in the share that the profile has of them
                share = self.function[name, lang]
                scaled = base.copy()
                inside = np.maximum(scaled[:, :-1].sum(axis=1, keepdims=True), 1e-9)
                scaled[:, :-1] *= share / inside
                scaled[:, -1] = np.where(inside[:, 0] > 1e-6, 1 - share, 1.0)
                words = divergence(t.words, scaled) * t.weight
            sums[:, k] = words + divergence(t.chars, chars) + divergence(t.parts, parts) + divergence(t.new, new)
        best = sums.argmin(axis=1)
        return best, sums[np.arange(n), best], apart


def _summed(vectors: DataFrame, words: Words, profiles: Profiles | None) -> dict[tuple[str, int], np.ndarray]:
    """Sums by profile over the corpus: documents, then classes, units, new bytes and function share in UNITs, then words."""
    shared = vectors.sparkSession.sparkContext.broadcast((words, profiles))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, profiles = shared.value
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            t = Table(list(batch["v"]), words.size)
            names = t.seeds() if profiles is None else np.array([profiles.names[k][0] for k in profiles.of(t)[0]], object)
            each = np.rint(np.concatenate([t.chars, t.parts, t.new[:, :1], 1 - t.words[:, -1:]], axis=1) * UNIT)
            each = np.concatenate([np.ones((len(names), 1)), each, t.counted], axis=1).astype(np.int64)
            langs = np.where(names == "prose", t.lang, -1)
            for name, lang in set(zip(names.tolist(), langs.tolist())):
                if name:
                    mine = each[(names == name) & (langs == lang)].sum(axis=0)
                    total[name, lang] = total.get((name, lang), 0) + mine
        rows = [(name, lang, i, int(x)) for (name, lang), sums in total.items() for i, x in enumerate(sums) if x]
        yield pd.DataFrame(rows, columns=["name", "lang", "item", "n"])

    rows = vectors.mapInPandas(scan, "name string, lang int, item int, n long").groupBy("name", "lang", "item").agg(F.sum("n").alias("n"))
    width = 1 + N_CLASS + N_UNIT + 2 + words.size
    out: dict[tuple[str, int], np.ndarray] = {}
    # a number for each profile and dimension
    for r in rows.collect():
        out.setdefault((r.name, r.lang), np.zeros(width))[r.item] = r.n
    return out


def verdicts(docs: DataFrame, common_words: DataFrame, key: str = "id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """`docs` without its text, with kind, lang, prose_divergence and kind_divergence."""
    common: dict[str, set[str]] = {}
    # a list of the commonest words of each language: a table of settings
    for r in common_words.select("lang", "word").distinct().collect():
        if r.lang and r.word:
            common.setdefault(r.lang, set()).add(r.word.lower())
    words = Words(common)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("binary")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = shared.value
        for texts in batches:
            yield pd.Series([None if not t or t.isspace() else np.array(counts_of(t) + words.counts(t), np.int32).tobytes() for t in texts], dtype=object)

    rest = [c for c in docs.columns if c not in (text, "kind", "lang", "prose_divergence", "kind_divergence")]
    vectors = checkpointed(docs.select(*rest, vector(F.col(text)).alias("__v")))
    told = vectors.where(F.col("__v").isNotNull()).select(F.col("__v").alias("v"))
    profiles = Profiles(_summed(told, words, None), words)
    for _ in range(rounds):
        profiles = Profiles(_summed(told, words, profiles), words)
    learnt = docs.sparkSession.sparkContext.broadcast((words, profiles))

    @F.pandas_udf("struct<kind:string,lang:string,prose_divergence:double,kind_divergence:double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, profiles = learnt.value
        kinds = [name.split(":")[0] for name, _ in profiles.names]
        for vs in batches:
            out: list[tuple] = [(None, None, 0.0, 0.0)] * len(vs)
            at = np.flatnonzero(vs.notna())
            if len(at):
                t = Table([vs.iloc[i] for i in at], words.size)
                for i, k, d, apart, lang in zip(at, *profiles.of(t), t.lang):
                    out[i] = (kinds[k], words.langs[lang] if lang >= 0 else None, float(apart), float(d))
            yield pd.DataFrame(out, columns=["kind", "lang", "prose_divergence", "kind_divergence"])

    return vectors.withColumn("__j", judge(F.col("__v"))).select(*rest, "__j.*")


def statistics(docs: DataFrame, common_words: DataFrame, code=None, text: str = "text") -> DataFrame:
    """Counts by built-in expressions: words, mean word length, symbol ratio, share of lines ending in punctuation and
    share of common words of the text's own language: the one with the most of them, or `code` where that is given and
    has a list. Words are runs of letters."""
    # one row with one list for each language
    lists = common_words.where("lang IS NOT NULL").groupBy("lang").agg(F.collect_set("word").alias("words"))
    common = lists.agg(F.collect_list(F.struct("lang", "words")).alias("__common"))
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}+"), 0)
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    rest = [c for c in docs.columns if c not in (text, "words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words")]
    made = docs.withColumn("__lang", F.lit(None).cast("string") if code is None else code).withColumn("__w", words).withColumn("__l", lines).withColumn("__n", F.length(t)).withColumn("__letters", F.length(F.regexp_replace(t, r"\P{L}", ""))).withColumn("__symbols", F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,;:!?'\"()\-]", "")))
    ends = F.size(F.filter("__l", lambda x: F.rtrim(x).rlike(r"[.!?:;,]$")))
    joined = made.crossJoin(F.broadcast(common))
    given = F.filter("__common", lambda c: c["lang"] == F.col("__lang"))
    counts = F.transform(F.when(F.size(given) > 0, given).otherwise(F.col("__common")), lambda c: F.size(F.filter("__w", lambda w: F.array_contains(c["words"], w))))
    hits = F.coalesce(F.array_max(counts), F.lit(0))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return joined.select(
        *rest,
        F.size("__w").cast("long").alias("words"),
        share(F.col("__letters"), F.size("__w")).alias("mean_word_length"),
        share(F.col("__symbols"), F.col("__n")).alias("symbol_ratio"),
        share(ends, F.size("__l")).alias("ended_lines"),
        share(hits, F.size("__w")).alias("common_words"),
    )
