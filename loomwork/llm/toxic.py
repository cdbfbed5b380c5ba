"""Abusive, hateful or sexually explicit passages, document scores and rates by source (problem 3).

Method. A token's score is the log-odds of standing in abusive text rather than in the corpus, with Dirichlet priors on
both sides: the abusive side's prior follows the corpus, with some more mass for a short list of seed words. The counts
are learnt. Sentences with a seed and without a word of reports or rules about such language mark documents; tokens that
are commoner there than in the corpus give first odds; the sentences of those documents that are abusive by these odds
(or have a seed) are the abusive side of the final ones. So phrases without any seed are learnt from what they stand
with, and a seed with other uses is outweighed by the words around it: in each sentence a positive score counts with the
probability that its surroundings are abusive. A linear-time scan (Ruzzo and Tompa) finds every maximal-scoring segment
of a text. By extreme-value theory the number of chance segments of score S or more in n tokens is about K n exp(-L S);
L is solved from the corpus's distribution of scores, K fitted to the best segments of random texts drawn from it. A
text's score is the least of that number over its segments, as -log10; segments from `significant` on are reported.

Disguises are undone before scoring: look-alike letters and digits, letters pulled apart, stretched and starred words.
A sentence that a text repeats counts once, and equal texts are evidence once.

Scale. One pass counts tokens with map-side sums and writes the marked documents' sentences, a small part of the corpus,
to the checkpoint folder; one pass scores. Tokens that make up less than SHARE of the abusive evidence carry none, at
any size, so at most 1 / SHARE tokens are sent to the workers. Nothing depends on partitions.

Defined cases: null, empty and blank texts score 0; repeated rows score alike; a null source is its own slice; columns
with the names of results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .segments import maximal_segments
from .toxic_terms import CUES, PAIRS, SEEDS

#: Least share of a token in the abusive evidence.
SHARE = 1e-5
#: Pseudo-tokens of the abusive side's prior, and the share of them that each seed has.
PRIOR, SEED_SHARE = 300.0, 0.02
#: A sentence is abusive by the first odds if their sum and their mean are above these.
SUM_ODDS, MEAN_ODDS = 6.0, 1.0
CUE = -6.0
#: Between sentences.
BARRIER = -8.0
#: Least score of a token that makes a text worth a closer look.
HOT = 1.5
SIGNIFICANT = 2.0
#: Tokens on either side that tell whether surroundings are abusive.
AROUND = 20
#: Words of a sentence that counts as evidence, at most: longer ones are lists.
LONGEST = 60

_LIKE = str.maketrans("аеорсхуікмтнвј", "aeopcxyikmthbj")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "|": "i", "€": "e"})
_APART = re.compile(r"(?<![^\W\d_])(?:[^\W_]([.\-_*])(?:[^\W_]\1){2,}[^\W_]{1,3}|[^\W_](?: {1,3}[^\W_]){3,})(?![^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+(?:[*$@!|€]+[^\W_]+)*[$*]*")
_STRANGE = re.compile(r"[0-9$@!|€*]")
_STRETCH = re.compile(r"(.)\1{2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")
#: Letters, digits and what is not in the Windows alphabet, and separators, of a byte.
_OUTLINE = bytes(ord(" ") if chr(i) in " .-_*" else ord("w") if chr(i) == "?" or bytes([i]).decode("cp1252", "replace").isalnum() else ord("|") for i in range(256))
MASKED = "\x00masked"


def _matcher(stems: list[str]) -> tuple[frozenset, re.Pattern]:
    exact = frozenset(s for s in stems if not s.endswith("*"))
    open_ended = sorted({re.escape(s[:-1]) for s in stems if s.endswith("*")})
    return exact, re.compile("(?:" + "|".join(open_ended) + r")\w{0,3}")


_EXACT, _STEMS = _matcher(SEEDS)
_CUES = frozenset(CUES)
_PAIRS = {f"{a} {b}": (a, b) for a, b in PAIRS}
_SECOND = frozenset(b for _, b in PAIRS)


def role(word: str) -> int:
    """1 for a seed, -1 for a word of reports and rules, else 0."""
    return 1 if word == MASKED or word in _EXACT or word in _PAIRS or _STEMS.fullmatch(word) else -1 if word in _CUES else 0


def plain(text: str) -> str:
    """The text without capitals, look-alike letters and letters pulled apart."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", text).lower()
        if re.search("[а-ј]", text) and re.search("[a-z]", text):
            text = re.sub(r"\w*[a-z]\w*", lambda m: m.group().translate(_LIKE), text)
    # four letters pulled apart are looked for in the outline, which is quicker than by the pattern
    outline = text.encode("cp1252", "replace").translate(_OUTLINE)
    if b"  " in outline:
        outline = outline.replace(b"   ", b" ").replace(b"  ", b" ")
    return _APART.sub(_joined, text) if b"w w w w" in outline else text


def _joined(match: re.Match) -> str:
    letters = re.sub(r"[ .\-_*]", "", match.group())
    if not any(c.isalpha() for c in letters):
        return match.group()
    letters = letters.translate(_LEET)
    # an article in front belongs to the sentence
    if letters[:1] in "ai" and role(letters) == 0 and role(letters[1:]) == 1:
        return letters[0] + " " + letters[1:]
    return letters


def word_of(raw: str) -> str:
    """The plain word that a token of a plain text stands for."""
    if _STRANGE.search(raw) and not raw.isdigit():
        if re.fullmatch(r"[^\W\d_]\w?\*{1,}\w*", raw) and len(raw) >= 4:
            return MASKED
        raw = raw.translate(_LEET).strip("*")
    return _STRETCH.sub(r"\1", raw) if len(raw) > 3 else raw


def tokens(text: str) -> list[str]:
    """The plain words of a text."""
    return [word_of(w) for w in _TOKEN.findall(plain(text))]


class Chunks:
    """Stretches without white space and their words, kept by stretch."""

    def __init__(self):
        self.words: dict[str, tuple[str, ...]] = {}

    def of(self, chunk: str) -> tuple[str, ...]:
        found = self.words.get(chunk)
        if found is None:
            if len(self.words) > 500_000:
                self.words.clear()
            found = self.words[chunk] = tuple(word_of(w) for w in _TOKEN.findall(chunk))
        return found

    def sentence(self, text: str) -> list[str]:
        """The words of a sentence; a pair's second word stands for both."""
        out: list[str] = []
        for chunk in text.split():
            out += self.of(chunk)
        if not _SECOND.isdisjoint(out):
            out = [both if i and w in _SECOND and (both := f"{out[i - 1]} {w}") in _PAIRS else w for i, w in enumerate(out)]
        return out


def sentences(text: str) -> list[str]:
    """The distinct sentences of a plain text."""
    return list(dict.fromkeys(_SENTENCE.split(text)))


def seeded(words: list[str]) -> bool:
    roles = [role(w) for w in words]
    return 1 in roles and -1 not in roles and len(words) < LONGEST


GATHERED = "token string, n long, doc long, at int, words array<string>"


def gather(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of tokens (token, n), and the sentences of documents with a seeded one (doc, at, words)."""

    def counted(counts: Counter, chunks: Chunks) -> pd.DataFrame:
        total: Counter = Counter()
        for chunk, n in counts.items():
            for w in chunks.of(chunk):
                total[w] += n
        counts.clear()
        return pd.DataFrame([(w, n, None, None, None) for w, n in total.items()], columns=["token", "n", "doc", "at", "words"]).astype({"doc": "Int64", "at": "Int32"})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, chunks, known, marks = Counter(), Chunks(), set(), set()
        for batch in batches:
            rows = []
            for t in batch["t"]:
                text = plain(t)
                parts = text.split()
                counts.update(parts)
                if not known.issuperset(parts):
                    for chunk in set(parts) - known:
                        if any(w in _SECOND or role(w) == 1 for w in chunks.of(chunk)):
                            marks.add(chunk)
                    known.update(parts)
                if not marks.isdisjoint(parts):
                    found = [chunks.sentence(s) for s in sentences(text)]
                    if any(map(seeded, found)):
                        doc = xxhash.xxh64_intdigest(text) - (1 << 63)
                        rows += [(None, None, doc, i, ws) for i, ws in enumerate(found) if ws]
            if rows:
                yield pd.DataFrame(rows, columns=["token", "n", "doc", "at", "words"]).astype({"n": "Int64"})
            if len(known) > 1_000_000:
                yield counted(counts, chunks)
                known.clear()
                marks.clear()
        yield counted(counts, chunks)

    return docs.select(F.col(text).alias("t")).where(F.length("t") > 0).mapInPandas(scan, GATHERED)


def _odds(a: float, n: float, side: float, total: float, prior: float, seed: float = 0.0) -> float:
    """Log-odds of a token with `a` of `side` tokens on the abusive side and `n` of `total` in the corpus."""
    p = n / total
    return math.log((a + prior * (p + seed)) / (side + prior) / p)


class Scores:
    """Log-odds by token, and the extreme-value parameters."""

    def __init__(self, rows: list[tuple[str, int, int]], side: int, total: int, vocabulary: int):
        """rows: (token, its count in the corpus, its count on the abusive side)."""
        self.side, self.total = side, max(1, total)
        # unseen tokens get one pseudo-count each
        self.size = self.total + max(1, vocabulary)
        self.neutral = self._of(0.0, 1.0, 0)
        self.value = {w: self._of(a, n + 1.0, role(w)) for w, n, a in rows}
        self.seed = self._of(0.0, 1.0, 1)
        self.prior = math.log((side + 1) / self.size)
        scores = np.array([self.neutral, *(self.value[w] for w, *_ in rows)])
        counts = np.array([max(0.0, self.total - sum(n for _, n, _ in rows)), *(n for _, n, _ in rows)]) / self.total
        self.rate = self._rate(scores, counts / max(counts.sum(), 1e-12))
        self.k = self._k(scores, counts / max(counts.sum(), 1e-12))

    def _of(self, a: float, n: float, kind: int) -> float:
        if kind < 0:
            return CUE
        return max(-5.0, min(8.0, _odds(a, n, self.side, self.size, PRIOR, SEED_SHARE if kind else 0.0)))

    @staticmethod
    def _rate(scores: np.ndarray, counts: np.ndarray) -> float:
        """L with sum of p exp(L s) = 1 over the corpus's tokens."""
        low, high = 0.05, 3.0
        for _ in range(60):
            mid = (low + high) / 2
            if (counts * np.exp(mid * scores)).sum() > 1:
                high = mid
            else:
                low = mid
        return low

    def _k(self, scores: np.ndarray, counts: np.ndarray, texts: int = 400, length: int = 1000) -> float:
        """K from the best segments of random texts: their mean is (ln(K n) + Euler's constant) / L."""
        rng = np.random.default_rng(11)
        best, now = np.zeros(texts), np.zeros(texts)
        edges = np.cumsum(counts)
        for _ in range(length):
            now = np.maximum(0.0, now + scores[np.minimum(np.searchsorted(edges, rng.random(texts)), len(scores) - 1)])
            best = np.maximum(best, now)
        return float(np.clip(math.exp(min(50.0, self.rate * best.mean() - 0.5772)) / length, 1e-3, 1.0))

    def of(self, word: str) -> float:
        v = self.value.get(word)
        if v is None:
            kind = role(word)
            v = self.neutral if kind == 0 else CUE if kind < 0 else self.seed
        return v

    def likely(self, odds: list[float]) -> list[float]:
        """For each token of a sentence the probability that what stands around it is abusive."""
        known = [max(-3.0, v) for v in odds]
        n = len(known)
        sums = [0.0]
        for v in known:
            sums.append(sums[-1] + v)
        out = []
        for i in range(n):
            z = self.prior + sums[min(n, i + AROUND + 1)] - sums[max(0, i - AROUND)]
            out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
        return out

    def passages(self, text: str, chunks: Chunks) -> list[tuple[float, str]]:
        """(-log10 of the expected number of chance segments, words) of each segment of a plain text, best first."""
        words, scores, n = [], [], 0
        for sentence in sentences(text):
            found = chunks.sentence(sentence)
            n += len(found)
            odds = [self.of(w) for w in found]
            # sentences without any evidence only separate
            if max(odds, default=0.0) >= HOT:
                words += [*found, "."]
                scores += [*(v * p if v > 0 else v for v, p in zip(odds, self.likely(odds))), BARRIER]
        if not any(s >= HOT for s in scores):
            return []
        base = math.log10(self.k * n)
        found = [(self.rate * s / math.log(10) - base, " ".join(words[a:b]).replace(MASKED, "***")) for a, b, s in maximal_segments(scores)]
        return sorted(found, reverse=True)


def learn(docs: DataFrame, text: str = "text") -> Scores:
    """The scores of tokens from the corpus."""
    spark = docs.sparkSession
    gathered = checkpointed(gather(docs, text))
    counts = gathered.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    marked = gathered.where("doc IS NOT NULL").select("doc", "at", "words").dropDuplicates(["doc", "at"])
    near = marked.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("a"))
    near_side = near.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
    # at most 1 / SHARE rows
    first = near.where((F.col("a") >= 2) & (F.col("a") >= SHARE * near_side)).join(counts, "token").collect()
    odds = spark.sparkContext.broadcast({r.token: _odds(r.a, r.n, near_side, total, 200.0) for r in first})

    def abusive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, found = odds.value, Counter()
        for batch in batches:
            for words in batch["words"]:
                words = list(words)
                value = sum(known.get(w, 0.0) for w in words)
                if seeded(words) or (value > max(SUM_ODDS, MEAN_ODDS * len(words)) and len(words) < LONGEST and not any(role(w) < 0 for w in words)):
                    found.update(set(words))
        yield pd.DataFrame(list(found.items()), columns=["token", "a"])

    side_counts = marked.mapInPandas(abusive, "token string, a long").groupBy("token").agg(F.sum("a").alias("a"))
    side = side_counts.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
    rows = side_counts.where(F.col("a") >= SHARE * side).join(counts, "token").select("token", "n", "a").collect()
    # sorted, so that sums of fractions come out the same
    return Scores(sorted(tuple(r) for r in rows), side, total, vocabulary)


def score(docs: DataFrame, key: str = "id", text: str = "text", significant: float = SIGNIFICANT) -> DataFrame:
    """`docs` without its text: `score` (0 if nothing is found), whether it is `toxic`, and the significant passages."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text))

    @F.pandas_udf("struct<score:double,passages:array<string>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores, chunks, known, hot = shared.value, Chunks(), set(), set()

        def passages(t: str) -> list[tuple[float, str]]:
            text = plain(t)
            parts = text.split()
            if not known.issuperset(parts):
                if len(known) > 1_000_000:
                    known.clear()
                    hot.clear()
                new = set(parts) - known
                hot.update(c for c in new if any(w in _SECOND or scores.of(w) >= HOT for w in chunks.of(c)))
                known.update(new)
            return [] if hot.isdisjoint(parts) else scores.passages(text, chunks)

        for texts in batches:
            out = [passages(t) if t else [] for t in texts]
            yield pd.DataFrame({"score": [max(0.0, p[0][0]) if p else 0.0 for p in out], "passages": [[w for s, w in p if s >= significant] for p in out]})

    rest = [c for c in docs.columns if c not in (text, "score", "toxic", "passages")]
    return docs.withColumn("__s", scan(F.col(text))).select(*rest, F.col("__s.score").alias("score"), (F.col("__s.score") >= significant).alias("toxic"), F.col("__s.passages").alias("passages"))


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """Records, toxic records and their rate in each slice."""
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("toxic").cast("long")).alias("toxic_docs"), F.round(F.avg(F.col("toxic").cast("double")), 6).alias("toxic_rate"))
