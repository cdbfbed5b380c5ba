"""Text that was decoded with a wrong character encoding: finding and restoring it (problem 10).

Method. Adjacent character pairs of the corpus are counted and scored by their mutual information, log2 of how much more
often a pair stands than its characters' frequencies let expect. Counts come from the texts in which no pair looks like
the image of a multi-byte sequence, so garbling does not vouch for itself. Pairs that are improbable have positive
scores here, and the maximum-scoring segments of a text are the improbable runs. Only inside those runs inverse mappings
are tested: the characters go back to the bytes that they stand for in a single-byte (or East Asian) encoding and are
read as UTF-8, or in the encoding of another script; sequences that lost a byte are completed by the candidate that fits
its neighbours best. A mapping is taken if the pairs that it makes are more probable than those it takes away. This is
repeated for text that was garbled several times, and numeric escapes of garbled characters are resolved first.

Counting takes one pass and map-side aggregation by pair. Characters beyond the alphabets and signs that misread text
consists of count as their block of 128, so that the table has at most about 3,300 characters (it has some ten thousand
pairs in practice) however many ideographs the corpus uses. A pair's own place does not vouch for it: one is taken off
its count, so that a pair that stands once scores like an unseen one and need not be sent anywhere.

Defined cases: null, empty and blank texts are not affected and come out as they are; text with the replacement
character is affected but its lost characters stay lost; rare right characters, other scripts and typographic signs fit
no inverse mapping; equal rows come out equal; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import maximal_segments

#: Single-byte encodings in which UTF-8 is commonly misread, in the order in which ties are decided.
MISREAD = ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "iso8859-5", "iso8859-7", "cp1257")
#: Of these, the ones whose images of multi-byte sequences are common pairs of right text.
CYRILLIC = ("koi8-r", "cp866", "iso8859-5", "iso8859-7", "cp1253")
#: (read as, really) for texts of other scripts in a single-byte or East Asian encoding.
SWAPPED = [(a, b) for a in ("cp1252", "mac-roman", "cp437", "cp1251", "koi8-r") for b in ("cp1251", "koi8-r", "cp866", "cp1253", "shift_jis", "euc_jp", "gbk") if a != b]
#: The marks that most three-byte sequences stand for.
MARKS = "’“”–—…‘•€™„‚"
LOST = "�"
UNSEEN = math.log2(0.02)
#: Least gain in bits of a mapping to UTF-8, and of a swap, which has no check by structure.
GAIN, SWAP_GAIN = 1.0, 12.0
_HIGH = re.compile(r"[^\x00-\x7f]+")
#: Beyond Latin, Greek and Cyrillic letters, punctuation, arrows, mathematical signs and box drawing.
_FAR = re.compile("[^\x00-\u052f\u2000-\u25ff]")
_ESCAPE = re.compile(r"(?:&#(?:1[2-9]\d|[2-9]\d\d|\d{4,5}|x[0-9a-fA-F]{2,4});|\\u[0-9a-fA-F]{4})+")


def _images(encoding: str) -> dict[int, str]:
    """The character of each byte from 128; bytes without one are read as the control characters of that number."""
    out = {}
    for byte in range(128, 256):
        try:
            out[byte] = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            out[byte] = chr(byte)
    return out


def near(text: str) -> str:
    """The text with each far character as the first of its block; of the same length."""
    return _FAR.sub(lambda m: chr(ord(m.group()) & ~0x7F), text)


class Inverse:
    """The way back from one misread encoding."""

    def __init__(self, encoding: str):
        images = _images(encoding)
        self.encoding = encoding
        self.bytes = {c: b for b, c in images.items()}
        if encoding in ("cp1252", "cp1254"):  # control characters that were passed through
            for byte in range(128, 160):
                self.bytes.setdefault(chr(byte), byte)

        def some(low: int, high: int) -> str:
            return "[" + "".join(re.escape(c) for c, b in self.bytes.items() if low <= b <= high) + "]"

        tail = some(0x80, 0xBF)
        self.pattern = re.compile(f"{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}}")
        lead3, space = re.escape(images[0xE2]), re.escape(images[0xA0])
        self.lost = re.compile(f"{lead3}{re.escape(images[0x80])}(?!{tail})|{lead3}(?={tail})(?!{re.escape(images[0x80])}){tail}|{lead3}(?!{tail})")
        self.blank = re.compile(f"{re.escape(images[0xC3])} " if space != " " else r"(?!)")

    def _whole(self, match: re.Match) -> str:
        try:
            return bytes(self.bytes[c] for c in match.group()).decode("utf-8")
        except UnicodeDecodeError:
            return match.group()

    def apply(self, text: str) -> str:
        return self.pattern.sub(self._whole, text)


_INVERSES: list[Inverse] = []


def inverses() -> list[Inverse]:
    if not _INVERSES:
        _INVERSES.extend(Inverse(e) for e in MISREAD)
    return _INVERSES


_SUSPECT: list[re.Pattern] = []


def suspect() -> re.Pattern:
    """A pair that may be the image of a multi-byte sequence, or a run of letters that may be another script's."""
    if not _SUSPECT:
        _SUSPECT.append(re.compile("|".join([*(i.pattern.pattern for i in inverses() if i.encoding not in CYRILLIC), "[À-ÿ]{3}", "[\x80-\x9f]", LOST])))
    return _SUSPECT[0]


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b, n): counts of adjacent characters with at least one beyond ASCII, and of characters (b is empty)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doubtful, pairs, single = suspect(), Counter(), Counter()
        for batch in batches:
            for t in batch["text"]:
                single.update(t)
                for m in _HIGH.finditer(t):
                    a, b = max(0, m.start() - 1), min(len(t), m.end() + 1)
                    if b - a > 2 and not doubtful.search(t, a, b):
                        pairs.update(zip(t[a : b - 1], t[a + 1 : b]))
        rows: Counter = Counter()
        for (a, b), n in pairs.items():
            rows[near(a), near(b)] += n
        for a, n in single.items():
            rows[near(a), ""] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in rows.items()], columns=["a", "b", "n"])

    return docs.select(F.col(text).alias("text")).where(F.length("text") > 0).mapInPandas(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Probable:
    """Mutual information of pairs, from the counts' rows."""

    def __init__(self, rows: list):
        single = {r[0]: r[2] for r in rows if r[1] == ""}
        total = sum(single.values()) or 1
        self.pmi = {}
        for a, b, n in rows:
            if b != "":
                expected = single.get(a, 1) * single.get(b, 1) / total
                self.pmi[a + b] = min(6.0, math.log2((n - 1 + 0.02 * expected) / expected))

    def of(self, text: str) -> float:
        """The sum over pairs with a character beyond ASCII."""
        get = self.pmi.get
        text = near(text)
        return sum(get(text[i : i + 2], UNSEEN) for i in range(len(text) - 1) if not text[i : i + 2].isascii())

    def runs(self, text: str) -> list[tuple[int, int]]:
        """The improbable runs, as spans with a character on either side."""
        out: list[tuple[int, int]] = []
        get = self.pmi.get
        text = near(text)
        # stretches between long pure ASCII ones are looked at by themselves: there every score is negative
        spans: list[list[int]] = []
        for m in _HIGH.finditer(text):
            a, b = max(0, m.start() - 1), min(len(text), m.end() + 1)
            if spans and a - spans[-1][1] < 12:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        for a, b in spans:
            scores = []
            for i in range(a, b - 1):
                pair = text[i : i + 2]
                scores.append(-0.5 if pair.isascii() else -get(pair, UNSEEN) - 0.5)
            for start, stop, score in maximal_segments(scores):
                if score > 2:
                    lo, hi = a + start, a + stop + 1
                    # whole runs of characters beyond ASCII, with one more on either side
                    while lo > 0 and not text[lo].isascii():
                        lo -= 1
                    while hi < len(text) and not text[hi - 1].isascii():
                        hi += 1
                    if out and lo < out[-1][1]:
                        out[-1] = (out[-1][0], max(hi, out[-1][1]))
                    else:
                        out.append((lo, hi))
        return out


def _swap(run: str, read: str, real: str) -> str:
    try:
        return run.encode(read).decode(real)
    except UnicodeError:
        return run


def _unwound(run: str, inverse: Inverse) -> Iterator[str]:
    """The run after one inverse step, and after more of them: what was garbled twice is unknown to the corpus in between."""
    text = inverse.apply(run)
    if text == run:
        return
    yield text
    for again in (inverse, *inverses()[:2]):
        deeper = text
        for _ in range(3):
            further = again.apply(deeper)
            if further == deeper:
                break
            deeper = further
            yield deeper


def repair_run(run: str, probable: Probable, garbled: bool = False) -> tuple[str, str]:
    """The most probable text that an inverse mapping gives for the run, and the encoding; the run and "" if none is taken.

    garbled: other runs of the text were; only then a lone letter counts as one whose no-break space became a space.
    """
    base = probable.of(run)
    best, name, score = run, "", base + GAIN
    for inverse in inverses():
        for text in _unwound(run, inverse):
            if (now := probable.of(text)) > score:
                # what comes out must be known to the corpus, unless many sequences fit
                pairs = sum(not text[i : i + 2].isascii() for i in range(len(text) - 1))
                if now > pairs * (UNSEEN + 1.5) or len(run) - len(text) >= 6:
                    best, name, score = text, inverse.encoding, now
    if sum(c > "\x7f" for c in run) >= 4:
        for read, real in SWAPPED:
            text = _swap(run, read, real)
            if text != run and (now := probable.of(text)) > max(score + GAIN, base + SWAP_GAIN) and now > len(run):
                best, name, score = text, f"{real} as {read}", now
    if not name:
        for inverse in inverses()[:3]:
            for pattern, choices in ((inverse.lost, MARKS), (inverse.blank, ("à ",) if garbled or run[:1].isalpha() else ())):
                m = pattern.search(run) if choices else None
                while m:
                    around = run[max(0, m.start() - 1) : m.end() + 1]
                    options = [(probable.of(run[max(0, m.start() - 1) : m.start()] + c + run[m.end() : m.end() + 1]), c) for c in choices]
                    value, choice = max(options, key=lambda o: o[0])
                    if value > probable.of(around) + 4:
                        text = run[: m.start()] + choice + run[m.end() :]
                        return text, inverse.encoding + " lossy"
                    m = pattern.search(run, m.end())
    return best, name


def repair(text: str, probable: Probable, rounds: int = 5) -> tuple[str, list[str]]:
    """The restored text and the mappings taken, in order; no mapping means that the text is not affected."""
    taken: list[str] = []
    if "&#" in text or "\\u" in text:
        def resolved(m: re.Match) -> str:
            plain = html.unescape(re.sub(r"\\u([0-9a-fA-F]{4})", lambda x: chr(int(x.group(1), 16)), m.group()))
            for inverse in inverses()[:2]:
                if inverse.apply(plain) != plain:
                    taken.append("escaped")
                    return plain
            return m.group()

        text = _ESCAPE.sub(resolved, text)
    for _ in range(rounds):
        parts, last, changed = [], 0, False
        for a, b in probable.runs(text):
            fixed, name = repair_run(text[a:b], probable, bool(taken))
            if name:
                parts += [text[last:a], fixed]
                last, changed = b, True
                taken.append(name)
        if not changed:
            break
        text = "".join([*parts, text[last:]])
    if LOST in text:
        taken.append("lost characters")
    return text, taken


def repaired(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The affected rows: key, the restored text and the mappings that were taken."""
    # pairs that stand once score as unseen; the rest is a table of an alphabet
    rows = [tuple(r) for r in pair_counts(docs, text).where((F.col("n") > 1) | (F.col("b") == "")).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Probable(rows))
    kind = docs.schema[key].dataType.simpleString()

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probable = shared.value
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"]):
                fixed, taken = repair(t, probable)
                if taken:
                    out.append((k, fixed, " > ".join(dict.fromkeys(taken))))
            yield pd.DataFrame(out, columns=[key, "restored", "mappings"])

    # a text of ASCII without escapes cannot be affected; the test runs in the JVM
    possible = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]|&#|\\u[0-9a-fA-F]{4}"))
    return possible.mapInPandas(fix, f"{key} {kind}, restored string, mappings string")
