"""Row-local curation operators: normalization, HTML, quality rules, masking by pattern and abusive-word density."""

from __future__ import annotations

import html.parser
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Curation
from ..functions import text as T

#: Phrases of page furniture (fixed values).
FURNITURE = r"(accept (all )?cookies|cookie (policy|settings)|privacy policy|terms of (use|service)|all rights reserved|subscribe to|sign up for|newsletter|follow us|share this|read more|click here|skip to content|start \| contact|back to top|log in|sign in)"
DROPPED_TAGS = ("script", "style", "noscript", "nav", "footer", "header", "form", "iframe", "svg", "aside")
TAGS = r"<(/?(html|body|div|p|br|span|table|tr|td|th|ul|ol|li|h[1-6]|a|nav|header|footer|article|main|section|script|style)([ \t\n][^<>]*)?/?)>"


def html_like(text: Column) -> Column:
    return F.lower(text).rlike(TAGS)


def strip_tags(text: Column) -> Column:
    """Markup removed by patterns: dropped elements with their content, then tags, then the commonest entities."""
    t = F.regexp_replace(text, r"(?is)<!--.*?-->", "")
    for tag in DROPPED_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}([ \t\n][^<>]*)?>.*?</{tag}>", "")
    t = F.regexp_replace(t, r"(?is)<[a-z/!][^<>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def without_furniture(text: Column) -> Column:
    """Without short lines of page furniture and lines that are menus (short cells between bars)."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    dull = lambda x: ((F.length(x) < 120) & F.lower(x).rlike(FURNITURE)) | ((bars(x) >= 2) & (F.length(x) / (bars(x) + 1) < 20))
    return F.array_join(F.filter(lines, lambda x: (x == "") | ~dull(x)), "\n")


def normalized(text: Column) -> Column:
    """The pattern form of the whole normalization step."""
    plain = F.when(F.contains(text, F.lit("<")) & html_like(text), strip_tags(text)).otherwise(text)
    return T.let(T.tidy(plain), lambda t: T.tidy(without_furniture(t)))


class _Main(html.parser.HTMLParser):
    """Text nodes by container; the text of main, else article, else the whole page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.parts = [], [], {"main": [], "article": [], "": []}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        label = f"{a.get('class') or ''} {a.get('id') or ''}".lower()
        dull = tag in DROPPED_TAGS or "cookie" in label or "newsletter" in label or "banner" in (a.get("class") or "").lower() or a.get("role") == "navigation"
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            if self.skip:
                self.skip.append(tag)
            elif dull:
                self.skip = [tag]
            elif tag in ("main", "article"):
                self.open.append(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
        elif tag in self.open:
            self.open.remove(tag)

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts[""].append(data.strip())
            for tag in set(self.open):
                self.parts[tag].append(data.strip())


def main_text(page: str | None) -> str | None:
    """The main text of a page, by a parser."""
    if page is None:
        return None
    parser = _Main()
    parser.feed(page)
    parser.close()
    return "\n".join(parser.parts["main"] or parser.parts["article"] or parser.parts[""])


def main_text_of(page: str) -> Column:
    @F.pandas_udf("string")
    def parsed(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return parsed(F.col(page))


def compatible(text: str) -> Column:
    """Unicode compatibility form (NFKC); there is no built-in expression for it."""

    @F.pandas_udf("string")
    def formed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return formed(F.col(text))


_GARBLED = re.compile("[ÂÃÅâãð][\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3}")


def _read_again(text: str) -> str | None:
    for encoding in ("cp1252", "latin-1"):
        try:
            return text.encode(encoding).decode("utf-8")
        except UnicodeError:
            pass
    return None


def reread_text(text: str) -> str:
    """A text whose UTF-8 bytes were read in a Windows or Latin alphabet, read again: as a whole if that leaves fewer
    garbled runs, else run by run; runs that do not fit stay."""
    found = len(_GARBLED.findall(text))
    if not found:
        return text
    whole = _read_again(text)
    if whole is not None and len(_GARBLED.findall(whole)) < found:
        return whole
    return _GARBLED.sub(lambda m: _read_again(m.group()) or m.group(), text)


def reread(text: str) -> Column:
    @F.pandas_udf("string")
    def fixed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else reread_text(t))

    return fixed(F.col(text))


def readable(text: str) -> Column:
    """The text read again and in compatibility form, in one pass over the texts that are not plain ASCII."""

    @F.pandas_udf("string")
    def formed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", reread_text(t)))

    t = F.col(text)
    odd = t.rlike(r"[^\x00-\x7f]")
    return F.when(odd, formed(F.when(odd, t))).otherwise(t)


# ---- quality rules

#: One symbol (a fixed value).
SYMBOLS = r"[#$%&*@^~<>{}\[\]|\\_=+]"


def measures(docs: DataFrame, text: str = "text", stop_words: list[str] = T.STOP_WORDS) -> DataFrame:
    """`docs` with one struct `m` of all measures of the quality rules but the n-gram shares."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    base = docs.withColumn("__w", T.tokens(t)).withColumn("__l", lines)
    n = F.size("__w")
    stops = F.size(F.filter("__w", lambda w: w.isin(*stop_words)))
    letters = F.aggregate("__w", F.lit(0), lambda a, w: a + F.length(w))
    measured = F.struct(
        F.length(t).alias("chars"),
        T.share(t, SYMBOLS).alias("symbol_ratio"),
        T.share(t, r"[0-9]").alias("digit_ratio"),
        T.share(t, r"\p{L}").alias("alpha_ratio"),
        F.size("__l").alias("lines"),
        F.coalesce(1 - F.try_divide(F.size(F.array_distinct("__l")), F.size("__l")), F.lit(0.0)).alias("dup_lines"),
        n.alias("words"),
        F.coalesce(F.try_divide(stops, n), F.lit(0.0)).alias("stop_share"),
        F.coalesce(F.try_divide(letters, n), F.lit(0.0)).alias("word_length"),
    )
    return base.withColumn("m", measured).drop("__w", "__l")


def top_ngrams(docs: DataFrame, key: str, n: int, text: str = "text") -> DataFrame:
    """(key, top, words): the largest count of an n-gram of each text that repeats one more than twice."""
    t = F.coalesce(F.col(text), F.lit(""))
    # counted within the row: sorted n-grams, and the longest run of equal neighbours; no shuffle of n-grams
    grams = docs.select(key, T.tokens(t).alias("w")).select(key, F.size("w").alias("words"), F.sort_array(T.ngrams(F.col("w"), n)).alias("g"))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(a: Column, g: Column) -> Column:
        run = F.when(a["last"] == g, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("last"), run.alias("run"), F.greatest(a["top"], run).alias("top"))

    return grams.select(key, "words", F.aggregate("g", start, step)["top"].cast("long").alias("top")).where("top > 2")


def reason_of(text: Column, c: Curation = Curation()) -> Column:
    """The first failing rule of a text, or "kept"; row-local. The dear n-gram rules run only on rows that pass the cheap
    ones, and measures are computed when a rule asks for them."""
    t = F.coalesce(text, F.lit(""))

    def top(words: Column, n: int) -> Column:
        """The largest count of an n-gram."""
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

        def step(a: Column, g: Column) -> Column:
            run = F.when(a["last"] == g, a["run"] + 1).otherwise(F.lit(1))
            return F.struct(g.alias("last"), run.alias("run"), F.greatest(a["top"], run).alias("top"))

        return F.aggregate(F.sort_array(T.ngrams(words, n)), start, step)["top"]

    def of_words(w: Column) -> Column:
        n = F.size(w)
        repeats = lambda k: T.let(top(w, k), lambda x: (x > 2) & (x * k / n > c.max_ngram_ratio))
        stops = F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: x.isin(*T.STOP_WORDS))), n), F.lit(0.0))
        length = F.coalesce(F.try_divide(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), n), F.lit(0.0))
        return (
            F.when(n < c.min_words, "too_few_words")
            .when(repeats(2), "top_2gram")
            .when(repeats(3), "top_3gram")
            .when(stops < c.min_stop_share, "no_stopwords")
            .when((length < c.min_word_length) | (length > c.max_word_length), "word_length")
            .otherwise("kept")
        )

    def repeated_lines(lines: Column) -> Column:
        return (F.size(lines) >= 3) & (1 - F.try_divide(F.size(F.array_distinct(lines)), F.size(lines)) > c.max_dup_line_ratio)

    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (
        F.when(F.length(t) < c.min_chars, "too_short")
        .when(F.length(t) > c.max_chars, "too_long")
        .when(T.share(t, SYMBOLS) > c.max_symbol_ratio, "symbol_ratio")
        .when(T.share(t, r"[0-9]") > c.max_digit_ratio, "digit_ratio")
        .when(T.share(t, r"\p{L}") < c.min_alpha_ratio, "low_alpha")
        .when(T.let(lines, repeated_lines), "dup_lines")
        .otherwise(T.let(T.tokens(t), of_words))
    )


def quality_reason(docs: DataFrame, key: str, text: str = "text", c: Curation = Curation()) -> DataFrame:
    """(key, reason) of every row."""
    return docs.select(key, reason_of(F.col(text), c).alias("reason"))


# ---- masking by pattern

# Patterns of personal information (fixed values). Every one is bounded, so that nothing inside of a longer word or number is masked. The bounds are written as \\b and
# \\B, which other engines have, too.
EMAIL = r"\b[\w.+-]+@[\w-]+(\.[\w-]+)+\b"
SOCIAL = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){3,7}( ?[A-Z0-9]{1,3})?\b"
CARD = r"\b[0-9]([ -]?[0-9]){12,18}\b"
IPV4 = r"\b(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\b"
#: Street words (fixed values).
STREETS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Boulevard Blvd".split()
STREET = r"\b[0-9]{1,5}[ \t\n]+([A-Z][a-z]+[ \t\n]){1,3}(" + "|".join(STREETS) + r")\b\.?"
_GROUP = r"(\(?[0-9]{2,4}\)?[ \t\n.\-]?)"
#: Groups of digits behind an international prefix or not, by what the number begins with.
PHONE = "(" + "|".join([r"\B\+[0-9]{1,3}[ \t\n.\-]?" + _GROUP + "{2,4}", r"\b[0-9]{1,3}[ \t\n.\-]?" + _GROUP + "{2,4}", r"\b[0-9]{2,4}\)?[ \t\n.\-]?" + _GROUP + "{1,3}", r"\B\([0-9]{2,4}\)?[ \t\n.\-]?" + _GROUP + "{1,3}"]) + r")[0-9]{3,4}\b"
#: In the order in which they run; each works on what the one before left.
MASKS = (("email", EMAIL, "<EMAIL>"), ("social", SOCIAL, "<ID>"), ("iban", IBAN, "<IBAN>"), ("card", CARD, "<CARD>"), ("ip", IPV4, "<IP>"), ("address", STREET, "<ADDRESS>"), ("phone", PHONE, "<PHONE>"))


def _not_card(match: Column) -> Column:
    digits = F.regexp_replace(match, "[ -]", "")
    return ~(F.call_function("luhn_check", digits) & F.length(digits).between(13, 19))


def _not_phone(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")) < 9


def mask_one(text: Column, kind: str) -> Column:
    _, pattern, put = next(m for m in MASKS if m[0] == kind)
    if kind == "card":
        return T.replaced_where(text, pattern, _not_card, put)
    if kind == "phone":
        return T.replaced_where(text, pattern, _not_phone, put)
    return F.regexp_replace(text, pattern, put)


def masked(text: Column, kinds: tuple[str, ...] = tuple(m[0] for m in MASKS)) -> Column:
    for kind in kinds:
        text = mask_one(text, kind)
    return text


def mask_counts(masked_text: Column) -> Column:
    """How many placeholders of each kind a masked text has, as a map without zeros."""
    pairs = [x for _, _, put in MASKS for x in (F.lit(put), F.regexp_count(masked_text, F.lit(put)))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v > 0)


# ---- abusive words

#: Words counted for English texts (fixed values).
ABUSIVE = "idiot idiots moron morons stupid bitch asshole fuck fucking shit bastard scum vermin whore slut porn nude naked horny".split()


def abusive_share(text: Column) -> Column:
    ws = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    return F.coalesce(F.try_divide(F.size(F.filter(ws, lambda w: w.isin(*ABUSIVE))), F.size(ws)), F.lit(0.0))
