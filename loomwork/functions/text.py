"""Column expressions on texts, all built in: they stay in the JVM and can be used in any projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are deleted: controls but tab and line ends, zero-width characters, separators and byte order marks.
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{2028}\x{2029}\x{feff}]"
#: English function words of the stop-word rule (fixed values).
STOP_WORDS = "a about after all also an and are as at be because been but by can did do for from had has have he her his how if in into is it its more most no not of on one or other our out she so some such than that the their them then there these they this to up was we were what when which who will with would you".split()


def tidy(text: Column) -> Column:
    """Without control characters, with single spaces, at most one empty line in a row and no blank ends."""
    t = F.regexp_replace(text, CONTROLS, "")
    t = F.regexp_replace(t, r"[ \t\x{a0}]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^[ \n\r]+|[ \n\r]+$", "")


def words(text: Column) -> Column:
    """Runs of lower-case ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def tokens(text: Column) -> Column:
    """Tokens between white space, in lower case."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda x: x != "")


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once: an expression inside of a lambda is otherwise computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(array: Column, n: int) -> Column:
    """Joined runs of n elements; none if the array is shorter."""

    def grams(a: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.array_join(F.slice(a, i, n), " "))
        return F.when(F.size(a) >= n, each).otherwise(F.array().cast("array<string>"))

    return let(array, grams)


def share(text: Column, pattern: str) -> Column:
    """Share of the characters that match a pattern of one character; 0 for an empty text."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)), F.length(text)), F.lit(0.0))


def hash32(text: Column) -> Column:
    """The first 32 bits of the MD5 sum, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def replaced_where(text: Column, pattern: str, keep, put: str) -> Column:
    """`text` with the matches of `pattern` for which keep(match) is false replaced by `put`."""
    between = F.split(text, pattern, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern), 0), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.when((b == "") | keep(b), b).otherwise(F.lit(put)))), "")


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences and lines of more than `least` characters."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n"), r"\n+")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda s: F.length(s) > least)
