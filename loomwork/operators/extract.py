"""Rule-based fields of companies from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: Keywords by field, in the order in which ties are decided (fixed values); keywords of several words count twice.
FIELDS = {
    "energy": ("solar", "energy", "battery", "wind", "grid operators"),
    "logistics": ("freight", "logistics", "delivery", "truck", "loading ramp"),
    "software": ("software", "platform", "portal", "cloud", "data model"),
    "agriculture": ("crop", "harvest", "irrigation", "farmers", "seed bank"),
    "healthcare": ("clinic", "patient", "hospital", "nurses", "home care"),
    "finance": ("credit", "claim", "bank", "insurance", "credit scoring"),
    "education": ("training", "school", "course", "learning", "school heads"),
    "construction": ("bridge", "construction", "steel", "building", "steel frame"),
    "water": ("water", "pumping", "leakage", "tidal", "waste water"),
}
COUNTRIES = {"Germany": ("German",), "France": ("French",), "Spain": ("Spanish",), "Italy": ("Italian",), "Portugal": ("Portuguese",), "Netherlands": ("Dutch",), "Ireland": ("Irish",), "Norway": ("Norwegian",), "Canada": ("Canadian",), "Austria": ("Austrian",)}
LEGAL = r"(?:GmbH|AG|Ltd|Inc|AB|Oy|Lda)"


def _hits(text: Column, word: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)"), 0))


def _best(scores: list[tuple[str, Column]], other: str | None) -> Column:
    """The name with the highest score; ties go to the first, none to `other`. Scores are computed once."""
    best = F.array_max(F.array(*[F.struct(s.cast("int").alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores)]))
    return T.let(best, lambda b: F.when(b["s"] > 0, b["name"]).otherwise(F.lit(other)))


def field(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return T.let(low, lambda t: _best([(name, sum((_hits(t, w) * (2 if " " in w else 1) for w in words), F.lit(0))) for name, words in FIELDS.items()], "unknown"))


def country(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    count = lambda w: F.size(F.regexp_extract_all(t, F.lit(w), 0))
    # inside of a lambda the expressions are interpreted, so their number does not grow the generated code
    return T.let(F.lit(1), lambda _: _best([(name, sum((count(a) for a in alias), count(name))) for name, alias in COUNTRIES.items()], None))


def company_name(text: Column) -> Column:
    """The commonest run of up to three capitalized words before a legal form; ties go to the first by name."""
    found = F.array_sort(F.regexp_extract_all(text, F.lit(rf"(?:[A-Z][a-z]+ ){{1,3}}{LEGAL}"), 0))
    return T.let(found, lambda a: F.get(F.transform(F.array_sort(F.transform(F.array_distinct(a), lambda x: F.struct((-F.size(F.filter(a, lambda y: y == x))).alias("n"), x.alias("x")))), lambda s: s["x"]), F.lit(0)))


def services(text: Column, most: int = 8) -> Column:
    """Distinct items after an offering phrase, in order."""
    lists = F.regexp_extract_all(text, F.lit(r"(?:offers|provides|builds and maintains|services include) ([^.\n]{3,200})"), 1)
    items = F.flatten(F.transform(lists, lambda x: F.split(F.lower(x), r"[;,]| and ")))
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.length(x).between(3, 80))), 1, most)


def size(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"([0-9][0-9,.]*) (?:employees|staff|people|team members)", 1), F.lit(""))
