"""Web pages and search hits: metadata, links, domains, and picking hits in turn from ordered buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hosts that are no company sites (fixed values).
EXCLUDED = r"(facebook|twitter|linkedin|instagram|youtube|wikipedia|social|finder|directory|yellow|pages|gov)[a-z-]*\."
KEY_PAGES = (("about", r"(about|company|who-we-are|ueber|nosotros)"), ("services", r"(service|solution|what-we-do|leistung)"), ("products", r"(product|shop|catalog|portfolio)"))


def title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, r"(?is)<title[^<>]*>(.*?)</title>", 1))


def page_lang(page: Column) -> Column:
    return F.lower(F.regexp_extract(page, r"(?i)<html[^<>]* lang=[\"']?([A-Za-z-]+)", 1))


def description(page: Column) -> Column:
    """The content of the description tag; empty without one."""
    tag = F.regexp_extract(page, r"(?is)<meta[^<>]*name=[\"']description[\"'][^<>]*>", 0)
    return F.regexp_extract(tag, r"(?is)content=[\"']([^\"'<>]*)[\"']", 1)


#: Ends and parts of links that lead to no page of text (fixed values).
SKIPPED = r"\.(pdf|jpg|jpeg|png|gif|svg|zip|mp4|docx?|xlsx?)$|login|signin|account|cart|checkout|privacy|cookie|terms|impressum|imprint|mailto:|tel:|javascript:"


def resolved(link: Column, base: Column) -> Column:
    """A link seen on the page `base` as a full address without fragment."""
    scheme, origin = F.regexp_extract(base, r"^([a-zA-Z]+:)//", 1), F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+(?:/[^?#/]*)*?/)[^/?#]*(?:[?#].*)?$", 1)
    plain = F.regexp_replace(link, r"#.*$", "")
    return (
        F.when(plain.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), plain)
        .when(plain.startswith("//"), F.concat(scheme, plain))
        .when(plain.startswith("/"), F.concat(origin, plain))
        .when(plain == "", base)
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), plain))
    )


def site_links(page: Column, base: Column) -> Column:
    """Distinct addresses of pages on the same host that a page links to, in order."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]+)", 1))
    found = F.regexp_extract_all(page, F.lit(r"(?i)<a [^<>]*href=[\"']([^\"'<>]*)"), 1)
    full = F.transform(found, lambda x: resolved(x, base))
    return F.array_distinct(F.filter(full, lambda u: (host(u) == host(base)) & ~F.lower(u).rlike(SKIPPED)))


def crawled(pages: DataFrame, homes: DataFrame, url: str = "url", html: str = "html", least: int = 40) -> DataFrame:
    """(home, url, text): the main text of each home page and of its key pages, from a table of fetched pages.

    A home page that was not fetched gives nothing; key pages of at most `least` characters are left out.
    """
    from . import curate

    there = pages.select(F.col(url).alias("__u"), F.col(html).alias("__h"))
    home = homes.select(F.col(url).alias("home")).distinct().join(there, F.col("home") == F.col("__u"))
    keys = key_pages(site_links(F.col("__h"), F.col("home")))
    wanted = home.select("home", F.explode(F.array_distinct(F.array_compact(F.array(F.col("home"), *[keys[k] for k, _ in KEY_PAGES])))).alias("__w"))
    found = wanted.join(there, F.col("__w") == F.col("__u")).select("home", F.col("__w").alias("url"), curate.main_text_of("__h").alias("text"))
    return found.where((F.col("url") == F.col("home")) | (F.length("text") > least))


def links(page: Column) -> Column:
    """Distinct link targets in order, without fragments, scripts and mail addresses."""
    found = F.regexp_extract_all(page, F.lit(r"(?i)<a [^<>]*href=[\"']([^\"'#<>]+)"), 1)
    return F.array_distinct(F.filter(found, lambda x: ~F.lower(x).rlike(r"^(javascript|mailto|tel):|\.(pdf|jpg|png|zip)$")))


def key_pages(urls: Column) -> Column:
    """The first link of each kind."""
    first = lambda p: F.get(F.filter(urls, lambda u: F.lower(u).rlike(p)), F.lit(0))
    return F.struct(*[first(p).alias(kind) for kind, p in KEY_PAGES])


def unwrapped(url: Column) -> Column:
    """The target of a tracking link that carries it as parameter u or uddg; other links as they are."""
    inner = F.regexp_extract(url, r"[?&](?:u|uddg)=([^&#]+)", 1)
    plain = inner
    for code, char in (("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%3D", "="), ("%26", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return F.when(inner != "", plain).otherwise(url)


def domain(url: Column) -> Column:
    """Host in lower case without www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def round_robin(hits: DataFrame, buckets: list[str], order: list[str], site: str, limit: int, seen: DataFrame | None = None) -> DataFrame:
    """Hits in turn from each bucket: first of all buckets, second of all buckets, and so on, each site once.

    A site's place is that of its best hit; sites in `seen` are left out. Only the best hit of each site is ranked over all.
    """
    ranked = hits.withColumn("__rank", F.row_number().over(W.partitionBy(*buckets).orderBy(*order)))
    place = F.struct("__rank", *buckets, *order)
    best = ranked.where(F.col(site).isNotNull()).groupBy(site).agg(F.min(place).alias("__p"))
    if seen is not None:
        best = best.join(seen.select(site).distinct(), site, "left_anti")
    return best.orderBy("__p", site).limit(limit).select(site, F.col("__p.__rank").cast("long").alias("rank"), *[F.col(f"__p.{b}").alias(b) for b in buckets])
