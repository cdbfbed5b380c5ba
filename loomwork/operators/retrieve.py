"""Retrieval over passages: BM25 by an inverted index as a table, overlaps, hashed embeddings, cosine, chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpointed

#: Words left out of content tokens (fixed values).
COMMON = "a an and are as at be by for from in is it its of on or that the this to was were with".split()
K1, B = 1.2, 0.75
#: Words of sentences about something missing (fixed values).
GAP = r"\b(few|still|limited|bottleneck|barrier|remains|lack|manual|spreadsheets|whiteboards)\b"


def content(text: Column) -> Column:
    return F.filter(T.words(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(*COMMON))


#: A query's terms whose passages give the first bound.
FIRST_TERMS = 2


def bm25(passages: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, text: str = "text", query_text: str = "query") -> DataFrame:
    """(query_key, key, score, rank): the k best passages of each query; ties go to the smaller key.

    A query's terms count as often as they stand in it. No passage gets more from a term than an upper bound that follows
    from how rare the term is. The passages of a query's strongest terms give a score that the k-th best reaches at least;
    terms whose bounds together stay under it cannot bring a passage in by themselves, so only passages with one of the
    other terms meet the query, and the weak terms, which are the common ones, are added to these only. Scores are exact.
    """
    words = content(F.col(text))
    terms = queries.select(query_key, F.explode(content(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf"))
    sizes = passages.select(F.size(words).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    # the length is taken before the words are spread: behind that it would be computed for each of them
    spread = passages.select(key, words.alias("w")).select(key, "w", F.size("w").alias("len")).select(key, "len", F.explode("w").alias("term"))
    index = spread.join(terms.select("term").distinct(), "term", "left_semi").groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    index = checkpointed(index)
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row of corpus statistics
    idf = df.crossJoin(F.broadcast(sizes)).select("term", "mean", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    weighted = index.join(idf, "term").select("term", key, weight.alias("weight"))
    bound = terms.join(idf.select("term", "idf"), "term").withColumn("most", F.col("qtf") * F.col("idf") * (K1 + 1))
    by_query = W.partitionBy(query_key)
    bound = bound.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("most"), "term")))

    def summed(some: DataFrame, name: str) -> DataFrame:
        return weighted.join(some.select(query_key, "term", "qtf"), "term").groupBy(query_key, key).agg(F.sum(F.col("weight") * F.col("qtf")).alias(name))

    first = summed(bound.where(F.col("place") <= FIRST_TERMS), "score")
    reached = first.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("score")))).where(F.col("r") == k).select(query_key, F.col("score").alias("reached"))
    weak = F.sum("most").over(by_query.orderBy("most", F.desc("term")).rowsBetween(W.unboundedPreceding, 0))
    # scores are compared in thousandths
    told = bound.join(reached, query_key, "left").withColumn("weak", weak < F.coalesce("reached", F.lit(0.0)) - 0.002)
    told = checkpointed(told)
    pairs = summed(told.where(~F.col("weak")), "strong")
    rest = told.where("weak").groupBy(query_key).agg(F.sum("most").alias("rest"), F.first("reached").alias("reached"))
    # read for the weak terms and for the sum
    pairs = checkpointed(pairs.join(rest, query_key, "left").where(F.col("reached").isNull() | (F.col("strong") + F.col("rest") >= F.col("reached") - 0.002)).select(query_key, key, "strong"))
    added = pairs.select(query_key, key).join(told.where("weak").select(query_key, "term", "qtf"), query_key).join(weighted, [key, "term"]).groupBy(query_key, key).agg(F.sum(F.col("weight") * F.col("qtf")).alias("added"))
    scored = pairs.join(added, [query_key, key], "left").select(query_key, key, F.round(F.col("strong") + F.coalesce("added", F.lit(0.0)), 3).alias("score")).where("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k)


def is_current(sentence: Column) -> Column:
    """Whether a sentence states something of today: no fragment, no words of history, at most one past form, and not
    mostly names."""
    past = r"(^|[^a-z])(history|historical|founded|formerly|originally|century|ancient|decades ago)([^a-z]|$)"
    forms = F.regexp_count(F.lower(sentence), F.lit(r"[a-z]{3,}ed([^a-z]|$)"))
    names = 2 * F.regexp_count(sentence, F.lit("(^| )[A-Z]")) < F.regexp_count(sentence, F.lit("[^ ]+"))
    return F.length(sentence).between(40, 320) & ~F.lower(sentence).rlike(past) & (forms <= 1) & names


def token_jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def embedding(docs: DataFrame, key: str, text: str = "text", dim: int = 512) -> DataFrame:
    """(key, bucket, x): a hashed, signed bag of words and word pairs with weights 1 + ln n and length 1, sparse."""
    w = content(F.col(text))
    grams = F.concat(w, T.ngrams(w, 2))
    counted = docs.select(key, F.explode(grams).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))
    h = T.hash32(F.col("g"))
    signed = F.when(h >= 1 << 31, -1.0).otherwise(1.0) * (1 + F.ln(F.col("n")))
    summed = counted.groupBy(key, F.pmod(h, F.lit(dim)).alias("bucket")).agg(F.sum(signed).alias("x"))
    length = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return summed.join(length, key).where("len > 0").select(key, "bucket", (F.col("x") / F.col("len")).alias("x"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def passages(text: Column, size: int = 600) -> Column:
    """Blank-line and sentence pieces packed, in order, into passages of at most `size` characters (longer pieces stay whole)."""
    pieces = F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?]) +([A-Z])", "$1\n\n$2"), r"\n[ \t]*\n"), lambda x: F.trim(x)), lambda p: p != "")
    start = F.array().cast("array<string>")

    def pack(out: Column, piece: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (F.size(out) > 0) & (F.length(F.when(F.size(out) > 0, last)) + 1 + F.length(piece) <= size)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.lit(" "), piece)))
        return F.when(fits, joined).otherwise(F.concat(out, F.array(piece)))

    return F.aggregate(pieces, start, pack)


def in_context(text: Column, pattern: str, window: int = 150, most: int = 20) -> Column:
    """Matches with up to `window` characters of the same line on either side."""
    return F.slice(F.regexp_extract_all(text, F.lit(f".{{0,{window}}}(?:{pattern}).{{0,{window}}}"), 0), 1, most)
