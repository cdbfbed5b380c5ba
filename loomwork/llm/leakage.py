"""Evaluation texts leaking into training text (problem 5).

Method. A prefix-filtered set join. Each item, without an instruction that it shares with others, gives its windows of
`run` words (an item that is shorter is one window). A document leaks an item if it contains a whole window in a row, so
it must contain each of the window's shingles, and for full containment the necessary prefix of a window, its shingles
in order of rarity, is the single rarest one. Rarity is counted over the whole corpus. Documents are joined to windows on
that shingle only; bounds on the document's length and on the shingle's place drop pairs that have no room for the
window; what is left is verified exactly, word by word, over the window-sized stretch around the shingle.

Words are runs of letters and digits after tags and entities are removed, in compatibility form and without case, so
case, punctuation, spacing, markup and line breaks do not matter.

A first sentence that SHARED items begin with is an instruction and is left out. Items of fewer than `size` words are
shingles by themselves.

Scale. One pass over the documents gives their shingles that some item has, each with its surroundings; the corpus is
not shuffled, only those rows are. The filter is a set of hashes of the items' shingles. It is sent to the workers only
up to `broadcast_shingles`; beyond that the hashes of the documents' shingles are joined to those of the items, and only
documents with a hit are read again, with their own few hashes. Both ways give the same rows.

Defined cases: null, empty and blank texts leak nothing; an item without words is never found; repeated items each have
their rows; repeated documents each have their rows if their ids differ; an empty table on either side gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = 13
SHINGLE = 5
#: Hashes of item shingles that are sent to the workers at most, 8 bytes each.
BROADCAST_SHINGLES = 2_000_000
#: A first sentence that as many items share is an instruction.
SHARED = 10

_TAG = re.compile(r"<[^<>]{0,300}>")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"^\s*(.+?[.!?:])\s+(?=\S)", re.S)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "")
    return _WORD.findall(text.lower())


def _hash(grams: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(grams)) - (1 << 63)


def item_windows(items: DataFrame, key: str, text: str, run: int = RUN, size: int = SHINGLE, shared: int = SHARED) -> DataFrame:
    """(item, window, offset, shingle, body): each shingle of each window; `body` is the window's words with single spaces."""

    @F.pandas_udf("struct<lead:string,lead_words:int>")
    def lead(texts: pd.Series) -> pd.DataFrame:
        found = [_SENTENCE.match(t) if t else None for t in texts]
        tokens = [words(m.group(1)) if m else [] for m in found]
        return pd.DataFrame({"lead": [" ".join(w) or None for w in tokens], "lead_words": [len(w) for w in tokens]})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, body, skip in zip(batch["item"], batch["text"], batch["skip"]):
                tokens = words(body)[int(skip) :]
                length = min(run, len(tokens))
                for at in range(len(tokens) - length + 1) if length else ():
                    window = tokens[at : at + length]
                    k = min(size, length)
                    rows += [(item, at, o, _hash(window[o : o + k]), " ".join(window), window[o], window[o + k - 1]) for o in range(length - k + 1)]
            yield pd.DataFrame(rows, columns=["item", "window", "offset", "shingle", "body", "first", "last"])

    named = items.select(F.col(key).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("lead", lead("text"))
    many = named.select("item", "lead.lead").distinct().groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= shared) & F.col("lead").isNotNull())
    cut = named.select("item", "text", "lead.lead", "lead.lead_words").join(many, "lead", "left").select("item", "text", F.when(F.col("n").isNotNull(), F.col("lead_words")).otherwise(0).alias("skip"))
    kind = items.schema[key].dataType.simpleString()
    return cut.mapInPandas(windows, f"item {kind}, window int, offset int, shingle long, body string, first string, last string")


def _grams(tokens: list[str], size: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of each shingle."""
    return ((at, _hash(tokens[at : at + size])) for at in range(len(tokens) - size + 1))


def _near(tokens: list[str], at: int, size: int, run: int) -> tuple[str, int]:
    """The words around a shingle, up to run - 1 on each side, and its place among them."""
    lo = max(0, at - run + 1)
    return " ".join(tokens[lo : at + size + run - 1]), at - lo


def doc_shingles(docs: DataFrame, key: str, text: str, known, sizes: list[int], run: int = RUN) -> DataFrame:
    """(doc, at, n, shingle, near, near_at): the shingles of each document that are in `known`, with the words around.

    `known` is a broadcast of (hashes, first words, last words), or None if each row of `docs` has its own `hashes`.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if known is not None:
            hashes, firsts, lasts = known.value
        for batch in batches:
            rows = []
            own = batch["hashes"] if known is None else [None] * len(batch)
            for doc, body, mine in zip(batch["doc"], batch["text"], own):
                tokens = words(body)
                n = len(tokens)
                if known is None:
                    mine = set(mine)
                    rows += [(doc, at, n, h, *_near(tokens, at, size, run)) for size in sizes for at, h in _grams(tokens, size) if h in mine]
                    continue
                for size in sizes:
                    for at in range(n - size + 1):
                        if tokens[at] in firsts and tokens[at + size - 1] in lasts and (h := _hash(tokens[at : at + size])) in hashes:
                            rows.append((doc, at, n, h, *_near(tokens, at, size, run)))
            yield pd.DataFrame(rows, columns=["doc", "at", "n", "shingle", "near", "near_at"])

    kind = docs.schema[key].dataType.simpleString()
    own = ["hashes"] if known is None else []
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), *own).where(F.length("text") > 0).mapInPandas(scan, f"doc {kind}, at int, n int, shingle long, near string, near_at int")


def doc_hashes(docs: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """(doc, shingle): the distinct hashes of each document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, h) for doc, body in zip(batch["doc"], batch["text"]) for tokens in [words(body)] for h in {h for size in sizes for _, h in _grams(tokens, size)}]
            yield pd.DataFrame(rows, columns=["doc", "shingle"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.length("text") > 0).mapInPandas(scan, f"doc {kind}, shingle long")


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "id", item_key: str = "item_id", text: str = "text", run: int = RUN, size: int = SHINGLE, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """Distinct (doc_key, item_key) of the documents that hold a window of an item."""
    spark = docs.sparkSession
    # read for its hashes, for the rarity and for the join; it is as large as the items
    windows = _kept(item_windows(items, item_key, text, run, size))
    length = F.size(F.split("body", " "))
    distinct = windows.select("shingle", "first", "last", F.least(F.lit(size), length).alias("size")).distinct()
    sizes = sorted(r.size for r in distinct.select("size").distinct().collect()) or [size]
    few = distinct.select("shingle", "first", "last").limit(broadcast_shingles + 1).toArrow()
    if few.num_rows <= broadcast_shingles:
        known = spark.sparkContext.broadcast(tuple(set(few.column(i).to_pylist()) for i in range(3)))
        found = doc_shingles(docs, doc_key, text, known, sizes, run)
    else:
        hits = doc_hashes(docs, doc_key, text, sizes).join(distinct.select("shingle").distinct(), "shingle", "left_semi")
        own = hits.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("shingle").alias("hashes"))
        found = doc_shingles(docs.select(F.col(doc_key), F.col(text)).join(own, F.col(doc_key).eqNullSafe(F.col("__doc"))), doc_key, text, None, sizes, run)
    # used for the rarity and for the join; it holds only rows that match an item
    found = _kept(found)
    rarity = found.groupBy("shingle").agg(F.countDistinct("doc").alias("docs"))
    ranked = windows.join(rarity, "shingle", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    # the window of an item is a group of at most run - size + 1 rows
    prefix = ranked.withColumn("r", F.row_number().over(W.partitionBy("item", "window").orderBy("docs", "offset"))).where((F.col("r") == 1) & (F.col("docs") > 0))
    room = (F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + length <= F.col("n"))
    pairs = found.join(prefix.select("item", "offset", "shingle", "body"), "shingle").where(room)
    stretch = F.array_join(F.slice(F.split("near", " "), F.col("near_at") - F.col("offset") + 1, length), " ")
    return pairs.where(stretch == F.col("body")).select(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).distinct()


def _kept(df: DataFrame) -> DataFrame:
    from ..session import checkpointed

    return checkpointed(df)
