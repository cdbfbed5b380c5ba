"""Token budget by source, language and domain under a public tokenizer (problem 6).

Method. A text longer than CHUNK characters is cut only where the tokenizer provably starts a new piece whatever stands
before it. Its pattern has no look-behind. No alternative goes on from a character that is no white space to white
space, so a piece ends in front of white space that follows another character. If that is a space, what follows is cut
there as the whole text would be; if it is a line end or tab in front of another character, the white space is a piece
of its own in either case. So the counts of the chunks add up to the count of the whole text. Chunks are salted over all
cores, counted exactly and summed for each document; short texts stay in their row and are never shuffled. Totals come
from grouping sets with map-side aggregation.

Defined cases: null and empty texts have 0 tokens; a null source, language or domain is its own slice and is shown as
null, with `slice` telling it from a total; repeated rows are counted each time; an empty table gives no
slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import TOKENIZER_DIR, read_ranks

#: Characters above which a text is cut.
CHUNK = 200_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tiktoken encoder of a rank file, made once in each worker."""
    if path not in _ENCODERS:
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODERS[path]


#: A space behind a character that is no white space, or another white space character alone between two of them.
_BOUNDARY = re.compile(r"(?<=\S)(?: |[^\S ](?=\S))")


def cut(text: str, size: int) -> list[str]:
    """`text` in chunks of about `size` characters, cut at independent boundaries only."""
    chunks, start = [], 0
    while len(text) - start > size:
        found = _BOUNDARY.search(text, start + size)
        if found is None:
            break
        chunks.append(text[start : found.start()])
        start = found.start()
    chunks.append(text[start:])
    return chunks


def token_counter(path: str):
    """A pandas UDF: the number of tokens of each text; 0 for null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def chunker(size: int):
    """A pandas UDF: the chunks of a long text; null for others."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t, size) if t is not None and len(t) > size else None)

    return chunks


def count_tokens(docs: DataFrame, key: str, text: str = "text", path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", out: str = "tokens", chunk: int = CHUNK) -> DataFrame:
    """`docs` without its text, with a column `out` of exact token counts. Rows with the same key and other values stay apart."""
    count = token_counter(path)
    rest = [c for c in docs.columns if c not in (text, out)]
    t = F.col(text)
    long = F.coalesce(F.length(t) > chunk, F.lit(False))
    spark = docs.sparkSession
    salts = max(1, spark.sparkContext.defaultParallelism) * 4
    # short texts are counted in place; the texts of the few long ones are spread in chunks
    short = docs.where(~long).select(*rest, count(t).alias(out))
    pieces = docs.where(long).withColumn("__row", F.monotonically_increasing_id()).select(*rest, "__row", F.posexplode(chunker(chunk)(t)).alias("__n", "__chunk"))
    salted = pieces.repartition(salts, F.col("__row"), F.col("__n")).withColumn("__t", count(F.col("__chunk")))
    whole = salted.groupBy("__row").agg(*[F.first(c).alias(c) for c in rest], F.sum("__t").alias(out)).select(*rest, out)
    return short.unionByName(whole)


def totals(counts: DataFrame, by: dict[str, Column], tokens: str = "tokens") -> DataFrame:
    """Documents and tokens for every subset of the columns `by`; `slice` names the subset, "all" the grand total."""
    names = list(by)
    named = counts.select(*[c.alias(n) for n, c in by.items()], F.col(tokens).alias("__tokens"))
    # rows of a slice are summed before they are multiplied by the grouping sets
    finest = named.groupBy(*names).agg(F.count(F.lit(1)).alias("__docs"), F.coalesce(F.sum("__tokens"), F.lit(0)).alias("__tokens"))
    sets = [list(s) for k in range(len(names), -1, -1) for s in combinations(names, k)]
    sliced = finest.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.sum("__docs").alias("docs"), F.sum("__tokens").alias("tokens"), F.grouping_id().alias("__g"))
    label = F.lit(None).cast("string")
    for s in sets:
        bits = sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in s)
        label = F.when(F.col("__g") == bits, " x ".join(s) or "all").otherwise(label)
    return sliced.select(*names, label.alias("slice"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
