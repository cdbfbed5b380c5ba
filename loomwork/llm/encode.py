"""Encoding of a corpus with a public byte-level BPE tokenizer by Spark higher-order functions (problem 8).

Method. A text is cut into pieces by the tokenizer's published pattern. Every piece is an array of byte strings (one
ISO-8859-1 character for each byte), and a fold merges the adjacent pair of lowest rank, at all its places from left to
right, until no pair has a rank. Ranks and ids come from one literal map, an array of small hash buckets, so a lookup
does not depend on the vocabulary's size. Distinct pieces are folded once: pieces that the vocabulary holds whole are in
the piece dictionary from the start, and the most frequent other pieces of the corpus are counted, folded and added to
it, up to DICTIONARY_ROWS entries. A piece outside the dictionary is folded where it stands, so the bound changes the
time, never the result. The fold's time grows with the square of a piece's length, so the rare texts that may hold a
piece of LONG_PIECE characters or more (a blob without spaces) have their pieces merged by a heap over positions, in
Arrow batches, with the same ids. No text is shuffled.

Defined cases: a null, empty text gives an empty list of ids; a blank text is encoded like any other; strings that look
like special tokens are ordinary text; repeated rows each give their row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("LOOMWORK_TOKENIZERS", "/opt/tokenizers")
#: Buckets of the literal maps, a power of two.
BUCKETS = 1 << 15
#: Most entries of the piece dictionary that come from the corpus; about 100 bytes each.
DICTIONARY_ROWS = 150_000
LONG_PIECE = 500
#: The pattern is the tokenizer's own; (?U) gives \s its Unicode meaning, as in the tokenizer.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN, CLOSE = "Ā", "ā"  # outside of the byte characters


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a byte-level BPE vocabulary: a line for each token, base64 and rank, which is also its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _bucket(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(BUCKETS))


def _bucketed(entries: DataFrame, value: str) -> DataFrame:
    """One row with column `value`: an array of BUCKETS maps, each from the keys of its bucket to `value`."""
    spark = entries.sparkSession
    maps = entries.groupBy(_bucket(F.col("key")).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("key", value))).alias("m"))
    filled = spark.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("b")).join(maps, "b", "left")
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m")), lambda x, y: x["b"] - y["b"]), lambda x: x["m"]).alias(value))


def _find(buckets: Column, key: Column) -> Column:
    return F.try_element_at(F.get(buckets, _bucket(key)), key)


def _merged(parts: Column, ranks: Column) -> Column:
    """One step of the fold: `parts` with its best pair merged everywhere, or as it is if no pair has a rank."""
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: F.struct(_find(ranks, F.concat(a, b)).alias("r"), a.alias("a"), b.alias("b")))
    best = F.array_min(F.filter(pairs, lambda x: x["r"].isNotNull()))

    def replaced(x: Column) -> Column:
        joined = F.concat(F.lit(OPEN), F.array_join(parts, CLOSE + OPEN), F.lit(CLOSE))
        both = F.replace(joined, F.concat(F.lit(OPEN), x["a"], F.lit(CLOSE + OPEN), x["b"], F.lit(CLOSE)), F.concat(F.lit(OPEN), x["a"], x["b"], F.lit(CLOSE)))
        return F.split(F.substring(both, 2, 2_000_000_000), CLOSE + OPEN + "?")

    return F.when(best.isNull(), parts).otherwise(F.filter(F.get(F.transform(F.array(best), replaced), F.lit(0)), lambda t: t != ""))


def fold(piece: Column, ranks: Column) -> Column:
    """The token ids of a piece. The state's second field says that nothing is left to merge."""
    raw = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")
    # (?s) split into single characters: every byte is one
    parts = F.regexp_extract_all(raw, F.lit("(?s)."), 0)
    start = F.struct(parts.alias("p"), (F.size(parts) < 2).alias("done"))

    def step(state: Column, _: Column) -> Column:
        after = F.transform(F.array(_merged(state["p"], ranks)), lambda p: F.struct(p.alias("p"), (F.size(p) == F.size(state["p"])).alias("done")))
        return F.when(state["done"], state).otherwise(F.get(after, F.lit(0)))

    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(raw) - 1)), start, step)
    return F.transform(last["p"], lambda t: _find(ranks, t))


def _let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with(df: DataFrame, columns: dict[str, Column], **tables: DataFrame) -> DataFrame:
    """`df` with `columns`, which may use each of the one-row `tables` once, by name.

    The analyzer takes no scalar subquery inside a higher-order function, but the optimizer merges the two projections
    made here, so that the subquery's value is a constant of the executors' plan and is never copied into rows.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select("*", *[t.scalar().alias(name) for name, t in tables.items()]).select(*kept, *[v.alias(k) for k, v in columns.items()])


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the pair of lowest rank first, from left to right. Parts are a linked list, pairs a heap."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place
    alive = [True] * n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        if j >= n:
            return None
        rank = ranks.get(piece[i : end[j]])
        return None if rank is None else (rank, i, end[j])

    heap = [x for i in range(n) if (x := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        # a pair is stale if one of its parts was merged
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        for k in (i, before[i]):
            if k >= 0 and (x := pair(k)):
                heapq.heappush(heap, x)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def heaped(spark: SparkSession, ranks: dict[bytes, int]):
    """A pandas UDF: the ids of texts, by `merged`; null for null."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pattern = regex.compile(PATTERN.removeprefix("(?U)"))
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [i for p in pattern.findall(t) for i in merged(p.encode(), shared.value)])

    return ids


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """(key, id): each token as a string of byte characters. Read from one JSON literal, on the executors."""
    literal = json.dumps([{"key": token.decode("latin-1"), "id": rank} for token, rank in ranks.items()])
    rows = spark.createDataFrame([(literal,)], "j string").select(F.explode(F.from_json("j", "array<struct<key:string,id:int>>")).alias("e"))
    return rows.select("e.key", "e.id")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), 0)


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", out: str = "ids", dictionary_rows: int = DICTIONARY_ROWS, long_piece: int = LONG_PIECE) -> DataFrame:
    """`docs` with a column `out` of token ids. Other columns pass through."""
    spark = docs.sparkSession
    # more than a piece that long needs: any run without a change between white space and others
    long = F.coalesce((F.length(text) >= long_piece) & F.col(text).rlike(rf"(?U)\S{{{long_piece}}}|\s{{{long_piece}}}"), F.lit(False))
    kept = [c for c in docs.columns if c != out]
    blobs = docs.where(long).select(*kept, heaped(spark, ranks)(F.col(text)).alias(out))
    docs = docs.where(~long)
    table = rank_table(spark, ranks)
    by_rank = _bucketed(table, "id")
    # tokens that are whole pieces of valid UTF-8 need no fold: a piece in the vocabulary is its own token
    readable = {}
    for token, rank in ranks.items():
        try:
            readable[token.decode("utf-8")] = rank
        except UnicodeDecodeError:
            pass
    literal = json.dumps([{"key": k, "ids": [v]} for k, v in readable.items()])
    whole = spark.createDataFrame([(literal,)], "j string").select(F.explode(F.from_json("j", "array<struct<key:string,ids:array<int>>>")).alias("e")).select("e.key", "e.ids")
    known = _bucketed(whole, "ids")
    source = docs.select(F.col(text).alias("t")).where(F.col("t") != "")
    missing = _let(F.col("_known"), lambda k: F.array_distinct(F.filter(pieces(F.col("t")), lambda p: _find(k, p).isNull())))
    unknown = _with(source, {"keys": missing}, _known=known).select(F.explode("keys").alias("key"))
    frequent = unknown.groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(dictionary_rows)
    spread = frequent.select("key").repartition(spark.sparkContext.defaultParallelism, "key")
    folded = _with(spread, {"ids": _let(F.col("_ranks"), lambda r: fold(F.col("key"), r))}, _ranks=by_rank)
    dictionary = _bucketed(whole.unionByName(folded), "ids")
    ids = _let(F.col("_pieces"), lambda d: _let(F.col("_ranks"), lambda r: F.flatten(F.transform(pieces(F.col(text)), lambda p: F.coalesce(_find(d, p), fold(p, r))))))
    value = F.when(F.col(text).isNull() | (F.col(text) == ""), F.array().cast("array<int>")).otherwise(ids)
    return _with(docs, {out: value}, _pieces=dictionary, _ranks=by_rank).unionByName(blobs)


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "text") -> DataFrame:
    """`docs` with a string column `out`: the tokens' bytes, put together and read as UTF-8. Null ids give null."""
    spark = docs.sparkSession
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    literal = spark.createDataFrame([(json.dumps([t.decode("latin-1") for t in tokens]),)], "j string").select(F.from_json("j", "array<string>").alias("a"))
    latin = _let(F.col("_tokens"), lambda a: F.array_join(F.transform(F.col(ids), lambda i: F.get(a, i)), ""))
    return _with(docs, {out: F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8")}, _tokens=literal)
