"""A uniform sample of fixed size from data of unknown length that arrives in pieces (problem 4).

Method. Every partition keeps a reservoir of k rows and counts its rows; between two accepted rows it skips ahead by a
geometric jump (Li's algorithm L), so the number of random draws grows with k log(n/k), not with n, and skipped rows are
never taken out of their Arrow batch. Reservoirs are merged by hypergeometric draws: how many of the k rows each of two
reservoirs gives follows the sizes of the populations that they stand for, and those rows are drawn from it without
replacement. The merged reservoir is again uniform over both populations, so pieces can be added later (`merge`), and
every record is equally likely whatever its piece.

The draws use counts only: one number for each partition goes to the driver, no rows; they are counted without reading
the other columns. The draw is exact at any size: k different places among all rows are drawn and counted by population,
which is the hypergeometric draw for many populations at once. Seeds depend on `seed` and the partition's number, so a
task that runs again makes the same choices; `records` must give the same partitions when it is read again, as scans
and checkpoints do, and a partition that does not have its counted rows fails the query.

Defined cases: fewer than k rows give all rows; k = 0 gives none; null texts are records like others; repeated rows are
separate records; an empty table gives an empty sample.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Skips:
    """The positions that enter a reservoir of k slots, and the slot of each (algorithm L)."""

    def __init__(self, k: int, rng: np.random.Generator):
        self.k, self.rng = k, rng
        self.w = math.exp(math.log(1.0 - rng.random()) / k)
        self.next = k - 1
        self._jump()

    def _jump(self) -> None:
        self.next += math.floor(math.log(1.0 - self.rng.random()) / math.log1p(-self.w)) + 1 if self.w < 1 else 1

    def accepted(self, start: int, stop: int) -> Iterator[tuple[int, int]]:
        """(position, slot) of the rows from start up to stop that enter."""
        for i in range(start, min(stop, self.k)):
            yield i, i
        while self.next < stop:
            yield self.next, int(self.rng.integers(self.k))
            self.w *= math.exp(math.log(1.0 - self.rng.random()) / self.k)
            self._jump()


def split_draws(counts: list[int], k: int, seed: int) -> list[int]:
    """How many of k rows come from each population, by draws without replacement from all of them."""
    ends = list(accumulate(counts))
    out = [0] * len(counts)
    if ends:
        for place in random.Random(seed).sample(range(ends[-1]), min(k, ends[-1])):
            out[bisect_right(ends, place)] += 1
    return out


def reservoirs(records: DataFrame, k: int, seed: int, plan: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """Up to k rows of each partition in random order (`__rank` from 0), with `__part` and the rows seen in `__seen`.

    With a `plan` of (rows, rows to give) by partition only the first of them are given, and the rows are counted again.
    """
    schema = T.StructType([*records.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__rank", T.LongType()), T.StructField("__seen", T.LongType())])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        counted, give = (None, k) if plan is None else plan.get(part, (0, 0))
        rng = np.random.default_rng([seed, part])
        skips, slots, seen, kept = Skips(k, rng), {}, 0, None
        for batch in batches:
            taken = {slot: at - seen for at, slot in skips.accepted(seen, seen + batch.num_rows)}
            seen += batch.num_rows
            if not taken:
                continue
            rows = pa.Table.from_batches([batch.take(pa.array(list(taken.values())))])
            old = [s for s in slots if s not in taken]
            kept = rows if kept is None else pa.concat_tables([kept.take(pa.array([slots[s] for s in old], pa.int64())), rows]).combine_chunks()
            slots = {s: i for i, s in enumerate([*old, *taken])}
        if counted is not None and seen != counted:
            raise RuntimeError(f"partition {part} has {seen} rows, {counted} were counted: checkpoint the records first")
        if kept is None or not give:
            return
        n = min(kept.num_rows, give)
        # the order of slots is by the draws alone, however rows came in batches
        places = [slots[s] for s in sorted(slots)]
        out = kept.take(pa.array([places[i] for i in rng.permutation(len(places))[:n]], pa.int64()))
        for name, value in (("__part", pa.array([part] * n, pa.int32())), ("__rank", pa.array(range(n), pa.int64())), ("__seen", pa.array([seen] * n, pa.int64()))):
            out = out.append_column(name, value)
        yield from out.to_batches()

    return records.mapInArrow(sample, schema)


def counted(records: DataFrame) -> dict[int, int]:
    """Rows of each partition; no column of a file is read for it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = sum(batch.num_rows for batch in batches)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64())})

    return {r.part: r.n for r in records.select(F.lit(0).alias("x")).mapInArrow(count, "part int, n long").collect()}


def reservoir_sample(records: DataFrame, k: int, seed: int = 20_24) -> DataFrame:
    """min(k, n) rows of `records`, each subset of that size equally likely."""
    if k <= 0:
        return records.limit(0)
    counts = counted(records)
    parts = sorted(counts)
    draws = split_draws([counts[p] for p in parts], k, seed)
    return reservoirs(records, k, seed, {p: (counts[p], d) for p, d in zip(parts, draws)}).select(*records.columns)


def merge(left: DataFrame, n_left: int, right: DataFrame, n_right: int, k: int, seed: int) -> DataFrame:
    """The uniform sample of both populations from uniform samples of each: `n_left` and `n_right` are their sizes."""
    a, b = split_draws([n_left, n_right], k, seed)

    def drawn(df: DataFrame, n: int, salt: int) -> DataFrame:
        cols = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.orderBy(F.xxhash64(F.to_json(cols), F.lit(seed + salt)), F.rand(seed + salt)).limit(n)

    return drawn(left, a, 1).unionByName(drawn(right, b, 2))
