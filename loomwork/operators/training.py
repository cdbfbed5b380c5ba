"""Training examples and shards: prompts from history, step parsing, truncation with a loss mask, packing into shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpointed


def shard_totals(docs: DataFrame, split: Column, tokens: str) -> DataFrame:
    return docs.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("docs"), F.sum(tokens).alias("tokens"))


def shard_numbers(docs: DataFrame, key: str, split: str, tokens: str, cap: int) -> DataFrame:
    """(key, split, shard): documents in key order; a shard ends with the document that reaches `cap` tokens.

    The walk is sequential, but not as one task. Keys are cut into ordered ranges. For a range, all that matters of what
    came before is how full the open shard is, and that only decides which document closes it; from each such document
    the rest of the range is walked once, from the right. The ranges' small tables are then chained in order, and each
    range numbers its documents from the state at its start. Only keys and sizes take part.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(key, split, F.col(tokens).cast("long").alias(tokens)).repartitionByRange(n, split, key).sortWithinPartitions(split, key).withColumn("__part", F.spark_partition_id())
    rows = checkpointed(rows)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        out = []
        for (part, name), group in pd.concat(parts).groupby(["__part", split], sort=True):
            total = np.concatenate([[0], np.cumsum(group[tokens].to_numpy())])
            # a shard that starts with document i ends with document close[i], if it ends here
            close = np.searchsorted(total[1:], total[:-1] + cap)
            shards, left = np.zeros(len(group) + 1, np.int64), np.zeros(len(group) + 1, np.int64)
            for i in range(len(group) - 1, -1, -1):
                if close[i] < len(group):
                    shards[i], left[i] = shards[close[i] + 1] + 1, left[close[i] + 1]
                else:
                    left[i] = total[-1] - total[i]
            # which document closes the open shard, by how many tokens it lacks
            last = min(int(np.searchsorted(total[1:], cap)), len(group) - 1)
            out += [(part, name, int(total[k + 1]), int(shards[k + 1]) + 1, int(left[k + 1])) for k in range(last + 1)]
            out.append((part, name, -1, 0, int(total[-1])))
        yield pd.DataFrame(out, columns=["part", "split", "upto", "shards", "left"])

    found: dict[tuple, list] = {}
    for r in rows.mapInPandas(tables, f"part int, split {kinds[split]}, upto long, shards long, left long").collect():
        found.setdefault((r.split, r.part), []).append((r.upto, r.shards, r.left))
    starts, state = {}, {}
    for name, part in sorted(found):
        shard, filled = state.get(name, (0, 0))
        starts[part, name] = (shard, filled)
        entries = sorted(e for e in found[name, part] if e[0] >= 0)
        closing = next((e for e in entries if filled + e[0] >= cap), None)
        whole = next(e for e in found[name, part] if e[0] < 0)
        state[name] = (shard + closing[1], closing[2]) if closing else (shard, filled + whole[2])
    shared = spark.sparkContext.broadcast(starts)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_shards: dict = {}
        for batch in batches:
            out = []
            for part, name, size in zip(batch["__part"], batch[split], batch[tokens]):
                shard, filled = open_shards.get(name) or shared.value[part, name]
                out.append(shard)
                filled += int(size)
                open_shards[name] = (shard + 1, 0) if filled >= cap else (shard, filled)
            yield batch.assign(shard=np.array(out, np.int32))[[key, split, "shard"]]

    return rows.mapInPandas(number, f"{key} {kinds[key]}, {split} {kinds[split]}, shard int")


def prefix_prompts(steps: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """`steps` with `history`: the texts of all earlier steps of the group, in order."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return steps.withColumn("history", F.array_join(F.collect_list(text).over(w), "\n\n"))


def step_code(text: Column) -> Column:
    """The last fenced code of a step."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(r"(?s)```python\n(.*?)```"), 1)), -1)


def step_confidence(text: Column) -> Column:
    """The last confidence that a step states, in (0, 100], to three decimals; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"\"?confidence\"?[ ]*[:=][ ]*([0-9]+(?:\.[0-9]+)?)"), 1)
    value = F.element_at(F.concat(F.array(F.lit(None).cast("string")), found), -1).try_cast("double")
    return F.when((value > 0) & (value <= 100), F.round(value, 3))


def confidence_target(valid: Column, error: Column, score: Column) -> Column:
    """Invalid: 5 with an error, else 12. Valid: the score in percent, at most 10 with an error. Kept in [2, 98]."""
    percent = 100 * score
    raw = F.when(~valid & error, 5.0).when(~valid, 12.0).when(error, F.least(F.lit(10.0), percent)).otherwise(percent)
    return F.greatest(F.lit(2.0), F.least(F.lit(98.0), raw))


def truncated(prompt: Column, target: Column, room: int, head: int = 256) -> Column:
    """struct(ids, mask): the target with an end mark whole if it fits, the prompt's head and tail in what is left."""
    goal = F.slice(F.concat(target, F.array(F.lit("</s>"))), 1, room)
    left = F.greatest(F.lit(0), F.lit(room) - F.size(goal))
    keep = F.least(F.lit(head), F.floor(left / 2)).cast("int")
    tail = left - keep
    cut = F.when(F.size(prompt) <= left, prompt).otherwise(F.concat(F.slice(prompt, F.lit(1), keep), F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - tail + 1), tail)))
    return F.struct(F.concat(cut, goal).alias("ids"), F.concat(F.array_repeat(F.lit(0), F.size(cut)), F.array_repeat(F.lit(1), F.size(goal))).alias("mask"))


def section_examples(docs: DataFrame, key: str, text: str = "text", most: int = 3) -> DataFrame:
    """(key, prompt, target): the first sentences of each text as cited facts, and as the section that is written of them."""
    first = F.transform(F.slice(T.sentences(F.col(text)), 1, most), lambda s: F.rtrim(s, F.lit(".")))
    label = lambda i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("]"))
    facts = F.array_join(F.transform("__s", lambda s, i: F.concat(s, F.lit(". "), label(i))), "\n")
    target = F.array_join(F.transform("__s", lambda s, i: F.concat(s, F.lit(" "), label(i), F.lit("."))), " ")
    return docs.select(key, first.alias("__s")).where(F.size("__s") > 0).select(key, F.concat(F.lit("Write a section from these facts:\n"), facts).alias("prompt"), target.alias("target"))


def distractors(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key): for each group one row of another group, chosen by the hash of the group's name.

    Rows are numbered in the order of their keys once; the n-th row outside a group is found from its own group's
    numbers, so groups do not meet all rows.
    """
    from .records import numbered

    known = rows.where(F.col(group).isNotNull()).select(group, key)
    placed = checkpointed(numbered(known, [key], "n"))
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("own"))
    # one row for each group: which row outside of it
    wanted = sizes.crossJoin(F.broadcast(total)).where("total > own").select(group, (F.pmod(T.hash32(F.col(group)), F.col("total") - F.col("own")) + 1).alias("at"))
    # its number is `at` and the own rows before it: own row i stands before it if its number less i is under `at`
    rank = F.row_number().over(W.partitionBy(group).orderBy("n"))
    before = placed.withColumn("i", rank).join(wanted, group).where(F.col("n") - F.col("i") < F.col("at")).groupBy(group).agg(F.count(F.lit(1)).alias("before"))
    number = wanted.join(before, group, "left").select(group, (F.col("at") + F.coalesce("before", F.lit(0))).alias("n"))
    return number.join(placed.select("n", key), "n").select(group, key)
