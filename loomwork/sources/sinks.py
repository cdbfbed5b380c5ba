"""Writers: stage output, reports, training splits and token shards."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def markdown(report: DataFrame) -> str:
    """A small report as a table."""
    rows = [tuple(r) for r in report.collect()]
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]
    return "\n".join(lines)


def stage_output(report: DataFrame, samples: DataFrame, path: str) -> None:
    """Counts and review samples of a plan's stages, by stage."""
    report.write.mode("overwrite").partitionBy("stage").json(f"{path}/stats")
    samples.write.mode("overwrite").partitionBy("stage").json(f"{path}/samples")


def before_and_after(report: DataFrame) -> DataFrame:
    """(source, docs_in, docs_out, chars_in, chars_out) from the first stage's input to the last one's output; a report has
    a row for each stage and source."""
    total = lambda c: F.max(c) if c.endswith("_in") else F.min(c)
    return report.groupBy("source").agg(*[total(c).alias(c) for c in ("docs_in", "docs_out", "chars_in", "chars_out")])


def combined_report(report: DataFrame) -> tuple[str, str]:
    """The report as JSON and as Markdown, with sources before and after; as many rows as stages and sources."""
    sources = before_and_after(report)
    stages = report.orderBy("stage", "source")
    both = {"stages": [r.asDict() for r in stages.collect()], "sources": [r.asDict() for r in sources.orderBy("source").collect()]}
    return json.dumps(both, sort_keys=True), markdown(stages) + "\n\n" + markdown(sources.orderBy("source"))


def event_log(events: DataFrame, path: str, time: str = "logged_at") -> None:
    """Appends events by day and channel; those with an error are written under the channel of errors, too."""
    failed = events.where((F.lower("status") == "error") & (F.col("channel") != "errors")).withColumn("channel", F.lit("errors"))
    dated = events.unionByName(failed).withColumn("day", F.to_date(time))
    dated.write.mode("append").partitionBy("day", "channel").json(path)


def state(values: dict, path: str) -> None:
    """A small state as JSON; the old one stays until the new one is whole."""
    with open(f"{path}.new", "w") as file:
        json.dump(values, file)
        file.flush()
        os.fsync(file.fileno())
    os.replace(f"{path}.new", path)


def token_shards(docs: DataFrame, path: str, bos: int, eos: int, vocab: int, ids: str = "ids", order: str = "doc_id") -> DataFrame:
    """Binary shards, a row for each written: split, shard, docs, tokens, content. `docs` has split, shard, an order and ids.

    Numbers take two bytes if the vocabulary allows it. A shard is bounded by its cap, so it is one group.
    """
    kind = np.uint16 if vocab < 1 << 16 else np.uint32

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        flat = np.concatenate([np.array([bos, *x, eos], kind) for x in pdf[ids]])
        return pd.DataFrame([(pdf["split"].iloc[0], int(pdf["shard"].iloc[0]), len(pdf), len(flat), flat.tobytes())], columns=["split", "shard", "docs", "tokens", "content"])

    packed = docs.groupBy("split", "shard").applyInPandas(pack, "split string, shard int, docs long, tokens long, content binary")
    packed.write.mode("overwrite").partitionBy("split").parquet(path)
    return docs.sparkSession.read.parquet(path).drop("content")


def read_shard(content: bytes, vocab: int) -> np.ndarray:
    return np.frombuffer(content, np.uint16 if vocab < 1 << 16 else np.uint32)


def windows(tokens: Iterator[int] | np.ndarray, length: int, seed: int, count: int) -> np.ndarray:
    """`count` random windows of length + 1 tokens of a shard."""
    flat = np.asarray(tokens)
    starts = np.random.default_rng(seed).integers(0, max(1, len(flat) - length), count)
    return np.stack([flat[s : s + length + 1] for s in starts])


def manifest(state: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered datasets with what was read of them."""
    return registry.join(state, "name", "left").select(registry["name"], *[c for c in registry.columns if c != "name"], *[c for c in state.columns if c != "name"]).orderBy(F.col("name"))
