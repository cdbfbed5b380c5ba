"""Event log operators: cleaning of repeated rows, filters, counts and shortening of details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def once(log: DataFrame) -> DataFrame:
    """Rows that were sent twice count once; rows repeated under the channel of errors are left out."""
    return log.where(F.col("channel").isNull() | (F.col("channel") != "errors")).distinct()


def matching(log: DataFrame, channel: str | None = None, status: str | None = None, text: str | None = None, newest: int | None = None) -> DataFrame:
    """Rows of a channel and status whose details hold `text` in any case; the newest ones, oldest first."""
    out = log
    if channel:
        out = out.where(F.col("channel") == channel)
    if status:
        out = out.where(F.lower("status") == status.lower())
    if text:
        out = out.where(F.lower("details").contains(text.lower()))
    if newest:
        out = out.orderBy(F.desc("logged_at"), F.desc("log_id")).limit(newest)
    return out


def tail(log: DataFrame, newest: int, dropped_steps: tuple[str, ...] = ()) -> DataFrame:
    """The newest rows of each channel, without the channel of repeated errors and without `dropped_steps`.

    Each task keeps its own newest rows of a channel before any are ranked together.
    """
    kept = log.where((F.col("channel") != "errors") & ~F.coalesce("step", F.lit("")).isin(*dropped_steps))
    order = W.partitionBy("channel").orderBy(F.desc("logged_at"), F.desc("log_id"))
    return kept.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= newest).drop("__r")


def shortened_list(values: Column, most: int = 2000, items: int = 200) -> Column:
    """At most `items` values of an array of texts, each shortened."""
    return F.slice(F.transform(values, lambda x: shortened(x, most)), 1, items)


def shortened(text: Column, most: int = 2000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("...[+"), (F.length(text) - most).cast("string"), F.lit(" chars]"))).otherwise(text)


def message_chunks(text: Column, size: int) -> Column:
    """Lines packed into messages of at most `size` characters; longer lines are cut hard."""
    pieces = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(F.length(x) <= size, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{size}}}"), 0))))
    start = F.array().cast("array<string>")

    def pack(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (F.size(out) > 0) & (F.length(F.when(F.size(out) > 0, last)) + 1 + F.length(x) <= size)
        return F.when(fits, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.lit("\n"), x)))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(pieces, start, pack)
