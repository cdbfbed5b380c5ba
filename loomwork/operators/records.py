"""Operators on records and lists: flattening, numbering by first use, band look-up, replacement from a reserve, scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed


def flattened(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, text): a row for each field that is there; arrays are joined by spaces, numbers written out."""
    kinds = dict(rows.dtypes)

    def text(name: str) -> Column:
        return F.array_join(F.transform(F.array_compact(name), lambda x: x.cast("string")), " ") if kinds[name].startswith("array") else F.col(name).cast("string")

    each = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("text")) for f in fields])
    return rows.select(key, F.inline(each)).where(F.col("text").isNotNull())


def described(name: str, value: Column, kind: str) -> Column:
    """A line on a value: its kind and size."""
    if kind == "string":
        return F.concat(F.lit(f"{name}: text, "), F.length(value).cast("string"), F.lit(" chars"))
    if kind.startswith("array"):
        return F.concat(F.lit(f"{name}: list, "), F.size(value).cast("string"), F.lit(" items"))
    return F.lit(f"{name}: {kind}")


def sliced(text: Column, start: int, stop: int | None = None) -> Column:
    """Characters from `start` up to `stop`, counted from 0."""
    return F.substring(text, start + 1, 2_000_000_000 if stop is None else max(0, stop - start))


def first_use_labels(rows: DataFrame, group: str, item: str, order: Sequence[str], prefix: str = "S") -> DataFrame:
    """(group, item, label): the items of a group numbered in the order in which they first stand.

    Uses are combined to one row an item before anything is ranked.
    """
    first = rows.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.min(F.struct(*order)).alias("__first"))
    n = F.row_number().over(W.partitionBy(group).orderBy("__first", item))
    return first.select(group, item, F.concat(F.lit(prefix), n.cast("string")).alias("label"))


def band_of(value: Column, bands: Sequence[tuple[float, float, float]], default: int) -> Column:
    """(low, high) of the first band (most, low, high) with value <= most; of the band `default` where the value is null.

    Bands are a short list of settings, so the range join is an expression and nothing is shuffled.
    """
    pair = lambda b: F.struct(F.lit(float(b[1])).alias("low"), F.lit(float(b[2])).alias("high"))
    found = reduce(lambda rest, b: F.when(value <= b[0], pair(b)).otherwise(rest), reversed(bands), F.lit(None))
    return F.when(value.isNull(), pair(bands[default])).otherwise(found)


#: Distinct values whose bands are sent to the workers, at most; more are joined.
SENT_VALUES = 100_000


def range_joined(rows: DataFrame, value: str, bands: DataFrame, most: str) -> DataFrame:
    """`rows` with the columns of the band of the least `most` that is not under `value`; null where there is none.

    For bands of any number: the distinct values and the bands are put in order by range, and each range takes the first
    band behind it from the next ranges that have one. Rows then meet the band of their value, so they are neither sorted
    nor do many of one value meet in one task.
    """
    extra = [c for c in bands.columns if c != most]
    number = F.col(value).cast("double")
    struct = F.struct(F.col(most).alias("__most"), *extra)
    left = rows.select(number.alias("__v")).distinct().select("__v", F.lit(0).alias("__side"), F.lit(None).cast(bands.select(struct.alias("s")).schema["s"].dataType).alias("__band"))
    right = bands.select(F.col(most).cast("double").alias("__v"), F.lit(1).alias("__side"), struct.alias("__band"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # bounds are sampled again if the plan runs again, so the ranges are written
    ranged = checkpointed(left.unionByName(right).where("__v IS NOT NULL").repartitionByRange(n, "__v").withColumn("__part", F.spark_partition_id()))
    # from the end to the start: a frame that starts at the current row would be gone through again for each row
    inside = F.last("__band", ignorenulls=True).over(W.partitionBy("__part").orderBy(F.desc("__v"), F.desc("__side")).rowsBetween(W.unboundedPreceding, W.currentRow))
    # one row for each range: the first band of any range behind it
    firsts = ranged.where("__side = 1").groupBy("__part").agg(F.min_by("__band", "__v").alias("__b"))
    parts = ranged.select("__part").distinct().join(firsts, "__part", "left")
    later = parts.select("__part", F.last("__b", ignorenulls=True).over(W.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)).alias("__later"))
    found = ranged.withColumn("__in", inside).where("__side = 0").join(F.broadcast(later), "__part").select("__v", F.coalesce("__in", "__later").alias("__hit"))
    if ranged.where("__side = 0").count() <= SENT_VALUES:
        found = F.broadcast(found)
    return rows.withColumn("__v", number).join(found, "__v", "left").select(*rows.columns, *[F.col(f"__hit.{c}").alias(c) for c in extra])


def as_of(rows: DataFrame, other: DataFrame, by: Sequence[str], time: str, take: Sequence[str]) -> DataFrame:
    """`rows` with the columns `take` of the last row of `other` of the same key that is not later; null if there is none."""
    kept = rows.columns
    left = rows.select(*by, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*kept).alias("__row"), F.lit(None).cast(other.select(F.struct(*take).alias("s")).schema["s"].dataType).alias("__o"))
    right = other.select(*by, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(rows.select(F.struct(*kept).alias("s")).schema["s"].dataType).alias("__row"), F.struct(*take).alias("__o"))
    last = F.last("__o", ignorenulls=True).over(W.partitionBy(*by).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, W.currentRow))
    return left.unionByName(right).withColumn("__o", last).where("__side = 1").select("__row.*", *[F.col(f"__o.{c}").alias(c) for c in take])


def numbered(rows: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """`rows` with numbers from 1 in the order of `order`, without one task that sees all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each range
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return placed.withColumn(name, inside).join(F.broadcast(before), "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).select(*rows.columns, name)


def replaced(skipped: DataFrame, reserve: DataFrame, skipped_order: Sequence[str], reserve_order: Sequence[str]) -> DataFrame:
    """The n-th skipped row with the n-th of the reserve; rows beyond the shorter side are left out. Names must differ."""
    return numbered(skipped, skipped_order, "__n").join(numbered(reserve, reserve_order, "__n"), "__n").drop("__n")


def run_limit(used: Column, per_run: int, daily: int) -> Column:
    """How many more are allowed: the limit of a run within what the day has left."""
    return F.least(F.lit(per_run), F.greatest(F.lit(0), F.lit(daily) - used))


def weighted(parts: Sequence[tuple[float, Column]]) -> Column:
    """The weighted sum of conditions or scores; null counts 0."""
    return sum((F.lit(w) * F.coalesce(c.cast("double"), F.lit(0.0)) for w, c in parts), F.lit(0.0))


def lead_and_rest(hits: Column, weight: float = 0.7) -> Column:
    """For a ranked list of truths: `weight` for the first, the rest for the mean of the second and third; 0 if empty."""
    first = F.coalesce(F.get(hits, F.lit(0)).cast("double"), F.lit(0.0))
    tail = F.slice(hits, 2, 2)
    mean = F.coalesce(F.try_divide(F.size(F.filter(tail, lambda x: x)), F.size(tail)), F.lit(0.0))
    return F.when(F.size(hits) > 0, weight * first + (1 - weight) * mean).otherwise(0.0)
