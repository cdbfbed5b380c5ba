"""Readers of the supported record formats and the projection of records to documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Columns are pruned to `fields` if the file has any of them."""
    df = spark.read.parquet(path)
    there = [f for f in fields or [] if f in df.columns]
    return df.select(*there) if there else df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, plain or gzip; lines that are no objects are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file is one object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path)


def zipped_csv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """CSV members of zip files. The separator is a semicolon if it is commoner than the comma in the first 4096 characters."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.lower().endswith(".csv"):
                            body = z.read(name).decode("utf-8", "replace")
                            sep = ";" if body[:4096].count(";") > body[:4096].count(",") else ","
                            rows = pd.read_csv(io.StringIO(body), sep=sep, dtype=str, keep_default_na=False)
                            yield rows.reindex(columns=fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"`{f}` string" for f in fields))


def zipped_xml(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """XML members of zip files, a row each: the text of each tag, the last one if it repeats. Broken files are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for batch in batches:
            for content in batch["content"]:
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.lower().endswith(".xml"):
                            try:
                                root = ElementTree.fromstring(z.read(name))
                            except ElementTree.ParseError:
                                continue
                            found = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in root.iter()}
                            rows.append([found.get(f) for f in fields])
                yield pd.DataFrame(rows, columns=fields, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"`{f}` string" for f in fields))


def to_documents(records: DataFrame, fields: list[str], key: Column, source: str | None = None) -> DataFrame:
    """(id, text, source): the non-empty fields joined by blank lines; rows without text are left out. Lists become JSON."""
    parts = []
    kinds = dict(records.dtypes)
    for f in fields:
        c = F.to_json(F.col(f)) if kinds[f].startswith(("array", "map", "struct")) else F.col(f).cast("string")
        parts.append(F.nullif(F.trim(c), F.lit("")))
    made = records.select(key.alias("id"), F.concat_ws("\n\n", *parts).alias("text"))
    return made.where("text <> ''").withColumn("source", F.lit(source) if source else F.substring_index("id", ":", 1))


def ordered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of all files of a pattern with `ord`, their place when the files stand one behind the other by name."""
    from ..operators.records import numbered

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"), F.from_json("value", schema).alias("__r"))
    placed = numbered(lines.where(F.col("__r").isNotNull() & (F.to_json("__r") != "{}")), ["__f", "__b", "__m"], "ord")
    return placed.select("ord", "__r.*")


def indexed_documents(records: DataFrame, fields: list[str], name: str, file: str, order: list[str], most: int | None = None) -> DataFrame:
    """(id, text, source) with ids `name:file:i`, where i counts all records from 0, those without text included; the first
    `most` documents if that is given."""
    from ..operators.records import numbered

    placed = numbered(records, order, "__i")
    made = to_documents(placed.withColumn("__key", F.concat(F.lit(f"{name}:{file}:"), (F.col("__i") - 1).cast("string"))), [*fields], F.col("__key"))
    number = F.substring_index("id", ":", -1).cast("long")
    return made if most is None else made.orderBy(number).limit(most)


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, expected, ok) of each file with a checksum file beside it (`.sha256`, the sum first)."""
    sums = checksums(spark, path).where(~F.col("name").endswith(".sha256"))
    beside = spark.read.format("binaryFile").option("pathGlobFilter", "*.sha256").load(path)
    expected = beside.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.sha256$", "").alias("name"), F.lower(F.substring_index(F.trim(F.decode("content", "UTF-8")), " ", 1)).alias("expected"))
    return sums.join(expected, "name").select("name", "sha256", "expected", (F.col("sha256") == F.trim("expected", F.lit("\n\r "))).alias("ok"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
