"""Session helpers: a local test session, table loading and a checkpoint folder shared by all executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomwork")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMWORK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a scale folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, over as many partitions as there are cores."""
    return spread(table(spark, sf_dir, name))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, with its lineage cut.

    The cluster names the folder in spark.checkpoint.dir; only where that is unset on one machine (in tests) a temporary
    folder is taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomwork-"))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python, once for each Spark context.

    Where executors see the driver's files, its folder is put on their path; elsewhere they get the package as a zip.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loomwork_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = sc.environment.get("PYTHONPATH", "")
    sc.environment["PYTHONPATH"] = f"{root}:{path}" if path else root
    if not sc.master.startswith("local"):
        import shutil

        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "loomwork"), "zip", root, "loomwork"))
    sc._loomwork_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """`df`, a plain scan, over as many partitions as there are cores if its files give fewer; larger scans stay as they are.

    For steps with much work on each row: a small file of one row group would be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
