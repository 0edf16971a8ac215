"""Session factory and table loader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from diglot.shipping import ship


def session(cores: int | str = 8, app: str = "diglot", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use.

    On a cluster the session comes from spark-submit; nothing here is needed there.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("DIGLOT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, as a Parquet scan that filters and projections reach.

    Texts and pages in one local file are spread over all cores: such a file is small, has few row
    groups, and would keep one core busy. Tables of many files are read as they are.
    """
    ship(spark)
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path)
    alone = name in ("documents", "pages", "conversations") and os.path.isfile(path)
    return found.repartition(spark.sparkContext.defaultParallelism) if alone else found
