"""Places where a plan is cut: written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from diglot.shipping import ship

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode a temporary one if that is unset.

    A cluster without the setting is an error: a machine-local folder would not be seen by
    other executors.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="diglot-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(path: str) -> bool:
    """Whether there is a file or folder of this name on the file system that its scheme names."""
    where, name = fs.FileSystem.from_uri(path)
    return where.get_file_info(name).type != fs.FileType.NotFound


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: its lineage ends at files that outlive executors."""
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
