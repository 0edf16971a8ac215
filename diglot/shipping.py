"""Sends this package to the Python workers, so that a session started anywhere can run its operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()
#: Spark's default of 64 MB is held several times over by each Python worker while a batch passes.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session, once for each application.

    Arrow batches of a session with the default size become 8 MB at most.
    """
    key, default, smaller = BATCH
    if spark.conf.get(key, None) in (None, default):  # with a default of its own, get doesn't give Spark's
        spark.conf.set(key, smaller)
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="diglot-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "diglot_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
