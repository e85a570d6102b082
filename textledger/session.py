"""What a Spark session needs before Python code of this package runs in its tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Sends the package's source files to the executors, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_textledger_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="textledger-"), "textledger_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._textledger_shipped = True
