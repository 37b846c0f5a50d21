"""Getting this package to the executors, which need not have it installed."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_leafspan_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="leafspan-"), "leafspan.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._leafspan_shipped = True


def shipped_udf(returns):
    """pandas_udf, whose package goes to the executors when a query first uses it."""

    def made(f):
        own = F.pandas_udf(f, returns)

        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            ship(SparkSession.getActiveSession())
            return own(*columns)

        return call

    return made
