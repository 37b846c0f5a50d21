"""Tables in the folder that driver and executors share: where lineage is cut and what a later run finds again."""

from __future__ import annotations

import tempfile
import uuid

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local mode, tests)."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_leafspan_folder"):
        sc._leafspan_folder = tempfile.mkdtemp(prefix="leafspan-shared-")
    return sc._leafspan_folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing that came before."""
    path = f"{shared_folder(df.sparkSession)}/leafspan-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_once(df: DataFrame, columns: list[str], made: dict[str, Column], name: str = "made") -> DataFrame:
    """df with what is made of some of its columns: made once for each distinct combination of them and joined to the rows, nulls too. df is written once.

    What is joined is as large as there are combinations; Spark sends it to every task only where its file is small.
    """
    rows = saved(df, f"{name}-rows")
    kinds = saved(rows.select(*columns).distinct().select(*[F.col(c).alias(f"__{c}") for c in columns], *[x.alias(n) for n, x in made.items()]), name)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    return rows.join(kinds, same).drop(*[f"__{c}" for c in columns])


def fenced(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each. A later filter then stays behind it: nothing is made once for it and
    once more for its columns, and no Python is taken into a join condition."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
