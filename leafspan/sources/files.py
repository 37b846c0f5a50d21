"""Files and texts that hold outputs: JSON files, folders compared, rules, JSON inside prose, snapshots."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import FieldRules
from ..functions.shipping import shipped_udf


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """file, raw, readable: every file under a path as one document; a file must fit in a task."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"), F.try_parse_json("value").isNotNull().alias("readable"))


def read_lenient(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines file of {prompt, outputs}: prompt_id, outputs. Lines that cannot be read or lack either are left out; of rows that repeat a prompt
    the last in the file holds."""
    lines = spark.read.text(path).select(F.from_json("value", "prompt string, outputs array<string>").alias("r"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    good = lines.where(F.col("r.prompt").isNotNull() & F.col("r.outputs").isNotNull())
    return good.groupBy(F.col("r.prompt").alias("prompt_id")).agg(F.max_by("r.outputs", "at").alias("outputs"))


def compare_folders(spark: SparkSession, before: str, after: str) -> DataFrame:
    """path, status, before, after: the files of two folders by relative path. same, different (as JSON values, so order of keys and spaces do not
    count), missing_after, new_after, or error where either cannot be read as JSON."""

    def side(root: str, name: str) -> DataFrame:
        df = read_json_files(spark, root)
        relative = F.regexp_replace(F.regexp_replace("file", r"^[a-z0-9]+:/*", "/"), f"^.*?{_escaped(root.rstrip('/').split('://')[-1])}/+", "")
        return df.select(relative.alias("path"), F.col("raw").alias(name), F.to_json(F.try_parse_json("raw")).alias(f"{name}_json"))

    both = side(before, "before").join(side(after, "after"), "path", "full_outer")
    status = F.when(F.col("after").isNull(), "missing_after").when(F.col("before").isNull(), "new_after").when(F.col("before_json").isNull() | F.col("after_json").isNull(), "error").when(F.col("before_json") == F.col("after_json"), "same").otherwise("different")
    return both.select("path", status.alias("status"), "before", "after")


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in text)


def rules_of(text: str, ignore: tuple[str, ...] = (), unordered: tuple[str, ...] = (), tolerance: dict | None = None) -> FieldRules:
    """Field rules from a JSON text of ignore, unordered and tolerance alone; what is given beside it is added, and overrides tolerances."""
    given = json.loads(text)
    if not isinstance(given, dict) or set(given) - {"ignore", "unordered", "tolerance"}:
        raise ValueError("rules are an object of ignore, unordered and tolerance")
    return FieldRules((*given.get("ignore", ()), *ignore), (*given.get("unordered", ()), *unordered), {**given.get("tolerance", {}), **(tolerance or {})})


def fenced(text: Column) -> Column:
    """The content of the first fenced block, or the whole text."""
    inner = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_-]*[ \t]*\r?\n(.*?)\r?\n?```", 1)
    return F.when(text.rlike(r"(?s)```[A-Za-z0-9_-]*[ \t]*\r?\n.*?```"), inner).otherwise(text)


def balanced(text: str | None) -> str | None:
    """From the first opening bracket to where as many have closed; brackets in quotes count, too. None if that never happens."""
    at = min((i for i in ((text or "").find("{"), (text or "").find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    opened, closed = ("{", "}") if text[at] == "{" else ("[", "]")
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == opened) - (text[i] == closed)
        if not depth:
            return text[at : i + 1]
    return None


@shipped_udf(T.StringType())
def first_balanced(text: pd.Series) -> pd.Series:
    """The first balanced JSON object or array in a text, after a fence is taken off."""
    return text.map(balanced)


def shortened(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def snapshot(spark: SparkSession, results: DataFrame, path: str, key: str, update: bool = False) -> DataFrame:
    """Rows that differ from a baseline kept as Parquet: key, before, after (as JSON). Without a baseline, or to update it, it is written and nothing differs.

    Both are compared by key in a full outer join; a key must be unique.
    """
    text = lambda df, name: df.select(F.col(key).alias("key"), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias(name))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if update or not there:
        text(results, "before").write.mode("overwrite").parquet(path)
    both = spark.read.parquet(path).join(text(results, "after"), "key", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
