"""Python of this package on workers that do not have it."""

import os
import subprocess
import sys
import textwrap

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from leafspan.functions.paths import FieldRules
from leafspan.operators import assign, consistency, trees
from leafspan.sources import converters, files, flatten, replies
df = spark.createDataFrame([('{{"a": [1, 2]}}', '{{"a": [2, 1, 3]}}', "see {{\\"k\\": 1}}")], "x string, y string, text string")
d = df.select("*", flatten.flatten_json(F.col("x")).alias("a"), flatten.flatten_json(F.col("y")).alias("b"))
assert d.first().a is not None
assert d.select(files.first_balanced(F.col("text"))).first()[0]
assert d.select(flatten.is_valid(F.lit("[1]"))).first()[0]
assert consistency.with_scores(d, "a", "b", FieldRules(unordered=("$.a",))).first().scores is not None
assert d.select(assign.unordered_similarity(F.array(F.lit("p")), F.array(F.lit("p")))).first()[0].total == 0
assert trees.profile_scores(d, "a", "b", "typed_mean").first().score > 0
assert d.select(trees.tree_edit_distance(F.col("a"), F.col("b")).alias("e")).first().e.nodes == 9
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(SCRIPT.format(root=root))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-3000:]
