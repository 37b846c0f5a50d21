"""Field rules on whole documents: unordered arrays, dropped elements; and files of outputs."""

import json

import pytest
from pyspark.sql import functions as F

from leafspan.functions.paths import FieldRules
from leafspan.operators import consistency, reports, significance
from leafspan.sources import files, flatten


def scores(spark, a, b, rules):
    df = spark.createDataFrame([(json.dumps(a), json.dumps(b))], "a string, b string").select(flatten.flatten_json(F.col("a")).alias("a"), flatten.flatten_json(F.col("b")).alias("b"))
    return {k: (v.status, round(v.score, 4)) for k, v in consistency.with_scores(df, "a", "b", rules).first().scores.items()}


def test_unordered(spark):
    tags = FieldRules(unordered=("tags",))
    assert scores(spark, {"tags": ["x", "y"], "n": 1}, {"tags": ["y", "x"], "n": 1}, tags) == {"$.tags": ("same", 1.0), "$.n": ("same", 1.0)}
    assert scores(spark, {"tags": ["x", "x"]}, {"tags": ["y", "x"]}, tags)["$.tags"] == ("changed", 0.0)
    assert scores(spark, {"tags": ["x"]}, {"tags": ["x", "x"]}, tags)["$.tags"] == ("changed", 0.0)
    assert scores(spark, {"tags": ["x"]}, {}, tags) == {"$.tags": ("missing", 0.0), "$": ("extra", 0.0)}
    assert scores(spark, {"tags": []}, {"tags": []}, tags)["$.tags"] == ("same", 1.0)
    assert scores(spark, {"tags": "x"}, {"tags": "x"}, tags) == {"$.tags": ("same", 1.0)}  # no array
    assert scores(spark, {"tags": ["abcd", "zz"]}, {"tags": ["zz", "abce"]}, tags)["$.tags"] == ("changed", round(0.75**0.5, 4))
    rows = FieldRules(unordered=("rows",), tolerance={"rows[*].price": 0.5})
    a = {"rows": [{"id": "a", "price": 1}, {"id": "b", "price": 2, "tags": ["p", "q"]}]}
    b = {"rows": [{"id": "b", "price": 2.4, "tags": ["p", "q"]}, {"id": "a", "price": 1}]}
    assert scores(spark, a, b, rows) == {"$.rows": ("same", 1.0)}
    assert scores(spark, a, b, FieldRules(unordered=("rows",)))["$.rows"] == ("changed", 0.0)
    assert scores(spark, {"a": a}, {"a": b}, FieldRules(unordered=("**",), tolerance={"**": 0.5})) == {"$.a.rows": ("same", 1.0)}


@pytest.mark.parametrize("ignore", [("a[1]",), ("a[*]",), ("a[0]", "b[0].c[1]"), ("b[*].c[0]",), ("b[0]",), ("x",), ("**[1]",)])
def test_dropped_elements_move_the_rest_up(spark, ignore):
    doc = {"a": [1, 2, 3], "b": [{"c": [4, 5], "x": 6}, {"c": [7, [8, 9]]}], "x": [0]}
    rules = FieldRules(ignore=ignore)

    def dropped(v, path=()):
        def gone(p):
            return any({"a[1]": p == ("a", 1), "a[*]": len(p) == 2 and p[0] == "a", "a[0]": p == ("a", 0), "b[0].c[1]": p == ("b", 0, "c", 1), "b[*].c[0]": len(p) == 4 and p[0] == "b" and p[2:] == ("c", 0), "b[0]": p == ("b", 0), "x": p[-1:] == ("x",), "**[1]": p[-1:] == (1,)}[i] for i in ignore)

        if isinstance(v, dict):
            return {k: dropped(x, (*path, k)) for k, x in v.items() if not gone((*path, k))}
        if isinstance(v, list):
            return [dropped(x, (*path, i)) for i, x in enumerate(v) if not gone((*path, i))]
        return v

    want = {k: x for k, x in flatten.document_of(dropped(doc)).items() if not x["vtype"].startswith("empty")}
    got = spark.createDataFrame([(json.dumps(doc),)], "t string").select(flatten.flatten_json(F.col("t")).alias("d")).select(rules.strip(F.col("d")).alias("d")).first().d
    assert {k: x.nval for k, x in got.items()} == {k: x["nval"] for k, x in want.items()}


def test_pairs_with_unordered_arrays(spark):
    rows = [("p", 1, '{"t": ["x", "y"]}'), ("p", 2, '{"t": ["y", "x"]}'), ("p", 3, '{"t": ["y", "z"]}'), ("p", 4, '{"t": ["x", "y"]}')]
    docs = spark.createDataFrame(rows, "prompt_id string, run_id int, t string").select("prompt_id", "run_id", flatten.flatten_json(F.col("t")).alias("doc"))
    scored = consistency.pairs(docs, FieldRules(unordered=("t",)))
    p = consistency.prompt_scores(docs, scored).first()
    assert (p.n_pairs, p.share_same) == (6, 0.5) and [(r.path, r.n) for r in consistency.unstable_fields(scored).collect()] == [("$.t", 3)]
    assert tuple(reports.worst_pairs(scored).first())[:3] == ("p", 1, 3)


def test_folders_and_runs(spark, tmp_path):
    for folder, texts in (("one", {"a.json": '{"x": 1, "y": 2}', "sub/b.json": "[1]", "c.json": "1", "d.json": "no"}), ("two", {"a.json": '{ "y": 2, "x": 1}', "sub/b.json": "[2]", "e.json": "{}", "d.json": "1"})):
        for name, text in texts.items():
            (tmp_path / folder / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / folder / name).write_text(text)
    got = {r.path: r.status for r in files.compare_folders(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()}
    assert got == {"a.json": "same", "sub/b.json": "different", "c.json": "missing_after", "e.json": "new_after", "d.json": "error"}
    runs = lambda text: (tmp_path / "r.jsonl").write_text(text) and [(r.prompt_id, r.raw) for r in flatten.read_runs(spark, str(tmp_path / "r.jsonl")).orderBy("run_id").collect()]
    assert runs('{"a": 1}\n\nbroken\n[2]\n') == [("", '{"a": 1}'), ("", "broken"), ("", "[2]")]
    assert runs(' [{"a":1}, "t", 3]') == [("", '{"a":1}'), ("", '"t"'), ("", "3")]
    assert runs('{"prompt": "p", "outputs": ["x", "y"]}\n{"outputs": ["z"]}\n{"prompt": "p", "outputs": ["w"]}\n') == [("p", "x"), ("p", "y"), ("row 1", "z"), ("p", "w")]
    (tmp_path / "l.jsonl").write_text('{"prompt": "p", "outputs": ["x"]}\nbad\n{"prompt": "p", "outputs": ["y"]}\n{"prompt": "q"}\n')
    assert [(r.prompt_id, r.outputs) for r in files.read_lenient(spark, str(tmp_path / "l.jsonl")).collect()] == [("p", ["y"])]


def test_rules_file_and_texts(spark):
    rules = files.rules_of('{"ignore": ["a"], "tolerance": {"p": 1}}', unordered=("t",), tolerance={"p": 2})
    assert rules.ignore == ("a",) and rules.unordered == ("t",) and rules.limits() == [("p", 2.0, 0.0)]
    for bad in ('{"other": 1}', "[]"):
        with pytest.raises(ValueError):
            files.rules_of(bad)
    assert files.balanced('x {"a": [1, {"b": 2}]} y}') == '{"a": [1, {"b": 2}]}' and files.balanced("[1, 2") is None and files.balanced(None) is None and files.balanced("[[1]]") == "[[1]]"


def test_snapshot_and_gate(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([(1, 0.5), (2, x)], "k int, score double")
    at = str(tmp_path / "base")
    assert files.snapshot(spark, rows(1.0), at, "k").count() == 0
    assert [r.key for r in files.snapshot(spark, rows(0.9), at, "k").collect()] == [2]
    assert files.snapshot(spark, rows(0.9), at, "k", update=True).count() == 0
    prompts = spark.createDataFrame([("a", 0.5, 1.0), ("b", 1.0, 1.0)], "prompt_id string, share_same double, r_v double")
    reports.gate(prompts, min_share=0.5, min_validity=1.0)
    with pytest.raises(AssertionError, match="a: 0.500"):
        reports.gate(prompts, min_share=0.6)


def test_power_mean_edges(spark):
    row = spark.createDataFrame([([0.0, 1.0], [])], "a array<double>, e array<double>").select(*[significance.power_mean(F.col(c), p).alias(f"{c}{i}") for c in "ae" for i, p in enumerate((float("-inf"), 0.0, 1.0, -2.0))]).first()
    assert tuple(row) == (0.0, 0.0, 0.5, 0.0, 1.0, 1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        significance.power_mean(F.lit(1), 2)
