import json

from leafspan.sources import traces


def test_trajectories(spark):
    records = [
        {"attributes": {"event.name": "x.tool_result", "tool_name": "b", "tool_input": '{"q": 1}', "prompt.id": "p", "event.sequence": 2}},
        {"attributes": [{"key": "event.name", "value": {"stringValue": "tool_result"}}, {"key": "tool_name", "value": {"stringValue": "a"}}, {"key": "prompt.id", "value": {"stringValue": "p"}}, {"key": "event.sequence", "value": {"intValue": 1}}]},
        {"body": {"tool.name": "c", "tool_parameters": {"z": 1}}, "session.id": "s", "success": True},
        {"name": "other", "tool_name": "d"},
        {"body": "tool_result"},
    ]
    lines = [json.dumps(r) for r in records] + ["", "not json", "[1]"]
    got = {r.group_id: [(s.name, s.args and json.loads(s.args), s.success) for s in r.steps] for r in traces.trajectories(spark.createDataFrame(lines, "string")).collect()}
    assert got == {"p": [("a", None, None), ("b", {"q": 1}, None)], "s": [("c", {"z": 1}, "true")]}
    assert {r.group_id for r in traces.trajectories(spark.createDataFrame(lines, "string"), by="single").collect()} == {"all"}


def test_transcripts(spark, tmp_path):
    call = lambda n: {"type": "tool_use", "name": n, "input": {"k": n}}
    rows = [{"type": "assistant", "message": {"content": [call("a"), {"type": "text"}, call("b")]}}, {"type": "user", "message": {"content": [call("x")]}}, {"type": "assistant", "message": {"content": [call("c")]}}]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    (tmp_path / "none.jsonl").write_text("{}\n")
    got = traces.read_transcripts(spark, str(tmp_path)).collect()
    assert [[s.name for s in r.steps] for r in got] == [["a", "b", "c"]] and json.loads(got[0].steps[0].args) == {"k": "a"}
