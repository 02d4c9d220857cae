"""Messages, responses, arms, diagnoses and readers, case by case."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from wayfield.functions import arms as A
from wayfield.functions import messages as M
from wayfield.sources import tables as T


def test_action_keys_of_lists_single_calls_and_nothing(spark):
    rows = [
        {"tool_calls": [{"function": {"name": "execute_bash", "arguments": '{"command": "pytest -q"}'}}, {"function": {"name": "str_replace_editor", "arguments": "{}"}}]},
        {"function_call": {"name": "grep_files", "arguments": "x"}},
        {"tool_calls": [], "function_call": {"name": "write_file", "arguments": None}},
        {"content": "no call"},
        {"tool_calls": [{"function": {"name": "", "arguments": "a"}}]},
    ]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(rows)], "k int, body string").select("k", F.from_json("body", M.MESSAGE).alias("m"))
    got = {r.k: r.keys for r in df.select("k", M.action_keys(F.col("m")).alias("keys")).collect()}
    assert got == {0: ["ACTION:edit", "CMD:pytest", "TOOL:execute_bash", "TOOL:str_replace_editor"], 1: ["ACTION:search", "TOOL:grep_files"], 2: ["ACTION:create", "TOOL:write_file"], 3: [], 4: []}


RESPONSES = [
    (("THOUGHT: see\nACTION: ```bash\nls -l\n```", None, None), ("", "see", "ls -l")),
    (("thought: a\naction: ls\nmore", None, None), ("", "a", "ls\nmore")),
    (("<think> deep </think>\nTHOUGHT: b\nACTION: bash -lc cat x", None, None), ("deep", "b", "cat x")),
    (("Look here\n```sh\ngrep y\n```\nend", None, None), ("", "Look here", "grep y")),
    (("nothing", "because\n```\nmake\n```", None), ("because\n```\nmake\n```", "because", "make")),
    (("visible", None, 'call {"cmd": ["bash", "-lc", "echo hi"]}'), ("", "call", "echo hi")),
    (("visible", None, '{"other": 1} {"command": "ls"}'), ("", '{"other": 1}', "ls")),
    (("visible", None, '{"cmd": "echo \\"a\\"", broken}'), ("", "visible", 'echo "a"')),
    (("visible", None, '{"cmd": ["grep", "a b", "f"]}'), ("", "visible", "grep 'a b' f")),
    (("visible", None, "{no json"), ("", "", "")),
    ((None, None, None), ("", "", "")),
    (("", "", ""), ("", "", "")),
]


def test_responses_are_parsed_by_sections_fences_and_json(spark):
    df = spark.createDataFrame([(k, *r) for k, (r, _) in enumerate(RESPONSES)], "k int, c string, r string, raw string")
    got = {r.k: tuple(r.p) for r in df.select("k", M.parsed("c", "r", "raw").alias("p")).collect()}
    for k, (given, want) in enumerate(RESPONSES):
        assert got[k] == want, given


def test_live_keys_of_missing_texts(spark):
    df = spark.createDataFrame([(1, None, None), (2, "cat /src/a.py", "Traceback (most recent call last)\nKeyError: x")], "k int, cmd string, seen string")
    got = {r.k: set(r.keys) for r in df.select("k", M.live_keys("cmd", "seen").alias("keys")).collect()}
    assert got[1] == {"TOOL:execute_bash"}
    assert {"ACTION:read", "CMD:cat", "FILE_PATH:/src/a.py", "FILE_EXT:py", "OBS:KeyError", "OBS:traceback", "OBS:hard_error", "OBS:error"} <= got[2]


def test_an_unknown_arm_is_an_error(spark):
    rows = spark.createDataFrame([("tg_hot", 1)], "arm string, n int")
    assert A.with_arm(rows).first().rank == 4
    with pytest.raises(Exception, match="unsupported arm"):
        A.with_arm(rows.union(spark.createDataFrame([("other", 2)], rows.schema))).collect()


def test_diagnoses_leave_out_what_has_no_number_or_text(spark):
    body = json.dumps({"families": {"a": {"diagnosis": " look "}, "b": {"diagnosis": " "}, "c": {}}, "by_trap_index": {"0": "a", "1": "b", "2": "c", "x": "a", "3": "missing", "4": "a"}})
    df = spark.createDataFrame([(body,), ("no json",), (None,)], "value string")
    assert sorted(map(tuple, A.diagnoses(df).collect())) == [(0, "look"), (4, "look")]


def test_outcomes_take_the_last_row_and_name_passes_once(spark, tmp_path):
    rows = [
        {"run_id": "r", "model_id": "m", "resolved": True, "metadata": {}},
        {"run_id": "r", "model_id": "a", "resolved": False, "metadata": {}},
        {"model_id": "m", "resolved": True, "metadata": {"pass": "pass1"}},
        {"model_id": "m", "resolved": True, "metadata": {"pass": "2"}},
        {"model_id": "m", "resolved": True, "metadata": {}},
    ]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "t.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r.run_str: (r.model_id, r.score) for r in T.outcomes(T.trajectories(spark, str(tmp_path))).collect()}
    assert got == {"r": ("a", 0.0), "m__pass1": ("m", 1.0), "m__pass2": ("m", 1.0)}


def test_verdicts_go_to_their_arm(spark):
    rows = spark.createDataFrame([("x", "hot", True), ("x", "base", True), ("y", "hot", True)], "instance_id string, arm string, resolved boolean")
    found = spark.createDataFrame([("hot", "x", True), ("base", "x", False)], "arm string, instance_id string, resolved boolean")
    assert {(r.instance_id, r.arm): r.resolved for r in T.merged(rows, found).collect()} == {("x", "hot"): True, ("x", "base"): False, ("y", "hot"): False}


def test_factorial_takes_the_last_repeat_and_one_arm_s_flags(spark):
    rows = spark.createDataFrame([("x", "a", True, 1, "p"), ("x", "a", False, 2, "q"), ("x", "b", True, 1, "r"), ("y", "a", True, 1, "s")], "instance_id string, arm string, resolved boolean, n int, prefix_flag string")
    assert [tuple(r) for r in T.factorial(rows, ["a", "b"], "n", "a").collect()] == [("x", 0, 1, "q")]


def test_paths_move_together():
    p = A.Paths("/d", "/r")
    assert (p.parsed(), p.stage("graphs"), p.moved(data="/e").parsed(), p.moved(data="/e").stage("graphs")) == ("/d/parsed", "/r/graphs", "/e/parsed", "/r/graphs")
