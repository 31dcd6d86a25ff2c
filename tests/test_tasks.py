"""Task families, metadata and annotations, goal terms, steps in plain text, quotas, merged criteria."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.functions import cues, goals
from tracewright.operators import rubrics, tasks, traces
from tracewright.plans import QUERIES


def test_action_families(spark):
    names = ["sort-incident-list", "navigate-and-create-user", "infeasible-navigate-and-sort-x", "order-standard-laptop-now", "one", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(tasks.action_family(F.col("n"))).collect()
    assert [r[0] for r in got] == ["sort", "navigate-and-create", "infeasible-navigate-and-sort", "order-standard-laptop", "one", ""]


@pytest.mark.parametrize(
    ("benchmark", "task", "meta", "want"),
    [
        ("workarena", "workarena.servicenow.sort-users-l2", {"category": "list"}, "workarena:list:sort"),
        ("workarena", "workarena.servicenow.a-b-c-d", {}, "workarena:a-b-c"),
        ("webarena", "webarena.310", {"sites": "['Shop Admin']", "eval_types": None}, "webarena:shop_admin:unknown_eval"),
        ("visualwebarena", "visualwebarena.resized.12", {}, "visualwebarena"),
        ("assistantbench", "assistantbench.improved.3", {"difficulty": "Hard", "browsergym_split": "valid"}, "assistantbench:valid:hard"),
        ("assistantbench", "assistantbench.improved.3", {}, "assistantbench"),
        ("other", "x.y.9", {}, "x.y"),
        (None, None, {}, "unknown"),
    ],
)
def test_task_families(spark, benchmark, task, meta, want):
    df = spark.range(1).select(tasks.task_family(F.lit(benchmark).cast("string"), F.lit(task).cast("string"), {k: F.lit(v) for k, v in meta.items()}))
    assert df.first()[0] == want


def test_task_metadata(spark):
    rows = [("web", 0, "web.1", "1", "A"), ("web", 1, "web.1", "1", "B"), ("vis", 0, "vis.resized.5", "5", "C"), ("vis", 1, None, "7", "D"), ("vis", 2, None, None, "E")]
    table = spark.createDataFrame(rows, "file string, at long, task_name string, task_id string, category string")
    splits = spark.createDataFrame([("web.1", "test", "web"), ("only.split", "train", "w"), ("", "x", "y")], "task_id string, split string, benchmark string")
    index = {r["name"]: r for r in tasks.task_index(table, splits).collect()}
    assert index["web.1"]["meta"]["category"] == "B" and index["web.1"]["split"] == "test"  # own names: the last row
    assert index["1"]["meta"]["category"] == "A"  # other names: the first row
    assert index["vis.5"]["meta"]["category"] == index["5"]["meta"]["category"] == "C" and index["vis.7"]["meta"]["category"] == "D"
    assert index["only.split"]["meta"] is None and "" not in index
    records = spark.createDataFrame([("r1", "web", "web.1"), ("r2", "vis", "vis.improved.5"), ("r3", "vis", "none.4"), ("r4", "vis", None)], "record_id string, benchmark string, task_id string")
    got = {r["record_id"]: r for r in tasks.with_task_metadata(records, tasks.task_index(table, splits)).collect()}
    assert len(got) == 4 and got["r1"]["split"] == "test" and got["r2"]["meta"]["category"] == "C"
    assert got["r3"]["meta"] is None and got["r3"]["task_family"] == "none" and got["r4"]["task_family"] == "vis"


def test_annotations(spark):
    said = [("b", "t", "m", "Successful", "No", None), ("b", "t", "m", "Unsuccessful", None, "Yes"), ("b", "t", "n", None, None, None)]
    notes = spark.createDataFrame(said, "benchmark string, task_id string, model_name string, trajectory_success string, trajectory_side_effect string, trajectory_looping string")
    records = spark.createDataFrame([("b", "t", "m"), ("b", "t", "n"), ("b", "u", "m")], "benchmark string, task_id string, agent string")
    got = {(r["task_id"], r["agent"]): r for r in tasks.with_annotations(records, tasks.annotation_index(notes)).collect()}
    assert (got["t", "m"]["success_vote_count"], got["t", "m"]["failure_vote_count"], got["t", "m"]["annotation_count"]) == (1, 1, 2)
    assert got["t", "m"]["trajectory_looping_votes"] == ["", "yes"]
    assert got["t", "n"]["success_vote_count"] == 0 and got["u", "m"]["annotation_count"] is None


def test_goal_terms(spark):
    texts = ['Open the "Incident list" page > Service Desk. Check priority twice, priority and desk', "", None, "the and"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(goals.goal_terms(F.col("t"))).collect()]
    assert got[0] == ["Incident list", "Service Desk. Check priority twice, priority and desk", "Open", "Incident", "Service Desk. Check", "page", "twice"]
    assert got[1] == got[2] == got[3] == []


def test_steps_of_text(spark):
    text = """Task: do it
The agent performed the following actions:
ignored
Step: 3
URL: http://a
Action: click('12')
Reasoning: first
  second
-----
Step:
Reasoning: open
URL: http://b
goes on
Action: fill('a', 'x')
after
The last accessibility tree is:
button 'Buy'

button 'Buy'"""
    df = spark.createDataFrame([("r", text), ("none", "no steps"), ("null", None)], "record_id string, text string")
    got = [r.asDict(True) for r in traces.steps_of_text(df).orderBy("pos").collect()]
    assert [(r["record_id"], r["step_index"], r["thought"], r["action"]) for r in got] == [("r", 3, "first second", "click('12')"), ("r", 1, "open goes on", "fill('a', 'x')")]
    assert got[0]["cues"] == ["url: http://a"] and got[1]["cues"] == ["url: http://b", "button 'Buy'"]
    assert got[1]["signature"]["target_text"] == "x"


def read_steps(text):
    """(number, thought, action) of each step, line by line."""
    out = []
    for line in (x.strip() for x in text.splitlines()):
        if line.startswith("Step:"):
            number = re.match(r"Step:\s*(\d+)", line)
            out.append([int(number[1]) if number else len(out), [], "", False])
        elif out and line not in ("", "-----"):
            step = out[-1]
            if line.startswith("Action:"):
                step[2], step[3] = line[7:].strip(), False
            elif line.startswith("Reasoning:"):
                step[1].append(line[10:].strip())
                step[3] = True
            elif step[3] and not line.startswith("URL:"):
                step[1].append(line)
    said = [" ".join(x for x in s[1] if x) for s in out]
    return [(s[0], t if len(t) <= 1200 else t[:1160].rstrip() + "\n...[truncated]...", s[2]) for s, t in zip(out, said, strict=True)]


def test_steps_of_all_turns_equal_a_parser_by_lines(spark):
    data = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{data}/conversations.parquet").collect()
    written = defaultdict(str)
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["turn"])):
        said = f"Reasoning: {r['text']}\n" if r["role"] == "assistant" and r["text"] is not None else ""
        written[r["conv_id"]] += f"Step: {r['turn']}\nAction: {r['role']}()\n{said}-----\n"
    want = Counter((i, *s) for i, text in written.items() for s in read_steps(text))
    got = Counter((r["conv_id"], r["turn"], r["thought"], r["action"]) for r in QUERIES["text_steps"](spark, data).collect())
    assert got == want and sum(got.values()) >= len(turns) and any("truncated" in r[2] for r in got)


def test_segmented_cues(spark):
    segments = [("head", ["a", " ", "b", "c"]), ("", ["d"]), ("tail", [])]
    df = spark.createDataFrame([(segments,), ([],)], "s array<struct<section:string,cues:array<string>>>")
    got = [r[0] for r in df.select(cues.segmented_cues(F.col("s"), 4, 50)).collect()]
    assert got == [["head: a", "head: b", "observation: d", "head: c"], []]
    assert df.limit(1).select(cues.segmented_cues(F.col("s"), 1, 50)).first()[0] == ["head: a"]


def test_merged_criteria(spark):
    item = "theme:string,dimension:string,criterion:string,description:string,tips:array<string>,verification_guide:struct<checks:array<string>,what_to_extract:array<string>>,negative_evidence:array<string>,severity:string,rationale:string,reason:string,source_pair_ids:array<string>"
    empty = dict.fromkeys(x.split(":")[0] for x in "theme dimension criterion description tips verification_guide negative_evidence severity rationale reason source_pair_ids".split())
    items = [empty | {"theme": "T", "tips": ["a", " ", "b"], "severity": "HIGH"}, empty | {"tips": ["only"]}, empty | {"description": "D", "verification_guide": {"checks": [], "what_to_extract": ["e"]}, "reason": "r"}, empty]
    merged = spark.createDataFrame([("g1", items), ("g2", [empty])], f"cluster_id string, rubrics array<struct<{item}>>")
    members = spark.createDataFrame([("p1", "g1"), ("p2", "g2"), ("p3", "g3"), (None, "g1"), ("p4", "")], "pair_id string, cluster_id string")
    found, missing = rubrics.for_members(merged, members, "cluster_id")
    row = found.collect()
    assert [r["pair_id"] for r in row] == ["p1"] and sorted(r[0] for r in missing.collect()) == ["g2", "g3"]
    a, b, c = row[0]["rubrics"]
    assert a["criterion"] == "T\nTips:\n- a\n- b" and a["positive_evidence"] == ["a", "b"] and a["severity"] == "high"
    assert b["criterion"] == "only" and b["positive_evidence"] == [] and b["severity"] == "medium"
    assert c["dimension"] == "D" and c["positive_evidence"] == ["e"] and c["rationale"] == "r"
