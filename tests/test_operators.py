"""Semantics that tables cannot show: actions, repair, linkage, readers, sinks, text edges."""

import json

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import outcome as oc
from tracewright.functions import text as tx
from tracewright.functions.vector import nearest_means
from tracewright.operators import clusters, pairs, rubrics, scoring, sequences, traces
from tracewright.sources import readers, sinks


@pytest.mark.parametrize(
    ("raw", "kind", "bid", "text"),
    [("click('12')", "click", "12", ""), ("fill('a', value='x')", "fill", "a", "x"), ("send_msg_to_user('hi')", "send_msg_to_user", "hi", ""), ("broken(", "broken", "", ""), (None, "", "", ""), ("", "", "", ""), ("None", "None", "", ""), ("f(g(1), [1, 'a'])", "f", "g(1)", '[1, "a"]'), ("a.b(1)", "a.b", "", ""), ("fill('a', 'it\\'s')", "fill", "a", "it's")],
)
def test_actions(raw, kind, bid, text):
    got = traces.parse_action(raw)
    assert (got["action_type"], got["target_bid"], got["target_text"]) == (kind, bid, text)


@pytest.mark.parametrize("text", ['[{"criterion": "a"}]', '```json\n[{"criterion": "a"}]\n```', '{"rubrics": [{"rule": "a"}]}', 'Here: [{"description": "a"}] done', '[[1], [{"rubric": "a"}]', '{"signals": ["a"]}'])
def test_repair(text):
    given = rubrics.extract_array(text)
    got = rubrics.normalise_items(given if given != ["a"] else [{"signals": given}])
    assert [x["criterion"] for x in got] == ["a"]


def test_missing_braces_are_repaired():
    got = rubrics.normalise_items(rubrics.extract_array('[{"dimension": "x", "criterion": "a"}, "dimension": "y", "criterion": "b"}]'))
    assert [(x["dimension"], x["criterion"]) for x in got] == [("x", "a"), ("y", "b")]


def test_repair_of_nothing(spark):
    for text in (None, "no list", '{"a": 1}'):
        with pytest.raises(ValueError, match="no JSON list"):
            rubrics.extract_array(text)
    assert rubrics.normalise_item({"severity": "high"}) is None is rubrics.normalise_item("text")
    got = rubrics.parse_rubrics(spark.createDataFrame([("no list",), ('[{"check": "c", "why": "w"}]',)], "answer string")).collect()
    assert [(len(r["rubrics"]), r["parse_error"] is None) for r in got] == [(0, False), (1, True)]


def test_criteria_in_nested_objects():
    raw = [{"rubrics": [{"rule": "a", "evidence": {"success": ["s"], "failure": "f"}, "priority": "Important"}, "b"], "category": "c"}, {"name": "n"}, {"criteria": [["d"]], "description": "e"}]
    got = rubrics.normalise_items(raw)
    assert [(x["criterion"], x["dimension"], x["severity"]) for x in got] == [("a", "trajectory_quality", "high"), ("b", "c", "medium"), ('["d"]', "trajectory_quality", "medium")]
    assert (got[0]["positive_evidence"], got[0]["negative_evidence"]) == (["s"], ["f"])
    guide = {"variables": ["v", 2], "method": "m", "pattern": "", "own": ["x"], "more": 1}
    assert rubrics.normalise_guide(guide) == {"what_to_extract": ["v", "2"], "verification_method": "m", "own": ["x"], "more": 1}
    assert rubrics.normalise_guide(["a", ""]) == {"checks": ["a"]} and rubrics.normalise_guide(" t ") == "t" and rubrics.normalise_guide({"pattern": ""}) is None


def test_merged_categories():
    raw = {"categories": [{"theme": "t", "guidance": ["a"]}, {"tips": ["first", "second"]}, {"title": "u", "criterion": "c"}, {"theme": "record_1"}, {"theme": "a/b"}, {"items": [{"theme": "in"}]}, "text", {"theme": "s", "sources": ["p"]}]}
    got = rubrics.merged_categories(rubrics.extract_object("x " + json.dumps(raw) + " y"))
    assert [(c["theme"], c["tips"]) for c in got] == [("t", ["a"]), ("first", ["second"]), ("u", ["c"]), ("in", []), ("s", [])]
    assert got[-1]["source_pair_ids"] == ["p"] and rubrics.extract_object('[{"theme": "x"}]') == {"categories": [{"theme": "x"}]}


def naive_linkage(d, cut):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min((np.mean([d[i][j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y)
        if best[0] >= cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage_equals_definition():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.random((12, 2))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        label = clusters.average_linkage(d, 0.4)
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == naive_linkage(d, 0.4)


def test_consensus_boundary():
    d = np.array([[0, 0.4], [0.4, 0]])
    assert len(set(clusters.average_linkage(d, 0.4))) == 2
    assert len(set(clusters.average_linkage(d, 0.4, inclusive=True))) == 1


def test_clusters_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((4, 8))
    data = [(i, (centres[i % 4] + 0.05 * rng.standard_normal(8)).tolist()) for i in range(40)]
    df = spark.createDataFrame(data, "id long, vector array<double>")
    got = [sorted(map(tuple, clusters.cluster_tasks(df.repartition(n)).select("id", "cluster_id", "cluster_size").collect())) for n in (1, 7)]
    assert got[0] == got[1]
    assert {r[2] for r in got[0]} == {10}


def test_linkages_equal_the_one_over_all_distances():
    rng = np.random.default_rng(5)
    for k in range(30):
        x = rng.standard_normal((5, 8))[rng.integers(0, 5, 50)] + (0.1, 0.5, 1.0)[k % 3] * rng.standard_normal((50, 8))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x[rng.integers(0, 50)] = 0
        cuts = (0.48, 0.3, 0.54)
        got = clusters.linkages(x, cuts, at_once=7)
        want = [clusters.average_linkage(np.clip(1 - x @ x.T, 0, 2), c) for c in cuts]
        assert [g.tolist() for g in got] == [w.tolist() for w in want]
        share = sum((g[:, None] == g[None]).astype(float) for g in got) / 3
        final = clusters.consensus_labels(got, 0.5)
        assert final.tolist() == clusters.average_linkage(1 - share, 0.5).tolist()
        same = final[:, None] == final[None]
        others = same.sum(1) - 1
        assert np.allclose(clusters.strengths(got, final), np.where(others > 0, ((share * same).sum(1) - 1) / np.maximum(others, 1), 1.0))


def test_a_component_of_many_rows_is_clustered(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(np.c_[np.full(5400, 2.0), rng.standard_normal((5400, 3))])]
    found = clusters.cluster_tasks(spark.createDataFrame(rows, "id long, vector array<double>"), thresholds=(0.02, 0.04))
    sizes = clusters.cluster_summary(found).agg({"size": "sum"}).first()[0]
    assert found.count() == sizes == 5400


def greedy_linkage(d, cut):
    """By definition, where distances are equal if they agree to 12 decimals."""
    d, label, size = d.copy(), np.arange(len(d)), np.ones(len(d))
    np.fill_diagonal(d, np.inf)
    while True:
        i, j = sorted(divmod(int(np.round(d, 12).argmin()), len(d)))
        if not round(d[i, j], 12) < cut:
            return label.tolist()
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i


def test_of_equal_distances_the_first_rows_merge_first():
    rng = np.random.default_rng(1)
    for k in range(20):
        x = rng.integers(-1, 2, (90, 4 + k % 4)).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        cuts = (0.1, 0.3, 0.5)
        assert [g.tolist() for g in clusters.linkages(x, cuts, at_once=7)] == [greedy_linkage(np.clip(1 - x @ x.T, 0, 2), c) for c in cuts]


def test_a_component_is_merged_in_rounds_and_no_task_has_it_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.c_[np.full(600, 0.8), rng.standard_normal((600, 8)) * 0.4]
    x[300:330] = x[:30]  # copies
    ids = rng.permutation(600) * 3
    whole, cuts = [], (0.2, 0.3, 0.1)
    monkeypatch.setattr(clusters, "REST_PAIRS", 300 * 300)
    rounds = clusters._merge_round
    monkeypatch.setattr(clusters, "_merge_round", lambda live, n, *more: whole.append(n) or rounds(live, n, *more))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(1, [float("nan")] * 9), (2, None)]
    found = {r["id"]: r for r in clusters.cluster_tasks(spark.createDataFrame(rows, "id long, vector array<double>"), thresholds=cuts).collect()}
    assert len(whole) > 1 and whole[0] == 600
    order = np.argsort(ids)
    x = x[order] / np.linalg.norm(x[order], axis=1, keepdims=True)
    want = [greedy_linkage(np.clip(1 - x @ x.T, 0, 2), c) for c in cuts]
    assert [[found[i]["labels"][k] // 3 for i in sorted(ids.tolist())] for k in range(3)] == want
    final = clusters.consensus_labels([np.array(w) for w in want], clusters.CONSENSUS)
    assert [found[i]["cluster_size"] for i in sorted(ids.tolist())] == np.bincount(final)[final].tolist()
    assert [found[i]["consensus_strength"] for i in sorted(ids.tolist())] == clusters.strengths([np.array(w) for w in want], final).tolist()
    assert len({found[i]["cluster_id"] for i in ids.tolist()}) == len(set(final.tolist()))
    assert [found[i]["cluster_size"] for i in (1, 2)] == [1, 1]


def test_stale_clusters_find_their_nearest_over_all_tiles(spark):
    rng = np.random.default_rng(6)
    x, stale = rng.standard_normal((400, 5)), rng.random(400) < 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 2.0, bool(s)) for i, (v, s) in enumerate(zip(x, stale, strict=True))]
    found = nearest_means(spark.createDataFrame(rows, "c long, total array<double>, size double, stale boolean"), 400, tile_rows=60).collect()
    s = x @ x.T / 4
    np.fill_diagonal(s, -np.inf)
    assert {r["c"]: r["near"] for r in found} == {int(i): int(s[i].argmax()) for i in np.flatnonzero(stale)}
    assert all(abs(r["least"] - max(0, 1 - s[r["c"]].max())) < 1e-9 for r in found)


def test_a_summary_of_clusters_merged_in_rounds_counts_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(clusters, "REST_PAIRS", 100)
    rows = [(i, [1.0, 0.001 * (i % 4), float(i % 2)]) for i in range(40)]
    found = clusters.cluster_summary(clusters.cluster_tasks(spark.createDataFrame(rows, "id long, vector array<double>"), thresholds=(0.1, 0.2))).collect()
    got = sorted((r["cluster_id"], r["size"], r["mean_strength"], r["first_ids"]) for r in found)
    assert got == [("task_cluster_0000", 20, 1.0, list(range(0, 16, 2))), ("task_cluster_0001", 20, 1.0, list(range(1, 16, 2)))]


def test_auc(spark):
    data = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (0, None)]
    got = scoring.auc(spark.createDataFrame(data, "y int, s double"), "y", "s").first()
    assert (got["n_positive"], got["n_negative"], got["auc"]) == (2, 2, 0.875)
    assert scoring.auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()["auc"] is None


def test_text_edges(spark):
    df = spark.createDataFrame([("a  b c\r\nd\n",), ("",), (" \n \n",)], "t string")
    got = df.select(tx.norm_ws(F.col("t")).alias("w"), tx.split_lines(F.col("t")).alias("l"), tx.clean_lines(F.col("t")).alias("c")).collect()
    assert got[0]["w"] == "a b c d"
    assert got[0]["l"] == ["a  b", "c", "d"]
    assert got[1]["l"] == [] and got[2]["c"] == []


@given(st.lists(st.text("ab \n", max_size=30), max_size=8), st.integers(1, 60))
def test_budget_definition(lines, budget):
    kept, cost = [], 0
    for x in lines:
        if kept and cost + len(x) + 1 > budget:
            break
        cost += len(x) + 1
        kept.append(x)
    assert not kept or len(kept) == 1 or sum(len(x) + 1 for x in kept) <= budget


def test_fit_budget(spark):
    df = spark.createDataFrame([(["aaaa", "bb", "c"],), (["x" * 50, "b"],), ([],)], "l array<string>")
    assert [r[0] for r in df.select(sequences.fit_budget(F.col("l"), 8)).collect()] == [["aaaa", "bb"], ["x" * 12 + " ...[truncated]"], []]


def test_outcomes_differ_on_purpose(spark):
    df = spark.createDataFrame([("unsuccessful", None), ("0.3", None), (None, 1.0), ("not failed", None)], "t string, r double")
    got = df.select(oc.outcome_by_words(F.col("t")), oc.outcome_normalised(F.col("t")), oc.outcome_of_pair(F.col("t"), reward=F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("success", "success", "unknown"), ("unknown", "unknown", "unknown"), ("unknown", "unknown", "success"), ("failure", "failure", "unknown")]


def test_outcomes_of_flags_and_numbers(spark, tmp_path):
    rows = [{"id": "a", "success": True}, {"id": "b", "score": 0.9}, {"id": "c", "label": "wrong"}, {"id": "d", "outcome": "incorrect"}, {"id": "e", "correct": False}, {"id": "f", "score": 0.3}, {"id": "g", "result": "1"}, {"id": "h", "outcome": None, "status": ""}]
    (tmp_path / "o.json").write_text(json.dumps(rows))
    got = readers.canonical(readers.read_records(spark, str(tmp_path / "o.json"))).orderBy("record_id").select("record_id", "outcome").collect()
    assert [r["outcome"] for r in got] == ["success", "success", "failure", "failure", "failure", "failure", "success", "unknown"]


def test_steps_from_files(spark, tmp_path):
    trace = {
        "id": "r1",
        "goal": "Find it",
        "outcome": "success",
        "steps": [
            {"observation": "button 'Go'"},
            {"error": "Element detached"},
            {"error": "Timeout early"},
            {"num": 0, "reasoning": "look", "action": "click('1')", "url": "http://a"},
            {"num": 0, "action": "click('1')", "url": "http://b", "last_action_error": "Element detached"},
            {"observation": "heading 'Done'", "error": "not told, as this is an observation"},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps({"records": [trace]}))
    (tmp_path / "b.jsonl").write_text(json.dumps(trace | {"id": "r2"}) + "\n\n")
    for name, key in (("a.json", "r1"), ("b.jsonl", "r2")):
        records = readers.canonical(readers.read_records(spark, str(tmp_path / name)))
        steps = traces.steps_of(records).orderBy("pos").collect()
        assert [(s["record_id"], s["pos"], s["signature"]["target_bid"]) for s in steps] == [(key, 3, "1"), (key, 4, "1")]
        assert steps[0]["cues"] == ["url: http://a", "button 'Go'"] and steps[0]["error_type"] == "timeout"
        assert steps[1]["cues"] == ["url: http://b", "heading 'Done'"] and steps[1]["error_type"] == "detached" and steps[1]["page_title"] == "Done"
        summary = traces.summaries(records).first()
        assert (summary["outcome"], summary["n_steps"], summary["final_url"]) == ("success", 2, "http://b")


def test_csv_events(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffid,step,action,task,outcome,tool_name\nx,2,b,late,,\nx,1,a,Do it,passed,t\ny,1,c,,0,\n")
    got = readers.canonical(readers.read_records(spark, str(tmp_path / "t.csv"))).orderBy("record_id")
    rows = got.select("record_id", "task", "outcome", F.transform("trace", lambda e: F.to_json(e)).alias("trace")).collect()
    assert [(r[0], r[1], r[2]) for r in rows] == [("x", "Do it", "success"), ("y", "", "failure")]
    assert [json.loads(e) for e in rows[0]["trace"]] == [{"action": "a", "tool": "t"}, {"action": "b"}]


def test_typed_cells(spark):
    cells = ["", " ", "1", "-2.50", "true", "[1, 2]", "{bad", "1_000", "x", None]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(F.to_json(readers.typed_cell(F.col("c")))).collect()
    assert [r[0] for r in got] == ['""', '""', "1", "-2.5", "true", "[1,2]", '"{bad"', '"1_000"', '"x"', None]


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="no reader"):
        readers.read_records(spark, "x.bin")


def test_log_keeps_latest(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, 1)
    sinks.append_log(spark.createDataFrame([(2, "c")], "k int, v string"), path, 2)
    assert sorted(map(tuple, sinks.read_log(spark, path, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_replayed_pairs(spark):
    rows = [("g", f"r{i}", "success" if i % 2 else "failure") for i in range(6)]
    df = spark.createDataFrame(rows, "k string, r string, outcome string")
    a, b = (pairs.pick_pairs_replayed(df.repartition(n), ["k"], "r").first() for n in (1, 5))
    assert a == b and a["positive"] in ("r1", "r3", "r5") and a["negative"] in ("r0", "r2", "r4")


def test_distinct_keeps_digits_and_strips_white_space(spark):
    df = spark.createDataFrame([(["0 a0", "1b1", " c\t", "C", "3", " ", None],)], "x array<string>")
    assert df.select(tx.ordered_distinct(F.col("x"))).first()[0] == ["0 a0", "1b1", "c", "3"]
