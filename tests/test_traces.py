"""Benchmark trees, chats, cards, features, provenance, judges' answers and the bank on hand-written fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import bank, features, judging, render, rubrics, traces
from tracewright.sources import benchmark, readers, sinks

RUN = {
    "benchmark": "webarena", "agent": "ag", "model": "m", "experiment": "exp", "goal": "Find the price of Red Shoes", "summary_info": {"cum_reward": 0, "err_msg": ""},
    "steps": [
        {"num": 0, "reasoning": "r", "action": "click('1')", "url": "u", "screenshot_path": "0.png", "axtree_pruned": "heading 'Shop'\nbutton 'price 3'\nimage 'logo'"},
        {"num": 1, "action": "click('1')", "url": "u2", "last_action_error": "Timeout", "screenshot_path": "1.png", "axtree": "heading 'B'\nStaticText 'Red Shoes'"},
        {"num": 2, "action": "send_message('3')", "url": "u2", "axtree": None},
        "odd",
    ],
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    at = root / "cleaned" / "webarena" / "ag" / "exp"
    at.mkdir(parents=True)
    (at / "t.1.json").write_text(json.dumps(RUN))
    (at / "bad.json").write_text("{")
    (at / "none.json").write_text(json.dumps({"goal": "x"}))
    return str(root)


def test_benchmark_tree(spark, tree):
    rows = [("webarena", "t.1", "ag", "Successful", "", ""), ("webarena", "t.1", "ag", "unsuccessful", "", ""), ("webarena", "t.1", "other", "unsuccessful", "", "")]
    votes = spark.createDataFrame(rows, "benchmark string, task_id string, model_name string, trajectory_success string, trajectory_side_effect string, trajectory_looping string")
    read = lambda policy: benchmark.read_benchmark(spark, tree, votes, options=readers.Options(observation_policy=policy, observation_chars=400))
    got = {r["record_id"]: r for r in read("all").select("record_id", "outcome", "task", "load_error", F.transform("trace", lambda e: F.to_json(e)).alias("trace")).collect()}
    assert set(got) == {"webarena/ag/exp/t.1", "webarena/ag/exp/bad"}
    run, bad = got["webarena/ag/exp/t.1"], got["webarena/ag/exp/bad"]
    assert (run["outcome"], bad["outcome"], bad["load_error"] is None) == ("success", "unknown", False)
    assert [json.loads(e)["index"] for e in run["trace"]] == ["0", "0.obs", "1", "1.obs", "1.error", "2", "3"]
    kept = read("last_and_errors").where("load_error is null").select(F.transform("trace", lambda e: F.to_json(e)).alias("t")).first()["t"]
    assert [json.loads(e)["index"] for e in kept] == ["0", "1", "1.obs", "1.error", "2", "3"]


def test_summary_of_a_run(spark, tree):
    records = benchmark.read_benchmark(spark, tree, options=readers.Options(observation_policy="all", observation_chars=400)).where("load_error is null")
    got = sinks.with_provenance(traces.summaries(records), F.lit("rel.json")).first()
    assert (got["outcome"], got["n_steps"], "Red Shoes" in got["goal_terms"]) == ("failure", 6, True)  # observations and errors of this form are steps too
    ids = [c["state_id"] for c in got["cards"]]
    assert ids[:2] == ["task_context", "initial_observation"] and ids[-3:] == ["output_or_answer", "media_references", "risk_signals"] and "final_observation" in ids
    by = {c["state_id"]: c for c in got["cards"]}
    assert by["output_or_answer"]["evidence_lines"] == ["action: send_message('3')"] and by["media_references"]["screenshot_paths"] == ["0.png", "1.png"]
    assert by["risk_signals"]["evidence_lines"][0] == "step 1 error: Timeout" and by["task_context"]["success_prior"]["outcome"] == "failure"
    assert any("Red Shoes" in c["matched_goal_terms"] for c in got["cards"] if c["card_type"] == "action_transition")
    assert (got["validation"]["reward"], got["validation"]["has_error"]) == (0.0, False) and len(got["cards"]) <= 14
    assert got["relative_source_path"] == "rel.json" and got["audit"]["source_metadata"]["relative_source_path"].endswith("t.1.json")


def test_null_values_and_repeats(spark, tmp_path):
    steps = [{"action": "a()", "last_action_error": None}, {"action": "a()", "last_action_error": ""}, {"thought": "t"}, {"action": "a()"}, {"url": ""}, {"error": "late"}, {"num": 9, "action": "b()"}, {"observation": None}]
    (tmp_path / "n.json").write_text(json.dumps([{"id": "x", "steps": steps}, {"id": "y", "trace": "[]"}]))
    records = readers.canonical(readers.read_records(spark, str(tmp_path / "n.json")))
    got = traces.steps_of(records).orderBy("pos").collect()
    assert [(s["step_index"], s["error"], s["error_type"]) for s in got] == [(0, "None", "unknown"), (1, "", ""), (2, "", ""), (3, "", ""), (9, "late", "unknown")]
    assert got[-1]["cues"] == ["None"]
    runs = spark.createDataFrame([([("a()", 0), ("a()", 1), ("", 2), ("a()", 3), ("b()", 4)],)], "s array<struct<raw:string,step_index:bigint>>")
    shaped = F.transform("s", lambda s: F.struct(F.struct(s["raw"].alias("raw")).alias("signature"), s["step_index"].alias("step_index")))
    assert [tuple(r) for r in runs.select(traces.repeated_runs(shaped)).first()[0]] == [("a()", 0, 3, 3)]


def test_chat_steps(spark):
    chat = {"regular": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "a thought"}], "pruned": [{"role": "assistant", "content": "Step: 4\nAction: click('7')\nReasoning: why\nThe last accessibility tree is:\nheading 'End'\nbutton 'x'"}, {"role": "assistant", "content": [{"text": "part"}]}]}
    rows = spark.createDataFrame([("r", json.dumps(chat))], "record_id string, c string").select("record_id", F.parse_json("c").alias("chat_messages"))
    got = traces.steps_of_chat(rows).orderBy("pos").collect()
    assert [(s["step_index"], s["thought"], s["action"], s["page_title"], s["focused"]) for s in got] == [(1, "a thought", "", "", ""), (4, "why", "click('7')", "End", "7")]
    assert rows.select(traces.chat_text(F.col("chat_messages"))).first()[0].endswith("\n\npart")
    response = spark.createDataFrame([('{"choices": [{"message": {"content": "c"}}]}',), ('{"chat_messages": [1]}',), ('"x"',)], "j string").select(F.to_json(benchmark.response_messages(F.parse_json("j"))))
    assert [json.loads(r[0]) for r in response.collect()] == [[{"role": "assistant", "content": "c"}], [1], "x"]


def test_features(spark):
    events = [{"tool": {"name": "t"}, "x": 1}, {"observation": "o"}, {"action": "a"}, {"content": "Traceback"}, {"state": "s"}]
    rows = spark.createDataFrame([("r", json.dumps(events))], "record_id string, j string").select("record_id", F.try_variant_get(F.parse_json("j"), "$", "array<variant>").alias("trace"))
    got = features.trace_features(features.trace_events(rows)).first()
    assert got["strategy_signature"] == "ToolCall -> Obs -> Action -> ErrorRecovery -> StateChange" and got["tool_names"] == ["t"] and got["num_events"] == 5
    assert features.flat_lines({"z": 1, "action": "a", "n": {"m": [True, None, "x"]}}) == ["action: a", "z: 1", "m: True", "m: x"]
    line = [("r", 0, "0", "", "go()", "u", "", ["c"]), ("r", 1, "0.obs", "", "", "", "", ["c", "d"]), ("r", 2, "1.obs", "", "", "", "", ["e"]), ("r", 3, "1", "t", "", "", "", [])]
    made = features.timeline(spark.createDataFrame(line, "record_id string, pos int, index string, thought string, action string, url string, error string, cues array<string>"))
    items = made.first()["items"]
    assert [(x["step"], x["cues"]) for x in items] == [("0", ["c", "d"]), ("1", ["e"])]
    assert made.select(features.final_state(F.col("items"))).first()[0] == "e"


def test_judges_answers(spark):
    rows = [
        (1, '[{"id": "b_1", "scores": [{"score": 2}, {"rubric_index": "3.0", "score": "0.5"}]}, {"response_id": "r0", "total_score": "7"}, 3]'),
        (2, '[{"rubric_scores": [{"score": "satisfied"}]}, {"rubric_scores": []}]'), (3, "no list"), (4, '[{"response_id": "x0", "total_score": 1}]'),
    ]
    got = judging.answer_items(spark.createDataFrame(rows, "k int, answer string")).select("k", "parse_error", judging.response_scores(F.col("items")).alias("s"), judging.pair_result(judging.response_scores(F.col("items"), words=True)).alias("p")).orderBy("k").collect()
    assert [(x["response_index"], x["total_score"]) for x in got[0]["s"]] == [(0, 7.0), (1, 1.5)] and [x["rubric_index"] for x in got[0]["s"][1]["rubric_scores"]] == [1, 3]
    assert (got[0]["p"]["score_margin"], got[0]["p"]["predicted"]) == (5.5, 0)
    assert got[1]["s"][0]["total_score"] == 0.0 and got[1]["p"]["positive_score"] == 1.0 and got[1]["p"]["pair_correct"]
    assert got[2]["parse_error"] and got[3]["p"]["pair_correct"] is None
    given = spark.createDataFrame([('[{"score": 1}, null, {"rating": "partial"}]',)], "answer string")
    rub = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("severity")) for d, v in (("a", "high"), ("b", "odd"), ("c", "low"))])
    aligned = judging.answer_items(given).select(judging.aligned_scores(F.col("items"), rub).alias("a")).select("a", judging.weighted_score(F.col("a")).alias("w")).first()
    assert [x["score"] for x in aligned["a"]] == [1.0, 0.0, 0.5] and aligned["w"] == round((1.0 + 0.15) / 1.9, 4)
    assert judging.parse_ids(" a, ,b") == ["a", "b"] and judging.parse_thresholds("0.5, 0.3,0.5") == [0.3, 0.5]
    with pytest.raises(ValueError, match="thresholds"):
        judging.parse_thresholds("3")


def test_selections(spark):
    pairs = spark.createDataFrame([("b", ["x", "y"], ["r", "s"], "t"), ("a", ["x", "y"], None, "t"), ("c", ["x"], ["r", "s"], " "), ("d", None, ["r", "s"], "t")], "pair_id string, responses array<string>, selected_records array<string>, task_text string").withColumn("validation", F.lit(None).cast("string"))
    assert [r["pair_id"] for r in judging.pairs_to_prompt(pairs).collect()] == ["b"]
    assert [r["pair_id"] for r in judging.pairs_to_weigh(pairs, limit=2).collect()] == ["a", "b"]
    made = spark.createDataFrame([("a", ["k"]), ("z", ["k"]), ("b", [])], "pair_id string, rubrics array<string>")
    assert [r["pair_id"] for r in judging.jobs_of_pairs(made, pairs).collect()] == ["a"]
    members = judging.members_of(spark.createDataFrame([("c", ["2", "9", "1"])], "cluster_id string, source_record_ids array<string>"), spark.createDataFrame([("1", "x"), ("2", "y")], "record_id string, outcome string"))
    assert [(r["record_id"], r["at"]) for r in members.orderBy("at").collect()] == [("2", 0), ("1", 2)]


def test_bank_ids_and_cache(spark):
    rubrics_of = spark.createDataFrame([("d/p q", "d", "j", "task", [("", " c ", [" e ", ""], [], "Important", "", '{"checks": ["x"]}')])], f"pair_id string, domain string, jobname string, query string, rubrics array<struct<{rubrics._ddl(rubrics.ITEM)}>>")
    made, missing = bank.build(rubrics_of, spark.createDataFrame([("d/p q", [1.0])], "pair_id string, vector array<double>"))
    row = made.first()
    assert row["rubric_id"].startswith("pairbank:d_p_q:000:") and len(row["rubric_id"].rsplit(":", 1)[1]) == 12 and missing.count() == 0
    assert (row["rubric"]["dimension"], row["rubric"]["criterion"], row["rubric"]["severity"], row["rubric"]["positive_evidence"]) == ("trajectory_quality", "c", "high", ["e"])
    tasks = spark.createDataFrame([("a", "t"), ("b", "new"), ("c", "")], "pair_id string, task_text string")
    cache = spark.createDataFrame([("a", "t", [1.0]), ("b", "old", [1.0])], "pair_id string, task_text string, vector array<double>")
    assert bank.to_embed(tasks, cache).count() == 0 and [r["pair_id"] for r in bank.to_embed(tasks, cache, same_text=True).collect()] == ["b"]


def test_group_text_and_prompts(spark):
    item = ("dim", "crit", ["p1", "p2", "p3", "p4"], [], "high", "", '{"checks": ["k"]}')
    rows = spark.createDataFrame([("g", "b", "q2", [item]), ("g", "a", "q1", [item, item])], f"group_id string, pair_id string, query string, rubrics array<struct<{rubrics._ddl(rubrics.ITEM)}>>")
    text = rubrics.group_text(rows, most=2).first()["text"]
    assert text.startswith("pair_id: a\nquery: q1\nrubrics:\n- dimension=dim | criterion=crit | positive_patterns=p1; p2; p3 | checks=k\n") and text.endswith("...[truncated: rendered 2 of 3 rubrics]...")
    asked = rows.select(render.messages(render.merge_prompt(F.lit(text))).alias("m")).first()["m"]
    assert [x["role"] for x in asked] == ["system", "user"] and text in asked[1]["content"]


def test_observation_segments_equal_definition(spark):
    from tracewright.operators import sequences

    lines = [f"line {i} " + ("token " * (i % 4)) + "x" * (i * 7 % 60) for i in range(40)]
    got = spark.createDataFrame([("\n".join(lines),), ("",), ("one",)], "t string").select(sequences.observation_segments(F.col("t"), F.array(F.lit("token")), 600).alias("s")).collect()

    def fit(rows, budget):
        kept, used = [], 0
        for i, x in rows:
            if kept and used + len(x) + 1 > budget:
                break
            kept.append((i, x))
            used += len(x) + 1
            if used >= budget:
                break
        return kept

    flat = [(i, " ".join(x.split())) for i, x in enumerate(lines)]
    head, tail = fit(flat, int(520 * 0.26)), fit(flat[::-1], int(520 * 0.34))[::-1]
    used = {i for i, _ in head + tail}
    score = lambda x: 3 * ("token" in x) + sum(w in x for w in sequences.MARKS)
    ranked = sorted(((-score(x), i, x) for i, x in flat if i not in used and score(x)), key=lambda r: r[:2])
    middle = sorted(fit([(i, x) for _, i, x in ranked], 520 - int(520 * 0.26) - int(520 * 0.34)))
    assert [(s["section"], s["line_indices"]) for s in got[0]["s"]] == [("head", [i for i, _ in head]), ("task_relevant", [i for i, _ in middle]), ("tail", [i for i, _ in tail])]
    assert [s["cues"] for s in got[2]["s"]] == [["one"], ["one"]]
    told = sequences.render_segments([{"section": "head", "cues": ["a" * 50, "b" * 80]}, {"section": "tail", "cues": ["c"]}], 120)
    assert told == "[head]\n" + "a" * 50 + "\n" + "b" * 44 + " ...[truncated]" and sequences.render_segments([], 10) == ""


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d", "m", None), ("b", "d", "m", "bad")], "record_id string, domain string, model_name string, load_error string")
    sinks.write_parsed(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "records")).count() == spark.read.parquet(str(tmp_path / "p" / "errors")).count() == 1
    log = sinks.configure_logging(str(tmp_path / "log.jsonl"))
    log.info("hello", extra={"fields": {"n": 1}})
    assert json.loads((tmp_path / "log.jsonl").read_text())["n"] == 1
    assert sinks.preview(rows, 1, 40).endswith("...[truncated]") and sinks.with_schema(rows, rows.select("record_id").schema).columns == ["record_id"]
