"""Jobs over models, with clients that answer by rule."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright import jobs


def judge(calls=None, broken=()):
    """A client that writes criteria, merges and scores, and notes its prompts in a folder."""

    class Client:
        def note(self, text):
            if calls is not None:
                (calls / f"{abs(hash(text))}-{__import__('uuid').uuid4().hex}").write_text(text)

        def complete(self, messages):
            p = messages[-1]["content"]
            self.note(p)
            if any(b in p for b in broken):
                return "no list here"
            if "Score both" in p:
                n = p.split("Criteria:\n")[1].split("\n\nresponse_0:")[0].count(". ")
                side = lambda i, s: {"response_id": f"response_{i}", "rubric_scores": [{"rubric_index": k + 1, "score": s} for k in range(max(n, 1))]}
                return json.dumps([side(0, 0.9), side(1, 0.2)])
            if "Score each" in p:
                return json.dumps([{"rubric_index": 1, "score": 0.8 if "good" in p.split("Response:\n")[1] else 0.1}])
            if "Merge these" in p:
                return json.dumps({"categories": [{"theme": "Care", "tips": ["look twice"], "source_pair_ids": ["d/a"]}], "reason": "r"})
            return json.dumps([{"dimension": "care", "criterion": f"criterion {len(p) % 5}", "severity": "high"}, {"dimension": "speed", "criterion": "is quick"}])

        def embed(self, texts):
            return [[1.0 + len(t) % 3, float(t.count("a")), 1.0] for t in texts]

    return Client


@pytest.fixture()
def made(spark):
    rows = [(f"d/{k}", "d", k, f"task {k}", ["good text", "bad text"], ["x", "y"]) for k in "abc"] + [("e/z", "e", "z", "another aaa", ["good", "bad"], ["x", "y"]), ("e/one", "e", "one", "t", ["only"], ["x"]), (None, "e", "n", "t", ["a", "b"], ["x", "y"])]
    return spark.createDataFrame(rows, "pair_id string, domain string, jobname string, query string, responses array<string>, selected_records array<string>")


def test_pairs_from_criteria_to_scores(spark, made, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()
    run = jobs.Run(spark, str(tmp_path / "run"), judge(seen, broken=["task b"]))
    found = jobs.extract_from_pairs(run, made)
    rows = {r["pair_id"]: r for r in found.collect()}
    assert set(rows) == {"d/a", "d/b", "d/c", "e/z"} and len(list(seen.iterdir())) == 4
    assert rows["d/b"]["error"] and rows["d/b"]["rubrics"] == [] and [r["severity"] for r in rows["d/a"]["rubrics"]] == ["high", "medium"]
    assert jobs.extract_from_pairs(run, made).count() == 4 and len(list(seen.iterdir())) == 4  # kept answers are not asked for again
    scored, summary = jobs.evaluate_pairs(run, found, made)
    assert {r["pair_id"]: (r["pair_correct"], round(r["score_margin"], 4)) for r in scored.collect()} == {p: (True, 1.4) for p in ("d/a", "d/c", "e/z")}
    assert summary.select("records", "completed", "errors", "pair_accuracy").first()[:] == (3, 3, 0, 1.0)


def test_a_failed_call_is_a_row(spark, made, tmp_path):
    def down():
        class Down:
            def complete(self, messages):
                raise OSError("down")

        return Down()

    prompts = made.where("pair_id = 'd/a'").select("pair_id", F.lit("p").alias("prompt"))
    got = jobs.Run(spark, str(tmp_path), down, attempts=1).ask(prompts, "pair_id", "s").first()
    assert got["answer"] is None and got["model_error"] == "down"
    answered = jobs.Run(spark, str(tmp_path), judge()).ask(prompts, "pair_id", "s").first()  # failed calls are made again
    assert answered["model_error"] is None and "care" in answered["answer"]


def test_clusters_merge_and_adapters(spark, made, tmp_path):
    run = jobs.Run(spark, str(tmp_path), judge())
    found = jobs.extract_from_pairs(run, made)
    members, summary = jobs.cluster_pairs(run, made.where("pair_id is not null"))
    assert members.count() == 5 and summary.count() == members.select("cluster_id").distinct().count()
    for select in (True, False):
        merged = jobs.merge(run, made, found, "domain", select)
        rows = merged.collect()
        assert [(r["group_id"], r["pair_count"], r["rubric_count"], r["error"]) for r in rows] == [("d", 3, 6, None)]
        assert rows[0]["categories"][0]["theme"] == "Care"
    adapted, missing = jobs.merged_for(merged, made, "domain")
    assert {r["pair_id"] for r in adapted.collect()} == {"d/a", "d/b", "d/c"} and [r[0] for r in missing.collect()] == ["e"]
    assert adapted.first()["rubrics"][0]["criterion"] == "Care\nTips:\n- look twice"


def test_bank(spark, made, tmp_path):
    run = jobs.Run(spark, str(tmp_path), judge())
    found = jobs.extract_from_pairs(run, made)
    rows, missing = jobs.build_bank(run, found, made)
    assert rows.count() == 8 and missing.count() == 0
    out = jobs.evaluate_with_bank(run, rows, made, k=4, batch=3)
    assert out["weights"].groupBy("pair_id").agg(F.round(F.sum("applicability"), 6).alias("s")).select("s").distinct().collect() == [(1.0,)]
    scores = out["scores"].collect()
    assert len(scores) == 4 and all(r["pair_correct"] and r["judge_error"] is None for r in scores)
    assert out["summary"].first()["pair_accuracy"] == 1.0 and out["applicability"].first()["pairs"] == 4


def test_members_by_path(spark):
    records = spark.createDataFrame([("r1", "t", "success", "/x/web/m/r1.json"), ("r2", None, "", "/x/b/web/r2.json"), ("r3", "t", "failure", "/x/none/r3.json"), ("", "t", "failure", "/web/r4.json")], "record_id string, task string, outcome string, source_path string")
    domains = spark.createDataFrame([("web",), ("b",)], "domain string")
    got = sorted(tuple(r)[:4] for r in jobs.members_by_path(records, domains).collect())
    assert got == [("b", "r2", "", "unknown"), ("web", "r1", "t", "success")]


def test_groups(spark, tmp_path):
    from tracewright.operators import traces
    from tracewright.sources import readers

    folder = tmp_path / "traces"
    folder.mkdir()
    for k, good in (("r1", True), ("r2", False), ("r3", True)):
        steps = [{"num": 0, "observation": "good page" if good else "page", "action": "click('a1')"}, {"num": 1, "observation": "end", "action": "stop()"}]
        (folder / f"{k}.json").write_text(json.dumps({"id": k, "task": "buy", "outcome": "success" if good else "failure", "trace": steps}))
    records = jobs.Run(spark, str(tmp_path / "run"), judge()).keep(traces.summaries(readers.canonical(readers.read_records(spark, str(folder), "json"))).select("record_id", "task", "outcome", "action_sequence", "final_state", "cards", "errors", "repeated_action_runs", "validation", "load_error", "final_cues", "final_url"), "records")
    run = jobs.Run(spark, str(tmp_path / "run"), judge())
    members = records.select(F.lit("g").alias("cluster_id"), "record_id", "outcome")
    found = jobs.extract_from_groups(run, members, records, sample=2)
    row = found.first()
    assert row["cluster_size"] == 3 and len(row["source_record_ids"]) == 2 and len(row["rubrics"]) == 2
    assert set(jobs.evaluate_groups(None, found)) == {"audit", "flags"}
    out = jobs.evaluate_groups(run, found, records)
    assert out["scores"].count() == 2 and out["overall"].first()["judge_errors"] == 0
    assert out["groups"].first()["cluster_id"] == "g" and "too_few_rubrics" in [f["type"] for f in out["audit"].first()["flags"]]


def test_command_line(spark, made, tmp_path, monkeypatch):
    from tracewright import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda master: spark)
    made.write.parquet(str(tmp_path / "pairs"))
    pairs, out = str(tmp_path / "pairs"), str(tmp_path / "out")
    cli.main(["extract-pairs", pairs, "--out", out])
    criteria = f"{out}/rubrics"
    assert spark.read.parquet(criteria).count() == 4
    cli.main(["evaluate-pairs", pairs, "--criteria", criteria, "--out", out, "--limit", "2"])
    assert spark.read.parquet(f"{out}/summary").first()["records"] == 2
    cli.main(["cluster-pairs", pairs, "--out", out, "--thresholds", "0.3,0.5"])
    assert spark.read.parquet(f"{out}/members").count() == 5
    cli.main(["merge", pairs, "--criteria", criteria, "--out", out])
    cli.main(["merged-members", pairs, "--criteria", f"{out}/merged", "--out", f"{out}/adapted"])
    assert spark.read.parquet(f"{out}/merged").count() == 1
    cli.main(["bank-build", pairs, "--criteria", criteria, "--out", out])
    cli.main(["bank-evaluate", pairs, "--bank", f"{out}/bank", "--out", f"{out}/weighed", "--top-k", "2"])
    assert spark.read.parquet(f"{out}/weighed/applicability").first()["pairs"] == 4
