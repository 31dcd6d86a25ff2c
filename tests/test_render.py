"""Cues, rendered texts, cleaned payloads, and the jobs."""

import json

from pyspark.sql import functions as F

from tracewright.__main__ import main
from tracewright.functions import cues
from tracewright.operators import models, render, rubrics, traces
from tracewright.sources import readers


def test_cues(spark):
    text = "plain\nheading 'Prices'\nbutton 'Buy'\nAccept cookie\nbutton 'Buy'\n\nStaticText 'total 3'\nbutton 'Show help'"
    df = spark.createDataFrame([(text,), ("",), ("no  page\nat all",)], "t string")
    got = [r[0] for r in df.select(cues.best_cues(F.col("t"), 4)).collect()]
    assert got[0] == ["heading 'Prices'", "StaticText 'total 3'", "button 'Buy'"] and got[1:] == [[], ["no page at all"]]
    assert [r[0] for r in df.limit(1).select(cues.first_cues(F.col("t"), 2)).collect()] == [["plain", "heading 'Prices'"]]


def test_balanced(spark):
    df = spark.createDataFrame([(["a: 1", "a: 2", "a: 3", "b: 1", "b: 2"],)], "l array<string>")
    assert df.select(cues.balanced_cues(F.col("l"), 4)).first()[0] == ["a: 1", "a: 2", "b: 1", "b: 2"]


def test_fit_cards(spark):
    df = spark.createDataFrame([([("x" * 50,), ("y",)],), ([("a",), ("b",), ("c",)],)], "c array<struct<v:string>>")
    assert [len(r[0]) for r in df.select(cues.fit_cards(F.col("c"), 46)).collect()] == [1, 2]
    assert df.select(cues.json_size(F.struct(F.lit("a").alias("k"), F.array(F.lit(1), F.lit(2)).alias("n")))).first()[0] == len(json.dumps({"k": "a", "n": [1, 2]}))


def test_clean_payload(spark):
    raw = {"Model": "m", "agent_x": 1, "my_model_args": 2, "a": {"success_prior": 3, "b": ""}, "l": [{"model": 1}, {"k": 2}], "source_fields": ["validation", "obs", "obs.screenshot_path"]}
    assert render.clean_payload(raw) == {"l": [{"k": 2}], "source_fields": ["obs"]}
    df = render.sanitised(spark.createDataFrame([(json.dumps(raw),), ("no json",), (None,)], "p string"), "p")
    assert [r[0] for r in df.collect()] == ['{"l": [{"k": 2}], "source_fields": ["obs"]}', "no json", None]


def test_rendering_and_models(spark, tmp_path):
    trace = {"id": "r", "goal": "Go", "outcome": "success", "steps": [{"action": "click('1')", "url": "u"}]}
    path = tmp_path / "dom" / "model" / "job_model" / "job.json"
    path.parent.mkdir(parents=True)
    path.write_text(json.dumps(trace))
    summary = traces.summaries(readers.canonical(readers.read_records(spark, str(tmp_path), "tree")))
    shown, hidden = summary.select(render.response_text(), render.response_text(with_outcome=False)).first()
    assert "Outcome:\nsuccess" in shown and "success" not in hidden and "- 0: click('1')" in hidden
    prompts = summary.select("record_id", render.pair_prompt(F.col("task"), F.lit(shown), F.lit(hidden)).alias("prompt"))
    answers = rubrics.parse_rubrics(models.complete_all(prompts, models.StubClient, "record_id"))
    assert answers.select(F.size("rubrics")).first()[0] == 1
    assert len(models.embed_all(prompts, models.StubClient, "record_id", "prompt").first()["vector"]) == 16


def test_parse_job(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": "a", "steps": [{"action": "goto('u')"}]}]))
    main(["parse", str(tmp_path / "t.json"), "--out", str(tmp_path / "out"), "--master", "local[8]"])
    assert spark.read.parquet(str(tmp_path / "out")).select("record_id", "n_steps").first() == ("a", 1)


def test_failed_calls_are_errors(spark):
    calls = []

    def fails():
        calls.append(1)
        raise ValueError("no")

    try:
        models.with_retry(fails, attempts=3, sleep=lambda _: None)
    except ValueError:
        pass
    assert len(calls) == 3
