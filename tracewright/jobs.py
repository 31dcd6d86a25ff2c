"""Jobs that call models: criteria of pairs and groups, their merging and judging, and the bank.

Each takes and returns tables. A model is asked once a row: answers are written to the run's folder
and read back, and a later run asks only for what has no answer there. A failed call, or an
answer that cannot be read, is a row with an error and never ends a job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import outcome as oc
from .operators import bank, clusters, judging, models, pairs, render, rubrics
from .sources import sinks


@dataclass
class Run:
    """Where a job keeps answers and vectors, and who gives them."""

    spark: SparkSession
    path: str
    client: Callable[[], models.ModelClient]
    attempts: int = 5

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows written to a table of their own and read back, as a job's results are used more than once."""
        path = f"{self.path}/tables/{name}-{time.time_ns()}"
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def known(self, name: str, key: str) -> DataFrame | None:
        """The latest rows kept under a name, none before the first run."""
        try:
            return sinks.read_log(self.spark, f"{self.path}/{name}", [key])
        except AnalysisException:
            return None

    def ask(self, prompts: DataFrame, key: str, stage: str) -> DataFrame:
        """(key, prompt, answer, model_error) of (key, prompt); those answered in an earlier run with the same prompt are not asked again."""
        name = f"answers/{stage}"
        asked = prompts.select(key, "prompt")
        known = self.known(name, key)
        todo = asked if known is None else pairs.pending(asked, known.where("model_error is null"), [key, "prompt"])
        answers = models.complete_all(todo, self.client, key, attempts=self.attempts).join(todo, key)
        sinks.append_log(answers.select(key, "prompt", "answer", "model_error"), f"{self.path}/{name}", time.time_ns())
        return asked.join(self.known(name, key).drop("prompt"), key)

    def embed(self, texts: DataFrame, key: str, stage: str, wrap: Callable[[Column], Column] | None = None) -> DataFrame:
        """(key, text, vector) of (key, text); a kept vector counts only for an equal text."""
        name = f"vectors/{stage}"
        known = self.known(name, key)
        rows = texts.select(key, "text").where((F.coalesce(key, F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
        todo = rows if known is None else pairs.pending(rows, known, [key, "text"])
        told = todo.withColumn("__input", wrap(F.col("text")) if wrap else F.col("text"))
        made = models.embed_all(told, self.client, key, "__input").join(todo, key)
        sinks.append_log(made.select(key, "text", "vector"), f"{self.path}/{name}", time.time_ns())
        return rows.join(self.known(name, key).drop("text"), key)


def _error() -> Column:
    return F.coalesce("model_error", "parse_error").alias("error")


def _pair_fields(rows: DataFrame) -> DataFrame:
    """Pairs with a validation, null where the table has none."""
    return rows if "validation" in rows.columns else rows.withColumn("validation", F.lit(None).cast("string"))


def _lines(criteria: Column) -> Column:
    return F.transform(criteria, rubrics.rubric_line)


def extract_from_pairs(run: Run, made: DataFrame, ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """pair_id, domain, jobname, query, rubrics, error: criteria that tell the two responses of each pair apart."""
    chosen = judging.pairs_to_prompt(_pair_fields(made), ids, limit)
    prompts = chosen.select("pair_id", render.pair_prompt(F.col("query"), F.get("responses", F.lit(0)), F.get("responses", F.lit(1))).alias("prompt"))
    told = rubrics.parse_rubrics(run.ask(prompts, "pair_id", "extract_pairs")).select("pair_id", "rubrics", _error())
    return run.keep(chosen.select("pair_id", "domain", "jobname", "query").join(told, "pair_id"), "pair_rubrics")


def evaluate_pairs(run: Run, criteria: DataFrame, made: DataFrame, ids: Sequence[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of each pair by its criteria (pair_id, scores, fields of judging.pair_result, judge_error), and their summary."""
    jobs = judging.jobs_of_pairs(criteria.select("pair_id", "rubrics"), made, ids, limit)
    prompts = jobs.select("pair_id", render.pair_judge_prompt(_lines(F.col("rubrics")), F.col("query"), F.get("responses", F.lit(0)), F.get("responses", F.lit(1))).alias("prompt"))
    told = judging.answer_items(run.ask(prompts, "pair_id", "evaluate_pairs")).withColumn("scores", judging.response_scores(F.col("items")))
    told = run.keep(told.select("pair_id", "scores", _error().alias("judge_error")), "pair_answers")
    rows = told.withColumn("p", judging.pair_result(F.col("scores"))).select("pair_id", "scores", "p.*", "judge_error")
    return rows, judging.pair_summary(rows)


def cluster_pairs(run: Run, made: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Pairs with the cluster of their task (pair_id, domain, jobname, task_instruction, cluster_id, cluster_size, consensus_strength), and the clusters.

    Clusters of a size are numbered by hashes of their pairs' ids.
    """
    tasks = made.select("pair_id", "domain", "jobname", bank.task_text(made).alias("text")).dropDuplicates(["pair_id"])
    vectors = run.embed(tasks, "pair_id", "tasks", render.embedding_input).withColumn("id", F.xxhash64("pair_id"))
    found = clusters.cluster_tasks(vectors.select("id", "vector"), **options)
    members = found.join(vectors.select("id", "pair_id"), "id").join(tasks.withColumnRenamed("text", "task_instruction"), "pair_id")
    members = run.keep(members.select("pair_id", "domain", "jobname", "task_instruction", "cluster_id", "cluster_size", "consensus_strength", "id"), "members")
    return members.drop("id"), clusters.cluster_summary(members)


def merge(run: Run, members: DataFrame, criteria: DataFrame, by: str = "domain", select: bool = True, least: int = 2, most: int = 80, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """group_id, the fields of rubrics.merge_groups, categories, error: merged criteria of the pairs of each group.

    Groups are values of `by` among members (pair_id, by, query). select: at most `most` criteria of
    a group, by coding rate of their vectors; otherwise all go into the prompt's own bounds.
    """
    flat = rubrics.flatten(criteria.where(F.size("rubrics") > 0), "pair_id", "rubrics")
    groups = rubrics.merge_groups(members, flat, by, least, ids, limit)
    placed = members.select(F.col(by).alias("group_id"), "pair_id", "query").join(groups.select("group_id"), "group_id")
    sources = flat.join(placed.select("group_id", "pair_id"), "pair_id")
    if select:
        texts = sources.select("rubric_id", rubrics.rubric_line(F.struct(*[F.col(f.split(" ")[0]) for f in rubrics.ITEM.split(", ")])).alias("text")).dropDuplicates(["rubric_id"])
        vectors = run.embed(texts, "rubric_id", "rubrics").withColumn("id", F.xxhash64("rubric_id"))
        picked = rubrics.mcr_selection(sources.select("group_id", "rubric_id").join(vectors.select("rubric_id", "id", "vector"), "rubric_id"), "group_id", most)
        picked = picked.join(vectors.select("id", "rubric_id"), "id").select("group_id", "rubric_id", "rank_no")
    else:
        picked = sources.select("group_id", "rubric_id", F.col("at").alias("rank_no"))
    chosen = rubrics.selected_rubrics(sources, picked).join(placed, ["group_id", "pair_id"])
    prompts = rubrics.group_text(chosen).select("group_id", render.merge_prompt(F.col("text")).alias("prompt"))
    told = rubrics.parse_merged(run.ask(prompts, "group_id", f"merge_{by}")).select("group_id", "categories", _error())
    return run.keep(groups.join(told, "group_id"), f"merged_{by}")


def merged_for(merged: DataFrame, members: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Members (pair_id, by) with the criteria of their group's merged categories, and the groups without any."""
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    guide = lambda c: F.from_json(c, "checks array<string>, what_to_extract array<string>")
    item = lambda c: F.struct(
        c["theme"].alias("theme"), *[none.alias(k) for k in ("dimension", "criterion", "description")], c["tips"].alias("tips"), guide(c["verification_guide"]).alias("verification_guide"),
        nothing.alias("negative_evidence"), *[none.alias(k) for k in ("severity", "rationale", "reason")], c["source_pair_ids"].alias("source_pair_ids"),
    )
    return rubrics.for_members(merged.select(F.col("group_id").alias(by), F.transform("categories", item).alias("rubrics")), members, by)


def members_by_path(records: DataFrame, domains: DataFrame) -> DataFrame:
    """Records (record_id, task, outcome, source_path) of each known domain that is a part of their path, the first by name, as members of it.

    Columns: cluster_id (the domain), record_id, task_instruction, outcome, source_path. Records
    without an id or a known domain go. The domains are joined, not listed on the driver.
    """
    named = records.where(F.coalesce("record_id", F.lit("")) != "")
    parts = named.select("source_path").distinct().select("source_path", F.explode(F.array_distinct(F.split("source_path", "/"))).alias("domain"))
    first = parts.join(domains.select("domain").distinct(), "domain").groupBy("source_path").agg(F.min("domain").alias("cluster_id"))
    return named.join(first, "source_path").select("cluster_id", "record_id", F.coalesce("task", F.lit("")).alias("task_instruction"), F.coalesce(F.nullif("outcome", F.lit("")), F.lit(oc.UNKNOWN)).alias("outcome"), "source_path")


def extract_from_groups(run: Run, members: DataFrame, records: DataFrame, sample: int = 8, least: int = 1, ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """cluster_id, cluster_size, source_record_ids, rubrics, error: criteria that a group's runs share.

    Members are (cluster_id, record_id, outcome); records are of traces.summaries. A group shows
    `sample` of its runs, the first of each outcome, then from both ends by id.
    """
    known = members.where((F.coalesce("cluster_id", F.lit("")) != "") & (F.coalesce("record_id", F.lit("")) != "")).select("cluster_id", "record_id", "outcome")
    sizes = known.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")).where(F.col("cluster_size") >= least)
    groups = judging.groups_to_judge(sizes, ids, limit)
    shown = pairs.head_tail_sample(known.join(groups, "cluster_id"), "cluster_id", "outcome", ["record_id"], sample)
    texts = records.select("record_id", render.extraction_sample().alias("text")).dropDuplicates(["record_id"])
    listed = shown.join(texts, "record_id").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("record_id", "text"))).alias("s"), F.max("cluster_size").alias("cluster_size"))  # of `sample` rows each
    of = lambda k: F.transform("s", lambda x: x[k])
    told = rubrics.parse_rubrics(run.ask(listed.select("cluster_id", render.cluster_prompt(of("text")).alias("prompt")), "cluster_id", "extract_groups"))
    return run.keep(listed.select("cluster_id", "cluster_size", of("record_id").alias("source_record_ids")).join(told.select("cluster_id", "rubrics", _error()), "cluster_id"), "group_rubrics")


def evaluate_groups(run: Run | None, criteria: DataFrame, records: DataFrame | None = None, with_labels: bool = False, ids: Sequence[str] | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """audit and flags of each group; with a run also scores of its records, groups and overall (AUC).

    Records are of traces.summaries; those that a group names in source_record_ids are judged,
    those of unknown outcome are left out. Without a run the audit is all there is.
    """
    chosen = judging.groups_to_judge(criteria, ids, limit)
    audit = judging.static_audit(chosen)
    out = {"audit": audit, "flags": judging.flag_totals(audit)}
    if run is None:
        return out
    known = records.where(F.col("outcome").isin(oc.SUCCESS, oc.FAILURE)).dropDuplicates(["record_id"])
    told = known.select("record_id", "outcome", render.judge_sample(with_labels).alias("response"))
    jobs = judging.members_of(chosen, told).join(chosen.select("cluster_id", "rubrics"), "cluster_id").where(F.size("rubrics") > 0)
    jobs = jobs.withColumn("call_id", F.concat_ws("\u0001", "cluster_id", "record_id")).dropDuplicates(["call_id"])
    answers = run.ask(jobs.select("call_id", render.judge_prompt(_lines(F.col("rubrics")), F.col("response")).alias("prompt")), "call_id", "evaluate_groups")
    read = judging.answer_items(answers).select("call_id", "items", _error().alias("judge_error")).join(jobs.select("call_id", "cluster_id", "record_id", "outcome", "rubrics"), "call_id")
    scored = read.withColumn("scores", judging.aligned_scores(F.col("items"), F.col("rubrics"))).drop("items", "rubrics")
    scored = run.keep(scored, "group_answers")
    score = F.when(F.col("judge_error").isNull(), judging.weighted_score(F.col("scores")))
    rows = scored.select("cluster_id", "record_id", (F.col("outcome") == oc.SUCCESS).cast("int").alias("label"), "scores", score.alias("weighted_score"), "judge_error")
    return out | {"scores": rows, "groups": judging.judged_groups(rows), "overall": judging.judged_overall(rows)}


def build_bank(run: Run, criteria: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bank of all pairs' criteria by the vectors of their tasks, and the pairs without a vector."""
    own = made.select("pair_id", *[c for c in bank.TASK_KEYS if c in made.columns]).dropDuplicates(["pair_id"])
    told = criteria.select("pair_id", "domain", "jobname", "rubrics").join(own, "pair_id")
    vectors = run.embed(told.select("pair_id", bank.task_text(told).alias("text")), "pair_id", "tasks", render.embedding_input)
    made_bank, missing = bank.build(told, vectors)
    return run.keep(made_bank, "bank"), missing


def evaluate_with_bank(run: Run, bank_rows: DataFrame, made: DataFrame, k: int = bank.TOP_K, batch: int = bank.BATCH, temperature: float = bank.TEMPERATURE, ids: Sequence[str] | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """weights of the bank's criteria for each pair's task, scores of its responses by the k most applicable, their summary and that of the weights."""
    asked = judging.pairs_to_weigh(made.withColumn("task_text", bank.task_text(made)), ids, limit)
    vectors = run.embed(asked.select("pair_id", F.col("task_text").alias("text")), "pair_id", "tasks", render.embedding_input)
    weights = run.keep(bank.applicability(vectors, bank_rows, temperature), "weights")
    items = run.keep(bank.scored_items(weights, k, batch), "weighed")
    lines = items.join(bank_rows.select("rubric_id", rubrics.rubric_line(F.col("rubric")).alias("line")), "rubric_id")
    chunks = lines.groupBy("pair_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("rubric_index", "line"))), lambda x: x["line"]).alias("lines"))  # of `batch` rows each
    jobs = chunks.join(asked.select("pair_id", "task_text", "responses"), "pair_id").withColumn("call_id", F.concat_ws("\u0001", "pair_id", "chunk"))
    prompts = jobs.select("call_id", render.bank_judge_prompt(F.col("lines"), F.col("task_text"), F.get("responses", F.lit(0)), F.get("responses", F.lit(1))).alias("prompt"))
    answers = judging.answer_items(run.ask(prompts, "call_id", "evaluate_bank")).select("call_id", judging.response_scores(F.col("items"), words=True).alias("scores"), _error())
    told = run.keep(answers.join(jobs.select("call_id", "pair_id", "chunk"), "call_id"), "bank_answers")
    errors = told.groupBy("pair_id").agg(F.min("error").alias("judge_error"))
    rows = bank.pair_scores(bank.chunk_scores(told, items), weights).join(errors, "pair_id", "right").withColumn("p", judging.pair_result(F.col("scores"), rounded=True))
    done = run.keep(rows.select("pair_id", "scores", "p.*", "judge_error"), "bank_scores")
    return {"weights": weights, "scores": done, "summary": judging.pair_summary(done), "applicability": bank.applicability_summary(weights)}
