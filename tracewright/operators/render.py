"""Texts for people and models: summaries of records, prompts, and payloads without noise."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues as cu
from ..functions import outcome as oc
from ..functions.text import let
from ..session import ship

# Keys that tell a model who ran, not what happened, and a sentence that tells of labels.
NOISE_KEYS = (
    "agent", "agent_name", "agent_args", "agent_config", "model", "model_name", "model_args", "llm", "llm_config", "experiment", "source_path", "relative_source_path", "screenshot_path", "screenshot_paths", "success_prior",
)
NOISE_PREFIXES, NOISE_PART = ("agent_", "model_"), "model_args"
TELLS_LABELS, TELLS_TASK = "Task instruction hints and dataset-level outcome supervision.", "Task instruction hints."

_EMPTY = (None, "", [], {})


def _is_noise(name: str) -> bool:
    return name in NOISE_KEYS or NOISE_PART in name or name.startswith(NOISE_PREFIXES)


def _is_noise_field(entry) -> bool:
    """A source field that is blank, a validation, or names a noise key."""
    low = str(entry or "").strip().lower()
    return not low or low == "validation" or any(k in low for k in NOISE_KEYS)


def clean_payload(value):
    """A nested value without noise keys and empty parts; texts are stripped. Keys count whatever their case."""
    if isinstance(value, dict):
        kept = {}
        for k, v in value.items():
            low = str(k).lower()
            if _is_noise(low):
                continue
            v = [x for x in v if not _is_noise_field(x)] if low == "source_fields" and isinstance(v, list) else v
            if (x := clean_payload(v)) not in _EMPTY:
                kept[str(k)] = x
        return kept
    if isinstance(value, list):
        return [x for v in value if (x := clean_payload(v)) not in _EMPTY]
    return value.strip().replace(TELLS_LABELS, TELLS_TASK) if isinstance(value, str) else value


def sanitised(rows: DataFrame, payload: str) -> DataFrame:
    """All columns, with the JSON text in payload cleaned; what is no JSON stays."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return json.dumps(clean_payload(json.loads(t)), ensure_ascii=False)
            except (TypeError, ValueError):
                return t

        return texts.map(one)

    return rows.withColumn(payload, clean(F.col(payload)))


def _section(name: str, lines: Column, mark: str = "- ") -> Column:
    """A name and lines below it; null without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit(mark), x)), "\n")))


def _card_lines(cards: Column, most: int | None, lines: int | None, stage: bool) -> Column:
    """A header of each card, and its evidence."""
    some = lambda c, n: F.slice(c, 1, n) if n else c
    head = lambda c: F.concat_ws(" | ", F.concat(F.lit("- "), c["state_id"]), *([F.concat(F.lit("stage="), c["stage"])] if stage else []), F.concat(F.lit("role="), c["rubric_role"]))
    evidence = lambda c: F.transform(some(c["evidence_lines"], lines), lambda x: F.concat(F.lit("  evidence: "), x))
    return F.array_join(F.transform(some(cards, most), lambda c: F.array_join(F.concat(F.array(head(c)), evidence(c)), "\n")), "\n")


def _risks(limit: int | None = None) -> Column:
    text = F.to_json(F.struct("errors", "repeated_action_runs"))
    return F.when((F.size("errors") > 0) | (F.size("repeated_action_runs") > 0), F.concat(F.lit("risk_signals:\n"), F.substring(text, 1, limit) if limit else text))


def _field(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("")))


def pair_response(model_name: Column, rank: int, actions: bool = True) -> Column:
    """A record of traces.summaries as the text of a pair's response, with its label: nothing is cut."""
    validation = F.to_json(F.struct(*[F.col(f"validation.{k}").alias(k) for k in ("reward", "raw_reward", "n_steps", "terminated", "truncated", "has_error")]))
    return F.concat_ws(
        "\n", _field("record_id", F.col("record_id")), _field("model_name", model_name), _field("outcome", F.col("outcome")), F.lit(f"label_rank: {rank}"), _field("task_instruction", F.col("task")), _field("validation", validation),
        *([_section("action_sequence", F.transform("action_sequence", lambda a: F.to_json(a)))] if actions else []), _section("final_state", F.col("final_state.evidence_lines")),
        F.concat(F.lit("state_cards:\n"), _card_lines(F.col("cards"), None, None, True)), _risks(),
    )


def judge_sample(with_labels: bool = False) -> Column:
    """A record of traces.summaries for a judge: ten lines of the final state, eight cards of six lines; labels only where they are asked for."""
    labels = [_field("outcome", F.col("outcome")), _field("validation", F.to_json("validation"))] if with_labels else []
    return F.concat_ws(
        "\n", _field("record_id", F.col("record_id")), _field("task_instruction", F.col("task")), *labels, _section("final_state", F.slice("final_state.evidence_lines", 1, 10)),
        F.concat(F.lit("state_cards:\n"), _card_lines(F.col("cards"), 8, 6, False)), _risks(1600), F.when(F.col("load_error").isNotNull(), _field("load_error", F.col("load_error"))),
    )


def step_text(steps: Column, most: int = 24, cues: int = 4) -> Column:
    """Steps (step_index, action, cues) as lines."""
    one = lambda s: F.concat_ws("\n", _field("- step", s["step_index"]), F.when(s["action"] != "", F.concat(F.lit("  action: "), s["action"])), F.when(F.size(s["cues"]) > 0, F.array_join(F.transform(F.slice(s["cues"], 1, cues), lambda c: F.concat(F.lit("  cue: "), c)), "\n")))
    return F.array_join(F.transform(F.slice(steps, 1, most), one), "\n")


def extraction_sample() -> Column:
    """A record of traces.summaries for the extraction of criteria, with its label: 16 actions, 12 lines of the final state, ten cards of eight lines."""
    acts = F.transform(F.slice("action_sequence", 1, 16), lambda a: F.concat(a["step_index"].cast("string"), F.lit(": "), a["action"]))
    return F.concat_ws(
        "\n", _field("record_id", F.col("record_id")), _field("outcome", F.col("outcome")), _field("task_instruction", F.col("task")), _section("action_sequence", acts),
        _section("final_state", F.slice("final_state.evidence_lines", 1, 12)), F.concat(F.lit("state_cards:\n"), _card_lines(F.col("cards"), 10, 8, False)), _risks(1600),
    )


def response_text(with_outcome: bool = True) -> Column:
    """A record of traces.summaries as text: task, actions, final state, errors; the outcome only where labels may be seen."""
    actions = F.array_join(F.transform("action_sequence", lambda a: F.concat(F.lit("- "), a["step_index"].cast("string"), F.lit(": "), F.coalesce(a["action"], a["action_type"]))), "\n")
    errors = F.array_join(F.transform("errors", lambda e: F.concat(F.lit("- "), e["error_type"], F.lit(": "), e["message"])), "\n")
    section = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:\n"), c))
    parts = [section("Task", F.col("task")), section("Actions", actions), section("Final page", F.col("final_url")), section("Final lines", F.array_join("final_cues", "\n")), section("Errors", errors)]
    return F.concat_ws("\n\n", *parts, *([section("Outcome", F.col("outcome"))] if with_outcome else []))


def prompt_payload(max_chars: int | None = 80_000, by_priority: bool = True) -> Column:
    """The cards of a record of traces.summaries as a prompt takes them: without what tells of models and labels, by priority, and within the characters."""
    bare = lambda c: (
        c.withField("success_prior", F.lit(None).cast("struct<outcome:string,reward:double,note:string>")).withField("screenshot_paths", F.array().cast("array<string>"))
        .withField("source_fields", F.filter(c["source_fields"], lambda f: ~F.lower(f).rlike("^$|^validation$|" + "|".join(NOISE_KEYS)))).withField("state_summary", F.replace(c["state_summary"], F.lit(TELLS_LABELS), F.lit(TELLS_TASK)))
    )
    cards = F.transform("cards", bare)
    ranked = F.array_sort(F.transform(cards, lambda c, i: F.struct(oc.card_priority(c["state_id"], c["rubric_role"]).alias("k"), i.alias("i"))))
    ordered = let(cards, lambda cs: F.transform(ranked, lambda r: F.get(cs, r["i"]))) if by_priority else cards
    return ordered if max_chars is None else let(ordered, lambda cs: cu.fit_cards(cs, max_chars, shrink=True))


def embedding_input(text: Column, instruction: str = "Represent the task for clustering") -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text)


def _prompt(ask: str, *parts: tuple[str, Column]) -> Column:
    return F.concat_ws("\n\n", F.lit(ask), *[F.concat(F.lit(f"{name}:\n"), c) for name, c in parts])


def _numbered(criteria: Column) -> Column:
    return F.array_join(F.transform(criteria, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")


def pair_prompt(task: Column, first: Column, second: Column) -> Column:
    """A request for criteria that tell two responses apart."""
    return _prompt("Name criteria that tell the better response from the other, as a JSON list of objects with dimension, criterion, positive_evidence, negative_evidence, severity, rationale and verification_guide.", ("Task", task), ("Response 0", first), ("Response 1", second))


def cluster_prompt(samples: Column) -> Column:
    """A request for criteria that a group of runs shares."""
    return _prompt("Name three to six criteria that separate good runs from bad ones of tasks like these, as a JSON list of objects. Name no records, addresses or persons.", ("Runs", F.array_join(samples, "\n\n---\n\n")))


def merge_prompt(group: Column) -> Column:
    """A request to merge the criteria of a group's pairs (rubrics.group_text)."""
    return _prompt("Merge these criteria into themes, as a JSON object with categories (theme, tips, verification_guide, source_pair_ids) and a reason.", ("Criteria", group))


def judge_prompt(criteria: Column, response: Column) -> Column:
    """A request for a score from 0 to 1 for each criterion of a list."""
    return _prompt("Score each criterion from 0 to 1, as a JSON list of rubric_index, score, evidence and rationale.", ("Criteria", _numbered(criteria)), ("Response", response))


def pair_judge_prompt(criteria: Column, task: Column, first: Column, second: Column) -> Column:
    """A request for scores of two responses by a pair's criteria."""
    return _prompt("Score both responses by each criterion from 0 to 1, as a JSON list of response_id, rubric_scores (rubric_index, score, evidence) and total_score.", ("Task", task), ("Criteria", _numbered(criteria)), ("response_0", first), ("response_1", second))


def bank_judge_prompt(criteria: Column, task: Column, first: Column, second: Column) -> Column:
    """A request for scores of two responses by a chunk of the bank's criteria."""
    return _prompt("Score both responses by each criterion of the list from 0 to 1, as a JSON list of response_id and rubric_scores (rubric_index, score, evidence, rationale).", ("Task", task), ("Criteria", _numbered(criteria)), ("response_0", first), ("response_1", second))


def messages(prompt: Column, system: str = "Answer with JSON only.") -> Column:
    """A prompt as chat messages."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))
