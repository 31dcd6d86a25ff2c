"""Canonical records to steps, summaries, evidence cards and audit views."""

from __future__ import annotations

import ast
import json
import keyword

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType
from pyspark.sql.window import Window

from ..functions import cues as cu
from ..functions import goals
from ..functions import open_json as oj
from ..functions import outcome as oc
from ..functions import text as tx
from ..session import ship

STEP_SCHEMA = "raw string, action_type string, target_bid string, target_text string, params string"
# Names under which a call gives its text and its target.
TEXT_NAMES = ("value", "options", "text", "query", "target", "target_text", "key_comb", "wait_ms", "delta_y")
TARGET_NAMES = ("bid", "selector", "target", "element")
# Keys that make an event a step, an observation, or an error.
STEP_EVENT = ("action", "reasoning", "thought", "url", "focused_element", "screenshot_path", "num")
OBSERVATION_EVENT = ("observation", "observation_segments", "axtree_pruned", "axtree")
ERROR_EVENT = ("error", "last_action_error")
# Actions that change a page, and those that answer.
CHANGING = ("fill", "select_option", "click", "goto", "press", "send_msg", "send_message")
ANSWERING = ("send_msg", "send_message", "answer", "final_answer")


def parse_action(raw: str | None) -> dict[str, str]:
    """Type, target, text and named values of a call such as click('12'); never evaluated. What is no call has the part before '(' as its type."""
    text = (raw or "").strip()
    out = {"raw": text, "action_type": text.split("(", 1)[0].strip(), "target_bid": "", "target_text": "", "params": "{}"}
    try:
        call = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return out
    if not isinstance(call, ast.Call) or not isinstance(call.func, ast.Name):
        return out

    def value(node: ast.expr):
        try:
            return ast.literal_eval(node)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return ast.unparse(node)

    def shown(v) -> str:
        return "" if v is None else str(v) if isinstance(v, str | int | float) else json.dumps(v, ensure_ascii=False, default=str)

    named = {k.arg: value(k.value) for k in call.keywords if k.arg}
    given = [shown(value(a)) for a in call.args[:2]] + ["", ""]
    said = given[1] or next((t for k in TEXT_NAMES if k in named and (t := shown(named[k]))), "")
    bid = given[0] or next((shown(named[k]) for k in TARGET_NAMES if k in named), "")
    return {"raw": text, "action_type": call.func.id, "target_bid": bid, "target_text": said, "params": json.dumps(named, ensure_ascii=False, default=str)}


_SIMPLE = r"^([A-Za-z_][A-Za-z0-9_]*)\((?:'([^'\\\\\n]*)'(?:, ?'([^'\\\\\n]*)')?)?\)$"
# Python's own words, which are no names of calls.
KEYWORDS = tuple(keyword.kwlist)


def action_signature(raw: str) -> Column:
    """A struct of parse_action's fields. Calls of up to two plain texts are matched natively; others are parsed, equal ones of a batch once."""

    @F.pandas_udf(STEP_SCHEMA)
    def parsed(raw: pd.Series) -> pd.DataFrame:
        known = {x: parse_action(x) for x in raw.unique()}
        return pd.DataFrame([known[x] for x in raw], columns=["raw", "action_type", "target_bid", "target_text", "params"])

    text = tx.strip(F.coalesce(F.col(raw), F.lit("")))
    part = lambda i: F.regexp_extract(text, _SIMPLE, i)
    simple = F.struct(text.alias("raw"), part(1).alias("action_type"), part(2).alias("target_bid"), part(3).alias("target_text"), F.lit("{}").alias("params"))
    blank = F.struct(F.lit("").alias("raw"), *[F.lit("").alias(c) for c in ("action_type", "target_bid", "target_text")], F.lit("{}").alias("params"))
    native = F.when(text == "", blank).when(text.rlike(_SIMPLE) & ~part(1).isin(*KEYWORDS), simple)
    # what is matched natively goes to Python as null, so that a batch parses the rest only
    return F.coalesce(native, parsed(F.when(native.isNull(), text)))


def _text_of(m: Column, keys: tuple[str, ...]) -> Column:
    """The first of some keys that is there, as stripped text; empty without one."""
    return tx.strip(F.coalesce(oj.text(oj.pick_present(m, keys)), F.lit("")))


def _cues_of(m: Column) -> Column:
    """The cues of an observation: those of its segments by section, else the best lines of its tree."""
    section = lambda s: F.coalesce(F.nullif(_text_of(s, ("section",)), F.lit("")), F.lit("observation"))
    listed = F.transform(F.filter(F.transform(oj.as_list(m["observation_segments"]), oj.as_map), lambda s: s.isNotNull()), lambda s: F.struct(section(s).alias("section"), oj.as_list(s["cues"]).alias("cues")))
    named = lambda s: F.transform(F.filter(F.transform(s["cues"], lambda c: tx.strip(oj.text(c))), lambda t: t != ""), lambda t: F.concat(s["section"], F.lit(": "), t))
    of_segments = F.flatten(F.transform(F.filter(listed, lambda s: s["cues"].isNotNull()), named))
    tree = F.coalesce(oj.text(oj.pick_present(m, ("observation", "axtree_pruned", "axtree"))), F.lit(""))
    return tx.let(of_segments, lambda found: F.when(F.size(found) > 0, found).otherwise(tx.let(tree, cu.best_cues)))


def _snapshot(m: Column) -> Column:
    """What an event shows: its title, focus and cues; url and picture only where it names them."""
    source = F.coalesce(oj.text(oj.pick_present(m, ("observation_source", "source_key"))), F.lit("observation"))
    here = lambda k: tx.strip(oj.text(m[k])).alias("screenshot" if k != "url" else k)
    return tx.let(_cues_of(m), lambda c: F.struct(
        source.alias("source_key"), _title(c).alias("page_title"), _text_of(m, ("focused_element",)).alias("focused"), here("url"), here("screenshot_path"),
        F.filter(c, lambda x: cu.any_of(F.lower(x), cu.CLICKABLE)).alias("clickable"), F.slice(c, 1, 24).alias("cues"),
    ))


def _title(cues: Column) -> Column:
    """The name of the first heading; empty without one."""
    return F.coalesce(F.regexp_extract(F.get(F.filter(cues, lambda x: x.rlike("heading '([^']+)'")), F.lit(0)), "heading '([^']+)'", 1), F.lit(""))


def events_of(records: DataFrame) -> DataFrame:
    """(record_id, pos, m, is_step, is_seen, is_error, valid) of every event that is an object; pos is its place, as step numbers may repeat.

    Keys that are there count, whatever their values. A step that says, does, shows and reports
    nothing is not valid: it ends the step before it and begins none.
    """
    each = records.select("record_id", F.posexplode("trace").alias("pos", "e")).select("record_id", "pos", oj.as_map(F.col("e")).alias("m")).where("m is not null")
    m = F.col("m")
    said = (_text_of(m, ("action",)) != "") | (_text_of(m, ("thought", "reasoning")) != "")
    shown = F.coalesce(m["observation"].isNotNull() & ~F.is_variant_null(m["observation"]), F.lit(False))
    return each.withColumns({"is_step": oj.has_any(m, STEP_EVENT), "is_seen": oj.has_any(m, OBSERVATION_EVENT), "is_error": oj.has_any(m, ERROR_EVENT)}).withColumn(
        "valid", F.col("is_step") & (said | shown | oj.truthy(oj.pick_present(m, ERROR_EVENT)))
    )


def steps_of(records: DataFrame) -> DataFrame:
    """A row for each step, with the observations and errors around it.

    A valid step is open until the next step event. Observations and errors after it are its own;
    those that come while none is open wait for the next one, which takes them after what it shows
    itself, of the waiting errors only the last. An event that shows something is an observation,
    whatever error it holds too. Of errors the last one that says something stays; of pages the
    last title, focus and source, and the last url and picture that an event names. One exchange
    by record_id serves all.
    """
    ship(records.sparkSession)
    ev = events_of(records)
    in_order = Window.partitionBy("record_id").orderBy("pos")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    placed = ev.withColumn("n", F.sum(F.col("valid").cast("int")).over(upto)).withColumn("open", F.coalesce(F.last(F.when(F.col("is_step"), F.col("valid")), ignorenulls=True).over(upto), F.lit(False)))
    useful = placed.where("valid or (not is_step and (is_seen or is_error))")
    step = F.when(F.col("valid") | F.col("open"), F.col("n")).otherwise(F.col("n") + 1)
    turn = F.when(F.col("valid"), 0).when(~F.col("open"), 1).otherwise(2)
    m, message = F.col("m"), _text_of(F.col("m"), ERROR_EVENT)
    fails = F.col("is_error") & (F.col("valid") | ~F.col("is_seen"))
    parts = useful.select(
        "record_id", step.alias("step"), "pos", turn.alias("turn"), "valid",
        F.when(F.col("is_seen"), _snapshot(m)).alias("seen"), F.when(fails, message).alias("message"),
        F.when(F.col("valid"), F.struct(
            oj.text(oj.pick_present(m, ("index", "num"))).alias("index"), _text_of(m, ("thought", "reasoning")).alias("thought"), _text_of(m, ("action",)).alias("action"),
            _text_of(m, ("url",)).alias("url"), oj.truthy(m["url"]).alias("has_url"), _text_of(m, ("screenshot_path",)).alias("screenshot"), _text_of(m, ("focused_element",)).alias("focused"),
        )).alias("own"),
    )
    grouped = parts.groupBy("record_id", "step").agg(
        F.max(F.when(F.col("valid"), F.col("pos"))).alias("pos"),
        F.first("own", ignorenulls=True).alias("own"),
        F.array_sort(F.collect_list(F.when(F.col("seen").isNotNull(), F.struct("turn", "pos", "seen")))).alias("seen"),
        F.max(F.when(F.col("message").isNotNull() & (F.col("turn") == 0), F.col("message"))).alias("own_error"),
        F.max(F.when(F.col("message").isNotNull() & (F.col("turn") == 1), F.struct("pos", "message")))["message"].alias("waited"),
        F.max(F.when((F.col("message") != "") & (F.col("turn") == 2), F.struct("pos", "message")))["message"].alias("later"),
    ).where("own is not null")
    error = F.coalesce("later", F.nullif("waited", F.lit("")), F.nullif("own_error", F.lit("")), F.lit(""))
    last = lambda f, own: F.when(F.size("seen") > 0, F.element_at("seen", -1)["seen"][f]).otherwise(own)
    named = lambda f: F.coalesce(_last_named(f), F.col(f"own.{f}"))
    url_cue = F.when(F.col("own.has_url"), F.array(F.concat(F.lit("url: "), F.col("own.url")))).otherwise(F.array().cast("array<string>"))
    of = lambda f: F.flatten(F.transform("seen", lambda s: s["seen"][f]))
    number = F.regexp_extract(F.coalesce("own.index", F.lit("")), r"^(\d+)", 1).try_cast("long")
    kept = F.size("seen") > 0
    out = grouped.select(
        "record_id", "pos", F.coalesce(number, (F.col("step") - 1).cast("long")).alias("step_index"), F.col("own.thought").alias("thought"), F.col("own.action").alias("action"),
        named("url").alias("url"), named("screenshot").alias("screenshot"), last("page_title", F.lit("")).alias("page_title"), last("focused", F.col("own.focused")).alias("focused"), last("source_key", F.lit("")).alias("source_key"),
        F.when(kept, tx.ordered_distinct(of("clickable"))).otherwise(F.array().cast("array<string>")).alias("clickable"), F.when(kept, tx.ordered_distinct(F.concat(url_cue, of("cues")))).otherwise(url_cue).alias("cues"),
        oc.error_type(error).alias("error_type"), tx.trim_text(error, 300).alias("error"),
    )
    return out.withColumn("signature", action_signature("action"))


def _last_named(f: str) -> Column:
    return F.try_element_at(F.filter(F.transform("seen", lambda s: s["seen"][f]), lambda x: x.isNotNull()), F.lit(-1))


def step_evidence(s: Column, terms: Column, limit: int) -> Column:
    """What a step did and showed: its action, target, url and title, then the best cues; without repeats."""
    line = lambda mark, x, when=None: F.when((x != "") & (F.lit(True) if when is None else when), F.concat(F.lit(mark), x))
    raw = s["signature"]["raw"]
    top = F.array(line("action: ", raw, F.lower(raw) != "none"), line("action_target_text: ", s["signature"]["target_text"]), line("url: ", s["url"]), line("page_title: ", s["page_title"]))
    return F.slice(tx.ordered_distinct(F.concat(top, cu.ranked_evidence(F.concat(s["cues"], s["clickable"]), terms, limit))), 1, limit)


def _matched(terms: Column, text: Column) -> Column:
    return F.filter(tx.matched_terms(terms, text), lambda t: F.trim(t) != "")


def step_scores(steps: DataFrame) -> DataFrame:
    """Steps (with terms) and idx, n, evidence, moved and seen: the scores as a transition and as an observation, 0 where a step is none.

    The last step is no transition; the first and the last are no observations.
    """
    in_order = Window.partitionBy("record_id").orderBy("pos")
    before = F.last(F.nullif("url", F.lit("")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    s = F.struct("signature", "url", "page_title", "cues", "clickable")
    placed = steps.withColumns({"idx": F.row_number().over(in_order) - 1, "n": F.count("*").over(Window.partitionBy("record_id")), "before": F.coalesce(before, F.lit("")), "evidence": step_evidence(s, F.col("terms"), 20)})
    raw, act = F.col("signature.raw"), F.lower("signature.action_type")
    searched = F.concat_ws("\n", "signature.raw", "signature.target_text", "signature.target_bid", "url", "page_title", "focused", "cues", "clickable")
    points = lambda when, n: F.when(when, n).otherwise(0)
    moved = (
        points((raw != "") & (F.lower(raw) != "none"), 2) + points(act.isin(*CHANGING), 2) + points(F.col("signature.target_text") != "", 4) + F.size(_matched(F.col("terms"), searched)) * 4
        + points(F.col("error") != "", 8) + points((F.col("url") != "") & (F.col("url") != F.col("before")), 5) + points(F.col("idx") < 2, 1)
    )
    joined = F.lower(F.array_join("evidence", "\n"))
    seen = F.least(F.size("evidence"), F.lit(12)) + F.size(_matched(F.col("terms"), joined)) * 3 + cu.how_many(joined, cu.DENSE)
    return placed.withColumns({"moved": F.when(F.col("idx") < F.col("n") - 1, moved).otherwise(0), "seen": F.when((F.col("idx") > 0) & (F.col("idx") < F.col("n") - 1), seen).otherwise(0)}).drop("before")


CARD = (
    "struct<state_id:string,card_type:string,stage:string,evidence_role:string,rubric_role:string,state_summary:string,matched_goal_terms:array<string>,evidence_lines:array<string>,"
    "source_steps:array<bigint>,source_fields:array<string>,screenshot_paths:array<string>,facets:map<string,boolean>,confidence:string,success_prior:struct<outcome:string,reward:double,note:string>>"
)
# What cards say of themselves.
SUPERVISION = "This is dataset-level supervision, not parser judgment."
SAYS = {
    "task_context": "Task instruction hints and dataset-level outcome supervision.",
    "initial_observation": "Initial observable state and first action context.",
    "action_transition": "Key action transition selected by observable change, target text, error state, or task-term evidence.",
    "evidence_observation": "Intermediate observation with dense visible evidence for later rubric extraction.",
    "final_observation": "Final observable state for later rubric verification.",
    "output_or_answer": "Explicit final response or message action emitted by the agent.",
    "media_reference": "Screenshot paths and image labels retained for optional visual inspection.",
    "risk_or_error": "Errors or repeated actions that may matter for failure/side-effect rubrics.",
}
ROLE_OF = {
    "task_context": "task_definition", "initial_observation": "initial_context", "action_transition": "action_and_observation_evidence", "evidence_observation": "supporting_observation_evidence",
    "final_observation": "terminal_state_evidence", "output_or_answer": "final_response_evidence", "media_reference": "visual_or_media_pointer", "risk_or_error": "negative_or_side_effect_evidence",
}

_TEXTS, _NUMBERS = "array<string>", "array<bigint>"


def card(kind: str, evidence: Column, state_id: Column | None = None, stage: str | None = None, matched: Column | None = None, steps: Column | None = None, fields: tuple[str, ...] = (), pictures: Column | None = None, facets: Column | None = None, prior: Column | None = None) -> Column:
    """A card of evidence, with all fields of its kind."""
    none = lambda c, t: F.array().cast(t) if c is None else c.cast(t)
    names = ("state_id", "card_type", "stage", "evidence_role", "rubric_role", "state_summary", "matched_goal_terms", "evidence_lines", "source_steps", "source_fields", "screenshot_paths", "facets", "confidence", "success_prior")
    values = (
        F.lit(kind) if state_id is None else state_id, F.lit(kind), F.lit(stage or kind), F.lit(ROLE_OF[kind]), F.lit(ROLE_OF[kind]), F.lit(SAYS[kind]), none(matched, _TEXTS), evidence.cast(_TEXTS),
        none(steps, _NUMBERS), F.array(*map(F.lit, fields)).cast(_TEXTS), none(pictures, _TEXTS), F.create_map().cast("map<string,boolean>") if facets is None else facets, F.lit("candidate"),
        F.lit(None) if prior is None else prior,
    )
    return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)]).cast(CARD)


def step_card(kind: str, s: Column, terms: Column, limit: int, state_id: Column | None = None, prior: Column | None = None) -> Column:
    """A card of one step: its evidence, the terms that this holds, its picture and what it speaks of."""
    bound = F.array(F.struct(step_evidence(s, terms, max(4, limit)).alias("lines"), F.array_join(step_evidence(s, F.array().cast(_TEXTS), 30), "\n").alias("plain")))
    made = lambda b: card(
        kind, b["lines"], state_id, matched=tx.ordered_distinct(_matched(terms, F.array_join(b["lines"], "\n"))), steps=F.array(s["step_index"]), fields=("action_signature", "obs_snapshot"),
        pictures=F.filter(F.array(s["screenshot"]), lambda x: x != ""), facets=oc.facets(b["plain"]), prior=prior,
    )
    return F.get(F.transform(bound, made), F.lit(0))


def repeated_runs(steps: Column) -> Column:
    """(action, start_step, end_step, count) of three and more equal actions in a row; blank ones do not part them."""
    acted = F.transform(F.filter(steps, lambda s: s["signature"]["raw"] != ""), lambda s: F.struct(s["signature"]["raw"].alias("action"), s["step_index"].alias("step")))

    def runs(b: Column) -> Column:
        a = b["a"]
        starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1)["action"] != x["action"]), i)), lambda i: i.isNotNull())
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(a)))
        both = F.zip_with(starts, F.slice(ends, 1, F.size(starts)), lambda lo, hi: F.struct(F.get(a, lo)["action"].alias("action"), F.get(a, lo)["step"].alias("start_step"), F.get(a, hi - 1)["step"].alias("end_step"), (hi - lo).cast("long").alias("count")))
        return F.filter(both, lambda r: r["count"] >= 3)

    return F.get(F.transform(F.array(F.struct(acted.alias("a"))), runs), F.lit(0))


def media_card(steps: Column) -> Column:
    """Pictures (the first and the last two) and labels of images, four of a step and twelve in all; null without any."""
    images = lambda s: F.filter(F.concat(s["cues"], s["clickable"]), lambda x: F.lower(x).contains("image") & (F.trim(x) != ""))
    labels = tx.ordered_distinct(F.flatten(F.transform(steps, lambda s: F.slice(images(s), 1, 4))))
    shots = tx.ordered_distinct(F.transform(steps, lambda s: s["screenshot"]))
    of = F.array_distinct(F.transform(F.filter(steps, lambda s: (s["screenshot"] != "") | (F.size(images(s)) > 0)), lambda s: s["step_index"]))
    sampled = F.array_distinct(F.concat(F.slice(shots, 1, 2), F.slice(shots, F.greatest(F.size(shots) - 1, F.lit(1)), F.lit(2))))
    facets = F.create_map(F.lit("has_screenshot"), F.size(shots) > 0, F.lit("has_image_label"), F.size(labels) > 0)
    made = card("media_reference", F.slice(labels, 1, 12), F.lit("media_references"), steps=F.slice(of, 1, 12), fields=("obs_snapshot.screenshot_path", "obs_snapshot.task_relevant_cues"), pictures=sampled, facets=facets)
    return F.when((F.size(shots) > 0) | (F.size(labels) > 0), made)


def risk_card(errors: Column, runs: Column) -> Column:
    """Up to eight errors and eight repeated actions as text; null without any."""
    failed = F.transform(F.slice(errors, 1, 8), lambda e: F.concat(F.lit("step "), e["step_index"].cast("string"), F.lit(" error: "), e["message"]))
    again = F.transform(F.slice(runs, 1, 8), lambda r: F.format_string("repeated action %s from step %d to %d (%d times)", r["action"], r["start_step"], r["end_step"], r["count"]))
    facets = F.create_map(F.lit("has_error"), F.size(errors) > 0, F.lit("has_repetition"), F.size(runs) > 0)
    made = card("risk_or_error", F.concat(failed, again), F.lit("risk_signals"), "risk_state", steps=F.transform(F.slice(errors, 1, 8), lambda e: e["step_index"]), fields=("error_signal", "action_signature"), facets=facets)
    return F.when((F.size(errors) > 0) | (F.size(runs) > 0), made)


def answer_card(steps: Column, terms: Column) -> Column:
    """The first step that answers; null without one."""
    raw = lambda s: F.lower(s["signature"]["raw"])
    opens = lambda s: F.substring_index(raw(s), "(", 1).rlike("^(" + "|".join(ANSWERING) + ")")
    found = F.filter(steps, lambda s: F.lower(s["signature"]["action_type"]).isin(*ANSWERING) | opens(s))

    def made(s: Column) -> Column:
        lines = F.array_compact(F.array(F.when(s["signature"]["raw"] != "", F.concat(F.lit("action: "), s["signature"]["raw"])), F.when(s["signature"]["target_text"] != "", F.concat(F.lit("answer_text: "), s["signature"]["target_text"]))))
        return card("output_or_answer", lines, matched=_matched(terms, F.array_join(lines, "\n")), steps=F.array(s["step_index"]), fields=("action_signature",), facets=F.create_map(F.lit("has_explicit_answer"), F.lit(True)))

    return F.get(F.transform(F.slice(found, 1, 1), made), F.lit(0))


def cards_of(steps: Column, terms: Column, outcome: Column, reward: Column, errors: Column, runs: Column) -> Column:
    """Up to 14 cards: the task, the first step, five transitions, three observations, the last step, the answer, media and risks.

    Transitions and observations come by score, then place; a step is one of them only. Without
    steps there is the task's card alone; cards of steps without evidence go, but for the first's.
    """
    prior = F.struct(outcome.alias("outcome"), reward.alias("reward"), F.lit(SUPERVISION).alias("note"))
    hints = F.when(F.size(terms) > 0, F.array(F.concat(F.lit("goal_terms: "), F.array_join(F.slice(terms, 1, 12), ", ")))).otherwise(F.array().cast(_TEXTS))
    task = card("task_context", hints, stage="task_state", matched=F.slice(terms, 1, 12), fields=("task_instruction", "validation"), facets=F.create_map(F.lit("has_task_terms"), F.size(terms) > 0), prior=prior)
    ranked = lambda f, rows: F.array_sort(F.transform(F.filter(rows, lambda s: s[f] > 0), lambda s: F.struct((-s[f]).alias("k"), s["idx"].alias("i"), s.alias("s"))))
    moves = F.slice(ranked("moved", steps), 1, 5)
    rest = F.filter(steps, lambda s: ~F.exists(moves, lambda r: r["i"] == s["idx"]))
    sights = F.slice(ranked("seen", rest), 1, 3)
    numbered = lambda kind, rows, limit: F.transform(rows, lambda r, i: step_card(kind, r["s"], terms, limit, F.concat(F.lit(f"{kind}_"), (i + 1).cast("string"))))
    told = lambda cards: F.filter(cards, lambda c: F.size(c["evidence_lines"]) > 0)
    of_steps = F.concat(
        F.transform(F.slice(steps, 1, 1), lambda s: step_card("initial_observation", s, terms, 8)),
        told(numbered("action_transition", moves, 10)), told(numbered("evidence_observation", sights, 12)),
        told(F.transform(F.slice(steps, -1, 1), lambda s: step_card("final_observation", s, terms, 16, prior=prior))),
        F.array_compact(F.array(answer_card(steps, terms), media_card(steps), risk_card(errors, runs))),
    )
    return F.slice(F.concat(F.array(task), F.when(F.size(steps) > 0, of_steps).otherwise(F.array().cast(f"array<{CARD}>"))), 1, 14)


def validation_of(summary: Column, n_steps: Column, outcome: Column) -> Column:
    """reward, raw_reward, n_steps, terminated, truncated, has_error and outcome of a run's own summary (a map of variants)."""
    return F.struct(
        oj.number(oj.pick_present(summary, ("cum_reward", "cum_raw_reward"))).alias("reward"), oj.number(summary["cum_raw_reward"]).alias("raw_reward"),
        F.coalesce(oj.number(summary["n_steps"]).cast("long"), n_steps.cast("long")).alias("n_steps"), oj.truthy(summary["terminated"]).alias("terminated"), oj.truthy(summary["truncated"]).alias("truncated"),
        (oj.truthy(summary["err_msg"]) | oj.truthy(summary["stack_trace"])).alias("has_error"), outcome.alias("outcome"),
    )


def compact_validation(v: Column) -> Column:
    """A validation's filled fields as text by name."""
    names = ("reward", "raw_reward", "n_steps", "terminated", "truncated", "has_error", "outcome")
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[v[k].cast("string") for k in names])), lambda _, x: x.isNotNull() & (x != ""))


STEP_FIELDS = ("pos", "idx", "step_index", "thought", "action", "signature", "url", "screenshot", "page_title", "focused", "clickable", "cues", "error_type", "error", "evidence", "moved", "seen")


def summaries(records: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """One row of each record (of readers.canonical): outcome, validation, goal terms, actions, final state, risks, cards, audit view and metadata.

    Steps come from events; where a record has none, from its chat messages. A record of unknown
    outcome takes that of its reward. The first 120 actions are told, blank and "none" ones left out.
    """
    found = steps if steps is not None else all_steps(records)
    of = F.col("metadata")
    summary = oj.as_map(of["summary_info"])
    paid = oj.number(oj.pick_present(summary, ("cum_reward", "reward")))
    outcome = F.when((F.col("outcome") == oc.UNKNOWN) & paid.isNotNull(), F.when(paid > 0, oc.SUCCESS).otherwise(oc.FAILURE)).otherwise(F.col("outcome"))
    base = records.select(
        "record_id", F.col("task"), outcome.alias("outcome"), goals.goal_terms(F.col("task")).alias("terms"), summary.alias("summary"),
        F.map_filter("metadata", lambda k, _: k != "package_version").alias("metadata"), "chat_messages", "load_error", "source_path",
    )
    scored = step_scores(found.join(base.select("record_id", "terms"), "record_id"))
    arrays = scored.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(*STEP_FIELDS))).alias("steps"))
    joined = base.join(arrays, "record_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast(arrays.schema["steps"].dataType)))
    told = F.transform(F.filter("steps", lambda s: s["error"] != ""), lambda s: F.struct(s["step_index"].alias("step_index"), s["error_type"].alias("error_type"), s["error"].alias("message")))
    joined = joined.withColumns({"errors": told, "repeated_action_runs": repeated_runs(F.col("steps"))})
    joined = joined.withColumn("validation", validation_of(F.col("summary"), F.size("steps"), F.col("outcome")))
    joined = joined.withColumn("cards", cards_of(F.col("steps"), F.col("terms"), F.col("outcome"), F.col("validation.reward"), F.col("errors"), F.col("repeated_action_runs")))
    sig = lambda s, k: s["signature"][k]
    acts = F.filter("steps", lambda s: ((sig(s, "raw") != "") | (sig(s, "action_type") != "")) & (F.lower(sig(s, "raw")) != "none") & (F.lower(sig(s, "action_type")) != "none"))
    shown = lambda s: F.coalesce(F.nullif(sig(s, "raw"), F.lit("")), sig(s, "action_type"))
    action = lambda s: F.struct(s["step_index"].alias("step_index"), shown(s).alias("action"), *[sig(s, k).alias(k) for k in ("action_type", "target_bid", "target_text")], s["url"].alias("url"))
    final = F.try_element_at("steps", F.lit(-1))
    last = F.struct(
        final["step_index"].alias("source_step"), F.coalesce(final["screenshot"], F.lit("")).alias("screenshot_path"), final["url"].alias("url"),
        F.coalesce(_matched(F.col("terms"), F.array_join(final["evidence"], "\n")), F.array().cast(_TEXTS)).alias("matched_goal_terms"), F.coalesce(final["evidence"], F.array().cast(_TEXTS)).alias("evidence_lines"),
    )
    text_of = lambda k: oj.text(F.col("metadata")[k])
    sources = F.transform("cards", lambda c: F.struct(*[c[k].alias(k) for k in ("state_id", "card_type", "evidence_role", "source_steps", "source_fields", "screenshot_paths")]))
    audit = F.struct(F.struct(*[text_of(k).alias(k) for k in ("benchmark", "dataset", "agent", "model", "task_id", "task_family", "source_path", "relative_source_path")]).alias("source_metadata"), sources.alias("state_card_sources"))
    return joined.select(
        "record_id", "task", "outcome", F.size("steps").cast("long").alias("n_steps"), F.col("validation.reward").alias("reward"), "validation", F.col("terms").alias("goal_terms"),
        F.transform(F.slice(acts, 1, 120), action).alias("action_sequence"), last.alias("final_state"), final["url"].alias("final_url"), F.slice(final["cues"], 1, 20).alias("final_cues"),
        "errors", "repeated_action_runs", "cards", audit.alias("audit"), "metadata", "chat_messages", "load_error", "source_path",
    )


def all_steps(records: DataFrame) -> DataFrame:
    """Steps of events; of chat messages for records that have none."""
    found = steps_of(records)
    if not isinstance(records.schema["chat_messages"].dataType, VariantType):
        return found
    chats = records.where("chat_messages is not null")
    chat = steps_of_chat(chats).join(found.select("record_id").distinct(), "record_id", "left_anti")
    return found.unionByName(chat, allowMissingColumns=True)


def messages_of(chat: Column) -> Column:
    """Messages (maps of variants) of a list, or of the lists under regular and pruned."""
    m = oj.as_map(chat)
    none = F.array().cast("array<variant>")
    listed = F.coalesce(oj.as_list(chat), F.concat(*[F.coalesce(oj.as_list(m[k]), none) for k in ("regular", "pruned")]), none)
    return F.filter(F.transform(listed, oj.as_map), lambda x: x.isNotNull())


def chat_text(chat: Column) -> Column:
    """The texts of all messages, and of the parts of those that are lists, between blank lines."""

    def parts(x: Column) -> Column:
        c = x["content"]
        inner = F.transform(oj.as_list(c), lambda p: F.coalesce(F.when(oj.is_text(oj.as_map(p)["text"]), oj.text(oj.as_map(p)["text"])), F.when(oj.is_text(p), oj.text(p))))
        one = F.when(c.isNotNull() & ~F.is_variant_null(c), F.array(oj.text(c))).otherwise(F.array().cast(_TEXTS))
        return F.coalesce(F.array_compact(inner), one)

    return F.array_join(F.flatten(F.transform(messages_of(chat), parts)), "\n\n")


def steps_of_chat(records: DataFrame) -> DataFrame:
    """Steps of the assistant's messages (record_id, chat_messages): a written trace gives its steps, other messages are a thought each."""
    ship(records.sparkSession)
    turns = records.select("record_id", F.posexplode(messages_of(F.col("chat_messages"))).alias("turn", "m"))
    said = turns.where((F.lower(_text_of(F.col("m"), ("role",))) == "assistant") & oj.is_text(F.col("m")["content"])).select("record_id", "turn", oj.text(F.col("m")["content"]).alias("text"))
    marked = F.col("text").contains("Reasoning:") | F.col("text").contains("Action:") | F.col("text").contains("Step:")
    keyed = said.withColumn("record_id", F.struct("record_id", "turn"))
    written = steps_of_text(keyed.where(marked)).select(F.col("record_id.record_id"), F.col("record_id.turn").alias("turn"), F.col("pos").alias("at"), "step_index", "thought", "action", "cues", "clickable", "page_title", "focused")
    none = F.array().cast(_TEXTS)
    plain = said.where(~marked).select("record_id", "turn", F.lit(0).alias("at"), F.col("turn").cast("long").alias("step_index"), tx.trim_text(F.col("text"), 1200).alias("thought"), F.lit("").alias("action"), none.alias("cues"), none.alias("clickable"), F.lit("").alias("page_title"), F.lit("").alias("focused"))
    both = written.unionByName(plain)
    pos = F.row_number().over(Window.partitionBy("record_id").orderBy("turn", "at")) - 1
    blank = [F.lit("").alias(c) for c in ("url", "screenshot", "source_key", "error_type", "error")]
    return both.select("record_id", pos.alias("pos"), "step_index", "thought", "action", "page_title", "focused", "clickable", "cues", *blank).withColumn("signature", action_signature("action"))


# Marks of the plain-text form of a trace.
BEFORE_STEPS, BEFORE_TREE = "The agent performed the following actions:", "The last accessibility tree is:"


def _step_fields(block: Column, at: Column) -> Column:
    """A step of a block of lines: its number, thought, last action and addresses."""
    lines = F.split(block, "\n")
    after = lambda x, mark: F.trim(F.substr(x, F.lit(len(mark) + 1)))
    marked = lambda mark: F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: after(x, mark))
    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("said"))

    def read(s: Column, x: Column) -> Column:
        begins, acts = x.startswith("Reasoning:"), x.startswith("Action:")
        words = F.when(begins, after(x, "Reasoning:")).when(s["open"] & ~acts & ~x.startswith("URL:"), x).otherwise("")
        return F.struct((begins | (s["open"] & ~acts)).alias("open"), F.concat_ws(" ", F.nullif(s["said"], F.lit("")), F.nullif(words, F.lit(""))).alias("said"))

    number = F.nullif(F.regexp_extract(F.get(lines, F.lit(0)), r"Step:\s*(\d+)", 1), F.lit(""))
    return F.struct(
        F.coalesce(number.try_cast("long"), at.cast("long")).alias("step_index"),
        tx.trim_text(F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), start, read, lambda s: s["said"]), 1200).alias("thought"),
        F.coalesce(F.try_element_at(marked("Action:"), F.lit(-1)), F.lit("")).alias("action"),
        F.transform(marked("URL:"), lambda u: F.concat(F.lit("url: "), u)).alias("cues"),
    )


def _tree_snapshot(tree: Column) -> Column:
    return tx.let(cu.best_cues(tree), lambda c: F.struct(F.slice(c, 1, 24).alias("cues"), F.filter(c, lambda x: cu.any_of(F.lower(x), cu.CLICKABLE)).alias("clickable"), _title(c).alias("page_title")))


def steps_of_text(texts: DataFrame, record_id: str = "record_id", text: str = "text") -> DataFrame:
    """Steps written as lines of Step:, URL:, Action: and Reasoning:, one row each.

    Steps lie after the opening sentence, where there is one, and before the last tree, whose
    best lines become cues of the last step. Lines before the first step, blank ones and rules are
    left out; a text without steps (or null) has no rows.
    """
    ship(texts.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    opened = F.locate(BEFORE_STEPS, whole)
    body = F.when(opened > 0, F.substr(whole, opened + len(BEFORE_STEPS))).otherwise(whole)
    closed = F.locate(BEFORE_TREE, body)
    body = F.when(closed > 0, F.substr(body, F.lit(1), closed - 1)).otherwise(body)
    tree_at = F.locate(BEFORE_TREE, whole)
    tree = F.when(tree_at > 0, F.trim(F.substr(whole, tree_at + len(BEFORE_TREE)))).otherwise("")
    lines = F.filter(F.transform(tx.split_lines(body), tx.strip), lambda x: (x != "") & (x != "-----"))
    blocks = F.filter(F.split(F.array_join(lines, "\n"), r"(?m)\n?^(?=Step:)"), lambda b: b.startswith("Step:"))
    steps = F.transform(F.transform(blocks, lambda b: F.rtrim(b)), _step_fields)
    rows = texts.select(record_id, tree.alias("tree"), steps.alias("steps")).select(record_id, "tree", F.size("steps").alias("n"), F.posexplode("steps").alias("pos", "s"))
    ends = (F.col("pos") == F.col("n") - 1) & (F.col("tree") != "")
    out = rows.withColumn("seen", F.when(ends, _tree_snapshot(F.col("tree"))))
    none = F.array().cast("array<string>")
    out = out.select(
        record_id, "pos", "s.step_index", "s.thought", "s.action", tx.ordered_distinct(F.concat("s.cues", F.coalesce("seen.cues", none))).alias("cues"), tx.ordered_distinct(F.coalesce("seen.clickable", none)).alias("clickable"),
        F.coalesce("seen.page_title", F.lit("")).alias("page_title"), ends.alias("ends"),
    ).withColumn("signature", action_signature("action"))
    focused = F.when(F.col("ends"), F.col("signature.target_bid")).otherwise("")
    return out.select(record_id, "pos", "step_index", "thought", "action", "signature", "cues", "clickable", "page_title", focused.alias("focused"))
