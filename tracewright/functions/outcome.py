"""Outcome rules and other classifications, as expressions. The outcome rules differ on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SUCCESS, FAILURE, UNKNOWN = "success", "failure", "unknown"


# Words of outcomes, those found anywhere and those that are the whole cell.
FAILURE_WORDS = ("fail", "failed", "error", "incorrect", "wrong")
SUCCESS_WORDS = ("success", "succeed", "pass", "passed", "correct")
YES, NO = ("1", "true", "yes", "y"), ("0", "false", "no", "n")
WHOLE_SUCCESS = ("success", "succeeded", "pass", "passed", "correct")
WHOLE_FAILURE = ("failure", "failed", "fail", "incorrect", "wrong", "error")
# Words of severity, and its weights.
HIGH, LOW = ("high", "critical", "severe", "major", "important"), ("low", "minor", "small", "optional")
BANK_HIGH, BANK_LOW = ("high", "critical", "major", "important"), ("low", "minor", "optional")
WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.3}
# Types of errors, in the order in which they are looked for.
ERROR_TYPES = ("timeout", "notfound", "elementnotfound", "detached", "permission", "invalid", "blocked")


def _has(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _of(truth: Column) -> Column:
    return F.when(truth, SUCCESS).otherwise(FAILURE)


def _words(low: Column) -> Column:
    """By words anywhere, failure first; null without any."""
    return let(low, lambda t: F.when(_has(t, FAILURE_WORDS), FAILURE).when(_has(t, SUCCESS_WORDS), SUCCESS))


def outcome_by_words(*texts: Column, flags: Sequence[Column] = (), score: Column | None = None) -> Column:
    """Generic record: the first text that tells, then the first flag that is there, then a score from 0.5."""
    out = [_words(F.lower(t)) for t in texts] + [F.when(f.isNotNull(), _of(f)) for f in flags]
    if score is not None:
        out.append(F.when(score.isNotNull(), _of(score >= 0.5)))
    return F.coalesce(*out, F.lit(UNKNOWN))


def outcome_normalised(value: Column, number: Column | None = None) -> Column:
    """A cell: numbers (of that type) from 0.5, yes and no as whole words, then words anywhere.

    A flag comes as "true" or "false". Text such as "0.7" is no number.
    """
    by_word = lambda t: F.when(t.isin(*YES), SUCCESS).when(t.isin(*NO), FAILURE).otherwise(F.coalesce(_words(t), F.lit(UNKNOWN)))
    out = let(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), by_word)
    return out if number is None else F.when(number.isNotNull(), _of(number >= 0.5)).otherwise(out)


def outcome_by_votes(successes: Column, failures: Column, reward: Column, has_error: Column) -> Column:
    """Annotated record: votes (a tie succeeds), else a positive reward, else an error fails."""
    return (
        F.when((successes + failures) > 0, F.when(successes >= failures, SUCCESS).otherwise(FAILURE))
        .when(reward > 0, SUCCESS)
        .when(reward.isNotNull(), FAILURE)
        .when(has_error, FAILURE)
        .otherwise(UNKNOWN)
    )


def outcome_word(label: Column) -> Column:
    """A whole word of success or failure; unknown otherwise."""
    t = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit(""))))
    return F.when(t.isin(*WHOLE_SUCCESS), SUCCESS).when(t.isin(*WHOLE_FAILURE), FAILURE).otherwise(UNKNOWN)


def outcome_of_pair(*labels: Column, reward: Column | None = None) -> Column:
    """Pair stage: the first label that is a known word, then the reward above 0."""
    known = [F.nullif(outcome_word(c), F.lit(UNKNOWN)) for c in labels]
    paid = [] if reward is None else [F.when(reward.isNotNull(), _of(reward > 0))]
    return F.coalesce(*known, *paid, F.lit(UNKNOWN))


def outcome_of_sample(label: Column, reward: Column) -> Column:
    """Adapter: the label if there is one, else the reward."""
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.when(reward > 0, SUCCESS).when(reward.isNotNull(), FAILURE), F.lit(UNKNOWN))


def label_of(outcome: Column) -> Column:
    return F.when(outcome == SUCCESS, 1).when(outcome == FAILURE, 0)


def severity(c: Column, bank: bool = False) -> Column:
    """high, medium or low, by words; medium where none fits. The bank's rule knows fewer words and no blanks."""
    t = F.lower(F.coalesce(c, F.lit("")))
    high, low = (BANK_HIGH, BANK_LOW) if bank else (HIGH, LOW)
    t = t if bank else F.trim(t)
    return F.when(t.isin(*high), "high").when(t.isin(*low), "low").otherwise("medium")


def severity_weight(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low == "high", WEIGHTS["high"]).when(low == "low", WEIGHTS["low"]).otherwise(WEIGHTS["medium"])


def _within(c: Column, most: float = 1.0) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(0.0), c))


def score_of(c: Column) -> Column:
    """A number within 0 and 1; words of satisfaction are 1 ("not satisfied" too), of partial satisfaction 0.5, others 0."""
    t = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    words = F.when(_has(t, ["satisf", "pass"]), 1.0).when(_has(t, ["partial", "ambiguous"]), 0.5).otherwise(0.0)
    return _within(F.coalesce(F.trim(t).try_cast("double"), words))


def score_number(c: Column, most: float = 1.0) -> Column:
    """A number within 0 and the most; 0 for what is no number, whatever it says."""
    return _within(F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0)), most)


def error_type(message: Column) -> Column:
    """The first of the fixed tokens that the message holds; empty without a message."""

    def first(t: Column) -> Column:
        out = F.when(t == "", "")
        for w in ERROR_TYPES:
            out = out.when(t.contains(w), w)
        return out.otherwise(UNKNOWN)

    return let(F.lower(F.coalesce(message, F.lit(""))), first)


def skip_reason(successes: Column, failures: Column) -> Column:
    return F.when((successes > 0) & (failures > 0), F.lit(None)).when(successes > 0, "all_success").when(failures > 0, "all_failure").otherwise("no_success_or_failure")


# Keys and words that tell the kind of an event, in the order in which they are looked for.
KEYS_OF = {
    "ToolCall": ("tool", "tool_call", "tool_calls", "tool_input", "function_call"),
    "Obs": ("observation", "tool_output", "result", "output"),
    "StateChange": ("state", "state_change", "diff", "patch", "updated", "changes"),
    "Action": ("action", "thought", "plan", "assistant"),
}
RECOVERY_WORDS = ("recover", "retry", "fix", "exception", "traceback", "error")
WORDS_OF = {
    "ToolCall": ("tool:", "tool_call", "function_call"),
    "Obs": ("observation:", "tool_output", "result:"),
    "StateChange": ("state change", "patch", "diff", "updated"),
    "ErrorRecovery": RECOVERY_WORDS,
}


def event_kind(text: Column, keys: Column | None = None) -> Column:
    """ToolCall, Obs, StateChange, ErrorRecovery or Action: by an event's keys (lower case), then by words of its text."""

    def kind(t: Column) -> Column:
        out = F.lit("Action")
        for name, words in reversed(WORDS_OF.items()):
            out = F.when(_has(t, words), name).otherwise(out)
        if keys is None:
            return out
        holds = lambda name: F.arrays_overlap(keys, F.array(*map(F.lit, KEYS_OF[name])))
        named = F.when(holds("ToolCall"), "ToolCall").when(holds("Obs"), "Obs").when(holds("StateChange"), "StateChange")
        return F.coalesce(named, F.when(_has(t, RECOVERY_WORDS), "ErrorRecovery").when(holds("Action"), "Action"), out)

    return let(F.lower(F.coalesce(text, F.lit(""))), kind)


# Names and roles of cards, in order of priority; then openings of names.
CARD_ORDER = (
    ("task_context", "task_definition"), ("final_observation", "terminal_state_evidence"), ("output_or_answer", "final_response_evidence"),
    ("risk_signals", "negative_or_side_effect_evidence"), ("initial_observation", "initial_context"),
)
CARD_OPENINGS = ("action_transition", "evidence_observation")


def card_priority(state_id: Column, role: Column) -> Column:
    """0 for the task to 6 for observations, 7 for other cards."""
    name, as_role, out = F.lower(F.coalesce(state_id, F.lit(""))), F.lower(F.coalesce(role, F.lit(""))), F.lit(7)
    for i, opening in reversed(list(enumerate(CARD_OPENINGS, len(CARD_ORDER)))):
        out = F.when(name.startswith(opening), i).otherwise(out)
    for i, (n, r) in reversed(list(enumerate(CARD_ORDER))):
        out = F.when((name == n) | (as_role == r), i).otherwise(out)
    return out


# What evidence speaks of.
FACETS = {
    "has_url": ("url:",), "has_form_control": ("textbox", "combobox", "checkbox", "button"), "has_table_or_grid": ("table", "grid", "gridcell", "columnheader"),
    "has_image_reference": ("image",), "has_error_text": ("error", "failed", "unexpected", "invalid"),
}


def facets(text: Column) -> Column:
    """Five flags of what evidence speaks of."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.create_map(*[x for k, words in FACETS.items() for x in (F.lit(k), _has(t, words))]))
