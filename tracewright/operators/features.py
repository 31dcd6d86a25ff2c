"""Flat texts of open records, kinds of events, features of traces, and compact timelines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import open_json as oj
from ..functions import outcome as oc
from ..functions import text as tx
from ..session import ship

# Keys that a flat text tells first, names of tools, and limits of a timeline.
FIRST_KEYS = ("role", "type", "event", "thought", "action", "tool", "tool_name", "tool_input", "observation", "tool_output", "error", "content", "message", "state", "state_change", "result")
TOOL_KEYS = ("tool", "tool_name", "name", "function")
MOST_STEPS, MOST_THOUGHT, MOST_ACTION, MOST_CUES, CUE_WIDTH = 160, 900, 1200, 24, 320
SIGNATURE_EVENTS, SUMMARY = 120, 1000


def flat_lines(value, depth: int = 8, name: str = "") -> list[str]:
    """A nested value as lines of key: text, keys that matter first, down to a depth; what lies deeper is JSON."""
    if value is None or value == "":
        return []
    if not isinstance(value, dict | list) or depth <= 0:
        said = value if isinstance(value, str) else str(value) if isinstance(value, bool | int | float) else json.dumps(value, ensure_ascii=False)
        return [f"{name}: {said}" if name else said]
    if isinstance(value, list):
        return [line for x in value for line in flat_lines(x, depth - 1, name)]
    keys = [k for k in FIRST_KEYS if k in value] + [k for k in value if k not in FIRST_KEYS]
    return [line for k in keys for line in flat_lines(value[k], depth - 1, k)]


def flat_text(v: Column, depth: int = 8) -> Column:
    """flat_lines of a variant."""

    @F.pandas_udf("string")
    def flat(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: "\n".join(flat_lines(json.loads(t), depth)), na_action="ignore")

    return flat(F.to_json(F.array(v)))


def trace_events(records: DataFrame) -> DataFrame:
    """(record_id, at, kind, role, tool_name, summary, n_chars) of every event of a trace."""
    ship(records.sparkSession)
    each = records.select("record_id", F.posexplode("trace").alias("at", "e")).withColumn("text", flat_text(F.col("e"), 4)).withColumn("m", oj.as_map(F.col("e")))
    m = F.col("m")
    inner = lambda k: oj.text(oj.as_map(m[k])["name"])
    tool = F.coalesce(*[F.nullif(F.trim(F.coalesce(F.when(oj.is_text(m[k]), oj.text(m[k])), inner(k))), F.lit("")) for k in TOOL_KEYS], F.lit(""))
    return each.select(
        "record_id", "at", oc.event_kind(F.col("text"), F.transform(F.map_keys(m), F.lower)).alias("kind"), F.trim(F.coalesce(oj.text(m["role"]), F.lit(""))).alias("role"), F.coalesce(tool, F.lit("")).alias("tool_name"),
        tx.trim_text(F.col("text"), SUMMARY).alias("summary"), F.length("text").alias("n_chars"),
    )


def trace_features(events: DataFrame) -> DataFrame:
    """Counts of kinds, tools, a signature of the first kinds and the size of each record's events."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    used = F.col("tool_name") != ""
    in_order = F.array_sort(F.collect_list(F.struct("at", "kind")))
    out = events.groupBy("record_id").agg(
        F.count("*").alias("num_events"), n("Action").alias("num_actions"), n("Obs").alias("num_observations"), n("StateChange").alias("num_state_changes"), n("ToolCall").alias("num_tool_calls"), n("ErrorRecovery").alias("num_error_recoveries"),
        F.array_sort(F.collect_set(F.when(used, F.col("tool_name")))).alias("tool_names"), F.count_if(used).alias("tool_call_count"), in_order.alias("kinds"), F.sum("n_chars").alias("trace_chars"),
    )
    signature = F.array_join(F.transform(F.slice("kinds", 1, SIGNATURE_EVENTS), lambda x: x["kind"]), " -> ")
    return out.withColumns({"strategy_signature": signature, "has_error_recovery": F.col("num_error_recoveries") > 0}).drop("kinds")


def timeline(events: DataFrame) -> DataFrame:
    """(record_id, items) of events (record_id, pos, index, thought, action, url, error, cues): events of one step, whose number is before the dot, make an item.

    An event that only shows something joins the item before it where that is of the same step,
    else the next one. Up to 160 items.
    """
    in_order = Window.partitionBy("record_id").orderBy("pos")
    acts = (F.coalesce("action", F.lit("")) != "") | (F.coalesce("thought", F.lit("")) != "") | (F.coalesce("error", F.lit("")) != "")
    base = F.substring_index(F.coalesce("index", F.col("pos").cast("string")), ".", 1)
    marked = events.withColumns({"step": base, "acts": acts})
    before = F.last(F.when(F.col("acts"), F.col("step")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    started = F.coalesce(F.sum(F.col("acts").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    item = F.when(F.col("acts"), started).when(F.col("step") == before, started).otherwise(started + 1)
    placed = marked.withColumn("item", item)
    last = lambda c, width: tx.one_line(F.coalesce(F.max(F.when(F.col("acts"), F.col(c))), F.lit("")), width)
    shown = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cues"))), lambda x: x["cues"]))
    cues = F.slice(F.transform(tx.ordered_distinct(shown), lambda c: tx.one_line(c, CUE_WIDTH)), 1, MOST_CUES)
    items = placed.groupBy("record_id", "item").agg(F.bool_or("acts").alias("acts"), F.max(F.when(F.col("acts"), F.col("step"))).alias("step"), last("thought", MOST_THOUGHT).alias("thought"), last("action", MOST_ACTION).alias("action"), F.max("url").alias("url"), last("error", MOST_THOUGHT).alias("error"), cues.alias("cues"))
    listed = F.array_sort(F.collect_list(F.struct("item", "step", "thought", "action", "url", "error", "cues")))
    return items.where("acts").groupBy("record_id").agg(F.slice(listed, 1, MOST_STEPS).alias("items"))


def final_state(items: Column) -> Column:
    """The last item with cues as text, else the last action."""
    seen = F.filter(items, lambda x: F.size(x["cues"]) > 0)
    return F.when(F.size(seen) > 0, F.array_join(F.element_at(seen, -1)["cues"], "\n")).otherwise(F.coalesce(F.try_element_at(items, F.lit(-1))["action"], F.lit("")))


def timeline_text(items: Column) -> Column:
    """A timeline as lines."""
    line = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c))
    one = lambda x: F.concat_ws("\n", F.concat(F.lit("step "), F.coalesce(x["step"], F.lit(""))), line("  thought: ", x["thought"]), line("  action: ", x["action"]), line("  url: ", x["url"]), line("  error: ", x["error"]), F.when(F.size(x["cues"]) > 0, F.concat(F.lit("  cues: "), F.array_join(x["cues"], " | "))))
    return F.array_join(F.transform(items, one), "\n")


def cluster_text(task: Column, outcome: Column, features: Column, timeline: Column) -> Column:
    """A document for clustering: the task, the outcome, the tools, the signature and the timeline."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", part("task", task), part("outcome", outcome), part("tools", F.array_join(features["tool_names"], ", ")), part("strategy", features["strategy_signature"]), part("trace", timeline))


def keywords(rows: DataFrame, key: str, text: str, k: int = 8, none: str | None = "misc", cjk: bool = True) -> DataFrame:
    """(key, token, n, rank_no): the k most frequent tokens of each text, the first seen of equals; where there are none, the word given for that, or no row."""
    explode = F.posexplode if none is None else F.posexplode_outer
    each = rows.select(key, explode(tx.tokens(F.coalesce(F.col(text), F.lit("")), cjk)).alias("at", "token"))
    counts = each.groupBy(key, F.coalesce("token", F.lit(none)).alias("token")).agg(F.count("*").alias("n"), F.min("at").alias("at"))
    ranked = counts.withColumn("rank_no", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "at")).cast("long"))
    return ranked.where(F.col("rank_no") <= k).drop("at")


