"""Trees of benchmark runs: paths, records with annotations and task metadata, steps as events, observations within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import open_json as oj
from ..functions import outcome as oc
from ..functions.text import let
from ..operators import sequences, tasks
from .readers import Options, below, read_documents

# The folder of runs, the dataset's name, tables that are no task metadata, and how long an observation may be.
RUNS, DATASET, NO_TASKS = "cleaned", "agent-reward-bench", ("annotations", "splits")
POLICIES = ("none", "all", "last_and_errors", "last")
TREES = ("axtree_pruned", "axtree")


def run_fields(path: Column) -> list[Column]:
    """benchmark, agent, experiment and task_id of a path below the folder of runs; unknown where there are too few parts."""
    parts = F.split(path, "/")
    part = lambda i, other: F.when(F.size(parts) > i + 1, F.get(parts, F.lit(i))).otherwise(other)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return [part(0, "unknown").alias("benchmark"), part(1, "unknown").alias("agent"), part(2, "").alias("experiment"), stem.alias("task_id")]


def keeps_observation(policy: str, at: Column, last: Column, error: Column) -> Column:
    """Whether a step's observation is kept; an unknown policy keeps the last one's."""
    if policy not in POLICIES:
        policy = "last"
    if policy in ("none", "all"):
        return F.lit(policy == "all")
    return (at == last) | (error if policy == "last_and_errors" else F.lit(False))


def _object(**fields: Column) -> Column:
    """An object of the fields that have a value."""
    return F.parse_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))


def step_events(steps: Column, task: Column, options: Options) -> Column:
    """Events of raw steps: what each did, then its observation and its error, where they are kept.

    A step that is no object is an event of content. Numbers name the events: n, n.obs, n.error.
    """
    text = lambda m, k: F.coalesce(oj.text(m[k]), F.lit(""))

    def of(v: Column, at: Column, n: Column) -> Column:
        def events(m: Column) -> Column:
            number = F.coalesce(oj.text(m["num"]), at.cast("string"))
            failed = oj.truthy(m["last_action_error"])
            tree = F.coalesce(*[F.when(oj.is_text(m[k]) & (F.trim(oj.text(m[k])) != ""), F.struct(oj.text(m[k]).alias("text"), F.lit(k).alias("key"))) for k in TREES])
            did = _object(index=number, thought=text(m, "reasoning"), action=text(m, "action"), url=text(m, "url"), focused_element=text(m, "focused_element"), screenshot_path=text(m, "screenshot_path"))
            terms = sequences.relevance_terms(task, *[text(m, k) for k in ("action", "url", "focused_element", "last_action_error")])
            plain = lambda g: F.substring(F.array_join(F.flatten(F.transform(g, lambda s: F.concat(F.array(F.concat(F.lit("["), s["section"], F.lit("]"))), s["cues"]))), "\n"), 1, options.observation_chars)
            seen = lambda t: let(sequences.observation_segments(t["text"], terms, options.observation_chars), lambda g: _object(
                index=F.concat(number, F.lit(".obs")), observation=plain(g), observation_segments=g, observation_source=t["key"],
                observation_char_budget=F.lit(options.observation_chars), observation_policy=F.lit("head_relevant_tail"), url=text(m, "url"), screenshot_path=text(m, "screenshot_path"),
            ))
            kept = keeps_observation(options.observation_policy, at, n - 1, failed) & F.lit(options.observation_chars > 0)
            shown = F.when(kept, let(tree, lambda t: F.when(t.isNotNull(), seen(t))))
            wrong = F.when(failed, _object(index=F.concat(number, F.lit(".error")), error=text(m, "last_action_error"), action=text(m, "action")))
            return F.array_compact(F.array(did, shown, wrong))

        other = F.array(_object(index=at.cast("string"), content=oj.text(v)))
        return let(oj.as_map(v), lambda m: F.when(m.isNotNull(), events(m)).otherwise(other))

    none = F.array().cast("array<variant>")
    return let(F.coalesce(oj.as_list(steps), none), lambda x: F.flatten(F.transform(x, lambda v, i: of(v, i, F.size(x)))))


def response_messages(response: Column) -> Column:
    """The chat of a model's response: its messages, else the first choice's message, else the response itself."""
    m = oj.as_map(response)
    choice = oj.as_map(oj.as_map(F.get(oj.as_list(m["choices"]), F.lit(0)))["message"])
    one = F.parse_json(F.to_json(F.array(F.struct(F.coalesce(oj.text(choice["role"]), F.lit("assistant")).alias("role"), F.coalesce(choice["content"], F.parse_json(F.lit('""'))).alias("content")))))
    return F.coalesce(F.when(~F.is_variant_null(m["chat_messages"]), m["chat_messages"]), F.when(choice.isNotNull(), one), response)


def normalise_runs(runs: DataFrame, annotations: DataFrame | None = None, index: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """Raw runs (source_path, relative_source_path, v) as canonical records, with their votes and their task's metadata and family.

    Votes decide the outcome, then the reward, then an error. Runs without steps are left out;
    what could not be read is a record with load_error.
    """
    options = options or Options()
    m = F.col("m")
    fields = run_fields(F.regexp_replace("relative_source_path", f"^(.*/)?{RUNS}/", ""))
    named = runs.withColumn("m", oj.as_map(F.col("v"))).select("*", *[f.alias(f"path_{n}") for f, n in zip(fields, ("benchmark", "agent", "experiment", "task_id"), strict=True)])
    error = F.when(m.isNull(), F.concat(F.lit("no JSON object: "), "source_path"))
    own = lambda k: F.when(m.isNull(), F.col(f"path_{k}")).otherwise(F.coalesce(oj.text(m[k]), F.lit(""))).alias(k)
    rows = named.where(m.isNull() | F.map_contains_key(m, "steps")).select(
        "source_path", "relative_source_path", "m", own("benchmark"), own("agent"), own("experiment"), F.col("path_task_id").alias("task_id"), error.alias("load_error"), oj.as_map(m["summary_info"]).alias("summary"),
    )
    rows = rows.withColumn("record_id", F.concat_ws("/", "benchmark", "agent", "experiment", "task_id"))
    votes = ["success_vote_count", "failure_vote_count", "annotation_count"]
    if annotations is not None:
        rows = tasks.with_annotations(rows, tasks.annotation_index(annotations).select("benchmark", "task_id", "model_name", *votes))
    else:
        rows = rows.withColumns({v: F.lit(None).cast("long") for v in votes})
    if index is not None:
        rows = tasks.with_task_metadata(rows, index)
    else:
        rows = rows.withColumns({"meta": F.lit(None).cast("string"), "split": F.lit(None).cast("string"), "task_family": tasks.task_family(F.col("benchmark"), F.col("task_id"), {})})
    s, zero = F.col("summary"), F.lit(0)
    failed = oj.truthy(s["err_msg"]) | oj.truthy(s["stack_trace"])
    outcome = oc.outcome_by_votes(F.coalesce("success_vote_count", zero), F.coalesce("failure_vote_count", zero), oj.number(oj.pick_present(s, ("cum_reward", "cum_raw_reward"))), F.coalesce(failed, F.lit(False)))
    task = F.trim(F.coalesce(oj.text(m["goal"]), F.lit("")))
    told = F.struct(
        F.lit(DATASET).alias("dataset"), "benchmark", "agent", oj.text(m["model"]).alias("model"), "experiment", "task_id", "task_family", m["seed"].alias("seed"), m["valid"].alias("valid"), m["summary_info"].alias("summary_info"),
        F.struct(*votes).alias("annotation"), F.col("meta").alias("task_metadata"), "split", "source_path", "relative_source_path",
    )
    chat = F.coalesce(m["chat_messages"], response_messages(m["response"])) if options.include_chat else F.lit(None).cast("variant")
    return rows.select(
        "record_id", task.alias("task"), F.when(F.col("load_error").isNotNull(), oc.UNKNOWN).otherwise(outcome).alias("outcome"), F.coalesce(step_events(m["steps"], task, options), F.array().cast("array<variant>")).alias("trace"),
        oj.as_map(F.parse_json(F.to_json(told))).alias("metadata"), chat.alias("chat_messages"), F.array_sort(F.map_keys(m)).alias("source_keys"), "load_error", "source_path",
    )


def balanced(records: DataFrame, n: int, limit: int | None = None, seed: int = 13) -> DataFrame:
    """Up to n records of each benchmark and outcome by a seeded hash, then the first by path up to a limit."""
    of = oj.text(F.col("metadata")["benchmark"])
    at = F.row_number().over(Window.partitionBy("__benchmark", "outcome").orderBy(F.xxhash64(F.lit(seed), "record_id"), "record_id"))
    kept = records.withColumn("__benchmark", of).withColumn("__at", at).where(F.col("__at") <= n).drop("__at", "__benchmark")
    return kept.orderBy("source_path").limit(limit) if limit is not None else kept


def read_benchmark(spark: SparkSession, root: str, annotations: DataFrame | None = None, index: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """Canonical records of all runs below a root that holds the folder of runs."""
    options = options or Options()
    whole = read_documents(spark, f"{root.rstrip('/')}/{RUNS}", "*.json", True)
    runs = whole.select("source_path", below(F.col("source_path"), root).alias("relative_source_path"), F.try_parse_json("value").alias("v"))
    out = normalise_runs(runs, annotations, index, options)
    if options.sample_per_bucket is not None:
        return balanced(out, options.sample_per_bucket, options.limit, options.sample_seed)
    return out.orderBy("source_path").limit(options.limit) if options.limit is not None else out
