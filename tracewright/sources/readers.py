"""Readers of raw traces (JSON, JSONL, YAML, CSV, trees) as open records, and their canonical form."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import open_json as oj
from ..functions import outcome as oc
from ..functions.text import let

# Keys in order of priority, what may contain records, and keys that are no metadata.
TASK_KEYS = ("task", "question", "prompt", "instruction", "goal", "user_request", "query")
OUTCOME_KEYS = ("outcome", "label", "status", "result", "success", "passed", "is_success", "correct", "score")
TRACE_KEYS = ("trace", "trajectory", "messages", "steps", "events", "conversation", "log")
ID_KEYS = ("__record_id__", "record_id", "trace_id", "sample_id", "id", "case_id", "episode_id")
STABLE_ID_KEYS = ("__record_id__", "id", "trace_id", "sample_id", "record_id")
STEP_KEYS = ("step", "step_index", "event_index", "turn", "turn_index", "timestep")
CONTAINERS = ("traces", "records", "items", "data", "examples", "episodes")
NOT_METADATA = ("chat_messages", "response", "trajectory_info", "raw_input")
SUFFIXES = {"json": "json", "jsonl": "jsonl", "yaml": "yaml", "yml": "yaml", "csv": "csv"}
# Fields of an event by the columns that they come from, the last filled one first.
EVENT_FIELDS = {
    "role": ("role",), "content": ("message", "content"), "thought": ("thought",), "action": ("action",), "observation": ("obs", "observation"),
    "tool": ("tool_name", "tool"), "tool_input": ("tool_input",), "tool_output": ("tool_output",), "error": ("error",), "state": ("state",), "state_change": ("state_change",),
}


@dataclass(frozen=True)
class Options:
    """How records are read: own key names, the CSV column of ids, and limits for all files together."""

    field_map: Mapping[str, str] = field(default_factory=dict)
    group_by: str | None = None
    limit: int | None = None
    include_chat: bool = False
    observation_chars: int = 1200
    observation_policy: str = "last"
    sample_per_bucket: int | None = None
    sample_seed: int = 13


def format_of(path: str, fmt: str | None = None) -> str:
    """The named format, or that of the suffix; a path without one is a folder of files."""
    found = fmt or SUFFIXES.get(path.rsplit(".", 1)[-1].lower()) or ("folder" if "." not in path.rstrip("/").rsplit("/", 1)[-1] else None)
    if found not in ("json", "jsonl", "yaml", "csv", "tree", "folder"):
        raise ValueError(f"no reader for {path!r}")
    return found


def unwrap(files: DataFrame) -> DataFrame:
    """(source_path, at, v): the records in documents (source_path, v): a list, the list under a known key, or itself.

    What is no object becomes the trace of one.
    """
    m = oj.as_map(F.col("v"))
    inner = F.coalesce(oj.as_list(F.col("v")), *[oj.as_list(m[k]) for k in CONTAINERS], F.array("v"))
    each = files.select("source_path", F.posexplode(inner).alias("at", "x"))
    wrapped = F.parse_json(F.concat(F.lit('{"trace":'), F.to_json("x"), F.lit("}")))
    return each.select("source_path", F.col("at").cast("long").alias("at"), F.when(oj.as_map(F.col("x")).isNull(), wrapped).otherwise(F.col("x")).alias("v"))


def read_documents(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    """(source_path, value): whole files."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern) if pattern else spark.read
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")


def read_records(spark: SparkSession, path: str, fmt: str | None = None, limit: int | None = None, options: Options | None = None) -> DataFrame:
    """(source_path, at, v) of raw records; at is a record's place in its file.

    A document that is no JSON is an error; `tree`, all JSON files below a folder, gives a record
    with load_error in its place, and so do readers of many files. `folder` reads the JSON, JSONL,
    YAML and CSV files of one folder. A limit takes the first records by path and place.
    """
    kind, options = format_of(path, fmt), options or Options()
    limit = limit if limit is not None else options.limit
    if kind == "csv":
        out = read_csv_records(spark, path, options.group_by)
    elif kind == "folder":
        found = [read_json_lines(spark, path, "*.jsonl"), unwrap(_parsed(read_documents(spark, path, "*.json"), False)), unwrap(_parsed(read_documents(spark, path, "*.{yaml,yml}"), True))]
        for csv in csv_files(spark, path):
            found.append(read_csv_records(spark, csv, options.group_by))
        out = reduce(DataFrame.unionByName, found)
    elif kind == "jsonl":
        out = read_json_lines(spark, path)
    elif kind == "tree":
        whole = read_documents(spark, path, "*.json", True)
        parsed = whole.select("source_path", F.try_parse_json("value").alias("v"))
        bad = F.parse_json(F.to_json(F.struct(F.concat(F.lit("no JSON: "), "source_path").alias("load_error"))))
        out = unwrap(parsed.select("source_path", F.coalesce("v", bad).alias("v")))
    else:
        out = unwrap(_parsed(read_documents(spark, path, ""), kind == "yaml"))
    return out.orderBy("source_path", "at").limit(limit) if limit else out


def _parsed(files: DataFrame, yaml: bool) -> DataFrame:
    return files.select("source_path", F.parse_json(_yaml_as_json(F.col("value")) if yaml else F.col("value")).alias("v"))


def read_json_lines(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """Records of lines; blank lines are left out, a bad one is an error. at counts the lines of a file by their order in it."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("spot"), "value")
    lines = lines.where(F.trim("value") != "")
    place = F.row_number().over(Window.partitionBy("source_path").orderBy("block", "spot")) - 1
    return lines.select("source_path", place.cast("long").alias("at"), F.parse_json("value").alias("v"))


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The CSV files of a folder, by name; each has a header of its own."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").distinct()
    return sorted(r[0] for r in found.collect())


def _yaml_as_json(c: Column) -> Column:
    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML traces need PyYAML") from e
        return texts.map(lambda t: json.dumps(yaml.safe_load(t), default=str))

    return convert(c)


def step_order(m: Column) -> Column:
    """(number, text) of the first step column that is filled; what is no whole number is 0."""
    value = F.coalesce(*[F.nullif(m[k], F.lit("")) for k in STEP_KEYS], F.lit(""))
    return F.struct(F.coalesce(F.trim(value).try_cast("long"), F.lit(0)).alias("n"), value.alias("text"))


def read_csv_records(spark: SparkSession, path: str, group_by: str | None = None) -> DataFrame:
    """CSV rows as records with typed cells; where ids repeat and a step column exists, rows of an id are its events in order.

    The first event's row gives the record's other fields.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {c: c.lstrip("\ufeff") for c in rows.columns}
    m = F.map_from_arrays(F.array(*[F.lit(n) for n in names.values()]), F.array(*[F.col(f"`{c}`") for c in names]))
    # rows of a multi-line file come in one partition each file, so that the number follows their order
    rows = rows.select(m.alias("m"), F.monotonically_increasing_id().alias("spot"))
    key = group_by or next((k for k in ID_KEYS if k in names.values()), None)
    typed = lambda c: F.map_filter(F.transform_values(c, lambda _, x: typed_cell(x)), lambda _, x: x.isNotNull())
    has_steps = any(k in names.values() for k in STEP_KEYS)
    if key and (group_by or (has_steps and rows.groupBy(F.col("m")[key]).count().where("count > 1").take(1))):
        event = F.struct(step_order(F.col("m")).alias("o"), "spot", F.map_entries("m").alias("m"))  # entries have an order, maps none
        grouped = rows.groupBy(F.coalesce(F.col("m")[key], F.lit("")).alias("id")).agg(F.array_sort(F.collect_list(event)).alias("x"), F.min("spot").alias("spot"))
        events = F.transform("x", lambda e: event_of(typed(F.map_from_entries(e["m"]))))
        first = F.map_filter(typed(F.map_from_entries(F.get("x", F.lit(0))["m"])), lambda k, _: ~k.isin("__record_id__", "trace"))
        more = F.map_from_arrays(F.array(F.lit("__record_id__"), F.lit("trace")), F.array(typed_text(F.col("id")), F.parse_json(F.to_json(events))))
        out = grouped.select("spot", F.parse_json(F.to_json(F.map_concat(first, more))).alias("v"))
    else:
        out = rows.select("spot", F.parse_json(F.to_json(typed(F.col("m")))).alias("v"))
    return out.select(F.lit(path).alias("source_path"), F.col("spot").alias("at"), "v")


def typed_text(c: Column) -> Column:
    """A text as a value."""
    return F.try_variant_get(F.parse_json(F.to_json(F.create_map(F.lit("x"), c))), "$.x", "variant")


def typed_cell(c: Column) -> Column:
    """A cell as a value: blank ones are empty texts, JSON lists and objects, flags and numbers are what they say, others texts."""
    whole, part = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

    def value(t: Column) -> Column:
        said = F.when(t.rlike(r"^[\[{]"), F.try_parse_json(t)).when(F.lower(t).isin("true", "false"), F.try_parse_json(F.lower(t)))
        counted = F.when(t.rlike(whole), F.try_parse_json(t.try_cast("long").cast("string"))).when(t.rlike(part), F.try_parse_json(t.try_cast("double").cast("string")))
        return F.when(t == "", F.parse_json(F.lit('""'))).otherwise(F.coalesce(said, counted, typed_text(c)))

    return F.when(c.isNotNull(), let(F.trim(c), value))


def event_of(m: Column) -> Column:
    """A row's fields as those of an event; the whole row where it has none. Filled ones only."""
    named = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, EVENT_FIELDS)), F.array(*[oj.pick(m, keys) for keys in EVENT_FIELDS.values()])), lambda _, x: x.isNotNull())
    return let(named, lambda x: F.when(F.size(x) > 0, x).otherwise(m))


def trace_of(m: Column) -> Column:
    """The list of events under the first trace key: a list, a text that holds one, the list in an object, or the value as one event."""
    none = F.array().cast("array<variant>")
    content = lambda v: F.parse_json(F.to_json(F.create_map(F.lit("content"), oj.text(v))))

    def events(v: Column) -> Column:
        nested = lambda inner: F.coalesce(*[oj.as_list(inner[k]) for k in TRACE_KEYS], F.when(inner.isNotNull(), F.array(v)))
        return F.coalesce(oj.as_list(v), let(oj.as_map(v), nested), F.when(oj.filled(v), F.array(content(v))), none)

    given = let(oj.pick_present(m, TRACE_KEYS), lambda raw: F.coalesce(F.when(~F.is_variant_null(raw), raw), oj.as_object(event_of(m))))
    value = let(given, lambda v: F.when(oj.is_text(v), let(F.try_variant_get(v, "$", "string"), typed_cell)).otherwise(v))
    return let(value, events)


def canonical(records: DataFrame, options: Options | None = None) -> DataFrame:
    """record_id, task, outcome, trace (array of variants), metadata (map of variants), chat_messages, source_keys, load_error, source_path.

    Each comes from the first of its keys that is filled, own names first. Records without an id
    are named by their place and a digest.
    """
    options = options or Options()
    m = F.col("m")
    own = lambda what, keys: ((options.field_map[what],) if options.field_map.get(what) else ()) + keys
    made = F.concat(F.lit("record_"), F.lpad(F.col("at").cast("string"), 6, "0"), F.lit("_"), F.substring(F.sha1(F.encode(F.to_json("v"), "UTF-8")), 1, 12))
    label = oj.pick(m, own("outcome", OUTCOME_KEYS))
    known = [*ID_KEYS, *TASK_KEYS, *OUTCOME_KEYS, *TRACE_KEYS, *STEP_KEYS, *NOT_METADATA]
    trace = m if not options.field_map.get("trace") else F.map_concat(F.map_filter(m, lambda k, _: ~k.isin(*TRACE_KEYS)), F.create_map(F.lit(TRACE_KEYS[0]), m[options.field_map["trace"]]))
    return records.withColumn("m", oj.as_map(F.col("v"))).select(
        F.coalesce(oj.text(oj.pick(m, own("__record_id__", ID_KEYS))), *[F.when(~F.is_variant_null(m[k]), oj.text(m[k])) for k in STABLE_ID_KEYS], made).alias("record_id"),
        F.coalesce(oj.text(oj.pick(m, own("task", TASK_KEYS))), F.lit("")).alias("task"),
        oc.outcome_normalised(oj.text(label), oj.number(label)).alias("outcome"),
        trace_of(trace).alias("trace"),
        F.map_filter(m, lambda k, _: ~k.isin(*known)).alias("metadata"),
        (m["chat_messages"] if options.include_chat else F.lit(None).cast("variant")).alias("chat_messages"),
        F.array_sort(F.map_keys(m)).alias("source_keys"),
        oj.text(m["load_error"]).alias("load_error"),
        "source_path",
    )


def path_fields(path: Column) -> list[Column]:
    """domain, model_name, job_with_model, jobname from the first three parts and the last part of a relative path; null where there are fewer than four."""
    parts = F.split(F.regexp_replace(path, r"^/+", ""), "/")
    part = lambda c: F.when(F.size(parts) >= 4, c)
    return [part(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(("domain", "model_name", "job_with_model"))] + [F.regexp_replace(part(F.element_at(parts, -1)), r"\.[^.]*$", "").alias("jobname")]


def below(path: Column, root: str) -> Column:
    """A path as written below a root, whatever scheme either has."""
    plain = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    base = plain(F.lit(root.rstrip("/") + "/"))
    at = F.locate("\u0000", F.replace(plain(path), base, F.lit("\u0000")))
    return F.when(at > 0, F.substring_index(F.replace(plain(path), base, F.lit("\u0000")), "\u0000", -1)).otherwise(F.substring_index(path, "/", -1))


def with_selected(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with the record of the same id and path, else the file's first, else a stub with load_error: joins, no reading by row."""
    exact = records.select("source_path", "record_id", F.col("v").alias("exact"))
    first = records.groupBy("source_path").agg(F.min_by("v", "at").alias("first"))
    both = pairs.join(exact, ["source_path", "record_id"], "left").join(first, "source_path", "left")
    missing = F.concat(F.lit("missing source_path: "), F.coalesce("source_path", F.lit("")))
    stub = F.parse_json(F.to_json(F.struct(F.col("record_id").alias("__record_id__"), missing.alias("load_error"))))
    return both.withColumn("record", F.coalesce("exact", "first", stub)).drop("exact", "first")
