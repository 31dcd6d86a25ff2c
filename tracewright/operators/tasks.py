"""Benchmark tasks: annotations, task metadata under several names, and task families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug

# Openings of a task's name that name its action, in order of priority.
ACTIONS = (
    "multi-chart", "dashboard-retrieve", "filter", "sort", "navigate-and-create", "navigate-and-order", "navigate-and-filter", "navigate-and-sort",
    "infeasible-navigate-and-create", "infeasible-navigate-and-order", "infeasible-navigate-and-filter", "infeasible-navigate-and-sort",
    "date-based", "off-board", "on-board", "get-warranty", "work-assignment", "priority-assignment",
)
# Variants of a task's name, the names of their plain forms, and the fields that make a family.
VARIANTS = r"\.(resized|improved)\."
SITE_BENCHMARKS = ("webarena", "visualwebarena")
NAME_PREFIX, LEVEL_SUFFIX = r"^workarena\.servicenow\.", r"-l\d+$"
META = ("task_name", "category", "sites", "eval_types", "difficulty", "time_dependency", "browsergym_split")


def plain_id(task_id: Column) -> Column:
    """A task's name without the marks of its variants."""
    return F.regexp_replace(F.coalesce(task_id, F.lit("")), VARIANTS, ".")


def action_family(name: Column) -> Column:
    """The known opening of a name, else its first three parts between hyphens; empty for an empty name."""
    out = F.array_join(F.slice(F.split(name, "-"), 1, 3), "-")
    for opening in reversed(ACTIONS):
        out = F.when(name.startswith(opening), opening).otherwise(out)
    return out


def task_family(benchmark: Column, task_id: Column, meta: dict[str, Column]) -> Column:
    """The family of a task, from its benchmark's fields where it has them, else from its name.

    meta maps names of META to columns; null and missing fields count as empty.
    """
    field = lambda k: F.trim(F.coalesce(meta.get(k, F.lit(None)).cast("string"), F.lit("")))
    filled = lambda c: F.nullif(c, F.lit(""))
    of, plain = F.coalesce(filled(benchmark), F.lit("unknown")), plain_id(task_id)
    by_name = F.coalesce(filled(F.regexp_replace(plain, r"\.\d+$", "")), of)
    name = F.regexp_replace(F.regexp_replace(F.coalesce(filled(field("task_name")), plain), NAME_PREFIX, ""), LEVEL_SUFFIX, "")
    by_action = F.array_join(F.array(of, filled(field("category")), filled(action_family(name))), ":")
    sites, checks = filled(slug(field("sites"))), filled(slug(field("eval_types")))
    by_site = F.concat_ws(":", of, F.coalesce(sites, F.lit("unknown_site")), F.coalesce(checks, F.lit("unknown_eval")))
    kinds = [filled(slug(field(k))) for k in ("browsergym_split", "difficulty", "time_dependency")]
    return (
        F.when(of == "workarena", F.when((field("category") == "") & (name == ""), "workarena:").otherwise(by_action))
        .when(of.isin(*SITE_BENCHMARKS) & (sites.isNotNull() | checks.isNotNull()), by_site)
        .when((of == "assistantbench") & F.coalesce(*kinds).isNotNull(), F.concat_ws(":", of, *kinds))
        .otherwise(by_name)
    )


def annotation_index(annotations: DataFrame) -> DataFrame:
    """Votes of each (benchmark, task_id, model_name): lists in order, their number, and those for success and failure."""
    keys = ["benchmark", "task_id", "model_name"]
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    asked = {k: low(f"trajectory_{k}") for k in ("success", "side_effect", "looping")}
    bad = asked["success"].contains("unsuccessful")
    lists = [F.array_sort(F.collect_list(v)).alias(f"trajectory_{k}_votes") for k, v in asked.items()]
    keyed = annotations.withColumns({k: F.coalesce(k, F.lit("")) for k in keys})
    return keyed.groupBy(*keys).agg(
        F.count("*").alias("annotation_count"), *lists, F.count_if(asked["success"].contains("successful") & ~bad).alias("success_vote_count"), F.count_if(bad).alias("failure_vote_count")
    )


def with_annotations(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records (benchmark, task_id, agent, …) with their votes; null where nobody voted."""
    return records.join(index.withColumnRenamed("model_name", "agent"), ["benchmark", "task_id", "agent"], "left")


def task_index(tasks: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """(name, meta, split, split_benchmark): a row for each name under which a task may be looked up.

    tasks has file (the table's stem), at (the row's place) and any of task_name, task_id and META.
    A row's own name goes before the other names of other rows; of own names the last row
    counts, of other names the first. Splits add names of their own.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in tasks.columns else F.lit("")
    own, number = F.coalesce(F.nullif(text("task_name"), F.lit("")), text("task_id")), text("task_id")
    meta = F.struct(*[F.nullif(text(k), F.lit("")).alias(k) for k in META])
    spot = F.struct("file", "at")
    rows = tasks.select(own.alias("own"), number.alias("number"), "file", spot.alias("spot"), meta.alias("meta")).where("own <> ''")
    named = F.when(F.col("number") != "", F.concat_ws(".", "file", "number"))
    others = F.array(F.nullif("number", F.lit("")), named, plain_id(F.col("own")))
    first = rows.groupBy(F.col("own").alias("name")).agg(F.max_by("meta", "spot").alias("own_meta"))
    rest = rows.select(F.explode(others).alias("name"), "spot", "meta").where("name IS NOT NULL").groupBy("name").agg(F.min_by("meta", "spot").alias("other_meta"))
    found = first.join(rest, "name", "full").select("name", F.coalesce("own_meta", "other_meta").alias("meta"))
    if splits is None:
        return found.withColumns({"split": F.lit(None).cast("string"), "split_benchmark": F.lit(None).cast("string")})
    by_split = splits.where("task_id <> ''").groupBy(F.col("task_id").alias("name")).agg(F.max(F.struct("split", "benchmark")).alias("s"))
    return found.join(by_split.select("name", "s.split", F.col("s.benchmark").alias("split_benchmark")), "name", "full")


def with_task_metadata(records: DataFrame, index: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Records (record_id, benchmark, task_id, …) with meta, split and task_family.

    The index is asked for a task's own name, then for its plain form; the first that is there counts.
    """
    names = F.array(F.col("task_id"), plain_id(F.col("task_id")))
    asked = records.select(record_id, F.posexplode(names).alias("__at", "name")).where("name <> ''")
    hit = asked.join(index, "name").groupBy(record_id).agg(F.min_by(F.struct("meta", "split", "split_benchmark"), "__at").alias("hit"))
    joined = records.join(hit, record_id, "left")
    fields = {k: F.col(f"hit.meta.{k}") for k in META}
    family = task_family(F.col("benchmark"), F.col("task_id"), fields)
    return joined.select(*[joined[c] for c in records.columns], F.col("hit.meta").alias("meta"), F.col("hit.split").alias("split"), family.alias("task_family"))
