"""Groups of candidates, one success and one failure of each, reports and summaries; keyed tables."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import outcome as oc
from ..functions.text import first_text


def group_counts(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, candidate_count, n_success, n_failure, n_unknown, skip_reason (null where a pair exists)."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    out = candidates.groupBy(*keys).agg(F.count("*").alias("candidate_count"), n(oc.SUCCESS).alias("n_success"), n(oc.FAILURE).alias("n_failure"), n(oc.UNKNOWN).alias("n_unknown"))
    return out.withColumn("skip_reason", oc.skip_reason(F.col("n_success"), F.col("n_failure")))


def pick_pairs(candidates: DataFrame, keys: list[str], record: str, seed: int = 42) -> DataFrame:
    """keys, positive, negative: the success and the failure of each group whose hash comes first.

    The choice depends on seed, keys and record only, so it is the same under any partitioning.
    """
    order = F.struct(F.xxhash64(F.lit(seed), *keys, record), F.col(record))
    best = lambda what: F.min_by(record, F.when(F.col("outcome") == what, order))
    picked = candidates.groupBy(*keys).agg(best(oc.SUCCESS).alias("positive"), best(oc.FAILURE).alias("negative"))
    return picked.where("positive IS NOT NULL AND negative IS NOT NULL")


def pick_first_pairs(candidates: DataFrame, keys: list[str], record: str) -> DataFrame:
    """keys, positive, negative: the smallest success and failure of each group."""
    best = lambda what: F.min(F.when(F.col("outcome") == what, F.col(record)))
    picked = candidates.groupBy(*keys).agg(best(oc.SUCCESS).alias("positive"), best(oc.FAILURE).alias("negative"))
    return picked.where("positive IS NOT NULL AND negative IS NOT NULL")


def pair_records(candidates: DataFrame, picked: DataFrame) -> DataFrame:
    """Whole records of picked pairs (domain, jobname, positive, negative): ids, query, ranks, responses, the two records, counts.

    Candidates are record_id, domain, model_name, job_with_model, jobname, source_path,
    relative_source_path, outcome, task_instruction, response. The query is the first task that
    is told, else the job's name.
    """
    counts = candidates.groupBy("domain", "jobname", "outcome").agg(F.count("*").alias("n"))
    outcomes = counts.groupBy("domain", "jobname").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"), F.sum("n").alias("candidate_count"))
    fields = ["record_id", "outcome", "domain", "model_name", "job_with_model", "jobname", "source_path", "relative_source_path"]

    def chosen(role: str, rank: int) -> DataFrame:
        keyed = picked.select("domain", "jobname", F.col(role).alias("record_id"))
        got = candidates.join(keyed, ["domain", "jobname", "record_id"]).dropDuplicates(["domain", "jobname"])
        summary = F.struct(F.col("record_id"), F.lit(role).alias("pair_role"), F.lit(rank).alias("label_rank"), *[F.col(c) for c in fields[1:]])
        return got.select("domain", "jobname", summary.alias(f"{role}_record"), F.col("response").alias(f"{role}_response"), first_text(F.col("task_instruction")).alias(f"{role}_task"))

    both = chosen("positive", 1).join(chosen("negative", 2), ["domain", "jobname"]).join(outcomes, ["domain", "jobname"])
    return both.select(
        F.concat_ws("/", "domain", "jobname").alias("pair_id"), "domain", "jobname", F.coalesce("positive_task", "negative_task", "jobname").alias("query"), F.array(F.lit(1), F.lit(2)).alias("label_rank"),
        F.array("positive_response", "negative_response").alias("responses"), F.array("positive_record", "negative_record").alias("selected_records"), "candidate_count", "outcomes",
    )


def skipped_groups(candidates: DataFrame) -> DataFrame:
    """pair_id, domain, jobname, reason, outcomes, candidate_count and the candidates of groups without a pair."""
    counts = group_counts(candidates, ["domain", "jobname"]).where("skip_reason is not null")
    listed = F.array_sort(F.collect_list(F.struct("relative_source_path", "record_id", "outcome", "model_name")))
    of = candidates.join(counts.select("domain", "jobname"), ["domain", "jobname"], "left_semi").groupBy("domain", "jobname").agg(listed.alias("candidates"))
    named = [F.struct(F.lit(k).alias("k"), F.col(f"n_{k}").alias("n")) for k in (oc.FAILURE, oc.SUCCESS, oc.UNKNOWN)]
    outcomes = F.map_from_entries(F.filter(F.array(*named), lambda x: x["n"] > 0))
    return counts.join(of, ["domain", "jobname"]).select(F.concat_ws("/", "domain", "jobname").alias("pair_id"), "domain", "jobname", F.col("skip_reason").alias("reason"), outcomes.alias("outcomes"), "candidate_count", "candidates")


def run_summary(candidates: DataFrame, keys: list[str], domain: str) -> DataFrame:
    """One row: candidates, groups, pairs, skipped_groups, and maps of candidates by outcome, groups by reason and pairs by domain, in order of keys."""
    groups = group_counts(candidates, keys)
    if domain not in keys:
        raise ValueError(f"{domain} is no key of groups")
    as_map = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("n"))))).alias(f"by_{key}"))
    paired = groups.where("skip_reason is null")
    totals = groups.agg(F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("candidates"), F.count("*").alias("groups"), F.count_if(F.col("skip_reason").isNull()).alias("pairs"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped_groups"))
    parts = [as_map(candidates, "outcome"), as_map(groups.where("skip_reason is not null"), "skip_reason"), as_map(paired, domain)]
    for part in parts:  # of one row each
        totals = totals.crossJoin(F.broadcast(part))
    return totals


def pick_pairs_replayed(candidates: DataFrame, keys: list[str], record: str, seed: int = 42) -> DataFrame:
    """As pick_pairs, by one random sequence over groups in key order: two draws for each pair.

    The driver holds two counts a group, for parity with a sequential run; use pick_pairs at scale.
    """
    counts = group_counts(candidates, keys).where("skip_reason IS NULL").orderBy(*keys).select(*keys, "n_success", "n_failure").collect()
    rng = random.Random(seed)
    drawn = [(*[r[k] for k in keys], rng.choice(range(r["n_success"])), rng.choice(range(r["n_failure"]))) for r in counts]
    kinds = ", ".join(f"{k} {candidates.schema[k].dataType.simpleString()}" for k in keys)
    chosen = candidates.sparkSession.createDataFrame(drawn, f"{kinds}, p int, n int")
    ranked = candidates.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "outcome").orderBy(record)) - 1)
    return (
        ranked.join(chosen, keys)
        .groupBy(*keys)
        .agg(F.max(F.when((F.col("outcome") == oc.SUCCESS) & (F.col("__k") == F.col("p")), F.col(record))).alias("positive"), F.max(F.when((F.col("outcome") == oc.FAILURE) & (F.col("__k") == F.col("n")), F.col(record))).alias("negative"))
    )


def latest_wins(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """One row of each key, that of the highest version."""
    at = Window.partitionBy(*keys).orderBy(*[v.desc() for v in version])
    return rows.withColumn("__r", F.row_number().over(at)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, replaced by those of new with the same keys, and what new has more."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a result."""
    return rows.join(done.select(*keys), keys, "left_anti")


def first_match(rows: DataFrame, candidates: Column, lookup: DataFrame, key: str, value: str, row_id: str) -> DataFrame:
    """row_id and the value of the first of several candidate keys that the lookup has; null without one."""
    each = rows.select(row_id, F.posexplode(candidates).alias("__at", key))
    found = each.join(lookup.select(key, value), key, "left")
    return found.groupBy(row_id).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("__at"))).alias(value))


def votes(annotations: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Votes for success and failure in free text: unsuccessful ones hold the other word too."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    bad = t.contains("unsuccessful")
    return annotations.groupBy(*keys).agg(F.count_if(t.contains("successful") & ~bad).alias("n_success"), F.count_if(bad).alias("n_failure"))


def stratified(rows: DataFrame, strata: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each stratum."""
    ranked = rows.withColumn("rank_no", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank_no") <= n)


def head_tail_sample(rows: DataFrame, key: str, outcome: str, order: list[str], n: int) -> DataFrame:
    """The first row of each outcome, then rows from the head and the tail up to n of each key."""
    first = F.row_number().over(Window.partitionBy(key, outcome).orderBy(*order)) == 1
    a = rows.withColumn("__first", first)
    up = F.row_number().over(Window.partitionBy(key, "__first").orderBy(*order))
    down = F.row_number().over(Window.partitionBy(key, "__first").orderBy(*[F.desc(c) for c in order]))
    left = F.lit(n) - F.sum(F.col("__first").cast("int")).over(Window.partitionBy(key))
    picked = a.withColumn("__keep", F.col("__first") | (up <= F.ceil(left / 2)) | (down <= F.floor(left / 2)))
    return picked.where("__keep").drop("__first", "__keep")
