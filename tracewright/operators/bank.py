"""A bank of criteria by the tasks that they came from: building, applicability by distance of tasks, weighted scores."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import outcome as oc
from ..functions import vector as vec
from ..functions.text import first_text, strip
from ..session import ship

# Temperature of the softmax, criteria that are scored, criteria of one prompt, and the distance of what has no vector.
TEMPERATURE, TOP_K, BATCH, NO_VECTOR = 0.05, 32, 32, 2.0
TASK_KEYS = ("query", "task_text", "task_instruction", "instruction", "task")
DEFAULT_DIMENSION = "trajectory_quality"


def task_text(pairs: DataFrame) -> Column:
    """The first filled text of a pair's task; empty without one."""
    return F.coalesce(first_text(*[F.col(k) for k in TASK_KEYS if k in pairs.columns]), F.lit(""))


def normalise(r: Column) -> Column:
    """A bank's form of a criterion (fields of rubrics.ITEM): trimmed texts, words of severity, a guide only where it is an object."""
    texts = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != "")
    guide = F.when(F.trim(r["verification_guide"]).startswith("{"), r["verification_guide"]).otherwise("{}")
    return F.struct(
        strip(F.coalesce(F.nullif(r["dimension"], F.lit("")), F.lit(DEFAULT_DIMENSION))).alias("dimension"), strip(F.coalesce(r["criterion"], F.lit(""))).alias("criterion"), texts(r["positive_evidence"]).alias("positive_evidence"),
        texts(r["negative_evidence"]).alias("negative_evidence"), oc.severity(F.coalesce(F.nullif(r["severity"], F.lit("")), F.lit("medium")), bank=True).alias("severity"), strip(F.coalesce(r["rationale"], F.lit(""))).alias("rationale"), guide.alias("verification_guide"),
    )


def _rubric_id(pair_id: Column, at: Column, rubric: Column) -> Column:
    """pairbank, the pair's safe name, the place and a digest of the criterion as sorted JSON."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            x = json.loads(t)
            x["verification_guide"] = json.loads(x["verification_guide"])
            return hashlib.sha1(json.dumps(x, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:12]

        return texts.map(one)

    safe = F.substring(F.regexp_replace(pair_id, "[^A-Za-z0-9_.-]+", "_"), 1, 100)
    return F.concat(F.lit("pairbank:"), safe, F.lit(":"), F.lpad(at.cast("string"), 3, "0"), F.lit(":"), digest(F.to_json(rubric)))


def build(rubrics: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bank of criteria (pair_id, domain, jobname, task keys, rubrics) whose pair has a vector (pair_id, vector), and the pairs without one.

    A row of the bank is rubric_id, source_pair_id, source_pair_index, domain, jobname, task_text,
    vector, rubric; criteria without wording go.
    """
    ship(rubrics.sparkSession)
    told = rubrics.withColumn("__task", task_text(rubrics))
    have = embeddings.where("vector is not null").select("pair_id", "vector").dropDuplicates(["pair_id"])
    missing = told.select("pair_id").join(have, "pair_id", "left_anti")
    each = told.join(have, "pair_id").select("pair_id", "domain", "jobname", F.col("__task").alias("task_text"), "vector", F.posexplode("rubrics").alias("source_pair_index", "r"))
    made = each.withColumn("rubric", normalise(F.col("r"))).where("rubric.criterion <> ''")
    return made.select(_rubric_id(F.col("pair_id"), F.col("source_pair_index"), F.col("rubric")).alias("rubric_id"), F.col("pair_id").alias("source_pair_id"), "source_pair_index", "domain", "jobname", "task_text", "vector", "rubric"), missing


def to_embed(tasks: DataFrame, cache: DataFrame, same_text: bool = False) -> DataFrame:
    """Tasks (pair_id, task_text) that the cache (pair_id, task_text, vector) does not hold; same_text: with the same text too."""
    keys = ["pair_id", "task_text"] if same_text else ["pair_id"]
    return tasks.where((F.coalesce("pair_id", F.lit("")) != "") & (F.coalesce("task_text", F.lit("")) != "")).join(cache.where("vector is not null").select(*keys), keys, "left_anti")


def applicability(tasks: DataFrame, bank: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """pair_id, rubric_id, source_pair_id, cosine_similarity, cosine_distance, applicability of every criterion for every task (pair_id, vector).

    The tasks are a stated set of queries, held against the bank in tiles. A criterion without a
    vector lies at distance 2. The sums of a task's softmax are aggregates, so that no task's rows
    are gathered.
    """
    named_tasks = tasks.where("vector is not null").select("pair_id", "vector", F.xxhash64("pair_id").alias("id"))
    named = bank.select("rubric_id", "source_pair_id", "vector", F.xxhash64("rubric_id").alias("id"))
    d = vec.all_distances(named_tasks.select("id", "vector"), named.where("vector is not null").select("id", "vector"))
    found = d.join(named_tasks.select("pair_id", F.col("id").alias("a")), "a").join(named.select("rubric_id", "source_pair_id", F.col("id").alias("b")), "b")
    near = found.select("pair_id", "rubric_id", "source_pair_id", (1 - F.col("distance")).alias("s"), "distance")
    lost = named.where("vector is null").select("rubric_id", "source_pair_id")
    far = named_tasks.select("pair_id", F.lit(1).alias("one")).join(lost.withColumn("one", F.lit(1)), "one").select("pair_id", "rubric_id", "source_pair_id", F.lit(-1.0).alias("s"), F.lit(NO_VECTOR).alias("distance"))
    rows = vec.with_softmax(near.unionByName(far), "distance", ["pair_id"], temperature, "applicability")
    return rows.select("pair_id", "rubric_id", "source_pair_id", F.bround("s", 8).alias("cosine_similarity"), F.bround("distance", 8).alias("cosine_distance"), "applicability")


def scored_items(weights: DataFrame, k: int = TOP_K, batch: int = BATCH) -> DataFrame:
    """The k most applicable criteria of each pair (all for 0), with rank_no, and chunk and rubric_index of the prompts that hold them."""
    ranked = weights.withColumn("rank_no", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("applicability"), "rubric_id")))
    kept = ranked.where(F.col("rank_no") <= k) if k > 0 else ranked
    return kept.withColumns({"chunk": F.floor((F.col("rank_no") - 1) / max(1, batch)).cast("long"), "rubric_index": ((F.col("rank_no") - 1) % max(1, batch) + 1).cast("int")})


def chunk_scores(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(pair_id, response_index, rubric_id, score) of answers (pair_id, chunk, scores of judging.response_scores(words=True)); unknown numbers have no rubric_id."""
    each = answers.select("pair_id", "chunk", F.explode("scores").alias("r")).select("pair_id", "chunk", "r.response_index", F.explode("r.rubric_scores").alias("s"))
    return each.select("pair_id", "chunk", "response_index", "s.rubric_index", "s.score").join(items.select("pair_id", "chunk", "rubric_index", "rubric_id"), ["pair_id", "chunk", "rubric_index"], "left")


def pair_scores(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """pair_id, scores: total_score of responses 0 and 1 as means weighted by applicability, rounded; 0 without any score. For judging.pair_result(rounded=True)."""
    weighed = scores.join(weights.select("pair_id", "rubric_id", "applicability"), ["pair_id", "rubric_id"], "left").withColumn("w", F.coalesce("applicability", F.lit(0.0)))
    total = lambda i: F.coalesce(F.bround(F.sum(F.when(F.col("response_index") == i, F.col("w") * F.col("score"))) / F.nullif(F.sum(F.when(F.col("response_index") == i, F.col("w"))), F.lit(0.0)), 4), F.lit(0.0))
    one = lambda i: F.struct(F.lit(i).alias("response_index"), F.col(f"t{i}").alias("total_score"))
    return weighed.groupBy("pair_id").agg(total(0).alias("t0"), total(1).alias("t1")).select("pair_id", F.array(one(0), one(1)).alias("scores"))


def applicability_summary(weights: DataFrame) -> DataFrame:
    """One row: pairs, weight_records, how often the most applicable criterion is of the same pair, that rate, and the mean of the largest weights."""
    best = weights.groupBy("pair_id").agg(F.min(F.struct((-F.col("applicability")).alias("less"), "rubric_id", "source_pair_id")).alias("top"), F.count("*").alias("n"))
    out = best.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("weight_records"), F.count_if(F.col("top.source_pair_id") == F.col("pair_id")).alias("top1_self"), F.avg(-F.col("top.less")).alias("mean"))
    return out.select("pairs", "weight_records", "top1_self", F.when(F.col("pairs") > 0, F.bround(F.col("top1_self") / F.col("pairs"), 4)).alias("top1_self_match_rate"), F.bround("mean", 6).alias("mean_top1_weight"))
