"""Judges' answers to scores of responses, pairs and runs, and what they tell of criteria."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import open_json as oj
from ..functions import outcome as oc
from ..functions.text import let, strip
from ..session import ship
from .rubrics import extract_array
from .scoring import LEAKS, auc

# Bounds of an audit, and the hits that it lists.
FEWEST, MOST, LISTED_HITS = 3, 6, 20
COVERED = ("criterion", "positive_evidence", "negative_evidence", "verification_guide")


def _ids(rows: DataFrame, key: str, ids: Sequence[str] | None, limit: int | None, order: list) -> DataFrame:
    rows = rows.where(F.col(key).isin(list(ids))) if ids else rows
    return rows.orderBy(*order).limit(max(0, limit)) if limit is not None else rows


def pairs_to_prompt(pairs: DataFrame, ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Pairs (pair_id, responses, validation, selected_records) with two responses, and a validation or two records; the first by id up to a limit."""
    ready = (F.coalesce("pair_id", F.lit("")) != "") & (F.size("responses") >= 2) & (F.col("validation").isNotNull() | (F.size("selected_records") >= 2))
    return _ids(pairs.where(ready), "pair_id", ids, limit, ["pair_id"])


def pairs_to_weigh(pairs: DataFrame, ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Pairs (pair_id, task_text, responses, selected_records) with a task, and two records or responses."""
    ready = (F.coalesce("pair_id", F.lit("")) != "") & (strip(F.coalesce("task_text", F.lit(""))) != "") & ((F.size("selected_records") >= 2) | (F.size("responses") >= 2))
    return _ids(pairs.where(ready), "pair_id", ids, limit, ["pair_id"])


def groups_to_judge(rubrics: DataFrame, ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Groups (cluster_id, cluster_size, …), the largest first, then by id."""
    return _ids(rubrics, "cluster_id", ids, limit, [F.desc(F.coalesce("cluster_size", F.lit(0))), "cluster_id"])


def jobs_of_pairs(rubrics: DataFrame, pairs: DataFrame, ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Criteria (pair_id, rubrics, …) with their pair's other columns; those without criteria or a pair are left out."""
    kept = rubrics.where((F.coalesce("pair_id", F.lit("")) != "") & (F.size("rubrics") > 0))
    more = pairs.dropDuplicates(["pair_id"]).select("pair_id", *[c for c in pairs.columns if c not in rubrics.columns])
    return _ids(kept.join(more, "pair_id"), "pair_id", ids, limit, ["pair_id"])


def members_of(rubrics: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, at, and the members' columns) for the ids in source_record_ids, in their order; unknown ids go."""
    each = rubrics.select("cluster_id", F.posexplode("source_record_ids").alias("at", "record_id"))
    return each.join(members.drop("cluster_id"), "record_id")


def answer_items(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """All columns, items (the objects in an answer's list, as variants) and parse_error where it holds no list."""
    ship(answers.sparkSession)

    @F.pandas_udf("struct<items:string,parse_error:string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple[str, str | None]:
            try:
                return json.dumps([x if isinstance(x, dict) else None for x in extract_array(t)], allow_nan=False), None
            except ValueError as e:
                return "[]", str(e)

        return pd.DataFrame([one(t) for t in texts], columns=["items", "parse_error"])

    got = answers.withColumn("__got", parse(F.col(answer)))
    return got.withColumns({"items": oj.as_list(F.try_parse_json("__got.items")), "parse_error": F.col("__got.parse_error")}).drop("__got")


def _score(v: Column, most: float = 1.0, words: bool = False) -> Column:
    """A value's score; flags are 1 and 0. Words count in one of the two rules."""
    text = oj.text(v)
    as_number = let(F.struct(oj.flag(v).cast("double").alias("flag"), text.alias("text")), lambda x: F.coalesce(x["flag"], oc.score_of(x["text"]) if words else oc.score_number(x["text"], most)))
    return F.coalesce(as_number, F.lit(0.0))


def _said(m: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(oj.text(oj.pick_present(m, keys)), F.lit(""))


def _truthy_first(m: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(oj.truthy(m[k]), m[k]) for k in keys])


def response_scores(items: Column, words: bool = False) -> Column:
    """Scores of responses, as an array in order of their numbers: response_id, response_index, total_score, rubric_scores.

    A response's number ends its id; without one, it is its place in the answer. The total is the
    given one, within 0 and 999, or the sum of the scores. words: scores may be words, as the
    bank's judge allows.
    """
    names = ("score", "rating", "value") if words else ("score",)

    def rubric(x: Column, at: Column) -> Column:
        given = F.floor(oj.text(x["rubric_index"]).try_cast("double")).cast("int")
        return F.struct(F.coalesce(given, at + 1).alias("rubric_index"), _score(oj.pick_present(x, names), words=words).alias("score"), F.substring(_said(x, ("evidence",)), 1, 800).alias("evidence"), F.substring(_said(x, ("rationale", "reason")), 1, 800).alias("rationale"))

    def response(x: Column, at: Column) -> Column:
        named = F.coalesce(oj.text(_truthy_first(x, ("response_id", "id"))), F.concat(F.lit("response_"), at.cast("string")))
        listed = F.filter(F.transform(oj.as_list(_truthy_first(x, ("rubric_scores", "scores"))), oj.as_map), lambda m: m.isNotNull())
        scores = F.coalesce(F.transform(listed, rubric), F.array().cast("array<struct<rubric_index:int,score:double,evidence:string,rationale:string>>"))
        total = lambda s: F.when(oj.filled(x["total_score"]), _score(x["total_score"], 999.0)).otherwise(F.aggregate(s, F.lit(0.0), lambda a, r: a + r["score"]))
        number = F.coalesce(F.nullif(F.regexp_extract(named, r"(\d+)$", 1), F.lit("")).try_cast("int"), at)
        return let(scores, lambda s: F.struct(number.alias("response_index"), at.alias("at"), named.alias("response_id"), total(s).alias("total_score"), s.alias("rubric_scores")))

    each = F.filter(F.transform(items, lambda v, i: F.struct(oj.as_map(v).alias("m"), i.alias("i"))), lambda s: s["m"].isNotNull())
    return F.array_sort(F.transform(each, lambda s: response(s["m"], s["i"])), lambda a, b: F.when(a["response_index"] != b["response_index"], a["response_index"] - b["response_index"]).otherwise(a["at"] - b["at"]))


def pair_result(scores: Column, rounded: bool = False) -> Column:
    """positive_score, negative_score, score_margin, predicted (-1: tie) and pair_correct of two responses; null where one is missing.

    Of several scores of a response the last counts. rounded: the margin is rounded before it is
    compared, as the bank does.
    """
    of = lambda x, i: F.try_element_at(F.filter(x, lambda s: s["response_index"] == i), F.lit(-1))["total_score"]

    def result(x: Column) -> Column:
        margin = F.bround(x["p"] - x["n"], 4) if rounded else x["p"] - x["n"]
        predicted = F.when(margin > 0, 0).when(margin < 0, 1).when(margin == 0, -1)
        return F.struct(x["p"].alias("positive_score"), x["n"].alias("negative_score"), margin.alias("score_margin"), predicted.alias("predicted"), (predicted == 0).alias("pair_correct"))

    return let(scores, lambda x: let(F.struct(of(x, 0).alias("p"), of(x, 1).alias("n")), result))


def pair_summary(rows: DataFrame) -> DataFrame:
    """One row over pairs (score_margin, predicted, pair_correct, judge_error): records, completed, correct, ties, errors, pair_accuracy, mean_margin."""
    failed = F.coalesce(F.col("judge_error"), F.lit("")) != ""
    done = ~failed & F.col("pair_correct").isNotNull()
    out = rows.agg(
        F.count("*").alias("records"), F.count_if(done).alias("completed"), F.count_if(done & F.col("pair_correct")).alias("correct"), F.count_if(done & (F.col("predicted") == -1)).alias("ties"),
        F.count_if(failed).alias("errors"), F.avg(F.when(done, F.col("score_margin"))).alias("mean"),
    )
    share = F.when(F.col("completed") > 0, F.bround(F.col("correct") / F.col("completed"), 4))
    return out.select("records", "completed", "correct", "ties", "errors", share.alias("pair_accuracy"), F.bround("mean", 4).alias("mean_margin"))


def aligned_scores(items: Column, rubrics: Column) -> Column:
    """The judge's scores in the order of the criteria, by place: rubric_index, dimension, severity, score, evidence, rationale; 0 where there is none."""

    def one(r: Column, i: Column) -> Column:
        made = lambda x: F.struct(
            (i + 1).alias("rubric_index"), r["dimension"].alias("dimension"), F.coalesce(r["severity"], F.lit("medium")).alias("severity"), _score(oj.pick_present(x, ("score", "rating", "value")), words=True).alias("score"),
            strip(_said(x, ("evidence",))).alias("evidence"), strip(_said(x, ("rationale", "reason"))).alias("rationale"),
        )
        return let(F.coalesce(oj.as_map(F.get(items, i)), F.create_map().cast("map<string,variant>")), made)

    return F.transform(rubrics, one)


def weighted_score(scores: Column) -> Column:
    """The mean of scores weighted by severity, rounded; 0 without any."""
    total = lambda f: F.aggregate(scores, F.lit(0.0), lambda a, s: a + f(s))
    weight = lambda s: oc.severity_weight(F.coalesce(s["severity"], F.lit("medium")))
    return F.when(F.size(scores) > 0, F.bround(total(lambda s: weight(s) * s["score"]) / total(weight), 4)).otherwise(F.lit(0.0))


def leak_hits(text: Column) -> Column:
    """(type, example) of each kind of identifier that a text holds, the first of a kind."""
    hit = lambda name, p: F.when(text.rlike(p), F.struct(F.lit(name).alias("type"), F.regexp_extract(text, p, 0).alias("example")))
    return F.array_compact(F.array(*[hit(k, p) for k, p in LEAKS.items()]))


def static_audit(groups: DataFrame, rubrics: str = "rubrics") -> DataFrame:
    """Flags of each group (cluster_id, cluster_size, rubrics): rubric_count, field_coverage, flags (type, values, count), leakage_hits.

    Dimensions that repeat whatever their case, fewer than three or more than six criteria, one
    member at most, and identifiers: all of them counted, the first 20 listed.
    """
    items = F.col(rubrics)
    low = F.filter(F.transform(items, lambda r: F.lower(strip(F.coalesce(r["dimension"], F.lit(""))))), lambda x: x != "")
    twice = let(low, lambda d: F.filter(F.array_distinct(d), lambda x: F.size(F.filter(d, lambda y: y == x)) > 1))
    hits = F.flatten(F.transform(items, lambda r, i: F.transform(leak_hits(F.to_json(r)), lambda h: F.struct(i.alias("rubric_index"), h["type"].alias("type"), h["example"].alias("example")))))
    has = lambda c: (lambda r: F.size(r[c]) > 0 if "evidence" in c else F.coalesce(r[c], F.lit("")) != "")
    n = F.size(items)
    share = lambda f: F.when(n > 0, F.size(F.filter(items, f)) / n).otherwise(F.lit(0.0))
    read = groups.select("cluster_id", F.coalesce("cluster_size", F.lit(0)).cast("long").alias("cluster_size"), n.cast("long").alias("rubric_count"), F.struct(*[share(has(c)).alias(c) for c in COVERED]).alias("field_coverage"), twice.alias("twice"), hits.alias("hits"))
    flag = lambda when, name, values=None, count=None: F.when(when, F.struct(F.lit(name).alias("type"), (F.array().cast("array<string>") if values is None else values).alias("values"), (F.lit(None) if count is None else count).cast("long").alias("count")))
    flags = F.array(
        flag(F.size("twice") > 0, "duplicate_dimensions", F.col("twice")), flag(F.col("rubric_count") < FEWEST, "too_few_rubrics", count=F.col("rubric_count")), flag(F.col("rubric_count") > MOST, "too_many_rubrics", count=F.col("rubric_count")),
        flag(F.col("cluster_size") <= 1, "singleton_cluster", count=F.col("cluster_size")), flag(F.size("hits") > 0, "instance_leakage", count=F.size("hits")),
    )
    return read.select("cluster_id", "cluster_size", "rubric_count", "field_coverage", F.array_compact(flags).alias("flags"), F.slice("hits", 1, LISTED_HITS).alias("leakage_hits"))


def flag_totals(audits: DataFrame) -> DataFrame:
    """One row: clusters_with_flags and total_flags."""
    return audits.agg(F.count_if(F.size("flags") > 0).alias("clusters_with_flags"), F.coalesce(F.sum(F.size("flags")), F.lit(0)).alias("total_flags"))


def judged_groups(scores: DataFrame) -> DataFrame:
    """AUC, counts, class means and their gap of each cluster_id of (cluster_id, label, weighted_score, judge_error); rows with an error or no score go."""
    valid = valid_scores(scores)
    of = lambda k: F.avg(F.when(F.col("label") == k, F.col("weighted_score")))
    means = valid.groupBy("cluster_id").agg(F.count("*").alias("evaluated_records"), F.count_if(F.col("label") == 1).alias("success_count"), F.count_if(F.col("label") == 0).alias("failure_count"), of(1).alias("s"), of(0).alias("f"))
    areas = auc(valid, "label", "weighted_score", ["cluster_id"]).select("cluster_id", F.bround("auc", 4).alias("auc"))
    out = means.join(areas, "cluster_id", "left")
    return out.select("cluster_id", "evaluated_records", "success_count", "failure_count", "auc", F.bround("s", 4).alias("success_mean_score"), F.bround("f", 4).alias("failure_mean_score"), F.bround(F.col("s") - F.col("f"), 4).alias("score_gap"))


def valid_scores(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("weighted_score").isNotNull() & (F.coalesce("judge_error", F.lit("")) == ""))


def judged_overall(scores: DataFrame) -> DataFrame:
    """One row over all clusters: evaluated_records, judge_errors, global_auc, success_count, failure_count."""
    failed = F.coalesce("judge_error", F.lit("")) != ""
    valid = F.col("weighted_score").isNotNull() & ~failed
    counts = scores.agg(F.count_if(valid).alias("evaluated_records"), F.count_if(failed).alias("judge_errors"), F.count_if(valid & (F.col("label") == 1)).alias("success_count"), F.count_if(valid & (F.col("label") == 0)).alias("failure_count"))
    area = auc(valid_scores(scores), "label", "weighted_score").select(F.bround("auc", 4).alias("global_auc"))
    return counts.join(area)  # of one row each


def parse_ids(text: str | None) -> list[str]:
    """Names between commas, blank ones left out."""
    return [x for part in (text or "").split(",") if (x := part.strip())]


def parse_thresholds(text: str) -> list[float]:
    """Distinct cosine distances between 0 and 2, in order; anything else is an error."""
    got = sorted({float(x) for x in re.split(",", text) if x.strip()})
    if not got or got[0] < 0 or got[-1] > 2:
        raise ValueError(f"no thresholds between 0 and 2: {text!r}")
    return got
