"""Weighted means, margins, accuracy, AUC, audits and applicability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Identifiers that a criterion should not hold.
LEAKS = {
    "uuid_or_series_id": r"(?i)#?[0-9a-f]{6,}-[0-9a-f]?",
    "record_number": r"\b(?:RITM|INC|PRB|CHG|EXP)\d{4,}\b",
    "literal_url_or_path": r"https?://|\.do\b|/now/nav|/catalogsearch",
    "literal_action_id": r"(?:click|fill|select_option|upload_file)\('[A-Za-z0-9_]+'",
    "hyphenated_person_name": r"\b[A-Z][a-z]+-[A-Z][a-z]+\s+[A-Z][a-z]+-[A-Z][a-z]+\b",
}


#: Ranges between quantiles of scores.
RANGES = 64


def weighted_mean(score: Column, weight: Column) -> Column:
    """An aggregate: 0 where no weight is left."""
    total = F.sum(F.when(score.isNotNull(), weight))
    return F.when(total > 0, F.sum(score * weight) / total).otherwise(F.lit(0.0))


def auc(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks; null where a class is absent.

    Ranks come from counts of distinct scores, so rows are summed before the ordered window.
    """
    keys = by or []
    counts = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n")
    )
    # scores lie in ranges between quantiles, so that the ordered window is not one task's; sums of ranges go before it
    edges = counts.agg(F.percentile_approx(score, [k / RANGES for k in range(1, RANGES)]).alias("__edges"))  # one row
    placed = counts.crossJoin(F.broadcast(edges)).withColumn("__range", F.size(F.filter("__edges", lambda e: e <= F.col(score)))).drop("__edges")
    sums = placed.groupBy(*keys, "__range").agg(F.sum("n").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__before", before).drop("__n")
    within = F.sum("n").over(Window.partitionBy(*keys, "__range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ranged = placed.withColumn("__within", F.coalesce(within, F.lit(0)))
    won = ranged.join(sums, [*keys, "__range"]).withColumn("won", F.col("p") * (F.col("__before") + F.col("__within") + F.col("n") / 2))
    out = won.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))
    product = F.col("n_positive") * F.col("n_negative")
    return out.select(*keys, "n_positive", "n_negative", F.when(product > 0, F.col("won") / product).alias("auc"))


def margins(scores: DataFrame, pair: str, index: str, score: str, round_first: bool = False) -> DataFrame:
    """pair, margin, predicted (-1: tie), correct: response 0 against response 1.

    round_first rounds totals and the margin before they are compared, as one of two callers does.
    """
    of = lambda i: F.coalesce(F.max(F.when(F.col(index) == i, F.col(score))), F.lit(0.0))
    r = (lambda c: F.bround(c, 4)) if round_first else (lambda c: c)
    out = scores.groupBy(pair).agg(r(of(0)).alias("first"), r(of(1)).alias("second")).withColumn("margin", r(F.col("first") - F.col("second")))
    out = out.withColumn("predicted", F.when(F.col("margin") > 0, 0).when(F.col("margin") < 0, 1).otherwise(-1))
    return out.withColumn("correct", F.col("predicted") == 0)


def accuracy(margin_rows: DataFrame) -> DataFrame:
    """One row: completed, correct, ties, accuracy, mean_margin (null without pairs)."""
    out = margin_rows.agg(F.count("*").alias("completed"), F.count_if("correct").alias("correct"), F.count_if(F.col("predicted") == -1).alias("ties"), F.avg("margin").alias("mean_margin"))
    return out.select("completed", "correct", "ties", F.when(F.col("completed") > 0, F.col("correct") / F.col("completed")).alias("accuracy"), "mean_margin")


def leak_counts(text: Column) -> list[Column]:
    return [F.size(F.regexp_extract_all(text, F.lit(p), 0)).cast("long").alias(f"n_{k}") for k, p in LEAKS.items()]


def class_means(rows: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Mean score of each class, and their gap."""
    of = lambda k: F.avg(F.when(F.col(label) == k, F.col(score)))
    out = rows.groupBy(*by).agg(of(1).alias("mean_positive"), of(0).alias("mean_negative"), F.count("*").alias("n"))
    return out.withColumn("gap", F.col("mean_positive") - F.col("mean_negative"))
