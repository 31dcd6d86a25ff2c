"""Sinks: keyed tables with versions, trees by key columns, and single JSON exports."""

from __future__ import annotations

import json
import logging
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import open_json as oj
from ..operators.pairs import latest_wins

logger = logging.getLogger("tracewright")


def append_log(rows: DataFrame, path: str, version: int) -> None:
    """Add rows as a version; readers take the latest of each key, so nothing is rewritten."""
    rows.withColumn("_version", F.lit(version)).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    return latest_wins(rows, keys, [F.col("_version")]).drop("_version")


def write_tree(rows: DataFrame, path: str, parts: list[str]) -> None:
    """A folder for each value of the parts, as a mirrored tree that readers prune."""
    rows.write.mode("overwrite").partitionBy(*parts).parquet(path)


def export_json(rows: DataFrame, path: str) -> None:
    """JSON lines for other programs."""
    rows.write.mode("overwrite").json(path)


def write_config(spark: SparkSession, path: str, **settings) -> None:
    """One row of run parameters."""
    spark.createDataFrame([{k: str(v) for k, v in settings.items()}]).coalesce(1).write.mode("overwrite").json(path)


def with_provenance(rows: DataFrame, relative: Column) -> DataFrame:
    """Rows (metadata, audit, source_path) whose metadata and audit name their source, where they do not yet."""
    text = lambda c: F.try_variant_get(F.parse_json(F.to_json(F.create_map(F.lit("x"), c))), "$.x", "variant")
    own = F.col("metadata")
    more = F.map_from_arrays(F.array(F.lit("source_path"), F.lit("relative_source_path")), F.array(text(F.col("source_path")), text(relative)))
    missing = F.map_filter(more, lambda k, _: ~F.coalesce(oj.filled(F.element_at(own, k)), F.lit(False)))
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(missing, k))
    fill = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    source = F.col("audit.source_metadata")
    audit = F.col("audit").withField("source_metadata", source.withField("source_path", fill(source["source_path"], F.col("source_path"))).withField("relative_source_path", fill(source["relative_source_path"], relative)))
    return rows.withColumns({"metadata": F.map_concat(kept, missing), "audit": audit, "relative_source_path": relative})


def write_parsed(rows: DataFrame, path: str, error: str = "load_error") -> None:
    """Records as a tree of domain, model and job, and those with an error in a table beside it."""
    good = F.coalesce(F.col(error), F.lit("")) == ""
    rows.where(good).write.mode("overwrite").partitionBy("domain", "model_name").parquet(f"{path}/records")
    rows.where(~good).write.mode("overwrite").parquet(f"{path}/errors")


def with_pair(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """The two records of each pair (pair_id, domain, jobname, selected_records), each with a struct that tells of its pair."""
    each = pairs.select("pair_id", "domain", "jobname", F.explode("selected_records").alias("s"))
    told = F.struct("pair_id", "domain", "jobname", "s.pair_role", "s.label_rank", "s.source_path", "s.relative_source_path")
    keyed = each.select(F.col("s.record_id").alias("record_id"), F.col("s.source_path").alias("source_path"), told.alias("_pair_cache"))
    return records.join(keyed, ["record_id", "source_path"])


def write_pairs(pairs: DataFrame, skipped: DataFrame, summary: DataFrame, selected: DataFrame, path: str) -> None:
    """The four tables of a pairing run."""
    for name, rows in (("pairs", pairs), ("skipped", skipped), ("summary", summary), ("selected", selected)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def log_calls(answers: DataFrame, path: str, stage: str) -> None:
    """Add prompts and raw answers of a stage to an append-only table."""
    answers.withColumns({"stage": F.lit(stage), "logged_at": F.current_timestamp()}).write.mode("append").parquet(path)


def with_schema(rows: DataFrame, schema: StructType) -> DataFrame:
    """Rows with a schema's columns in its order and types; missing ones are null, others go. What cannot be cast is an error."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def preview(rows: DataFrame, n: int = 5, width: int = 160) -> str:
    """The first rows as JSON lines of a bounded width, for a console."""
    cut = lambda t: t if len(t) <= width else t[: width - 16].rstrip() + " ...[truncated]"
    return "\n".join(cut(line) for line in rows.limit(n).toJSON().collect())


class JsonFormatter(logging.Formatter):
    """A log record as one line of JSON."""

    def format(self, record: logging.LogRecord) -> str:
        told = {"ts": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        return json.dumps(told | getattr(record, "fields", {}), ensure_ascii=False, default=str)


def configure_logging(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Log to the console, and as JSON lines to a file of the driver if one is named."""
    logger.handlers = [logging.StreamHandler(sys.stderr)]
    if path:
        logger.addHandler(logging.FileHandler(path))
        logger.handlers[-1].setFormatter(JsonFormatter())
    logger.setLevel(level)
    return logger
