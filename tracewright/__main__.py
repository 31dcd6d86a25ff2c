"""Jobs: python -m tracewright JOB INPUT --out FOLDER; those that ask a model keep its answers in FOLDER and ask only for what is missing there."""

from __future__ import annotations

import argparse
import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs
from .operators import clusters, judging, models, pairs, traces
from .plans import QUERIES
from .session import session
from .sources import benchmark, readers, sinks


TABLES = ["parse", "pairs", "cluster", "audit", "judged", "query"]
ASKING = ["extract-pairs", "evaluate-pairs", "cluster-pairs", "merge", "extract-groups", "evaluate-groups", "bank-build", "bank-evaluate"]
ADAPTERS = ["merged-members", "members-by-path"]


def _asking(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Tables of a job that asks a model, or that prepares its input."""
    client = partial(models.HttpClient, a.model_url, a.model, os.environ.get(a.api_key_variable, "")) if a.model_url else models.StubClient
    run = jobs.Run(spark, a.out, client, a.attempts)
    given, read = spark.read.parquet(a.input), lambda path: spark.read.parquet(path)
    some = {"ids": judging.parse_ids(a.ids), "limit": a.limit}
    if a.job == "extract-pairs":
        return {"rubrics": jobs.extract_from_pairs(run, given, **some)}
    if a.job == "evaluate-pairs":
        return dict(zip(("scores", "summary"), jobs.evaluate_pairs(run, read(a.criteria), given, **some), strict=True))
    if a.job == "cluster-pairs":
        options = {"thresholds": tuple(judging.parse_thresholds(a.thresholds))} if a.thresholds else {}
        return dict(zip(("members", "clusters"), jobs.cluster_pairs(run, given, consensus=a.consensus, min_size=a.least, **options), strict=True))
    if a.job == "merge":
        return {"merged": jobs.merge(run, given, read(a.criteria), a.by, a.select, a.least, a.most, **some)}
    if a.job == "merged-members":
        return dict(zip(("rubrics", "missing"), jobs.merged_for(read(a.criteria), given, a.by), strict=True))
    if a.job == "members-by-path":
        return {"members": jobs.members_by_path(given, read(a.criteria).select(F.col("group_id").alias("domain")))}
    if a.job == "extract-groups":
        return {"rubrics": jobs.extract_from_groups(run, given, read(a.records), a.sample, a.least, **some)}
    if a.job == "evaluate-groups":
        return jobs.evaluate_groups(None if a.static else run, given, None if a.static else read(a.records), a.with_labels, **some)
    if a.job == "bank-build":
        return dict(zip(("bank", "missing"), jobs.build_bank(run, read(a.criteria), given), strict=True))
    return jobs.evaluate_with_bank(run, read(a.bank), given, a.top_k, a.batch, a.temperature, **some)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    p.add_argument("job", choices=TABLES + ASKING + ADAPTERS)
    p.add_argument("input", help="traces; parsed traces; (id, vector), criteria, scores, pairs or members as Parquet; or a folder of tables")
    p.add_argument("--out", required=True)
    p.add_argument("--format", choices=["json", "jsonl", "yaml", "csv", "tree", "folder", "benchmark"])
    p.add_argument("--name", help="of the query")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--limit", type=int)
    p.add_argument("--include-chat", action="store_true")
    p.add_argument("--observation-chars", type=int, default=2400)
    p.add_argument("--observation-policy", choices=benchmark.POLICIES, default="all")
    p.add_argument("--criteria", help="criteria of pairs, or merged ones, as Parquet")
    p.add_argument("--records", help="parsed traces as Parquet")
    p.add_argument("--bank", help="a bank as Parquet")
    p.add_argument("--ids", help="names between commas")
    p.add_argument("--by", default="domain", help="the column of groups")
    p.add_argument("--least", type=int, default=2, help="pairs or runs of the smallest group")
    p.add_argument("--most", type=int, default=80, help="criteria of a group that are merged")
    p.add_argument("--all-criteria", dest="select", action="store_false", help="merge without a selection")
    p.add_argument("--sample", type=int, default=8, help="runs shown of a group")
    p.add_argument("--thresholds")
    p.add_argument("--consensus", type=float, default=clusters.CONSENSUS)
    p.add_argument("--static", action="store_true", help="audit only")
    p.add_argument("--with-labels", action="store_true")
    p.add_argument("--top-k", type=int, default=32)
    p.add_argument("--batch", type=int, default=32)
    p.add_argument("--temperature", type=float, default=0.05)
    p.add_argument("--model-url", help="a server of chat and embedding endpoints; a stub without it")
    p.add_argument("--model", default="")
    p.add_argument("--api-key-variable", default="MODEL_API_KEY")
    p.add_argument("--attempts", type=int, default=5)
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    spark = session(a.master)
    if a.job in ASKING + ADAPTERS:
        for name, rows in _asking(spark, a).items():
            rows.write.mode("overwrite").parquet(f"{a.out}/{name}")
        return
    if a.job == "parse":
        options = readers.Options(limit=a.limit, include_chat=a.include_chat, observation_chars=a.observation_chars, observation_policy=a.observation_policy)
        records = benchmark.read_benchmark(spark, a.input, options=options) if a.format == "benchmark" else readers.canonical(readers.read_records(spark, a.input, a.format, options=options), options)
        relative = readers.below(F.col("source_path"), a.input)
        out = sinks.with_provenance(traces.summaries(records), relative)
        out = out.select("*", *readers.path_fields(F.col("relative_source_path")))
    elif a.job == "pairs":
        out = pairs.pick_pairs(spark.read.parquet(a.input), ["domain", "jobname"], "record_id", a.seed)
    elif a.job == "audit":
        out = judging.static_audit(spark.read.parquet(a.input))
    elif a.job == "judged":
        out = judging.judged_groups(spark.read.parquet(a.input))
    elif a.job == "cluster":
        out = clusters.cluster_tasks(spark.read.parquet(a.input))
    else:
        out = QUERIES[a.name](spark, a.input)
    out.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
