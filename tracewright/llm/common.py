"""Shared helpers: tables, the shared scratch folder, and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Rows of one Arrow batch. Texts may hold hundreds of kB, so the default of 10,000 rows is too many.
BATCH_ROWS = 256
#: Spark's setting that deletes a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by bounding the rows of an Arrow batch."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def few_files(rows: DataFrame) -> DataFrame:
    """Small rows in as many parts as the session has cores, not one for each shuffle partition.

    On a local disk without Hadoop's native library, the executor starts three processes for each file that it
    writes (for its folder, itself and its .crc file), each of which has all pages of the executor until it calls exec.
    """
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def gathered(rows: DataFrame) -> DataFrame:
    """As few_files, without an exchange: for what has just left one, where little is done for a row (distinct, sums)."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def map_texts(rows: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], added: str, at_once: int = 128) -> DataFrame:
    """Replace the column text by columns computed from it, in a narrow pass over Arrow batches.

    make() runs once in each task and gives a function of some texts to columns as in added (DDL).
    The other columns pass through as they are, so null ids keep their type.
    """
    small_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c != "text"]
    names = [x.split()[0] for x in added.split(", ")]
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in kept)
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    types = [arrow[x.split()[1]] for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for whole in batches:
            for lo in range(0, whole.num_rows, at_once):
                b = whole.slice(lo, at_once)
                got = of([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(got[n], k) for n, k in zip(names, types, strict=True))], [*kept, *names])

    return rows.mapInArrow(run, kinds + added)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, a local session (tests) gets a temporary folder; a cluster
    must name one, as a machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-"))
    return sc.getCheckpointDir()


class Scratch:
    """Parquet tables in the shared folder that cut lineage; an executor's loss does not lose them."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at = spark, f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df once and read it back."""
        return self.keep_all([df])

    def keep_all(self, parts: Iterable[DataFrame]) -> DataFrame:
        """Write tables of equal columns one after another, at least one, and read them back as one.

        What a write shuffled is deleted as soon as it ends, not when the driver happens to collect garbage.
        """
        self.count += 1
        path, conf, schema = f"{self.at}/{self.count}", self.spark.conf, None
        before = conf.get(CLEAN_UP, "false")
        for df in parts:
            conf.set(CLEAN_UP, "true")
            try:
                df.write.mode("append").option("compression", "zstd").parquet(path)
            finally:
                conf.set(CLEAN_UP, before)
            schema = schema or df.schema
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
