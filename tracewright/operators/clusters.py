"""Task clusters: average linkage at several thresholds, their consensus, and ordered ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import matrix, nearest_columns, nearest_means
from ..session import ship

# Thresholds of the ensemble, and of the consensus.
THRESHOLDS, CONSENSUS, MIN_SIZE = (0.30, 0.36, 0.42, 0.48, 0.54), 0.60, 2


def average_linkage(d: np.ndarray, cut: float, inclusive: bool = False) -> np.ndarray:
    """Labels of average linkage of a distance matrix, merging below the cut (at it too if inclusive)."""
    n = len(d)
    label, size = np.arange(n), np.ones(n)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        least = d[i, j]
        if not (least <= cut if inclusive else least < cut):
            break
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


#: Clusters are merged in one task when they hold so many numbers, and those that look again meet so many.
REST_NUMBERS, REST_PAIRS = 2**22, 2**27


def _merges(sums: np.ndarray, size: np.ndarray, height: np.ndarray, near: np.ndarray, least: np.ndarray, stale: np.ndarray, cut: float, inclusive: bool, at_once: int = 512) -> list[tuple[int, int, float]]:
    """(kept, merged, distance) of average linkage below a cut, for clusters of unit vectors with their sums.

    The mean cosine of two clusters is the product of their means, so no distances are held. Merging
    never brings a cluster nearer to another than the nearer part was. So two that are each other's
    nearest merge sooner or later, and all such pairs merge at once; a cluster without another below
    the cut is ready; and one whose nearest was merged keeps a lower bound and looks again when that
    is among the least, or when it is nearest to one of the least: some eight for each last merge.
    """
    n = len(sums)
    rows, gone, some = np.arange(n), np.zeros(n, bool), n
    sums, size, height, near, least, stale = (k.copy() for k in (sums, size, height, near, least, stale))
    means = sums / size[:, None]
    out: list[tuple[int, int, float]] = []
    while len(rows):
        ask = np.flatnonzero(stale & ~gone)
        if len(ask) > some:
            least_of = lambda at: at[np.argpartition(least[at], some)[:some]] if len(at) > some else at
            told = np.zeros(len(rows), bool)
            told[near[least_of(np.flatnonzero(~stale & ~gone))]] = True
            told[least_of(ask)] = True
            ask = np.flatnonzero(told & stale & ~gone)
        void = np.flatnonzero(gone)
        for lo in range(0, len(ask), at_once):
            at = ask[lo : lo + at_once]
            s = means[at] @ means.T
            s[np.arange(len(at)), at] = -np.inf
            s[:, void] = -np.inf
            near[at], least[at] = nearest_columns(s)
        stale[ask] = False
        gone |= ~(least <= cut if inclusive else least < cut)
        fresh = ~stale & ~gone
        at = np.flatnonzero(fresh & fresh[near] & (near[near] == np.arange(len(rows))) & (np.arange(len(rows)) < near))
        if not len(at):
            if gone.all():
                break
            if (stale & ~gone).any():
                some *= 2
                continue
            at = np.flatnonzero(fresh)[[least[fresh].argmin()]]  # equal ones but for rounding in a ring
        i, j = np.minimum(at, near[at]), np.maximum(at, near[at])
        height[i] = np.maximum(least[at], np.maximum(height[i], height[j]))
        out += zip(rows[i].tolist(), rows[j].tolist(), height[i].tolist(), strict=True)
        sums[i] += sums[j]
        size[i] += size[j]
        means[i] = sums[i] / size[i][:, None]
        gone[j] = True
        new = np.zeros(len(rows), bool)
        new[i] = new[j] = True
        stale |= new | new[near]
        some = 8 + 8 * len(i)
        if 4 * np.count_nonzero(gone) > len(rows):
            keep = np.flatnonzero(~gone)
            place = np.zeros(len(rows), np.int64)
            place[keep] = np.arange(len(keep))
            near = place[near[keep]]  # that of a stale one means nothing
            rows, sums, size, height, means, least, stale, gone = rows[keep], sums[keep], size[keep], height[keep], means[keep], least[keep], stale[keep], gone[keep]
    return out


def _labels(n: int, merges: list[tuple[int, int, float]], cuts: tuple[float, ...], inclusive: bool) -> list[np.ndarray]:
    """The first row of each row's cluster at each cut, of merges that follow the ones they rest on."""
    out = []
    for cut in cuts:
        label = np.arange(n)
        for i, j, d in reversed(merges):  # the last one first: what a row has merged into has its own label by then
            if d <= cut if inclusive else d < cut:
                label[j] = label[i]
        out.append(label)
    return out


def linkages(x: np.ndarray, cuts: tuple[float, ...], inclusive: bool = False, at_once: int = 512) -> list[np.ndarray]:
    """Labels of average linkage at each cut, for the cosine distances of unit vectors or zero ones; the memory is that of the rows.

    Least pairs merge first, of equal ones that of the first rows, so clusters of larger cuts hold those of smaller ones.
    """
    n = len(x)
    merges = _merges(x.astype(float), np.ones(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool), max(cuts), inclusive, at_once)
    return _labels(n, merges, cuts, inclusive)


def _enough(runs: int, consensus: float, inclusive: bool) -> int | None:
    """In how many runs rows must be together to be so in the consensus; None if in all is not enough."""
    cut = 1 - consensus
    return next((m for m in range(runs + 1) if (1 - m / runs <= cut if inclusive else 1 - m / runs < cut)), None)


def consensus_labels(labels: list[np.ndarray], consensus: float, inclusive: bool = False) -> np.ndarray:
    """Labels of average linkage of 1 less the share of runs in which two rows are together, for nested runs.

    Shares of nested runs are levels of one tree, which average linkage gives back: rows are
    together where they are in so many runs, the coarsest ones, that 1 less that share is within the cut.
    """
    enough = _enough(len(labels), consensus, inclusive)
    if enough is None:
        return np.arange(len(labels[0]))
    coarsest = sorted(labels, key=lambda x: len(np.unique(x)))
    return coarsest[enough - 1] if enough else np.zeros_like(labels[0])


def strengths(labels: list[np.ndarray], final: np.ndarray) -> np.ndarray:
    """Mean share of runs in which a row is with each other one of its final cluster; 1 for a row alone."""
    others = np.bincount(final, minlength=len(final))[final] - 1
    together = np.zeros(len(final), np.int64)
    for x in labels:
        _, group, count = np.unique(final * len(final) + x, return_inverse=True, return_counts=True)
        together += count[group] - 1
    return np.where(others > 0, together / len(labels) / np.maximum(others, 1), 1.0)


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) by smallest labels over edges (a, b); rounds are checkpointed where the session names a folder."""
    sc = nodes.sparkSession.sparkContext
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now = nodes.select("id", F.col("id").alias("component"))
    for _ in range(rounds):
        near = both.join(now, both["b"] == now["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = now.join(near, now["id"] == near["a"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = step.join(jump, "component").select("id", F.col("next").alias("component"))
        new = new.checkpoint() if sc.getCheckpointDir() else new.persist()
        moved = new.join(now.withColumnRenamed("component", "old"), "id").where("component <> old").take(1)
        now = new
        if not moved:
            return now
    raise RuntimeError("components did not settle")


def _settled(rows: DataFrame) -> DataFrame:
    """The rows worked out once, without their lineage: in the session's checkpoint folder, or by its executors where it names none."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


class _Held:
    """Settled tables in executors' storage, whose sizes Spark knows: that of a checkpoint is what its joins might have made, which grows without bound over rounds."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, rows: DataFrame) -> DataFrame:
        self.tables.append(_settled(rows).persist())
        self.tables[-1].count()
        return self.tables[-1]

    def drop(self) -> None:
        for t in self.tables:
            t.unpersist()


def _merge_round(live: DataFrame, n: int, cut: float, inclusive: bool, held: _Held) -> tuple[DataFrame, DataFrame]:
    """Clusters after those merged that are each other's nearest, and (c, root, height) of the merged ones."""
    seen = live.join(nearest_means(live, n).select("c", F.col("near").alias("near2"), F.col("least").alias("least2")), "c", "left")
    seen = seen.select("c", "total", "size", "height", F.coalesce("near2", "near").alias("near"), F.coalesce("least2", "least").alias("least"))
    pointed = held.keep(seen.where(F.col("least") <= cut if inclusive else F.col("least") < cut))
    a = pointed.select(F.col("c").alias("root"), F.col("near").alias("child"), "least", F.col("height").alias("height_a"))
    b = pointed.select(F.col("c").alias("child"), F.col("near").alias("root"), F.col("height").alias("height_b"))
    made = a.where("root < child").join(b, ["root", "child"]).select(F.col("child").alias("c"), "root", F.greatest("least", "height_a", "height_b").alias("height"))
    made = held.keep(made)
    if made.isEmpty():  # equal ones but for rounding in a ring, or none
        ends = (F.least("c", "near"), F.greatest("c", "near"))
        one = pointed.orderBy("least", *ends).limit(1).select(ends[1].alias("c"), ends[0].alias("root"), "least")
        heights = pointed.select("c", "height").join(one.select(F.explode(F.array("c", "root")).alias("c")), "c").agg(F.max("height").alias("h"))
        made = held.keep(one.crossJoin(heights).select("c", "root", F.greatest("least", "h").alias("height")))
    parts = made.join(pointed.select("c", F.col("total").alias("total2"), F.col("size").alias("size2")), "c")
    parts = parts.select(F.col("root").alias("c"), "total2", "size2", F.col("height").alias("height2"))
    changed = made.select(F.explode(F.array("c", "root")).alias("near"), F.lit(True).alias("moved"))
    after = pointed.join(made.select("c"), "c", "left_anti").join(parts, "c", "left").join(changed, "near", "left")
    grown = F.col("size2").isNotNull()
    after = after.select(
        "c", F.when(grown, F.zip_with("total", "total2", lambda x, y: x + y)).otherwise(F.col("total")).alias("total"), F.when(grown, F.col("size") + F.col("size2")).otherwise(F.col("size")).alias("size"),
        F.coalesce("height2", "height").alias("height"), "near", "least", (grown | F.coalesce("moved", F.lit(False))).alias("stale"),
    )
    return after, made


def _linked(rows: DataFrame, cuts: tuple[float, ...], inclusive: bool, held: _Held) -> DataFrame:
    """(id, labels) of rows (id, vector): the least id of each one's cluster at each cut.

    Rounds over tiles of clusters merge all that are each other's nearest; what is left in the end is merged in one task of a bounded size.
    """
    top, width = max(cuts), rows.agg(F.max(F.size("vector"))).first()[0] or 0

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            x = matrix(t["vector"], width)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            known = np.isfinite(n[:, 0])  # one with nulls or other than finite numbers is alone
            x, n = x[known], n[known]
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(t["id"].to_numpy()[known]), lists], ["c", "total"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := [b for b in batches if b.num_rows]):
            return
        t = pa.Table.from_batches(got).sort_by("c")
        c, size, height, near, least, stale = (t[k].to_numpy() for k in ("c", "size", "height", "near", "least", "stale"))
        merges = _merges(matrix(t["total"], width), size, height, np.where(stale, 0, np.minimum(np.searchsorted(c, near), len(c) - 1)), least, stale, top, inclusive)
        ends = c[np.stack(_labels(len(c), merges, cuts, inclusive), 1)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ends.size + 1, len(cuts)), pa.int32()), pa.array(ends.ravel()))
        moved = pa.array((ends != c[:, None]).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(c), lists], ["c", "ends"]).filter(moved)

    members = rows.select("id", F.col("id").alias("c"), F.array_repeat("id", len(cuts)).alias("labels"))
    if not width:
        return members.select("id", "labels")
    live = rows.select("id", "vector").mapInArrow(unit, "c long, total array<double>").select("c", "total", F.lit(1.0).alias("size"), F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("near"), F.lit(0.0).alias("least"), F.lit(True).alias("stale"))
    within = lambda d, cut: d <= cut if inclusive else d < cut
    label = lambda k: F.get("labels", F.lit(k))
    whole = lambda k: label(k) == F.col("c")  # noqa: E731  a row whose cluster is one at that cut
    while True:
        live = held.keep(live)
        n, ask = live.agg(F.count("*"), F.count_if("stale")).first()
        if n * width <= REST_NUMBERS and n * ask <= REST_PAIRS:
            break
        live, made = _merge_round(live, n, top, inclusive, held)
        told = [F.when(whole(k) & within(F.col("height"), cut), F.col("root")).otherwise(label(k)) for k, cut in enumerate(cuts)]
        members = members.join(made, "c", "left").select("id", F.coalesce("root", "c").alias("c"), F.when(F.col("root").isNull(), F.col("labels")).otherwise(F.array(*told)).alias("labels"))
    ended = live.repartition(1).mapInArrow(finish, "c long, ends array<long>")
    told = [F.when(whole(k), F.get("ends", F.lit(k))).otherwise(label(k)) for k in range(len(cuts))]
    return members.join(ended, "c", "left").select("id", F.when(F.col("ends").isNull(), F.col("labels")).otherwise(F.array(*told)).alias("labels"))


def cluster_tasks(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, consensus: float = CONSENSUS, min_size: int = MIN_SIZE, inclusive: bool = False) -> DataFrame:
    """id, cluster_id, cluster_size, consensus_strength, labels of rows (id, vector), whose ids differ.

    Runs are nested, so the consensus is the run of the coarsest enough, a coarser one has all pairs
    of its clusters together, and a finer one those of its own.
    """
    ship(rows.sparkSession)
    thresholds, runs = tuple(thresholds), len(thresholds)
    held = _Held()
    found = _settled(_linked(rows, thresholds, inclusive, held))
    held.drop()
    order, enough = sorted(range(runs), key=lambda k: -thresholds[k]), _enough(runs, consensus, inclusive)
    label = lambda k: F.get("labels", F.lit(k))
    if enough == 0:
        found = found.crossJoin(found.agg(F.min("id").alias("label")))
    else:
        found = found.withColumn("label", F.col("id") if enough is None else label(order[enough - 1]))
    counts = lambda by: found.groupBy(by.alias("at")).agg(F.count("*").alias("n"))
    found = found.withColumn("at", F.col("label")).join(counts(F.col("label")), "at").withColumns({"all": F.col("n"), "together": (F.col("n") - 1) * (enough or 0)}).drop("at", "n")
    for k in order[enough:] if enough is not None else []:
        found = found.withColumn("at", label(k)).join(counts(label(k)), "at").withColumn("together", F.col("together") + F.col("n") - 1).drop("at", "n")
    small = F.col("all") < min_size
    found = found.withColumns({"label": F.when(small, F.col("id")).otherwise(F.col("label")), "consensus_strength": F.when(small | (F.col("all") < 2), 1.0).otherwise(F.col("together") / runs / (F.col("all") - 1))})
    sizes = found.groupBy("label").agg(F.count("*").alias("cluster_size"), F.min("id").alias("least"))
    numbered = sizes.withColumn("cluster_id", F.format_string("task_cluster_%04d", F.row_number().over(Window.orderBy(F.desc("cluster_size"), "least")) - 1))
    return found.join(numbered, "label").select("id", "cluster_id", "cluster_size", "consensus_strength", "labels")


def cluster_summary(members: DataFrame) -> DataFrame:
    """cluster_id, size, mean strength, first members."""
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.bround(F.avg("consensus_strength"), 4).alias("mean_strength"), F.slice(F.array_sort(F.collect_list("id")), 1, 8).alias("first_ids"))
