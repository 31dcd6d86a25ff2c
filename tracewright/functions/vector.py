"""Vector expressions, and distances of rows and of clusters in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine within 0 and 2; 1 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / n))).otherwise(F.lit(1.0))




def truncated_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors cut to the shorter length before their norms are taken; 0 for a zero or empty one."""
    n = F.least(F.size(a), F.size(b))
    length = norm(F.slice(a, F.lit(1), n)) * norm(F.slice(b, F.lit(1), n))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def with_softmax(rows: DataFrame, distance: str, by: list[str], temperature: float, name: str) -> DataFrame:
    """All rows with exp((least - d) / T) over its sum in each group, by two small aggregates instead of a window, so that no group is one task's."""
    t = max(temperature, 1e-8)
    least = rows.groupBy(*by).agg(F.min(distance).alias("__least"))
    e = F.exp((F.col("__least") - F.col(distance)) / t)
    sums = rows.join(least, by).groupBy(*by, "__least").agg(F.sum(e).alias("__sum"))
    return rows.join(sums, by).withColumn(name, e / F.col("__sum")).drop("__least", "__sum")


def _tiled(left: DataFrame, right: DataFrame, lefts: int, rights: int, link: Callable, self_join: bool) -> DataFrame:
    """Rows of left meet all rows of right, a tile of each at a time; of a table with itself, each pair of tiles once."""
    tile = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if self_join:
        own = right.select("id", "vector", tile(rights, 0).alias("own"), every(rights).alias("other"))
        i, j = F.least("own", "other"), F.greatest("own", "other")
        rows = own.select("id", "vector", i.alias("i"), j.alias("j"), (F.col("own") == i).alias("query"), (F.col("own") == j).alias("row"))
    else:
        a = left.select("id", "vector", tile(lefts, 0).alias("i"), every(rights).alias("j"), F.lit(True).alias("query"), F.lit(False).alias("row"))
        rows = a.union(right.select("id", "vector", every(lefts).alias("i"), tile(rights, 0).alias("j"), F.lit(False).alias("query"), F.lit(True).alias("row")))
    return rows.groupBy("i", "j").applyInArrow(link, "a long, b long, distance double")


def _linker(most: float, how: str) -> Callable:
    """how: once (a < b), others (a <> b) or all."""

    def link(rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        of = lambda name: np.flatnonzero(rows[name].to_numpy(zero_copy_only=False))
        given = rows["vector"].to_pylist()
        x = np.zeros((len(ids), max(map(len, given), default=0)))  # a shorter vector has zeros at its end
        for k, v in enumerate(given):
            x[k, : len(v)] = v
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        q, r = of("query"), of("row")
        same_tile = rows["i"][0].as_py() == rows["j"][0].as_py()
        out: list[np.ndarray] = []
        dists: list[np.ndarray] = []
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            d = np.clip(1 - x[part] @ x[r].T, 0, 2)
            i, j = np.nonzero(d <= most)
            a, b = ids[part[i]], ids[r[j]]
            keep = (a < b if same_tile else a != b) if how == "once" else a != b if how == "others" else np.ones(len(a), bool)
            a, b, d = a[keep], b[keep], d[i, j][keep]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]) if how == "once" else np.stack([a, b]))
            dists.append(d)
        ends = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(ends[0]), pa.array(ends[1]), pa.array(np.concatenate(dists) if dists else np.zeros(0))], names=["a", "b", "distance"])

    return link


def _tiles(rows: DataFrame, block_rows: int) -> int:
    return max(1, -(-rows.count() // block_rows))


def pair_distances(rows: DataFrame, most: float = 2.0, block_rows: int = 2048) -> DataFrame:
    """(a, b, distance) of all pairs a < b of (id, vector) within a cosine distance, by products of tiles."""
    n = _tiles(rows, block_rows)
    return _tiled(rows, rows, n, n, _linker(most, "once"), True)


def query_distances(queries: DataFrame, rows: DataFrame, block_rows: int = 8192) -> DataFrame:
    """(a, b, distance) of each query to all other rows."""
    return _tiled(queries, rows, _tiles(queries, block_rows), _tiles(rows, block_rows), _linker(2.0, "others"), False)


def all_distances(queries: DataFrame, rows: DataFrame, block_rows: int = 8192) -> DataFrame:
    """(a, b, distance) of each query to all rows of another table, whose ids may be the same."""
    return _tiled(queries, rows, _tiles(queries, block_rows), _tiles(rows, block_rows), _linker(2.0, "all"), False)


#: Distances count as equal, so that the first rows go first, where they agree to so many decimals.
DECIMALS = 12


def nearest_columns(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the columns with the largest cosine of each row, and its distance."""
    best = s.max(1)
    return (s >= best[:, None] - 10.0**-DECIMALS).argmax(1), np.round(np.maximum(1 - best, 0), DECIMALS)


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, a shorter one with zeros at its end, a null one and nulls in one as NaN."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
    flat = pc.list_flatten(vectors).to_numpy().astype(float)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    x = np.zeros((len(lengths), width))
    x[lengths < 0] = np.nan
    x[np.arange(width) < lengths[:, None]] = flat
    return x


def _nearest_in_tiles(rows: pa.Table) -> pa.Table:
    """(c, near, least) of stale clusters of either of two tiles among those of the other, or within one tile."""
    at_once, c = 256, rows["c"].to_numpy()
    order = np.argsort(c)
    size, stale, first = (rows[k].to_numpy() for k in ("size", "stale", "first"))
    x = matrix(rows["total"], len(rows["total"][0])) / size[:, None]
    a, b = (order[first[order] == side] for side in (True, False))
    own = rows["i"][0].as_py() == rows["j"][0].as_py()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def look(ask: np.ndarray, among: np.ndarray) -> None:
        y = x[among].T
        for lo in range(0, len(ask), at_once):
            at = ask[lo : lo + at_once]
            s = x[at] @ y
            if own:
                s[np.arange(len(at)), np.searchsorted(c[among], c[at])] = -np.inf
            k, d = nearest_columns(s)
            found.append((c[at], c[among[k]], d))

    def look_both() -> None:
        y, best, near = x[b].T, np.full(len(b), -np.inf), np.zeros(len(b), np.int64)
        for lo in range(0, len(a), at_once):
            at = a[lo : lo + at_once]
            s = x[at] @ y
            k, d = nearest_columns(s)
            found.append((c[at][stale[at]], c[b[k]][stale[at]], d[stale[at]]))
            top = s.max(0)
            more = np.flatnonzero(top > best + 10.0**-DECIMALS)
            near[more] = at[(s[:, more] >= top[more] - 10.0**-DECIMALS).argmax(0)]
            best[more] = top[more]
        found.append((c[b][stale[b]], c[near][stale[b]], np.round(np.maximum(1 - best, 0), DECIMALS)[stale[b]]))

    ask_a, ask_b = a[stale[a]], b[stale[b]]
    if own:
        look(ask_a, a) if len(a) > 1 else None
    elif len(a) and len(b):
        if len(ask_a) * len(b) + len(ask_b) * len(a) > len(a) * len(b):
            look_both()
        else:
            look(ask_a, b)
            look(ask_b, a)
    cs, near, least = (np.concatenate(k) for k in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([pa.array(cs), pa.array(near), pa.array(least)], names=["c", "near", "least"])


def nearest_means(rows: DataFrame, n: int, tile_rows: int = 8192) -> DataFrame:
    """(c, near, least): the nearest other cluster of each stale one of n clusters (c, total, size, stale).

    The distance is 1 less the product of mean vectors, total / size. A task holds two tiles of clusters and a strip of their products.
    """
    tiles = max(-(-n // tile_rows), min(8, -(-n // 1024)))
    own, other = F.pmod(F.xxhash64("c", F.lit(2)), F.lit(tiles)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dealt = rows.select("c", "total", "size", "stale", own.alias("own"), other.alias("other"))
    dealt = dealt.select("c", "total", "size", "stale", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.expr("own <= other").alias("first"))
    found = dealt.repartition(tiles * (tiles + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(_nearest_in_tiles, "c long, near long, least double")
    return found.groupBy("c").agg(F.min(F.struct("least", "near")).alias("m")).select("c", "m.near", "m.least")
