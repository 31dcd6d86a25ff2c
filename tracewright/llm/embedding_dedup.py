"""Embedding near-duplicates: range joins of rotated subspaces under shares of the squared distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .components import connected_components, spanning

#: Least cosine, dimensions of a subspace, vectors at home in a cell about, and rows of a tile.
COSINE, BLOCK_DIMS, CELL_ROWS, TILE = 0.95, 16, 8_192, 32_768
#: Dimensions of a subspace that name its cells at most, and vectors whose medians the cells are halved at.
MOST_BITS, SAMPLE = 12, 4_096
#: Rows that are sent to cells in one round, at least.
ROUND_ROWS = 1 << 18
#: What the budgets are widened by, for the rounding of coordinates to multiples of 2^-20.
SLACK, GRID = 1e-4, 1 << 20
#: Home rows and other rows that are compared at once, and the share of near pairs from which they are worked out as matrices.
FEW, MANY, DENSE = 256, 2_048, 0.01


def rotation(dims: int, seed: int = 13) -> np.ndarray:
    """A fixed random rotation, so that no subspace is poor by the data's layout."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, width: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    return [(lo, min(lo + width, dims)) for lo in range(0, dims, width)]


def budgets(dims: int, cosine: float, width: int = BLOCK_DIMS) -> np.ndarray:
    """Squared distance of each subspace, in proportion to its dimensions.

    Unit vectors of that cosine lie at a squared distance of 2 - 2 cosine at most; if every
    subspace were over its share, the whole would be over.
    """
    whole = 2 - 2 * cosine
    return np.array([whole * (hi - lo) / dims for lo, hi in blocks_of(dims, width)]) + SLACK * whole


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bits_for(rows: int, cell_rows: int, most: int) -> int:
    """Halvings after which a cell has so many rows, about."""
    return min(most, max(0, int(np.ceil(np.log2(max(1.0, rows / cell_rows))))))


def code_of(p: np.ndarray) -> np.ndarray:
    """The orthant of each point."""
    return (p > 0) @ (1 << np.arange(p.shape[1])) if p.shape[1] else np.zeros(len(p), np.int64)


def apart_from(p: np.ndarray, code: np.ndarray, cell: int) -> np.ndarray:
    """Squared distance of points, whose orthants are known, to an orthant."""
    bits = np.arange(p.shape[1])
    return (p**2 * ((code[:, None] ^ cell) >> bits & 1)).sum(1)


def cells(p: np.ndarray, most: float, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cell, home): of some orthants, the one of each point and those of a larger number within the distance.

    Of two points within the distance in different orthants, the one of the smaller number so
    meets the other in the other's home; within one orthant they meet at home.
    """
    own, bits = code_of(p), np.arange(p.shape[1])
    above, below = np.where(p > 0, p**2, 0), np.where(p > 0, 0, p**2)
    for lo in range(0, len(wanted), 256):
        x = wanted[lo : lo + 256]
        one = (x >> bits[:, None] & 1).astype(float)
        near = above @ (1 - one) + below @ one <= most + 1e-5
        rows, k = np.nonzero(near & (x > own[:, None]) | (x == own[:, None]))
        yield rows, x[k], x[k] == own[rows]


def in_rounds(cells: list[tuple[tuple[int, int, int], int]], rows: int) -> list[dict[tuple[int, int], np.ndarray]]:
    """Cells (dims, block, cell) and the rows sent to each, in their order, as rounds of about so many rows: cells by dims and block."""
    out: list[dict[tuple[int, int], list[int]]] = []
    full = rows
    for (dims, block, cell), sent in sorted(cells):
        if full + sent > rows and full:
            out.append({})
            full = 0
        out[-1].setdefault((dims, block), []).append(cell)
        full += sent
    return [{k: np.array(v) for k, v in r.items()} for r in out]


class Linker:
    """Links of a cell's rows whose first subspace within its budget is this one.

    Coordinates are rounded to a grid, so that squared distances are whole numbers that double
    precision holds exactly: any task decides alike which subspace is a pair's first. Cosines
    are those of the vectors themselves.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray, block: int, cell: int, bits: int, centre: np.ndarray, cosine: float, width: int):
        self.u, self.weight, self.block, self.cosine = unit(x), weight, block, cosine
        dims = x.shape[1]
        y = self.u @ rotation(dims)
        self.q, self.spans = np.rint(y * GRID), blocks_of(dims, width)
        real = budgets(dims, cosine, width)
        self.most, self.most_real = np.floor(real * GRID**2), real[block]
        lo, hi = self.spans[block]
        p = y[:, lo:hi] - centre[lo:hi]
        self.low = apart_from(p[:, :bits], code_of(p[:, :bits]), cell)
        self.fine = p[:, bits:]
        self.sums, self.edges = np.zeros(len(x), np.int64), []

    def distance(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        lo, hi = self.spans[block]
        p, q = self.q[a, lo:hi], self.q[b, lo:hi]
        left = np.c_[p, (p**2).sum(1), np.ones(len(p))]
        return left @ np.c_[-2 * q, np.ones(len(q)), (q**2).sum(1)].T

    def tile(self, a: np.ndarray, b: np.ndarray, upper: bool) -> None:
        """Rows a against rows b; if upper, both are the same and each pair counts once."""
        near = self.distance(a, b, self.block) <= self.most[self.block]
        if upper:
            near &= np.tri(len(a), len(b), -1, dtype=bool).T
        found = np.count_nonzero(near)
        if not found:
            return
        if found < DENSE * near.size:
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            for k in range(self.block):
                lo, hi = self.spans[k]
                first = ((self.q[i, lo:hi] - self.q[j, lo:hi]) ** 2).sum(1) > self.most[k]
                i, j = i[first], j[first]
            good = np.einsum("ij,ij->i", self.u[i], self.u[j]) >= self.cosine
            i, j = i[good], j[good]
            np.add.at(self.sums, i, self.weight[j])
            np.add.at(self.sums, j, self.weight[i])
            self.edges += zip(i.tolist(), j.tolist(), strict=True)
        else:
            for k in range(self.block):
                near &= self.distance(a, b, k) > self.most[k]
            near &= self.u[a] @ self.u[b].T >= self.cosine
            self.sums[a] += near @ self.weight[b]
            self.sums[b] += self.weight[a] @ near
            self.edges += forest(near, a, b)
        if len(self.edges) > 200_000:
            self.edges = spanning(self.edges)

    def scan(self, a: np.ndarray, homes: np.ndarray, same: bool) -> None:
        """Rows a against home rows, which if same meet each other too. Finer orthants leave out most pairs."""
        if not len(homes):
            return
        p = self.fine[:, : bits_for(len(homes), FEW, self.fine.shape[1])]
        code = code_of(p)
        homes = homes[np.argsort(code[homes], kind="stable")]
        edges = np.flatnonzero(np.r_[True, np.diff(code[homes]) != 0, True])
        for s, e in zip(edges, edges[1:], strict=False):
            others = np.r_[homes[:s], a] if same else a
            low = self.low[others] + apart_from(p[others], code[others], int(code[homes[s]]))
            others = others[low <= self.most_real + 1e-5]
            for at in range(s, e, FEW):
                b = homes[at : min(at + FEW, e)]
                for lo in range(0, len(others), MANY):
                    self.tile(others[lo : lo + MANY], b, False)
                if same:
                    for lo in range(s, at, FEW):
                        self.tile(homes[lo : lo + FEW], b, False)
                    self.tile(b, b, True)


def forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges from linked rows to one column of their component, by smallest labels."""
    n = len(b)
    of_row, of_col = np.full(len(a), n), np.arange(n)
    while True:
        row = np.minimum(of_row, np.where(near, of_col[None], n).min(1))
        col = np.minimum(of_col, np.where(near, row[:, None], n).min(0))
        if (row == of_row).all() and (col == of_col).all():
            break
        of_row, of_col = row, col
    rows, cols = np.flatnonzero(of_row < n), np.flatnonzero(of_col < np.arange(n))
    return [*zip(a[rows].tolist(), b[of_row[rows]].tolist(), strict=True), *zip(b[cols].tolist(), b[of_col[cols]].tolist(), strict=True)]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, width: int = BLOCK_DIMS, cell_rows: int = CELL_ROWS, tile: int = TILE, round_rows: int = ROUND_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding).

    Two vectors are linked when their cosine, in double precision, is at least `cosine`. Equal
    vectors are one node with a weight. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, as do vectors of different lengths. Null ids keep their rows
    and never name a component that has an id; repeated ids are rows of their own.
    Every pair meets in at least one subspace. A subspace is halved at the medians of a sample, in
    as many dimensions as make cells of about `cell_rows` home rows; a vector visits the cells
    within the budget of it. Cells of more than `tile` rows, whatever makes them, are dealt to tasks as pairs of tiles;
    a task returns sums and a spanning forest, not all pairs. Cells are sent in rounds of about as
    many rows as there are vectors (`round_rows` at least), so the disk holds two rounds at most, however often a vector is sent.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "embeddings")
    code = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, names = [], []
            for v in b.column("embedding").to_pylist():
                x = None if v is None or None in v else np.array(v, code)
                ok = x is not None and len(x) and np.isfinite(x).all() and np.isfinite(n := np.linalg.norm(x.astype("f8"))) and n > 0
                raw.append((x + 0.0).astype(code).tobytes() if ok else None)
                names.append(int.from_bytes(hashlib.blake2b(raw[-1], digest_size=8).digest(), "little", signed=True) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(names, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "node", "raw"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    table = scratch.keep(vectors.select("vec_id", "embedding").mapInArrow(read, f"vec_id {kind}, node long, raw binary"))
    nodes = scratch.keep(table.where("node is not null").groupBy("node").agg(F.first("raw").alias("raw"), F.count("*").alias("weight"), F.min("vec_id").alias("least")))
    different = nodes.count()
    bits = bits_for(different, cell_rows, MOST_BITS)
    sample: dict[int, list[np.ndarray]] = {}
    for r in nodes.select("node", "raw").orderBy("node").limit(SAMPLE).collect():  # names are hashes
        x = np.frombuffer(r["raw"], code)
        sample.setdefault(len(x), []).append(x)
    centres = {n: np.median(unit(np.stack(x)) @ rotation(n), axis=0) for n, x in sample.items()}

    def placed_in(raw: list[bytes], wanted: dict[tuple[int, int], np.ndarray] | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """dims, block, rows, cell, home, for some cells or all."""
        lengths = np.array([len(r) for r in raw])
        for n in np.unique(lengths):
            of = np.flatnonzero(lengths == n)
            x = unit(np.frombuffer(b"".join(raw[i] for i in of), code).reshape(len(of), -1))
            dims = x.shape[1]
            turn, centre, most = rotation(dims), centres.get(dims, np.zeros(dims)), budgets(dims, cosine, width)
            for k, (lo, hi) in enumerate(blocks_of(dims, width)):
                hi = min(hi, lo + bits)
                some = np.arange(1 << hi - lo) if wanted is None else wanted.get((dims, k))
                if some is not None:
                    for rows, cell, home in cells(x @ turn[:, lo:hi] - centre[lo:hi], most[k], some):
                        yield dims, k, of[rows], cell, home

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, k, _, cell, _ in placed_in(b.column("raw").to_pylist(), None):
                at, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dims)), pa.array(np.full(len(at), k)), pa.array(at), pa.array(n)], ["dims", "block", "cell", "n"])

    # at most blocks times 2^MOST_BITS cells for each length of vectors
    sizes = nodes.select("raw").mapInArrow(count, "dims long, block long, cell long, n long").groupBy("dims", "block", "cell").agg(F.sum("n").alias("n"))
    held = {(r["dims"], r["block"], r["cell"]): r["n"] for r in sizes.collect()}
    tiles = {c: -(-n // tile) for c, n in held.items() if n > tile}
    rounds = in_rounds([(c, n * tiles.get(c, 1)) for c, n in held.items()], max(round_rows, different))

    def spread(wanted: dict[tuple[int, int], np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw, node, weight = b.column("raw").to_pylist(), b.column("node").to_numpy(), b.column("weight").to_numpy()
                for dims, k, rows, cell, home in placed_in(raw, wanted):
                    parts = np.array([tiles.get((dims, k, c), 1) for c in cell.tolist()]) if tiles else np.ones(len(cell), np.int64)
                    mine = node[rows] % parts
                    for other in range(parts.max(initial=1)):
                        some = other < parts
                        r, p = rows[some], mine[some]
                        full = lambda v, r=r: pa.array(np.full(len(r), v, np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [
                                full(dims), full(k), pa.array(cell[some]), pa.array(np.minimum(p, other)), pa.array(np.maximum(p, other)), pa.array(p), pa.array(home[some]),
                                pa.array(node[r]), pa.array(weight[r]), pa.array([raw[i] for i in r], pa.binary()),
                            ],
                            ["dims", "block", "cell", "i", "j", "part", "home", "node", "weight", "raw"],
                        )

        return run

    def join(rows: pa.Table) -> pa.Table:
        one = lambda c: rows[c][0].as_py()
        x = np.frombuffer(b"".join(rows["raw"].to_pylist()), code).reshape(rows.num_rows, -1)
        node, weight, part, home = (rows[c].to_numpy(zero_copy_only=False) for c in ("node", "weight", "part", "home"))
        dims = x.shape[1]
        lo, hi = blocks_of(dims, width)[one("block")]
        link = Linker(x, weight, one("block"), one("cell"), min(bits, hi - lo), centres.get(dims, np.zeros(dims)), cosine, width)
        left, right = part == one("i"), part == one("j")
        if one("i") == one("j"):
            link.scan(np.flatnonzero(~home), np.flatnonzero(home), True)
        else:
            link.scan(np.flatnonzero(left), np.flatnonzero(right & home), False)
            link.scan(np.flatnonzero(right & ~home), np.flatnonzero(left & home), False)
        some, ends = np.flatnonzero(link.sums), np.array(spanning(link.edges), np.int64).reshape(-1, 2)
        return pa.table(
            [
                pa.array(np.r_[node[some], node[ends[:, 0]]]),
                pa.array(np.r_[link.sums[some], np.zeros(len(ends), np.int64)]),
                pa.array([*[None] * len(some), *node[ends[:, 1]].tolist()], pa.int64()),
            ],
            names=["node", "links", "other"],
        )

    keys = ["dims", "block", "cell", "i", "j"]
    columns = ", ".join(f"{c} long" for c in [*keys, "part"]) + ", home boolean, node long, weight long, raw binary"
    sent = (nodes.select("node", "weight", "raw").mapInArrow(spread(r), columns) for r in rounds or [{}])
    found = scratch.keep_all(x.groupBy(*keys).applyInArrow(join, "node long, links long, other long") for x in sent)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    of_node = scratch.keep(
        nodes.select("node", "weight", "least").join(links, "node", "left").join(component, "node", "left").select("node", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    )
    smallest = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_node.join(smallest, "component").select("node", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = table.select("vec_id", "node").join(named, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
