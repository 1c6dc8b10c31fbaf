"""Approximate nearest neighbours by inner product: stable projections, kd-trees and a chi-square stopping test.

Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2) with M the greatest norm: then
|x' - q'|^2 = M^2 + |q|^2 - 2 <q, x>. Vectors are projected to ``PROJECTED`` dimensions by a 2-stable (normal) matrix, so
a squared projected distance over the squared true distance is chi-square. The projected space is cut into cells by the
top of a kd-tree, fitted on a bounded sample; every vector is indexed in the kd-tree of its cell. A query takes leaves
by ascending projected distance, verifies their vectors exactly, and stops once a vector as near as the current k-th
would have a projected distance this large with probability below 1 - ``CONFIDENCE``; the same test spares each single
vector of a leaf. A query visits its home cell first, and then, with that bound, each further cell whose box of vectors
the test does not exclude.

A cell of more than ``CELL`` vectors is dealt into blocks, and its queries into chunks of ``QUERIES``; a task holds one
block and one chunk, whatever the sizes of cells. How much the test spares depends on how much nearer the k-th neighbour is
than the others: of vectors in all directions alike it must verify a good part, and work grows with queries times vectors.

Defined results: rows with a null id, or a vector that is null, empty, zero or holds null or non-finite components, take
no part; repeated rows count once, and of several vectors of one id the one of least hash counts; shorter vectors are
padded with zeros; ties go to the lesser id; an empty table gives an empty result; extra columns of any name are ignored.
Equal vectors are indexed as one with their ``k + 1`` least ids, which is all that a list of ``k`` can hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.batches import runs
from packloom.plans.stash import small, stash

PROJECTED = 24
CONFIDENCE = 0.93
LEAF = 32
#: Vectors in a cell or block of one, about; queries of a chunk; vectors of the sample on which cells are fitted.
CELL, QUERIES, SAMPLE = 4096, 1024, 20_000


def chi_square_cdf(x: float, m: int = PROJECTED) -> float:
    """For an even ``m``."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int = PROJECTED) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


class Projection:
    """The extra coordinate and the projection; ``norm2`` is the greatest squared norm of the data."""

    def __init__(self, dims: int, norm2: float, seed: int = 11) -> None:
        self.dims, self.norm2 = dims, norm2
        self.matrix = np.random.default_rng(seed).standard_normal((dims + 1, PROJECTED))

    def data(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.norm2 - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.matrix[:-1] + extra[:, None] * self.matrix[-1]

    def query(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]


class Cells:
    """The top of a kd-tree: ``2 ** depth`` cells, fewer if points run out, by median cuts of the widest side."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.side, self.cut, self.kids, self.count, self.depth = [], [], [], 0, depth

        def grow(x: np.ndarray, d: int) -> int:
            """A node's number, or a cell's as -1 - number."""
            side = int(np.argmax(np.ptp(x, axis=0))) if len(x) > 1 else 0
            at = float(np.median(x[:, side])) if len(x) > 1 else 0.0
            if not d or len(x) < 2 or not (x[:, side] < at).any():
                self.count += 1
                return -self.count
            node = len(self.side)
            self.side.append(side)
            self.cut.append(at)
            self.kids.append([0, 0])
            self.kids[node] = [grow(x[x[:, side] < at], d - 1), grow(x[x[:, side] >= at], d - 1)]
            return node

        self.top = grow(points, depth)

    def home(self, p: np.ndarray) -> np.ndarray:
        """The cell of each point, a level at a time."""
        at = np.full(len(p), self.top)
        side, cut, kids = np.array(self.side, int), np.array(self.cut), np.array(self.kids, int).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = kids[node, (p[inner, side[node]] >= cut[node]).astype(int)]
        return (-1 - at).astype(np.int32)


def box_distance2(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - p, p - high), 0)
    return (gap * gap).sum(axis=-1)


class Tree:
    """A kd-tree's leaves over projected points: the order of points, and each leaf's range and bounding box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        order, ends, todo = [], [0], [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= leaf:
                order.append(at)
                ends.append(ends[-1] + len(at))
                continue
            x = points[at]
            side = int(np.argmax(np.ptp(x, axis=0)))
            half = np.argpartition(x[:, side], len(at) // 2)
            todo += [at[half[len(at) // 2 :]], at[half[: len(at) // 2]]]
        self.order = np.concatenate(order) if order else np.zeros(0, int)
        self.ends = np.array(ends)
        self.points = points[self.order]
        self.low = np.minimum.reduceat(self.points, self.ends[:-1]) if len(points) else np.zeros((0, PROJECTED))
        self.high = np.maximum.reduceat(self.points, self.ends[:-1]) if len(points) else np.zeros((0, PROJECTED))


def search(tree: Tree, vectors: np.ndarray, q: np.ndarray, p: np.ndarray, base: float, bound2: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and inner products of up to ``k`` near vectors, and how many were verified. ``vectors`` are in the
    tree's order; ``base`` is M^2 + |q|^2; ``bound2`` is a squared distance of which k vectors are known elsewhere;
    ``stop`` is the quantile."""
    far = box_distance2(p, tree.low, tree.high)
    leaves = np.argsort(far, kind="stable")
    best_at, best = np.zeros(0, int), np.zeros(0)
    done, take, verified = 0, 4, 0
    while done < len(leaves):
        if far[leaves[done]] > stop * bound2:
            break
        some = leaves[done : done + take]
        some = some[far[some] <= stop * bound2]
        at = np.concatenate([np.arange(tree.ends[i], tree.ends[i + 1]) for i in some])
        if np.isfinite(bound2):
            gap = tree.points[at] - p
            at = at[np.einsum("ij,ij->i", gap, gap) <= stop * bound2]
        verified += len(at)
        best_at, best = np.concatenate([best_at, at]), np.concatenate([best, vectors[at] @ q])
        if len(best) > k:
            # ties with the k-th stay, to be settled by id
            edge = np.partition(best, len(best) - k)[len(best) - k]
            keep = best >= edge
            best_at, best = best_at[keep], best[keep]
            bound2 = min(bound2, max(base - 2 * edge, 0.0))
        elif len(best) == k:
            bound2 = min(bound2, max(base - 2 * best.min(), 0.0))
        done, take = done + take, take * 2
    return best_at, best, verified


def _matrix(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False) if len(col) else np.zeros(0, int)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in (col.chunks if isinstance(col, pa.ChunkedArray) else [col])] or [np.zeros(0)])
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(float)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


class Index:
    """The fitted projection and cells, and every vector in its cell: what a search needs."""

    def __init__(self, rows: DataFrame, k: int, n: int, dims: int, norm2: float) -> None:
        self.k, self.dims, self.norm2, self.stop = k, dims, norm2, chi_square_quantile(CONFIDENCE)
        self.made = made = Projection(dims, norm2)
        sample = rows.select("v").sample(fraction=min(1.0, 2 * SAMPLE / n), seed=3).limit(SAMPLE) if n > SAMPLE else rows.select("v")
        points = made.data(_matrix(sample.toArrow()["v"], dims))
        self.cells = cells = Cells(points, max(0, math.ceil(math.log2(n / CELL)))) if len(points) else Cells(np.zeros((1, PROJECTED)), 0)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = cells.home(made.data(_matrix(b["v"], dims)))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *b.columns], names=["cell", *b.schema.names])

        # equal vectors as one, with their least ids; the limit acts before the shuffle
        first = Window.partitionBy("key", "v").orderBy("id")
        vectors = rows.select("key", "v", "id").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
        vectors = vectors.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        self.vectors = stash(vectors.mapInArrow(place, "cell int, key long, v array<double>, ids array<long>"))
        # at most as many cells as the sample has vectors
        sizes = self.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        self.blocks = stash(sizes.select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("nb")))
        self.low, self.high = self._boxes()

    def _boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """The least box around the projected vectors of each cell."""
        cells, dims, made = self.cells, self.dims, self.made

        def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full((cells.count, PROJECTED), np.inf), np.full((cells.count, PROJECTED), -np.inf)
            seen = np.zeros(cells.count, bool)
            for b in batches:
                at, p = b["cell"].to_numpy(), made.data(_matrix(b["v"], dims))
                seen[at] = True
                np.minimum.at(low, at, p)
                np.maximum.at(high, at, p)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(at, PROJECTED).astype(np.int32)), pa.array(np.tile(np.arange(PROJECTED, dtype=np.int32), len(at))), pa.array(low[at].ravel()), pa.array(high[at].ravel())],
                names=["cell", "side", "low", "high"],
            )

        found = self.vectors.mapInArrow(boxes, "cell int, side int, low double, high double").groupBy("cell", "side").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        low, high = np.full((cells.count, PROJECTED), np.inf), np.full((cells.count, PROJECTED), np.inf)
        at = found["cell"].to_numpy(), found["side"].to_numpy()
        low[at], high[at] = found["low"].to_numpy(), found["high"].to_numpy()
        return low, high

    def homes(self, queries: DataFrame) -> DataFrame:
        """Add ``cell``, the home of (key, v)."""
        cells, made, dims = self.cells, self.made, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(cells.home(made.query(_matrix(b["v"], dims))), pa.int32()), *b.columns], names=["cell", *b.schema.names])

        return queries.mapInArrow(run, "cell int, key long, v array<double>")

    def others(self, queries: DataFrame) -> DataFrame:
        """(cell, key, v, bound): each cell but the home that the test does not exclude for (cell, key, v, bound)."""
        low, high, made, dims, norm2, stop = self.low, self.high, self.made, self.dims, self.norm2, self.stop

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = []
                for home, q, bound in zip(b["cell"].to_pylist(), _matrix(b["v"], dims), b["bound"].to_pylist(), strict=True):
                    far = box_distance2(made.query(q), low, high)
                    near.append([int(c) for c in np.flatnonzero((far <= stop * bound) & np.isfinite(far)) if c != home])
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.list_(pa.int32())), b["key"], b["v"], b["bound"]], names=["cells", "key", "v", "bound"])

        found = queries.select("cell", "key", "v", "bound").mapInArrow(run, "cells array<int>, key long, v array<double>, bound double")
        return found.select(F.explode("cells").alias("cell"), "key", "v", "bound")

    def visit(self, asks: DataFrame) -> DataFrame:
        """(key, id, score, bound, verified) for each (cell, key, v, bound) and block of the cell: the nearest found there."""
        made, dims, norm2, stop, k = self.made, self.dims, self.norm2, self.stop, self.k

        def search_block(t: pa.Table) -> pa.RecordBatch:
            is_query = t["bound"].is_valid().to_numpy()
            data, ask = t.filter(pa.array(~is_query)), t.filter(pa.array(is_query))
            x = _matrix(data["v"], dims)
            tree = Tree(made.data(x))
            x, ids = x[tree.order], data["ids"].take(pa.array(tree.order))
            out: dict[str, list] = {c: [] for c in ("key", "id", "score", "bound", "verified")}
            for key, v, bound in zip(ask["key"].to_pylist(), _matrix(ask["v"], dims), ask["bound"].to_pylist(), strict=True):
                base = norm2 + float(v @ v)
                at, score, verified = search(tree, x, v, made.query(v), base, bound, k + 1, stop)
                found = sorted((-float(s), i) for a, s in zip(ids.take(pa.array(at)).to_pylist(), score, strict=True) for i in a)[: k + 1]
                if len(found) > k:
                    bound = min(bound, max(base + 2 * found[k][0], 0.0))
                for c, value in zip(out, (key, [i for _, i in found], [-s for s, _ in found], bound, verified), strict=True):
                    out[c].append(value)
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out.values(), kinds, strict=True)], names=list(out))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in runs(batches, ["cell", "block", "chunk"]):
                yield search_block(table)

        chunks = stash(asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("nc")))
        shape = self.blocks.join(chunks, "cell")
        n = self.cells.count
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda c: F.pmod(F.xxhash64("key"), F.col(c).cast("long")).cast("int")
        data = self.vectors.join(small(shape, n), "cell").select("cell", deal("nb").alias("block"), upto("nc").alias("chunk"), "key", "v", "ids", F.lit(None).cast("double").alias("bound"))
        asked = asks.join(small(shape, n), "cell").select("cell", upto("nb").alias("block"), deal("nc").alias("chunk"), "key", "v", F.lit(None).cast("array<long>").alias("ids"), "bound")
        task = ["cell", "block", "chunk"]
        both = data.unionByName(asked).repartition(*task).sortWithinPartitions(*task)
        return both.mapInArrow(run, "key long, id array<long>, score array<double>, bound double, verified long")


def search_all(table: DataFrame, k: int, every: int, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame | None, int]:
    """The queries asked (id, key), what each visit found, and the number of vectors; None without any vector."""
    vec = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vec.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    rows = stash(rows.withColumn("key", F.xxhash64("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    n, dims, norm2 = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("norm2")).first()
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).select("id", "key")
    if not n:
        return asked, None, 0
    index = Index(rows, k, n, dims, norm2)
    queries = stash(index.homes(rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("key").agg(F.min_by("v", "id").alias("v"))))
    one = stash(index.visit(queries.withColumn("bound", F.lit(float("inf")))))
    bounds = one.groupBy("key").agg(F.min("bound").alias("bound"))
    two = index.visit(stash(index.others(queries.join(bounds, "key"))))
    return asked, one.unionByName(two), n


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each row whose id is divisible by ``every``."""
    asked, found, n = search_all(table, k, every, id_col, vec_col)
    if found is None:
        return table.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    found = found.select("key", F.explode(F.arrays_zip("id", "score")).alias("x")).select("key", F.col("x.id").alias("near"), F.col("x.score").alias("score"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "near")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "near")
    out = asked.withColumnRenamed("id", "query_id").join(found, "key").filter("near <> query_id").withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("near").alias(id_col), "score")
