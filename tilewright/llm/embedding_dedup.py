"""Embedding near-duplicates: a pivot-permutation index, inverted lists of near pivots with shared-pivot counts, exact checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, first_by_hash, prepare, written

LEAST_CHUNK = 256
#: Rows of a cell's chunk, and rows of a slice of it that meet the other side at once.
CELL_CHUNK, SLICE = 4096, 512
#: Radians that the bounds of single-precision angles leave for rounding.
MARGIN = 2e-3


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    flat = column.values.to_numpy(zero_copy_only=False) if isinstance(column, pa.ListArray) else column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    return flat[len(flat) - n * (len(flat) // max(n, 1)) :].reshape(n, -1) if n else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivot_order(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each row's `prefix` nearest pivots, the nearest first."""
    near = unit(x) @ pivots.T
    k = min(prefix, near.shape[1])
    part = np.argpartition(-near, k - 1, axis=1)[:, :k]
    rank = np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, rank, 1)


def angles(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ to.T, -1, 1))


@dataclass
class Index:
    """Sparse pivots with their prefix lists (numbers from 0), and crowded pivots with the cells of their centres (numbers after those)."""

    pivots: np.ndarray
    crowded: np.ndarray
    centre_of: np.ndarray
    centres: np.ndarray
    angle: float
    prefix: int
    reach: np.ndarray | None = None

    def cells(self, u: np.ndarray) -> np.ndarray:
        """The cell of each row of unit length, -1 for those that have no crowded pivot within twice the angle."""
        if not len(self.crowded):
            return np.full(len(u), -1)
        near = u @ self.crowded.T
        best = near.argmax(1)
        return np.where(near[np.arange(len(u)), best] >= np.cos(min(np.pi, 2 * self.angle)), self.centre_of[best], -1)

    def lists(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Cells, nearest pivots and the lists that each row goes to.

        Rows of no cell go to their pivots' lists. Every row goes to the cells that a linked row of theirs may lie in by
        the triangle inequality; of two rows with cells, the one of the higher cell visits the other's.
        """
        cells, orders = self.cells(u), pivot_order(u, self.pivots, self.prefix)
        out = [[] if c >= 0 else o for c, o in zip(cells.tolist(), orders.tolist(), strict=True)]
        if len(self.centres):
            met = angles(u, self.centres) <= self.reach + self.angle + MARGIN
            met &= (cells < 0)[:, None] | (np.arange(len(self.centres)) <= cells[:, None])
            for i, c in zip(*(k.tolist() for k in np.nonzero(met)), strict=True):
                out[i].append(len(self.pivots) + c)
        return cells, orders, out


def indexed(pivots: np.ndarray, cosine: float, prefix: int) -> Index:
    """Pivots that have `prefix` others or more within twice the angle are crowded: their rows' prefixes are spread over
    more pivots than they hold. Centres are crowded pivots more than three times the angle apart."""
    small, angle = pivots.astype(np.float32), float(np.arccos(min(1.0, cosine)))
    wide, apart = (np.cos(min(np.pi, k * angle)) for k in (2, 3))
    crowd = np.concatenate([(small[k : k + 1024] @ small.T >= wide).sum(1) - 1 for k in range(0, len(small), 1024)])
    many = crowd >= prefix
    crowded, left, centres = small[many], np.flatnonzero(many), []
    left = left[np.argsort(-crowd[left], kind="stable")]
    while len(left):
        centres.append(left[0])
        left = left[small[left] @ small[left[0]] < apart]
        left = left[left != centres[-1]]
    centre_of = np.concatenate([(crowded[k : k + 1024] @ small[centres].T).argmax(1) for k in range(0, len(crowded), 1024)]) if len(crowded) else np.zeros(0, np.int64)
    kept = ~many
    kept[centres] = True
    return Index(small[kept], crowded, centre_of, small[np.array(centres, np.int64)], angle, prefix)


def linked(x, first, second, cosine: float):
    """Slices (places, good) of the linked pairs of two chunks' places: good[i, j] for places[i] and second[j], each pair once.

    first, second: ascending; the same ones for a chunk with itself.
    """
    other = x[second].T
    for k in range(0, len(first), SLICE):
        places = first[k : k + SLICE]
        good = x[places] @ other >= cosine
        if first is second:
            good &= second > places[:, None]
        yield places, good


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, prefix: int = 6, share: int = 2, most_pivots: int = 16_384) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept): links of cosine `cosine` or more among `vectors` (vec_id, embedding).

    Equal vectors are one class from the start. The index describes a class by its `prefix` nearest pivots; pivots are
    2 sqrt(n) classes, `most_pivots` at most, the first by a hash: a bounded sample, while every class is indexed. Each
    pivot's inverted list holds the classes that have it in their prefix; pairs with `share` pivots or more in common
    are checked in double precision, once, in the list of their smallest common pivot. A list longer than twice the
    mean, or than 4096 rows, is cut into chunks that meet pairwise in tasks of their own.

    Where pivots crowd (`prefix` others within twice the angle of `cosine`), prefixes would be spread over too many of
    them: rows within twice the angle of such a pivot go to the cell of its centre instead, and all others that the
    triangle inequality allows meet them there, in chunks too. Links of these rows are exact. Those between two rows
    outside all cells are the ones the prefixes find: recall against brute force is a test (pairs at 0.95 exactly,
    the hardest, in 64 dimensions: 0.998 of them at 20,000 rows, 0.989 at 200,000).

    Null, empty or zero vectors, those that hold a null or no finite number, and null ids: no links, kept, their own
    component. Vectors of different lengths never link. Repeated rows link with each other. Empty table: empty. Other
    columns are left out.
    """
    prepare(vectors.sparkSession)
    v = F.col("embedding")
    number = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(number, F.lit(False)) & F.coalesce(F.exists(v, lambda e: e != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", F.coalesce(fine, F.lit(False)).alias("fine"))
    classes = written(rows.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    answers = None
    for dim, count in sorted((r["dim"], r["count"]) for r in classes.groupBy(F.size("embedding").alias("dim")).count().collect()):
        of_dim = classes.where(F.size("embedding") == dim)
        size = int(min(most_pivots, max(4, 2 * count**0.5)))
        chosen = first_by_hash(of_dim, count, size, "rep").select("embedding").collect()
        found = _links(of_dim, unit(np.array([r["embedding"] for r in chosen])), count, cosine, prefix, share)
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    answers = written(answers, "links")
    weight = answers.where("n_links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("more"))
    joined = components(answers.where("b is not null").select("a", "b")).withColumnsRenamed({"node": "rep"})
    told = classes.join(weight, "rep", "left").join(joined, "rep", "left")
    told = told.select("embedding", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = rows.where("fine").select("vec_id", "embedding").join(told, "embedding").select("vec_id", "n_links", "component_id")
    bad = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(classes: DataFrame, pivots: np.ndarray, count: int, cosine: float, prefix: int, share: int) -> DataFrame:
    """Rows (a, b, null) of a spanning forest of each block's links, and (a, null, n_links) of its sums."""
    index = indexed(pivots, cosine, prefix)
    first_cell = len(index.pivots)

    def widths(batches):
        for batch in batches:
            u = unit(matrix(batch.column(1)))
            cells = index.cells(u)
            mine = np.flatnonzero(cells >= 0)
            width = angles(u[mine], index.centres)[np.arange(len(mine)), cells[mine]]
            yield pa.record_batch([pa.array(cells[mine], pa.int32()), pa.array(width, pa.float64())], names=["cell", "width"])

    if len(index.centres):
        index.reach = np.full(len(index.centres), -10.0)
        for r in classes.select("rep", "embedding").mapInArrow(widths, "cell int, width double").groupBy("cell").agg(F.max("width").alias("width")).collect():
            index.reach[r["cell"]] = r["width"]

    def near(batches):
        for batch in batches:
            _, _, lists = index.lists(unit(matrix(batch.column(1))))
            yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["rep", "lists"])

    seen = classes.select("rep", "embedding").mapInArrow(near, "rep bigint, lists array<int>")
    listed = {r["list"]: r["count"] for r in seen.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}
    sparse = [n for p, n in listed.items() if p < first_cell]
    chunk = min(CELL_CHUNK, max(LEAST_CHUNK, 2 * sum(sparse) // max(1, len(sparse))))  # a task's memory doesn't grow with the table
    cuts = np.ones(first_cell + len(index.centres), np.int64)
    for p, n in listed.items():
        cuts[p] = -(-n // (chunk if p < first_cell else CELL_CHUNK))

    def post(batches):
        for batch in batches:
            cells, orders, lists = index.lists(unit(matrix(batch.column(1))))
            reps = np.array(batch.column(0).to_pylist(), np.int64)
            at, key, low = [], [], []
            for i, (r, mine) in enumerate(zip(reps.tolist(), lists, strict=True)):
                for p in mine:
                    n = int(cuts[p])
                    c = (r * 0x9E3779B97F4A7C15 >> 20) % n
                    for d in range(n):
                        at.append(i)
                        key.append(f"{p}:{min(c, d)}:{max(c, d)}:{'' if n > 1 else '-'}")
                        low.append(c <= d)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.record_batch(
                [pa.array(key, pa.string()), pa.array(low, pa.bool_()), part.column(0), part.column(1), part.column(2), pa.array(orders[at].tolist() if at else [], pa.list_(pa.int32())), pa.array(cells[at] if at else [], pa.int32())],
                names=["key", "low", "rep", "embedding", "n", "pivots", "cell"],
            )

    kind = classes.schema["embedding"].dataType.simpleString()
    posted = classes.select("rep", "embedding", "n").mapInArrow(post, f"key string, low boolean, rep bigint, embedding {kind}, n bigint, pivots array<int>, cell int")

    def check(group: pa.Table) -> pa.Table:
        pivot, low, high, _ = group.column("key")[0].as_py().split(":")
        side = np.array(group.column("low").to_pylist(), bool)
        ids = np.array(group.column("rep").to_pylist(), np.int64)
        x = unit(matrix(group.column("embedding")))
        weights = np.array(group.column("n").to_pylist(), np.int64)
        orders = matrix(group.column("pivots")).astype(np.int32)
        cells = np.array(group.column("cell").to_pylist(), np.int64)
        first = np.flatnonzero(side)
        second = first if low == high else np.flatnonzero(~side)
        cell = int(pivot) - first_cell
        sums, label, forest = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        for places, good in linked(x, first, second, cosine):
            if cell >= 0:  # the lower of the two rows' cells answers
                a, b = (np.where(c < 0, len(index.centres), c) for c in (cells[places], cells[second]))
                good &= np.minimum(a[:, None], b) == cell
            else:
                i, j = np.nonzero(good)
                mine, theirs = orders[places[i]], orders[second[j]]
                same = (mine[:, :, None] == theirs[:, None, :]).any(2)
                good[i, j] = (same.sum(1) >= share) & (np.where(same, mine, np.iinfo(np.int32).max).min(1) == int(pivot))
            sums[places] += (good @ weights[second].astype(np.float64)).astype(np.int64)
            sums[second] += (weights[places].astype(np.float64) @ good).astype(np.int64)
            for s, row in zip(places.tolist(), good, strict=True):
                to = second[row]
                to = to[label[to] != label[s]]
                for old, k in zip(*(v.tolist() for v in np.unique(label[to], return_index=True)), strict=True):
                    forest.append((int(ids[s]), int(ids[to[k]])))
                    label[label == old] = label[s]
        full = np.flatnonzero(sums)
        a = [f[0] for f in forest] + ids[full].tolist()
        b = [f[1] for f in forest] + [None] * len(full)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_links": pa.array([None] * len(forest) + sums[full].tolist(), pa.int64())})

    return posted.groupBy("key").applyInArrow(check, "a bigint, b bigint, n_links bigint")
