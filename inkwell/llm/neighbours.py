"""Operator 3: approximate nearest neighbours by largest inner product.

Method: low-dimensional stable projections indexed by a kd-tree. One more component turns the
largest inner product into the smallest Euclidean distance; DIMENSIONS Gaussian (2-stable)
projections of it are indexed by a kd-tree whose leaves know the box around their points. A query
looks at projected neighbours in rounds - the leaf whose box is nearest, then GROWTH times as many in
each round, by distance - and verifies them on the original vectors. A chi-square test stops it: at a
projected distance within which a vector closer than the K-th found would have its projection with
probability CONFIDENCE; that distance shrinks after every round, and nothing beyond is looked at.

The tree's splits are fitted on a bounded sample (SAMPLE vectors, by hash); every vector is indexed.
Equal vectors are one entry of the index, which keeps the smallest ids that a result can need; so
many copies make neither a large leaf nor many pairs. Scores are double-precision inner products of
the original vectors.

Vectors that are null, zero or hold null or non-finite components take no part. Vectors of different
lengths have no inner product: each length is searched by itself. Null vec_id: takes no part. Ties: the smaller vec_id first. Repeated rows, that is one vec_id twice: each counts as a
candidate of others, none of its own. Empty table: no rows. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 20
DIMENSIONS = 16
CONFIDENCE = 0.97
SAMPLE = 20_000
#: Distinct vectors per leaf aimed at, and most leaves; a larger leaf is searched in blocks.
LEAF = 512
LEAVES = 4096
GROWTH = 4
BLOCK = 16_384
#: Queries searched together in one block of a leaf.
TOGETHER = 4096


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number m of degrees of freedom."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


@dataclass
class Tree:
    """Projection and splits; leaf i's points are from low[i] to high[i]."""

    radius: float  # largest norm
    projection: np.ndarray
    axis: list[int]
    at: list[float]
    left: list[int]  # of an inner node: number of its left child, the right one follows; of a leaf: minus one minus its number
    leaves: int
    low: np.ndarray | None = None  # corners of the boxes around the leaves' points
    high: np.ndarray | None = None

    def project(self, v: np.ndarray) -> np.ndarray:
        """Projected entries."""
        rest = np.sqrt(np.maximum(self.radius**2 - (v * v).sum(1), 0))
        return np.column_stack([v, rest]) @ self.projection

    def project_queries(self, q: np.ndarray) -> np.ndarray:
        """Projected queries; a query's length doesn't change its order of neighbours, so all get the largest norm."""
        scaled = q * (self.radius / np.sqrt((q * q).sum(1)))[:, None]
        return scaled @ self.projection[:-1]

    def leaf(self, z: np.ndarray) -> np.ndarray:
        """The leaf of each projected point."""
        out = np.zeros(len(z), np.int32)
        pending = [(0, np.arange(len(z)))]
        while pending:
            node, rows = pending.pop()
            if self.left[node] < 0:
                out[rows] = -1 - self.left[node]
                continue
            right = z[rows, self.axis[node]] > self.at[node]
            pending += [(self.left[node], rows[~right]), (self.left[node] + 1, rows[right])]
        return out

    def distances(self, z: np.ndarray) -> np.ndarray:
        """Squared distance of each projected point to each leaf's box; infinite for a leaf without points."""
        out = np.zeros((len(z), self.leaves))
        for j in range(z.shape[1]):
            x = z[:, j : j + 1]
            out += np.square(np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0))
        return out


def build(sample: np.ndarray, radius: float, leaves: int) -> Tree:
    """kd-tree over the projected sample: always splits the fullest leaf at its median along its widest axis."""
    width = sample.shape[1]
    projection = np.random.default_rng(3).normal(size=(width + 1, DIMENSIONS))
    tree = Tree(radius, projection, [0], [0.0], [-1], 1)
    z = tree.project(sample)
    held = [(0, np.arange(len(z)))]
    done = []
    while held and len(held) + len(done) < leaves:
        held.sort(key=lambda x: len(x[1]))
        node, rows = held.pop()
        spread = z[rows].max(0) - z[rows].min(0) if len(rows) > 1 else np.zeros(DIMENSIONS)
        axis = int(spread.argmax())
        if spread[axis] <= 0:
            done.append((node, rows))
            continue
        middle = float(np.median(z[rows, axis]))
        right = z[rows, axis] > middle
        if not right.any():  # the median is the largest value
            middle = float(z[rows, axis][z[rows, axis] < middle].max())
            right = z[rows, axis] > middle
        tree.axis[node], tree.at[node], tree.left[node] = axis, middle, len(tree.left)
        for side in (~right, right):
            held.append((len(tree.left), rows[side]))
            tree.axis.append(0)
            tree.at.append(0.0)
            tree.left.append(-1)
    done += held
    for k, (node, _) in enumerate(done):
        tree.left[node] = -1 - k
    tree.leaves = len(done)
    return tree


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (little-endian doubles) and width of the vectors that take part, of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column("embedding"), batch.column("vec_id")
            at = np.asarray(column.offsets, np.int64)
            x = np.asarray(column.values.cast(pa.float64()).fill_null(math.nan), "<f8") + 0.0  # no negative zeros, so equal vectors have equal bytes
            bad, some = (np.concatenate(([0], np.cumsum(flag))) for flag in (~np.isfinite(x), x != 0))
            good = np.asarray(column.is_valid()) & np.asarray(ids.is_valid()) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            rows = np.flatnonzero(good)
            made = [x[at[i] : at[i + 1]].tobytes() for i in rows.tolist()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(made, pa.binary()), pa.array(np.diff(at)[rows], pa.int32())], names=["vec_id", "vec", "width"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, vec binary, width int")


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A binary column of equally long double vectors as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1) if values else np.empty((0, 0))


def stop_radius(tree: Tree, q: np.ndarray, score: np.ndarray, quantile: float) -> np.ndarray:
    """Squared projected distance at which the test holds, given the K-th score found so far."""
    norm = np.sqrt((q * q).sum(1))
    near = np.maximum(2 * tree.radius**2 - 2 * tree.radius * score / norm, 0) * (1 + 1e-9) + 1e-12 * tree.radius**2
    return np.where(np.isfinite(score), near * quantile, np.inf)


def search_leaf(tree: Tree, q: np.ndarray, known: np.ndarray, v: np.ndarray, smallest: np.ndarray, copies: np.ndarray, quantile: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query: (entries, scores) of up to K + 1 best entries of this block.

    known: the K-th score that the query has already (minus infinity if none). Verified are the
    entries with a projection within the distance that the test asks for at that score; kept are
    those that reach it.
    """
    far = _squares(tree.project_queries(q), tree.project(v))
    near = far <= stop_radius(tree, q, known, quantile)[:, None] * (1 + 1e-9)
    score = q @ v.T
    slack = 1e-9 * tree.radius * np.sqrt((q * q).sum(1))
    score[~near] = -np.inf
    count = min(K + 1, len(v))
    top = np.partition(score, len(v) - count, axis=1)[:, len(v) - count]
    floor = np.maximum(np.where(np.isfinite(top), top, -np.inf), known) - slack
    for i in range(len(q)):
        at = np.flatnonzero(near[i] & (score[i] >= floor[i]))
        exact = (v[at] * q[i]).sum(1)
        rank = np.lexsort((smallest[at], -exact))
        enough = int(np.searchsorted(np.cumsum(copies[at[rank]]), K + 1)) + 1
        rank = rank[: min(K + 1, enough)]
        rank = rank[exact[rank] >= known[i]]
        yield at[rank], exact[rank]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


_FOUND = "key binary, scores array<double>, ids array<array<bigint>>"


def _searched(probes: DataFrame, index: DataFrame, tree: Tree, quantile: float) -> DataFrame:
    """key and what search_leaf gives for every probe (key, q, known, leaf, block, part) in its block of a leaf."""

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, scores, ids = [], [], []
        if left.num_rows and right.num_rows:
            v = rows_of(right.column("vec"))
            own = right.column("ids").to_pylist()
            smallest, copies = np.array([x[0] for x in own]), np.array([len(x) for x in own])
            for lo in range(0, left.num_rows, 256):
                some = left.slice(lo, 256)
                found = search_leaf(tree, rows_of(some.column("q")), np.asarray(some.column("known")), v, smallest, copies, quantile)
                for key, (at, score) in zip(some.column("key").to_pylist(), found, strict=True):
                    if len(at):
                        keys.append(key)
                        scores.append(score.tolist())
                        ids.append([own[a] for a in at.tolist()])
        return pa.table({"key": pa.array(keys, pa.binary()), "scores": pa.array(scores, pa.list_(pa.float64())), "ids": pa.array(ids, pa.list_(pa.list_(pa.int64())))})

    by = ("leaf", "block", "part")
    return probes.groupBy(*by).cogroup(index.groupBy(*by)).applyInArrow(run, _FOUND)


def boxes(index: DataFrame, tree: Tree) -> np.ndarray:
    """Sets the corners of the leaves' boxes; returns the number of entries of each leaf."""
    schema = "leaf int, n long, low array<double>, high array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((tree.leaves, DIMENSIONS), np.inf), np.full((tree.leaves, DIMENSIONS), -np.inf)
        n = np.zeros(tree.leaves, np.int64)
        for batch in batches:
            if len(batch):
                leaf, z = np.asarray(batch.column("leaf")), tree.project(rows_of(batch.column("vec")))
                np.minimum.at(low, leaf, z)
                np.maximum.at(high, leaf, z)
                n += np.bincount(leaf, minlength=tree.leaves)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(n[has]), *(pa.array(x[has].tolist(), pa.list_(pa.float64())) for x in (low, high))], names=["leaf", "n", "low", "high"])

    corners = [f(F.col(side)[j]).alias(f"{side}{j}") for side, f in (("low", F.min), ("high", F.max)) for j in range(DIMENSIONS)]
    sizes = np.zeros(tree.leaves, np.int64)
    tree.low, tree.high = np.full((tree.leaves, DIMENSIONS), np.inf), np.full((tree.leaves, DIMENSIONS), np.inf)
    for row in index.select("vec", "leaf").mapInArrow(run, schema).groupBy("leaf").agg(F.sum("n").alias("n"), *corners).collect():
        sizes[row["leaf"]] = row["n"]
        tree.low[row["leaf"]], tree.high[row["leaf"]] = [row[f"low{j}"] for j in range(DIMENSIONS)], [row[f"high{j}"] for j in range(DIMENSIONS)]
    return sizes


def best(found: DataFrame, k: int) -> DataFrame:
    """key and the k + 1 best (less: minus the score, vec_id) of found."""
    some = found.select("key", F.explode(F.arrays_zip("scores", "ids")).alias("e"))
    some = some.select("key", F.transform("e.ids", lambda i: F.struct((-F.col("e.scores")).alias("less"), i.alias("vec_id"))).alias("some"))
    return some.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k + 1).alias("found"))


def neighbours(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each vec_id divisible by every."""
    rows = common.cut(usable(vectors), "vectors")
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in rows.select("width").distinct().orderBy("width").collect():
        found = found.unionByName(_of_one_length(rows.where(F.col("width") == row["width"]), every, k))
    return found


def _of_one_length(rows: DataFrame, every: int, k: int) -> DataFrame:
    rows = rows.select("vec_id", "vec", F.unhex(F.md5("vec")).alias("key"))
    # the k + 1 smallest ids of each distinct vector are all that a result can need: one may be the query's own
    ids = F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1)
    partial = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).groupBy("key", "salt").agg(F.first("vec").alias("vec"), ids.alias("ids"))
    entries = common.cut(partial.groupBy("key").agg(F.first("vec").alias("vec"), F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")), "entries")
    sample = rows_of(pa.array([bytes(r["vec"]) for r in entries.orderBy("key").limit(SAMPLE).select("vec").collect()], pa.binary()))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = rows_of(batch.column("vec"))
            yield pa.RecordBatch.from_arrays([pa.array(np.sqrt((v * v).sum(1)) if len(v) else [], pa.float64())], names=["norm"])

    n, radius = entries.select("vec").mapInArrow(norms, "norm double").agg(F.count("*"), F.max("norm")).first()
    tree = build(sample, radius, max(1, min(LEAVES, n // LEAF)))
    quantile = chi_square_quantile(CONFIDENCE, DIMENSIONS)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf(tree.project(rows_of(batch.column("vec")))) if len(batch) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec", "ids", "seed", "leaf"])

    index = common.cut(entries.select("vec", "ids", F.xxhash64("key").alias("seed")).mapInArrow(placed, "vec binary, ids array<bigint>, seed long, leaf int"), "index")
    sizes = boxes(index, tree)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    state = common.cut(queries.groupBy("key").agg(F.first("vec").alias("q")).select("key", "q", F.lit(float("-inf")).alias("known"), F.expr("cast(array() as array<struct<less: double, vec_id: bigint>>)").alias("found")), "queries")
    first, last = 0, 1
    while first < tree.leaves:
        probes = common.cut(_next_leaves(state, tree, quantile, first, last), "probes")
        asked = probes.groupBy("leaf").count().toArrow()  # a row for each leaf at most
        if not asked.num_rows:
            break
        leaf, count = np.asarray(asked.column("leaf")), np.asarray(asked.column("count"))
        plan = [(int(a), int(-(-sizes[a] // BLOCK)), int(-(-c // TOGETHER))) for a, c in zip(leaf, count, strict=True)]
        plan = F.broadcast(rows.sparkSession.createDataFrame(plan, "leaf int, blocks int, parts int"))
        there = index.join(plan, "leaf").select("vec", "ids", "leaf", F.pmod("seed", F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        here = probes.join(plan, "leaf").select("key", "q", "known", "leaf", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        new = best(common.cut(_searched(here, there, tree, quantile), "found"), k).withColumnRenamed("found", "more")
        joined = state.join(new, "key", "left").withColumn("found", F.slice(F.sort_array(F.concat("found", F.coalesce("more", F.expr("cast(array() as array<struct<less: double, vec_id: bigint>>)")))), 1, k + 1))
        # the k + 1 best, a query's own vector among them, give the score to beat
        known = F.when(F.size("found") > k, -F.get("found", F.lit(k))["less"]).otherwise(F.lit(float("-inf")))
        before, state = state, common.cut(joined.select("key", "q", known.alias("known"), "found"), "queries")
        common.discard(before, probes)
        first, last = last, min(tree.leaves, last * GROWTH)
    each = queries.select(F.col("vec_id").alias("query_id"), "key").join(state.select("key", "found"), "key")
    own = F.slice(F.filter("found", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    out = each.select("query_id", F.posexplode(own).alias("pos", "e"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.less")).alias("score"))


def _next_leaves(state: DataFrame, tree: Tree, quantile: float, first: int, last: int) -> DataFrame:
    """key, q, known and each leaf that is first-th to before last-th by distance and that the test doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                some = batch.slice(lo, 256)
                q, known = rows_of(some.column("q")), np.asarray(some.column("known"), float)
                far = tree.distances(tree.project_queries(q))
                order = np.argsort(far, axis=1, kind="stable")[:, first:last]
                with np.errstate(invalid="ignore"):
                    near = np.take_along_axis(far, order, 1)
                    near = (near <= stop_radius(tree, q, known, quantile)[:, None]) & np.isfinite(near)
                row, column = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(row)) for c in ("key", "q", "known")), pa.array(order[row, column], pa.int32())], names=["key", "q", "known", "leaf"])

    return state.select("key", "q", "known").mapInArrow(run, "key binary, q binary, known double, leaf int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(common.table(spark, sf_dir, "embeddings"))
