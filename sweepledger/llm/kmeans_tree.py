"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

A tree of centres is fitted on a bounded sample, every vector is dealt to a leaf. A query walks
down the tree through a priority queue of branches, nearest centre first, and visits as many
leaves as a calibration against brute force found to reach the wanted recall. Its distances to
all vectors of these leaves are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .shared import ship

CHUNK = 2048
ANSWERS = pa.schema([("first_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Tree:
    """Centres of a k-means tree, as arrays: of each node its children, or its leaf number."""

    def __init__(self, sample: np.ndarray, branches: int, leaf_size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []  # of a node's children
        self.children: list[list[int]] = []  # a node's number, or -1 - leaf
        self.leaves = 0
        self.members: list[np.ndarray] = []  # of a leaf, from the sample
        self._grow(sample.astype(np.float64), branches, leaf_size, rng)

    def _grow(self, points: np.ndarray, branches: int, leaf_size: int, rng) -> int:
        groups = kmeans(points, branches, rng) if len(points) > leaf_size else None
        if groups is None:
            self.leaves += 1
            self.members.append(points)
            return -self.leaves
        node = len(self.centres)
        centres, member = groups
        self.centres.append(centres)
        self.children.append([])
        for k in range(len(centres)):
            child = self._grow(points[member == k], branches, leaf_size, rng)
            self.children[node].append(child)
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf each vector belongs to, by the nearest centre at every level."""
        out = np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))] if self.centres else []
        while waiting:
            node, rows = waiting.pop()
            nearest = squares(points[rows], self.centres[node]).argmin(axis=1)
            for k, child in enumerate(self.children[node]):
                some = rows[nearest == k]
                if not len(some):
                    continue
                if child < 0:
                    out[some] = -1 - child
                else:
                    waiting.append((child, some))
        return out

    def visits(self, query: np.ndarray, most: int, held: list[int] | None = None, needed: int = 0) -> list[int]:
        """Leaves in the order of a best-bin-first walk: ``most`` of them, and more only while these hold
        fewer than ``needed`` rows, by the leaves' counts ``held``."""
        if not self.centres:
            return [0]
        queue, found, rows = [(0.0, 0)], [], 0
        while queue and (len(found) < most or held and rows < needed):
            _, node = heapq.heappop(queue)
            while True:
                if node < 0:
                    found.append(-1 - node)
                    rows += held[-1 - node] if held else 0
                    break
                far = squares(query[None], self.centres[node])[0]
                near = int(far.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != near:
                        heapq.heappush(queue, (float(far[k]), child))
                node = self.children[node][near]
        return found


def squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, fast but rounded: for choosing centres only."""
    return (points**2).sum(1)[:, None] - 2 * points @ others.T + (others**2).sum(1)


def distances(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences."""
    return np.sqrt(((points - query) ** 2).sum(axis=1))


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8):
    """Centres and members of up to ``k`` non-empty groups, or None if the points cannot be parted."""
    distinct = np.unique(points, axis=0)
    if len(distinct) < 2:
        return None
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        member = squares(points, centres).argmin(axis=1)
        kept = np.unique(member)
        centres = np.stack([points[member == j].mean(axis=0) for j in kept])
    member = squares(points, centres).argmin(axis=1)
    kept, member = np.unique(member, return_inverse=True)
    return (centres[kept], member) if len(kept) > 1 else None


def calibrate(tree: Tree, sample: np.ndarray, queries: int, k: int, recall: float, seed: int) -> int:
    """The smallest number of visited leaves at which the sample's own queries find ``recall`` of their
    ``k`` nearest among the sample."""
    rng = np.random.default_rng(seed)
    leaf = tree.leaf_of(sample)
    visit = np.zeros(tree.leaves, np.int64)
    visits = []
    for q in rng.choice(len(sample), min(queries, len(sample)), replace=False):
        order = tree.visits(sample[q], tree.leaves)
        visit[order] = np.arange(len(order))
        visits.append(visit[leaf[np.argsort(distances(sample[q], sample), kind="stable")[1 : k + 1]]])
    needed = np.sort(np.concatenate(visits))
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else tree.leaves


def within(tree: Tree, query: np.ndarray, leaves: list[int], k: int) -> float:
    """A distance within which the query has ``k`` sample rows in the leaves it visits, infinite without as many."""
    met: list[np.ndarray] = []
    for leaf in leaves:
        met.append(tree.members[leaf])
        if sum(map(len, met)) >= 8 * k:
            break
    far = distances(query, np.concatenate(met))
    return float(np.partition(far, k - 1)[k - 1]) if len(far) >= k else float("inf")


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    sample_rows: int = 20_000,
    branches: int = 8,
    leaf_size: int = 128,
    recall: float = 0.97,
    calibration_queries: int = 200,
    seed: int = 10,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query row its ``k`` nearest other rows found, nearest first.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller ``vec_id``. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id, or whose vectors are not of the sample's most common length. A query is
    compared with all rows but those of its own id; rows of another id, however many, are one neighbour, at the
    nearest of their vectors. It gets fewer than ``k`` neighbours only if there are fewer ids. An empty table gives no rows.

    The tree and the number of visits come from ``sample_rows`` rows at most, drawn by a hash of their id; every
    row is indexed. Equal vectors are one entry with the ``k + 1`` smallest different ids, of which any
    query needs no more. Entries are cut into chunks within each leaf, as are the queries that
    visit it, and each chunk of ``CHUNK`` entries or so meets each of as many queries; the tree and a row per leaf of it, of bounded
    size, go to all tasks. Other joins are shuffled: no table of vectors passes through the driver.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    share = 0.95 * sample_rows / max(1, rows.count())
    drawn = rows if share >= 0.95 else rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    # One vector of each id, so that different points of the sample are different ids.
    picked = drawn.select("vec_id", "v").limit(sample_rows).toPandas().drop_duplicates("vec_id")
    if picked.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = picked["v"].map(len)
    size = int(lengths.mode().iloc[0])
    sample = np.stack(picked["v"][lengths == size].to_numpy()).astype(np.float64)
    distinct = np.unique(sample, axis=0)
    tree = Tree(distinct, branches, leaf_size, seed)
    visits = calibrate(tree, distinct, calibration_queries, k, recall, seed)
    sent = spark.sparkContext.broadcast((tree, visits))

    rows = rows.where(F.size("v") == size)
    ids = Window.partitionBy("v").orderBy("vec_id")
    entries = (
        rows.select("vec_id", "v").distinct().withColumn("place", F.row_number().over(ids))
        .where(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                yield batch.append_column("leaf", pa.array(sent.value[0].leaf_of(points)))

    dealt = stage(entries.mapInArrow(deal, "v array<double>, ids array<long>, leaf long"), "leaves")
    # Each id in one of its leaves only, so that leaves that hold so many ids together hold as many different ones.
    homes = dealt.select(F.explode("ids").alias("id"), "leaf").groupBy("id").agg(F.min("leaf").alias("leaf"))
    counts = dict(homes.groupBy("leaf").count().collect())  # at most one row per leaf of the tree
    held = spark.sparkContext.broadcast([counts.get(leaf, 0) for leaf in range(max(1, tree.leaves))])
    chunks = dealt.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                leaves = [sent.value[0].visits(p, sent.value[1], held.value, k + 1) for p in points]
                reach = [within(sent.value[0], p, some, k + 1) for p, some in zip(points, leaves)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(reach, pa.float64()), pa.array(leaves, pa.list_(pa.int64()))],
                    ["v", "first_id", "mark", "reach", "leaves"],
                )

    # Equal queries are asked once; the smallest of their ids and a checksum stand for the vector from here on.
    asker = ["first_id", "mark"]
    asked = rows.where("asks").groupBy("v").agg(F.min("vec_id").alias("first_id")).withColumn("mark", F.xxhash64("v"))
    walked = stage(asked.mapInArrow(walk, "v array<double>, first_id long, mark long, reach double, leaves array<long>"), "walks")
    visiting = walked.select("v", *asker, "reach", F.explode("leaves").alias("leaf"))
    groups = visiting.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / CHUNK).cast("int").alias("groups"))
    # At most one row per leaf of the tree, so the two joins with it broadcast this and never the vectors, which Spark takes for as
    # small as their files although each query comes once per leaf it visits. Written first, so that the broadcast waits for nothing.
    blocks = F.broadcast(stage(chunks.join(groups, "leaf"), "blocks"))
    key = ["leaf", "chunk", "group"]

    def block(df: DataFrame, own: str, parts: str, other: str, others: str) -> DataFrame:
        """Each row under its own part of the leaf and all parts of the other side."""
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other)
        part = F.pmod(F.xxhash64("v"), F.col(parts)).cast("int").alias(own)
        return df.join(blocks, "leaf").select(*df.columns, part, every)

    probes = block(visiting, "group", "groups", "chunk", "chunks")
    placed = block(dealt, "chunk", "chunks", "group", "groups")

    def compare(queries: pa.Table, entries: pa.Table) -> pa.Table:
        """Entries within each query's reach, by the distances of the original vectors."""
        if not queries.num_rows or not entries.num_rows:
            return ANSWERS.empty_table()
        q, e = (
            t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for t in (queries, entries)
        )
        reach = queries.column("reach").to_numpy()
        # Squares from products are rounded: a margin first, then exact distances.
        near = squares(q, e)
        margin = 1e-9 * ((q**2).sum(axis=1) + (e**2).sum(axis=1).max())
        by, at = np.nonzero(near <= (reach**2 + margin)[:, None])
        far = np.sqrt(((e[at] - q[by]) ** 2).sum(axis=1))
        kept = far <= reach[by] * (1 + 1e-12)
        by, at, far = by[kept], at[kept], far[kept]
        ids = entries.column("ids").combine_chunks()
        ends = ids.offsets.to_numpy()
        counts = np.diff(ends)[at]
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = ids.values.to_numpy()[np.repeat(ends[:-1][at], counts) + inside]
        each, far = np.repeat(by, counts), np.repeat(far, counts)
        # The block's k + 1 nearest different ids of each query: of an id the nearest, then the first of each query.
        order = np.lexsort((far, flat, each))
        first = np.r_[True, (np.diff(each[order]) != 0) | (np.diff(flat[order]) != 0)] if len(order) else order
        order = order[first]
        order = order[np.lexsort((flat[order], far[order], each[order]))]
        begins = np.searchsorted(each[order], each[order])
        order = order[np.arange(len(order)) - begins <= k]
        each, flat, far = each[order], flat[order], far[order]
        return pa.Table.from_arrays(
            [
                pa.array(queries.column("first_id").to_numpy()[each]),
                pa.array(queries.column("mark").to_numpy()[each]),
                pa.array(flat),
                pa.array(far),
            ],
            schema=ANSWERS,
        )

    each = (
        probes.groupBy(*key)
        .cogroup(placed.groupBy(*key))
        .applyInArrow(lambda q, e: compare(q, e), "first_id long, mark long, vec_id long, score double")
    )
    by_query = Window.partitionBy(*asker).orderBy("score", "vec_id")
    nearest_of_id = each.groupBy(*asker, "vec_id").agg(F.min("score").alias("score"))
    best = nearest_of_id.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k + 1)
    lists = best.groupBy(*asker).agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    found = walked.select("v", *asker).hint("merge").join(lists, asker).select("v", "near")
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").hint("merge").join(found, "v")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.select("query_id", F.posexplode(others).alias("place", "found")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), F.col("found.score").alias("score")
    )
