"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

Vectors are dealt to shards by a top tree that halves a bounded sample of them; what a shard holds beyond SHARD_ROWS is salted, so
copies of one vector don't meet in one task.  A shard has a centre and a radius, and within it a ball tree is built, once, past which
its queries are streamed in batches.  A ball (centre c, radius r) holds no score above q.c + |q| r: nodes are taken from a heap in the
order of that bound until it falls below the k-th score so far.  Every query first goes to its most promising shard alone; the k-th
score that it finds there is the bound that all other shards share, and shards whose own bound lies below it never see the query.

The driver holds the sample, and a centre and a radius for each of at most MAX_SHARDS shards; it sees no other vector.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, neither as query nor as candidate.
Vectors meet only vectors of the same length.  Ties go to the smaller id.  Repeated ids are separate candidates, but a row never
meets a row of its own id; queries that share an id have ranks of their own each, if their vectors differ.  An empty table gives no
rows.  Scores that might not fit a long are refused by an error.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fraction

#: Vectors of a shard and queries that meet one copy of it, about; they bound a task's memory.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS, MAX_SHARDS, SAMPLE, SEED = 8192, 65_536, 256, 16_384, 20_000, 1


def usable(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component as long, or null if the vector takes no part."""
    ok = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(ok, F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double"))))


class BallTree:
    """Nodes as arrays; leaves are ranges of ``order``."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.centres, self.radii, self.children, self.ranges = [], [], [], []
        self._split(points, 0, len(points), leaf_rows)
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _split(self, points: np.ndarray, a: int, b: int, leaf_rows: int) -> None:
        pending = [(a, b, -1)]
        while pending:
            a, b, parent = pending.pop()
            own = points[self.order[a:b]]
            centre = own.mean(axis=0)
            away = ((own - centre) ** 2).sum(axis=1)
            node = len(self.radii)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(away.max())))
            self.ranges.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > leaf_rows:
                first = own[away.argmax()]
                second = own[((own - first) ** 2).sum(axis=1).argmax()]
                side = np.argsort(own @ (second - first), kind="stable")  # halves by the axis of two far points
                self.order[a:b] = self.order[a:b][side]
                mid = (a + b) // 2
                pending += [(a, mid, node), (mid, b, node)]


class Splits:
    """The top tree of one vector length: halves of a sample, down to ``depth`` cuts, and the mean of each leaf."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth if len(sample) else 0
        self.axes, self.at = np.zeros(((1 << self.depth) - 1, sample.shape[1])), np.zeros((1 << self.depth) - 1)
        groups = [np.arange(len(sample))]
        for level in range(self.depth):
            halves = []
            for i, rows in enumerate(groups):
                own, node = sample[rows], (1 << level) - 1 + i
                if len(own):
                    away = ((own - own.mean(axis=0)) ** 2).sum(axis=1)
                    first = own[away.argmax()]
                    self.axes[node] = own[((own - first) ** 2).sum(axis=1).argmax()] - first
                    self.at[node] = np.median(own @ self.axes[node])
                side = own @ self.axes[node] > self.at[node]
                halves += [rows[~side], rows[side]]
            groups = halves
        self.centres = np.array([sample[g].mean(axis=0) if len(g) else np.zeros(sample.shape[1]) for g in groups])

    def leaves(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for level in range(self.depth):
            place = (1 << level) - 1 + node
            node = 2 * node + ((points * self.axes[place]).sum(axis=1) > self.at[place])
        return node


def _matrix(lists) -> np.ndarray:
    return np.array(list(lists), dtype=np.int64).reshape(len(lists), -1)


class Shard:
    """The points of one shard with their ball tree."""

    def __init__(self, points: pd.DataFrame, exact: bool):
        self.ids = points["id"].to_numpy()
        self.points = _matrix(points["v"])
        self.tree = BallTree(self.points.astype(float))
        self.exact = exact  # products of doubles are exact below 2**53, and much faster
        if exact:
            self.points = self.points.astype(float)

    def search(self, queries: pd.DataFrame, k: int) -> pd.DataFrame:
        """The k best for each query, of those that reach its floor."""
        q = _matrix(queries["v"])
        qf = q.astype(float)
        q = qf if self.exact else q
        bounds = qf @ self.tree.centres.T + np.sqrt((qf**2).sum(axis=1))[:, None] * self.tree.radii
        bounds += 1e-6 + 1e-9 * np.abs(bounds)
        kept: list[tuple[int, int, int, int]] = []
        for i, (qid, qkey, floor) in enumerate(zip(queries["id"], queries["qkey"], queries["floor"], strict=True)):
            best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
            least = -np.inf if pd.isna(floor) else floor
            heap = [(-bounds[i, 0], 0)]
            while heap and -heap[0][0] >= least:
                _, node = heapq.heappop(heap)
                if self.tree.children[node]:
                    for child in self.tree.children[node]:
                        if bounds[i, child] >= least:
                            heapq.heappush(heap, (-bounds[i, child], child))
                    continue
                rows = self.tree.order[slice(*self.tree.ranges[node])]
                scores = self.points[rows] @ q[i]
                for at in np.flatnonzero(scores >= least):
                    if self.ids[rows[at]] != qid:
                        hit = (int(scores[at]), -int(self.ids[rows[at]]))
                        if len(best) < k:
                            heapq.heappush(best, hit)
                        elif hit > best[0]:
                            heapq.heapreplace(best, hit)
                if len(best) == k:
                    least = max(least, best[0][0])
            kept += [(qid, qkey, -neg, score) for score, neg in best]
        return pd.DataFrame(kept, columns=["query_id", "qkey", "vec_id", "score"]).astype("int64")


def _stream(k: int, exact: bool):
    """Rows in the order (shard, block, kind): a shard's points, then the queries that are to pass it."""

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, points, shard = None, [], None
        for pdf in it:
            for key, own in pdf.groupby(["shard", "block", "kind"], sort=True):
                if key[:2] != at:
                    at, points, shard = key[:2], [], None
                if key[2] == 0:
                    points.append(own)
                elif points:
                    shard = shard or Shard(pd.concat(points), exact)
                    yield shard.search(own, k)

    return task


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``queries``(query_id, vector) against ``vectors``(vec_id, vector): query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    largest = lambda v: F.array_max(F.transform(F.col(v), lambda x: F.abs(F.lit(scale) * x.cast("double")))) + 1
    slim = lambda df, key: df.select(F.col(key).cast("long").alias("id"), usable("vector", scale).alias("v"), largest("vector").alias("most")).where("v is not null and id is not null")
    q, p = durable(slim(queries, "query_id").withColumn("dim", F.size("v")).withColumn("qkey", F.xxhash64("v"))), slim(vectors, "vec_id").withColumn("dim", F.size("v"))
    asked, held = q.agg(F.count("*").alias("n"), F.max("most").alias("m")).first(), p.agg(F.count("*").alias("n"), F.max("most").alias("m"), F.max("dim").alias("dim")).first()
    room = float(held["m"] or 1) * float(asked["m"] or 1) * (held["dim"] or 1)
    if room >= 2.0**62:
        raise ValueError("components are so large that scores don't fit a long: choose a smaller scale")
    exact = room < 2.0**52

    # the top tree, from a bounded sample, and every vector's leaf
    sample = p.where(fraction(SEED, "id", "v") < min(1.0, SAMPLE / max(1, held["n"]))).select("dim", "v").limit(2 * SAMPLE).toPandas()
    depth = min(max(0, (-(-held["n"] // SHARD_ROWS) - 1).bit_length()), MAX_SHARDS.bit_length() - 1)
    tops = {int(d): Splits(_matrix(g["v"]).astype(float), depth) for d, g in sample.groupby("dim")}
    top = spark.sparkContext.broadcast(tops)  # at most 2 * MAX_SHARDS numbers for each component

    def dealt(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for d, g in pdf.groupby("dim"):
                tree, points = top.value.get(int(d)), _matrix(g["v"]).astype(float)
                leaf = tree.leaves(points) if tree else np.zeros(len(g), dtype=np.int64)
                centre = tree.centres[leaf] if tree else np.zeros_like(points)
                yield g.assign(leaf=leaf, away=np.sqrt(((points - centre) ** 2).sum(axis=1)))

    p = durable(p.select("id", "v", "dim").mapInPandas(dealt, "id long, v array<bigint>, dim int, leaf long, away double"))
    balls = p.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toPandas()  # at most MAX_SHARDS for a length
    rows = max(SHARD_ROWS, -(-held["n"] // MAX_SHARDS))
    balls["salts"] = -(-balls["n"] // rows)
    balls["first"] = balls["salts"].cumsum() - balls["salts"]
    table = {}
    for d, g in balls.groupby("dim"):
        tree = tops.get(int(d))
        centres = tree.centres[g["leaf"].to_numpy()] if tree else np.zeros((len(g), int(d)))
        table[int(d)] = (centres, g["radius"].to_numpy(), g["first"].to_numpy(), g["salts"].to_numpy())
    sent = spark.sparkContext.broadcast(table)

    def routed(first: bool):
        """Each query with the shards it is to visit: those of its most promising ball, or of all others whose bound reaches its floor."""

        def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for d, g in pdf.groupby("dim"):
                    if int(d) not in sent.value:
                        continue
                    centres, radii, start, salts = sent.value[int(d)]
                    points = _matrix(g["v"]).astype(float)
                    near = points @ centres.T
                    bounds = near + np.sqrt((points**2).sum(axis=1))[:, None] * radii
                    bounds += 1e-6 + 1e-9 * np.abs(bounds)
                    best = near.argmax(axis=1)
                    if first:
                        i, j = np.arange(len(g)), best
                    else:
                        floor = g["floor"].fillna(-np.inf).to_numpy()
                        reach = bounds >= floor[:, None]
                        reach[np.arange(len(g)), best] = False
                        i, j = np.nonzero(reach)
                    i, j = np.repeat(i, salts[j]), np.repeat(j, salts[j])
                    salt = np.arange(len(i)) - np.maximum.accumulate(np.where(np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0)], np.arange(len(i)), 0)) if len(i) else i
                    yield pd.DataFrame({"id": g["id"].to_numpy()[i], "qkey": g["qkey"].to_numpy()[i], "floor": g["floor"].to_numpy()[i], "v": g["v"].to_numpy()[i], "shard": start[j] + salt})

        return task

    spread = F.broadcast(spark.createDataFrame(balls[["dim", "leaf", "first", "salts"]].astype("int64"), "dim int, leaf long, first long, salts long"))
    placed = p.join(spread, ["dim", "leaf"]).select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("salts"))).alias("shard"))

    def found(asking: DataFrame, first: bool) -> DataFrame:
        visits = durable(asking.mapInPandas(routed(first), "id long, qkey long, floor double, v array<bigint>, shard long"))
        blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
        ones = placed.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        own = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id", "qkey"), F.col("blocks")).cast("int"))
        points = ones.select("shard", "block", F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("qkey"), F.lit(None).cast("double").alias("floor"), "v")
        both = points.unionByName(own.select("shard", "block", F.lit(1).alias("kind"), "id", "qkey", "floor", "v"))
        ordered = both.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
        return durable(best(ordered.mapInPandas(_stream(k, exact), "query_id long, qkey long, vec_id long, score long")))

    def best(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    q = q.select("id", "qkey", "v", "dim").dropDuplicates(["id", "qkey"])
    one = found(q.withColumn("floor", F.lit(None).cast("double")), True)
    floors = one.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "qkey", F.col("score").cast("double").alias("floor"))
    two = found(q.join(floors, ["id", "qkey"], "left"), False)
    return best(one.drop("rank").unionByName(two.drop("rank"))).select("query_id", "rank", "vec_id", "score")
