"""Approximate nearest neighbours by inner product: probed lists, scanned a few dimensions at a time.

1. One more component turns largest inner product into smallest distance (it lifts every vector to the
   longest one's norm); a random rotation then spreads distance evenly over the components.
2. Centroids are fitted on a bounded sample (`SAMPLE` vectors, smallest hash of the id first); every vector is
   indexed under its nearest centroid.
3. A query first probes the lists nearest to it, until they hold `FIRST` x k candidates.  Then a test per list: from
   the distance to its centroid and the spread of its members follows how many of them can be expected nearer
   than the k-th best so far.  Lists are added, the most promising first, until all others together are expected
   to hold less than the share `MISSED` of what all lists hold.  So the share of lists that a query looks into falls
   as lists and structure grow; nothing is fixed by a number of lists.
4. In a list, candidates lie in column blocks.  The first block's partial distances of all queries at once are a
   matrix product; after each block a hypothesis test compares the partial distance, scaled to all components, with
   the distance of the k-th best so far, and abandons pairs that could pass only by a rare error.
5. Survivors are scored exactly, in double precision, component by component, on the original vectors.

A list is cut into cells of about `CELL` candidates and as many queries, so a list that holds a third of
all vectors is spread like any other.  Only the centroids, sizes and spreads of lists and the sample reach the driver;
all are bounded by parameters.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
vec_id or of another dimension than most (ties: the smaller).  Of rows that share a vec_id the smallest vector
counts.  No query or no candidate gives no rows; fewer than k candidates give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import importable, map_batches, stored

SAMPLE = 40_000
MOST_LISTS = 4096
FIRST = 20  # times k: candidates looked at before lists are tested
MISSED = 0.1  # share of the k nearest that the lists left out may be expected to hold
CELL = 8_000
TOGETHER = 128  # queries scanned at once
SPARSE = 0.02  # share of pairs left from which they are taken one by one
BLOCK = 13  # components per column block
CONFIDENCE = 2.1
ROUNDS = 8


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, one per id."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.filter(fine & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


class Index:
    """Rotation, norm and centroids; small enough to send to every task."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int) -> None:
        rng = np.random.default_rng(7)
        self.longest = longest
        self.rotation = np.linalg.qr(rng.standard_normal((sample.shape[1] + 1,) * 2))[0]
        points = self.rotated(sample)
        self.centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
        for _ in range(ROUNDS):
            owner = self.nearest(points)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, owner, points)
            sizes = np.bincount(owner, minlength=len(sums))
            filled = sizes > 0
            self.centroids[filled] = sums[filled] / sizes[filled, None]

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0.0))
        return np.concatenate([vectors, lift[:, None]], 1) @ self.rotation

    def as_query(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.rotation[:-1]

    def distances(self, points: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(1) - 2 * points @ self.centroids.T

    def nearest(self, points: np.ndarray) -> np.ndarray:
        return np.concatenate([self.distances(points[i : i + 1024]).argmin(1) for i in range(0, len(points), 1024)])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def fit(vectors: DataFrame, lists: int | None = None) -> Index | None:
    sizes = vectors.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("m"))
    top = sizes.orderBy(F.desc("n"), "d").first()
    if top is None:
        return None
    sample = vectors.filter(F.size("vector") == top["d"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = np.stack([np.array(r["vector"]) for r in sample.select("vector").collect()])
    return Index(sample, float(np.sqrt(top["m"])), lists or max(1, min(MOST_LISTS, int(top["n"] ** 0.5 / 4))))


def _indexed(vectors: DataFrame, index: Index) -> DataFrame:
    dimension = len(index.rotation) - 1

    def place(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        if len(batch):
            points = index.rotated(_matrix(batch.column("vector")))
            lists = index.nearest(points)
            off = ((points - index.centroids[lists]) ** 2).sum(1)
            yield {"vec_id": batch.column("vec_id"), "vector": batch.column("vector"), "list": lists, "off": off}

    fitting = vectors.filter(F.size("vector") == dimension)
    return map_batches(fitting, place, "vec_id bigint, vector array<double>, list int, off double")


class Lists:
    """Members of each list: how many, and mean and variance of their squared distance to the centroid."""

    def __init__(self, placed: DataFrame, number: int) -> None:
        self.held, self.mean, self.variance = np.zeros(number), np.zeros(number), np.zeros(number)
        for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.avg("off").alias("m"), F.var_pop("off").alias("v")).collect():
            self.held[r["list"]], self.mean[r["list"]], self.variance[r["list"]] = r["n"], r["m"], r["v"]

    def expected_nearer(self, distances: np.ndarray, limits: np.ndarray, dimension: int) -> np.ndarray:
        """(query, list): members expected within the limit, their distances taken as normal around what the
        centroid's distance and the members' spread say."""
        spread = np.sqrt(4 * distances * self.mean / dimension + self.variance) + 1e-12
        z = (limits[:, None] - distances - self.mean) / spread
        return self.held * _normal(z)


def _normal(z: np.ndarray) -> np.ndarray:
    """Distribution function of the normal distribution, to about 1e-4."""
    return 1.0 / (1.0 + np.exp(-np.clip(z * (1.5976 + 0.070566 * z * z), -500, 500)))


_PROBE = "query_id bigint, vector array<double>, list int, limit double"


def _first_probes(queries: DataFrame, index: Index, lists: Lists, enough: int) -> DataFrame:
    """The nearest lists that hold `enough` candidates together."""

    def probe(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        for low in range(0, len(batch), 512):
            part = batch.slice(low, 512)
            order = index.distances(index.as_query(_matrix(part.column("vector")))).argsort(1)
            many = np.minimum((lists.held[order].cumsum(1) < enough).sum(1) + 1, order.shape[1])
            at = np.repeat(np.arange(len(part)), many)
            chosen = np.concatenate([o[:m] for o, m in zip(order, many)]) if len(part) else np.zeros(0, int)
            yield {"query_id": part.column("query_id").take(pa.array(at)), "vector": part.column("vector").take(pa.array(at)), "list": chosen, "limit": np.full(len(at), np.inf)}

    return map_batches(queries, probe, _PROBE)


def _further_probes(queries: DataFrame, index: Index, lists: Lists, enough: int, missed: float) -> DataFrame:
    """The lists that the first probes left out and that may hold some of the k nearest.

    `queries` has the score of the k-th best so far as ``worst``, null where there are fewer.
    """
    dimension = len(index.rotation)

    def probe(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        for low in range(0, len(batch), 512):
            part = batch.slice(low, 512)
            vectors = _matrix(part.column("vector")) if len(part) else np.zeros((0, dimension - 1))
            own = (vectors**2).sum(1)
            apart = np.maximum(index.distances(index.as_query(vectors)) + own[:, None], 0.0)
            order = apart.argsort(1)
            many = np.minimum((lists.held[order].cumsum(1) < enough).sum(1) + 1, order.shape[1])
            worst = part.column("worst").to_numpy(zero_copy_only=False).astype(np.float64)
            limits = np.where(np.isnan(worst), np.inf, own + index.longest**2 - 2 * worst)
            chance = lists.expected_nearer(apart, limits, dimension)
            chance[np.isinf(limits)] = lists.held  # too few found: all lists count
            # what all lists together are expected to hold is one whole, so the estimate's own bias cancels
            whole = chance.sum(1)[:, None]
            np.put_along_axis(chance, order, np.where(np.arange(order.shape[1]) < many[:, None], 0.0, np.take_along_axis(chance, order, 1)), 1)
            ranked = (-chance).argsort(1)
            value = np.take_along_axis(chance, ranked, 1)
            left = value.sum(1)[:, None] - value.cumsum(1) + value  # with this list and those after it
            wanted = (left > np.where(np.isinf(limits)[:, None], 0.0, missed * whole)) & (value > 0)
            at, place = np.nonzero(wanted)
            yield {"query_id": part.column("query_id").take(pa.array(at)), "vector": part.column("vector").take(pa.array(at)), "list": ranked[at, place], "limit": limits[at]}

    return map_batches(queries, probe, _PROBE)


def _scan(blocks: list[np.ndarray], queries: np.ndarray, k: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) positions that may be among each query's k nearest, abandoned block by block.

    `limits`: squared distance of each query's k-th best so far, infinite where it is not known; the k candidates
    with the smallest partial distance stand in for it then.
    """
    number, whole = len(blocks[0]), queries.shape[1]
    edges = np.cumsum([0] + [b.shape[1] for b in blocks])
    parts = [queries[:, a:b] for a, b in zip(edges, edges[1:])]

    def block(step: int, columns: np.ndarray | slice) -> np.ndarray:
        own = blocks[step][columns]
        return (own**2).sum(1) - 2 * parts[step] @ own.T + (parts[step] ** 2).sum(1)[:, None]

    partial = block(0, slice(None))
    limit = limits.astype(np.float32)
    seeds = np.zeros((len(queries), 0), np.int64)
    if np.isinf(limit).any():
        if number <= k:
            return np.repeat(np.arange(len(queries)), number), np.tile(np.arange(number), len(queries))
        seeds = np.argpartition(partial, k - 1, axis=1)[:, :k]
        limit = np.minimum(limit, sum(((b[seeds] - p[:, None]) ** 2).sum(2) for b, p in zip(blocks, parts)).max(1))
    slack = 1e-5 * (limit + np.abs(partial).max(initial=0.0))  # of single precision

    def bound(step: int) -> np.ndarray:
        done = edges[step + 1]
        test = limit * (1 + CONFIDENCE / np.sqrt(done)) ** 2 * done / whole
        return (limit if done == whole else np.minimum(test, limit)) + slack

    columns = np.arange(number)
    alive = partial <= bound(0)[:, None]
    step = 1
    while step < len(blocks) and alive.mean() > SPARSE:
        # many pairs left: a matrix product with the candidates that any query still wants
        wanted = alive.any(0)
        columns, partial, alive = columns[wanted], partial[:, wanted], alive[:, wanted]
        partial = partial + block(step, columns)
        alive &= partial <= bound(step)[:, None]
        step += 1
    at, place = np.nonzero(alive)
    near, partial = columns[place], partial[at, place]
    for step in range(step, len(blocks)):  # few left: pair by pair
        partial = partial + ((blocks[step][near] - parts[step][at]) ** 2).sum(1)
        fit = partial <= bound(step)[at]
        at, near, partial = at[fit], near[fit], partial[fit]
    pairs = np.union1d(at * number + near, (np.arange(len(queries))[:, None] * number + seeds).ravel())
    return np.divmod(pairs, number)


def search(embeddings: DataFrame, is_query: Column, k: int = 20, missed: float = MISSED, lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` holds for, its k nearest found."""
    spark = embeddings.sparkSession
    importable(spark)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    vectors = stored(usable(embeddings), "vectors")
    index = fit(vectors, lists)
    if index is None:
        return empty
    placed = stored(_indexed(vectors, index), "placed")
    known = Lists(placed, len(index.centroids))
    queries = placed.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    enough = max(k + 1, FIRST * k)
    found = stored(_nearest(placed, _first_probes(queries, index, known, enough), index, known, k), "first")
    worst = found.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    tested = queries.join(worst, "query_id", "left").select("query_id", "vector", F.when(F.col("n") >= k, F.col("worst")).alias("worst"))
    further = _further_probes(tested, index, known, enough, missed)
    found = _best(found.unionByName(_nearest(placed, further, index, known, k)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _nearest(placed: DataFrame, probes: DataFrame, index: Index, lists: Lists, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query in the lists that it probes."""
    spark = placed.sparkSession
    probes = stored(probes, "probes")
    asked = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
    cells = [(i, -(-int(lists.held[i]) // CELL), -(-n // CELL)) for i, n in asked.items()]
    grid = F.broadcast(spark.createDataFrame(cells, "list int, high int, wide int"))  # one row a list

    def cell(own: str, width: str, other: str) -> Column:
        mine = F.pmod(F.xxhash64(own), F.col(width)).cast("int")
        return F.explode(F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda o: F.struct(mine.alias("m"), o.alias("o"))))

    left = placed.join(grid, "list").withColumn("c", cell("vec_id", "high", "wide"))
    left = left.select("list", F.col("c.m").alias("row"), F.col("c.o").alias("column"), "vec_id", "vector")
    right = probes.join(grid, "list").withColumn("c", cell("query_id", "wide", "high"))
    right = right.select("list", F.col("c.o").alias("row"), F.col("c.m").alias("column"), "query_id", "vector", "limit")

    def answer(candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(candidates) and len(asking):
            own = np.stack(candidates["vector"].to_numpy())
            ids = candidates["vec_id"].to_numpy()
            points = index.rotated(own).astype(np.float32)
            blocks = [np.ascontiguousarray(points[:, a : a + BLOCK]) for a in range(0, points.shape[1], BLOCK)]
            for low in range(0, len(asking), TOGETHER):
                some = asking.iloc[low : low + TOGETHER]
                originals, query_ids = np.stack(some["vector"].to_numpy()), some["query_id"].to_numpy()
                # one more: a query may be its own neighbour
                at, near = _scan(blocks, index.as_query(originals).astype(np.float32), k + 1, some["limit"].to_numpy())
                other = ids[near] != query_ids[at]
                at, near = at[other], near[other]
                score = np.zeros(len(near))
                for j in range(own.shape[1]):
                    score += own[near, j] * originals[at, j]
                order = np.lexsort((ids[near], -score, at))
                at, near, score = at[order], near[order], score[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                kept = rank < k
                out.append((query_ids[at[kept]], ids[near[kept]], score[kept]))
        if not out:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    keys = ["list", "row", "column"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(answer, "query_id bigint, vec_id bigint, score double")
    return _best(found, k).drop("rank")


def report(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 20 == 0)
