"""Centroid clustering over a vector-approximation file (VA-file).

Vectors become whole numbers.  They are stored once, dealt by row number into buckets, and beside them a file of
approximations: per component only the number of the cell it lies in, `BITS` bits.  Cell borders are quantiles of a
bounded sample; the outermost cells reach to the smallest and largest value of the table, so borders only decide how
sharp the approximation is, never the result.

A round reads approximations alone.  For each centroid a table gives, by component and cell, the least and the most
that the component can add to the distance (less the vector's own square, the same for all centroids); added up they
are an interval per centroid.  A centroid whose interval begins above the smallest upper end is out.  One centroid
left: the vector is settled.  Several left, or another cluster than before: the whole vector is fetched by a join
on its row number, compared with the centroids left, and its cluster's sum corrected.  Clusters keep
running sums, so that vectors that stay where they are need no fetch.  Only sums (clusters x components) reach the
driver.  The last pass fetches all vectors, because their distances are asked for.

The join reads the stored vectors bucket by bucket without shuffling them; only row numbers and approximations
move.  Row numbers spread evenly, whatever the vectors are: a third of all rows being one vector is no hot key.

Null vectors, vectors of another size and those with null or non-finite components take no part, nor do those with a
component beyond `LARGEST` when scaled, whose distances would not fit a long.  Rows that repeat a vec_id
or a vector are clustered each for itself; a row without vec_id is clustered but never a first centroid.
Equal distances go to the smaller cluster number; among equal ids the smaller vector is the first centroid.  Fewer
vectors than clusters: as many clusters as ids.  No vectors: no rows.  Sums beyond a long are null.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import importable, stored
from linkwright.session import scratch_path

CLUSTERS = 40
ROUNDS = 5
DIMENSION = 64
SCALE = 256
SALT = "2:"
BITS = 6
LARGEST = 1 << 26
SAMPLE = 20_000  # vectors from which cell borders are taken
TOGETHER = 2048  # vectors compared at once


def whole_numbers(embeddings: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) of the rows that take part: floor(scale * x) of every component."""
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < LARGEST))
    rows = rows.filter((F.size("vector") == dimension) & fine)
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("int")))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The vectors with the smallest hash of the salted id, in the order of the hash."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    top = vectors.filter("vec_id is not null").select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(clusters)
    return np.array([r["vector"] for r in top.orderBy("mark", "vector").collect()], np.int64)


class Cells:
    """Borders of the cells of each component, and how cells are packed into bytes."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int = BITS) -> None:
        self.bits, self.dimension = bits, sample.shape[1]
        shares = np.arange(1, 1 << bits) / (1 << bits)
        # cell j holds the whole numbers from borders[j] to borders[j + 1] - 1
        self.borders = np.ceil(np.quantile(sample, shares, axis=0)).astype(np.int64).T.copy()
        low = np.minimum(np.concatenate([least[:, None], self.borders], 1), most[:, None])
        high = np.concatenate([self.borders - 1, most[:, None]], 1)
        # empty cells (equal borders) hold no vector; any interval will do
        self.low, self.high = np.maximum(low, least[:, None]), np.maximum(np.minimum(high, most[:, None]), np.maximum(low, least[:, None]))

    def pack(self, vectors: np.ndarray) -> list[bytes]:
        cells = np.stack([np.searchsorted(b, vectors[:, d], "right") for d, b in enumerate(self.borders)], 1).astype(np.uint8)
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [row.tobytes() for row in np.packbits(bits.reshape(len(cells), -1), axis=1)]

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        """Cells of the vectors whose packed bytes are the rows."""
        bits = np.unpackbits(packed, axis=1)[:, : self.dimension * self.bits].reshape(len(packed), self.dimension, self.bits)
        return bits @ (1 << np.arange(self.bits - 1, -1, -1))

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """(component, cell, least for each centroid then most for each): what a component adds to the distance
        less its own square, c * c - 2 * c * x, at the ends of the cell."""
        c = centroids.T[:, None, :]
        ends = [c * c - 2 * c * edge[:, :, None] for edge in (self.low, self.high)]
        return np.concatenate([np.minimum(*ends), np.maximum(*ends)], 2)

    def left(self, packed: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(vectors, centroids): whether a centroid may be the nearest."""
        cells = self.unpack(packed)
        ends = np.zeros((len(cells), tables.shape[2]), np.int64)
        for d in range(self.dimension):
            ends += tables[d][cells[:, d]]
        least, most = np.split(ends, 2, axis=1)
        return least <= most.min(1, keepdims=True)


def _numbers(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimension).astype(np.int64)


def _bytes(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def nearest(vectors: np.ndarray, left: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) among the centroids left; the smaller number at ties."""
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    owner = np.full(len(vectors), -1)
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero(left[:, j])
        distance = ((vectors[rows] - centroid) ** 2).sum(1)
        nearer = distance < best[rows]
        best[rows[nearer]], owner[rows[nearer]] = distance[nearer], j
    return owner, best


class VectorFile:
    """Stored whole vectors and their approximations; both outlive lost executors."""

    def __init__(self, vectors: DataFrame, bits: int = BITS) -> None:
        self.spark = vectors.sparkSession
        importable(self.spark)
        numbered = stored(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
        self.dimension = DIMENSION
        head = numbered.select(F.size("vector")).first()
        self.empty = head is None
        if self.empty:
            return
        self.dimension = head[0]
        component = [F.col("vector")[d] for d in range(self.dimension)]
        edges = numbered.agg(*[F.min(c) for c in component], *[F.max(c) for c in component]).first()
        sample = numbered.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").toPandas()["vector"]
        edges = np.array(edges, np.int64).reshape(2, -1)
        self.cells = Cells(np.stack(sample.to_numpy()).astype(np.int64), *edges, bits)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Buckets by row number: the join with a round's rows does not shuffle the vectors.
        name, path = f"vectors_{uuid.uuid4().hex}", scratch_path(self.spark, "bucketed")
        dealt = numbered.repartition(buckets, "row")
        dealt.write.bucketBy(buckets, "row").option("path", path).saveAsTable(name)
        self.vectors = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name alone; the files stay in the shared folder
        cells, dimension = self.cells, self.dimension

        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed = cells.pack(_numbers(batch.column("vector"), dimension))
                none = np.full(len(batch), -1)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(packed, pa.binary()), pa.array(none, pa.int32())], names=["row", "cells", "cluster"])

        self.approximations = stored(numbered.select("row", "vector").mapInArrow(approximate, "row bigint, cells binary, cluster int"), "approximations")

    def judged(self, state: DataFrame, centroids: np.ndarray) -> DataFrame:
        """(row, cells, cluster, left): approximations and the cluster so far, with the centroids left as bits."""
        cells, tables = self.cells, self.cells.tables(centroids)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, len(batch), TOGETHER):
                    part = batch.slice(low, TOGETHER)
                    left = cells.left(_bytes(part.column("cells")), tables)
                    only = np.where(left.sum(1) == 1, left.argmax(1), -1)
                    bits = [row.tobytes() for row in np.packbits(left, axis=1)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(only, pa.int32()), pa.array(bits, pa.binary())], names=["row", "cells", "cluster", "only", "left"])

        return state.mapInArrow(judge, "row bigint, cells binary, cluster int, only int, left binary")

    def fetched(self, rows: DataFrame) -> DataFrame:
        """The rows beside their whole vectors."""
        return rows.hint("shuffle_hash").join(self.vectors, "row")

    def moved(self, asked: DataFrame, centroids: np.ndarray) -> DataFrame:
        """Rows asked for with their new cluster; and, without a row number, what each task's rows that changed add
        to a cluster's sum: (cluster, n, sums)."""
        dimension, k = self.dimension, len(centroids)

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
            names = ["row", "cells", "cluster", "n", "sums"]
            for batch in batches:
                for low in range(0, len(batch), TOGETHER):
                    part = batch.slice(low, TOGETHER)
                    whole = _numbers(part.column("vector"), dimension)
                    left = np.unpackbits(_bytes(part.column("left")), axis=1)[:, :k].astype(bool)
                    old = part.column("cluster").to_numpy()
                    new, _ = nearest(whole, left, centroids)
                    for side, sign in ((old, -1), (new, 1)):
                        rows = np.flatnonzero((old != new) & (side >= 0))
                        np.add.at(sums, side[rows], sign * whole[rows])
                        np.add.at(n, side[rows], sign)
                    void = [None] * len(part)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), part.column("cells"), pa.array(new, pa.int32()), pa.array(void, pa.int64()), pa.array(void, pa.list_(pa.int64()))],
                        names=names,
                    )
            touched = [j for j in range(k) if n[j] or sums[j].any()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * len(touched), pa.int64()), pa.array([None] * len(touched), pa.binary()), pa.array(touched, pa.int32()),
                    pa.array(n[touched], pa.int64()), pa.array([sums[j].tolist() for j in touched], pa.list_(pa.int64())),
                ],
                names=names,
            )

        fetched = self.fetched(asked.select("row", "cells", "cluster", "left")).select("row", "cells", "cluster", "left", "vector")
        return fetched.mapInArrow(settle, "row bigint, cells binary, cluster int, n bigint, sums array<bigint>")


def _corrections(moved: DataFrame, dimension: int) -> list:
    """(cluster, n, sums) added up over the tasks: a row per cluster."""
    wide = [F.sum(F.col("sums")[d].cast("decimal(20,0)")).cast("string") for d in range(dimension)]
    each = moved.filter("row is null").groupBy("cluster")
    return each.agg(F.sum(F.col("n").cast("decimal(20,0)")).cast("string").alias("n"), F.array(*wide).alias("sums")).collect()


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT, bits: int = BITS) -> tuple[VectorFile, np.ndarray, DataFrame | None]:
    """The vector file, the centroids after all rounds, and the clusters after the last round's assignment."""
    file = VectorFile(vectors, bits)
    if file.empty:
        return file, np.zeros((0, file.dimension), np.int64), None
    centroids = first_centroids(file.vectors, clusters, salt)
    if not len(centroids):  # no row has an id
        return file, centroids, None
    state, sums, sizes = file.approximations, np.zeros(centroids.shape, object), np.zeros(len(centroids), object)
    for _ in range(rounds):
        judged = stored(file.judged(state, centroids), "judged")
        moved = stored(file.moved(judged.filter("only < 0 or only <> cluster"), centroids), "moved")
        stay = judged.filter("only >= 0 and only = cluster").select("row", "cells", "cluster")
        state = stay.unionByName(moved.filter("row is not null").select("row", "cells", "cluster"))
        for r in _corrections(moved, file.dimension):
            sums[r["cluster"]] += [int(x) for x in r["sums"]]
            sizes[r["cluster"]] += int(r["n"])
        before, centroids = centroids, centroids.copy()
        for j in range(len(centroids)):
            if sizes[j]:
                centroids[j] = [x // sizes[j] for x in sums[j]]
        if (before == centroids).all():
            break  # nothing changes in further rounds
    return file, centroids, state


def assign(file: VectorFile, centroids: np.ndarray, state: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance) of every vector: approximations rule centroids out, whole vectors decide."""
    dimension, k = file.dimension, len(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), TOGETHER):
                part = batch.slice(low, TOGETHER)
                left = np.unpackbits(_bytes(part.column("left")), axis=1)[:, :k].astype(bool)
                owner, distance = nearest(_numbers(part.column("vector"), dimension), left, centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(owner, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    rows = file.fetched(file.judged(state, centroids).select("row", "left"))
    return rows.select("vec_id", "left", "vector").mapInArrow(measure, "vec_id bigint, cluster int, distance bigint")


def report(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: its cluster, its distance, the inertia of cluster and table, its centroid's checksum."""
    spark = embeddings.sparkSession
    file, centroids, state = fit(whole_numbers(embeddings), clusters, rounds)
    names = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if state is None:
        return spark.createDataFrame([], names)
    found = stored(assign(file, centroids, state), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("string").alias("s")).collect()
    own = {r["cluster"]: int(r["s"]) for r in sums}  # a row per cluster
    whole, top = sum(own.values()), 2**63
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(j, s if s < top else None, whole if whole < top else None, shas[j]) for j, s in own.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
