"""Centroid clustering beside a plain version in whole numbers."""

import hashlib
import random
from collections import Counter
from math import floor, isfinite

import numpy as np
from pyspark.sql import functions as F

from linkwright.llm import centroids


def expected(rows, clusters=40, rounds=5):
    kept = [
        (i, [floor(256 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middles = [v for _, v in named[:clusters]]
    if not middles:
        return Counter()

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middles))

    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in kept]
        for j in range(len(middles)):
            own = [v for (_, v), o in zip(kept, owner) if o == j]
            if own:
                middles[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in found:
        sums[j] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return Counter((i, j, d, sums[j], sum(sums.values()), shas[j]) for i, d, j in found)


def run(frame, **how):
    return Counter(map(tuple, centroids.report(frame, **how).collect()))


def test_clusters(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.select("vec_id", "embedding").collect()]
    found = centroids.report(frame)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.collect())) == expected(rows)


def test_hard_vectors(spark):
    """Missing and odd vectors, repeated ids and vectors, ties, and one vector that holds a third of all rows."""
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(64)]) for i in range(120)]
    rows += [(200 + i, [0.25] * 64) for i in range(60)] + [(7, [1.0] * 64), (7, [1.0] * 64), (None, [0.1] * 64)]
    rows += [(300, None), (301, [1.0] * 63), (302, [1.0] * 65), (303, []), (304, [None] + [1.0] * 63)]
    rows += [(305, [float("nan")] + [1.0] * 63), (306, [float("inf")] + [1.0] * 63), (307, [-2000.5] * 64)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, row int")
    assert run(frame) == expected(rows)
    assert run(frame, clusters=3, rounds=2) == expected(rows, 3, 2)
    # too large for a long of squares: no part
    assert run(frame.limit(0).unionByName(frame.filter("vec_id = 0").withColumn("embedding", F.expr("transform(embedding, x -> 1e300)")))) == Counter()


def test_few_or_no_vectors(spark):
    rows = [(i, [i / 8.0] * 64) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert run(frame) == expected(rows)
    assert run(frame.limit(0)) == Counter()
    assert run(frame.withColumn("vec_id", F.lit(None).cast("bigint"))) == Counter()


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, (500, 9))
    vectors[:200, 3] = 5
    middles = rng.integers(-300, 300, (11, 9))
    for bits in (1, 3, 6):
        cells = centroids.Cells(vectors[:100], vectors.min(0), vectors.max(0), bits)
        packed = np.frombuffer(b"".join(cells.pack(vectors)), np.uint8).reshape(len(vectors), -1)
        assert packed.shape[1] == -(-9 * bits // 8)
        own = cells.unpack(packed)
        at = np.arange(9)
        assert (cells.low[at, own] <= vectors).all() and (vectors <= cells.high[at, own]).all()
        tables = cells.tables(middles)
        ends = tables[at, own].sum(1)
        exact = ((vectors[:, None] - middles) ** 2).sum(2) - (vectors**2).sum(1)[:, None]
        assert (ends[:, :11] <= exact).all() and (exact <= ends[:, 11:]).all()
        left = cells.left(packed, tables)
        assert (left[np.arange(500), exact.argmin(1)]).all()
        if bits == 6:
            assert left.sum() < 0.5 * left.size


def test_only_open_vectors_are_fetched(spark):
    """Well-separated clusters are settled by their approximations; the join does not shuffle the vectors."""
    rng = np.random.default_rng(3)
    points = (rng.standard_normal((400, 64)) * 0.02 + 5 * rng.standard_normal((4, 64))[np.arange(400) % 4]).tolist()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(points)], "vec_id bigint, embedding array<double>")
    file = centroids.VectorFile(centroids.whole_numbers(frame))
    middles = np.floor(256 * np.array(points[:4])).astype(np.int64)
    judged = file.judged(file.approximations, middles)
    assert judged.filter("only < 0").count() == 0
    plan = file.moved(judged, middles)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
