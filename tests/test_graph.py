import math
import random
from pathlib import Path

import people
import pytest

from linkwright.operators import blocking as B
from linkwright.operators import clustering, kinship, scoring
from linkwright.session import shared_dir
from test_model import COMPARISONS, SETTINGS, stated


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["random", "chain", "hub", "micro", "empty"])
def test_components_equal_union_find(spark, shape, monkeypatch):
    monkeypatch.setattr(clustering, "spread_lookup", lambda *a, **k: spread(*a, **{**k, "rows_per_task": 5, "largest": None}))
    rng = random.Random(5)
    edges = {
        "random": [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)],
        "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)],
        "hub": [("n900", f"n{i:03d}") for i in range(70)] + [("m1", "m2")],
        "micro": [("a", "b"), ("b", "c"), ("d", "e")],
        "empty": [],
    }[shape]
    got = clustering.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()
    want = components([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


spread = clustering.spread_lookup
kinship_join = kinship.spread_join


@pytest.mark.parametrize("forests", [True, False])
def test_a_long_chain_over_many_partitions(spark, forests):
    rng = random.Random(1)
    order = list(range(3000))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(2999) if i != 1500] + [(5000, 5001), (7, 7)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "a int, b int").repartition(8)
    got = {r["node"]: r["component"] for r in clustering.connected_components(frame, forests=forests).collect()}
    assert got == components([e for e in edges if e[0] != e[1]])
    assert clustering.connected_components(frame).schema["node"].dataType.simpleString() == "int"


def test_forests_span_what_they_are_given():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 5, 50, 400):
        a, b = rng.integers(0, n, (2, n // 2 + 1)) * 1000
        child, root = clustering.spanning_forest(a, b)
        want = components([(x, y) for x, y in zip(a.tolist(), b.tolist())])
        assert dict(zip(child.tolist(), root.tolist())) == {x: r for x, r in want.items() if x != r}
        assert len(set(child.tolist())) == len(child)


def test_clusters_from_records_equal_clusters_from_pairs(spark):
    left = spark.createDataFrame(people.register("l", 70, 6), people.SCHEMA).cache()
    right = spark.createDataFrame(people.register("r", 60, 7), people.SCHEMA).cache()
    pairs = scoring.predict(left, right, SETTINGS, stated(), 0.2)
    a = clustering.cluster_at_threshold(pairs, 0.5, left, right)
    b = clustering.cluster_records(left, right, SETTINGS, stated(), 0.5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 130


def corroboration(matches, edges):
    kin = {}
    for a, b in edges:
        kin.setdefault(a, set()).add(b)
        kin.setdefault(b, set()).add(a)
    lookup = {(l, r): p for l, r, p in matches}
    out = {}
    for l, r, _ in matches:
        best = []
        for x in kin.get(l, ()):
            found = [lookup[x, y] for y in kin.get(r, ()) if lookup.get((x, y)) is not None]
            if found:
                best.append(max(found))
        out[l, r] = sum(best) / len(best) if best else None
    return out


@pytest.mark.parametrize("small_family, budget", [(0, 10**6), (0, 4), (3, 10**6), (3, 9), (400, 10**6), (400, 5)])
@pytest.mark.parametrize("seed", [1, 2])
def test_corroboration_equals_its_definition(spark, small_family, budget, seed):
    rng = random.Random(seed)
    left, right = [f"l{i}" for i in range(14)], [f"r{i}" for i in range(14)]
    matches = [(l, r, rng.choice([round(rng.random(), 3), None]) if rng.random() < 0.1 else round(rng.random(), 3))
               for l in left for r in right if rng.random() < 0.3]
    edges = [(rng.choice(left), rng.choice(left)) for _ in range(22)] + [(rng.choice(right), rng.choice(right)) for _ in range(18)]
    edges += [("l0", x) for x in left[1:]] + [("r0", y) for y in right[1:9]] + [("l1", "r1")]
    frame = spark.createDataFrame(matches, "unique_id_l string, unique_id_r string, match_probability double")
    links = kinship.symmetric_edges(spark.createDataFrame(edges, "subject_id string, object_id string"))
    rows = kinship.relative_corroboration(frame, links, small_family, budget).collect()
    want = corroboration(matches, edges)
    assert len(rows) == len(matches)
    for r in rows:
        value = want[r["unique_id_l"], r["unique_id_r"]]
        got = r["relatives_match_probability"]
        assert (value is None and got is None) or math.isclose(value, got, abs_tol=1e-12)


def test_a_hub_on_both_sides(spark, monkeypatch):
    """Everybody is related to the hubs, and the hubs are in many pairs; hub keys are joined on strips."""
    rng = random.Random(4)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    matches = [("l0", r, round(rng.random(), 3)) for r in right] + [(l, "r0", round(rng.random(), 3)) for l in left[1:]]
    matches += [(l, r, round(rng.random(), 3)) for l in left[1:] for r in right[1:] if rng.random() < 0.15]
    edges = [("l0", x) for x in left[1:]] + [("r0", y) for y in right[1:]] + [("l1", x) for x in left[2:30]]
    frame = spark.createDataFrame(matches, "unique_id_l string, unique_id_r string, match_probability double")
    links = kinship.symmetric_edges(spark.createDataFrame(edges, "subject_id string, object_id string"))
    plans = []

    def noted(*given, **named):
        plans.append(kinship_join(*given, **named))
        return plans[-1]

    monkeypatch.setattr(kinship, "spread_join", noted)
    found = kinship.relative_corroboration(frame, links, small_family=0, pairs_per_task=60)
    want = corroboration(matches, edges)
    for r in found.collect():
        value, got = want.pop((r["unique_id_l"], r["unique_id_r"])), r["relatives_match_probability"]
        assert (value is None and got is None) or math.isclose(value, got, abs_tol=1e-12)
    assert not want
    # both walks, and their meeting with the pairs, are on strips
    assert len(plans) == 4 and all("__col" in p._jdf.queryExecution().analyzed().toString() for p in plans)


@pytest.mark.parametrize("small_family, budget", [(0, 10**6), (3, 9), (400, 10**6)])
def test_wanted_pairs_as_among_all(spark, small_family, budget):
    rng = random.Random(9)
    left, right = [f"l{i}" for i in range(14)], [f"r{i}" for i in range(14)]
    matches = [(l, r, round(rng.random(), 3)) for l in left for r in right if rng.random() < 0.4]
    edges = [(rng.choice(left), rng.choice(left)) for _ in range(22)] + [(rng.choice(right), rng.choice(right)) for _ in range(22)]
    frame = spark.createDataFrame(matches, "unique_id_l string, unique_id_r string, match_probability double")
    links = kinship.symmetric_edges(spark.createDataFrame(edges, "subject_id string, object_id string"))
    asked = [m[:2] for m in matches if rng.random() < 0.3] + [("l0", "nobody"), (None, "r1")]
    wanted = spark.createDataFrame(asked + asked[:3], "unique_id_l string, unique_id_r string")
    whole = {tuple(r)[:3]: r[3] for r in kinship.relative_corroboration(frame, links).collect()}
    got = kinship.relative_corroboration(frame, links, small_family, budget, wanted).collect()
    assert sorted(tuple(r)[:2] for r in got) == sorted(set(asked) & {k[:2] for k in whole})
    assert any(r[3] is not None for r in got)
    for r in got:
        want = whole[tuple(r)[:3]]
        assert (want is None and r[3] is None) or math.isclose(want, r[3], abs_tol=1e-12)


def test_corroboration_leaves_one_table(spark):
    matches = [(f"l{i}", f"r{j}", 0.5) for i in range(5) for j in range(5)]
    edges = [("l0", f"l{i}") for i in range(1, 5)] + [("r0", f"r{i}") for i in range(1, 5)]
    frame = spark.createDataFrame(matches, "unique_id_l string, unique_id_r string, match_probability double")
    links = kinship.symmetric_edges(spark.createDataFrame(edges, "subject_id string, object_id string"))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    for family in (0, 400):
        found = kinship.relative_corroboration(frame, links, family)
        new = {p for p in folder.iterdir() if (p / "_SUCCESS").exists()} - before
        assert [p.name.split("-")[0] for p in new] == ["corroboration"]
        before |= new
        assert found.filter("relatives_match_probability = 0.5").count() == 25


def test_unmatched_relatives_do_not_count_as_zero(spark):
    matches = [("a", "b", 0.5), ("x1", "y", 0.9)]
    edges = [("a", "x1"), ("a", "x2"), ("b", "y")]
    frame = spark.createDataFrame(matches, "unique_id_l string, unique_id_r string, match_probability double")
    links = kinship.symmetric_edges(spark.createDataFrame(edges, "subject_id string, object_id string"))
    got = {r["unique_id_l"]: r["relatives_match_probability"] for r in kinship.relative_corroboration(frame, links).collect()}
    assert got == {"a": 0.9, "x1": 0.5}


def test_sets_have_one_form_at_every_size(spark):
    edges = spark.createDataFrame([("hub", f"x{i}") for i in range(30)] + [("a", "b")], "mention_id string, relative_id string")
    rows = {tuple(r) for r in kinship.relative_sets(edges).collect()}
    assert rows == {("hub", f"x{i}", 30) for i in range(30)} | {("a", "b", 1)}


def test_rules_used_here():
    assert B.block_on("a").both(B.BlockRule(("b",), (("y", 3),))).label == "a equal and b equal and y within 3"
    assert len(COMPARISONS) == 4
