"""Clusters of records connected by confident pairs.

Nodes get whole numbers in their order, so that rounds move numbers whatever the ids look like.  Each
partition then replaces its edges by a spanning forest (one edge for each node but the smallest of a tree), and
alternating large-star and small-star contraction (Kiveris et al. 2014) joins the forests: a round is a
minimum per node and a lookup, the edge set never grows, and the number of rounds is logarithmic in practice.  A
round's edges are stored once; what tells whether they changed is counted while they are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.operators.model import LinkModel, LinkSettings
from linkwright.operators.ordering import numbered
from linkwright.operators.profiles import profile_columns, stand_ins, with_profile
from linkwright.operators.scoring import predict
from linkwright.operators.spread import spread_lookup
from linkwright.session import cut_lineage, importable

MAX_ROUNDS = 60
TOGETHER = 2_000_000  # edges whose forest is found at once


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that is not the smallest of its tree, with that smallest node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ends, 2)
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:  # up to the roots
            higher = root[root]
            if (higher == root).all():
                break
            root = higher
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _forests(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of whole numbers with each partition's replaced by a spanning forest."""
    importable(edges.sparkSession)

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def forest() -> pa.RecordBatch:
            ends = spanning_forest(*(np.concatenate([e[i] for e in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b")])
            number += len(batch)
            if number >= TOGETHER:
                yield forest()
                held, number = [], 0
        if held:
            yield forest()

    return edges.mapInArrow(contract, "a bigint, b bigint")


def _large_star(edges: DataFrame, number: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("__n"))
    known = spread_lookup(both, nearest.drop("__n"), ["a"], ["b"], sizes=nearest.select("a", "__n"), largest=2 * number)
    return known.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, number: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nearest = down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("__n"))
    known = spread_lookup(down, nearest.drop("__n"), ["a"], ["b"], sizes=nearest.select("a", "__n"), largest=number)
    links = known.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return links.unionByName(nearest.select("a", F.col("low").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is itself a child."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    nodes = ends.groupBy("node").agg(F.sum("child").alias("children"), F.max("parent").alias("parent"))
    unsettled = (F.col("children") > 1) | ((F.col("children") > 0) & (F.col("parent") > 0))
    return nodes.filter(unsettled).isEmpty()


def _kept(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """The edges stored, their number, and a sum of hashes that tells two edge sets apart."""
    seen = Observation()
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("string")
    edges = cut_lineage(edges.observe(seen, F.count("*").alias("links"), mark.alias("mark")))
    return edges, seen.get["links"], int(seen.get["mark"] or 0)


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS, forests: bool = True) -> DataFrame:
    """(a, b) edges to (node, component); the component is its smallest node.

    `forests`: let each partition contract its own edges first, in Arrow batches; without, all of the work is
    Spark's own expressions.
    """
    kind = edges.schema["a"].dataType
    edges = edges.filter("a <> b").select("a", "b")
    names = None
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        edges = cut_lineage(edges.distinct())
        names = cut_lineage(numbered(edges.select(F.explode(F.array("a", "b")).alias("node")), "node"))
        number = edges.count()
        for end in ("a", "b"):
            known = names.select(F.col("node").alias(end), F.col("number").alias("__number"))
            edges = spread_lookup(edges, known, [end], ["b" if end == "a" else "a"], largest=number)
            edges = edges.drop(end).withColumnRenamed("__number", end)
    edges = edges.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b"))
    edges, links, mark = _kept((_forests(edges) if forests else edges).distinct())
    settled = _settled(edges)
    while not settled and max_rounds > 0:
        before, max_rounds = (links, mark), max_rounds - 1
        edges, links, mark = _kept(_small_star(_large_star(edges, links), links))
        settled = before == (links, mark)  # a round that changes nothing leaves stars
    if not settled:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    if names is None:
        return found.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
    found = found.join(names.select(F.col("number").alias("node"), F.col("node").alias("__node")), "node")
    top = names.select(F.col("number").alias("component"), F.col("node").alias("__component"))
    found = spread_lookup(found, top, ["component"], ["__node"], largest=2 * links)
    return found.select(F.col("__node").alias("node"), F.col("__component").alias("component"))


def _node(side: str, column: str = "unique_id"):
    return F.concat(F.lit(f"{side}:"), F.col(column))


def _confident(pairs: DataFrame, threshold: float) -> DataFrame:
    kept = pairs.filter(F.col("match_probability") >= threshold)
    return kept.select(_node("left", "unique_id_l").alias("a"), _node("right", "unique_id_r").alias("b"))


def cluster_at_threshold(pairs: DataFrame, threshold: float, left: DataFrame, right: DataFrame) -> DataFrame:
    """(cluster_id, source_dataset, unique_id) for every record, from a table of scored pairs."""
    labels = connected_components(_confident(pairs, threshold))
    nodes = _all_nodes(left, right)
    return _labelled(nodes.join(labels, "node", "left"))


def _all_nodes(left: DataFrame, right: DataFrame, *extra: str) -> DataFrame:
    sides = [
        side.select(F.lit(name).alias("source_dataset"), "unique_id", _node(name).alias("node"), *extra)
        for name, side in (("left", left), ("right", right))
    ]
    return sides[0].unionByName(sides[1])


def _labelled(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.coalesce("component", "node").alias("cluster_id"), "source_dataset", "unique_id")


def cluster_records(
    left: DataFrame, right: DataFrame, settings: LinkSettings, model: LinkModel, threshold: float
) -> DataFrame:
    """The same clusters straight from the records, with one graph node per distinct profile."""
    columns = profile_columns(settings)
    keyed = [with_profile(side, columns) for side in (left, right)]
    nodes = [cut_lineage(stand_ins(side, columns)) for side in keyed]
    labels = connected_components(_confident(predict(*nodes, settings, model, threshold), threshold))
    # Only profiles with a partner bind their records together.
    named = _all_nodes(*nodes, "profile").join(labels, "node").select("source_dataset", "profile", "component")
    members = _all_nodes(*keyed, "profile")
    number = left.count() + right.count()
    return _labelled(spread_lookup(members, named, ["source_dataset", "profile"], ["unique_id"], "left", largest=number))
