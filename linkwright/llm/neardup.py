"""Near-duplicate documents: an inverted join on MinHash coordinates, confirmed on full shingle sets.

1. A document's set is its distinct five-word shingles (lower-cased A-Z; fewer words are one shingle).
   Documents with one and the same set share one stand-in, so groups of copies cost one row.
2. Each stand-in is posted under its `COORDINATES` coordinate-value pairs.  Two alike sets collide in at
   least `MATCHES` of them, so, with pairs ordered from rare to frequent, in the first
   `COORDINATES - MATCHES + 1` of each: only this prefix is posted, and the frequent rest is skipped.
3. Members of a posting list meet its leader, never each other: as many pairs as postings.  The leader is the
   member whose coordinates are the most frequent ones, the middle of a family of near copies.  Pairs are
   counted on all coordinates; those with enough collisions are compared on full sets.
4. Members that did not join their leader's component meet members of other components of their lists, where
   they share one of the rarest shingles of each and enough shingles follow it (exact conditions for being alike),
   long lists on a grid.
5. Components of the confirmed links.

At similarity 0.75 a link collides in 72 of 96 coordinates on average; fewer than 52 come with odds of
about one in a million.  Nothing else is lost: no list, partner or candidate is capped.

Null text, or none but white space, is an empty set, linked with nothing.  A row without doc_id is linked
with nothing, has no component and is kept.  Rows that share a doc_id are one document: equal texts count once,
of unlike texts each links it.  Two texts of any length are compared on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import PAIRS_IN_TASK, WordHashes, grams, importable, map_batches, settled, stored, thinned, utf8, with_strays
from linkwright.operators.spread import spread_join
from linkwright.plans.store import discarding

SHINGLE = 5
SIMILAR = 75  # percent
COORDINATES = 96
MATCHES = 52

_rng = np.random.default_rng(20240501)
_FLIP = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1)


def shingles(text: bytes, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = hashes.of(text.lower().split())
    if not len(words):
        return words
    if len(words) < size:
        return grams(words, len(words)) ^ np.uint64(0x9E3779B97F4A7C15 * len(words) % 2**64)
    return np.unique(grams(words, size))


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """Smallest permuted hash per coordinate."""
    low = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.empty(COORDINATES, np.uint32)
    for k in range(COORDINATES):
        out[k] = ((low ^ _FLIP[k]) * _TIMES[k]).min()
    return out.view(np.int32)


def _sketch(documents: DataFrame) -> DataFrame:
    def sketch(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        hashes = WordHashes()
        numbers, sums, signatures, packed = [], [], [], []
        for text in utf8(batch.column("text")):
            found = shingles(text, hashes)
            numbers.append(len(found))
            sums.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signatures.append(signature(found) if len(found) else None)
            packed.append(signatures[-1].astype(np.uint8).view(np.int64) if len(found) else None)
        yield {"doc_id": batch.column("doc_id"), "n_shingles": numbers, "sum": sums, "signature": signatures, "packed": packed}

    fields = "doc_id bigint, n_shingles bigint, sum binary, signature array<int>, packed array<bigint>"
    return map_batches(documents, sketch, fields)


def _collide(a: str, b: str) -> Column:
    """Whether two packed signatures (the last byte of each coordinate) agree in `MATCHES` bytes: equal
    coordinates have equal bytes, so no pair is lost."""
    differ = []
    for i in range(COORDINATES // 8):
        bits = f"({a}[{i}] ^ {b}[{i}])"
        for step in (4, 2, 1):  # whether any bit of a byte is set, in its lowest bit
            bits = f"({bits} | shiftrightunsigned({bits}, {step}))"
        differ.append(f"bit_count({bits} & {0x0101010101010101}L)")
    return F.expr(f"{' + '.join(differ)} <= {COORDINATES - MATCHES}")


def _fitting(a: str, b: str) -> Column:
    """Sets whose sizes differ more than this cannot be alike."""
    return F.expr(f"100 * least({a}, {b}) >= {SIMILAR} * greatest({a}, {b})")


def _sets(documents: DataFrame) -> DataFrame:
    def build(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        hashes = WordHashes()
        yield {"node": batch.column("doc_id"), "shingles": [shingles(t, hashes).tobytes() for t in utf8(batch.column("text"))]}

    return map_batches(documents, build, "node bigint, shingles binary")


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, node, leader, n) of the lists that at least two prefixes share, with their length."""
    key = F.col("coordinate").cast("bigint") * (1 << 32) + F.col("value").cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
    posted = nodes.select("node", F.posexplode("signature").alias("coordinate", "value")).select("node", key.alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # keys that one document holds alone come first in its order, but join nothing
    ordered = posted.join(shared, "key").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"), F.sum("n").alias("weight")
    )
    left = F.size("keys") - (MATCHES - 1)
    prefix = ordered.filter(left > 0).select("node", "weight", F.explode(F.slice("keys", F.lit(1), left)).alias("k")).select("node", "weight", "k.key")
    leaders = prefix.groupBy("key").agg(F.max(F.struct("weight", -F.col("node"))).alias("top"), F.count("*").alias("n"))
    leaders = leaders.filter("n > 1").select("key", (-F.col("top.col2")).alias("leader"), "n")
    return prefix.drop("weight").join(leaders, "key")


def _colliding(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) with enough collisions."""
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("packed").alias("pa"), F.col("n_shingles").alias("na")), "a")
    pairs = pairs.join(nodes.select(F.col("node").alias("b"), F.col("packed").alias("pb"), F.col("n_shingles").alias("nb")), "b")
    return pairs.filter(_fitting("na", "nb") & _collide("pa", "pb")).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike; `b` may be shared by many."""
    pairs = stored(pairs, "collided")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")

    def compare(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        keep = []
        for x, y in zip(batch.column("xa"), batch.column("xb")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield {"a": kept.column("a"), "b": kept.column("b")}

    return stored(map_batches(both, compare, "a bigint, b bigint"), "links")


def _strays_met(postings: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of a stray, a member outside its list leader's component, with members of other components of
    its lists that it may be alike to.

    Two alike sets share a shingle among the rarest of each: with n shingles, in the first n - ceil(0.75 n) + 1.
    Members of a family that are not alike differ in just these, so they do not meet, however many they are.
    """
    known = with_strays(postings, labels)
    open_lists = known.filter("stray").select("key").distinct()
    marked = known.join(open_lists, "key", "left_semi").groupBy("node").agg(F.max("stray").alias("stray"), F.min("component").alias("component"))
    marked = stored(marked, "marked")

    def split(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        found = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("shingles")]
        sizes = np.array([len(x) for x in found], np.int64)
        at = np.repeat(np.arange(len(found)), sizes)
        if len(at):
            yield {
                "set": batch.column("set").take(pa.array(at)), "node": batch.column("node").take(pa.array(at)),
                "n": np.repeat(sizes, sizes), "shingle": np.concatenate(found),
            }

    numbered = sets.join(marked.select("node"), "node", "left_semi").withColumn("set", F.monotonically_increasing_id())
    each = stored(map_batches(numbered, split, "set bigint, node bigint, n bigint, shingle bigint"), "shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("f")).filter("f > 1")
    shared = each.join(often, "shingle").groupBy("set", "node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("held"))
    # shingles that one set holds alone come first and meet nothing
    first = F.expr(f"cast(n - ({SIMILAR} * n + 99) div 100 + 1 - (n - size(held)) as int)")
    prefix = shared.withColumn("first", first).filter("first > 0")
    prefix = prefix.select("node", "n", "held", F.posexplode(F.slice("held", F.lit(1), F.col("first"))["shingle"]).alias("i", "key"))
    # how many shingles there are from this one on, in the order of rarity
    prefix = prefix.select("node", "n", (F.size("held") - F.col("i")).alias("rest"), "key")
    prefix = stored(prefix.join(marked, "node"), "prefix")
    left = prefix.filter("stray").select("key", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    right = prefix.select(
        F.col("key").alias("k"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("stray").alias("sb")
    )
    # at the first shingle that two sets share, what follows must be enough for the overlap that alike sets have
    enough = F.expr(f"{100 + SIMILAR} * least(ra, rb) >= {SIMILAR} * (na + nb)")
    apart = enough & _fitting("na", "nb") & (F.col("ca") != F.col("cb")) & ((F.col("a") < F.col("b")) | ~F.col("sb"))
    return spread_join(left, right, ["key"], ["k"], "a", "b", apart, PAIRS_IN_TASK).select("a", "b").distinct()


def stand_ins(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, stand_in) per row, and (node, component) of the stand-ins that are linked."""
    importable(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    sketch = stored(_sketch(texts), "sketch")
    # stored, so that the joins with it may split a hot set
    firsts = stored(sketch.filter("doc_id is not null and sum is not null").groupBy("sum").agg(F.min("doc_id").alias("stand_in")), "firsts")
    nodes = sketch.join(firsts.withColumnRenamed("stand_in", "doc_id"), ["sum", "doc_id"])
    nodes = nodes.select(F.col("doc_id").alias("node"), "signature", "packed", "n_shingles").distinct()
    postings = stored(_postings(nodes), "postings")
    wanted = postings.select(F.col("node").alias("doc_id")).distinct()
    nodes = stored(nodes.drop("signature").join(wanted.withColumnRenamed("doc_id", "node"), "node"), "nodes")
    sets = stored(_sets(thinned(texts, wanted, "doc_id").join(wanted, "doc_id")).distinct(), "sets")
    pairs = postings.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    found = _confirmed(_colliding(pairs, nodes), sets)

    members = sketch.join(firsts, "sum", "left").select("doc_id", "n_shingles", "stand_in")
    # the texts of one document belong together
    ends = members.filter("stand_in is not null").groupBy("doc_id").agg(F.min("stand_in").alias("b"), F.max("stand_in").alias("top"))
    own = members.join(ends.filter("b < top"), "doc_id").select(F.col("stand_in").alias("a"), "b").filter("a <> b").distinct()
    found = found.unionByName(own)

    def more(labels: DataFrame) -> DataFrame:
        pairs = _strays_met(postings, labels, sets)
        return _confirmed(_colliding(pairs, nodes), sets)

    return members, settled(found, more)


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row."""
    members, labels = stand_ins(documents)
    labels = labels.select(F.col("node").alias("stand_in"), "component")
    known = members.join(labels, "stand_in", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "stand_in", "doc_id"))
    known = known.select("doc_id", "n_shingles", component.alias("component_id"))
    return known.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without those that a smaller doc_id of their group stands for."""
    with discarding(documents.sparkSession):
        gone = stored(groups(documents).filter("not kept").select("doc_id").distinct(), "gone", lasting=True)
    return documents.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
