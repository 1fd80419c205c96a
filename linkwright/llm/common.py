"""Small helpers the operators share: tables, scratch copies, word splitting, Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.clustering import connected_components
from linkwright.operators.spread import spread_join
from linkwright.plans import store
from linkwright.plans.store import CLEANUP  # noqa: F401
from linkwright.session import importable

# Words of letters and digits are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# One byte table does the same for UTF-8: bytes over 0x7F are always inside a word.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
    for b in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters of a UTF-8 text."""
    return text.translate(_WORD_BYTES).split()


def alnum_places(text: bytes) -> list[tuple[int, int]]:
    """Where the words of `alnum_words` begin and end in the bytes."""
    return [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_WORD_BYTES))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage, survives lost executors."""
    return store.stored(frame.sparkSession, frame, label, lasting)


def lean(frame: DataFrame, label: str, lasting: bool = False, **options: str) -> DataFrame:
    """Like `stored`, without the shuffled files that Spark else keeps until the driver collects its garbage."""
    return store.lean(frame.sparkSession, frame, label, lasting, **options)


def fold(doc_id: Column, modulus: int, held_out: int) -> Column:
    """Whether crc32 of the id as text falls into the held-out class; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == held_out, F.lit(False))


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8, null as empty."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def map_batches(
    frame: DataFrame, function: Callable[[pa.RecordBatch], Iterable[dict[str, list]]], schema: str
) -> DataFrame:
    """`function` turns an Arrow batch into column dictionaries of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    importable(frame.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in out], schema=out
                )

    return frame.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash per word; frequent words are not hashed again."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` neighbours."""
    number = len(hashes) - size + 1
    if number <= 0:
        return hashes[:0]
    out = np.zeros(number, np.uint64)
    for j in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + number]
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = np.minimum(values[:-step], values[step:])
        reach += step
    return values


FILTER_BITS = 1 << 23
PAIRS_IN_TASK = 500_000  # pairs of a posting list beyond which it is laid out on a grid


def thinned(frame: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` may be in the one column of `wanted`: a first sieve before a join.

    The sieve is a bitmap of `FILTER_BITS` bits, 1 MB whatever the tables, so it can be broadcast.  It lets
    a few others through, and all of them once it is full; the join decides.
    """
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    marks = wanted.select(F.pmod(F.xxhash64(F.col(wanted.columns[0])), F.lit(FILTER_BITS)).alias("place"))
    maps = marks.groupBy(F.expr("place div 32768").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.col("place") % 32768).alias("__bits")
    )
    seen = frame.withColumn("__place", place).withColumn("__bucket", F.expr("__place div 32768"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__place % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(__place % 8 as int)")
    hit = seen.join(F.broadcast(maps), "__bucket").filter(F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1)
    return hit.select(*[F.col(f"`{c}`") for c in frame.columns])


def with_strays(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """`postings` (key, node, leader, ...) with the component of each node so far, that of its list's leader, and
    whether these differ: the node is then a stray of the list."""
    label = labels.select("node", "component")
    known = postings.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = label.select(F.col("node").alias("leader"), F.col("component").alias("lead"))
    known = known.join(lead, "leader", "left").withColumn("lead", F.coalesce("lead", "leader"))
    return known.withColumn("stray", F.col("component") != F.col("lead"))


def crossing(postings: DataFrame, labels: DataFrame, carried: list[str], alike: Column) -> DataFrame:
    """Pairs (a, b) that a posting list holds, that its leader has not brought together, and that `alike`
    holds for.

    `postings` has key, node, leader and the `carried` columns; `alike` reads these as ``c_a`` and ``c_b``;
    `labels` are the components so far.  Strays meet every member of another component, the leader apart, for both
    may be alike though neither is like the leader.  Lists without strays are left out before anything is paired;
    long lists are laid out on a grid.
    """
    known = with_strays(postings, labels)
    strays = stored(known.filter("stray").drop("stray", "lead", "leader"), "strays")
    others = known.filter("node <> leader").join(strays.select("key").distinct(), "key", "left_semi")
    left = strays.select("key", F.col("node").alias("a"), F.col("component").alias("ca"), *[F.col(c).alias(f"{c}_a") for c in carried])
    right = stored(others, "others").select(
        F.col("key").alias("k"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("stray").alias("sb"),
        *[F.col(c).alias(f"{c}_b") for c in carried],
    )
    apart = (F.col("ca") != F.col("cb")) & ((F.col("a") < F.col("b")) | ~F.col("sb"))
    return spread_join(left, right, ["key"], ["k"], "a", "b", apart & alike, PAIRS_IN_TASK).select("a", "b")


def settled(links: DataFrame, more: Callable[[DataFrame], DataFrame], forests: bool = True) -> DataFrame:
    """(node, component) from the links, and from those that `more` finds given these components."""
    labels = stored(connected_components(links, forests=forests), "labels")
    added = more(labels)
    if added.isEmpty():
        return labels
    known = labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(known.unionByName(added), forests=forests)
