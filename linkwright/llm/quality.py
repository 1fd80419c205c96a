"""Quality scores by histogram gradient-boosted trees over document statistics.

1. A document becomes a short row of statistics (`NAMES`): sizes, shares of character classes, word and line
   lengths, repetition.  Nothing but the text goes in; the whole text counts.
2. Labelled documents that are not held out are joined to their statistics; of these the `SAMPLE` with the smallest
   hash of the id train the trees (documented bound; all of them where there are fewer).
3. Statistics are binned at quantiles.  Each tree grows level by level: histograms of gradients and curvatures per
   node, statistic and bin give the best split of every node at once.  Logistic loss; all trees have `DEPTH` levels.
4. Trees are flattened into arrays (statistic, cut, leaf value by position in the complete tree).  Scoring walks
   all rows of a batch through a tree level at a time.

The score is the probability of label 1.  Null text is empty text; its statistics are zero and it is scored like any
other.  Labels other than 0 and 1, and ids whose label rows contradict each other, teach nothing; repeated label
rows count once; of repeated document ids the smallest row of statistics is learnt from.  Each document row is
scored for itself, a row without doc_id too.  Without labels every score is 0.5, with one class only it is that
class's smoothed share.  Equal gains go to the first statistic and the lowest cut.  Empty tables give no rows;
further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.llm.common import fold, importable, stored, utf8

SAMPLE = 40_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.2
RIDGE = 1.0  # added to a node's curvature
LEAST = 3.0  # curvature that both sides of a split need
GOOD = 0.7  # score from which a document is predicted to be good

NAMES = [
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digits", "spaces", "newlines", "controls", "beyond_ascii",
    "punctuation", "top_punctuation", "kinds_of_punctuation", "byte_entropy", "word_length", "word_length_spread",
    "longest_word", "distinct_words", "top_word", "top_three_words", "word_entropy", "repeated_next", "wordless", "marked_end",
    "shouted", "capitalised", "distinct_pairs", "line_words", "distinct_lines", "line_of_most", "closed_lines", "short_lines",
]

_CLASS = np.zeros(256, np.int64)  # 0 other ASCII controls, then in the order of the statistics
for _from, _to, _class in ((65, 91, 1), (97, 123, 2), (48, 58, 3), (32, 33, 4), (10, 11, 5), (128, 256, 6)):
    _CLASS[_from:_to] = _class
_PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_ENDS = tuple(bytes([b]) for b in _PUNCTUATION)


def _entropy(counts: np.ndarray) -> float:
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


def statistics_of(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text, in the order of `NAMES`."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    held = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    other, upper, lower, digits, spaces, newlines, beyond = np.bincount(_CLASS, held, 7)
    marks = held[_PUNCTUATION]
    out = [0.0, 0.0, 0.0, upper / n, lower / n, digits / n, spaces / n, newlines / n, (other - marks.sum()) / n, beyond / n]
    out += [marks.sum() / n, marks.max() / n, float((marks > 0).sum()), _entropy(held)]
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[:3] = [math.log1p(n), math.log1p(len(words)), math.log1p(len(lines))]
    if not words:
        return out + [0.0] * (len(NAMES) - len(out))
    many = len(words)
    lengths = np.fromiter(map(len, words), np.float64, many)
    counted = Counter(words)
    times = np.fromiter(counted.values(), np.float64, len(counted))
    top = -np.sort(-times)[:3]
    out += [lengths.mean(), lengths.std(), math.log1p(lengths.max()), len(counted) / many, top[0] / many, top.sum() / many, _entropy(times)]
    pairs = list(pairwise(words))
    wordless = marked = shouted = capitalised = 0
    for word, often in counted.items():
        if word.isupper():
            shouted += often
        elif word[:1].isupper():
            capitalised += often
        if word.endswith(_ENDS):
            marked += often
            # bytes beyond ASCII are letters here
            if not (word.isalnum() or any(b > 127 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in word)):
                wordless += often
    out += [sum(a == b for a, b in pairs) / many, wordless / many, marked / many, shouted / many, capitalised / many]
    out += [len(set(pairs)) / max(1, len(pairs))]
    of_lines = Counter(lines)
    out += [
        math.log1p(many / len(lines)), len(of_lines) / len(lines), max(of_lines.values()) / len(lines),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), sum(x.count(b" ") < 2 for x in lines) / len(lines),
    ]
    return out


def statistics(documents: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every input column (or those of `carry`) inside `in`, and the statistics of the text."""
    importable(documents.sparkSession)
    kept = documents.columns if carry is None else carry
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("in"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics_of(t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("in"), pa.array(found, pa.list_(pa.float32()))], names=["in", "statistics"])

    return rows.mapInArrow(run, T.StructType([rows.schema["in"]]).add("statistics", T.ArrayType(T.FloatType())))


class Trees:
    """Boosted trees as arrays: a row per tree, a column per node of a complete tree, level by level."""

    def __init__(self, depth: int) -> None:
        self.depth, self.start = depth, 0.0
        self.feature = np.zeros((0, (1 << depth) - 1), np.int32)
        self.cut = np.zeros((0, (1 << depth) - 1), np.float32)
        self.leaf = np.zeros((0, 1 << depth))

    def walk(self, tree: int, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: right where the statistic is above the cut."""
        node, at = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(self.depth):
            node = 2 * node + 1 + (rows[at, self.feature[tree, node]] > self.cut[tree, node])
        return node - ((1 << self.depth) - 1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(rows), self.start)
        for tree in range(len(self.leaf)):
            total += self.leaf[tree, self.walk(tree, rows)]
        return 1.0 / (1.0 + np.exp(-total))


def _cuts(rows: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper borders of all bins but the last, per statistic: values that occur, each once."""
    order = np.sort(rows, axis=0)
    at = (np.arange(1, bins) * len(rows)) // bins
    return [np.setdiff1d(order[at, j], order[-1:, j]) for j in range(rows.shape[1])]


def best_splits(binned: np.ndarray, node: np.ndarray, nodes: int, slope: np.ndarray, curve: np.ndarray, sizes: list[int], bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistic, bin, gain) of the best split of each node, from histograms; gain 0 where none helps."""
    whole_g, whole_h = np.bincount(node, slope, nodes), np.bincount(node, curve, nodes)
    base = whole_g**2 / (whole_h + RIDGE)
    best = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes)
    for j, size in enumerate(sizes):
        if not size:
            continue
        place = node * bins + binned[:, j]
        g = np.bincount(place, slope, nodes * bins).reshape(nodes, bins).cumsum(1)[:, :size]
        h = np.bincount(place, curve, nodes * bins).reshape(nodes, bins).cumsum(1)[:, :size]
        right_g, right_h = whole_g[:, None] - g, whole_h[:, None] - h
        gain = g**2 / (h + RIDGE) + right_g**2 / (right_h + RIDGE) - base[:, None]
        gain[(h < LEAST) | (right_h < LEAST)] = 0.0
        at = gain.argmax(1)
        top = gain[np.arange(nodes), at]
        better = top > best[2] + 1e-9
        best[0][better], best[1][better], best[2][better] = j, at[better], top[better]
    return best


def boost(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Fit on statistics (rows, statistics) and labels 0 or 1."""
    model = Trees(depth)
    good = float(labels.sum())
    model.start = math.log((good + 1) / (len(labels) - good + 1))
    if good in (0.0, float(len(labels))):
        return model
    cuts = _cuts(rows, bins)
    binned = np.stack([np.searchsorted(c, rows[:, j], "left") for j, c in enumerate(cuts)], 1)
    sizes, inner = list(map(len, cuts)), (1 << depth) - 1
    total = np.full(len(rows), model.start)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        chance = 1.0 / (1.0 + np.exp(-total))
        slope, curve = chance - labels, chance * (1.0 - chance)
        feature, limit = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            which, where, gain = best_splits(binned, node, nodes, slope, curve, sizes, bins)
            split = gain > 0
            for k in np.flatnonzero(split):
                feature[first + k], limit[first + k] = which[k], cuts[which[k]][where[k]]
            # a node without a split sends all its rows left
            node = 2 * node + (split[node] & (binned[np.arange(len(rows)), which[node]] > where[node]))
        value = -rate * np.bincount(node, slope, inner + 1) / (np.bincount(node, curve, inner + 1) + RIDGE)
        total += value[node]
        features.append(feature), limits.append(limit), leaves.append(value)
    model.feature, model.cut, model.leaf = np.stack(features), np.stack(limits), np.stack(leaves)
    return model


def learn(described: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from (doc_id, statistics) and the labels (doc_id, quality) of documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), 4, 2) & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.filter("quality = other").select("doc_id", "quality")
    met = described.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("statistics").alias("statistics"))
    rows = met.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    if not len(rows):
        return Trees(DEPTH)
    return boost(np.stack(rows["statistics"].to_numpy()).astype(np.float32), rows["quality"].to_numpy(np.float64))


def score(described: DataFrame, model: Trees) -> DataFrame:
    """Every column but the statistics, with the probability of label 1."""
    kept = [c for c in described.columns if c != "statistics"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("statistics").flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(model.scores(rows))], names=[*kept, "score"])

    importable(described.sparkSession)
    return described.mapInArrow(run, T.StructType([described.schema[c] for c in kept]).add("score", "double"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; learns from the labels of documents that are not held out."""
    each = statistics(documents, ["doc_id"]).select(F.col("in.doc_id").cast("bigint").alias("doc_id"), "statistics")
    described = stored(each, "statistics")
    scored = score(described, learn(described, labels))
    predicted = (F.col("score") >= GOOD).cast("int")
    return scored.select("doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", predicted.alias("predicted"))
