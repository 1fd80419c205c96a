"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of the normalised items.  Document words are streamed through it,
the longest match ending at each word is tracked, and each occurring window is looked up along the
suffix links.  Spark splits the items into shards of a bounded number of words.  There is one pass over the
documents per shard; its marks are stored and united with those of the passes before, so a task holds one automaton
and the driver one shard's words at a time, however large the benchmark.

Before streaming, stretches that cannot hold a window are skipped: each pair of neighbouring words of an
occurrence is also a pair of neighbours in an item, so only runs of such pairs are walked.  The pair
filter may let too much through, never too little.

Null and empty texts have no words and are clean; repeated items and rows count as they stand; an empty
benchmark leaves every document clean; items with a null id are left out, because they cannot be named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import alnum_places, alnum_words, importable, map_batches, stored, utf8
from linkwright.operators.ordering import running_totals

WINDOW = 13
COVERAGE = 20  # one word in so many must be hit
SHARD_WORDS = 100_000
_PAIR_BITS = 22


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            sequences.append((name, ids))
            last = 0
            for word in ids:
                last = self._extend(last, word)
        named: dict[int, dict[int, set[str]]] = {}
        self.shortest = window
        for name, ids in sequences:
            width = min(window, len(ids))
            self.shortest = min(self.shortest, width)
            for start in range(len(ids) - width + 1):
                state = 0
                for word in ids[start : start + width]:
                    state = self.next[state][word]
                named.setdefault(state, {}).setdefault(width, set()).add(name)
        # state -> [(width, items)], and the next state up the links that has any
        self.ends = {s: [(w, tuple(sorted(n))) for w, n in by.items()] for s, by in named.items()}
        self.up = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[state]
            self.up[state] = above if above in self.ends else self.up[above] if above >= 0 else -1
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        for _, ids in sequences:
            if len(ids) > 1:
                both = np.array(ids, np.int64)
                self.pairs[_pair(both[:-1], both[1:])] = True

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, known, word)
        state = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            whole = self.length[target] == self.length[at] + 1
            self.link[state] = target if whole else self._clone(at, target, word)
        return state

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, at: int, target: int, word: int) -> int:
        copy = self._new(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of known neighbours long enough to hold the shortest window."""
        if len(ids) < self.shortest:
            return []
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        joined &= self.pairs[_pair(ids[:-1], ids[1:])]
        breaks = np.flatnonzero(~joined) + 1
        starts = np.concatenate(([0], breaks))
        stops = np.concatenate((breaks, [len(ids)]))
        fit = (stops - starts >= self.shortest) & (ids[starts] >= 0)
        return list(zip(starts[fit].tolist(), stops[fit].tolist()))

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(position after the window, width, items) of each occurring window."""
        state = matched = 0
        for at, word in enumerate(ids, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            found = state if state in self.ends else self.up[state]
            while found > 0:
                for width, items in self.ends[found]:
                    if matched >= width:
                        yield at, width, items
                found = self.up[found]


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def sharded(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """(shard, item, words) of the items that have words, stored by shard, and the number of shards.

    Spark numbers the items and adds up their words in ranges, so that a shard holds about `shard_words` words
    (or one item); the driver sees no text.
    """
    importable(benchmark.sparkSession)

    def split(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        words = [b" ".join(alnum_words(t)) for t in utf8(batch.column("text"))]
        yield {"item": batch.column("item"), "words": words, "n": [w.count(b" ") + 1 if w else 0 for w in words]}

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = map_batches(rows.filter("item is not null and text is not null"), split, "item string, words binary, n bigint").filter("n > 0")
    items = stored(items.withColumn("number", F.monotonically_increasing_id()), "items")
    placed = running_totals(items.select("number", "n"), "number", ["n"])
    placed = placed.select("number", F.floor(F.col("before_n") / shard_words).cast("int").alias("shard"))
    found = stored(items.join(placed, "number").select("shard", "item", "words"), "shards")
    top = found.agg(F.max("shard")).first()[0]
    return found, 0 if top is None else top + 1


def _items_of(shards: DataFrame, number: int) -> list[tuple[str, list[bytes]]]:
    """One shard's items; only `SHARD_WORDS` words and the words of one item come at once."""
    rows = shards.filter(F.col("shard") == number).select("item", "words").collect()
    return [(r["item"], bytes(r["words"]).split(b" ")) for r in sorted(rows, key=lambda r: r["item"])]


def _spans(text: bytes, automaton: ItemAutomaton) -> tuple[int, list[int], list[int], set[str]]:
    words = alnum_words(text)
    ids = np.fromiter(map(automaton.vocabulary.get, words, repeat(-1)), np.int64, len(words))
    starts: list[int] = []
    stops: list[int] = []
    items: set[str] = set()
    for begin, end in automaton.stretches(ids):
        for at, width, names in automaton.matches(ids[begin:end].tolist()):
            start, stop = begin + at - width, begin + at
            items.update(names)
            if stops and start <= stops[-1] and start >= starts[-1]:
                stops[-1] = max(stop, stops[-1])
            else:
                starts.append(start)
                stops.append(stop)
    return len(words), starts, stops, items


def _union(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(zip(starts, stops)):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
    shard_words: int = SHARD_WORDS, carry: list[str] | None = None,
) -> DataFrame:
    """Every input column `c` (or those of `carry`) as `in.c`, with n_words, n_hit, spans, items, contaminated.

    Spans are half-open word ranges, united and in order.  A document is contaminated when
    `coverage * n_hit >= n_words` and anything is hit.
    """
    kept = documents.columns if carry is None else carry
    marked = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("in"), F.col("text").cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    importable(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    shards, number = sharded(benchmark, shard_words)
    for at in range(max(1, number)):
        shipped = context.broadcast(_items_of(shards, at))

        def walk(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            automaton = ItemAutomaton(shipped.value, window)
            for batch in batches:
                numbers, spans, names = [], [], []
                earlier = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                for text, (old, known) in zip(utf8(batch.column("text")), earlier):
                    n, starts, stops, items = _spans(text, automaton)
                    numbers.append(n)
                    both = _union(starts + [x["start"] for x in old], stops + [x["stop"] for x in old])
                    spans.append([{"start": a, "stop": b} for a, b in both])
                    names.append(sorted(items.union(known)))
                columns = {"n_words": numbers, "spans": spans, "items": names}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) if f.name in columns else batch.column(f.name) for f in batch.schema],
                    schema=batch.schema,
                )

        marked = marked.mapInArrow(walk, marked.schema)
        if at + 1 < number:
            # stored between passes, so that a task holds one automaton
            marked = stored(marked, "marked")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    marked = marked.withColumn("n_hit", hit)
    return marked.select(
        "in", "n_words", "n_hit", "spans", "items",
        ((F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One digest row per document."""
    found = contamination(documents, benchmark, carry=["doc_id"])
    return found.select(
        F.col("in.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    clean = contamination(documents, benchmark, **options).filter("not contaminated")
    return clean.select("in.*")


def _cut(text: bytes, spans: list[dict[str, int]]) -> bytes:
    places = alnum_places(text)
    left, at = [], 0
    for span in spans:
        left.append(text[at : places[span["start"]][0]])
        at = places[span["stop"] - 1][1]
    return b"".join([*left, text[at:]])


def remove_spans(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, the marked words and what stands between them cut out of their texts."""
    names = documents.columns
    inner = [F.col(f"in.`{c}`") if c != "text" else F.col("in.text").cast("string").alias("text") for c in names]
    marked = contamination(documents, benchmark, **options).select(F.struct(*inner).alias("in"), "spans")
    marked = marked.select(F.col("in.text").alias("text"), "in", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _cut(text, spans).decode() if spans else whole
                for text, whole, spans in zip(utf8(batch.column("text")), batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            ]
            columns = [pa.array(texts, f.type) if f.name == "text" else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    found = marked.mapInArrow(cut, marked.schema)
    return found.select(*[F.col("text") if c == "text" else F.col(f"in.`{c}`") for c in names])
