"""Removal of passages that stand in an earlier document, with Aho-Corasick automata.

1. Each document is sketched: words, checksum, and anchors.  The anchor of a window is its smallest
   hashed run of `GRAM` words, so equal windows have equal anchors, and only one word in about eighteen
   begins one.  A whole copy of an earlier document is settled by its checksum.
2. Anchors that stand in two documents point at candidate windows; those whose hash occurs in two
   documents are recurring passages, each with the first place it stands in.
3. A document is sent the chunks of first places that its windows point at.  Documents are worked on in
   shards of bounded pattern size; a shard's chunks are compiled into one automaton (blocks of half a window
   are the patterns: every window holds a whole one), its documents are streamed through it, and every match
   is extended word by word.  What is removed has therefore been compared word for word.

Work follows the number of repeated words.  No step gathers more than one document's anchors or windows;
hot anchors, windows and chunks are grouped with partial sums or joined to a table that has one row per key.
Window hashes have 64 bits: among n candidate windows a collision, which could hide a repeat, has odds of
n squared over 4e19.

Null text has no words; fewer words than a window are never removed; a row without doc_id is neither earlier
nor later than any other, so it stays whole; repeated rows with one doc_id are not earlier than each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import WordHashes, grams, importable, map_batches, sliding_min, stored, utf8

WINDOW = 50
GRAM = 16
CHUNK = 256  # windows that begin in a chunk
SHARD_WORDS = 300_000


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Anchor of each window."""
    return _signed(sliding_min(grams(hashes, gram), window - gram + 1)) if len(hashes) >= window else np.empty(0, np.int64)


def _sketch(documents: DataFrame, window: int, gram: int) -> DataFrame:
    def sketch(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        hashes = WordHashes()
        numbers, sums, anchors = [], [], []
        for text in utf8(batch.column("text")):
            words = text.split()
            numbers.append(len(words))
            sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
            anchors.append(np.unique(_anchors(hashes.of(words), window, gram)) if len(words) >= window else [])
        yield {"doc_id": batch.column("doc_id"), "n_words": numbers, "sha": sums, "anchors": anchors}

    return map_batches(documents, sketch, "doc_id bigint, n_words bigint, sha string, anchors array<bigint>")


def _windows(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, doc_id, at) of the windows whose anchor recurs."""

    def find(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        hashes = WordHashes()
        keys, owners, places = [], [], []
        known = zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("anchors"))
        for doc_id, text, anchors in known:
            values = hashes.of(text.split())
            at = np.flatnonzero(np.isin(_anchors(values, window, gram), anchors.values.to_numpy()))
            if len(at):
                keys.append(_signed(grams(values, window)[at]))
                owners.append(np.full(len(at), doc_id, np.int64))
                places.append(at)
        if keys:
            yield {"key": np.concatenate(keys), "doc_id": np.concatenate(owners), "at": np.concatenate(places)}

    return map_batches(candidates, find, "key bigint, doc_id bigint, at int")


def _chunks(candidates: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(source, chunk, words): the texts of the chunks that hold first places."""
    lists = wanted.groupBy(F.col("source").alias("doc_id")).agg(F.collect_set("chunk").alias("chunks"))

    def cut(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        sources, numbers, texts = [], [], []
        for doc_id, text, chunks in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("chunks").to_pylist()):
            words = text.split()
            for chunk in chunks:
                part = words[chunk * CHUNK : chunk * CHUNK + CHUNK + window - 1]
                if len(part) >= window:
                    sources.append(doc_id)
                    numbers.append(chunk)
                    texts.append(b" ".join(part).decode())
        yield {"source": sources, "chunk": numbers, "words": texts}

    return map_batches(candidates.select("doc_id", "text").join(lists, "doc_id"), cut, "source bigint, chunk int, words string").distinct()


class _Shard:
    """One automaton over the passages of some documents."""

    def __init__(self, window: int) -> None:
        self.window, self.block = window, window // 2
        self.ids: dict[bytes, int] = {}
        self.passages: list[tuple[int, np.ndarray]] = []
        self.seen: set[tuple[int, int]] = set()
        self.size = 0
        self.blocks: dict[tuple[int, ...], list[tuple[int, int]]] = {}

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in words), np.int64, len(words))

    def add(self, source: int, chunk: int, words: bytes) -> None:
        if (source, chunk) in self.seen:
            return
        self.seen.add((source, chunk))
        ids = self.numbers(words)
        self.passages.append((source, ids))
        self.size += len(ids)
        for at in range(0, len(ids) - self.block + 1, self.block):
            self.blocks.setdefault(tuple(ids[at : at + self.block].tolist()), []).append((len(self.passages) - 1, at))

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, places in self.blocks.items():
            self.automaton.add_word(block, places)
        if self.blocks:
            self.automaton.make_automaton()

    def repeated(self, doc_id: int, text: bytes) -> np.ndarray:
        """Which words of a document stand in a window of an earlier one."""
        ids = self.numbers(text)
        marks = np.zeros(len(ids), bool)
        done: dict[tuple[int, int], int] = {}
        if not self.blocks or len(ids) < self.window:
            return marks
        for end, places in self.automaton.iter(tuple(ids.tolist())):
            begin = end - self.block + 1
            for passage, at in places:
                source, words = self.passages[passage]
                shift = begin - at
                if source >= doc_id or done.get((passage, shift), -1) > begin:
                    continue
                # the run of equal words around the block
                left = min(begin, at)
                differ = np.flatnonzero(ids[begin - left : begin] != words[at - left : at])
                low = begin - left + (int(differ[-1]) + 1 if len(differ) else 0)
                right = min(len(ids) - begin, len(words) - at)
                differ = np.flatnonzero(ids[begin : begin + right] != words[at : at + right])
                high = begin + (int(differ[0]) if len(differ) else right)
                done[passage, shift] = high
                if high - low >= self.window:
                    marks[low:high] = True
        return marks


def _stream(routed: DataFrame, window: int) -> DataFrame:
    """(doc_id, sha, n_removed, kept): documents with their chunks, through sharded automata."""

    def work(shard: _Shard, rows: list[tuple]) -> dict[str, list]:
        shard.compile()
        out = {"doc_id": [], "sha": [], "n_removed": [], "kept": []}
        for doc_id, text in rows:
            words = text.split()
            marks = shard.repeated(doc_id, text)
            out["doc_id"].append(doc_id)
            out["sha"].append(hashlib.sha256(b" ".join(words)).hexdigest())
            out["n_removed"].append(int(marks.sum()))
            out["kept"].append(b" ".join(w for w, gone in zip(words, marks.tolist()) if not gone).decode())
        return out

    def locate(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        shard, rows = _Shard(window), []
        for at, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")))):
            for passage in batch.column("passages")[at].as_py():
                shard.add(passage["source"], passage["chunk"], passage["words"].encode())
            rows.append((doc_id, text))
            if shard.size >= SHARD_WORDS:
                yield work(shard, rows)
                shard, rows = _Shard(window), []
        if rows:
            yield work(shard, rows)

    return map_batches(routed, locate, "doc_id bigint, sha string, n_removed bigint, kept string")


def deduplicate(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, sha, n_words, n_removed, kept) per row; `kept` is null where all words stay.

    `sha` is the checksum of the words joined by single spaces.
    """
    importable(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    sketch = stored(_sketch(texts, window, gram), "sketch")
    # stored, so that the joins with it may split a hot checksum
    firsts = stored(sketch.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first")), "firsts")
    long = sketch.filter(F.size("anchors") > 0)
    # whole copies add nothing that the first of them does not hold
    places = long.join(firsts.withColumnRenamed("first", "doc_id"), ["sha", "doc_id"]).select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = places.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")
    lists = places.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    candidates = stored(texts.join(lists, "doc_id"), "candidates")

    found = _windows(candidates, window, gram)
    confirmed = found.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last"))
    confirmed = confirmed.filter("first.doc_id < last").select(
        "key", F.col("first.doc_id").alias("source"), F.expr(f"cast(first.at div {CHUNK} as int)").alias("chunk")
    )
    confirmed = stored(confirmed, "passages")
    pairs = found.join(confirmed, "key").filter("source < doc_id").select("doc_id", "source", "chunk").distinct()
    chunks = _chunks(candidates, confirmed.select("source", "chunk").distinct(), window)
    sent = pairs.join(chunks, ["source", "chunk"]).groupBy("doc_id").agg(F.collect_list(F.struct("source", "chunk", "words")).alias("passages"))
    cut = _stream(candidates.select("doc_id", "text").join(sent, "doc_id"), window).filter("n_removed > 0").distinct()

    whole = sketch.select("doc_id", "n_words", "sha").join(firsts, "sha", "left").join(cut, ["doc_id", "sha"], "left")
    copy = (F.col("n_words") >= window) & (F.col("first") < F.col("doc_id"))
    return whole.select(
        "doc_id", "sha", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def report(documents: DataFrame) -> DataFrame:
    """One digest row per document."""
    return deduplicate(documents).select(
        "doc_id", "n_words", "n_removed", F.when(F.col("kept").isNull(), F.col("sha")).otherwise(F.sha2("kept", 256)).alias("kept_sha256")
    )
