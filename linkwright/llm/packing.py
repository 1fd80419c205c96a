"""Packing documents into training sequences by cutting-stock column generation.

1. Texts are tokenised once, in parallel.  A document becomes full pieces of the sequence length and one
   remainder, for which the checksums of what lies before and after a few fixed cut points are noted too.
2. Only a histogram of remainder lengths, in bins, reaches the driver: its size is fixed by the sequence
   length.  A linear program over patterns (how many pieces of which bin share a sequence) and over cuts
   (one piece of a bin becomes two of smaller bins) is solved by column generation; an unbounded knapsack
   by dynamic programming prices the patterns.
3. Pattern counts are rounded down; what is left, a number that does not grow with the corpus, is
   packed largest first, on counts again.
4. Pieces are ranked inside their bin, in parallel, and take the places the patterns offer by rank.

The text of an added token (such as the end of a text) inside a document gets that token's id, as the tokenizer
file has it.  Documents with the same number of tokens are ranked in no stated order.  A null doc_id is kept.
Padding is what bins round up plus what patterns leave open.  A sequence whose length is a power of two
needs none.  Null text is empty text: its only token is the end token.  Empty tables give no rows;
repeated rows are packed each for itself; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import importable, stored

LENGTH = 2048
END = 1
BIN = 16
CUT_EVERY = 256
CUT_COST = 0.02  # a cut is worth so much of a sequence
RANKED_TOGETHER = 5_000
CACHED_WORDS = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    """The same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with the ids of frequent words kept.

    The vocabulary's splitting rule always breaks before a space that follows a non-space, so a text may be
    cut there and its parts encoded on their own.  New words are encoded many at a time: only the first
    token of a word begins with a space, so the tokens of a row of words fall apart again there.  Words of
    Latin letters go through the faster of two libraries that hold the same vocabulary.  Words that hold the text
    of an added token do not: the tokenizer file has an id for it (`plain`: its characters' ids instead).
    """

    def __init__(self, path: str, ranks: str, plain: bool = False) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain
        added = [] if plain else [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.opens = np.zeros(max(merges.values()) + 1, bool)
        self.opens[[rank for token, rank in merges.items() if token.startswith(b" ")]] = True
        self.known: dict[str, bytes] = {}  # a word without its space -> ids with it

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: list[str]) -> None:
        plain, rest = [], []
        for word in words:
            quick = _LATIN.fullmatch(word) and not (self.added and self.added.search(word))
            (plain if quick else rest).append(word)
        for at in range(0, len(plain), 500):
            row = plain[at : at + 500]
            ids = np.array(self.quick.encode_ordinary(" " + " ".join(row)), "<u4")
            starts = np.flatnonzero(self.opens[ids]) * 4
            if len(starts) == len(row):
                data, stops = ids.tobytes(), starts[1:].tolist() + [4 * len(ids)]
                self.known.update(zip(row, map(data.__getitem__, map(slice, starts.tolist(), stops))))
            else:
                rest += row
        self.known.update(zip(rest, self._whole([" " + w for w in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [_words(t) for t in texts]
        heads = self._whole([p[0] for p in parts])
        fresh = set(filterfalse(self.known.__contains__, chain.from_iterable(islice(p, 1, None) for p in parts)))
        if len(self.known) + len(fresh) > CACHED_WORDS:
            used = set(chain.from_iterable(parts))
            self.known = {w: ids for w, ids in self.known.items() if w in used}
        self._learn(sorted(fresh))
        return [h + b"".join(map(self.known.__getitem__, islice(p, 1, None))) for h, p in zip(heads, parts)]


# Printable ASCII without the space, Latin letters, and line ends inside.
_LATIN = re.compile("[\n\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
_SPACE_SPACE = re.compile(r"\s ")
_encoders: dict[str, Encoder] = {}  # of this Python worker; later tasks find the words known


def _words(text: str) -> list[str]:
    """The text cut at spaces that follow a non-space, these spaces left out."""
    parts = text.split(" ")
    if not _SPACE_SPACE.search(text):
        return parts
    joined = parts[:1]
    for part in parts[1:]:
        if not joined[-1] or joined[-1][-1].isspace():
            joined[-1] += " " + part
        else:
            joined.append(part)
    return joined


def pieces(
    documents: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, ranks: str | None = None
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, heads, tails): pieces of at most `length` tokens.

    heads and tails: checksums of a piece up to and from each multiple of `CUT_EVERY`.
    """
    path, ranks = path or tokenizer_path(), ranks or ranks_path()
    importable(documents.sparkSession)
    closing = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path, ranks))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id")
            for low in range(0, len(texts), 256):
                rows: list[tuple] = []
                for at, ids in enumerate(encoder.encode(texts[low : low + 256]), low):
                    ids += closing
                    for start in range(0, len(ids), 4 * length):
                        piece = ids[start : start + 4 * length]
                        points = range(4 * CUT_EVERY, len(piece), 4 * CUT_EVERY) if len(piece) < 4 * length else ()
                        rows.append((
                            at, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4,
                            [zlib.crc32(piece[:p]) for p in points], [zlib.crc32(piece[p:]) for p in points],
                        ))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(columns[0], pa.int64()))]
                    + [pa.array(c, pa.int64()) for c in columns[1:5]]
                    + [pa.array(c, pa.list_(pa.int64())) for c in columns[5:]],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "heads", "tails"],
                )

    numbers = ", ".join(f"{n} bigint" for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, numbers + ", heads array<bigint>, tails array<bigint>"
    )


class CuttingStock:
    """Patterns for a histogram of bins: `demand[b]` pieces of size b + 1, sequences of `capacity`."""

    def __init__(self, demand: np.ndarray, capacity: int, cut_points: list[int], rounds: int = 4000) -> None:
        self.capacity, self.cut_points = capacity, cut_points
        self.demand = demand.astype(np.int64)
        self.sizes = np.arange(1, len(demand) + 1)
        self.cuts: dict[tuple[int, int], int] = {}  # (bin, point) -> pieces cut there
        self.patterns: list[tuple[np.ndarray, int]] = []
        self._solve(rounds)

    def _knapsack(self, value: np.ndarray) -> tuple[float, np.ndarray]:
        """Most valuable pattern: unbounded knapsack, one step per unit of capacity."""
        best = np.zeros(self.capacity + 1)
        take = np.full(self.capacity + 1, -1)
        n = len(value)
        for room in range(1, self.capacity + 1):
            top = min(n, room)
            offers = value[:top] + best[room - 1 :: -1][:top]
            pick = int(offers.argmax())
            best[room], take[room] = best[room - 1], -1
            if offers[pick] > best[room] + 1e-12:
                best[room], take[room] = offers[pick], pick
        pattern, room = np.zeros(n, np.int64), self.capacity
        while room > 0:
            if take[room] < 0:
                room -= 1
            else:
                pattern[take[room]] += 1
                room -= int(take[room]) + 1
        return float(best[self.capacity]), pattern

    def _best_cut(self, value: np.ndarray) -> tuple[float, tuple[int, int] | None]:
        """Cut of most gain: its two pieces must be cheaper to place than the whole."""
        gain, where = 0.0, None
        for point in self.cut_points:
            if point < len(value):
                whole = value[point:]
                gains = whole - value[point - 1] - value[: len(whole)] - CUT_COST
                at = int(gains.argmax())
                if gains[at] > gain:
                    gain, where = float(gains[at]), (point + at, point)
        return gain, where

    def _solve(self, rounds: int) -> None:
        """Revised simplex over generated columns, from one-bin patterns, then rounding."""
        n = len(self.demand)
        columns: list[object] = []
        for b in range(n):
            pattern = np.zeros(n, np.int64)
            pattern[b] = self.capacity // (b + 1)
            columns.append(pattern)
        inverse = np.diag([1.0 / (self.capacity // (b + 1)) for b in range(n)])
        costs = np.ones(n)
        amount = inverse @ self.demand
        for _ in range(rounds):
            value = costs @ inverse
            best, pattern = self._knapsack(value)
            gain, cut = self._best_cut(value)
            if max(best - 1.0, gain) < 1e-7:
                break
            if best - 1.0 >= gain:
                entering, cost, column = pattern, 1.0, pattern.astype(float)
            else:
                entering, cost = cut, CUT_COST
                column = self._cut_column(cut)
            direction = inverse @ column
            up = direction > 1e-9
            if not up.any():
                break
            ratio = np.where(up, np.maximum(amount, 0.0) / np.where(up, direction, 1.0), np.inf)
            leaving = int(ratio.argmin())
            step = ratio[leaving]
            amount -= step * direction
            amount[leaving] = step
            pivot = inverse[leaving] / direction[leaving]
            inverse -= np.outer(direction, pivot)
            inverse[leaving] = pivot
            columns[leaving], costs[leaving] = entering, cost
        left = self.demand.copy()
        for entering, much in zip(columns, amount):
            if isinstance(entering, tuple):
                # a cut offers what patterns then use: round it up as far as pieces are there
                times = min(int(np.ceil(max(much, 0.0) - 1e-9)), int(left[entering[0]]))
                if times > 0:
                    self.cuts[entering] = times
                    left += (times * -self._cut_column(entering)).astype(np.int64)
        for entering, much in zip(columns, amount):
            if not isinstance(entering, tuple) and entering.any():
                held = np.flatnonzero(entering)
                times = min(int(max(much, 0.0) + 1e-9), int((left[held] // entering[held]).min()))
                if times > 0:
                    self.patterns.append((entering, times))
                    left -= times * entering
        while left.any():  # largest first; bounded by the number of basic patterns
            pattern, room = np.zeros(n, np.int64), self.capacity
            for b in range(n - 1, -1, -1):
                fit = min(int(left[b]), room // (b + 1))
                pattern[b] = fit
                room -= fit * (b + 1)
            held = np.flatnonzero(pattern)
            times = int((left[held] // pattern[held]).min())
            self.patterns.append((pattern, times))
            left -= times * pattern

    def _cut_column(self, cut: tuple[int, int]) -> np.ndarray:
        """What a cut takes (positive) and offers (negative), as a pattern would take it."""
        whole, point = cut
        column = np.zeros(len(self.demand))
        column[whole] += 1.0
        column[point - 1] -= 1.0
        column[whole - point] -= 1.0
        return column


def _ranked(rows: DataFrame, group: str, order: list[str], number: int) -> DataFrame:
    """Zero-based rank within the group, without a task that holds a whole group."""
    share = F.pmod(F.xxhash64(*order), F.lit(max(1, -(-number // RANKED_TOGETHER))))
    rows = rows.withColumn("share", share)
    counts = rows.groupBy(group, "share").agg(F.count("*").alias("n"))
    before = counts.withColumn("first", F.sum("n").over(Window.partitionBy(group).orderBy("share")) - F.col("n")).drop("n")
    inside = Window.partitionBy(group, "share").orderBy(*order)
    rows = rows.withColumn("inside", F.row_number().over(inside) - 1)
    return rows.join(before, [group, "share"]).withColumn("rank", F.col("first") + F.col("inside")).drop("share", "first", "inside")


_ORDER = ["doc_id", "start", "ids_crc32"]


def pack(documents: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    spark = documents.sparkSession
    cut = stored(pieces(documents, path, length, end), "pieces")
    bins = length // BIN
    cut = cut.withColumn("bin", F.ceil(F.col("length") / BIN).cast("int") - 1)
    sizes = {r["bin"]: r["n"] for r in cut.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # one row a bin
    demand = np.array([sizes.get(b, 0) for b in range(bins)])
    plan = CuttingStock(demand, bins, list(range(CUT_EVERY // BIN, bins, CUT_EVERY // BIN)))

    cut_rows = [(b, p * BIN, int(t)) for (b, p), t in plan.cuts.items()]
    chosen, first = [], {}
    for whole, point, times in cut_rows:
        begin = first.get(whole, 0)
        chosen.append((whole, begin, begin + times, point))
        first[whole] = begin + times
    number = int(demand.sum())
    if chosen:
        ranked = _ranked(cut, "bin", _ORDER, number)
        table = spark.createDataFrame(chosen, "bin int, low bigint, high bigint, point int")  # bins x cut points
        where = (ranked["bin"] == table["bin"]) & (ranked["rank"] >= table["low"]) & (ranked["rank"] < table["high"])
        halves = ranked.join(F.broadcast(table), where, "left").drop(table["bin"])
        whole = F.struct("start", "length", "ids_crc32")
        at = (F.col("point") / CUT_EVERY).cast("int")
        head = F.struct(F.col("start"), F.col("point").cast("bigint").alias("length"), F.element_at("heads", at).alias("ids_crc32"))
        tail = F.struct((F.col("start") + F.col("point")).alias("start"), (F.col("length") - F.col("point")).alias("length"), F.element_at("tails", at).alias("ids_crc32"))
        parts = F.when(F.col("point").isNull(), F.array(whole)).otherwise(F.array(head, tail))
        cut = halves.select("doc_id", "doc_tokens", F.inline(parts))
        cut = cut.withColumn("bin", F.ceil(F.col("length") / BIN).cast("int") - 1)
        number += sum(t for _, _, t in cut_rows)
    ranked = _ranked(cut.drop("heads", "tails"), "bin", _ORDER, number)

    # Places: per bin, consecutive rank ranges of the patterns that hold it.
    places, sequence = [], 0
    taken = np.zeros(bins, np.int64)
    for pattern, times in plan.patterns:
        for b in np.flatnonzero(pattern):
            much = int(pattern[b])
            places.append((int(b), int(taken[b]), int(taken[b]) + much * times, sequence, much))
            taken[b] += much * times
        sequence += times
    table = spark.createDataFrame(places, "bin int, low bigint, high bigint, base bigint, much bigint")
    by_bin = table.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("low", "high", "base", "much"))).alias("places"))
    placed = ranked.join(F.broadcast(by_bin), "bin")  # patterns x bins, whatever the corpus
    fit = F.filter("places", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["high"]))[0]
    placed = placed.withColumn("place", fit)
    placed = placed.withColumn("sequence_id", F.expr("place.base + (rank - place.low) div place.much"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
