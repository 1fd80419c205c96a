"""Alignment of two tokenizers: which tokens of one end where tokens of the other end.

Tokenizer A is a byte-level BPE, tokenizer B a piece BPE with byte fallback; both see a space and the text.  A
text is aligned when the bytes of its tokens are the same on both sides and those of the text; otherwise, and when
it is null or empty, it has no tokens.

1. Texts are cut into words where neither tokenizer ever joins (a space after a non-space), so that the ids and
   byte lengths of frequent words are kept between texts.
2. The ends of all tokens of a batch of documents lie on one line of bytes.  One state vector holds a pointer into
   A and one into B for every document; each step compares all pairs of ends, emits a link where both are equal,
   advances the side that lags (both at a link), and drops finished documents.  A document of more than `LANE`
   tokens takes several places of the vector, each with its own stretch of bytes, so a batch needs at most
   2 x `LANE` steps however long a text is.
3. Linked id pairs are counted over the corpus: each task adds its own up, Spark adds up the tasks.

The shorter token of a linked pair is a suffix of the longer one, so the number of different pairs is bounded by
the two vocabularies (the suffixes of one's tokens that the other holds: fewer than 400,000 here), whatever the
corpus.  That bound is why their counts may be sent to every task.

Every row is a document for itself, repeated rows and rows without doc_id included; ties for the highest count of a
B id are all best; texts are aligned whole, however long; further columns are not read.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.llm import packing
from linkwright.llm.common import importable, stored

LANE = 4096
TOGETHER = 256  # documents aligned at once
CACHED_WORDS = 400_000
SETTLED = 4_000_000  # links kept in a task before they are added up


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each token of a byte-level vocabulary: one character of its entry stands for one byte."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    added = model.get_added_tokens_decoder()
    out = np.zeros(model.get_vocab_size(), np.int64)
    for token, i in model.get_vocab().items():
        out[i] = len(token.encode()) if i in added else len(token)
    return out


class PieceEncoder:
    """Ids of a piece vocabulary by words, with a mark for words whose tokens do not give their bytes back."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i)
            else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        # words may be encoded on their own only where no piece goes on after a space
        self.by_word = not any(" " in b.lstrip(b" ").decode(errors="ignore") for b in self.bytes)
        self.known: dict[str, bytes | None] = {}  # a word without its space -> ids with it, None if not its bytes

    def _learn(self, words: list[str]) -> None:
        for word, ids in zip(words, self.model.encode(words, num_threads=1) if words else []):
            if not word:  # a single space, for which the model adds none
                ids = [self.model.piece_to_id("▁")]
            same = b"".join(map(self.bytes.__getitem__, ids)) == b" " + word.encode()
            self.known[word] = np.array(ids, "<u4").tobytes() if same else None

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Of a space and each text; None where the tokens differ from it."""
        parts = [packing._words(" " + t) if self.by_word else ["", t] for t in texts]
        # the space that opens a text is either a word's own or part of more spaces
        parts = [p[1:] if not p[0] else [p[0][1:], *p[1:]] for p in parts]
        fresh = set(filterfalse(self.known.__contains__, chain.from_iterable(parts)))
        if len(self.known) + len(fresh) > CACHED_WORDS:
            used = set(chain.from_iterable(parts))
            self.known = {w: ids for w, ids in self.known.items() if w in used}
        self._learn(sorted(fresh))
        out: list[bytes | None] = []
        for words in parts:
            ids = list(map(self.known.__getitem__, words))
            out.append(None if None in ids else b"".join(ids))  # type: ignore[arg-type]
        return out


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of the tokens that end together, in order.

    `ends_a` and `ends_b` rise; a row of `lanes` is (first in A, first in B, behind the last in A, behind the last
    in B) of a stretch that both sides cover alike.
    """
    at_a, at_b, stop_a, stop_b = (np.ascontiguousarray(c) for c in lanes.T)
    alive = (at_a < stop_a) & (at_b < stop_b)
    links_a, links_b = [at_a[:0]], [at_b[:0]]
    while True:
        if not alive.all():  # finished stretches leave the vector
            at_a, at_b, stop_a, stop_b = at_a[alive], at_b[alive], stop_a[alive], stop_b[alive]
        if not len(at_a):
            break
        a, b = ends_a[at_a], ends_b[at_b]
        both = a == b
        links_a.append(at_a[both])
        links_b.append(at_b[both])
        at_a = at_a + (a <= b)
        at_b = at_b + (b <= a)
        alive = (at_a < stop_a) & (at_b < stop_b)
    found = np.sort(np.concatenate(links_a))
    return found, np.sort(np.concatenate(links_b))


class Batch:
    """Aligned documents: ids of all tokens, where each document begins, and the linked positions."""

    def __init__(self, ids_a: list[bytes], ids_b: list[bytes], lengths_a: np.ndarray, lengths_b: np.ndarray) -> None:
        self.a = np.frombuffer(b"".join(ids_a), "<u4").astype(np.int64)
        self.b = np.frombuffer(b"".join(ids_b), "<u4").astype(np.int64)
        self.first_a = np.cumsum([0] + [len(x) // 4 for x in ids_a])
        self.first_b = np.cumsum([0] + [len(x) // 4 for x in ids_b])
        ends_a, ends_b = lengths_a[self.a].cumsum(), lengths_b[self.b].cumsum()
        self.link_a, self.link_b = lockstep(ends_a, ends_b, self._lanes(ends_a, ends_b))
        # the document of each link, and where each document's links begin
        self.first_link = np.searchsorted(self.link_a, self.first_a)

    def _lanes(self, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
        starts = [np.arange(low, max(high, low + 1), LANE) for low, high in zip(self.first_a, self.first_a[1:])]
        low_a = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        opens = np.isin(low_a, self.first_a[:-1])
        before = np.where(low_a > 0, ends_a[low_a - 1], 0) if len(ends_a) else np.zeros(len(low_a), np.int64)
        # B tokens that end behind a stretch's first byte belong to it
        low_b = np.searchsorted(ends_b, before, "right")
        at = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        low_b = np.where(opens, self.first_b[:-1][at], low_b)
        high_a = np.where(np.append(opens[1:], True), self.first_a[1:][at], np.append(low_a[1:], 0))
        high_b = np.where(np.append(opens[1:], True), self.first_b[1:][at], np.append(low_b[1:], 0))
        return np.stack([low_a, low_b, high_a, high_b], 1)

    def keys(self) -> np.ndarray:
        """The linked id pairs as numbers."""
        return (self.a[self.link_a] << 32) | self.b[self.link_b]

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document: the ids between cuts."""
        if not len(self.a):
            return [b""] * (len(self.first_a) - 1)
        rank_a, rank_b = np.arange(len(self.a)), np.arange(len(self.b))
        group_a = np.searchsorted(self.link_a, rank_a)  # a cut closes the group of its token
        group_b = np.searchsorted(self.link_b, rank_b)
        behind = np.append(-1, self.link_b)[group_a] + 1  # B tokens of earlier groups
        place_a, place_b = rank_a + behind, rank_b + self.link_a[group_b] + 1
        digits = np.zeros((len(self.a) + len(self.b), _WIDTH + 1), np.uint8)
        text = _digits(int(max(self.a.max(), self.b.max())) + 1)
        digits[place_a, :_WIDTH], digits[place_b, :_WIDTH] = text[self.a], text[self.b]
        digits[:, _WIDTH] = ord(",")
        digits[place_a[self.link_a], _WIDTH] = ord("|")
        digits[place_b[self.link_b], _WIDTH] = ord(";")
        begins = self.first_a + self.first_b
        last = begins[1:][np.diff(begins) > 0] - 1
        digits[last, _WIDTH] = 0  # nothing follows a document's last group
        lengths = np.append(0, (digits != 0).sum(1).cumsum())
        flat = digits.ravel()
        flat = flat[flat != 0].tobytes()
        return [flat[lengths[i] : lengths[j]] for i, j in zip(begins, begins[1:])]


_WIDTH = 6
_tables: dict[int, np.ndarray] = {}


def _digits(size: int) -> np.ndarray:
    """Decimal digits of the numbers below a power of two from `size`, zero bytes behind them."""
    size = 1 << (size - 1).bit_length() if size > 1 else 2
    if size not in _tables:
        if size > 10**_WIDTH:
            raise ValueError(f"vocabularies of more than {10**_WIDTH} ids are not supported")
        _tables[size] = np.arange(size).astype(f"S{_WIDTH}").view(np.uint8).reshape(size, _WIDTH)
    return _tables[size]


class Aligner:
    """Both tokenizers, with what their words gave before."""

    def __init__(self, path: str, ranks: str, pieces: str) -> None:
        self.a, self.b = packing.Encoder(path, ranks, plain=True), PieceEncoder(pieces)
        self.lengths = byte_lengths(path), self.b.lengths

    def align(self, texts: list[str | None]) -> Batch:
        """Documents without tokens hold none."""
        whole = [i for i, t in enumerate(texts) if t]
        ids_a, ids_b = [b""] * len(texts), [b""] * len(texts)
        pieces = self.b.encode([texts[i] for i in whole])  # type: ignore[misc]
        fine = [(i, p) for i, p in zip(whole, pieces) if p is not None]
        for (i, p), ids in zip(fine, self.a.encode([" " + texts[i] for i, _ in fine])):  # type: ignore[operator]
            ids_a[i], ids_b[i] = ids, p
        return Batch(ids_a, ids_b, *self.lengths)


_aligners: dict[tuple[str, str, str], Aligner] = {}  # of this Python worker; later tasks find the words known


def _paths(path: str | None, ranks: str | None, pieces: str | None) -> tuple[str, str, str]:
    return path or packing.tokenizer_path(), ranks or packing.ranks_path(), pieces or pieces_path()


def _aligner(paths: tuple[str, str, str]) -> Aligner:
    return _aligners.get(paths) or _aligners.setdefault(paths, Aligner(*paths))


def _spread(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def align(documents: DataFrame, path: str | None = None, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """Every input column inside `in`, with a_ids, b_ids, and a_cuts, b_cuts: for each group the number of A and of
    B tokens up to its end.  The last tokens before a cut are linked."""
    importable(documents.sparkSession)
    paths = _paths(path, ranks, pieces)
    rows = documents.select(F.struct("*").alias("in"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), TOGETHER):
                part = batch.slice(low, TOGETHER)
                found = _aligner(paths).align(part.column("text").to_pylist())
                many = np.diff(found.first_link)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("in"), _spread(found.first_a, found.a, pa.int32()), _spread(found.first_b, found.b, pa.int32()),
                        _spread(found.first_link, found.link_a + 1 - np.repeat(found.first_a[:-1], many), pa.int32()),
                        _spread(found.first_link, found.link_b + 1 - np.repeat(found.first_b[:-1], many), pa.int32()),
                    ],
                    names=["in", "a_ids", "b_ids", "a_cuts", "b_cuts"],
                )

    schema = T.StructType([rows.schema["in"]])
    for name in ("a_ids", "b_ids", "a_cuts", "b_cuts"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


_DIGEST = (
    "doc_id bigint, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>, total boolean"
)


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, back, np.concatenate(times))
    return distinct, sums


def digests(documents: DataFrame, path: str | None = None, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """A row per document: numbers of tokens and links, checksum of the groups, linked pairs with how often; and
    rows marked `total` that add up the pairs of a task's documents."""
    importable(documents.sparkSession)
    paths = _paths(path, ranks, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for low in range(0, len(batch), TOGETHER):
                part = batch.slice(low, TOGETHER)
                found = _aligner(paths).align(part.column("text").to_pylist())
                many = np.diff(found.first_link)
                document = np.repeat(np.arange(len(part)), many)
                order = np.lexsort((found.keys(), document))
                own, document = found.keys()[order], document[order]
                first = np.ones(len(own), bool)
                first[1:] = (own[1:] != own[:-1]) | (document[1:] != document[:-1])
                at = np.flatnonzero(first)
                often = np.diff(np.append(at, len(own)))
                begins = np.searchsorted(document[at], np.arange(len(part) + 1))
                shas = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(np.diff(found.first_a)), pa.array(np.diff(found.first_b)), pa.array(many),
                        pa.array(shas, pa.string()), _spread(begins, own[at], pa.int64()), _spread(begins, often, pa.int64()),
                        pa.array([False] * len(part), pa.bool_()),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_links", "groups_sha256", "pairs", "times", "total"],
                )
                keys.append(own[at])
                times.append(often)
                held += len(at)
                if held > SETTLED:
                    (one, other), held = _summed(keys, times), 0
                    keys, times = [one], [other]
        one, other = _summed(keys, times)
        for low in range(0, len(one), 50_000):
            high = min(low + 50_000, len(one))
            span = np.array([0, high - low])
            zero = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [zero, zero, zero, zero, pa.array([None], pa.string()), _spread(span, one[low:high], pa.int64()),
                 _spread(span, other[low:high], pa.int64()), pa.array([True], pa.bool_())],
                names=["doc_id", "n_a", "n_b", "n_links", "groups_sha256", "pairs", "times", "total"],
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _DIGEST)


def pair_counts(digested: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold an id pair; one row per pair that occurs."""
    each = digested.filter("total").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    return each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))


def report(documents: DataFrame) -> DataFrame:
    """One row per document with counts and checksums; how often pairs are linked is counted over all documents."""
    digested = stored(digests(documents), "alignment")
    counts = pair_counts(digested).toPandas().sort_values("pair")  # bounded by the vocabularies, see above
    pair, n = counts["pair"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    _, owner = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
    most = np.zeros(len(pair), np.int64)
    np.maximum.at(most, owner, n)
    shipped = documents.sparkSession.sparkContext.broadcast((pair, n, n == most[owner]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, top = shipped.value
        for batch in batches:
            links, times = batch.column("pairs"), batch.column("times")
            where = np.searchsorted(pair, links.flatten().to_numpy())
            often = times.flatten().to_numpy()
            document = np.repeat(np.arange(len(batch)), links.value_lengths().to_numpy())
            best, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(best, document, often * top[where])
            np.add.at(total, document, often * n[where])
            own = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_links", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(best), pa.array(total), batch.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    numbers = ", ".join(f"{c} bigint" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return digested.filter("not total").mapInArrow(judge, numbers + ", groups_sha256 string")
