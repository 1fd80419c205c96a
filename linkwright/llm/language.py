"""Language identification by unigrams over all segmentations of a word.

A fixed public vocabulary gives the pieces.  A language is a probability per piece; a word's probability
is the sum, over every way to cut it into pieces, of the product of their probabilities (forward
algorithm).  Piece probabilities are the expected piece counts of a language's words when all
segmentations start out with equally likely pieces (one expectation step, forward-backward), smoothed.

Only runs of letters count, lower-cased, each opened by the vocabulary's word mark, so digits, markup and
spacing say nothing.  A run is one word however long: beyond `LONG` letters the sums are carried as logarithms, so
nothing underflows, at a cost that stays proportional to the length.  A character that no piece spells costs
`UNKNOWN` in every language.  Equal scores go to the first language in order.

The model is as large as vocabulary times languages, whatever the corpus; each task adds up its own counts
before the shuffle.  A null text, or one without letters, is `und` with score 0; so is every text when there
is nothing to learn from.  Repeated rows are answered one by one; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.llm.common import fold, importable

LONG = 24
SMOOTHING = 0.1
UNKNOWN = 1e-9
UNDECIDED = "und"
MARK = "▁"  # opens a word in the vocabulary
CACHED_WORDS = 500_000
_HASH_TIMES = np.uint64(0x9E3779B97F4A7C15)
_HASH_BITS = 18
_HASH_SHIFT = np.uint64(64 - _HASH_BITS)
_known: dict[str, tuple[dict[str, int], np.ndarray]] = {}  # of this Python worker, for the model used last
SETTLED = 2_000_000  # characters between looks at the size of the counts
_RUNS = re.compile(r"[^\W\d_]+")  # letters, and a few numerals that are dropped afterwards
TOGETHER = 512  # documents whose new words are looked up at once


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def letter_words(text: str) -> Counter:
    """How often each lower-cased run of letters stands in a text."""
    words = Counter(_RUNS.findall(text.lower()))
    for run in [w for w in words if not w.isalpha()]:
        times, letters = words.pop(run), "".join(filter(str.isalpha, run))
        if letters:
            words[letters] += times
    return words


class Pieces:
    """The vocabulary's pieces and, for words of one length, the pieces at each place."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        skip = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(names))]
        self.ids = {p: i for i, (p, s) in enumerate(zip(names, skip)) if not s}
        self.size = len(names)
        self.longest = max(map(len, self.ids))
        # Pieces by a hash of their characters, in tables that are tried one after the other.
        hashes = {i: self._hash(p) for p, i in self.ids.items()}
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        while hashes:
            times = np.uint64((2 * len(self.tables) + 1) * 0xBF58476D1CE4E5B9 % 2**64)
            keys, values, left = np.zeros(1 << _HASH_BITS, np.uint64), np.full(1 << _HASH_BITS, -1, np.int64), {}
            for i, h in hashes.items():
                slot = int((np.array([h]) * times >> _HASH_SHIFT)[0])
                if values[slot] < 0:
                    keys[slot], values[slot] = h, i
                else:
                    left[i] = h
            self.tables.append((times, keys, values))
            hashes = left

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        code = np.zeros(1, np.uint64)
        for c in piece:
            code = (code + np.uint64(ord(c) + 1)) * _HASH_TIMES
        return code[0]

    def _find(self, hashes: np.ndarray, missing: int) -> np.ndarray:
        out = np.full(len(hashes), missing, np.int64)
        for times, keys, values in self.tables:
            slots = (hashes * times) >> _HASH_SHIFT
            hit = (keys[slots] == hashes) & (values[slots] >= 0)
            out[hit] = values[slots[hit]]
        return out

    def lattice(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, piece of each word there; `size` where there is none) by end; single unknown
        characters get the piece `size + 1`."""
        none, unknown = self.size, self.size + 1
        letters = np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1).T.astype(np.uint64) + np.uint64(1)
        begun: list[np.ndarray] = []  # hash from each start to here
        for end in range(1, len(words[0]) + 1):
            begun.append(np.zeros(len(words), np.uint64))
            for start in range(max(0, end - self.longest), end):
                code = begun[start]
                code += letters[end - 1]
                code *= _HASH_TIMES
                found = self._find(code, unknown if end - start == 1 else none)
                if end - start == 1 or (found != none).any():
                    yield start, end, found

    def _long_lattice(self, word: str) -> np.ndarray:
        """(length of a piece less one, start) -> piece, as in `lattice`."""
        letters = np.array([word]).view(np.uint32).astype(np.uint64) + np.uint64(1)
        found = np.full((min(self.longest, len(word)), len(word)), self.size, np.int64)
        code = np.zeros(len(word), np.uint64)
        for k in range(len(found)):
            code = (code[: len(word) - k] + letters[k:]) * _HASH_TIMES
            found[k, : len(code)] = self._find(code, self.size if k else self.size + 1)
        return found

    @staticmethod
    def _log_forward(found: np.ndarray, chances: np.ndarray) -> np.ndarray:
        """(place, language): log of the sum over all segmentations up to each place."""
        out = np.zeros((found.shape[1] + 1, chances.shape[1]))
        for end in range(1, len(out)):
            lengths = np.arange(min(len(found), end))
            starts = end - 1 - lengths
            out[end] = out[end - 1] + np.log((np.exp(out[starts] - out[end - 1]) * chances[found[lengths, starts]]).sum(0))
        return out

    def _expected_long(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(piece, expected count) of one long word."""
        found, n = self._long_lattice(word), len(word)
        chances = np.full((self.size + 2, 1), 1.0 / self.size)
        chances[self.size], chances[self.size + 1] = 0.0, UNKNOWN
        before = self._log_forward(found, chances)[:, 0]
        turned = np.full_like(found, self.size)  # by where a piece ends, from the end
        for k in range(len(found)):
            turned[k, : n - k] = found[k, : n - k][::-1]
        behind = self._log_forward(turned, chances)[::-1, 0]
        lengths, starts = np.nonzero(found < self.size)
        share = np.exp(before[starts] + behind[starts + lengths + 1] - before[n] - np.log(self.size))
        return found[lengths, starts], share

    def expected(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the word, piece, expected count) with all pieces equally likely: forward-backward."""
        if len(words[0]) > LONG + 1:
            each = [self._expected_long(w) for w in words]
            who = np.repeat(np.arange(len(words)), [len(p) for p, _ in each])
            return who, np.concatenate([p for p, _ in each]), np.concatenate([m for _, m in each])
        wide = [(s, e, p, p < self.size) for s, e, p in self.lattice(words)]
        base = 1.0 / self.size
        # scaled so that a word cut into single characters keeps weight one per character
        weight = {True: base}
        n, m = len(words[0]), len(words)
        forward, backward = np.zeros((n + 1, m)), np.zeros((n + 1, m))
        forward[0], backward[n] = 1.0, 1.0
        each = [np.where(ok, weight[True], UNKNOWN * (e - s == 1)) for s, e, _, ok in wide]
        for (s, e, _, _), w in zip(wide, each):
            forward[e] += forward[s] * w
        for (s, e, _, _), w in zip(reversed(wide), reversed(each)):
            backward[s] += backward[e] * w
        total = forward[n]
        who, what, much = [], [], []
        for (s, e, p, ok), w in zip(wide, each):
            share = forward[s] * w * backward[e] / total
            at = np.flatnonzero(ok)
            who.append(at)
            what.append(p[at])
            much.append(share[at])
        return np.concatenate(who), np.concatenate(what), np.concatenate(much)

    def log_probabilities(self, words: list[str], chances: np.ndarray) -> np.ndarray:
        """(words, languages): log of the sum over all segmentations."""
        n = len(words[0])
        if n > LONG + 1:
            return np.stack([self._log_forward(self._long_lattice(w), chances)[-1] for w in words])
        forward = np.zeros((n + 1, len(words), chances.shape[1]))
        forward[0] = 1.0
        for start, end, pieces in self.lattice(words):
            forward[end] += forward[start] * chances[pieces]
        return np.log(forward[n])


def _by_length(words: list[str]) -> Iterator[list[str]]:
    """Words of one length together, a bounded number at a time."""
    groups = defaultdict(list)
    for word in words:
        groups[len(word)].append(word)
    for group in groups.values():
        for i in range(0, len(group), 4096):
            yield group[i : i + 4096]


def learn(documents: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities (vocabulary + 2, languages) from text and lang.

    Only rows with both take part.  Two last rows: no piece (0) and an unknown character.
    """
    path = path or vocabulary_path()
    importable(documents.sparkSession)
    rows = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = defaultdict(Counter)

        def settle() -> None:
            for lang, words in seen.items():
                total = totals.setdefault(lang, np.zeros(pieces.size))
                for group in _by_length(list(words)):
                    times = np.fromiter((words[w] for w in group), np.float64, len(group))
                    who, what, much = pieces.expected([MARK + w for w in group])
                    total += np.bincount(what, much * times[who], pieces.size)
            seen.clear()

        size = 0
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                seen[lang].update(letter_words(text))
                size += len(text)
                if size > SETTLED and sum(map(len, seen.values())) > CACHED_WORDS:
                    settle()
                    size = 0
        settle()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            # whole thousandths add up alike in any order
            much = np.maximum(1, np.rint(total[at] * 1000)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(much, pa.int64())],
                names=["lang", "piece", "much"],
            )

    counted = rows.mapInArrow(count, "lang string, piece int, much bigint").groupBy("lang", "piece").agg(F.sum("much").alias("much"))
    found = counted.toPandas()  # at most vocabulary times languages
    languages = sorted(found["lang"].unique())
    size = Pieces(path).size
    chances = np.full((size + 2, len(languages)), SMOOTHING)
    index = {lang: i for i, lang in enumerate(languages)}
    chances[found["piece"].to_numpy(), found["lang"].map(index).to_numpy(dtype=np.int64)] += found["much"].to_numpy() / 1000
    chances /= chances[:size].sum(axis=0, keepdims=True) if languages else 1.0
    chances[size], chances[size + 1] = 0.0, UNKNOWN
    return languages, chances


def identify(
    documents: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str] | None = None, path: str | None = None
) -> DataFrame:
    """Every input column (or those of `carry`) inside `in`, with lang_pred and score."""
    path = path or vocabulary_path()
    importable(documents.sparkSession)
    kept = documents.columns if carry is None else carry
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("in"), F.col("text").cast("string").alias("text")
    )
    shipped, mark = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, chances = shipped.value
        pieces = Pieces(path)
        if mark not in _known:  # later tasks of the worker find the words known
            _known.clear()
            _known[mark] = {}, np.zeros((CACHED_WORDS, len(languages)))
        known, scores = _known[mark]

        def judge(texts: list[str | None]) -> Iterator[tuple[str, float]]:
            counted = [letter_words(t) if t and languages else None for t in texts]
            fresh = {w for words in counted if words for w in words if w not in known}
            if len(known) + len(fresh) > CACHED_WORDS:
                known.clear()
                fresh = {w for words in counted if words for w in words}
            extra: list[np.ndarray] = []  # texts with more new words than the cache holds
            for group in _by_length(sorted(fresh)):
                logs = pieces.log_probabilities([MARK + w for w in group], chances)
                at = len(known)
                known.update(zip(group, range(at, at + len(group))))
                room = max(0, min(len(group), CACHED_WORDS - at))
                scores[at : at + room] = logs[:room]
                if room < len(group):
                    extra.append(logs[room:])
            table = np.concatenate([scores, *extra]) if extra else scores
            spoken = [words for words in counted if words]
            if spoken:
                at = np.fromiter(chain.from_iterable(map(map, repeat(known.__getitem__), spoken)), np.int64)
                times = np.fromiter(chain.from_iterable(w.values() for w in spoken), np.float64, len(at))
                begins = np.cumsum([0] + [len(w) for w in spoken[:-1]])
                total = np.add.reduceat(times[:, None] * table[at], begins)
                best = total.argmax(1)
                sure = np.round(1.0 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(1), 6)
                found = zip((languages[i] for i in best), sure.tolist())
            for words in counted:
                yield next(found) if words else (UNDECIDED, 0.0)
            if extra:
                known.clear()

        for batch in batches:
            texts = batch.column("text").to_pylist()
            judged = [x for low in range(0, len(texts), TOGETHER) for x in judge(texts[low : low + TOGETHER])]
            names, values = zip(*judged) if judged else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("in"), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                names=["in", "lang_pred", "score"],
            )

    schema = T.StructType([rows.schema["in"]]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(predict, schema)


def training_part(documents: DataFrame) -> DataFrame:
    return documents.filter(~fold(F.col("doc_id"), 4, 2))


def report(documents: DataFrame) -> DataFrame:
    """One row per document; learns from all documents that are not held out."""
    found = identify(documents, learn(training_part(documents)), ["doc_id"])
    doc_id = F.col("in.doc_id")
    return found.select(doc_id.alias("doc_id"), fold(doc_id, 4, 2).alias("held_out"), "lang_pred", "score")
