"""Tokenizer alignment beside a plain version that encodes whole texts and compares sets of ends."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from linkwright.llm import alignment, packing


@pytest.fixture(scope="module")
def plain():
    """text -> (A tokens, B tokens) as (id, end) pairs, from the whole text; empty where the bytes differ."""
    a = Tokenizer.from_file(packing.tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.pieces_path())
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_byte = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(of_byte[c] for c in a.id_to_token(i))) for i in ids]
        right = [
            (i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
            for i in b.encode(text) for p in [b.id_to_piece(i)]
        ]
        whole = (" " + text).encode()
        if not b"".join(x for _, x in left) == whole == b"".join(x for _, x in right):
            return [], []
        out = []
        for side in (left, right):
            ends, at = [], 0
            for i, data in side:
                at += len(data)
                ends.append((i, at))
            out.append(ends)
        return tuple(out)

    return tokens


def expected(rows, plain):
    per_row, counts = [], Counter()
    for row in rows:
        a, b = plain(row.text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(([i for i, e in a if low < e <= cut], [i for i, e in b if low < e <= cut]))
            low = cut
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        per_row.append((row.doc_id, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = Counter()
    for doc_id, n_a, n_b, groups, links in per_row:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        top = sum(counts[link] == best[link[1]] for link in links)
        out[doc_id, n_a, n_b, len(groups), len(links), top, sum(counts[x] for x in links), brute.sha(text) if text else ""] += 1
    return out


def test_alignment(documents, rows, nothing, plain):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = alignment.report(documents)
    assert found.columns == names
    assert Counter(map(tuple, found.collect())) == expected(rows, plain)
    assert alignment.report(nothing).collect() == []


def test_hard_texts(spark, plain):
    rnd = random.Random(5)
    signs = ["a", " ", "  ", "\n", "\t", "é", "😀", "▁", "’s", "don't", "<unk>", "</s>", "<0x41>", "<|endoftext|>", "　", "​", "1234", "\r\n", "word", "x" * 40]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(1, 12))) for _ in range(300)] + [None, "", " ", "▁", "a▁b", "  x", "x  ", "\x00", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, "twice"), (0, "twice")], "doc_id bigint, text string")
    got = Counter(map(tuple, alignment.report(docs.withColumn("pairs", F.lit(1)).withColumn("in", F.lit(2))).collect()))
    assert got == expected(docs.collect(), plain)
    assert sum(n for r, n in got.items() if r[1] == 0) >= 4  # null, empty and marks of the piece vocabulary have no tokens


def test_real_outputs(spark, plain):
    text = "Unbelievable naïve tokenisations, 12345 and\nmore.  "
    docs = spark.createDataFrame([(1, text, 7), (2, None, 8)], "doc_id bigint, text string, a_ids int")
    got = {r["in"].doc_id: r for r in alignment.align(docs).collect()}
    a, b = plain(text)
    assert got[1].a_ids == [i for i, _ in a] and got[1].b_ids == [i for i, _ in b] and got[1]["in"].a_ids == 7
    ends = {e: k + 1 for k, (_, e) in enumerate(b)}
    assert list(zip(got[1].a_cuts, got[1].b_cuts)) == [(k + 1, ends[e]) for k, (_, e) in enumerate(a) if e in ends]
    assert got[2].a_ids == got[2].b_cuts == []


def test_long_texts_take_several_lanes(spark, plain, monkeypatch):
    rnd = random.Random(2)
    text = " ".join(rnd.choice(["alpha", "beta-gamma", "δέλτα", "x1y2", "\n"]) for _ in range(30_000))
    one = alignment.Aligner(*alignment._paths(None, None, None))
    found = one.align(["short", text, "", "end"])
    a, b = plain(text)
    shared = {e for _, e in a} & {e for _, e in b}
    assert np.diff(found.first_link)[1] == len(shared) and len(a) > 5 * alignment.LANE
    monkeypatch.setattr(alignment, "LANE", 7)
    again = one.align(["short", text, "", "end"])
    assert (again.link_a == found.link_a).all() and (again.link_b == found.link_b).all()
    assert again.groups() == found.groups()


def test_pairs_are_bounded_by_the_vocabularies():
    """The bound the module names: suffixes of one vocabulary's tokens that the other holds."""
    one = alignment.Aligner(*alignment._paths(None, None, None))
    model = Tokenizer.from_file(packing.tokenizer_path())
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_byte = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    left = [bytes(of_byte[c] for c in t) for t in model.get_vocab() if set(t) <= of_byte.keys()]
    right = Counter(b for b in one.b.bytes if b)
    held = set(left)
    pairs = sum(right.get(t[k:], 0) for t in left for k in range(len(t)))
    pairs += sum(n for t, n in right.items() for k in range(1, len(t)) if t[k:] in held)
    assert pairs < 400_000
