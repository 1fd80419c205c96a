"""The quality classifier: trees against row-by-row versions, held-out accuracy, hard rows."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from linkwright.llm import quality


def test_trees_walk_like_single_rows():
    rng = np.random.default_rng(0)
    rows = rng.random((800, 6)).astype(np.float32)
    labels = ((rows[:, 1] > 0.5) ^ (rows[:, 4] > 0.3)).astype(float)
    model = quality.boost(rows, labels, trees=12, depth=3)
    assert ((model.scores(rows) > 0.5) == labels).mean() > 0.97

    def score(row):
        total = model.start
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(model.scores(rows[:100]), [score(r) for r in rows[:100]])


def test_splits_are_the_best_ones():
    rng = np.random.default_rng(1)
    binned = rng.integers(0, 5, (300, 3))
    node, slope, curve = rng.integers(0, 2, 300), rng.standard_normal(300), rng.random(300)
    which, where, gain = quality.best_splits(binned, node, 2, slope, curve, [4, 4, 4], 5)

    def worth(rows):
        return slope[rows].sum() ** 2 / (curve[rows].sum() + quality.RIDGE)

    for k in range(2):
        own = node == k
        offers = {}
        for j in range(3):
            for b in range(4):
                low, high = own & (binned[:, j] <= b), own & (binned[:, j] > b)
                if min(curve[low].sum(), curve[high].sum()) >= quality.LEAST:
                    offers[j, b] = worth(low) + worth(high) - worth(own)
        assert math.isclose(gain[k], max(offers.values())) and math.isclose(offers[which[k], where[k]], gain[k])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.report(documents, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.95
    # nothing but the text decides, and held-out labels teach nothing
    other = documents.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    upset = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, r.score) for r in quality.report(other, upset).collect()} == {(r.doc_id, r.score) for r in rows}


def test_hard_rows(spark, documents, rows, nothing):
    labels = [(r.doc_id, len(r.text or "") % 2) for r in rows[:150]] + [(None, 1), (1, None), (2, 5), (3, 0), (3, 1), (4, 1), (4, 1)]
    marks = spark.createDataFrame([(*x, "e") for x in labels], "doc_id bigint, quality int, score string")
    crowded = documents.withColumn("score", F.lit("x")).withColumn("statistics", F.lit(0))
    got = quality.report(crowded, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in {x.doc_id for x in rows if not x.text}}) == 1
    assert quality.report(nothing, marks).collect() == []
    assert {r.score for r in quality.report(documents, marks.limit(0)).collect()} == {0.5}
    alone = quality.report(documents, marks.withColumn("quality", F.lit(1))).collect()
    assert len({r.score for r in alone}) == 1 and alone[0].score > 0.9
    lost = spark.createDataFrame([(None, "some text"), (5, "x" * 300_000)], "doc_id bigint, text string")
    assert [r.held_out for r in quality.report(lost, marks).collect() if r.doc_id is None] == [False]


def test_statistics(spark):
    def of(text):
        return dict(zip(quality.NAMES, quality.statistics_of(text.encode())))

    assert set(of("").values()) == {0.0} and len(of(" \n")) == len(quality.NAMES)
    found = of("AB cd, cd ef!\nab cd\n\nab cd")
    assert found["log_words"] == math.log1p(8) and found["log_lines"] == math.log1p(3)
    assert found["top_word"] == 3 / 8 and found["shouted"] == 1 / 8 and found["marked_end"] == 2 / 8
    assert found["distinct_lines"] == 2 / 3 and found["newlines"] == 3 / 26 and found["closed_lines"] == 1 / 3
    assert of("a | b |")["wordless"] == 1 / 2 and of("x x x y")["repeated_next"] == 2 / 4
    whole = quality.statistics(spark.createDataFrame([(1, "a b", 3)], "doc_id bigint, text string, statistics int")).first()
    assert whole["in"].statistics == 3 and len(whole.statistics) == len(quality.NAMES)
