import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from linkwright.functions.scalars import bin_of, even_edges
from linkwright.operators import evaluation, profiling
from linkwright.operators.ordering import numbered, running_totals


def labelled(spark, rows):
    return spark.createDataFrame(rows, "label int, match_probability double")


def auc(rows):
    ones, zeros = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_with_ties(spark, digits):
    rng = random.Random(digits)
    rows = [(int(rng.random() < 0.4), round(rng.random(), digits)) for _ in range(300)]
    assert math.isclose(evaluation.roc_auc(labelled(spark, rows)).first()[0], auc(rows), abs_tol=1e-12)


def test_auc_of_constant_and_of_one_class(spark):
    assert evaluation.roc_auc(labelled(spark, [(1, 0.5), (0, 0.5), (0, 0.5)])).first()[0] == 0.5
    assert evaluation.roc_auc(labelled(spark, [(1, 0.5), (1, 0.7)])).first()[0] is None


def test_log_loss_at_the_ends(spark):
    right = evaluation.log_loss(labelled(spark, [(1, 1.0), (1, 0.5)])).first()[0]
    assert math.isclose(right, math.log(2))
    assert evaluation.log_loss(labelled(spark, [(0, 1.0), (1, 0.5)])).first()[0] == math.inf
    assert evaluation.log_loss(labelled(spark, [(1, 0.0)])).first()[0] == math.inf
    assert evaluation.log_loss(labelled(spark, [(0, 1.0)]), eps=1e-6).first()[0] < 20


def test_bins(spark):
    """Edges are multiples of 0.1 in floating point, the third of them just above 0.3."""
    values = [0.0, 0.1, 0.3, 0.6, 0.7, 1.0, 0.05, 0.999]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", bin_of(F.col("v"), even_edges(10)).alias("b"))
    assert {r["v"]: r["b"] for r in frame.collect()} == {0.0: 0, 0.1: 1, 0.3: 2, 0.6: 5, 0.7: 6, 1.0: 9, 0.05: 0, 0.999: 9}


def test_recall_is_strict_and_has_an_overall_row(spark):
    rows = [(3, 0.8), (3, 0.81), (2, None), (2, 0.95)]
    table = evaluation.recall_at_threshold(spark.createDataFrame(rows, "confidence int, match_probability double"), [0.8, 0.9])
    got = {(r["threshold"], r["confidence_level"]): (r["match_percentage"], r["truth_pairs"]) for r in table.collect()}
    assert got == {
        (0.8, "3"): (0.5, 2), (0.8, "2"): (0.5, 2), (0.8, "overall"): (0.5, 4),
        (0.9, "3"): (0.0, 2), (0.9, "2"): (0.5, 2), (0.9, "overall"): (0.25, 4),
    }


def test_evaluate_agrees_with_its_parts(spark):
    rows = [(3, 0.9), (3, 0.4), (0, 0.6), (0, 0.2), (1, 0.5), (2, None), (3, None)]
    row = evaluation.evaluate(spark.createDataFrame(rows, "confidence int, match_probability double")).first()
    pairs = [(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.2)]
    assert math.isclose(row["auc"], auc(pairs)) and row["accuracy"] == 0.5 and (row["used"], row["dropped"]) == (4, 3)
    assert math.isclose(row["brier"], statistics.mean((p - y) ** 2 for y, p in pairs))
    counts = evaluation.evaluation_counts(spark.createDataFrame(rows, "confidence int, match_probability double")).first()
    assert tuple(counts) == (4, 3, 2, 1)


def test_truth_join_keeps_unmatched(spark):
    truth = spark.createDataFrame([("a", "b"), ("c", "d")], "id_1870 string, id_1880 string")
    predictions = spark.createDataFrame([("a", "b", 0.7), ("a", "z", 0.1)], "unique_id_l string, unique_id_r string, match_probability double")
    rows = {(r["id_1870"], r["match_probability"]) for r in evaluation.truth_left_join(truth, predictions).collect()}
    assert rows == {("a", 0.7), ("c", None)}


def test_density_integrates_to_one(spark):
    rng = random.Random(3)
    frame = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(200)], "v double")
    rows = evaluation.density_table(frame, "v").orderBy("point").collect()
    step = rows[1]["x"] - rows[0]["x"]
    assert len(rows) == 200 and abs(sum(r["density"] for r in rows) * step - 1) < 0.01
    doubled = evaluation.density_table(frame.withColumn("w", F.lit(1)), "v", weight="w").orderBy("point").collect()
    assert all(math.isclose(a["density"], b["density"], rel_tol=1e-9) for a, b in zip(rows, doubled))


def test_running_totals_over_many_ranges(spark):
    rng = random.Random(8)
    values = sorted({round(rng.random(), 5) for _ in range(2000)})
    frame = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "v double, n int")
    total, rows = 0, running_totals(frame, "v", ["n"], rows_per_range=130).orderBy("v").collect()
    for r in rows:
        assert r["before_n"] == total
        total += r["n"]


def test_running_totals_within_groups_and_positions(spark):
    rng = random.Random(3)
    cells = sorted({(rng.choice("abc"), rng.randrange(900)) for _ in range(700)} | {("d", 1)})
    frame = spark.createDataFrame([(g, v, v % 5 + 1) for g, v in cells], "g string, v int, n int")
    for rows_per_range in (40, 10**6):
        totals = dict.fromkeys("abcd", 0)
        for r in running_totals(frame, "v", ["n"], ["g"], rows_per_range).orderBy("g", "v").collect():
            assert r["before_n"] == totals[r["g"]]
            totals[r["g"]] += r["n"]
        names = numbered(frame.selectExpr("concat(g, v) as name"), "name", rows_per_range).collect()
        assert [r["name"] for r in sorted(names, key=lambda r: r["number"])] == sorted({f"{g}{v}" for g, v in cells})
        assert sorted(r["number"] for r in names) == list(range(len(names)))


def test_one_value_holds_most_rows(spark):
    rng = random.Random(6)
    rows = [(i % 2, 0.5 if i % 10 else round(rng.random(), 4)) for i in range(3000)]
    assert math.isclose(evaluation.roc_auc(labelled(spark, rows)).first()[0], auc(rows), abs_tol=1e-12)
    values = [7.0] * 2500 + [round(rng.random() * 20, 3) for _ in range(301)]
    frame = spark.createDataFrame([(v, None, -v, int(v)) for v in values], "v double, none double, w double, i int")
    got = {r["column_name"]: r for r in profiling.describe_numeric(frame, ["v", "none", "w", "i"], rows_per_range=50).collect()}
    for name, own in (("v", values), ("w", [-v for v in values]), ("i", [float(int(v)) for v in values])):
        r = got[name]
        assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(statistics.quantiles(own, n=4, method="inclusive"))
        assert (r["count"], r["min"], r["max"]) == (len(own), min(own), max(own))
        assert math.isclose(r["std"], statistics.stdev(own)) and math.isclose(r["mean"], statistics.fmean(own))
    assert tuple(got["none"])[1:] == (0, None, None, None, None, None, None, None)


def test_describe_numeric_interpolates(spark):
    values = [5, 1, 9, 9, 2, 7, None]
    row = profiling.describe_numeric(spark.createDataFrame([(v,) for v in values], "v int"), ["v"]).first()
    clean = sorted(v for v in values if v is not None)
    quarters = statistics.quantiles(clean, n=4, method="inclusive")
    assert (row["count"], row["min"], row["max"]) == (6, 1.0, 9.0)
    assert [row["p25"], row["p50"], row["p75"]] == quarters
    assert math.isclose(row["std"], statistics.stdev(clean))


def test_profile_ranks_both_ends(spark):
    frame = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), (None,)], "v string")
    rows = profiling.profile_columns(frame, ["v"], 2, 1).collect()
    assert {(r["end"], r["position"], r["value"], r["count"]) for r in rows} == {("top", 1, "a", 3), ("top", 2, "b", 2), ("bottom", 1, "c", 1)}
    text = profiling.describe_text(frame, "v").first()
    assert tuple(text) == (6, 3, "a", 3)


def test_crosstab_discovers_columns_and_fills_zero(spark):
    frame = spark.createDataFrame([(1, 10), (1, 10), (2, 20)], "g int, s int")
    rows = profiling.crosstab(frame, "g", "s").orderBy("g").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 0), (2, 0, 1)]
