"""Predictions of given pairs against all predictions."""

import people
import pytest

from linkwright.operators import scoring
from linkwright.plans import catalog
from test_model import SETTINGS, stated

LEFT, RIGHT = people.register("l", 90, 31, hot=0.2), people.register("r", 80, 32, hot=0.2)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([*LEFT, LEFT[0], (None, *LEFT[1][1:])], people.SCHEMA)
    return left.cache(), spark.createDataFrame(RIGHT, people.SCHEMA).cache()


@pytest.fixture(scope="module")
def everything(sides):
    return scoring.predict(*sides, SETTINGS, stated(), 0.2).collect()


def test_wanted_pairs_are_a_semi_join_of_all(spark, sides, everything):
    asked = [(a[0], b[0]) for i, a in enumerate(LEFT) for j, b in enumerate(RIGHT) if (i + j) % 3 == 0]
    wanted = spark.createDataFrame([*asked, asked[0], ("nobody", "r0000"), (None, "r0000")], "unique_id_l string, unique_id_r string")
    got = scoring.predict(*sides, SETTINGS, stated(), 0.2, wanted=wanted)
    want = [r for r in everything if (r.unique_id_l, r.unique_id_r) in set(asked)]
    assert want and sorted(map(repr, (r.asDict() for r in got.select(*everything[0].asDict()).collect()))) == sorted(map(repr, (r.asDict() for r in want)))


def test_truth_queries_form_no_blocks(spark, sf_dir, monkeypatch):
    """What only asks for the truth's pairs scores these, and forms no pairs of a block."""
    def refuse(*_, **__):
        raise AssertionError("blocks were formed")

    monkeypatch.setattr(scoring, "passing_pairs", refuse)
    monkeypatch.setattr(scoring, "multi_pass_blocking", refuse)
    for name in ("B16_project_pair_score", "C5_truth_left_join", "C7_pair_probability_lookup", "D17_weight_waterfall_chosen", "F3_pair_difference"):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0
