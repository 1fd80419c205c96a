"""Random pairs for u: the registered query draws a million, the sampled branch is tried with fewer."""

import people
import pytest

from linkwright.operators import blocking as B
from linkwright.operators import comparison as C
from linkwright.operators import training
from linkwright.plans import catalog


def test_the_query_draws_a_million_pairs(spark, sf_dir, monkeypatch):
    asked = []

    def noted(left, right, max_pairs, columns):
        asked.append(max_pairs)
        return B.random_pair_sample(left, right, max_pairs, columns)

    monkeypatch.setattr(training, "random_pair_sample", noted)
    catalog.QUERIES["D7_estimate_u_sampled"](spark, sf_dir)
    assert asked == [1_000_000]


def test_few_pairs_give_about_the_exact_shares(spark):
    left, right = (spark.createDataFrame(people.register(p, 600, s), people.SCHEMA) for p, s in (("a", 1), ("b", 2)))
    gender = C.comparison_exact("gender")
    exact = training.estimate_u(left, right, [gender], method="exact")
    drawn = training.estimate_u(left, right, [gender], max_pairs=20_000)
    assert drawn != exact
    for level, share in exact[gender.key].items():
        assert drawn[gender.key][level] == pytest.approx(share, abs=0.1)
