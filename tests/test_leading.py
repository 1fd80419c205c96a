"""The first and the best predictions against all predictions."""

import people
import pytest

from linkwright.operators import scoring
from test_model import SETTINGS, stated

LEFT, RIGHT = people.register("l", 90, 31, hot=0.2), people.register("r", 80, 32, hot=0.2)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([*LEFT, LEFT[0], (None, *LEFT[1][1:])], people.SCHEMA)
    return left.cache(), spark.createDataFrame(RIGHT, people.SCHEMA).cache()


@pytest.fixture(scope="module")
def everything(sides):
    return scoring.predict(*sides, SETTINGS, stated(), 0.2).collect()


@pytest.mark.parametrize("n", [1, 5, 60, 10**6])
def test_first_and_best_pairs(sides, everything, n):
    def key(r):
        return r.unique_id_l or "", r.unique_id_r

    first = scoring.leading_predictions(*sides, SETTINGS, stated(), 0.2, n, records=2).collect()
    assert [key(r) for r in sorted(first, key=key)[:n]] == [key(r) for r in sorted(everything, key=key)[:n]]
    best = scoring.best_predictions(*sides, SETTINGS, stated(), 0.2, n, pairs_per_task=10)
    got = [(round(r.match_probability, 9), *key(r)) for r in scoring.top_scored_pairs(best, n).collect()]
    want = sorted(everything, key=lambda r: (-r.match_probability, *key(r)))[:n]
    assert got == [(round(r.match_probability, 9), *key(r)) for r in want]
