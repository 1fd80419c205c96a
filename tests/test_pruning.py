import random

import people
import pytest

from linkwright.operators import blocking as B
from linkwright.operators import comparison as C
from linkwright.operators import pruning, scoring
from linkwright.operators.model import LinkModel
from test_model import COMPARISONS, RULES, SETTINGS, stated

NAMES = ["ANNA", "ANN", "BERTA", "CARL", "CARLA", "DORA", "EMIL", "FRITZ", "GRETE", "HANS", "IDA", "JOHN", "KARL", "LENA"]
PLACES = [f"P{i}" for i in range(30)]
LEFT, RIGHT = people.register("l", 80, 11, hot=0.15), people.register("r", 90, 12, hot=0.15)


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(LEFT, people.SCHEMA).cache(), spark.createDataFrame(RIGHT, people.SCHEMA).cache()


def model(prior):
    base = stated()
    return LinkModel(base.comparisons, base.m, base.u, prior)


def test_levels_a_rule_allows():
    year, race, _, name = COMPARISONS
    assert pruning.allowed_levels(RULES[1], year) == {1, 2, 3, 4}
    assert pruning.allowed_levels(RULES[1], race) == {1}
    assert pruning.allowed_levels(RULES[0], name) == {4}
    assert pruning.allowed_levels(RULES[0], year) == {-1, 0, 1, 2, 3, 4}


def test_necessary_agreement_depends_on_the_threshold():
    assert pruning.narrowing(RULES[1], model(0.1), 0.0) is None
    strict = pruning.narrowing(RULES[1], model(0.01), 0.2)
    assert strict.comparison.column == "norm_first_name" and 0 not in strict.levels


@pytest.mark.parametrize("prior", [0.3, 0.05, 0.02, 0.0001])
@pytest.mark.parametrize("threshold", [0.2, 0.7])
def test_narrowed_rules_lose_nothing_that_passes(sides, prior, threshold):
    chosen = model(prior)
    columns = [c.column for c in COMPARISONS]
    whole = scoring.score_gammas(scoring.candidate_gammas(*sides, SETTINGS), chosen, threshold)
    pairs = pruning.passing_pairs(*sides, RULES, columns, chosen, threshold, pairs_per_task=10, partners=0)
    gammas = scoring.gamma_vectors(pairs, COMPARISONS, ["unique_id_l", "unique_id_r", "match_key"])
    narrow = scoring.score_gammas(gammas, chosen, threshold)
    keys = ["unique_id_l", "unique_id_r", "match_key"]
    got = [tuple(r) for r in narrow.select(*keys).collect()]
    assert sorted(got) == sorted(tuple(r) for r in whole.select(*keys).collect())

def test_missing_names_do_not_bring_back_the_whole_rule(spark):
    """A third of all names is missing: the branch without a name asks for the next agreement in turn."""
    rng = random.Random(21)

    def register(prefix, number):
        return [
            (f"{prefix}{i}", 1800 + rng.randrange(60), rng.choice("WB"), rng.choice("FM"), None if rng.random() < 0.34 else rng.choice(NAMES), rng.choice(PLACES))
            for i in range(number)
        ]

    names = ["unique_id", "birth_year", "norm_race", "gender", "norm_first_name", "place"]
    schema = "unique_id string, birth_year int, norm_race string, gender string, norm_first_name string, place string"
    left, right = (spark.createDataFrame(register(p, 300), schema).cache() for p in ("l", "r"))
    assert left.columns == names
    name, place = C.comparison_first_name(), C.comparison_exact("place")
    rates = {
        name.key: {4: (0.8, 0.01), 3: (0.1, 0.02), 2: (0.05, 0.05), 1: (0.04, 0.1), 0: (0.01, 0.82)},
        place.key: {1: (0.95, 0.02), 0: (0.05, 0.98)},
    }
    chosen = LinkModel((name, place), {k: {g: x[0] for g, x in v.items()} for k, v in rates.items()}, {k: {g: x[1] for g, x in v.items()} for k, v in rates.items()}, 0.02)
    rule = B.block_on("gender")
    columns = ["norm_first_name", "place"]

    def formed(**how):
        return pruning.passing_pairs(left, right, [rule], columns, chosen, 0.3, **how)

    whole, narrow = formed(pairs_per_task=10**9), formed(pairs_per_task=10, partners=0)
    scored = [scoring.score_gammas(scoring.gamma_vectors(p, (name, place), ["unique_id_l", "unique_id_r", "match_key"]), chosen, 0.3) for p in (whole, narrow)]
    keys = [sorted(map(tuple, s.select("unique_id_l", "unique_id_r").collect())) for s in scored]
    assert keys[0] == keys[1] and len(keys[0]) > 50
    # without a name, only an equal place can pass: a key, not the whole of the rule's pairs
    assert narrow.count() < 0.25 * whole.count()
    missing = narrow.filter("norm_first_name_l is null or norm_first_name_r is null")
    assert missing.filter("place_l <> place_r").count() == 0


def test_a_rule_is_narrowed_by_every_agreement_that_is_needed(spark):
    """Where only full agreement passes, pairs that share a name but no year are not formed."""
    def register(prefix):
        return [(f"{prefix}{i}", "ANNA", "BRAN", "W", "F", 1000 + 10 * i) for i in range(60)]

    left, right = (spark.createDataFrame(register(p), people.SCHEMA) for p in "lr")
    threshold = pruning.reachable_probabilities(RULES[:1], model(0.05))[0] - 1e-6
    joins = list(pruning._narrow_rules(left, right, RULES[0], model(0.05), threshold, 10))
    assert sum(int(B.count_rule(a, b, rule).first()["comparisons"]) for a, b, rule in joins) == 60  # of 3,600
