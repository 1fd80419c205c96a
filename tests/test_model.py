import math
import re
from collections import Counter

import people
import pytest

from linkwright.operators import blocking as B
from linkwright.operators import comparison as C
from linkwright.operators import profiles, scoring, training
from linkwright.operators.model import LinkModel, LinkSettings, initial_model
from linkwright.operators.patterns import close_words, countable, pattern_counts

COMPARISONS = (
    C.comparison_birth_year(), C.comparison_exact("norm_race"), C.comparison_exact("gender"), C.comparison_first_name(),
)
RULES = (B.block_on("norm_first_name", "nysiis_last_name"), B.BlockRule(("norm_race", "gender"), (("birth_year", 5),)))
SETTINGS = LinkSettings(RULES, COMPARISONS)
LEFT, RIGHT = people.register("l", 80, 3), people.register("r", 95, 4)


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(LEFT, people.SCHEMA).cache(), spark.createDataFrame(RIGHT, people.SCHEMA).cache()


def test_levels_follow_their_order(spark):
    pairs = spark.createDataFrame(
        [("JOHN", "JOAN", 1850, 1850), ("ANN", "ALEXANDER", 1850, 1851), ("A", None, 1850, 1852), ("BOB", "MARY", 1850, 1853), ("A", "A", 1850, 1855), ("A", "AB", 1850, 1856)],
        "norm_first_name_l string, norm_first_name_r string, birth_year_l int, birth_year_r int",
    )
    rows = C.gamma_vectors(pairs, [COMPARISONS[3], COMPARISONS[0]], ["birth_year_r"]).orderBy("birth_year_r").collect()
    assert [r["gamma_norm_first_name"] for r in rows] == [3, 1, -1, 0, 4, 3]
    assert [r["gamma_birth_year"] for r in rows] == [4, 3, 2, 1, 1, 0]


def test_close_words_finds_all_pairs_within_two_edits(spark):
    words = sorted({w for w in people.FIRST if w is not None} | {"JHON", "NOHJ", "LIAM", "AB", "BA", "X"})
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = {tuple(r) for r in close_words(frame, frame, 2).collect()}
    want = {(a, b, people.edit_distance(a, b)) for a in words for b in words if people.edit_distance(a, b) <= 2}
    assert got == want


BLOCKS = [
    ((), (0,)), ((), (3,)), ((), (0, 1, 2, 3)),
    (("gender",), (0, 1, 3)), (("norm_race", "norm_first_name"), (0, 2)), (("gender",), (2, 3)),
]


@pytest.mark.parametrize("block,which", BLOCKS)
def test_pattern_counts_equal_brute_force(sides, block, which):
    chosen = [COMPARISONS[i] for i in which]
    place = {"gender": 4, "norm_race": 3, "norm_first_name": 1}

    def together(a, b):
        return all(a[place[c]] is not None and a[place[c]] == b[place[c]] for c in block)

    want = Counter(tuple(people.gammas(a, b)[i] for i in which) for a in LEFT for b in RIGHT if together(a, b))
    for by_keys in ([True, False] if block else [True]):
        rows = pattern_counts(*sides, chosen, B.block_on(*block), by_keys=by_keys).collect()
        assert {tuple(r[c.gamma] for c in chosen): r["pairs"] for r in rows} == want


def test_sql_levels_are_counted_by_pairs_of_profiles(sides):
    custom = C.comparison_custom("birth_year", [("abs(birth_year_l - birth_year_r) + 0 <= 3", "near")], "near")
    assert not countable(custom)
    rows = pattern_counts(*sides, [custom], B.block_on("gender")).collect()
    want = Counter(
        -1 if None in (a[5], b[5]) else int(abs(a[5] - b[5]) <= 3) for a in LEFT for b in RIGHT if a[4] and a[4] == b[4]
    )
    assert {r["gamma_near"]: r["pairs"] for r in rows} == want
    with pytest.raises(ValueError):
        pattern_counts(*sides, [custom])


def test_exact_u_is_the_share_over_all_pairs_and_sample_agrees_when_whole(sides):
    exact = training.estimate_u(*sides, COMPARISONS, method="exact")
    sampled = training.estimate_u(*sides, COMPARISONS, max_pairs=10**6)
    for c in COMPARISONS:
        assert math.isclose(sum(exact[c.key].values()), 1, abs_tol=1e-6)
        for g in exact[c.key]:
            assert math.isclose(exact[c.key][g], sampled[c.key][g], abs_tol=1e-12)


def test_training_raises_likelihood_and_sums_to_one(sides):
    model = training.train(
        *sides, initial_model(COMPARISONS), [B.block_on("gender", "norm_race", "norm_first_name")],
        [B.block_on("gender"), B.block_on("norm_race", "norm_first_name")], recall=0.9, max_rounds=8, tolerance=0.0,
    )
    for session in model.sessions:
        assert session.rounds == 8
        assert all(b >= a - 1e-6 for a, b in zip(session.log_likelihood, session.log_likelihood[1:]))
    for c in COMPARISONS:
        assert math.isclose(sum(model.m[c.key].values()), 1, abs_tol=1e-6)
    assert "gender" not in model.sessions[0].m and "norm_race" not in model.sessions[1].m


def test_training_stops_on_tolerance():
    session = training.run_em(
        "x", [COMPARISONS[1]], [((1,), 900), ((0,), 100)], {"norm_race": {1: 0.5, 0: 0.5}}, 0.3, 500, 1e-6
    )
    assert session.rounds < 500 and session.last_change < 1e-6


def test_prior_outside_range_is_refused(sides):
    with pytest.raises(ValueError):
        training._prior_value(*sides, [B.block_on("gender"), B.block_on("norm_race")], 0.05)


def stated():
    m = {c.key: {g: 0.8 if g == len(c.levels) else 0.2 / len(c.levels) for g in range(len(c.levels), -1, -1)} for c in COMPARISONS}
    u = {c.key: {g: 1 / (len(c.levels) + 1) for g in range(len(c.levels), -1, -1)} for c in COMPARISONS}
    return LinkModel(COMPARISONS, m, u, 0.1)


def score(model, levels):
    weight = model.prior_weight + sum(model.weight(c, g) for c, g in zip(COMPARISONS, levels) if g >= 0)
    return 1 / (1 + 2**-weight)


def test_predictions_by_definition_and_in_compact_form(sides):
    model = stated()
    want = {
        (a[0], b[0]): score(model, people.gammas(a, b))
        for a in LEFT for b in RIGHT if people.rule_name(a, b) or people.rule_range(a, b)
    }
    want = {pair: p for pair, p in want.items() if p >= 0.2}
    rows = scoring.predict(*sides, SETTINGS, model, 0.2, pairs_per_task=200).collect()
    assert {(r["unique_id_l"], r["unique_id_r"]) for r in rows} == set(want)
    assert all(math.isclose(r["match_probability"], want[r["unique_id_l"], r["unique_id_r"]], rel_tol=1e-9) for r in rows)
    compact = profiles.predict_profiles(*sides, SETTINGS, model, 0.2).collect()
    assert sum(r["pairs"] for r in compact) == len(want) and len(compact) < len(want)


def test_pattern_examples_are_the_first_pairs(sides):
    found = {}
    for a in LEFT:
        for b in RIGHT:
            if people.rule_name(a, b) or people.rule_range(a, b):
                found.setdefault(people.gammas(a, b), []).append((a[0], b[0]))
    names = [c.gamma for c in COMPARISONS]
    rows = profiles.pattern_examples(*sides, SETTINGS, 3).collect()
    got = {}
    for r in rows:
        got.setdefault(tuple(r[n] for n in names), []).append((r["example"], r["unique_id_l"], r["unique_id_r"], r["pattern_pairs"]))
    assert set(got) == set(found)
    for pattern, examples in got.items():
        pairs = sorted(found[pattern])
        assert sorted(examples) == [(i, *p, len(pairs)) for i, p in enumerate(pairs[:3], 1)]


def test_waterfall_ends_at_the_weight(sides):
    model = stated()
    predictions = scoring.predict(*sides, SETTINGS, model, 0.2).cache()
    final = scoring.weight_waterfall_table(predictions, model).filter("term = 'final'")
    both = predictions.join(final, ["unique_id_l", "unique_id_r"]).collect()
    assert both and all(math.isclose(r["match_weight"], r["running_weight"], abs_tol=1e-9) for r in both)


def test_close_words_of_every_length(spark):
    long = "ab" * 2500
    words = ["", "a", "b", "ab", "ba", "abc", "acb", "xabc", "abcd", "bcd", "a" * 9, "a" * 7 + "b", long, long[:-1], "x" + long[2:], "é☃", "☃"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")

    def distance(a, b):
        if abs(len(a) - len(b)) > 2 or max(len(a), len(b)) > 100 and not (a[2:50] in b and b[2:50] in a):
            return 9
        above = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
            above = row
        return above[-1]

    short = [w for w in words if len(w) < 100]
    want = {(a, b, distance(a, b)) for a in short for b in short if distance(a, b) <= 2}
    tall = {(long, long, 0), (long, long[:-1], 1), (long[:-1], long, 1), (long[:-1], long[:-1], 0), ("x" + long[2:], "x" + long[2:], 0),
            (long, "x" + long[2:], 2), ("x" + long[2:], long, 2)}
    got = {tuple(r) for r in close_words(frame, frame, 2).collect()}
    assert {g for g in got if len(g[0]) < 100} == want
    assert tall <= {g for g in got if len(g[0]) > 100}


@pytest.mark.parametrize("kinds", [("int", "int"), ("bigint", "int"), ("double", "double"), ("double", "int"), ("decimal(9,1)", "decimal(9,1)")])
def test_both_ways_of_counting_agree_on_every_type(sides, kinds):
    left, right = (side.withColumn("birth_year", side["birth_year"].cast(kind)) for side, kind in zip(sides, kinds))
    twice = [COMPARISONS[0], C.Comparison("birth_year", (C.within(0), C.within(3)), "years"), COMPARISONS[1]]
    block = B.block_on("gender")
    counted = [
        {tuple(r) for r in pattern_counts(left, right, twice, block, by_keys=by_keys).select("gamma_birth_year", "gamma_years", "gamma_norm_race", "pairs").collect()}
        for by_keys in (True, False)
    ]
    assert counted[0] == counted[1] and len(counted[0]) > 5


def test_fractions_are_not_counted_by_keys(sides):
    left = sides[0].withColumn("birth_year", sides[0]["birth_year"] + 0.5)
    with pytest.raises(ValueError):
        pattern_counts(left, sides[1], [COMPARISONS[0]], by_keys=True)


def test_level_text_becomes_a_level_where_it_can():
    texts = [("birth_year_l = birth_year_r", "same"), ("abs(birth_year_l - birth_year_r) <= 2", "near"), ("birth_year_l > 3", "odd")]
    levels = C.comparison_custom("birth_year", texts).levels
    assert [(x.kind, x.amount, x.title) for x in levels] == [("within", 0, "same"), ("within", 2, "near"), ("sql", 0, "odd")]
    names = [("n_l = n_r", ""), ("levenshtein(n_l, n_r) = 1", ""), ("levenshtein(n_l, n_r) <= 2", ""), ("substr(n_l, 1, 1) = substr(n_r, 1, 1)", "")]
    comparison = C.comparison_custom("n", names)
    assert [(x.kind, x.amount) for x in comparison.levels] == [("edit", 0), ("edit", 1), ("edit", 2), ("prefix", 1)]
    assert countable(comparison)


def test_counting_by_keys_sends_no_unfolded_table_through_the_driver(sides):
    """F1 to F4, F9, F10: the unfolded keys were one broadcast, 512 MB on 248,138 records."""
    words = close_words(*(side.select("norm_first_name") for side in sides), 2)
    counted = pattern_counts(*sides, [COMPARISONS[0], COMPARISONS[3]], B.block_on("gender"), by_keys=True)
    for frame, key in ((words, r"\bkey#"), (counted, r"key_norm_first_name")):
        lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        kinds = {re.search(r"\w+Join", x)[0] for x in lines if "Join" in x and re.search(key, x)}
        assert kinds == {"SortMergeJoin"}, kinds


def test_tolerances_and_words_fan_out_on_different_sides(spark):
    """F1 to F4: with both on the left, one value combination sent out the product of its years and words."""
    words = [f"{a}{b}{c}" for a in "ABC" for b in "ABC" for c in "ABC"]
    left = spark.createDataFrame([("l", "AAA", "X", "W", "F", 1850)], people.SCHEMA)
    right = spark.createDataFrame([(f"r{i}", w, "X", "W", "F", 1840 + i) for i, w in enumerate(words)], people.SCHEMA)
    chosen = [COMPARISONS[0], COMPARISONS[3]]
    rows = pattern_counts(left, right, chosen, B.block_on("gender"), by_keys=True).collect()
    want = Counter((people.gammas(a, b)[0], people.gammas(a, b)[3]) for a in left.collect() for b in right.collect())
    assert {(r["gamma_birth_year"], r["gamma_norm_first_name"]): int(r["pairs"]) for r in rows} == want
