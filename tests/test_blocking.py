import people
import pytest

from linkwright.operators import blocking as B
from linkwright.operators.spread import heavy_blocks, spread_join, spread_lookup

RULES = (B.block_on("norm_first_name", "nysiis_last_name"), B.BlockRule(("norm_race", "gender"), (("birth_year", 5),)))
LEFT, RIGHT = people.register("l", 90, 1), people.register("r", 110, 2)


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(LEFT, people.SCHEMA).cache(), spark.createDataFrame(RIGHT, people.SCHEMA).cache()


def expected(*rules):
    found = {}
    for a in LEFT:
        for b in RIGHT:
            for key, rule in enumerate(rules):
                if rule(a, b):
                    found[a[0], b[0]] = key
                    break
    return found


@pytest.mark.parametrize("budget", [1, 37, 400, 10**9])
def test_multi_pass_gives_each_pair_once_whatever_the_layout(sides, budget):
    pairs = B.multi_pass_blocking(*sides, RULES, pairs_per_task=budget)
    rows = pairs.select("unique_id_l", "unique_id_r", "match_key").collect()
    assert len(rows) == len({tuple(r)[:2] for r in rows})
    assert {(r[0], r[1]): r[2] for r in rows} == expected(people.rule_name, people.rule_range)


def test_sql_rules_give_the_same_pairs(sides):
    rules = [
        B.sql_rule("l.norm_first_name = r.norm_first_name and l.nysiis_last_name = r.nysiis_last_name"),
        B.sql_rule("l.norm_race = r.norm_race and l.gender = r.gender and abs(l.birth_year - r.birth_year) <= 5"),
    ]
    rows = B.multi_pass_blocking(*sides, rules).select("unique_id_l", "unique_id_r", "match_key").collect()
    assert {(r[0], r[1]): r[2] for r in rows} == expected(people.rule_name, people.rule_range)


def test_heavy_block_is_cut_into_tasks_within_budget(sides):
    left, right = sides
    pairs = B.sided(left, "_l"), B.sided(right, "_r")
    rows = heavy_blocks(*pairs, ["gender_l"], ["gender_r"], 100).collect()
    n_l = sum(r[4] == "F" for r in LEFT)
    n_r = sum(r[4] == "F" for r in RIGHT)
    assert any(r["split_l"] * r["split_r"] * 100 >= n_l * n_r for r in rows)


def test_spread_lookup_keeps_left_rows(spark):
    facts = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 99)], "k string, i int")
    lookup = spark.createDataFrame([("hot", 7)], "k string, v int")
    rows = spread_lookup(facts, lookup, ["k"], ["i"], "left", rows_per_task=4).collect()
    assert {(r["k"], r["i"], r["v"]) for r in rows} == {("hot", i, 7) for i in range(50)} | {("x", 99, None)}
    assert len(rows) == 51


def test_counts_equal_joins(sides):
    for rule in (*RULES, B.block_on("gender")):
        assert B.count_rule(*sides, rule).first()[0] == B.block_pairs(*sides, rule).count()
    added = B.cumulative_comparisons(*sides, RULES).orderBy("match_key").collect()
    truth = list(expected(people.rule_name, people.rule_range).values())
    assert [r["new_comparisons"] for r in added] == [truth.count(0), truth.count(1)]
    assert added[-1]["cumulative_comparisons"] == len(truth)


def test_three_overlapping_rules(sides):
    rules = (B.block_on("norm_race"), B.block_on("gender"), B.BlockRule((), (("birth_year", 2),)))
    total = B.count_union(*sides, rules).first()[0]
    assert total == B.multi_pass_blocking(*sides, rules).count()


def test_random_sample_is_repeatable_and_of_the_size_asked(sides):
    for number in (1, 137, 2000):
        rows = {tuple(r) for r in B.random_pair_sample(*sides, number).collect()}
        assert rows == {tuple(r) for r in B.random_pair_sample(*sides, number).collect()}
        assert len(rows) == number
        assert B.random_pair_sample(*sides, number, ["gender"]).count() == number
    # every record can be drawn
    assert {r[0] for r in rows} == {a[0] for a in LEFT} and {r[1] for r in rows} == {b[0] for b in RIGHT}
    for number in (len(LEFT) * len(RIGHT) - 1, len(LEFT) * len(RIGHT), 10**6):
        assert B.random_pair_sample(*sides, number).count() == min(number, len(LEFT) * len(RIGHT))
    assert B.random_pair_sample(sides[0].limit(0), sides[1], 10).count() == 0
    with pytest.raises(ValueError):
        B.random_pair_sample(*sides, 0)


def test_no_block_join_is_a_nested_loop(sides):
    plan = B.multi_pass_blocking(*sides, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_spread_join_condition(sides):
    left, right = B.sided(sides[0], "_l"), B.sided(sides[1], "_r")
    got = spread_join(left, right, ["gender_l"], ["gender_r"], "unique_id_l", "unique_id_r", pairs_per_task=50)
    want = sum(a[4] is not None and a[4] == b[4] for a in LEFT for b in RIGHT)
    assert got.count() == want


def test_sql_text_becomes_keys_where_it_can():
    rule = B.sql_rule("l.gender = r.gender and abs(r.birth_year - l.birth_year) <= 5")
    assert (rule.equal, rule.within, rule.sql) == (("gender",), (("birth_year", 5),), None)
    assert rule.label.startswith("l.gender")
    assert B.sql_rule("l.a = r.b").sql and B.sql_rule("l.a = l.a").sql and B.sql_rule("l.a = r.a or l.b > 3").sql
    assert B.sql_rule("l.a = r.a and l.b > 3").rest == "(l.b > 3)"
    assert B.sql_rule("l.a = r.b and l.c > 3").columns() == {"a", "b", "c"}
    passes = B.sql_rules("l.a = r.a or (l.b = r.b)")
    assert [p.equal for p in passes] == [("a",), ("b",)]


def test_sql_and_keyed_rules_mix(spark):
    rows = [(i, i % 3, i % 5) for i in range(40)]
    left = spark.createDataFrame(rows, "unique_id int, a int, b int")
    right = spark.createDataFrame([(100 + i, a, b) for i, a, b in rows], "unique_id int, a int, b int")
    rules = [B.block_on("a"), B.sql_rule("l.b = r.b and l.unique_id < 20"), B.sql_rule("l.b = r.b")]
    got = {(r["unique_id_l"], r["unique_id_r"], r["match_key"]) for r in B.multi_pass_blocking(left, right, rules).collect()}
    want = set()
    for i, a, b in rows:
        for j, c, d in rows:
            first = 0 if a == c else 1 if b == d and i < 20 else 2 if b == d else None
            if first is not None:
                want.add((i, 100 + j, first))
    assert got == want
    with pytest.raises(ValueError):
        B.cumulative_comparisons(left, right, [rules[0], B.sql_rule("l.b < r.b")]).collect()
    sizes = B.cumulative_comparisons(left, right, rules).orderBy("match_key").collect()
    assert [r["new_comparisons"] for r in sizes] == [sum(k == n for _, _, k in want) for n in range(3)]
    keyed = [rules[0], B.block_on("b")]
    assert [r["new_comparisons"] for r in B.cumulative_comparisons(left, right, [rules[0], rules[2]]).orderBy("match_key").collect()] == [
        r["new_comparisons"] for r in B.cumulative_comparisons(left, right, keyed).orderBy("match_key").collect()
    ]


def test_one_heavy_key_among_light_ones(spark):
    left = spark.range(3000).selectExpr("id as i", "cast(if(id < 300, 0, id) as int) as k")
    right = spark.range(3000).selectExpr("id as j", "if(id < 300, 0L, id) as q")
    joined = spread_join(left, right, ["k"], ["q"], "i", "j", pairs_per_task=1000)
    assert joined.count() == joined.distinct().count() == 300 * 300 + 2700
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan  # light keys apart from the grid


def test_sizes_of_nothing_are_zero(spark):
    none = spark.createDataFrame([], "unique_id string")
    assert tuple(B.cartesian_size(none, none).first()) == (0, 0, 0)


CONDITIONS = [
    "l.a = r.a and (l.b = r.b or l.c = r.c)",
    "(l.a = r.a or l.b = r.b) and (l.c = r.c or abs(l.n - r.n) <= 2)",
    "((l.a = r.a)) AND NOT (l.b = r.b OR l.n > r.n)",
    "not (not l.a = r.a or not (l.b = r.b))",
    "l.a = r.a and l.b <> ' or ' and r.b <> 'it\\'s and (' or l.c = r.c",
    "l.a = r.a and l.n between 2 and 9 or l.b = r.b and case when l.c = 'x' or r.c = 'y' then true else false end",
    "l.a = r.a and (l.n + 1) * 2 > r.n and (l.b is not null or r.c in ('x', 'y'))",
    "l.c = r.c and not (l.n > 5 and r.n > 5) and abs(l.n - r.n) <= 4 and abs(r.n - l.n) <= 3",
    "l.a = r.a or l.n < r.n",
    "l.a == r.a and coalesce(l.b = r.b, l.c = r.c)",
    "(l.a = r.a and l.b = r.b or l.b = r.b and l.c = r.c) and (l.n = r.n or l.a = r.a and (l.c = r.c or not l.n = r.n))",
    "(l.a = r.a) = (l.b = r.b)",
]


@pytest.fixture(scope="module")
def odd_sides(spark):
    import random

    rnd = random.Random(9)
    row = lambda i: (i, rnd.choice([1, 2, 3, None]), rnd.choice(["p", "q", " or ", "it's and (", None]), rnd.choice("xyz"), rnd.choice([*range(12), None]))
    schema = "unique_id int, a int, b string, c string, n int"
    return spark.createDataFrame([row(i) for i in range(60)], schema).cache(), spark.createDataFrame([row(100 + i) for i in range(70)], schema).cache()


def pairs_by_spark(left, right, condition):
    from pyspark.sql import functions as F

    pairs = left.alias("l").crossJoin(right.alias("r")).filter(F.expr(condition))
    return sorted(map(tuple, pairs.select("l.unique_id", "r.unique_id").collect()))


@pytest.mark.parametrize("condition", CONDITIONS)
def test_nested_conditions_give_the_pairs_they_say(odd_sides, condition):
    rule = B.sql_rule(condition)
    want = pairs_by_spark(*odd_sides, condition)
    got = B.block_pairs(*odd_sides, rule).select("unique_id_l", "unique_id_r").collect()
    assert sorted(map(tuple, got)) == want
    assert B.count_rule(*odd_sides, rule).first()[0] == len(want)
    assert set(rule.columns()) <= {"a", "b", "c", "n"} and rule.label == condition
    if condition in CONDITIONS[:8] + CONDITIONS[10:11]:
        assert not rule.sql and all(r.equal for r in rule.passes())
        plan = B.block_pairs(*odd_sides, rule)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    else:
        assert rule.sql or rule.rest


def test_nested_rules_among_others(odd_sides):
    rules = [B.sql_rule(CONDITIONS[0]), B.sql_rule(CONDITIONS[1]), B.block_on("c")]
    first = {}
    for number, condition in enumerate([CONDITIONS[0], CONDITIONS[1], "l.c = r.c"]):
        for pair in pairs_by_spark(*odd_sides, condition):
            first.setdefault(pair, number)
    got = B.multi_pass_blocking(*odd_sides, rules).select("unique_id_l", "unique_id_r", "match_key").collect()
    assert sorted(map(tuple, got)) == sorted((*pair, n) for pair, n in first.items())
    added = B.cumulative_comparisons(*odd_sides, rules).orderBy("match_key").collect()
    assert [int(r["new_comparisons"]) for r in added] == [list(first.values()).count(n) for n in range(3)]
    sizes = B.count_comparisons(*odd_sides, [*rules, B.block_on("a"), B.sql_rule("l.n < r.n")]).collect()
    assert [int(r["pre_filter"]) for r in sizes] == [len(pairs_by_spark(*odd_sides, x)) for x in (CONDITIONS[0], CONDITIONS[1], "l.c = r.c", "l.a = r.a", "l.n < r.n")]


def test_text_that_is_not_understood_stays_whole():
    for text in ("l.a = r.a -- or more", "l.a = r.a and", "(l.a = r.a", "l.a = r.a /* x */ and l.b = r.b"):
        assert B.sql_rule(text) == B.BlockRule(sql=text)
    many = " and ".join(f"(l.a{i} = r.a{i} or l.b{i} = r.b{i})" for i in range(9))
    assert B.sql_rule(many).sql == many
    assert B.sql_rule("l.a = r.a and l.`odd name` = 'l.z'").columns() == {"a", "odd name"}


def joins_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")


def test_ten_rules_need_ten_joins(odd_sides):
    keys = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "n"), ("b", "n"), ("c", "n"), ("a",), ("b",), ("n",), ("c",)]
    rules = [B.block_on(*k) for k in keys]
    added = B.cumulative_comparisons(*odd_sides, rules)
    assert joins_of(added) <= 10
    first = {}
    for number, k in enumerate(keys):
        for pair in pairs_by_spark(*odd_sides, " and ".join(f"l.{c} = r.{c}" for c in k)):
            first.setdefault(pair, number)
    rows = added.orderBy("match_key").collect()
    assert [int(r["new_comparisons"]) for r in rows] == [list(first.values()).count(n) for n in range(10)]
    assert int(rows[-1]["cumulative_comparisons"]) == len(first) == B.count_union(*odd_sides, rules).first()[0]
    # heavy combinations on the grid
    spread = B.cumulative_comparisons(*odd_sides, rules, pairs_per_task=50).orderBy("match_key").collect()
    assert [tuple(r) for r in spread] == [tuple(r) for r in rows]


def test_all_rules_are_counted_from_one_scan_of_each_side(spark, odd_sides, tmp_path):
    stored = []
    for i, side in enumerate(odd_sides):
        side.write.parquet(f"{tmp_path}/{i}")
        stored.append(spark.read.parquet(f"{tmp_path}/{i}"))
    sets = [("a",), ("a", "b"), ("b", "c"), ("c",), ("a", "c"), ("a", "n")]
    plan = B.key_sizes(stored[0], sets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
    sizes = {(r["__set"], r.a, r.b, r.c, r.n): r["__n"] for r in B.key_sizes(stored[0], sets).collect()}
    rows = stored[0].collect()
    assert sizes[1, 2, "q", None, None] == sum(r.a == 2 and r.b == "q" for r in rows)
    assert not any(k[0] == 0 and k[1] is None for k in sizes)
    # a set that two rules share, one of them with a tolerance
    rules = [B.block_on("a", "n"), B.BlockRule(("a",), (("n", 3),)), B.block_on("a"), B.block_on("a")]
    got = [int(r["post_filter"]) for r in B.count_comparisons(*stored, rules).collect()]
    texts = ["l.a = r.a and l.n = r.n", "l.a = r.a and abs(l.n - r.n) <= 3", "l.a = r.a", "l.a = r.a"]
    assert got == [len(pairs_by_spark(*odd_sides, t)) for t in texts]


@pytest.mark.parametrize(
    "rules",
    [
        RULES,
        (B.block_on("norm_race"), B.block_on("gender"), B.BlockRule((), (("birth_year", 2),))),
        (B.BlockRule((), (("birth_year", 5),)), B.block_on("birth_year"), B.BlockRule(("gender",), (("birth_year", 1),))),
        (B.sql_rule("l.gender = r.gender or l.norm_race = r.norm_race"), B.sql_rule("not (l.nysiis_last_name <> r.nysiis_last_name)")),
    ],
)
def test_overlaps_by_conjunctions_are_those_of_pairs(sides, rules):
    want = [tuple(r) for r in B.cumulative_comparisons(*sides, rules, paired=10**12).orderBy("match_key").collect()]
    got = [tuple(r) for r in B.cumulative_comparisons(*sides, rules, paired=-1).orderBy("match_key").collect()]
    assert got == want and len(got) == len(rules)
    assert int(got[-1][3]) == B.multi_pass_blocking(*sides, rules).count()


def test_not_unequal_is_a_key(sides):
    rule = B.sql_rule("l.norm_first_name = r.norm_first_name and not (l.gender <> r.gender or l.norm_race != r.norm_race)")
    assert rule.equal == ("norm_first_name", "gender", "norm_race") and rule.rest is None
    whole = B.block_on("norm_first_name", "gender", "norm_race")
    assert B.count_rule(*sides, rule).first() == B.count_rule(*sides, whole).first()
    assert B.sql_rule("l.gender = r.gender and not (l.norm_race <> r.gender)").rest
