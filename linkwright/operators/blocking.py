"""Candidate pairs from blocking rules, and the size of what the rules would produce."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwright.functions.scalars import PAIR_COUNT, hash60, pair_count
from linkwright.operators.conditions import NotUnderstood, alternatives, sided_columns, with_suffixes
from linkwright.operators.prepare import all_of
from linkwright.operators.spread import PAIRS_PER_TASK, spread_join
from linkwright.session import cut_lineage


@dataclass(frozen=True)
class BlockRule:
    """Columns that must be equal, and integer columns that may differ by at most a tolerance.

    `rest` is a further condition, in SQL over ``l.`` and ``r.`` columns, on pairs that meet by these keys.
    `alternatives` are rules by keys of which one must hold.  `sql` stands alone, for a condition without
    keys: Spark parses and plans it.  `sql_rule` finds the form for SQL text.
    """

    equal: tuple[str, ...] = ()
    within: tuple[tuple[str, int], ...] = ()
    sql: str | None = None
    title: str = ""
    rest: str | None = None
    alternatives: tuple["BlockRule", ...] = ()

    @property
    def label(self) -> str:
        if self.title or self.sql:
            return self.title or self.sql
        if self.alternatives:
            return " or ".join(f"({r.label})" for r in self.alternatives)
        parts = [f"{c} equal" for c in self.equal] + [f"{c} within {t}" for c, t in self.within]
        return " and ".join(parts + ([self.rest] if self.rest else []))

    @property
    def keyed(self) -> bool:
        """One join by keys, whatever else must hold."""
        return not self.sql and not self.alternatives

    def passes(self) -> tuple["BlockRule", ...]:
        """The rules by keys of which one must hold."""
        return self.alternatives or (self,)

    def columns(self) -> set[str]:
        named = {c for text in (self.sql, self.rest) if text for c in sided_columns(text)}
        named |= {c for rule in self.alternatives for c in rule.columns()}
        return set(self.equal) | {c for c, _ in self.within} | named

    def holds(self) -> Column:
        """The rule over a pair with ``_l``/``_r`` columns; null inputs do not satisfy it."""
        if self.alternatives:
            return reduce(lambda a, b: a | b, [r.holds() for r in self.alternatives])
        return F.coalesce(all_of(self.tests()), F.lit(False))

    def tests(self) -> list[Column]:
        tests = [F.col(f"{c}_l") == F.col(f"{c}_r") for c in self.equal]
        return tests + self.beyond_equal() + ([F.expr(with_suffixes(self.sql))] if self.sql else [])

    def beyond_equal(self) -> list[Column]:
        """What a pair with equal keys must meet besides."""
        tests = [F.abs(F.col(f"{c}_l") - F.col(f"{c}_r")) <= t for c, t in self.within]
        return tests + ([F.expr(with_suffixes(self.rest))] if self.rest else [])

    def both(self, other: "BlockRule") -> "BlockRule":
        """The conjunction of two rules."""
        if not (self.keyed and other.keyed):
            raise ValueError(f"cannot count by keys: {(other if self.keyed else self).label}")
        tolerance = dict(self.within)
        for column, t in other.within:
            tolerance[column] = min(t, tolerance.get(column, t))
        equal = tuple(dict.fromkeys(self.equal + other.equal))
        rest = " AND ".join(f"({r.rest})" for r in (self, other) if r.rest) or None
        return BlockRule(equal, tuple((c, t) for c, t in tolerance.items() if c not in equal), rest=rest)


PAIRED = 5_000_000  # pairs beyond which overlaps are counted by conjunctions
CONJOINED = 6  # passes; so many have at most 63 conjunctions


def block_on(*columns: str) -> BlockRule:
    return BlockRule(equal=columns)


_EQUAL = re.compile(r"([lr])\.(\w+)\s*==?\s*([lr])\.(\w+)", re.I)
_NOT_UNEQUAL = re.compile(r"not\s*\(\s*([lr])\.(\w+)\s*(?:<>|!=)\s*([lr])\.(\w+)\s*\)", re.I)
_WITHIN = re.compile(r"abs\(\s*([lr])\.(\w+)\s*-\s*([lr])\.(\w+)\s*\)\s*<=\s*(\d+)", re.I)


def _by_keys(texts: Sequence[str]) -> BlockRule:
    """A rule from texts that must all hold: ``l.c = r.c`` and ``not (l.c <> r.c)`` are keys, ``abs(l.c - r.c) <= k`` a
    tolerance."""
    equal: list[str] = []
    within: dict[str, int] = {}
    rest: list[str] = []
    for text in texts:
        same, near = _EQUAL.fullmatch(text) or _NOT_UNEQUAL.fullmatch(text), _WITHIN.fullmatch(text)
        found = same or near
        if not found or found[1].lower() == found[3].lower() or found[2] != found[4]:
            rest.append(text)
        elif same:
            equal.append(same[2])
        else:
            within[near[2]] = min(int(near[5]), within.get(near[2], int(near[5])))
    tolerances = tuple((c, t) for c, t in within.items() if c not in equal)
    return BlockRule(tuple(dict.fromkeys(equal)), tolerances, rest=" AND ".join(f"({x})" for x in rest) or None)


def sql_rule(condition: str) -> BlockRule:
    """A rule from SQL text over ``l.`` and ``r.`` columns.

    Brackets, ``and``, ``or`` and ``not`` are resolved into alternatives.  If each of them has a key or a
    tolerance, it is joined by these and what else it says is checked on the pairs that meet; otherwise
    (and for text that is not understood) the whole condition is left to Spark.
    """
    try:
        passes = [_by_keys(texts) for texts in alternatives(condition)]
    except NotUnderstood:
        return BlockRule(sql=condition)
    if not all(r.equal or r.within for r in passes):
        return BlockRule(sql=condition)
    if len(passes) == 1:
        return replace(passes[0], title=condition)
    return BlockRule(alternatives=tuple(passes), title=condition)


def sql_rules(condition: str) -> list[BlockRule]:
    """One rule for each alternative of a condition, where each is a rule by keys; else one SQL rule."""
    return list(sql_rule(condition).passes())


def sided(records: DataFrame, suffix: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Give every column a side suffix."""
    return records.select(*[F.col(c).alias(f"{c}{suffix}") for c in (columns or records.columns)])


def _banded(left: DataFrame, right: DataFrame, rule: BlockRule, suffixes=("_l", "_r")):
    """Join keys that turn tolerances into equalities.

    Values are cut into bands as wide as the tolerance; two values within it lie in the same or in
    neighbouring bands, so the left side gets three copies and the join becomes a plain equi-join
    with the exact difference checked afterwards.
    """
    keys_l = [f"{c}{suffixes[0]}" for c in rule.equal]
    keys_r = [f"{c}{suffixes[1]}" for c in rule.equal]
    for column, tolerance in rule.within:
        width = max(tolerance, 1)
        band_l, band_r = f"__band_{column}_l", f"__band_{column}_r"
        cell = F.floor(F.col(f"{column}{suffixes[0]}") / width)
        near = [cell] if tolerance == 0 else [cell - 1, cell, cell + 1]
        left = left.filter(F.col(f"{column}{suffixes[0]}").isNotNull()).withColumn(band_l, F.explode(F.array(*near)))
        right = right.withColumn(band_r, F.floor(F.col(f"{column}{suffixes[1]}") / width))
        keys_l.append(band_l)
        keys_r.append(band_r)
    return left, right, keys_l, keys_r


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    rule: BlockRule,
    columns: Sequence[str] = (),
    unique_id: str = "unique_id",
    pairs_per_task: int = PAIRS_PER_TASK,
    largest: int | None = None,
) -> DataFrame:
    """Pairs (``*_l``, ``*_r``) of left and right records that satisfy one rule.

    `largest` bounds the pairs of a block; it is left rows x right rows unless given.  The sides should
    be stored tables: they are counted, sized by key and then joined.
    """
    if rule.sql:
        needed = sorted({unique_id, *rule.columns(), *columns})
        raw = left.alias("l").join(right.alias("r"), F.expr(rule.sql))
        return raw.select(
            *[F.col(f"l.{c}").alias(f"{c}_l") for c in needed], *[F.col(f"r.{c}").alias(f"{c}_r") for c in needed]
        )
    needed = sorted({unique_id, *rule.columns(), *columns})
    if largest is None:
        largest = left.count() * right.count()
    if rule.alternatives:
        pairs = _passes([[r] for r in rule.alternatives], left, right, needed, unique_id, pairs_per_task, largest)
        return pairs.drop("match_key")
    a, b, keys_l, keys_r = _banded(sided(left, "_l", needed), sided(right, "_r", needed), rule)
    exact = rule.beyond_equal()
    pairs = spread_join(
        a, b, keys_l, keys_r, f"{unique_id}_l", f"{unique_id}_r", all_of(exact) if exact else None, pairs_per_task, largest
    )
    return pairs.select(*[f"{c}_l" for c in needed], *[f"{c}_r" for c in needed])


def multi_pass_blocking(
    left: DataFrame,
    right: DataFrame,
    rules: Sequence[BlockRule],
    columns: Sequence[str] = (),
    unique_id: str = "unique_id",
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Union of the rules, each pair once and tagged with the first rule it satisfies.

    One join per rule; a later rule drops what an earlier one already produced by testing the
    earlier condition on the pair itself, so no distinct over pairs is needed.
    """
    needed = sorted({unique_id, *columns, *(c for r in rules for c in r.columns())})
    largest = None if all(r.sql for r in rules) else left.count() * right.count()
    return _passes([r.passes() for r in rules], left, right, needed, unique_id, pairs_per_task, largest)


def _passes(
    rules: Sequence[Sequence[BlockRule]], left: DataFrame, right: DataFrame, needed: Sequence[str], unique_id: str,
    pairs_per_task: int, largest: int | None,
) -> DataFrame:
    """A join for each pass of each rule, less the pairs that an earlier pass has."""
    united, earlier = None, []
    for number, passes in enumerate(rules):
        for rule in passes:
            pairs = block_pairs(left, right, rule, needed, unique_id, pairs_per_task, largest)
            for other in earlier:
                pairs = pairs.filter(~other.holds())
            pairs = pairs.withColumn("match_key", F.lit(number))
            united = pairs if united is None else united.unionByName(pairs)
            earlier.append(rule)
    return united


# -- sizes, from group counts rather than pairs ------------------------------------------------


def _group_sizes(records: DataFrame, columns: Sequence[str], suffix: str, size: str) -> DataFrame:
    known = records.filter(all_of([F.col(c).isNotNull() for c in columns]))
    return sided(known.groupBy(*columns).agg(F.count("*").alias("__n")), suffix).withColumnRenamed(f"__n{suffix}", size)


def block_size_join(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per key combination: left rows, right rows, comparisons."""
    n_l = _group_sizes(left, columns, "", "n_left")
    n_r = _group_sizes(right, columns, "", "n_right")
    return n_l.join(n_r, list(columns)).withColumn("comparisons", pair_count(F.col("n_left"), F.col("n_right")))


def _total() -> Column:
    return F.coalesce(F.sum(pair_count(F.col("__n_l"), F.col("__n_r"))), F.lit(0)).cast(PAIR_COUNT)


def _sized_pairs(a: DataFrame, b: DataFrame, rule: BlockRule) -> DataFrame:
    """Distinct key values of both sides, with their sizes, that satisfy a rule by keys."""
    a, b, keys_l, keys_r = _banded(a, b, rule)
    match = all_of([F.col(x) == F.col(y) for x, y in zip(keys_l, keys_r)] + rule.beyond_equal())
    return a.join(b, match)


def count_rule(left: DataFrame, right: DataFrame, rule: BlockRule) -> DataFrame:
    """One row ``comparisons``: pairs satisfying the rule, summed over distinct key values."""
    if rule.sql:
        return left.alias("l").join(right.alias("r"), F.expr(rule.sql)).agg(F.count("*").cast(PAIR_COUNT).alias("comparisons"))
    if rule.alternatives:
        return count_union(left, right, rule.alternatives)
    columns = sorted(rule.columns())
    # a column that only `rest` reads may be null in a pair that satisfies it
    sides = [
        side.filter(all_of([F.col(c).isNotNull() for c in (*rule.equal, *(c for c, _ in rule.within))])).groupBy(*columns).agg(F.count("*").alias("__n"))
        for side in (left, right)
    ]
    a, b = (sided(side, s) for side, s in zip(sides, ("_l", "_r")))
    return _sized_pairs(a, b, rule).agg(_total().alias("comparisons"))


def cartesian_size(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows, right rows and their product, without pairing anything."""
    tagged = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sizes = tagged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("l", "n_left"), ("r", "n_right"))])
    return sizes.withColumn("comparisons", pair_count(F.col("n_left"), F.col("n_right")))


def key_sizes(records: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """(__set, columns, __n): rows per value of every set of columns, from one scan.

    `__set` numbers the sets in the order given; rows null in a column of the set are left out; columns
    of other sets are null.
    """
    columns = sorted({c for keys in key_sets for c in keys})
    place = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    marks = [sum(bit for c, bit in place.items() if c not in keys) for keys in key_sets]
    grouped = records.groupingSets([list(keys) for keys in key_sets], *columns).agg(
        F.grouping_id().alias("__mark"), F.count("*").alias("__n")
    )
    number, known = F.lit(None).cast("int"), F.lit(False)
    for i, (keys, mark) in reversed(list(enumerate(zip(key_sets, marks)))):
        here = F.col("__mark") == mark
        number = F.when(here, F.lit(i)).otherwise(number)
        known = known | (here & all_of([F.col(c).isNotNull() for c in keys]))
    return grouped.filter(known).select(number.alias("__set"), *columns, "__n")


def count_comparisons(left: DataFrame, right: DataFrame, rules: Sequence[BlockRule]) -> DataFrame:
    """Pairs of each rule before and after filtering; equal when linking two tables.

    One scan of each side counts the values of all rules by keys (grouping sets); equal keys of all
    rules are joined at once, tolerances and further conditions on the values already counted.
    """
    spark = left.sparkSession
    by_keys = [r for r in rules if r.keyed]
    key_sets = list(dict.fromkeys(tuple(sorted({*r.equal, *(c for c, _ in r.within)} | r.columns())) for r in by_keys))
    found = None
    if by_keys:
        a, b = (cut_lineage(key_sizes(side, key_sets)) for side in (left, right))
        columns = [c for c in a.columns if c not in ("__set", "__n")]
        number = {id(r): key_sets.index(tuple(sorted(r.columns()))) for r in by_keys}
        plain = sorted({number[id(r)] for r in by_keys if not r.beyond_equal()})
        if plain:
            x, y = sided(a, "_l").filter(F.col("__set_l").isin(plain)), sided(b, "_r")
            same = all_of([F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")) for c in ("__set", *columns)])
            found = x.join(y, same).groupBy(F.col("__set_l").alias("__set")).agg(_total().alias("pairs"))
            found = found.select("__set", F.lit(-1).alias("rule_number"), "pairs")
    for i, rule in enumerate(rules):
        if not rule.keyed:
            one = count_rule(left, right, rule)
        elif rule.beyond_equal():
            own = [sided(side.filter(F.col("__set") == number[id(rule)]).select(*sorted(rule.columns()), "__n"), s) for side, s in ((a, "_l"), (b, "_r"))]
            one = _sized_pairs(*own, rule).agg(_total().alias("comparisons"))
        else:
            continue
        one = one.select(F.lit(-1).alias("__set"), F.lit(i).alias("rule_number"), F.col("comparisons").alias("pairs"))
        found = one if found is None else found.unionByName(one)
    named = []
    for i, rule in enumerate(rules):
        plain = rule.keyed and not rule.beyond_equal()
        named.append((i, rule.label, number[id(rule)] if plain else -1, -1 if plain else i))
    named = spark.createDataFrame(named, "number int, rule string, __set int, rule_number int")
    pairs = F.coalesce("pairs", F.lit(0)).cast(PAIR_COUNT)
    sized = F.broadcast(named).join(found, ["__set", "rule_number"], "left").orderBy("number")
    return sized.select("rule", pairs.alias("pre_filter"), pairs.alias("post_filter"))


def n_largest_blocks(left: DataFrame, right: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    sizes = block_size_join(left, right, columns)
    return sizes.orderBy(F.desc("comparisons"), *columns).limit(n)


def _conjunctions(passes: Sequence[tuple[int, BlockRule]]) -> list[tuple[BlockRule, dict[int, int]]]:
    """What each pass adds to the earlier ones as a sum of conjunctions: each with its factor for each rule number."""
    terms: dict[tuple, tuple[BlockRule, dict[int, int]]] = {}
    for i, (number, rule) in enumerate(passes):
        signed = [(rule, 1)]
        for _, earlier in passes[:i]:
            signed += [(one.both(earlier), -sign) for one, sign in signed]
        for one, sign in signed:
            _, factors = terms.setdefault((frozenset(one.equal), frozenset(one.within), one.rest), (one, {}))
            factors[number] = factors.get(number, 0) + sign
    return [(one, used) for one, factors in terms.values() if (used := {n: f for n, f in factors.items() if f})]


def _by_conjunctions(left: DataFrame, right: DataFrame, passes: Sequence[tuple[int, BlockRule]]) -> DataFrame:
    """(match_key, part): the pairs that the passes add, counted by the keys of their conjunctions.

    A combination of keys meets one of the other side, and with a tolerance as many as it spans, so the work is in
    proportion to the records, however large the blocks.
    """
    columns = sorted({c for _, one in passes for c in one.columns()})
    sides = [cut_lineage(side.groupBy(*columns).agg(F.count("*").alias("__n"))) for side in (left, right)]
    parts = None
    nothing = {number: 0 for number, _ in passes}  # a rule that adds nothing has a row, too
    for rule, factors in _conjunctions(passes):
        factors, nothing = nothing | factors, {}
        keys = [F.col(c).isNotNull() for c in (*rule.equal, *(c for c, _ in rule.within))]
        a, b = (
            sided(side.filter(all_of(keys)).groupBy(*sorted(rule.columns())).agg(F.sum("__n").alias("__n")), s)
            for side, s in zip(sides, ("_l", "_r"))
        )
        rows = F.array(*[F.struct(F.lit(n).alias("match_key"), F.lit(f).alias("factor")) for n, f in sorted(factors.items())])
        met = _sized_pairs(a, b, rule).agg(_total().alias("n")).select("n", F.inline(rows))
        met = met.select("match_key", (F.col("n") * F.col("factor")).cast(PAIR_COUNT).alias("part"))
        parts = met if parts is None else parts.unionByName(met)
    return parts


def cumulative_comparisons(
    left: DataFrame, right: DataFrame, rules: Sequence[BlockRule], pairs_per_task: int = PAIRS_PER_TASK,
    paired: int = PAIRED,
) -> DataFrame:
    """Pairs each rule adds to the earlier ones, with the running total.

    Rows are counted per distinct combination of the rules' columns.  Combinations are joined rule by rule,
    those that an earlier rule holds for are dropped, and products of counts are added up.  What the last rule
    (as a rule the loosest) adds is its size, from group counts alone, less what the others have of it.  So k
    rules need k joins.  Where these would form more than `paired` pairs and the rules are few, the keys of their
    conjunctions are counted instead.
    """
    passes = [(number, one) for number, rule in enumerate(rules) for one in rule.passes()]
    if any(not one.keyed for _, one in passes):
        raise ValueError(f"cannot count by keys: {next(one for _, one in passes if not one.keyed).label}")
    by_keys = 1 < len(passes) <= CONJOINED and not any(one.rest for _, one in passes)
    if by_keys:
        sized = reduce(DataFrame.unionByName, [count_rule(left, right, one) for _, one in passes[:-1]])
        by_keys = sized.agg(F.sum("comparisons")).first()[0] > paired
    parts = _by_conjunctions(left, right, passes) if by_keys else _by_pairs(left, right, passes, pairs_per_task)
    name = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (i, r.label)]), F.col("match_key"))
    added = parts.groupBy("match_key").agg(F.coalesce(F.sum("part"), F.lit(0)).cast(PAIR_COUNT).alias("new_comparisons"))
    running = W.orderBy("match_key").rowsBetween(W.unboundedPreceding, 0)  # one row per rule
    total = F.sum("new_comparisons").over(running).cast(PAIR_COUNT)
    return added.select("match_key", name.alias("rule"), "new_comparisons", total.alias("cumulative_comparisons"))


def _by_pairs(left: DataFrame, right: DataFrame, passes: Sequence[tuple[int, BlockRule]], pairs_per_task: int) -> DataFrame:
    """(match_key, part): the pairs that the passes add, from pairs of distinct combinations."""
    last_number, last = passes[-1]
    parts = count_rule(left, right, last).select(F.lit(last_number).alias("match_key"), F.col("comparisons").alias("part"))
    if len(passes) > 1:
        columns = sorted({c for _, one in passes for c in one.columns()})
        sides, sizes = [], []
        for side, s in ((left, "_l"), (right, "_r")):
            counted = sided(side.groupBy(*columns).agg(F.count("*").alias("__n")), s)
            sides.append(cut_lineage(counted.withColumn(f"__tuple{s}", F.xxhash64(*[F.col(f"{c}{s}") for c in columns]))))
            sizes.append(sides[-1].count())
    for i, (number, rule) in enumerate(passes[:-1]):
        a, b, keys_l, keys_r = _banded(*sides, rule)
        exact = rule.beyond_equal()
        pairs = spread_join(a, b, keys_l, keys_r, "__tuple_l", "__tuple_r", all_of(exact) if exact else None, pairs_per_task, sizes[0] * sizes[1])
        for _, earlier in passes[:i]:
            pairs = pairs.filter(~earlier.holds())
        n = pair_count(F.col("__n_l"), F.col("__n_r"))
        both = pairs.agg(F.sum(n).alias("own"), F.sum(F.when(last.holds(), n)).alias("shared"))
        rows = F.array(
            F.struct(F.lit(number).alias("match_key"), F.col("own").alias("part")),
            F.struct(F.lit(last_number).alias("match_key"), (-F.col("shared")).alias("part")),
        )
        parts = parts.unionByName(both.select(F.inline(rows)).select("match_key", F.col("part").cast(PAIR_COUNT)))
    return parts


def count_union(left: DataFrame, right: DataFrame, rules: Sequence[BlockRule]) -> DataFrame:
    """One row ``comparisons``: pairs satisfying at least one rule."""
    if len(rules) == 1 and not rules[0].alternatives:
        return count_rule(left, right, rules[0])
    return cumulative_comparisons(left, right, rules).agg(F.sum("new_comparisons").cast(PAIR_COUNT).alias("comparisons"))


def reduction_ratio(left: DataFrame, right: DataFrame, rules: Sequence[BlockRule]) -> DataFrame:
    """Per rule: 1 - pairs / all pairs."""
    sizes = count_comparisons(left, right, rules).select("rule", F.col("post_filter").alias("comparisons"))
    whole = cartesian_size(left, right).select(F.col("comparisons").cast("double")).scalar()
    return sizes.withColumn("reduction_ratio", 1 - F.try_divide(F.col("comparisons").cast("double"), whole))


# -- random pairs ---------------------------------------------------------------------------------


STRIPS = 32
SPARE = 1.25  # so many times the pairs asked for are drawn by bucket before the cut
CELL_BITS = 14  # the histogram of pair hashes has 2 ** CELL_BITS cells


def _bucket(unique_id: str, buckets: int) -> Column:
    return hash60(F.col(unique_id)) % buckets


def sample_buckets(left: DataFrame, right: DataFrame, max_pairs: int, unique_id: str = "unique_id") -> int:
    """Number of hash buckets whose equal-bucket pairs are at least `max_pairs` (or all pairs): halved from
    `SPARE` times the pairs asked for until bucket sizes alone say that they suffice."""
    whole = left.count() * right.count()
    buckets = max(1, int(whole / (max_pairs * SPARE)))
    while buckets > 1:
        n_l = left.groupBy(_bucket(unique_id, buckets).alias("b")).agg(F.count("*").alias("n_l"))
        n_r = right.groupBy(_bucket(unique_id, buckets).alias("b")).agg(F.count("*").alias("n_r"))
        drawn = n_l.join(n_r, "b").agg(F.sum(pair_count(F.col("n_l"), F.col("n_r")))).first()[0]
        if (drawn or 0) >= max_pairs:
            break
        buckets //= 2
    return buckets


def random_pair_sample(
    left: DataFrame,
    right: DataFrame,
    max_pairs: int = 1_000_000,
    columns: Sequence[str] = (),
    unique_id: str = "unique_id",
) -> DataFrame:
    """Exactly `max_pairs` pairs (all, if there are fewer) drawn from left x right.

    Records of both sides are hashed into buckets and pairs meet when the buckets agree: an equi-join,
    repeatable because the hash is of the id, in which every record can be drawn.  Of these slightly
    too many pairs those with the smallest hash of both ids stay: a histogram of hashes, a bounded number of
    cells, tells the cell of the last one, and only that cell's pairs are sorted.  Ids are unique on
    each side; a null id cannot be drawn unless all pairs are asked for.  Left rows of a bucket are dealt over
    `STRIPS` copies of its right rows, so that few buckets do not mean few tasks.
    """
    if max_pairs <= 0:
        raise ValueError("max_pairs must be positive")
    needed = sorted({unique_id, *columns})
    buckets = sample_buckets(left, right, max_pairs, unique_id)
    strips = STRIPS if buckets < STRIPS else 1

    def drawn(names: Sequence[str]) -> DataFrame:
        a, b = sided(left, "_l", names), sided(right, "_r", names)
        if buckets > 1:
            a, b = a.withColumn("__bucket_l", _bucket(f"{unique_id}_l", buckets)), b.withColumn("__bucket_r", _bucket(f"{unique_id}_r", buckets))
        else:
            a, b = a.withColumn("__bucket_l", F.lit(0)), b.withColumn("__bucket_r", F.lit(0))
        a = a.withColumn("__strip_l", F.pmod(F.xxhash64(f"{unique_id}_l"), F.lit(strips)).cast("int"))
        b = b.withColumn("__strip_r", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
        met = a.join(b, (F.col("__bucket_l") == F.col("__bucket_r")) & (F.col("__strip_l") == F.col("__strip_r")))
        return met.drop("__bucket_l", "__bucket_r", "__strip_l", "__strip_r")

    pairs = drawn(needed)
    if left.count() * right.count() <= max_pairs:
        return pairs
    ids = [f"{unique_id}_l", f"{unique_id}_r"]
    mark = hash60(F.concat_ws("|", *[F.col(c).cast("string") for c in ids]))
    marked = drawn([unique_id]).select(mark.alias("mark"), *ids)
    cell = F.shiftright("mark", 60 - CELL_BITS)
    sizes = sorted(marked.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect())
    seen = 0
    for last, n in sizes:
        if seen + n >= max_pairs:
            break
        seen += n
    edge = marked.filter(cell == last).orderBy("mark", *ids).limit(max_pairs - seen)
    edge = edge.agg(F.max(F.struct("mark", *ids)).alias("top")).first()["top"]
    kept = F.struct(mark.alias("mark"), *ids) <= F.struct(F.lit(edge["mark"]), *[F.lit(edge[c]).cast(pairs.schema[c].dataType) for c in ids])
    return pairs.filter(kept)


def self_pairing(records: DataFrame, columns: Sequence[str], unique_id: str = "unique_id") -> DataFrame:
    """Every record beside itself; a projection, no join."""
    needed = sorted({unique_id, *columns})
    return records.select(
        *[F.col(c).alias(f"{c}_l") for c in needed], *[F.col(c).alias(f"{c}_r") for c in needed]
    )
