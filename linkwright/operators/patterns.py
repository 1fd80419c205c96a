"""How many pairs of a block show each agreement pattern, without forming the pairs of records.

Training needs only the number of pairs per pattern, yet a training block such as "same gender"
holds half of all pairs.  Counting goes through keys instead.  For one comparison, every value
sends out a few keys with a class:

* ``*``            any value, missing ones too;
* ``#``            any value that is present;
* ``^P``           values starting with P, when the comparison has a prefix level;
* ``=w``           each value w close enough for one of the closest levels (equal values, numbers
                   within the tolerance, words within the edit distance).

The other side sends ``*``, ``#``, its own prefix and its own value.  Words fan out on the right and all
else on the left, so that no value combination is multiplied by both.  Both sides are first reduced to
distinct value combinations with a row count and then to distinct key combinations, so one equi-join
on unique keys followed by a sum of products yields the pairs per class combination.  Classes
overlap, and the overlap is undone on that small table: a pair whose words are one letter apart also
met under ``*``, ``#`` and maybe ``^P``, hence its ``=`` class adds one to its own level and takes one
from the level the wider classes had put it in.

The cost grows with the number of distinct value combinations times a constant, never with the square
of a block, and no key can be heavy in the join because keys are unique on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.functions.scalars import PAIR_COUNT, pair_count
from linkwright.operators.blocking import BlockRule, block_pairs
from linkwright.operators.comparison import ELSE_LEVEL, NULL_LEVEL, Comparison, gamma_vectors, input_columns
from linkwright.operators.spread import spread_lookup
from linkwright.session import cut_lineage

# Roughly how many keys one value combination sends out: tolerance x prefix x close words.
KEYS_PER_TUPLE = 2_000
ENUMERABLE = ("equal", "within", "edit")


def countable(comparison: Comparison) -> bool:
    """Levels of one enumerable kind, optionally followed by a single prefix level."""
    kinds = [level.kind for level in comparison.levels]
    close = [k for k in kinds if k != "prefix"]
    return (
        all(k in ENUMERABLE for k in close)
        and len(set(close)) == 1
        and kinds.count("prefix") <= 1
        and ("prefix" not in kinds or (kinds[-1] == "prefix" and close[0] == "edit"))
    )


def _prefix_length(comparison: Comparison) -> int | None:
    return next((level.amount for level in comparison.levels if level.kind == "prefix"), None)


def _base(comparison: Comparison) -> int:
    """Level of a pair known only to share the prefix."""
    return next((comparison.gamma_of(x) for x in comparison.levels if x.kind == "prefix"), ELSE_LEVEL)


def close_words(left_words: DataFrame, right_words: DataFrame, limit: int) -> DataFrame:
    """(word_l, word_r, distance) of distinct words at edit distance `limit` or less.

    A right word is cut into `limit + 1` segments of even length.  At least one of them is untouched by
    `limit` edits, so it stands in the left word, moved by at most `limit` places; the left word offers what
    it holds there, for each length the right word may have.  Both send a number of short keys that
    depends on `limit` only; the distance is then checked.
    """

    def distinct(words: DataFrame, name: str) -> DataFrame:
        return words.select(F.col(words.columns[0]).alias(name)).filter(F.col(name).isNotNull()).distinct()

    parts = limit + 1

    def segment(length: str) -> tuple[str, str]:
        """Start and size of segment i of a word of that length: the last ones take what is over."""
        return f"(i * ({length} div {parts}) + greatest(0, i - {parts} + {length} % {parts}))", (
            f"({length} div {parts} + if(i >= {parts} - {length} % {parts}, 1, 0))"
        )

    start, size = segment("length(word_r)")
    own = F.expr(
        f"explode(transform(sequence(0, {limit}), i -> struct(length(word_r) as size, i as part,"
        f" substring(word_r, cast({start} as int) + 1, cast({size} as int)) as segment)))"
    )
    start, size = segment("n")
    offered = F.expr(
        f"""explode(array_distinct(flatten(flatten(transform(
            sequence(greatest(0, length(word_l) - {limit}), length(word_l) + {limit}), n -> transform(
                sequence(0, {limit}), i -> transform(
                    filter(sequence(-{limit}, {limit}), d -> {start} + d >= 0 and {start} + d + {size} <= length(word_l)),
                    d -> struct(n as size, i as part,
                                substring(word_l, cast({start} + d as int) + 1, cast({size} as int)) as segment))))))))"""
    )
    a = distinct(left_words, "word_l").select("word_l", offered.alias("key"))
    b = distinct(right_words, "word_r").select("word_r", own.alias("key"))
    # Spark sizes a table by its file and so knows nothing of rows unfolded here: unhinted, it may send
    # a whole side through the driver.
    pairs = a.join(b.hint("merge"), "key")
    pairs = pairs.filter(F.abs(F.length("word_l") - F.length("word_r")) <= limit).select("word_l", "word_r").distinct()
    measured = pairs.withColumn("distance", F.levenshtein("word_l", "word_r", limit))
    return measured.filter(F.col("distance") >= 0)


def _class_of(comparison: Comparison, distance: Column, same_prefix: Column) -> Column:
    """Class text ``=<gamma>`` plus ``s`` when the prefix level would have held as well."""
    chain = None
    for level in comparison.levels:
        if level.kind == "prefix":
            continue
        reached = distance <= level.amount
        text = F.lit(f"={comparison.gamma_of(level)}")
        chain = F.when(reached, text) if chain is None else chain.when(reached, text)
    return F.concat(chain, F.when(same_prefix, F.lit("s")).otherwise(F.lit("")))


def _key_class(key: Column, kind: Column) -> Column:
    return F.struct(key.alias("key"), kind.alias("kind"))


def _wide_classes(comparison: Comparison, value: Column) -> Column:
    """The ``*``, ``#`` and ``^P`` classes of a value as an array."""
    text = value.cast("string")
    present = [_key_class(F.lit("#"), F.lit("#"))]
    length = _prefix_length(comparison)
    if length is not None:
        present.append(_key_class(F.concat(F.lit("^"), F.substring(text, 1, length)), F.lit("^")))
    anything = F.array(_key_class(F.lit("*"), F.lit("*")))
    return F.when(value.isNull(), anything).otherwise(F.concat(anything, F.array(*present)))


def _send_far(tuples: DataFrame, comparison: Comparison, words: DataFrame | None = None) -> DataFrame:
    """Replace the comparison's column by its keys and classes, one row per distinct combination.

    `words` are (own, other, distance) of close words.

    Rows of the wide classes share few keys and are added up; those sent to close words seldom
    coincide and go on as they are.
    """
    value = F.col(comparison.column)
    kind = comparison.levels[0].kind
    wide = _wide_classes(comparison, value)
    own = F.concat(F.lit("="), value.cast("string"))
    if kind == "edit":
        length = _prefix_length(comparison)
        shared = (
            F.substring("own", 1, length) == F.substring("other", 1, length) if length is not None else F.lit(False)
        )
        links = words.select(
            F.col("own").alias(comparison.column),
            _key_class(
                F.concat(F.lit("="), F.col("other")), _class_of(comparison, F.col("distance"), shared)
            ).alias("__sent"),
        )
        others = [c for c in tuples.columns if c != comparison.column]
        close = spread_lookup(tuples, links, [comparison.column], others, merge=True)
        near = _spread_out(close, comparison)
        return _added_up(_spread_out(tuples.withColumn("__sent", F.explode(wide)), comparison)).unionByName(near)
    if kind == "equal":
        near = F.array(_key_class(own, F.lit(f"={comparison.gamma_of(comparison.levels[0])}")))
    else:
        reach = max(level.amount for level in comparison.levels)
        near = F.transform(
            F.sequence(F.lit(-reach), F.lit(reach)),
            lambda d: _key_class(
                F.concat(F.lit("="), (value.cast("bigint") + d).cast("string")),
                _class_of(comparison, F.abs(d), F.lit(False)),
            ),
        )
    sent = tuples.withColumn("__sent", F.explode(F.when(value.isNull(), wide).otherwise(F.concat(wide, near))))
    return _added_up(_spread_out(sent, comparison))


def _spread_out(sent: DataFrame, comparison: Comparison) -> DataFrame:
    named = {f"key_{comparison.key}": F.col("__sent.key"), f"class_{comparison.key}": F.col("__sent.kind")}
    return sent.withColumns(named).drop("__sent", comparison.column)


def _added_up(frame: DataFrame) -> DataFrame:
    return frame.groupBy(*[c for c in frame.columns if c != "__n"]).agg(F.sum("__n").alias("__n"))


def _send_own(tuples: DataFrame, comparison: Comparison) -> DataFrame:
    """Replace the comparison's column by the keys of its own value, to be met by the other side's."""
    value = F.col(comparison.column)
    wide = F.transform(_wide_classes(comparison, value), lambda c: c["key"])
    own = F.array(F.concat(F.lit("="), value.cast("string")))
    keys = F.when(value.isNull(), wide).otherwise(F.concat(wide, own))
    return _added_up(tuples.withColumn(f"key_{comparison.key}", F.explode(keys)).drop(comparison.column))


def _corrections(comparison: Comparison) -> Column:
    """Class to signed levels, as a map expression over a table of at most a few hundred rows."""
    base = _base(comparison)
    moves = {"*": [(NULL_LEVEL, 1)], "#": [(NULL_LEVEL, -1), (ELSE_LEVEL, 1)], "^": [(ELSE_LEVEL, -1), (base, 1)]}
    for level in comparison.levels:
        if level.kind != "prefix":
            g = comparison.gamma_of(level)
            moves[f"={g}"] = [(ELSE_LEVEL, -1), (g, 1)]
            moves[f"={g}s"] = [(base, -1), (g, 1)]
    entries = []
    for name, signed in moves.items():
        entries.append(F.lit(name))
        entries.append(F.array(*[F.struct(F.lit(g).alias("gamma"), F.lit(s).alias("sign")) for g, s in signed]))
    return F.create_map(*entries)


def _tuples(records: DataFrame, columns: Sequence[str], present: Sequence[str]) -> DataFrame:
    """Distinct value combinations with their number of records."""
    for column in present:
        records = records.filter(F.col(column).isNotNull())
    return records.groupBy(*columns).agg(F.count("*").alias("__n"))


def _pairs(wide: bool) -> Column:
    """Sum of products of the two row counts, in bigint arithmetic where all pairs together fit."""
    a, b = F.col("__n_l"), F.col("__n_r")
    return F.sum(pair_count(a, b) if wide else a * b).cast(PAIR_COUNT)


def _by_keys(a: DataFrame, b: DataFrame, block: Sequence[str], comparisons: Sequence[Comparison], wide: bool) -> DataFrame:
    # A blocked column that is also compared is needed twice: as join key and as compared value.
    held = {c: f"__block_{c}" for c in block}
    spent = [c for c in block if c not in input_columns(comparisons)]
    a, b = (side.withColumns({new: F.col(old) for old, new in held.items()}).drop(*spent) for side in (a, b))
    # Each comparison uses its column up, so each has one of its own.
    copies = {f"__compared_{c.key}": F.col(c.column) for c in comparisons}
    a, b = (side.withColumns(copies).drop(*input_columns(comparisons)) for side in (a, b))
    comparisons = [replace(c, column=f"__compared_{c.key}", name=c.key) for c in comparisons]
    # Words last: they fan out most, and what comes before has been added up by then.
    ordered = sorted(comparisons, key=lambda c: c.edit_limit is not None)
    keys = list(held.values()) + [f"key_{c.key}" for c in comparisons]
    classes = [f"class_{c.key}" for c in comparisons]
    for comparison in ordered:
        if comparison.edit_limit is not None:
            met = [k for k in keys if k in a.columns]
            if met:
                a, b = cut_lineage(a), cut_lineage(b)
                # A combination of earlier keys that the right side lacks cannot meet anything.
                a = cut_lineage(spread_lookup(a, b.select(*met).distinct(), met, [comparison.column], "left_semi", merge=True))
            words = close_words(a.select(comparison.column), b.select(comparison.column), comparison.edit_limit)
            words = cut_lineage(words.select(F.col("word_r").alias("own"), F.col("word_l").alias("other"), "distance"))
            # Words fan out on the right, tolerances on the left: the two add up instead of multiplying.
            a, b = _send_own(a, comparison), _send_far(b, comparison, words)
        else:
            a, b = _send_far(a, comparison), _send_own(b, comparison)
    # Both sides are unfolded far beyond what Spark expects of them (see `close_words`).
    met = a.withColumnRenamed("__n", "__n_l").join(b.withColumnRenamed("__n", "__n_r").hint("merge"), keys)
    counted = met.groupBy(*classes).agg(_pairs(wide).alias("pairs"))
    for comparison in comparisons:
        counted = (
            counted.withColumn("__move", F.explode(F.element_at(_corrections(comparison), F.col(f"class_{comparison.key}"))))
            .withColumn(comparison.gamma, F.col("__move.gamma"))
            .withColumn("pairs", (F.col("pairs") * F.col("__move.sign")).cast(PAIR_COUNT))
            .drop("__move", f"class_{comparison.key}")
        )
    gammas = [c.gamma for c in comparisons]
    return counted.groupBy(*gammas).agg(F.sum("pairs").cast(PAIR_COUNT).alias("pairs")).filter("pairs <> 0")


def _by_tuples(a: DataFrame, b: DataFrame, block: BlockRule, comparisons: Sequence[Comparison], wide: bool) -> DataFrame:
    """Pairs of distinct value combinations, each weighted by its record pairs."""
    columns = a.columns
    marked = [side.withColumn("unique_id", F.xxhash64(*columns)) for side in (a, b)]
    pairs = block_pairs(marked[0], marked[1], block, columns)
    gammas = gamma_vectors(pairs, comparisons, ["__n_l", "__n_r"])
    return gammas.groupBy(*[c.gamma for c in comparisons]).agg(_pairs(wide).alias("pairs"))


def _few_partners(a: DataFrame, b: DataFrame, block: Sequence[str]) -> bool:
    """Whether pairing value combinations inside blocks is less work than sending keys."""
    per_block = [side.groupBy(*block).agg(F.count("*").alias(n)) for side, n in ((a, "t_l"), (b, "t_r"))]
    sizes = per_block[0].join(per_block[1], list(block)).agg(
        F.sum(F.col("t_l").cast("double") * F.col("t_r")).alias("pairs"), F.sum(F.col("t_l") + F.col("t_r")).alias("tuples")
    ).first()
    return (sizes["pairs"] or 0) <= KEYS_PER_TUPLE * (sizes["tuples"] or 0)


def _plain_numbers(a: DataFrame, b: DataFrame, comparisons: Sequence[Comparison]) -> tuple[DataFrame, DataFrame, bool]:
    """Compared columns under one type on both sides, so that equal values send equal keys.

    Whole numbers of a fractional type become bigints; the flag tells whether a fractional value is left,
    which has no neighbours that could be listed as keys.
    """
    listed = True
    for column in input_columns(comparisons):
        kinds = [side.schema[column].dataType for side in (a, b)]
        common = a.select(column).limit(0).union(b.select(column).limit(0)).schema[column].dataType
        if isinstance(common, (T.DoubleType, T.FloatType, T.DecimalType)):
            value = F.col(column)
            odd = F.isnan(value.cast("double")) | (value != F.floor(value)) | (F.abs(value) >= 2**53)
            if any(side.filter(odd).limit(1).count() for side in (a, b)):
                listed = listed and not any(c.column == column and c.levels[0].kind == "within" for c in comparisons)
            else:
                common = T.LongType()
        if any(kind != common for kind in kinds):
            a, b = (_added_up(side.withColumn(column, F.col(column).cast(common))) for side in (a, b))
    return a, b, listed


def pattern_counts(
    left: DataFrame,
    right: DataFrame,
    comparisons: Sequence[Comparison],
    block: BlockRule = BlockRule(),
    sql_columns: Sequence[str] = (),
    by_keys: bool | None = None,
) -> DataFrame:
    """(gamma..., pairs) over all left x right pairs satisfying the block.

    Value combinations are paired directly while a block offers each of them few partners; beyond
    that, and without a block, counting goes through keys.  `by_keys` overrides the choice.
    `sql_columns` names columns that SQL levels read beyond the comparison's own.
    """
    countable_here = block.keyed and not block.within and not block.rest and all(countable(c) for c in comparisons)
    columns = sorted({*block.columns(), *input_columns(comparisons), *sql_columns})
    a, b = _tuples(left, columns, block.equal), _tuples(right, columns, block.equal)
    if block.equal or any(c.edit_limit is not None for c in comparisons):
        # The choice of method and several branches after it read them again.
        a, b = cut_lineage(a), cut_lineage(b)
    wide = left.count() * right.count() >= 2**62
    if by_keys is None or by_keys:
        a, b, listed = _plain_numbers(a, b, comparisons)
        countable_here = countable_here and listed
        if by_keys and not countable_here:
            raise ValueError("these comparisons cannot be counted by keys")
    if by_keys is None:
        by_keys = countable_here and (not block.equal or not _few_partners(a, b, block.equal))
    if by_keys:
        return _by_keys(a, b, block.equal, comparisons, wide)
    if not (block.equal or block.within or block.sql or block.alternatives):
        raise ValueError("these levels need a block: pairing everything with everything is not planned")
    return _by_tuples(a, b, block, comparisons, wide)
