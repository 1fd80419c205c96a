"""The relationship graph, and how well the relatives of a pair match each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwright.operators.profiling import cell_counts
from linkwright.operators.spread import PAIRS_PER_TASK, spread_join, spread_lookup
from linkwright.plans.store import discarding, lean

# Up to this many (left relative, right relative) combinations a pair's relatives are simply combined.
SMALL_FAMILY = 400


def symmetric_edges(assertions: DataFrame, subject: str = "subject_id", object: str = "object_id") -> DataFrame:
    """(mention_id, relative_id) in both directions, each once."""
    forward = assertions.select(F.col(subject).alias("mention_id"), F.col(object).alias("relative_id"))
    backward = assertions.select(F.col(object).alias("mention_id"), F.col(subject).alias("relative_id"))
    return forward.unionByName(backward).distinct()


def relative_sets(edges: DataFrame) -> DataFrame:
    """(mention_id, relative_id, relatives): each mention's set of relatives, a row per member, with its
    size.  The same form for every size, so a hub is never one array."""
    sizes = edges.groupBy("mention_id").agg(F.count("*").alias("__n"))
    known = spread_lookup(edges, sizes.withColumnRenamed("__n", "relatives"), ["mention_id"], ["relative_id"], sizes=sizes)
    return known.select("mention_id", "relative_id", "relatives")


def relatives_lookup_join(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of relatives on each side, null when a record has none."""
    degree = edges.groupBy("mention_id").agg(F.count("*").alias("n"))
    left = degree.select(F.col("mention_id").alias("unique_id_l"), F.col("n").alias("relatives_l"))
    right = degree.select(F.col("mention_id").alias("unique_id_r"), F.col("n").alias("relatives_r"))
    return pairs.join(left, "unique_id_l", "left").join(right, "unique_id_r", "left")


def pair_probability_lookup(pairs: DataFrame, matches: DataFrame, left: str, right: str) -> DataFrame:
    """Probability of another pair by its two ids; pairs that are not candidates drop out."""
    found = matches.select(
        F.col("unique_id_l").alias(left), F.col("unique_id_r").alias(right), F.col("match_probability").alias("probability")
    ).filter(F.col("probability").isNotNull())
    return pairs.join(found, [left, right])


def _kept(frame: DataFrame) -> DataFrame:
    """Stored by columns, what it shuffled taken from the disk: a checkpoint holds a pair's ids and numbers as they
    are in memory."""
    return lean(frame.sparkSession, frame, "kin")


def relative_corroboration(
    matches: DataFrame, edges: DataFrame, small_family: int = SMALL_FAMILY, pairs_per_task: int = PAIRS_PER_TASK,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Add ``relatives_match_probability`` to (unique_id_l, unique_id_r, match_probability).

    For a pair (a, b): every relative x of a takes the best probability among the candidate pairs
    (x, y) with y a relative of b; the value is the mean over those x that have one.

    Three ways to reach the supporting pairs, chosen per pair by the work each would be:

    * few combinations: relatives of a times relatives of b, looked up among the matches;
    * otherwise the walk from a over its relatives to *their* candidate partners, kept where these are relatives
      of b; or the same walk from b.  A record's walk is made once, however many pairs it is in, and then met
      with these pairs.

    So a hub never meets a hub.  Ids with many pairs, many relatives or many partners are dealt over strips in
    every join (`spread`).  `edges` is symmetric and distinct; `matches` has one row per pair.  `wanted`: only pairs
    whose (unique_id_l, unique_id_r) it holds, strengthened by all `matches`.
    """
    spark, pair = matches.sparkSession, ["unique_id_l", "unique_id_r"]
    scored = every = matches.select(*pair, "match_probability")
    if wanted is not None:
        scored = lean(spark, every.join(wanted.select(*pair), pair, "left_semi"), "wanted")
    with discarding(spark):
        found = _support(scored, every, edges, small_family, pairs_per_task, wanted is not None)
        # dealt out by the pair once, for both steps
        best = found.repartition("l", "r").groupBy("l", "r", "x").agg(F.max("p").alias("p"))
        mean = best.groupBy("l", "r").agg(F.avg("p").alias("relatives_match_probability"))
        mean = lean(spark, mean.withColumnsRenamed({"l": "unique_id_l", "r": "unique_id_r"}), "corroboration", lasting=True)
    return scored.join(mean, pair, "left")


def _support(
    scored: DataFrame, every: DataFrame, edges: DataFrame, small_family: int, pairs_per_task: int, some: bool
) -> DataFrame:
    """(l, r, x, p): for the `scored` pairs, each relative x of l with the probabilities of its pairs with relatives of r.
    `some`: not all of the pairs are `scored`.  Each way is stored before the next, so that their shuffles do not lie on
    disk together."""
    usable = every.filter(F.col("match_probability").isNotNull())
    # Only relatives that are candidates on the right side of the linkage can support a pair.
    ids_l = usable.select(F.col("unique_id_l").alias("id")).distinct()
    ids_r = usable.select(F.col("unique_id_r").alias("id")).distinct()

    def kin(ids: DataFrame, who: str, relative: str) -> DataFrame:
        within = edges.join(ids.withColumnRenamed("id", "mention_id"), "mention_id", "left_semi")
        if some:
            within = within.join(scored.select(F.col(f"unique_id_{who}").alias("mention_id")), "mention_id", "left_semi")
        within = within.join(ids.withColumnRenamed("id", "relative_id"), "relative_id", "left_semi")
        return within.select(F.col("mention_id").alias(who), F.col("relative_id").alias(relative))

    # Each is read by several branches.
    kin_l, kin_r = _kept(kin(ids_l, "l", "x")), _kept(kin(ids_r, "r", "y"))
    known = usable.select(F.col("unique_id_l").alias("x"), F.col("unique_id_r").alias("y"), F.col("match_probability").alias("p"))
    if some:  # of the others nobody's relatives are
        known = _kept(known.join(kin_l.select("x"), "x", "left_semi").join(kin_r.select("y"), "y", "left_semi"))
    pairs = scored.select(F.col("unique_id_l").alias("l"), F.col("unique_id_r").alias("r"))
    number = pairs.count()

    def reach(family: DataFrame, who: str, via: str) -> DataFrame:
        """Per record: its relatives, and the candidate pairs that these are in."""
        partners = known.groupBy(via).agg(F.count("*").alias("__m"))
        met = spread_lookup(family, partners, [via], [who], rows_per_task=pairs_per_task)
        return met.groupBy(who).agg(F.count("*").alias(f"kin_{who}"), F.sum("__m").alias(f"walk_{who}"))

    per_r = pairs.groupBy("r").agg(F.count("*").alias("__n"))
    pairs = spread_lookup(pairs, reach(kin_l, "l", "x"), ["l"], ["r"], largest=number)
    pairs = spread_lookup(pairs, reach(kin_r, "r", "y"), ["r"], ["l"], sizes=per_r, largest=number)
    combined, shorter = F.col("kin_l") * F.col("kin_r"), F.least("walk_l", "walk_r")
    way = F.when((combined <= small_family) | (combined <= F.least(shorter, F.lit(1_000 * small_family))), "few")
    pairs = _kept(pairs.withColumn("way", way.when(F.col("walk_l") <= F.col("walk_r"), "left").otherwise("right")))
    work = {r["way"]: r for r in pairs.groupBy("way").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in ("kin_l", "walk_l", "walk_r")], F.sum(combined.cast("decimal(38,0)")).cast("double").alias("combined")
    ).collect()}
    parts = [known.select(F.lit(None).cast(scored.schema["unique_id_l"].dataType).alias("l"), F.lit(None).cast(scored.schema["unique_id_r"].dataType).alias("r"), "x", "p").limit(0)]
    if "few" in work:
        met = pairs.filter("way = 'few'").select("l", "r")
        rows, most = work["few"]["kin_l"], work["few"]["combined"]
        met = _looked_up(met, kin_l, ["l"], ["r"], number, pairs_per_task)
        met = _looked_up(met, kin_r, ["r"], ["l", "x"], rows, pairs_per_task)
        if most > pairs_per_task:
            # many pairs have the same relatives: these are looked up once
            met = _kept(met)
            near = _kept(known.join(_kept(met.select("x", "y").distinct()), ["x", "y"], "left_semi"))
        else:
            near = known
        parts.append(_kept(_looked_up(met, near, ["x", "y"], ["l", "r"], most, pairs_per_task, stored_already=True).select("l", "r", "x", "p")))
    for way, who, via, other, family, far in (("left", "l", "x", "r", kin_l, kin_r), ("right", "r", "y", "l", kin_r, kin_l)):
        if way not in work:
            continue
        own = pairs.filter(F.col("way") == way).select("l", "r")
        most = work[way][f"walk_{who}"]
        # every walk once: (who, x, y, p)
        starts = family.join(own.select(who).distinct(), who, "left_semi").withColumnRenamed(via, "__via")
        ways = known.withColumn("__pair", F.xxhash64("x", "y"))
        walk = spread_join(starts, ways, ["__via"], [via], who, "__pair", pairs_per_task=pairs_per_task, largest=int(min(most, 2.0**62)))
        walk = _kept(walk.select(F.col(who).alias("__who"), "x", "y", "p")).withColumn("__pair", F.xxhash64("x", "y"))
        met = spread_join(own, walk, [who], ["__who"], other, "__pair", pairs_per_task=pairs_per_task, largest=int(min(most, 2.0**62)))
        met = met.select("l", "r", "x", "y", "p")
        keys = ["r", "y"] if other == "r" else ["l", "x"]
        met = _looked_up(met, far, keys, [c for c in ("l", "r", "x", "y") if c not in keys], most, pairs_per_task, "left_semi")
        parts.append(_kept(met.select("l", "r", "x", "p")))
    return reduce(DataFrame.unionByName, parts)


def _looked_up(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_by: Sequence[str], most: float, rows_per_task: int, how: str = "inner",
    stored_already: bool = False,
) -> DataFrame:
    """`facts` beside the rows of `lookup`; stored first where `most` rows are enough for a heavy key, since a
    heavy key is found by counting.  Where there is none, both are shuffled once only."""
    if most > rows_per_task:
        facts = facts if stored_already else _kept(facts)
        heavy = _kept(facts.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > rows_per_task))
        if heavy.isEmpty():
            return facts.join(lookup, list(keys), how)
        return spread_lookup(facts, lookup, keys, spread_by, how, rows_per_task, sizes=heavy)
    return spread_lookup(facts, lookup, keys, spread_by, how, rows_per_task, largest=int(min(most, 2.0**62)))


def boosted_matches(corroborated: DataFrame) -> DataFrame:
    return corroborated.select("unique_id_l", "unique_id_r", "match_probability", "relatives_match_probability")


def corroborated_only(boosted: DataFrame, n: int | None = None) -> DataFrame:
    kept = boosted.na.drop(subset=["relatives_match_probability"])
    return kept if n is None else kept.orderBy("unique_id_l", "unique_id_r").limit(n)


def top_candidates_for_record(boosted: DataFrame, record_id: str, n: int = 10) -> DataFrame:
    """Best corroborated partners of one left record; ties broken by the partner's id.

    Sort keys are rounded so that the last bits of a mean cannot reorder equal values.
    """
    kept = corroborated_only(boosted).filter(F.col("unique_id_l") == record_id)
    order = [F.desc(F.round("match_probability", 9)), F.desc(F.round("relatives_match_probability", 9)), "unique_id_r"]
    return kept.orderBy(*order).limit(n)


def appearance_histogram(assertions: DataFrame, column: str) -> DataFrame:
    """How many ids appear n times in a column, with the mean appearances overall and among
    repeated ids on every row."""
    per_id = assertions.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("appearances"))
    bars = per_id.groupBy("appearances").agg(F.count("*").alias("ids"))
    # One row per distinct count: at most sqrt(2 * rows) of them.
    every = W.partitionBy(F.lit(1))
    weight, repeated = F.col("appearances") * F.col("ids"), F.col("appearances") > 1

    def mean(keep: Column) -> Column:
        return F.try_divide(F.sum(F.when(keep, weight)).over(every), F.sum(F.when(keep, F.col("ids"))).over(every))

    return bars.select(
        "appearances", "ids", mean(F.lit(True)).alias("mean_appearances"), mean(repeated).alias("mean_repeated")
    )


def predicate_by_source(assertions: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """(predicate, source, assertions, predicate_total) for every source there is, under its label where
    one is given; largest predicates first."""
    cells = cell_counts(assertions, "predicate", "who").withColumnRenamed("n", "assertions")
    totals = cells.groupBy("predicate").agg(F.sum("assertions").alias("predicate_total"))
    source = F.col("who")
    for who, label in (labels or {}).items():
        source = F.when(F.col("who") == who, F.lit(label)).otherwise(source)
    table = cells.join(totals, "predicate").select("predicate", source.alias("source"), "assertions", "predicate_total")
    return table.orderBy(F.desc("predicate_total"), "predicate", F.desc("assertions"), "source")


def source_shares(assertions: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Assertions and share per source, with display labels where given."""
    known = assertions.filter(F.col("who").isNotNull())
    counts = known.groupBy("who").agg(F.count("*").alias("assertions"))
    label = F.col("who")
    for source, text in (labels or {}).items():
        label = F.when(F.col("who") == source, F.lit(text)).otherwise(label)
    share = F.col("assertions") / known.agg(F.count("*")).scalar()
    return counts.select("who", label.alias("label"), "assertions", share.alias("share"))
