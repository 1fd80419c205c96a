"""Tables that line dedup and near-duplicates make on the way: how many rows, and what is left on disk."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkwright.llm import fuzzy_lines, neardup
from linkwright.llm.common import stored
from linkwright.plans.store import discarding, once
from linkwright.session import shared_dir


def tables(spark):
    return {p for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if (p / "_SUCCESS").exists()}


def test_lists_of_two_keep_one_member(spark):
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(words), " ".join(words[:29] + ["other"])]  # in lists of two, unless a third is in them
    lines = spark.createDataFrame(list(enumerate(texts)), "node bigint, norm string").withColumn("size", F.length("norm"))
    signed = fuzzy_lines._all(fuzzy_lines._signatures(fuzzy_lines._counted(lines)))
    found = fuzzy_lines._postings(signed).collect()
    assert found and all((r.node, r.leader, r.long) == (1, 0, False) for r in found)
    third = lines.unionByName(lines.filter("node = 1").withColumn("node", F.lit(2).cast("bigint")))
    signed = fuzzy_lines._all(fuzzy_lines._signatures(fuzzy_lines._counted(third)))
    members = {}
    for r in fuzzy_lines._postings(signed).collect():
        members.setdefault((r.key, r.long), set()).add((r.node, r.leader))
    assert {True, False} >= {long for _, long in members}
    assert {frozenset(x) for (_, long), x in members.items() if long} == {frozenset({(0, 0), (1, 0), (2, 0)})}


def test_tables_discarded(spark):
    before = tables(spark)
    numbers = spark.range(5)
    with discarding(spark):
        stored(numbers, "passing")
        with discarding(spark):
            inner = stored(numbers, "passing")
            middle = stored(inner, "passing", lasting=True)
        assert middle.count() == 5
        last = stored(middle, "passing", lasting=True)
        held = once(spark, "nowhere", "held", lambda: stored(numbers, "held"))
    assert last.count() == held.count() == 5
    assert len(tables(spark) - before) == 2
    with pytest.raises(ZeroDivisionError), discarding(spark):
        stored(numbers, "passing")
        1 / 0
    assert len(tables(spark) - before) == 2


def test_stages_leave_what_their_rows_need(spark):
    line = "the quick brown fox jumps over the lazy dog and runs away from it all the way"
    rows = [(i, f"{line} {i}\nline of its own {i * 7919}") for i in range(12)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    for stage in (fuzzy_lines.deduplicate, neardup.one_of_each):
        before = tables(spark)
        kept = stage(documents)
        assert len(tables(spark) - before) == 1
        assert kept.collect()
