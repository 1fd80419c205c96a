"""Comparisons: ordered agreement levels between the two records of a pair.

A comparison yields ``gamma``: -1 when either value is missing, otherwise the number of the first
level that holds, counted down from the closest, and 0 when none holds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_LEVEL = -1
ELSE_LEVEL = 0


@dataclass(frozen=True)
class Level:
    """One agreement level: ``equal``, ``within`` (numeric difference), ``edit`` (edit distance),
    ``prefix`` (leading characters) or ``sql`` (a condition over ``_l``/``_r`` columns)."""

    kind: str
    amount: int = 0
    condition: str = ""
    title: str = ""

    @property
    def label(self) -> str:
        if self.title:
            return self.title
        if self.kind == "sql":
            return self.condition
        return "equal" if self.kind == "equal" else f"{self.kind} {self.amount}"


def equal() -> Level:
    return Level("equal")


def within(amount: int) -> Level:
    return Level("within", amount)


def edit(amount: int) -> Level:
    return Level("edit", amount)


def prefix(amount: int) -> Level:
    return Level("prefix", amount)


def sql_level(condition: str, title: str = "") -> Level:
    return Level("sql", condition=condition, title=title)


@dataclass(frozen=True)
class Comparison:
    column: str
    levels: tuple[Level, ...]
    name: str = ""

    @property
    def key(self) -> str:
        return self.name or self.column

    @property
    def gamma(self) -> str:
        return f"gamma_{self.key}"

    def gamma_of(self, level: Level) -> int:
        return len(self.levels) - self.levels.index(level)

    def level_labels(self) -> dict[int, str]:
        """Level number to label, closest first, without the null level."""
        labels = {self.gamma_of(level): level.label for level in self.levels}
        labels[ELSE_LEVEL] = "all other"
        return labels

    @property
    def edit_limit(self) -> int | None:
        limits = [level.amount for level in self.levels if level.kind == "edit"]
        return max(limits) if limits else None

    def edit_column(self) -> Column | None:
        """Edit distance up to the largest level, -1 beyond; equal values skip the computation."""
        if self.edit_limit is None:
            return None
        a, b = F.col(f"{self.column}_l"), F.col(f"{self.column}_r")
        return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b, self.edit_limit))

    def gamma_column(self) -> Column:
        a, b = F.col(f"{self.column}_l"), F.col(f"{self.column}_r")
        chain = F.when(a.isNull() | b.isNull(), F.lit(NULL_LEVEL))
        for level in self.levels:
            if level.kind == "equal":
                test = a == b
            elif level.kind == "within":
                test = F.abs(a - b) <= level.amount
            elif level.kind == "edit":
                test = F.col(f"__edit_{self.key}").between(0, level.amount)
            elif level.kind == "prefix":
                test = F.substring(a, 1, level.amount) == F.substring(b, 1, level.amount)
            else:
                test = F.expr(level.condition)
            chain = chain.when(test, F.lit(self.gamma_of(level)))
        return chain.otherwise(F.lit(ELSE_LEVEL)).cast("int")


def comparison_birth_year(column: str = "birth_year") -> Comparison:
    return Comparison(column, (within(0), within(1), within(2), within(5)))


def comparison_first_name(column: str = "norm_first_name") -> Comparison:
    """One letter apart outranks the shared initial, so the order of levels matters."""
    return Comparison(column, (edit(0), edit(1), edit(2), prefix(1)))


def comparison_exact(column: str) -> Comparison:
    return Comparison(column, (equal(),))


def comparison_custom(column: str, levels: Sequence[tuple[str, str]], name: str = "") -> Comparison:
    """`levels`: (condition over ``_l``/``_r`` columns, label), closest first.

    Equality, ``abs(..) <= k``, ``levenshtein(..) <= k`` and equal leading characters of the column are
    recognised, so that they can be counted; any other text stays SQL.
    """
    known = [_recognised(column, condition, label) for condition, label in levels]
    kinds = {level.kind for level in known}
    # equality is the closest of the kind beside it
    same = "within" if "within" in kinds else "edit" if "edit" in kinds else "equal"
    known = [replace(level, kind=same) if level.kind == "equal" else level for level in known]
    for place, level in enumerate(known):
        exact = level.kind == "edit" and level.condition == "="
        if exact and level.amount and not (place and known[place - 1].kind == "edit" and known[place - 1].amount == level.amount - 1):
            known[place] = sql_level(*levels[place])  # smaller distances would not have been taken before
    return Comparison(column, tuple(level if level.kind == "sql" else replace(level, condition="") for level in known), name)


def _recognised(column: str, condition: str, label: str) -> Level:
    a, b = rf"{column}_l", rf"{column}_r"
    text = re.sub(r"\s+", "", condition)
    forms = (
        ("equal", rf"{a}={b}"),
        ("within", rf"abs\({a}-{b}\)<=(?P<k>\d+)"),
        ("edit", rf"levenshtein\({a},{b}\)(?P<sign><?=)(?P<k>\d+)"),
        ("prefix", rf"substr(?:ing)?\({a},1,(?P<k>\d+)\)=substr(?:ing)?\({b},1,(?P=k)\)"),
    )
    for kind, form in forms:
        found = re.fullmatch(form, text, re.I)
        if found:
            parts = found.groupdict()
            return Level(kind, int(parts.get("k") or 0), parts.get("sign", "") or "", label or condition)
    return sql_level(condition, label)


def input_columns(comparisons: Sequence[Comparison]) -> list[str]:
    return list(dict.fromkeys(c.column for c in comparisons))


def gamma_vectors(pairs: DataFrame, comparisons: Sequence[Comparison], keep: Sequence[str]) -> DataFrame:
    """`keep` columns plus one gamma per comparison.

    Edit distances are computed once, in a projection of their own, because several levels read them.
    The levels leave through a one-row `inline`: a later filter on the score would otherwise be
    rewritten in terms of the inputs and moved into the join, computing every level many times over.
    """
    distances = {f"__edit_{c.key}": c.edit_column() for c in comparisons if c.edit_limit is not None}
    measured = pairs.withColumns(distances) if distances else pairs
    levels = F.struct(*[c.gamma_column().alias(c.gamma) for c in comparisons])
    return measured.select(*keep, F.inline(F.array(levels)))
