"""Intermediate tables that several branches or queries read, written once to shared storage.

Reading a file back costs a scan of a few narrow columns; repeating the plan would scan and parse the
whole texts again for every branch.  A lost executor costs nothing, and the file has real statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from linkwright.session import scratch_path

Made = TypeVar("Made")
_kept: dict[tuple, object] = {}
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())  # tables of each `discarding`, the innermost last


def stored(spark: SparkSession, frame: DataFrame, label: str, lasting: bool = False, **options: str) -> DataFrame:
    """`lasting`: kept when the innermost `discarding` ends."""
    path = scratch_path(spark, label)
    around = _passing.get()[: -1 if lasting else None]
    if around:
        around[-1].append(path)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query shuffles leaves the disk as soon as its rows are there."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def lean(spark: SparkSession, frame: DataFrame, label: str, lasting: bool = False, **options: str) -> DataFrame:
    """Like `stored`, without the shuffled files that Spark else keeps until the driver collects its garbage."""
    with swept(spark):
        return stored(spark, frame, label, lasting, **options)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """What is `stored` inside leaves the disk at the end, but for what is `lasting`.  Nothing that is read later may
    read the others."""
    tables: list[str] = []
    before = _passing.set((*_passing.get(), tables))
    try:
        yield
    finally:
        _passing.reset(before)
        for path in tables:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def once(spark: SparkSession, sf_dir: str, label: str, make: Callable[[], Made]) -> Made:
    """`make()` on first use in this application and for these tables, the same object afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _kept:
        before = _passing.set(())  # kept however short-lived what asks for it first
        try:
            _kept[key] = make()
        finally:
            _passing.reset(before)
    return _kept[key]  # type: ignore[return-value]


def forget() -> None:
    """Drop what earlier queries left behind, so that the next one is measured on its own."""
    _kept.clear()
