"""Linkage inputs derived from the tables at hand.

`documents` plays the register: even ids are the earlier year, odd ids the later one.  It holds real
exact and near copies, hence real matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.prepare import clean_records, derive_record_ids, split_by_year
from linkwright.operators.spread import spread_lookup
from linkwright.plans.store import once, stored

YEARS = (1870, 1880)
SOURCES = ("SRC_1870", "SRC_1880")
UNUSED = ("source", "confidence", "race", "occupation", "first_name", "last_name", "row_order")
PREDICATES = ("child_of", "spouse_of", "sibling_of", "lodges_with")
LEADING_WORD = r"^\W*(\w+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_end_words(documents: DataFrame) -> DataFrame:
    """Add the first and the last word of the text, null when there is none.

    The last word is the first one of the reversed text: an anchored pattern stops at once, where one
    anchored at the end would be tried from every position.
    """
    found = documents.withColumns(
        {
            "first_word": F.regexp_extract("text", LEADING_WORD, 1),
            "last_word": F.reverse(F.regexp_extract(F.reverse("text"), LEADING_WORD, 1)),
        }
    )
    return found.withColumns({w: F.when(F.col(w) != "", F.col(w)) for w in ("first_word", "last_word")})


def _year() -> Column:
    return F.when(F.col("doc_id") % 2 == 0, F.lit(YEARS[0])).otherwise(F.lit(YEARS[1]))


def _unless(divisor: int, value: Column) -> Column:
    return F.when(F.col("doc_id") % divisor != 0, value)


def record_id(doc_id: Column) -> Column:
    year = F.when(doc_id % 2 == 0, F.lit(str(YEARS[0]))).otherwise(F.lit(str(YEARS[1])))
    return F.concat(F.lit("DOC-"), year, F.lit("-"), doc_id.cast("string"))


def raw_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All appearances, with the flaws real registers have: missing values, repeated ids, a source
    that does not belong."""
    documents = table(spark, sf_dir, "documents")
    copies = F.when(F.col("doc_id") % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    named = _with_end_words(documents).select(
        "doc_id", "lang", "source", "n_chars", "first_word", "last_word",
        F.contains("text", F.lit("\n")).alias("broken"),
    ).withColumn("copy", F.explode(copies))
    return named.select(
        record_id(F.col("doc_id")).alias("mention_id"),
        F.when(F.col("doc_id") % 31 == 0, F.lit("SRC_OTHER"))
        .otherwise(F.concat(F.lit("SRC_"), _year().cast("string")))
        .alias("source"),
        _year().alias("source_year"),
        _unless(17, F.col("n_chars")).cast("int").alias("birth_year"),
        F.col("first_word").alias("first_name"),
        F.when(F.col("copy") == 1, F.lit("copy")).otherwise(_unless(3, F.col("lang"))).alias("middle_name"),
        F.col("last_word").alias("last_name"),
        _unless(19, F.upper("first_word")).alias("norm_first_name"),
        F.upper("last_word").alias("nysiis_last_name"),
        F.col("lang").alias("race"),
        _unless(23, F.col("lang")).alias("norm_race"),
        F.when(F.col("broken"), F.lit("M")).otherwise(F.lit("F")).alias("gender"),
        F.col("source").alias("occupation"),
        F.upper("source").alias("norm_occupation"),
        F.lit(0.9).alias("confidence"),
        (F.col("doc_id") * 2 + F.col("copy")).alias("row_order"),
    )


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two cleaned sides, stored: blocking, training and sizing read them many times, the texts
    behind them once."""

    def make() -> tuple[DataFrame, DataFrame]:
        cleaned = clean_records(raw_mentions(spark, sf_dir), SOURCES, ["row_order"], UNUSED)
        return split_by_year(stored(spark, cleaned, "records"), *YEARS)

    return once(spark, sf_dir, "records", make)


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First word, last word and text digest of every document, stored."""
    words = _with_end_words(table(spark, sf_dir, "documents")).select(
        "doc_id", "lang", "source", "n_chars", (F.col("doc_id") % 2).cast("int").alias("side"),
        F.upper("first_word").alias("first"), F.upper("last_word").alias("last"),
        F.md5("text").alias("text_hash"), F.contains("text", F.lit("\n")).alias("broken"),
    )
    return once(spark, sf_dir, "words", lambda: stored(spark, words, "words"))


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record is tied to the head (smallest id) of its first-word and of its last-word group
    within language and side.  Stored, as the file it stands for."""
    words = _worded(spark, sf_dir)

    def ties(word: str, predicate: Column) -> DataFrame:
        keys = ["lang", "side", word]
        members = words.filter(F.col(word).isNotNull()).select("doc_id", "source", *keys)
        heads = members.groupBy(*keys).agg(F.min("doc_id").alias("head"))
        tied = spread_lookup(members, heads, keys, ["doc_id"]).filter("doc_id <> head")
        return tied.select(
            record_id(F.col("doc_id")).alias("subject_id"),
            record_id(F.col("head")).alias("object_id"),
            predicate.alias("predicate"),
            F.col("source").alias("who"),
        )

    by_first = F.element_at(F.array(*[F.lit(p) for p in PREDICATES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return once(
        spark,
        sf_dir,
        "assertions",
        lambda: stored(spark, ties("first", by_first).unionByName(ties("last", F.lit("kin_of"))), "assertions"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded pairs, each record used at most once per side.  Stored, as the file it stands for.

    Groups of alike records name one pair each, their smallest ids: 3 same text, 2 same first and
    last word, 1 same language and first word, 0 alike in language, layout and length only.
    """
    words = _worded(spark, sf_dir)

    def named(grade: int, *keys: Column) -> DataFrame:
        low = [F.min(F.when(F.col("side") == s, F.col("doc_id"))) for s in (0, 1)]
        pairs = words.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(low[0].alias("l"), low[1].alias("r"))
        return pairs.filter("l is not null and r is not null").select("l", "r", F.lit(grade).alias("confidence"))

    first, last, lang = F.col("first"), F.col("last"), F.col("lang")
    pairs = (
        named(3, F.col("text_hash"))
        .unionByName(named(2, first, last))
        .unionByName(named(1, lang, first))
        .unionByName(named(0, lang, F.col("broken"), F.floor(F.col("n_chars") / 6)))
    )
    per_left = pairs.groupBy("l").agg(F.max(F.struct("confidence", -F.col("r"))).alias("best"))
    per_left = per_left.select("l", (-F.col("best.col2")).alias("r"), F.col("best.confidence").alias("confidence"))
    per_right = per_left.groupBy("r").agg(F.max(F.struct("confidence", -F.col("l"))).alias("best"))
    graded = per_right.select(
        (-F.col("best.col2")).alias("1870_line"),
        F.col("r").alias("1880_line"),
        (75 + 105 * (-F.col("best.col2") / 2 % 5)).cast("int").alias("score"),
        F.col("best.confidence").alias("confidence"),
    )
    return once(spark, sf_dir, "truth", lambda: stored(spark, graded, "truth"))


def truth_with_ids(truth: DataFrame) -> DataFrame:
    return derive_record_ids(
        truth, {"1870_line": ("DOC-1870-", "id_1870"), "1880_line": ("DOC-1880-", "id_1880")}
    )
