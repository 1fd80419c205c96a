"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

All of it is Spark SQL inside one projection per document: no shuffle, no Python.  Patterns are written so
that Java's engine reads each character a bounded number of times: possessive quantifiers where giving
characters back cannot help, and a match may only begin where a run begins or where the last match ended.

The score reads `CONTEXT` characters on both sides of a match, other matches included.  Beside the base kinds
there are account numbers, social security numbers, and secrets: long mixed values given to a name such as token or
password, and key formats that name themselves.

Positions are code points, end exclusive.  Null and empty texts have no spans; texts of any length are read
whole; repeated rows are answered one by one; spans that begin together come in the order of kinds.  Columns of
other names pass through `detect` and `redact`; one that has the name of the result is an error, not overwritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40  # characters read on each side of a match

# Fixed values of the contract: the first four kinds and their patterns, in order.  The others are this operator's own.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
BASE = KINDS[:4]

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # a value after the name it is given to, keys that name themselves, and what opens a private key
    "secret": (
        r"(?<=(?:key|oken|ecret|assword|asswd|KEY|OKEN|ECRET|ASSWORD|ASSWD)[\x22']?\x20?[=:]\x20?[\x22']?)[A-Za-z0-9+/_.=-]{16,}+"
        r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)"
        r"|-----BEGIN\x20(?:[A-Z]+\x20){0,2}PRIVATE\x20KEY-----"
    ),
}

# A cheap test that every match passes, so that most texts skip the search.
HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "secret": r"[yntdYNTD][\x22']?\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_.=-]{16}|AKIA|gh[pousr]_|xox[abprs]-|eyJ|-----BEGIN",
}

# Score of a confirmed span without context, and the words that raise or lower it.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.5, "secret": 0.8}
RAISE = {
    "email": "mail|contact|write|address|courriel|correo",
    "ip": "address|server|host|login|client|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|contact|anruf|appel",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
    "secret": "api|auth|bearer|access|private|credential|login",
}
LOWERED = "example|sample|test|dummy|version|isbn|order|serial"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weigh(total: Column, at: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - at, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(at % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), weigh) % 10 == 0


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN whose letters count from ten, taken digit by digit."""
    moved = F.concat(F.substr(text, F.lit(5)), F.left(text, F.lit(4)))

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code <= 57, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def _confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        parts = F.split(match, r"\.")
        # leading zeros do not change a value; longer numbers exceed 255
        return F.forall(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        text = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(text).between(15, 34), _mod97(text) == 1).otherwise(False)
    if kind == "secret":
        # letters and digits, or named by its own form
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") | match.rlike("^(-----BEGIN|eyJ|xox|gh[pousr]_|AKIA)")
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, near: Column) -> Column:
    near = F.lower(near)
    up = F.when(near.rlike(RAISE[kind]), 0.2).otherwise(0.0)
    down = F.when(near.rlike(LOWERED), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(SCORES[kind]) + up - down))


_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,score:double>>"


def _contexts(between: Column, matches: Column) -> Column:
    """For each match the characters before and behind it, `CONTEXT` at most on each side.

    One pass from the start carries the last characters of all that came before, one from the end the first
    characters of all that follows; `between` has what lies before, between and behind the matches.
    """
    reach, number = F.lit(CONTEXT), F.size(matches)
    begun = F.struct(F.lit("").alias("near"), F.expr("cast(array() as array<string>)").alias("sides"))

    def before(a: Column, s: Column) -> Column:
        near = F.right(F.concat(a["near"], F.right(s["gap"], reach)), reach)
        return F.struct(F.right(F.concat(near, F.right(s["match"], reach)), reach).alias("near"), F.array_append(a["sides"], near).alias("sides"))

    def behind(a: Column, s: Column) -> Column:
        near = F.left(F.concat(F.left(s["gap"], reach), a["near"]), reach)
        return F.struct(F.left(F.concat(F.left(s["match"], reach), near), reach).alias("near"), F.array_append(a["sides"], near).alias("sides"))

    forth = F.arrays_zip(F.slice(between, F.lit(1), number).alias("gap"), matches.alias("match"))
    back = F.reverse(F.arrays_zip(F.slice(between, F.lit(2), number).alias("gap"), matches.alias("match")))
    left = F.aggregate(forth, begun, before, lambda a: a["sides"])
    right = F.reverse(F.aggregate(back, begun, behind, lambda a: a["sides"]))
    return F.zip_with(left, right, lambda x, y: F.concat(x, F.lit(" "), y))


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind.  Splitting at the matches gives what lies between them."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    # where each match starts: running sum over what lies before it
    steps = F.zip_with(between, matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
    begun = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<bigint>)").alias("starts"))
    starts = F.aggregate(
        F.slice(steps, F.lit(1), F.size(matches)),
        begun,
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["size"]).alias("at"),
            F.array_append(a["starts"], a["at"] + s["gap"]).alias("starts"),
        ),
        lambda a: a["starts"],
    )
    found = F.arrays_zip(starts.alias("start"), matches.alias("match"), _contexts(between, matches).alias("near"))
    found = F.filter(found, lambda m: _confirmed(kind, m["match"]))
    spans = F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (m["start"] + F.length(m["match"])).cast("bigint").alias("stop"),
            F.lit(kind).alias("kind"),
            _score(kind, m["near"]).alias("score"),
        ),
    )
    empty = F.expr(f"cast(array() as {_SPAN})")
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(empty)


def detect(documents: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """The documents with an array of spans (start, rank, stop, kind, score), by start, then kind."""
    if name in documents.columns:
        raise ValueError(f"there is a column {name} already")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kinds = [_spans(kind, whole) for kind in KINDS]
    return documents.withColumn(name, F.array_sort(reduce(lambda a, b: F.concat(a, b), kinds)))


def redact(documents: DataFrame, text: str = "text", threshold: float = 0.0) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one."""
    marked = detect(documents, text, "__pii")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def write(a: Column, s: Column) -> Column:
        return F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substr(whole, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["stop"]).alias("at"),
        )

    begun = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    wanted = F.filter("__pii", lambda s: s["score"] >= threshold)
    written = F.aggregate(wanted, begun, write, lambda a: F.concat(a["out"], F.substr(whole, (a["at"] + 1).cast("int"))))
    return marked.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), written)).drop("__pii")


def report(documents: DataFrame) -> DataFrame:
    """One digest row per document."""
    # A stored array would be cheaper only by luck: keep Spark from computing it once per output column.
    found = detect(documents.select("doc_id", "text")).select("doc_id", "pii")
    found = found.select("doc_id", F.explode(F.array("pii")).alias("pii"))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *[number(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"),
        *[number(k) for k in KINDS[len(BASE):]],
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
