"""Personal data in text: pattern proposals, checksum validation, context-adjusted scores.

Everything is a Spark expression over one row, so a scan is the only work: no shuffle, no Python.

Each kind has a pattern that proposes spans, a validator that confirms them and a base score.
A word of the kind's context list shortly before the span raises the score.  A span is reported
when its score reaches ``MIN_SCORE``.  The four base kinds start at that score once validated, so
they are always reported; ``iban``, ``short_card``, ``national_id`` and ``secret`` (access tokens, keys)
depend on checksum and context.

Defined results: a null text counts as empty and has no spans; spans of one kind never overlap,
spans of different kinds may; repeated rows and null ids are judged row by row; every pattern is linear
in the text, so a text of any length is judged whole; other columns stay, and one named like ``out`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.tables import table, unused

#: A span is reported from this score on.
MIN_SCORE = 0.6
#: What a context word adds, and how many characters before a span are searched for one.
CONTEXT_BONUS = 0.3
CONTEXT_WINDOW = 40


@dataclass(frozen=True)
class Kind:
    """One kind of personal data; ``needs`` is a pattern without which a text holds none."""

    name: str
    pattern: str
    needs: str
    score: float
    context: str = ""


#: In Java's pattern syntax.  Possessive quantifiers and the look-behinds change no match (a run of
#: digits or address characters matches from its start or not at all); they keep each scan linear in
#: the text and free of recursion, so that a run of a million digits is harmless.
BASE_KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.6, r"mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9\x20-]{14}", 0.6, r"card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"phone|call|tel|mobile"),
)
EXTRA_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]", 0.7, r"iban|account|bank|konto"),
    Kind("short_card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", r"[0-9][0-9\x20-]{11}", 0.4, r"card|visa|amex|credit|payment"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.4, r"ssn|social|national|identity|\bid\b"),
    Kind("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}", r"(?i)token|secret|passw|key|bearer|credential", 0.4, r"token|secret|passw|key|bearer|credential"),
)
KINDS = BASE_KINDS + EXTRA_KINDS


def luhn_valid(digits: Column) -> Column:
    """The mod-10 checksum of a string of digits."""
    doubled = lambda c: F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.expr("0") + c.cast("int"))
    weighted = F.transform(values, lambda c, i: F.when(i % 2 == 1, doubled(c)).otherwise(c))
    return F.aggregate(weighted, F.lit(0), lambda a, c: a + c) % 10 == 0


def mod97_valid(iban: Column) -> Column:
    """The mod-97 checksum of an account number without spaces."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, text: Column) -> Column:
    """Whether a proposed span passes its kind's validator."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|(?<=0))"
        return text.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn_valid(digits)).otherwise(False)
    if kind == "short_card":
        return luhn_valid(digits)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97_valid(F.regexp_replace(text, " ", ""))
    if kind == "national_id":
        return ~text.rlike("^(?:000|666|9..)|-00-|-0000$")
    if kind == "secret":
        return text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    return F.lit(True)


def proposals(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, stop, score>> of one kind's confirmed spans, in code points.

    Matches and the pieces between them alternate, so running lengths give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    between = F.split(text, kind.pattern, -1)
    state = "struct<at:int,spans:array<struct<kind:string,start:int,stop:int,before:string>>>"
    start = lambda a, x: a["at"] + F.length(x["gap"])
    steps = F.arrays_zip(found.alias("match"), F.slice(between, 1, F.size(found)).alias("gap"))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(state),
        lambda a, x: F.struct(
            (start(a, x) + F.length(x["match"])).alias("at"),
            F.when(
                confirmed(kind.name, x["match"]),
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            F.lit(kind.name).alias("kind"),
                            start(a, x).alias("start"),
                            (start(a, x) + F.length(x["match"])).alias("stop"),
                            F.right(x["gap"], F.lit(CONTEXT_WINDOW)).alias("before"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ).cast(state),
    )["spans"]
    bonus = lambda s: F.when(F.lower(s["before"]).rlike(kind.context), CONTEXT_BONUS).otherwise(0.0) if kind.context else F.lit(0.0)
    scored = F.transform(
        walked,
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.least(F.lit(1.0), F.lit(kind.score) + bonus(s)).alias("score")),
    )
    kept = F.filter(scored, lambda s: s["score"] >= MIN_SCORE)
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,score:double>>")
    return F.when(text.rlike(kind.needs), kept).otherwise(none)


def find_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds ``out``: every reported span by kind in listed order, then by start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(out, F.concat(*[proposals(whole, k) for k in KINDS]))


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by ``<KIND>`` of its first span."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    state = "struct<at:int,parts:array<string>>"
    last = lambda a, s: a["at"] > s["start"]
    walked = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().alias("parts")).cast(state),
        lambda a, s: F.when(last(a, s), F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["parts"].alias("parts")).cast(state)).otherwise(
            F.struct(
                s["stop"].alias("at"),
                F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("parts"),
            ).cast(state)
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(walked)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by its masked form; a null text stays null, other columns are kept."""
    spans = unused(df, "__pii_spans")
    return find_spans(df, text, spans).withColumn(text, F.when(F.col(text).isNotNull(), masked(F.col(text), F.col(spans)))).drop(spans)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every whole document."""
    base = [k.name for k in BASE_KINDS]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_spans(docs).select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(digest(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
        *[count(k.name) for k in EXTRA_KINDS],
        F.size("spans").cast("long").alias("n_spans"),
    )


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
