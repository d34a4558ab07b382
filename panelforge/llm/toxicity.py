"""Toxicity by a weighted finite-state grammar over clauses.

The grammar's insult entries are whole words and word beginnings or endings.  A list of plain English
insults is given; the rest is learned from labelled documents, which also set every weight: forms that
toxic documents hold much more often than clean ones, taken greedily while each explains toxic
documents that no earlier entry explains.  A document's matched clauses, scored by the composed
transducers, become a probability by a logistic fit on the same labelled sample.

Learning is bounded: at most ``DOCS_PER_CLASS`` labelled documents of each class, ``CANDIDATES`` forms
and ``ENTRIES`` lexicon entries.  Scoring reads all clauses of every document.

Defined results: null and empty texts match nothing and get the score of a text without matches;
without labels of both classes the given insults alone decide; a null doc_id is scored, not held out; repeated
rows get equal scores; a text of any length is read whole; an empty table stays empty; a column named like the
score is replaced, others stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.grammar import BOUNDARY, INSULT, INTENT, NEGATION, OTHER, REPORT, TARGET, THREAT, clause_scores
from panelforge.llm.labelled import held_out, sample_by_class
from panelforge.llm.quality import learning_labels
from panelforge.llm.tables import table

#: Bounds of learning.
DOCS_PER_CLASS = 4000
CANDIDATES = 4000
ENTRIES = 400
#: A candidate form is in at least so many toxic documents, and so much likelier in them.
MIN_DOCS = 5
MIN_LOG_ODDS = 2.0
#: Log odds of an entry of weight 1.
UNIT_LOG_ODDS = 3.0
#: An entry explains at least so many toxic documents, and this share of them, beyond earlier entries.
MIN_NEW, MIN_NEW_SHARE = 5, 0.004
EXPLAINED_BY, CLEAN_COST = 5, 6.0
AFFIX = range(3, 8)

INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "disgusting", "pathetic", "clown", "imbecile", "dumb", "jerk", "filth", "vermin", "garbage")
THREATS = ("kill", "destroy", "hurt", "punish", "crush", "beat", "hunt")
INTENTS = ("will", "shall", "should", "must", "gonna", "going", "want", "let", "ll", "werde", "werden", "vais", "voy", "vamos")
TARGETS = ("you", "your", "yourself", "he", "she", "they", "them", "him", "her", "everyone", "people", "du", "ihr", "sie", "vous", "toi", "usted", "ustedes", "tú")
NEGATIONS = ("not", "never", "no", "without", "isn", "aren", "don", "doesn", "nicht", "kein", "keine", "jamais", "nunca")
REPORTS = ("said", "says", "wrote", "called", "claimed", "reported", "quoted", "according", "sagte", "dit", "dijo")

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
_BOUNDARIES = frozenset(".!?;:,\n")


def forms(word: str) -> Iterator[str]:
    """A word's whole form, beginnings and endings, as lexicon entries are written."""
    yield word
    for k in AFFIX:
        if len(word) > k:
            yield word[:k] + "*"
            yield "*" + word[-k:]


@dataclass
class Lexicon:
    """Symbol and weight of words; insult entries may be word beginnings or endings."""

    insults: dict[str, float]
    known: dict[str, tuple[str, float]] = field(default_factory=dict)

    def __post_init__(self):
        for symbol, words, weight in ((THREAT, THREATS, 1.0), (INTENT, INTENTS, 0.0), (TARGET, TARGETS, 0.0), (NEGATION, NEGATIONS, 0.0), (REPORT, REPORTS, 0.0)):
            self.known |= dict.fromkeys(words, (symbol, weight))
        self.known |= dict.fromkeys(_BOUNDARIES, (BOUNDARY, 0.0))
        self.fixed = dict(self.known)

    def of(self, word: str) -> tuple[str, float]:
        if (found := self.known.get(word)) is None:
            weight = max((self.insults[f] for f in forms(word) if f in self.insults), default=0.0)
            found = (INSULT, weight) if weight > 0 else (OTHER, 0.0)
            if len(self.known) > 300_000:
                self.known = dict(self.fixed)
            self.known[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """Of a document's matched clauses: strongest, all together, how many, and how dense."""
        tokens = _TOKEN.findall((text or "").lower())
        read = [self.of(t) for t in tokens]
        if not any(s == INSULT or s == THREAT for s, _ in read):
            return [0.0, 0.0, 0.0, 0.0]
        scores = clause_scores([s for s, _ in read], [w for _, w in read])
        return [min(max(scores), 6.0), math.log1p(sum(scores)), math.log1p(sum(x > 0.5 for x in scores)), math.log1p(1000 * sum(scores) / len(tokens))]


def _signature(texts: pd.Series) -> pd.Series:
    """The least hash of a text's three-word runs: mostly alike for near copies, seldom for other texts."""
    least = []
    for text in texts:
        words = (text or "").lower().encode().split()
        least.append(min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0))
    return pd.Series(least, dtype="int64")


def _count_forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pd.DataFrame:
        seen = list(set(counts[0]) | set(counts[1]))
        out = pd.DataFrame({"form": pd.Series(seen, dtype=object), "clean": [counts[0][f] for f in seen], "toxic": [counts[1][f] for f in seen]})
        counts[0].clear(), counts[1].clear()
        return out

    for frame in frames:
        for label, text in zip(frame["label"], frame["text"], strict=True):
            words = set(_TOKEN.findall((text or "").lower())) - _BOUNDARIES
            counts[label].update({f for w in words for f in forms(w)})
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
    yield flush()


def _held_forms(candidates: frozenset):
    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = [set(_TOKEN.findall((t or "").lower())) for t in frame["text"]]
            yield pd.DataFrame({"forms": [sorted({f for w in ws for f in forms(w) if f in candidates}) for ws in words]})

    return held


def _cover(candidates: dict[str, tuple[float, float]], documents: list[list[str]]) -> list[str]:
    """Greedy choice of entries: each helps to explain the most toxic documents, less its cost in clean ones.

    ``candidates`` holds each form's log odds and share of clean documents.  A document is explained
    by ``EXPLAINED_BY`` entries, so that a rare form beside frequent ones is still learned.
    """
    of = {f: set() for f in candidates}
    for i, held in enumerate(documents):
        for f in held:
            of[f].add(i)
    least = max(MIN_NEW, MIN_NEW_SHARE * len(documents))
    explained = [0] * len(documents)
    chosen: list[str] = []

    def worth(form: str) -> tuple:
        odds, clean = candidates[form]
        return len(of[form]) - CLEAN_COST * clean * len(documents), odds, -len(form), form

    while of and len(chosen) < ENTRIES:
        best = max(of, key=worth)
        if worth(best)[0] < least:
            break
        chosen.append(best)
        done = set()
        for i in of.pop(best):
            explained[i] += 1
            if explained[i] == EXPLAINED_BY:
                done.add(i)
        # Forms of words that are in the lexicon by now explain nothing new beside them.
        kin = {f for f in of if f.strip("*") in best or best.strip("*") in f}
        of = {f: rest for f, docs in of.items() if f not in kin and len(rest := docs - done) >= least}
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised weights, the intercept last, by Newton steps; classes weigh alike."""
    x = np.column_stack((x, np.ones(len(x))))
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    ridge = np.diag([1e-3] * (x.shape[1] - 1) + [1e-9])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (p - y)) + ridge @ b)
    return b


#: Used where there is nothing to learn from: one clear match is toxic.
DEFAULT_FIT = np.array([1.5, 1.0, 1.0, 0.2, -2.5])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    fit: np.ndarray

    def score(self, texts: list) -> np.ndarray:
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.fit[:-1] + self.fit[-1], -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> ToxicityModel:
    given = dict.fromkeys(INSULTS, 1.0)
    sample, counts = sample_by_class(labels, key, label, DOCS_PER_CLASS)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return ToxicityModel(Lexicon(given), DEFAULT_FIT)
    drawn = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").select("label", "text")
    # Copies count once, or the words of one much-copied document would look like a pattern.
    drawn = drawn.withColumn("signature", F.pandas_udf(_signature, "long")("text")).dropDuplicates(["label", "signature"]).drop("signature").persist()
    try:
        sizes = {r[0]: r[1] for r in drawn.groupBy("label").count().collect()}
        if set(sizes) != {0, 1}:
            return ToxicityModel(Lexicon(given), DEFAULT_FIT)
        counted = drawn.mapInPandas(_count_forms, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
        likely = counted.where(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
        candidates = {r["form"]: (r["odds"], r["clean"] / (sizes[0] + 1)) for r in likely.orderBy(F.desc("toxic"), F.desc("odds"), "form").limit(CANDIDATES).collect()}
        documents = [r[0] for r in drawn.where("label = 1").mapInPandas(_held_forms(frozenset(candidates)), "forms array<string>").collect()]
        learned = {f: min(2.0, candidates[f][0] / UNIT_LOG_ODDS) for f in _cover(candidates, documents)}
        lexicon = Lexicon(given | learned)

        def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"label": frame["label"], "x": [lexicon.features(t) for t in frame["text"]]})

        rows = sorted((tuple(r[1]), r[0]) for r in drawn.mapInPandas(measured, "label int, x array<double>").collect())
    finally:
        drawn.unpersist()
    return ToxicityModel(Lexicon(given | learned), _logistic(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity_score") -> DataFrame:
    """Adds ``out``, from 0 to 1, to every row."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(list(texts)))

    return df.withColumn(out, scored(F.col(text)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, learning_labels(table(spark, sf_dir, "labels"), "toxic"))
    scored = score_toxicity(docs, model, out="score")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
