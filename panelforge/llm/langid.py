"""Language identification by cross-parsing entropy over suffix automata.

For every language a suffix automaton of labelled text accepts exactly that text's substrings.  A
document is cross-parsed against it: the longest match is one phrase, and the next phrase begins where
it broke off.  Text in the automaton's language parses into few long phrases.  Phrases times the
logarithm of the training length, over the letters parsed, estimates the cross entropy; the language
with the least wins.

Text is normalised to lower-case letters with one space between words; everything else only separates.
An automaton becomes a dense transition table, in which breaking off is a marked transition, so a
batch of documents is parsed by table lookups, one character of every document at a time.  Documents
are cut into runs of ``RUN`` characters that are parsed side by side; a cut costs each language the
same fraction of a phrase.

Learning is bounded: ``TRAIN_CHARS`` characters for each language, as stretches of equal length of ``TRAIN_DOCS``
different labelled texts, from a place anywhere in each that its hash chooses; prediction reads every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when
nothing is labelled.  Rows with null labels teach nothing; a null doc_id is predicted, not held out; repeated rows
get equal results; an empty table stays empty; columns named like the results are replaced, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.labelled import held_out
from panelforge.llm.tables import table, unused

TRAIN_CHARS = 24_000
TRAIN_DOCS = 120
RUN = 256
#: Letters parsed together.
BATCH = 4 << 20
UNDETERMINED = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words of letters between single spaces."""
    found = _OTHER.sub(" ", (text or "").lower()).strip()
    return found if any(map(str.isalpha, found)) else ""


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton of all suffixes of ``text``; state 0 is the start."""
    nexts: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


class CrossParser:
    """Phrase counts of many texts against the training text of every language."""

    def __init__(self, training: dict[str, str]):
        self.languages = sorted(training)
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(training.values()))))}
        self.logs = np.array([np.log2(len(training[x]) + 1) for x in self.languages])
        self.tables = [self._table(training[x]) for x in self.languages]
        # Characters by code point; those beyond the training text are symbol 0, known to no language.
        self.symbols = np.zeros(max(map(ord, self.alphabet), default=0) + 2, np.int64)
        for c, i in self.alphabet.items():
            self.symbols[ord(c)] = i

    def _table(self, text: str) -> np.ndarray:
        """Flat (state, symbol) -> 2 * next state * width + broke: a break starts anew with the symbol.

        A symbol that the language lacks is a phrase of its own: the extra last state breaks off at once.
        """
        automaton = suffix_automaton(text)
        width, lost = len(self.alphabet) + 1, len(automaton)
        out = np.full((lost + 1, width), 2 * lost * width + 1, np.int32)
        for c, state in automaton[0].items():
            out[:, self.alphabet[c]] = 2 * state * width + 1
        for s, arcs in enumerate(automaton):
            for c, state in arcs.items():
                out[s, self.alphabet[c]] = 2 * state * width
        return out.ravel()

    def phrases(self, texts: list[str]) -> np.ndarray:
        """texts x languages: phrases started, a first one included."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        symbols = self.symbols[np.minimum(codes, len(self.symbols) - 1)]
        sizes = np.array([len(t) for t in texts])
        runs = -(-sizes // RUN)
        owner = np.repeat(np.arange(len(texts)), runs)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = np.repeat(np.cumsum(sizes) - sizes, runs) + place * RUN
        size = np.minimum(RUN, np.repeat(sizes, runs) - place * RUN)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        alive = np.searchsorted(-size, -np.arange(RUN))  # runs longer than each step
        state = np.zeros((len(self.tables), len(begin)), np.int64)
        count = np.ones((len(self.tables), len(begin)), np.int64)
        for step in range(RUN):
            n = alive[step]
            if n == 0:
                break
            symbol = symbols[begin[:n] + step]
            for k, table_ in enumerate(self.tables):
                after = table_[state[k, :n] + symbol]
                if step:  # the first phrase is counted already
                    count[k, :n] += after & 1
                state[k, :n] = after >> 1
        return np.stack([np.bincount(owner, c, len(texts)) for c in count], axis=1)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """texts x languages: bits for each letter, infinite for a text without letters."""
        sizes = np.array([len(t) for t in texts], float)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(sizes > 0, self.phrases(texts) * self.logs / sizes, np.inf)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """The language of each text, and how clearly it wins: its share of exp(-bits), in whole texts of up to 64 letters."""
        plain = [letters(t) for t in texts]
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = 0
        while at < len(plain):
            end, size = at, 0
            while end < len(plain) and (end == at or size + len(plain[end]) <= BATCH):
                size += len(plain[end])
                end += 1
            some = [i for i in range(at, end) if plain[i]]
            if some and self.languages:
                bits = self.entropies([plain[i] for i in some])
                best = bits.argmin(axis=1)
                weight = np.minimum([len(plain[i]) for i in some], 64)[:, None]
                share = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * weight).sum(axis=1)
                for i, b, s in zip(some, best.tolist(), share.tolist(), strict=True):
                    labels[i], scores[i] = self.languages[b], s
            at = end
        return labels, scores


def training_text(labelled: DataFrame, text: str, lang: str) -> dict[str, str]:
    """Bounded training text of each language: a stretch of each of its first texts in the order of their hash."""
    useful = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # Copies count once.  The limit on the rank is applied before the exchange, so no task gathers a frequent language.
    ranked = useful.select("lang", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    drawn = useful.join(F.broadcast(ranked.where(F.col("r") <= TRAIN_DOCS).drop("r")), ["lang", "h"])
    each = TRAIN_CHARS // TRAIN_DOCS
    begin = F.pmod("h", F.greatest(F.length("text") - 4 * each, F.lit(0)) + 1) + 1
    stretches = drawn.groupBy("lang", "h").agg(F.min(F.substring("text", begin.cast("int"), F.lit(4 * each))).alias("part"))
    texts: dict[str, list] = {}
    for r in stretches.collect():
        texts.setdefault(r["lang"], []).append((r["h"], letters(r["part"])[:each]))
    return {x: " ".join(t for _, t in sorted(parts) if t) for x, parts in texts.items() if any(t for _, t in parts)}


_PARSERS: dict[int, CrossParser] = {}


def identify(df: DataFrame, training: dict[str, str], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``lang_score`` to every row."""
    held = df.sparkSession.sparkContext.broadcast(training)

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # Workers are reused: the automata are built once in each.
        key = hash(tuple(sorted(held.value.items())))
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = CrossParser(held.value)
        for texts in batches:
            labels, scores = _PARSERS[key].predict(list(texts))
            yield pd.DataFrame({"lang_pred": labels, "lang_score": scores})

    found = F.pandas_udf(predicted, "lang_pred string, lang_score double")
    held_in = unused(df, "__found")
    return df.withColumn(held_in, found(F.col(text))).withColumns({c: F.col(held_in)[c] for c in ("lang_pred", "lang_score")}).drop(held_in)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    training = training_text(docs.where(~out), "text", "lang")
    return identify(docs.select("doc_id", "text"), training).select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op10_langid": op10_langid}
ORACLES: dict[str, str] = {}
