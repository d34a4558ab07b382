"""Quality classifier: attention-based multiple-instance learning over a document's passages.

Every run of ``PASSAGE_WORDS`` words is a passage, encoded by its byte classes and word statistics.  A
small network embeds each passage, gated attention weighs the passages of a document, and a logistic
output scores the weighted sum.  Only document labels are used; the attention learns which passages
carry them.

The model is fitted on a bounded sample: at most ``BAGS_PER_CLASS`` documents of each class and
``BAG_PASSAGES`` evenly spaced passages of each.  Scoring encodes all passages of every document.

Defined results: null, empty and blank texts are one passage of zeros and get a score; without
labels of both classes every score is the base rate (one half without any); a null doc_id is scored
and not held out; repeated rows get equal scores; a text of any length is read whole; an empty table stays empty; a column
named like the score is replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.labelled import held_out, sample_by_class
from panelforge.llm.tables import table
from panelforge.llm.text_hash import Windows, word_bounds

PASSAGE_WORDS = 64
#: Bounds of the sample that the model is fitted on.
BAGS_PER_CLASS = 1500
BAG_PASSAGES = 16
EMBEDDING, GATE, EPOCHS, RATE = 16, 8, 200, 0.02
#: Bytes of text encoded at once, where documents allow.
CHUNK = 1 << 20

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]


def _byte_classes() -> np.ndarray:
    """256 x classes: capitals, small letters, digits, line ends, other space, beyond ASCII, and each ASCII punctuation mark."""
    kinds = [range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), (10, 13), (9, 32), range(128, 256), *[(b,) for b in _PUNCTUATION]]
    out = np.zeros((256, len(kinds)), np.float32)
    for k, members in enumerate(kinds):
        out[list(members), k] = 1
    return out


_CLASSES = _byte_classes()
FEATURES = _CLASSES.shape[1] + 4


def _encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the index of each one's document."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, stop = word_bounds(data)
    doc = np.searchsorted(ends, start, side="right")
    first = np.searchsorted(doc, np.arange(len(texts)))
    place = (np.arange(len(doc)) - first[doc]) // PASSAGE_WORDS if len(doc) else doc
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    begin = np.flatnonzero(fresh)  # first word of each passage
    passage = np.cumsum(fresh) - 1
    n = len(begin)
    features = np.zeros((n, FEATURES), np.float32)
    if n:
        words = np.diff(np.append(begin, len(doc)))
        lo, hi = start[begin], stop[np.append(begin[1:], len(doc)) - 1]
        at = np.zeros(len(data) + 1, np.int32)
        np.add.at(at, lo, 1)
        inside = np.cumsum(at[:-1]) - 1
        inside[inside < 0] = 0
        histogram = np.bincount(inside.astype(np.int64) * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float32)
        size = np.maximum(hi - lo, 1)[:, None]
        k = _CLASSES.shape[1]
        features[:, :k] = histogram @ _CLASSES / size
        hashes = Windows(data).hash(start, stop)
        same = np.zeros(len(doc), np.float32)
        same[1:] = (hashes[1:] == hashes[:-1]) & ~fresh[1:]
        features[:, k] = np.add.reduceat(same, begin) / words
        order = np.lexsort((hashes, passage))
        different = np.ones(len(doc), np.float32)
        different[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        features[:, k + 1] = np.add.reduceat(different, begin) / words
        features[:, k + 2] = np.minimum(np.add.reduceat((stop - start).astype(np.float32), begin) / words / 16, 4)
        features[:, k + 3] = words / PASSAGE_WORDS
    return features, doc[begin]


def encode(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, features, document) for chunks of the texts; a text without words is one passage of zeros."""
    chunk: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        chunk.append((t or "").encode())
        size += len(chunk[-1])
        if size >= CHUNK or i == len(texts) - 1:
            features, doc = _encode(chunk)
            bare = np.setdiff1d(np.arange(len(chunk)), doc)
            doc = np.concatenate((doc, bare))
            order = np.argsort(doc, kind="stable")
            features = np.concatenate((features, np.zeros((len(bare), FEATURES), np.float32)))
            yield first, i + 1, features[order], doc[order]
            chunk, first, size = [], i + 1, 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Embedding, gated attention over each bag, logistic output; trained by Adam on whole batches."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale, self.shift = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), 0.0
        self.p = {"w": draw(FEATURES, EMBEDDING), "b": np.zeros(EMBEDDING, np.float32), "v": draw(EMBEDDING, GATE), "u": draw(EMBEDDING, GATE), "a": draw(GATE), "c": draw(EMBEDDING), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, begin: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        weight = e / np.add.reduceat(e, begin)[bag]
        z = np.add.reduceat(h * weight[:, None], begin)
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "logit": z @ p["c"] + p["d"][0]}

    def fit(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> AttentionModel:
        bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        importance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        p, xs = self.p, (x - self.mean) / self.scale
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        for epoch in range(1, EPOCHS + 1):
            f = self.forward(x, begin, bag)
            slope = ((_sigmoid(f["logit"]) - y) * importance).astype(np.float32)
            dz = slope[:, None] * p["c"]
            dh = f["weight"][:, None] * dz[bag]
            dweight = (f["h"] * dz[bag]).sum(1)
            de = f["weight"] * (dweight - np.add.reduceat(f["weight"] * dweight, begin)[bag])
            dt = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
            dg = de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
            dh += dt @ p["v"].T + dg @ p["u"].T
            dx = dh * (1 - f["h"] ** 2)
            grad = {"w": xs.T @ dx, "b": dx.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ slope, "d": slope.sum(keepdims=True)}
            for k, g in grad.items():
                g = g + 1e-4 * p[k] * (k not in "bd")
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
        return self

    def score(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """A score for each document; passages come in the documents' order."""
        fresh = np.append(True, doc[1:] != doc[:-1])
        return _sigmoid(self.forward(x, np.flatnonzero(fresh), np.cumsum(fresh) - 1)["logit"] + self.shift)


def _bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for first, end, features, doc in encode(list(frame["text"])):
            edges = np.searchsorted(doc, np.arange(end - first + 1))
            rows = [features[np.unique(np.linspace(a, b - 1, BAG_PASSAGES).astype(int))] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pd.DataFrame({"label": frame["label"].iloc[first:end].to_numpy(), "passages": [r.ravel() for r in rows]})


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> AttentionModel | float:
    """The fitted model, or the base rate where labels of one class only, or none, are given."""
    sample, counts = sample_by_class(labels, key, label, BAGS_PER_CLASS)
    total = sum(counts.values())
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return counts.get(1, 0) / total if total else 0.5
    drawn = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    rows = drawn.select("label", "text").mapInPandas(_bags, "label int, passages array<float>").collect()
    rows.sort(key=lambda r: (r[0], r[1]))  # the fit doesn't depend on the order of partitions
    if {r[0] for r in rows} != {0, 1}:
        return counts[1] / total
    bags = [np.asarray(r[1], np.float32).reshape(-1, FEATURES) for r in rows]
    begin = np.concatenate(([0], np.cumsum([len(b) for b in bags])))[:-1]
    y = np.array([r[0] for r in rows], np.float32)
    model = AttentionModel().fit(np.concatenate(bags), begin, y)
    model.shift = float(np.log(counts[1] / counts[0]))  # the classes weigh alike in the fit
    return model


def score_quality(df: DataFrame, model: AttentionModel | float, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Adds ``out``, from 0 to 1, to every row."""
    if isinstance(model, float):
        return df.withColumn(out, F.lit(model))
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for first, end, features, doc in encode(list(texts)):
            out[first:end] = held.value.score(features, doc)
        return pd.Series(out)

    return df.withColumn(out, scored(F.col(text)))


def learning_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of the rows that may be learned from."""
    return labels.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col(label).alias("label"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, learning_labels(table(spark, sf_dir, "labels"), "quality"))
    scored = score_quality(docs, model, out="score")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
