"""Every text operator on null, empty, very long and repeated texts, empty tables, and clashing column names; learned ones by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import decontam, jaccard, langid, packing, pii, quality, substring_dedup, toxicity, url_reputation

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 9973}" for i in range(150_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "Ünd 1 😀 the"), (4, "Ünd 1 😀 the"), (5, LONG), (6, LONG), (None, "no id"), (None, None), (9, "x" * 300_000)]
#: Names that operators use for their results or on the way.
NAMES = ("score", "n", "spans", "__spans", "__items", "__n_words", "__text", "__score", "__found", "__ruled", "k1", "node", "id", "length", "part", "host", "label", "n_bytes", "__pii_spans", "wanted", "comp")
LABELS = "doc_id long, label int"


def odd(spark, texts=TEXTS):
    return spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in NAMES})


def learned(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(30)) + (" you zorgle fool" if i % 2 else ""), i % 2) for i in range(60)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS)


def scored_toxicity(spark, df):
    return toxicity.score_toxicity(df, toxicity.fit_toxicity(*learned(spark)))


def scored_quality(spark, df):
    return quality.score_quality(df, quality.fit_quality(*learned(spark)))


def identified(spark, df):
    return langid.identify(df, {"a": "the quick brown fox", "b": "und der schnelle fuchs"})


def contaminated(spark, df):
    benchmark = spark.createDataFrame([(1, "the"), (2, None)], "item_id long, text string")
    return decontam.find_contamination(df, benchmark, carry=[c for c in df.columns if c != "text"])


def repeats(spark, df):
    return substring_dedup.Repeats(df, "text").removed(*[c for c in df.columns if c != "text"], kept=False)


def judged(spark, df):
    return url_reputation.judge(df, "text")


ROWWISE = {
    "pii": (lambda spark, df: pii.find_spans(df, out="found"), ["found"]),
    "masked": (lambda spark, df: pii.redact(df), ["text"]),
    "decontamination": (contaminated, ["__n_words", "__spans", "__items"]),
    "toxicity": (scored_toxicity, ["toxicity_score"]),
    "quality": (scored_quality, ["quality_score"]),
    "language": (identified, ["lang_pred", "lang_score"]),
    "urls": (judged, ["host", "path", "rule", "verdict"]),
    "repeats": (repeats, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"]),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_each_row_has_its_result(spark, name):
    run, results = ROWWISE[name]
    got = run(spark, odd(spark))
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    kept = [c for c in NAMES if c not in results]
    assert all(r[c] == f"own {c}" for r in rows for c in kept)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append([r[c] for c in results])
    assert by_id[4][0] == by_id[4][1] and by_id[5] == by_id[6]
    nothing = run(spark, odd(spark, TEXTS).limit(0))
    assert nothing.count() == 0 and nothing.columns == got.columns


def test_classes_of_odd_rows(spark):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_classes(odd(spark)).collect())
    assert [g[::2] for g in got if g[0] in (1, 2, 3, 4, 5, 6, 9)] == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5), (6, 5), (9, 9)]
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == [0, 0, 0] and len(got) == len(TEXTS)


def test_packing_of_odd_rows(spark):
    counted = odd(spark).withColumn("n_tokens", packing.token_count(F.col("text")))
    got = packing.pack(counted).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {4: 8, 5: 150_000, 6: 150_000, None: 2, 9: 1}


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_pipeline_of_odd_rows(spark, rows):
    docs = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns, name
        assert all(r[c] == f"own {c}" for r in got for c in NAMES)
        assert len(got) <= len(rows)
        if rows and name == "near_duplicates":
            assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 1, 2, 3, 4, 5, 9]
        elif name == "personal_data" and rows:
            assert len(got) == len(rows)
    assert corpus_pipeline.packing(spark, docs, SF).columns[0] == "doc_id"


def plain_phrases(text, training):
    """Longest matches one after the other; a letter that the training text lacks is a phrase of its own."""
    i = n = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in training:
            k += 1
        i, n = i + k, n + 1
    return n


def test_phrases_match_longest_matches():
    rng = random.Random(2)
    for _ in range(40):
        training = {x: "".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for x in "pq"}
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, langid.RUN))) for _ in range(6)]
        got = langid.CrossParser(training).phrases(texts)
        assert got.tolist() == [[plain_phrases(t, training[x]) for x in "pq"] for t in texts]


def test_attention_matches_loops_over_passages():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(chr(c) for c in rng.integers(97, 123, 4)) for _ in range(n)) for n in (3, 200, 70, 0)]
    model = quality.AttentionModel(seed=1)
    model.shift = 0.3
    (_, _, features, doc), *rest = quality.encode(texts)
    assert not rest and np.bincount(doc).tolist() == [1, 4, 2, 1]
    got, p = model.score(features, doc), model.p
    for d in range(len(texts)):
        embedded, pull = [], []
        for x in features[doc == d]:
            h = [math.tanh(sum(float(x[i]) * float(p["w"][i, j]) for i in range(quality.FEATURES)) + float(p["b"][j])) for j in range(quality.EMBEDDING)]
            gate = 0.0
            for m in range(quality.GATE):
                v, u = (sum(h[j] * float(p[k][j, m]) for j in range(quality.EMBEDDING)) for k in "vu")
                gate += float(p["a"][m]) * math.tanh(v) / (1 + math.exp(-u))
            embedded.append(h)
            pull.append(math.exp(gate))
        whole = [sum(w * h[j] for w, h in zip(pull, embedded, strict=True)) / sum(pull) for j in range(quality.EMBEDDING)]
        logit = sum(z * float(c) for z, c in zip(whole, p["c"], strict=True)) + float(p["d"][0]) + 0.3
        assert abs(got[d] - 1 / (1 + math.exp(-logit))) < 1e-4
