"""BPE, ranked search and divergence audit: against the library, brute force, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import bpe, divergence, lexical

DOC = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"wort{i % 9973}" for i in range(120_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Ünd 1 😀 the"), (4, "Ünd 1 😀 the"), (5, LONG), (None, "the fox"), (None, None), (7, "x" * 200_000)]


def odd(spark):
    """Odd rows with further columns, some named like results."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")})
    return rows.withColumns({c: F.lit("own") for c in ("ids", "n_tokens", "decoded", "item", "key", "score", "rank", "terms", "n", "term", "segment", "value", "part")})


# op11 -----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    with open(path, "rb") as f:
        return bpe.WordBPE(f.read()), Tokenizer.from_file(path)


def same(both, text):
    own, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.unpacked(own.encode(text)) == ids
    assert own.decode(own.encode(text)).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAeé'sStTlL 1!Σσ\n\x1c\x85")), max_size=60))
def test_bpe_is_the_librarys(both, text):
    same(both, text)


def test_bpe_on_special_strings_long_words_and_controls(both):
    rng = random.Random(3)
    for text in ("<|endoftext|>", "a<|endoftext|><|startoftext|>B <|ENDOFTEXT|>", "don't we'll I'D", "\x00\x1c\x7f a\x1fb", "́e", "İΣ ΑΣ", "ing" * 5000, "x" * 200_000):
        same(both, text)
    for size in (bpe.SCANNED - 1, bpe.SCANNED, bpe.SCANNED + 1, 900):
        for _ in range(20):
            same(both, "".join(rng.choices("theingrasoñ", k=size)))


def test_scanned_and_queued_merges_agree(both):
    rng = random.Random(4)
    for _ in range(300):
        word = bytes(rng.choices(b"theingraso", k=rng.randint(1, bpe.SCANNED)))
        parts = [both[0].inner[c] for c in word]
        parts[-1] = both[0].last[word[-1]]
        assert both[0].merged(word) == both[0]._queued(parts)


def test_bpe_query_on_given_documents(spark, both):
    got = {r["doc_id"]: r for r in bpe.op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc, text in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        ids = both[1].encode(text or "", add_special_tokens=False).ids
        told = both[1].decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(told.encode()).hexdigest())
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == want


def test_bpe_on_odd_rows(spark, both):
    rows = odd(spark)
    encoded = bpe.encode(rows, carry=rows.columns)
    got = bpe.decode(encoded, carry=encoded.columns).collect()
    assert len(got) == len(ODD) and set(got[0].asDict()) == set(rows.columns)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((d, both[0].encode(t)) for d, t in ODD)
    assert all(r["decoded"] == "" and r["n_tokens"] == 0 for r in got if not (r["text"] or "").strip())
    assert bpe.encode(rows.limit(0)).count() == 0
    assert both[0].decode(np.array([10**6, 0], "<u4").tobytes()) == b"!"


# op12 -----------------------------------------------------------------------------------------------
def brute_search(docs, items, best):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    held = [(d, Counter(words(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(words(t))
    out = []
    for i, wanted in terms.items():
        scores = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("best,block", [(3, 1000), (3, 7), (50, 1000)])
def test_search_is_brute_force(spark, best, block):
    rng = random.Random(best + block)
    vocabulary = [f"t{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    prose = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, prose(rng.randint(0, 40))) for i in range(300)] + [(5, prose(9)), (None, prose(9)), (None, None), (301, "")]
    docs += [(400 + i, docs[7][1]) for i in range(8)]
    items = [(i, prose(8)) for i in range(9)] + [(3, prose(3)), (None, prose(5)), (50, None), (51, ""), (52, "absent")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"), best=best, block_words=block).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items, best)


def test_search_prunes_common_terms(spark):
    """A frequent word's bound lies under the threshold that a rarer word's kth impact sets."""
    docs = [(i, "the " + ("rare" if i % 20 == 0 else f"w{i}")) for i in range(400)]
    shared = {"the": 0, "rare": 1}
    vectors = spark.createDataFrame([(d, len(t.split()), [shared[w] for w in t.split() if w in shared], [1] * sum(w in shared for w in t.split())) for d, t in docs], "key long, n long, terms array<long>, counts array<long>")
    statistics = lexical.term_statistics(vectors, 400, 800, best=10)
    rows = {r["term"]: r for r in lexical.pruned(spark.createDataFrame([(0, 0), (0, 1)], "item long, term long"), statistics).collect()}
    assert rows[1]["essential"] and not rows[0]["essential"] and 0 < rows[0]["rest"] < rows[0]["threshold"]


def test_search_on_odd_rows(spark):
    items = spark.createDataFrame([(1, "the fox"), (2, LONG), (3, None)], "item_id long, text string")
    got = lexical.search(odd(spark), items).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(ODD, [(1, "the fox"), (2, LONG), (3, None)], 50)
    assert lexical.search(odd(spark).limit(0), items).count() == 0
    assert lexical.search(odd(spark), items.limit(0)).count() == 0


def test_search_with_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "two")], "name string, body string")
    items = spark.createDataFrame([("q", "one"), ("r", "three")], "item_id string, text string")
    assert [r[:3] for r in lexical.search(docs, items, key="name", text="body").collect()] == [("q", 1, "a")]


# op13 -----------------------------------------------------------------------------------------------
def brute_audit(docs, least, best):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    n, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        n[lang or "", source or ""].update(words(text))
        df[lang or ""].update(set(words(text)))
    out = []
    for lang in {k[0] for k in n}:
        kept = sorted(t for t, c in df[lang].items() if c >= least)
        groups = {s: c for (la, s), c in n.items() if la == lang}
        share = lambda c, tot: 1 + (10**9 * (c + 5)) // (tot + 5 * len(kept))
        p = {s: {t: share(c[t], sum(c[x] for x in kept)) for t in kept} for s, c in groups.items()}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in groups:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:best]
            out += [(lang, s, part, x.decode(), -v, r) for part, rows in (("pair", pair), ("term", term)) for r, (v, x) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,wave,segment", [(4, 8, 16_384), (1, 2, 16), (2, 3, 7), (3, 1, 50)])
def test_audit_is_brute_force(spark, monkeypatch, block, wave, segment):
    monkeypatch.setattr(divergence, "SEGMENT", segment)
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = random.Random(block)
    vocabulary = ["the", "Ünd", "naïve", "a", "b", "été", *(f"w{chr(97 + i)}" for i in range(26))]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12))), rng.choice(["en", "de", None, "de"]), rng.choice(["s1", "s2", "s3", None, "s5", "s6", "ß"])) for i in range(400)]
    docs += [(900, None, "en", "empty"), (901, "1 2", "de", "digits"), (902, "once", "xx", "a"), (903, "once", "xx", "b"), (904, "alone", "yy", "c"), *docs[:3]]
    got = divergence.audit(spark.createDataFrame(docs, DOC), least=5, best=4, wave=wave, block=block).collect()
    assert sorted(map(tuple, got)) == brute_audit(docs, 5, 4)


def test_every_two_blocks_meet_once(spark):
    for blocks in (1, 2, 3, 4, 7, 10):
        turns = spark.range(blocks).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(max(1, blocks + blocks % 2 - 1)))).alias("r"))
        met = [(r["i"], r["j"]) for r in turns.withColumn("j", divergence.opponent(F.col("i"), F.lit(blocks), F.col("r"))).where("j is not null").collect()]
        assert sorted(met) == [(i, j) for i in range(blocks) for j in range(blocks) if i != j]


def test_shares_are_exact_for_large_counts():
    for n, total in ((0, 6), (10**12, 10**13 + 7), (9 * 10**14, 9 * 10**14 + 5), (123456789012, 8 * 10**15)):
        assert divergence.shares(np.array([n], np.int64), total)[0] == 1 + (10**9 * (n + 5)) // total


def test_audit_on_odd_rows(spark):
    rows = odd(spark)
    docs = [(d, t, "x", None) for d, t in ODD]
    assert sorted(map(tuple, divergence.audit(rows, least=1).collect())) == brute_audit(docs, 1, 50)
    assert divergence.audit(rows.limit(0)).count() == 0


def test_residents_stay(spark):
    """The resident side of a meeting is read as it lies: only the visitors are shuffled."""
    rows = spark.createDataFrame([(1, 0, 0)], "k int, a int, b int")
    stay = rows.repartition(4, "k").persist()
    try:
        met = stay.groupBy("k").cogroup(rows.withColumnRenamed("a", "c").groupBy("k")).applyInArrow(lambda x, y: x, stay.schema)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.split("InMemoryRelation")[0].count("Exchange") == 1 or plan.count("ENSURE_REQUIREMENTS") == 1
    finally:
        stay.unpersist()
