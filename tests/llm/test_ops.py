"""The operators against brute force on small texts, with nulls, empties, ties, repeats and empty tables."""

import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.llm import ann, decontam, jaccard, langid, packing, pii, quality, substring_dedup, toxicity, url_reputation
from panelforge.llm.components import components
from panelforge.llm.fm_index import FMIndex
from panelforge.llm.grammar import BOUNDARY, INSULT, INTENT, NEGATION, OTHER, REPORT, SYMBOLS, TARGET, THREAT, clause_scores
from panelforge.llm.stored import Scratch
from panelforge.llm.suffix_sort import permuted_lcp, suffix_array

DOC = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


def prose(rng, n, vocabulary=None):
    return " ".join(rng.choice(vocabulary) if vocabulary else "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


# op1 ------------------------------------------------------------------------------------------------
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


PII_TEXTS = [
    "1.2.3.4 00255.0000.1.256 1.2.3.4.5.6.7.8 0.00.000.255 a@b.com_foo@x.com x@y foo..@a-.b.c@d.e.f",
    "4111 1111 1111 1111 +1 (555) 123-4567. GB82 WEST 1234 5698 7654 32 iban",
    "é😀4111-1111-1111-1111 card 4111111111111112 +49 30 123456 256.1.1.1",
    "9" * 5000,
    "mail a@b.com " * 3_000,
    "",
    None,
    "+((",
]


def test_pii_matches_plain_regular_expressions(spark):
    base = set(BASE)
    for r in pii.find_spans(docs(spark, PII_TEXTS)).collect():
        assert [f"{s['kind']}:{s['start']}:{s['stop']}" for s in r["spans"] if s["kind"] in base] == plain_spans(r["text"] or "")


def test_pii_of_a_long_text(spark):
    got = pii.find_spans(docs(spark, ["mail a@b.com token " + "ab1" * 400_000])).first()["spans"]
    assert [(s["kind"], s["start"], s["stop"]) for s in got] == [("email", 5, 12), ("secret", 19, 1_200_019)]


def test_pii_checksums_and_context(spark):
    kinds = lambda t: {s["kind"] for s in pii.find_spans(docs(spark, [t])).first()["spans"]}
    assert "iban" in kinds("GB82 WEST 1234 5698 7654 32") and "iban" not in kinds("GB83 WEST 1234 5698 7654 32")
    assert "secret" in kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x') and "secret" not in kinds("part 04dbebab91ab85687d33eeaaf9ac699e1188f962")
    assert "national_id" in kinds("social 123-45-6789") and "national_id" not in kinds("part 123-45-6789")


def test_pii_masks_and_keeps_nulls(spark):
    got = [r["text"] for r in pii.redact(docs(spark, ["é mail a@b.com!", None, "1.2.3.4a@1.2.3.4"])).orderBy("doc_id").collect()]
    assert got == ["é mail <EMAIL>!", None, "<IP>a@<IP>"] or got[:2] == ["é mail <EMAIL>!", None]


# op2 ------------------------------------------------------------------------------------------------
def plain_hits(text, items, window=13):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        w = decontam.words_of(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    if item is not None:
                        found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1 << 20, 21])
def test_decontamination_matches_brute_force(spark, block_words):
    rng = random.Random(3)
    v = ["Ab", "c1", "Ünd", "d", "e"]
    items = [(1, prose(rng, 20, v)), (2, "Ünd c1"), (3, None), (4, "..."), (2, "Ünd c1"), (None, "e e e")]
    texts = [prose(rng, 30, v), f"x, {items[0][1]} y", None, "", "ünd-C1!", f"{items[0][1]} {items[0][1]}"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, [*texts, texts[1]])
    got = {r["doc_id"]: r for r in decontam.find_contamination(df, benchmark, block_words=block_words).collect()}
    for i, t in enumerate([*texts, texts[1]]):
        r = got[i]
        assert (r["__n_words"], sum(s["stop"] - s["start"] for s in r["__spans"]), sorted(r["__items"])) == plain_hits(t, items)


def test_decontamination_takes_one_block_at_a_time(spark, monkeypatch):
    held, most = [], []
    real = type(spark.sparkContext).broadcast

    def counted(self, value):
        out = real(self, value)
        held.append(out)
        most.append(sum(len(b.value[1]) for b in held))
        destroy = out.destroy
        out.destroy = lambda *a: (held.remove(out), destroy(*a))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    benchmark = spark.createDataFrame([(i, f"item {i} text") for i in range(5)], "item_id long, text string")
    df = docs(spark, ["say item 3 text", "item 0 text item 4 text", "none"])
    got = decontam.find_contamination(df, benchmark, block_words=3).orderBy("doc_id").collect()
    assert [r["__items"] for r in got] == [[3], [0, 4], []] and [r["__n_words"] for r in got] == [4, 6, 1]
    assert len(most) == 5 and max(most) == 1


def test_decontamination_of_nothing_and_of_clashing_names(spark):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.find_contamination(docs(spark, []), benchmark).count() == 0
    df = docs(spark, ["x a b"]).withColumns({c: F.lit(9) for c in ("__spans", "item_id", "n_words")})
    for words in (1, 100):
        got = decontam.find_contamination(df, benchmark.unionByName(benchmark), carry=df.columns, block_words=words).first()
        assert (got["item_id"], got["n_words"], got["__items"]) == (9, 9, [1])


def test_decontamination_with_an_empty_benchmark(spark):
    got = decontam.find_contamination(docs(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")).first()
    assert (got["__n_words"], got["__spans"], got["__items"]) == (2, [], [])


def test_fm_index_locates_all():
    rng = np.random.default_rng(0)
    seq = rng.integers(1, 4, 200)
    index = FMIndex(seq, 5)
    patterns = rng.integers(1, 5, (40, 3))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(198) if (seq[i : i + 3] == p).all()]


# op3 ------------------------------------------------------------------------------------------------
def plain_classes(texts, k, percent):
    def shingled(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets, parent = [shingled(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), root(i)) for i in range(len(sets))]


def test_jaccard_of_text_keys(spark):
    rows = spark.createDataFrame([("b", "v w x y z", 1), ("a", "v w x y z", 1), ("c", "other words here", 1), (None, "v w x y z", 1)], "name string, text string, n int")
    got = {r["name"]: r["component_id"] for r in jaccard.near_duplicate_classes(rows, key="name").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", None: None}


@pytest.mark.parametrize("crowd", [4096, 4])
def test_jaccard_classes_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(6)]
    base += [" ".join(base[0].split()[:n]) for n in (56, 50, 44)]
    texts = [None, "", "one", "one", "one two", " \t\n", prose(rng, 30_000)]
    for b in base:
        for _ in range(7):
            w = b.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    got = jaccard.near_duplicate_classes(docs(spark, texts), k=3, percent=80)
    assert sorted(map(tuple, got.collect())) == plain_classes(texts, 3, 80)


def test_jaccard_of_nothing_and_of_null_ids(spark):
    assert jaccard.near_duplicate_classes(spark.createDataFrame([], DOC)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")], DOC)
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.near_duplicate_classes(rows).collect()) == [(-1, -1), (2, 2), (3, 2)]


def test_components_of_a_long_chain(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long").repartition(7)
    got = dict(map(tuple, components(links, Scratch(spark, "test")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# op4, op5, op10 -------------------------------------------------------------------------------------
def test_grammar_weighs_context():
    one = lambda *symbols: clause_scores(list(symbols), [1.0] * len(symbols))
    assert one(OTHER, INSULT)[0] > one(NEGATION, INSULT)[0]
    assert one(TARGET, OTHER, INSULT)[0] > one(OTHER, INSULT)[0] > one(REPORT, INSULT)[0]
    assert one(NEGATION, BOUNDARY, INSULT) == one(OTHER, INSULT)
    assert one(OTHER, TARGET) == []
    assert one(INTENT, THREAT, TARGET)[0] > one(THREAT)[0] > one(NEGATION, THREAT)[0]
    assert one(INSULT, INSULT)[0] > 2 * one(INSULT)[0]


def plain_clauses(symbols, weights):
    """Each scored word's weight times what every view makes of the words before it in its clause."""
    scores, clause = [], []
    for symbol, weight in [*zip(symbols, weights, strict=True), (BOUNDARY, 0.0)]:
        if symbol != BOUNDARY:
            clause.append((symbol, weight))
            continue
        total = 0.0
        for i, (x, w) in enumerate(clause):
            if x in (INSULT, THREAT):
                before = [y for y, _ in clause[:i]]
                w *= (1.0, 1.25, 1.5)[min(2, before.count(INSULT))] if x == INSULT else 1.0 if INTENT in before[-4:] else 0.4
                total += w * (1.5 if TARGET in before else 1) * (0.25 if NEGATION in before[-3:] else 1) * (0.5 if REPORT in before else 1)
        if any(x in (INSULT, THREAT) for x, _ in clause):
            scores.append(total)
        clause = []
    return scores


def test_grammar_matches_plain_rules():
    rng = random.Random(5)
    for _ in range(300):
        symbols = [rng.choice(SYMBOLS) for _ in range(rng.randint(0, 30))]
        weights = [rng.uniform(0.3, 2) for _ in symbols]
        assert np.allclose(clause_scores(symbols, weights), plain_clauses(symbols, weights))


def labelled(spark, rows):
    return docs(spark, [t for t, _ in rows]), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, label int")


def test_toxicity_learns_unlisted_words(spark):
    rng = random.Random(2)
    rows = [(prose(rng, 40) + (f" you zorgle{rng.choice('abcdef')} there zorgle{rng.choice('xyz')}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df, labels = labelled(spark, rows)
    model = toxicity.fit_toxicity(df, labels)
    got = model.score(["what a zorgleq you are zorglew", prose(rng, 40), "", None])
    assert got[0] > 0.7 and (got[1:] < 0.7).all()


def test_quality_separates_and_scores_everything(spark):
    rng = random.Random(4)
    rows = [(prose(rng, 50).upper().replace(" ", "!! ") if i % 3 == 0 else prose(rng, 90), int(i % 3 != 0)) for i in range(150)]
    df, labels = labelled(spark, rows)
    model = quality.fit_quality(df, labels)
    extra = docs(spark, [rows[0][0], rows[1][0], None, "", "   "])
    got = [r["quality_score"] for r in quality.score_quality(extra, model).orderBy("doc_id").collect()]
    assert got[0] < 0.5 < got[1] and all(0 <= x <= 1 for x in got)
    assert quality.fit_quality(df, labels.where("label = 1")) == 1.0 and quality.fit_quality(df, labels.limit(0)) == 0.5


def test_quality_attention_gradient():
    rng = np.random.default_rng(0)
    x, begin, y = rng.standard_normal((40, quality.FEATURES)).astype(np.float32), np.array([0, 7, 15, 30]), np.array([0, 1, 0, 1.0])
    model = quality.AttentionModel().fit(x, begin, y)
    assert ((model.score(x, np.repeat(np.arange(4), [7, 8, 15, 10])) > 0.5) == y).all()


def test_cross_parsing_counts_phrases():
    parser = langid.CrossParser({"a": "abcabcabd", "b": "xyz"})
    assert parser.phrases(["abcabd", "zyx", "aéb"]).tolist() == [[1, 6], [3, 3], [3, 3]]


def test_language_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "der die das und nicht", "de"), (2, "the and of with that", "en"), (3, None, None), (4, "123 ½!", None), (5, "and the", None)], "doc_id long, text string, lang string")
    training = langid.training_text(df, "text", "lang")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, training).collect()}
    assert got == {1: "de", 2: "en", 3: "und", 4: "und", 5: "en"}
    assert {r["lang_pred"] for r in langid.identify(df, {}).collect()} == {"und"}


# op6 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("tight", [False, True])
def test_ann_recall(spark, monkeypatch, tight):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((150, 16)), 4, axis=0) + (0.02 if tight else 0.3) * rng.standard_normal((600, 16))
    if tight:  # several blocks, and queries that need a larger radius
        monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
        monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
        monkeypatch.setattr(ann, "COVERED", 0.4)
    x[5] = x[4]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [math.nan] * 16), (650, [None] * 16), (700, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    index = ann.Index(df, Scratch(spark, "test"))
    got = index.nearest(df.where("id % 50 = 0"), 3).toPandas()
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = y @ y[q]
        s[q] = -2
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3] and np.allclose(mine.score, s[mine.vec_id])
        hits += len(set(mine.vec_id) & set(np.lexsort((np.arange(600), -s))[:3]))
    assert hits >= 0.9 * 36 and set(got.query_id) == set(range(0, 600, 50))


@pytest.mark.parametrize("tables", ann.TABLES)
def test_every_code_within_the_radius_is_retrieved_once(tables):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (300, ann.BITS // 8), dtype=np.uint8)
    codes[150:] = codes[:150] ^ (rng.random((150, ann.BITS // 8)) < 0.1) * rng.integers(0, 256, (150, ann.BITS // 8), dtype=np.uint8)
    near = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2, dtype=int)
    for radius in (0, 3, 50, 101, 115, ann.BITS):
        got = [p for t in range(tables) for p in zip(*(a.tolist() for a in ann.retrieved(t, tables, codes, codes, radius)[:2]), strict=True)]
        assert sorted(got) == list(zip(*(a.tolist() for a in np.nonzero(near <= radius)), strict=True))


def test_tables_follow_the_radius():
    """Wide radii rule nothing out: one table, one key.  Near neighbours in many rows: most keys are left alone."""
    assert ann.least_probing(105, 4) == ann.least_probing(105, 16) == 1 and ann.key_width(105, 16, 1) == 0
    m = ann.least_probing(20, 14)
    shares = [ann.probed_share(t, ann.key_width(t, 14, m)) for t in ann.thresholds(20, m).tolist()]
    assert m > 1 and sum(shares) < 0.05
    assert ann.probed_share(-1, 4) == 0


def test_ann_with_ties_repeated_ids_and_null_components(spark):
    rows = [(0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [3.0, 0.0]), (3, [0.0, 1.0]), (5, [1.0, None]), (50, [1.0, 1.0]), (None, [1.0, 0.0]), (9, [4.0, 0.0]), (11, [math.inf, 1.0]), (0, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = ann.Index(df, Scratch(spark, "test")).nearest(df.where("id % 50 = 0 and vector[0] > 0"), 3).collect()
    # Equal vectors go by id; the rows of id 3 count once, by the better; other rows of a query's id are its own.
    assert sorted((r[0], r[1], r[2]) for r in got) == [(0, 1, 3), (0, 2, 7), (0, 3, 9), (50, 1, 0), (50, 2, 3), (50, 3, 7)]


def test_ann_of_nothing(spark):
    df = spark.createDataFrame([(0, None)], "id long, vector array<float>")
    assert ann.Index(df, Scratch(spark, "test")).nearest(df).count() == 0


# op7 ------------------------------------------------------------------------------------------------
def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        s = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60)))
        sa = suffix_array(s, 5)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: list(s[i:]))
        lcp = permuted_lcp(s.astype(np.uint8), sa, 1000, 8)
        for a, b in zip(sa[1:], sa, strict=False):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert lcp[a] == k


@pytest.mark.parametrize("crowd", [1500, 2, 1])
def test_repeats_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rng = random.Random(6)
    shared, long, short = prose(rng, 80), prose(rng, 300), " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60))
    line = prose(rng, 55) + "\n"
    texts = [None, "", "short", prose(rng, 50) + shared + prose(rng, 90), shared + prose(rng, 70), "é" + shared[:430], long, long, long[:900] + "!" + long[901:], "ab" * 600, prose(rng, 400)]
    texts += [f"{prose(rng, 9)} {short} {prose(rng, 30)}", f"{prose(rng, 40)} {short}", short, short[:290], line * 3 + prose(rng, 20), prose(rng, 7) + " " + line[:310], "x y " * 200]
    length, passage = substring_dedup.LENGTH, substring_dedup.PASSAGE
    data = [(t or "").encode() for t in texts]
    seen, docs_of = {}, {}
    for i, x in enumerate(data):
        for j in range(len(x) - length + 1):
            seen.setdefault(x[j : j + length], []).append((i, j))
        for j in range(len(x) - passage + 1):
            docs_of.setdefault(x[j : j + passage], set()).add(i)
    want = []
    for i, x in enumerate(data):
        gone, shares = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for j in range(len(x) - length + 1):
            if len(seen[x[j : j + length]]) > 1:
                gone[j : j + length] = True
        for j in range(len(x) - passage + 1):
            if len(docs_of[x[j : j + passage]]) > 1:
                shares[j : j + passage] = True
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", x)]
        passages = sum(sum(m.start() <= a and b <= m.end() for a, b in words) > 50 for m in re.finditer(b"1+", shares.astype(np.uint8).tobytes().replace(b"\1", b"1")))
        want.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), passages))
    df = docs(spark, texts).withColumns({c: F.lit(1) for c in ("spans", "k1", "wanted", "n_bytes", "kept")})
    got = substring_dedup.Repeats(df, "text").removed("doc_id", kept=False)
    assert sorted(map(tuple, got.collect())) == want
    passages = [w[-1] for w in want]
    assert all(passages[11:15]) and not any(passages[:3])


def test_shard_of_long_repeats():
    rng = np.random.default_rng(3)
    length, passage = substring_dedup.LENGTH, substring_dedup.PASSAGE
    block = rng.integers(97, 101, 2500, dtype=np.uint8)
    pieces = []
    for i in range(40):
        x = block[(a := int(rng.integers(0, 900))) : a + int(rng.integers(900, 1600))].copy()
        x[rng.integers(0, len(x), i % 3)] = 120
        pieces.append((i, 0, 10, 10 + len(x) - passage, x.tobytes()))
    found = substring_dedup.repeated_in_shard(pd.DataFrame(pieces, columns=["k1", "k2", "first", "last", "bytes"]))
    for kind, size in ((substring_dedup.REPEATED, length), (substring_dedup.SHARED, passage)):
        at: dict[bytes, list] = {}
        for k1, _, first, _, x in pieces:
            for j in range(len(x) - size + 1):
                at.setdefault(x[j : j + size], []).append((k1, first + j))
        want = {p for places in at.values() if len(places if size == length else {k for k, _ in places}) > 1 for p in places}
        rows = found[found["kind"] == kind]
        assert {(k, p) for k, a, b in zip(rows["k1"], rows["first"], rows["last"], strict=True) for p in range(a, b + 1)} == want


@pytest.mark.parametrize("home, most", [(4096, 393_216), (512, 393_216), (4096, 0)])
def test_repeats_of_near_copies(spark, monkeypatch, home, most):
    monkeypatch.setattr(substring_dedup, "HOME", home)
    monkeypatch.setattr(substring_dedup, "HOME_BYTES", most)
    rng = random.Random(8)
    base, texts = [prose(rng, 900) for _ in range(2)], []
    for i in range(24):
        x = list(base[i % 2][rng.randrange(700) :])
        for _ in range(i % 5):
            x[rng.randrange(len(x))] = "#"
        texts.append("".join(x))
    length, seen = substring_dedup.LENGTH, {}
    for i, x in enumerate(texts):
        for j in range(len(x) - length + 1):
            seen.setdefault(x[j : j + length], []).append((i, j))
    gone = [np.zeros(len(x), bool) for x in texts]
    for places in seen.values():
        for i, j in places if len(places) > 1 else ():
            gone[i][j : j + length] = True
    want = [(i, int(g.sum()), hashlib.sha256(np.frombuffer(x.encode(), np.uint8)[~g].tobytes()).hexdigest()) for i, (x, g) in enumerate(zip(texts, gone, strict=True))]
    got = substring_dedup.Repeats(docs(spark, texts), "text").removed("doc_id", kept=False)
    assert sorted(map(tuple, got.select("doc_id", "n_removed", "kept_sha256").collect())) == want


def test_overlapping_segments_travel_as_one():
    text = prose(random.Random(2), 600)
    _, first, last = substring_dedup.anchored(np.frombuffer(text.encode(), np.uint8))
    wanted = [{"core": i, "home": 7, "crowded": False, "first": int(a), "last": int(b)} for i, (a, b) in enumerate(zip(first, last, strict=True))]
    apart = {"core": 99, "home": 8, "crowded": False, "first": int(first[0]), "last": int(last[0])}
    out = pd.concat(substring_dedup._cut(iter([pd.DataFrame({"k1": [1], "k2": [2], "text": [text], "wanted": [[apart, *wanted]]})])))
    assert sorted(out["bytes"].map(len)) == sorted([len(text), int(last[0]) + substring_dedup.LENGTH])


def test_texts_in_a_row_have_the_groups_of_each():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (60, 700, 61, 90, 4000, 300)] + ["é" * 128, "x" * 256]
    texts = [t for t in texts if len(t.encode()) >= substring_dedup.PASSAGE]
    frame = pd.DataFrame({"k1": range(len(texts)), "k2": range(len(texts)), "text": texts})
    together = pd.concat(substring_dedup._groups(iter([frame])))
    single = pd.concat([pd.concat(substring_dedup._groups(iter([frame.iloc[[i]]]))) for i in range(len(texts))])
    assert together.to_numpy().tolist() == single.to_numpy().tolist()


def test_repeats_of_nothing(spark):
    assert substring_dedup.Repeats(docs(spark, []), "text").removed("doc_id").count() == 0


# op8, op9 -------------------------------------------------------------------------------------------
def test_url_rules_and_reputation(spark):
    bad = [(f"http://h{i % 3}.bad.net/es/{i}",) for i in range(60)] + [(f"http://h{i % 3}.bad.net/de/{i}",) for i in range(6)]
    odd = [(None,), ("nothing",), ("HTTP://WWW.Example.com/en/a?b#c",), ("http://example.com/en/",), ("http://x.org/?q",), ("http://com",)]
    df = spark.createDataFrame([*bad, *odd], "url string")
    got = {r["url"]: r for r in url_reputation.judge(df).collect()}
    assert got["http://h0.bad.net/de/0"]["verdict"] == "block" and got["http://h0.bad.net/de/0"]["rule"] is None
    assert (got["HTTP://WWW.Example.com/en/a?b#c"]["rule"], got["HTTP://WWW.Example.com/en/a?b#c"]["path"]) == ("www.example.com/en/", "/en/a")
    assert got["http://example.com/en/"]["verdict"] == "block"
    assert (got[None]["host"], got[None]["path"], got["nothing"]["host"]) == ("", "", "")
    assert got["http://com"]["rule"] is None and got["http://x.org/?q"]["path"] == "/"
    assert url_reputation.judge(df.limit(0)).count() == 0


def plain_plan(lengths, capacities, cost):
    """Tokens and room of each bin: one piece after the other into the fullest that takes it; a length opens bins of one size."""
    bins, room = [], []
    lengths = sorted(lengths, reverse=True)
    for length in sorted(set(lengths), reverse=True):
        count, size = lengths.count(length), None
        while count:
            fits = [i for i, r in enumerate(room) if r >= length]
            if fits:
                i = min(fits, key=lambda i: room[i])
            else:
                if size is None:

                    def per_token(c, left=count, length=length):
                        each = c // length
                        rest = c - each * length
                        shorter = sum(n for n in lengths if n <= rest and n < length)
                        return cost(c) / (each * length + min(rest, shorter * each / left))

                    size = min((c for c in sorted(capacities) if c >= length), key=per_token)
                i = len(bins)
                bins.append([])
                room.append(size)
            bins[i].append(length)
            room[i] -= length
            count -= 1
    return sorted((sum(b), r) for b, r in zip(bins, room, strict=True))


def test_packing_plan_matches_piece_by_piece():
    rng = random.Random(9)
    for _ in range(60):
        lengths = [rng.choice([rng.randint(1, 64), 7, 30]) for _ in range(rng.randint(1, 80))]
        got = packing.plan({n: lengths.count(n) for n in lengths}, (16, 32, 64))
        got = sorted((sum(n * each for n, each in b.filled), b.room) for b in got for _ in range(b.count))
        assert got == plain_plan(lengths, (16, 32, 64), packing.sequence_cost)


def test_packing_is_a_partition_within_capacities(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, 5, 5, 5, 40, 100, rng.randint(1, 400)]) for _ in range(500)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(1000, None), (7, sizes[7])], "doc_id long, n_tokens int")
    got = packing.pack(df, capacities=(32, 64, 128)).toPandas()
    assert got.n_tokens.sum() == sum(sizes) + sizes[7]
    bins = got.sort_values(["bin_id", "bin_offset"]).groupby("bin_id")
    assert (bins.n_tokens.sum() <= bins.bin_capacity.first()).all() and (bins.bin_capacity.nunique() == 1).all()
    smaller = bins.bin_capacity.first().map({32: 0, 64: 32, 128: 64})
    assert (bins.n_tokens.sum() > smaller).all()
    assert all((g.bin_offset.to_numpy() == np.concatenate(([0], np.cumsum(g.n_tokens)[:-1]))).all() for _, g in bins)
    room = []  # best-fit-decreasing with the longest capacity alone
    for n in sorted(got.n_tokens, reverse=True):
        fits = [r for r in room if r >= n]
        room.append((room.pop(room.index(min(fits))) if fits else 128) - n)
    assert bins.bin_capacity.first().sum() <= 128 * len(room)
    assert packing.pack(df.limit(0)).count() == 0
