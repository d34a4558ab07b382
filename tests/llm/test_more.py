"""Learned operators on the given tables, reputations without evidence, hot lengths, ids of other types."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import decontam, jaccard, packing, quality, toxicity, url_reputation
from tests.llm.test_odd import NAMES, TEXTS, odd

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


# op2 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block_words", [3, 1000])
def test_decontamination_by_ids_of_any_type(spark, block_words):
    items = spark.createDataFrame([("q1", "a b c"), ("q2", "c d"), (None, "z z"), ("q3", "b c")], "item_id string, text string")
    docs = spark.createDataFrame([("x", "a b c d"), ("y", "z z a b c z z"), ("x", "none"), (None, None)], "doc_id string, text string")
    got = decontam.find_contamination(docs, items, block_words=block_words).collect()
    told = sorted((str(r["doc_id"]), r["__n_words"], [(s["start"], s["stop"]) for s in r["__spans"]], r["__items"]) for r in got)
    assert told == [("None", 0, [], []), ("x", 1, [], []), ("x", 4, [(0, 4)], ["q1", "q2", "q3"]), ("y", 7, [(0, 7)], ["q1", "q3"])]


def test_later_blocks_write_what_they_find_only(spark, monkeypatch):
    sizes, real = [], decontam.Scratch.store

    def counted(self, df):
        out = real(self, df)
        sizes.append((sorted(c for c in out.columns if not c.startswith("__")), out.count()))
        return out

    monkeypatch.setattr(decontam.Scratch, "store", counted)
    items = spark.createDataFrame([(i, f"item {i} text") for i in range(4)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"word {i} item 3 text" if i == 7 else f"word {i}") for i in range(50)], "doc_id long, text string")
    got = decontam.find_contamination(docs, items, block_words=3).where(F.size("__items") > 0).collect()
    assert [(r["doc_id"], r["__items"]) for r in got] == [(7, [3])]
    # The rows once; a count of words for each; then the hits of each further block.
    assert sizes == [(["doc_id", "text"], 50), ([], 50), ([], 0), ([], 0), ([], 1)]


# op3 ------------------------------------------------------------------------------------------------
def _template(rng, n, own, common=180):
    shared = " ".join(f"c{i}" for i in range(common))
    return [(i, shared + " " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(own))) for i in range(n)]


@pytest.mark.parametrize("percent,own", [(90, 12), (80, 30)])
def test_documents_of_one_template_are_not_all_compared(spark, monkeypatch, percent, own):
    """What they share falls short of the threshold; only planted copies are linked."""
    monkeypatch.setattr(jaccard, "BANDED", 300)
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    rng = random.Random(percent)
    rows = _template(rng, 700, own)
    rows += [(1000 + i, rows[i][1] + " extra") for i in range(0, 40, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicate_classes(df, k=3, percent=percent).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}


def test_bands_lose_no_link(spark, monkeypatch):
    """Sets around the threshold, in bands of all kinds, against all pairs."""
    for name, value in (("BANDED", 10), ("BLOCK", 8), ("CROWD", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(11)
    base = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(base[: rng.randint(40, 60)])
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(12)}" if rng.random() < 0.5 else f"o{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for percent in (80, 90):
        parent[:] = range(len(rows))
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
        got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=percent).collect()}
        assert got == {i: root(i) for i in range(len(rows))}


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_the_join_does_not_pile_up_shuffle_files(spark, monkeypatch):
    """What a step shuffles goes when its table is written; it used to lie there until the driver collected its garbage.  Spark takes files away beside other work."""
    write, left = DataFrameWriter.parquet, []

    def written(self, *args, **kwargs):
        before = _shuffle_files(spark)
        write(self, *args, **kwargs)
        left.append(_shuffle_files(spark) - before)

    monkeypatch.setattr(DataFrameWriter, "parquet", written)
    rng = random.Random(3)
    jaccard.near_duplicate_classes(spark.createDataFrame(_template(rng, 60, 12), "doc_id long, text string"), k=3, percent=90)
    assert len(left) > 10 and sum(bool(x & _shuffle_files(spark)) for x in left) < len(left) / 5


def test_passes_give_the_same_classes(spark, monkeypatch):
    """Posting lists, plans, met pairs, verified pairs and blocks of families in several passes each; tables that are read no more are gone."""
    rng = random.Random(12)
    rows = _template(rng, 40, 30, 120)
    rows += [(100 + i, " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))) for i in range(30)]
    for i, text in rows[:]:
        words = text.split()
        for j in range(1, 4):
            words[rng.randrange(len(words))] = f"q{rng.randrange(10**6)}"
            rows.append((1000 * j + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    want = sorted(map(tuple, jaccard.near_duplicate_classes(df, k=3, percent=80).collect()))
    assert len({c for _, _, c in want}) < len(want)
    for name, value in (("PASS", 1500), ("PAIRS", 400), ("passes", None)):
        monkeypatch.setattr(jaccard.Join if value is None else jaccard, name, value or (lambda self, n: min(3, max(1, n // 10))))
    for crowd in (10**6, 4):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        join = jaccard.Join(df, "doc_id", "text", 3, 80)
        assert 3 < join.parts < 9
        assert sorted(map(tuple, join.classes().collect())) == want
        assert id(join.postings) not in join.scratch.paths


# op4, op5 -------------------------------------------------------------------------------------------
def _held_out(rows, label):
    labels = rows.sparkSession.read.parquet(f"{LARGER}/labels.parquet").groupBy("doc_id").agg(F.max(label).alias("y"))
    return {(r["y"], r["predicted"]): r["count"] for r in rows.where("held_out").join(labels, "doc_id").where("y is not null").groupBy("y", "predicted").count().collect()}


def test_toxicity_of_held_out_documents(spark):
    n = _held_out(toxicity.op4_toxicity(spark, LARGER), "toxic")
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))


def test_quality_of_held_out_documents(spark):
    n = _held_out(quality.op5_quality(spark, LARGER), "quality")
    assert n.get((1, 0), 0) + n.get((0, 1), 0) <= 0.02 * sum(n.values())


# op8 ------------------------------------------------------------------------------------------------
def _verdicts(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r["url"]: r["verdict"] for r in url_reputation.judge(df).where("rule is null").collect()}


def test_nothing_is_blocked_without_outcomes_of_its_own(spark):
    bad = [f"http://h{i % 3}.bad.net/es/{i}" for i in range(90)]
    got = _verdicts(spark, [*bad, *(f"http://a{i}.site.org/p" for i in range(30)), "http://b.co.uk/", "none", "http://h0.bad.net/de/"])
    assert got.pop("http://h0.bad.net/de/") == "block"
    assert set(got.values()) == {"allow"} and len(got) == 32


def test_a_rule_on_one_path_does_not_block_a_host(spark):
    """One path in four is blocked on each host but one, where nearly all is."""
    urls = [f"http://h{h}.d{h % 3}.net/{p}/{i}" for h in range(9) for i in range(20) for p in ("es", "de", "en", "it")]
    urls += [f"http://evil.d9.net/fr/{i}" for i in range(200)] + ["http://evil.d9.net/de/"]
    got = _verdicts(spark, urls)
    assert got.pop("http://evil.d9.net/de/") == "block"
    assert set(got.values()) == {"allow"}


def test_reputation_of_hidden_labels(spark):
    """Hosts that are bad or good throughout: verdicts on a tenth of the labels, hidden, agree with them."""
    rng = random.Random(5)
    rows = [(f"h{h}.d{h % 7}.s{h % 2}", int(rng.random() < (0.95 if h % 3 == 0 else 0.03)), rng.random() < 0.1) for h in range(40) for _ in range(60)]
    df = spark.createDataFrame(rows, "host string, bad int, hidden boolean")
    reputed = url_reputation.host_reputation(df.where("not hidden"))
    blocked = (F.col("known") & (url_reputation.lower_bound(F.col("mean"), F.col("weight")) > 0.5)).cast("int")
    right = df.where("hidden").join(reputed, "host").agg(F.avg((blocked == F.col("bad")).cast("int"))).first()[0]
    assert right > 0.9


# op9 ------------------------------------------------------------------------------------------------
def test_a_hot_length_is_ranked_in_parts_of_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 4)
    monkeypatch.setattr(packing, "SUMMED_TOGETHER", 3)
    docs = spark.createDataFrame([(i, 2048 * (i % 5)) for i in range(300)] + [(900 + i, 700) for i in range(50)], "doc_id long, n_tokens long")
    got = packing.pack(docs)
    rows = got.collect()
    assert len(rows) == 60 * (1 + 2 + 3 + 4) + 50
    taken = sorted((r["bin_id"], r["bin_offset"], r["bin_offset"] + r["n_tokens"], r["bin_capacity"]) for r in rows)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(taken, taken[1:], strict=False)) and all(t[2] <= t[3] for t in taken)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # No window orders a length alone but that over blocks of parts.
    assert sum("block#" in line or "part#" in line for line in windows) == len(windows)


# the pipeline ---------------------------------------------------------------------------------------
def test_quality_stage_of_odd_rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumns({c: F.lit(f"own {c}") for c in NAMES})
    docs = given.unionByName(odd(spark, [(d if d is None else 10**6 + d, t) for d, t in TEXTS]))
    out = corpus_pipeline.quality(spark, docs, SF)
    assert out.columns == docs.columns and corpus_pipeline.quality(spark, docs.limit(0), SF).count() == 0
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in NAMES) and 0 < len(rows) < docs.count()
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    assert out.join(clean, "doc_id", "left_semi").count() >= 0.95 * given.join(clean, "doc_id", "left_semi").count()
