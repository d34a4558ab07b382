"""Ranked lexical search: the best documents for each item of a query table, by a threshold-seeded join.

Every document is read once into a vector: its number of terms, and the query terms it holds with their
occurrences.  From the stored vectors come the corpus counts, and for each term its number of
documents, its largest impact and its kth impact (the floor of the step of ``STEP`` in which the kth lies, so that
impacts are counted and never gathered).  An item's kth document can't score less than the best kth impact of its
terms: that is the threshold it starts with.  Its terms are ordered by largest impact; the longest suffix whose
largest impacts sum to less than the threshold can't carry a document into the result alone and is pruned.
Documents that hold one of the remaining terms are candidates.  A candidate whose remaining terms, with the
suffix's bound, stay below the threshold goes; the others are scored exactly over all terms.  A task raises an
item's threshold to the kth of the exact scores it has seen and prunes again, so it hands on k rows of an item at most,
and ties with the last.  No bound ever drops a document that belongs in the result.

Query items are taken in blocks of about ``BLOCK_WORDS`` terms against all documents; what a block brings to the
driver and the tasks (its terms, their statistics, its plan) is bounded by that.  A further block takes a further pass.

Scores are integers: w = floor(1000 ln((2N+2)/(2df+1))) times (10**9 tf) div (1000 tf + 20 m), summed over the item's
terms, where m = 50 + (50 n N) div L.

Defined results: a null or empty text has no terms, is in no count and is never found; an item without terms, or whose
terms no document holds, has no rows; rows with one item_id are one item, of all their terms once each, and so are the
rows whose item_id is null; rows of documents are ranked one by one, repeated or not, equal scores by id, nulls last;
texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from panelforge.llm.decontam import words_of
from panelforge.llm.stored import Scratch
from panelforge.llm.tables import table

BEST = 50
BLOCK_WORDS = 250_000
#: Impacts before the weight lie under a million; kth ones are known to steps of this size.
STEP = 4096
#: Pairs of a document's term and an item that are handled together in a task.
TOGETHER = 1_000_000
#: Parts in which an item's found rows meet before the last ranking.
PARTS = 64


def _vectors(shared, text: str, key: str):
    """doc_id, n and the query terms held, by number, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            n, terms, counts, at = [], [], [], [0]
            for t in batch.column(text).to_pylist():
                words = words_of(t)
                held = {number[w]: c for w, c in Counter(words).items() if w in number}
                n.append(len(words))
                terms += held
                counts += held.values()
                at.append(len(terms))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), *lists], names=["key", "n", "terms", "counts"])

    return run


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def term_statistics(vectors: DataFrame, total: int, length: int, best: int = BEST) -> DataFrame:
    """term, df, w, largest (impact) and kth (impact, 0 where fewer documents hold the term)."""
    m = F.lit(50) + _div(F.lit(50) * F.col("n") * F.lit(total), F.lit(max(length, 1)))
    held = vectors.select(m.alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), "m", F.col("t.counts").alias("tf"))
    impact = _div(F.lit(1_000_000_000) * F.col("tf"), 1000 * F.col("tf") + 20 * F.col("m"))
    steps = held.select("term", impact.alias("s")).groupBy("term", _div(F.col("s"), F.lit(STEP)).alias("step")).agg(F.count(F.lit(1)).alias("c"), F.max("s").alias("s"))
    above = Window.partitionBy("term").orderBy(F.desc("step"))
    counted = steps.withColumn("so_far", F.sum("c").over(above))
    kth = F.max(F.when(F.col("so_far") >= best, F.col("step") * STEP))
    found = counted.groupBy("term").agg(F.sum("c").alias("df"), F.max("s").alias("largest"), F.coalesce(kth, F.lit(0)).alias("kth"))
    w = F.floor(1000 * F.log((2.0 * F.lit(total) + 2) / (2.0 * F.col("df") + 1)))
    return found.select("term", "df", w.alias("w"), (w * F.col("largest")).alias("largest"), (w * F.col("kth")).alias("kth"))


def pruned(items: DataFrame, statistics: DataFrame) -> DataFrame:
    """item, term, w, threshold, essential, and rest: the bound of what the item's pruned terms add."""
    joined = items.join(statistics, "term")
    by_item = Window.partitionBy("item")
    suffix = F.sum("largest").over(by_item.orderBy("largest", "term"))
    bounded = joined.withColumns({"threshold": F.max("kth").over(by_item), "suffix": suffix})
    told = bounded.withColumn("essential", F.col("suffix") >= F.col("threshold"))
    rest = F.coalesce(F.max(F.when(~F.col("essential"), F.col("suffix"))).over(by_item), F.lit(0))
    return told.withColumn("rest", rest).select("item", "term", "w", "threshold", "suffix", "essential", "rest")


class _Plan:
    """What a block's items look for, as arrays: weights, thresholds, and each item's terms with the bounds of their suffixes."""

    def __init__(self, n_terms: int, n_items: int, rows: list[tuple]):
        self.item, self.term, w, threshold, self.suffix = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        self.weight = np.zeros(n_terms, np.int64)
        self.weight[self.term] = w
        self.threshold = np.ones(n_items, np.int64)
        self.threshold[self.item] = np.maximum(threshold, 1)

    def split(self, threshold: np.ndarray) -> tuple[tuple, tuple, np.ndarray]:
        """By term the items that seek it, and those that have pruned it; and by item what its pruned terms add at most."""
        pruned = self.suffix < threshold[self.item]
        rest = np.zeros(len(threshold), np.int64)
        np.maximum.at(rest, self.item[pruned], self.suffix[pruned])
        return (*(self._by_term(self.term[chosen], self.item[chosen], len(self.weight)) for chosen in (~pruned, pruned)), rest)

    @staticmethod
    def _by_term(term: np.ndarray, item: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(n_terms + 1)), item[order]


def _spread(index: tuple[np.ndarray, np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For terms in a row: the places of those that items hold, once for each item, and the items."""
    bounds, items = index
    size = bounds[terms + 1] - bounds[terms]
    place = np.repeat(np.arange(len(terms)), size)
    step = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
    return place, items[bounds[terms][place] + step]


def _summed(pair: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pair, kind="stable")
    pair, value = pair[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    return pair[first], np.add.reduceat(value, first) if len(first) else value


def _search(shared, best: int, total: int, length: int):
    """Rows of (item, key, score) that can be among an item's best."""

    def scored(seeking: tuple, other: tuple, rest: np.ndarray, threshold: np.ndarray, doc: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n_items = len(threshold)
        place, item = _spread(seeking, terms)
        pair, partial = _summed(doc[place] * n_items + item, impact[place])
        item = pair % n_items
        able = partial + rest[item] >= threshold[item]
        pair, partial = pair[able], partial[able]
        # The pruned terms of candidates, to make their scores exact.
        candidate = np.zeros(doc[-1] + 1 if len(doc) else 0, bool)
        candidate[pair // n_items] = True
        wanted = np.flatnonzero(candidate[doc])
        place, item = _spread(other, terms[wanted])
        sought = doc[wanted][place] * n_items + item
        at = np.minimum(np.searchsorted(pair, sought), max(len(pair) - 1, 0))
        hit = np.flatnonzero(pair[at] == sought) if len(pair) else np.zeros(0, np.int64)
        np.add.at(partial, at[hit], impact[wanted][place[hit]])
        item = pair % n_items
        good = partial >= threshold[item]
        return pair[good] // n_items, item[good], partial[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: _Plan = shared.value
        threshold, n_items = plan.threshold.copy(), len(plan.threshold)
        parts = plan.split(threshold)
        spread = 1 + np.diff(parts[0][0]) + np.diff(parts[1][0])
        held: list[pa.RecordBatch] = []
        waiting = 0

        def kept(found: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            """The rows of each item that no k others have beaten; raises the thresholds."""
            rows = pa.Table.from_batches(found).combine_chunks()
            item, score = rows["item"].to_numpy(), rows["score"].to_numpy()
            order = np.lexsort((-score, item))
            first = np.searchsorted(item[order], np.arange(n_items + 1))
            full = np.flatnonzero(np.diff(first) >= best)
            threshold[full] = np.maximum(threshold[full], score[order][first[full] + best - 1])
            return rows.take(pa.array(order[score[order] >= threshold[item[order]]])).combine_chunks().to_batches()

        for batch in batches:
            m = 50 + (50 * batch.column("n").to_numpy() * total) // length
            sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            terms, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            impact = plan.weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            ends = np.cumsum(sizes)
            work = np.concatenate(([0], np.cumsum(spread[terms])))[np.concatenate(([0], ends))]
            begin = 0
            while begin < len(sizes):
                end = max(begin + 1, int(np.searchsorted(work, work[begin] + TOGETHER, side="right")) - 1)
                here = slice(ends[begin] - sizes[begin], ends[end - 1])
                row, item, score = scored(*parts, threshold, doc[here] - begin, terms[here], impact[here])
                keys = batch.column("key").take(pa.array(row + begin))
                held.append(pa.RecordBatch.from_arrays([pa.array(item), keys, pa.array(score)], names=["item", "key", "score"]))
                waiting += len(row)
                if waiting > best * n_items:
                    held = kept(held)
                    waiting, parts = 0, plan.split(threshold)
                begin = end
        if held:
            yield from kept(held)

    return run


def ranked(rows: DataFrame, best: int = BEST) -> DataFrame:
    """The best rows of each item, ranked from 1; an item's rows meet in parts first."""
    order = (F.desc("score"), F.asc_nulls_last("key"))
    within = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("key", "score"), F.lit(PARTS))).withColumn("place", within).where(F.col("place") <= best)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best).select("item", "rank", "key", "score")


def item_terms(items: DataFrame, item: str, text: str, block_words: int) -> tuple[DataFrame, int]:
    """item, term and the block of each different term of each item, and the number of blocks."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.split(F.translate(F.col(text), upper, lower), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = items.select(F.col(item).alias("item"), F.explode(words).alias("term")).where("term <> ''").distinct()
    n = -(-terms.count() // block_words)
    return terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(n, 1)))), n


def search(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", best: int = BEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item, rank, key and score: each item's ``best`` documents with a score above 0.  The first and third have their given names."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical")
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    longs = ArrayType(LongType())
    vector = StructType([StructField("key", rows.schema["key"].dataType), StructField("n", LongType()), StructField("terms", longs), StructField("counts", longs)])
    hit = StructType([StructField("item", LongType()), vector["key"], StructField("score", LongType())])
    named = StructType([StructField("item", LongType()), StructField(item, items.schema[item].dataType)])
    terms, n_blocks = item_terms(items, item, item_text, block_words)
    terms = scratch.store(terms)
    found, total, length = spark.createDataFrame([], hit).select("item", F.lit(0).alias("rank"), "key", "score").join(spark.createDataFrame([], named), "item"), 0, 0
    for block in range(n_blocks):
        pairs = terms.where(F.col("block") == block).select("item", "term").collect()
        ids, words = list(dict.fromkeys(r[0] for r in pairs)), list(dict.fromkeys(r[1] for r in pairs))
        number, place = {w.encode(): i for i, w in enumerate(words)}, {x: i for i, x in enumerate(ids)}
        shared = spark.sparkContext.broadcast(number)
        vectors = scratch.store(rows.mapInArrow(_vectors(shared, "text", "key"), vector).where("n > 0"))
        shared.destroy()
        if not block:
            total, length = (x or 0 for x in vectors.agg(F.count(F.lit(1)), F.sum("n")).first())
        numbered = spark.createDataFrame([(place[r[0]], number[r[1].encode()]) for r in pairs], "item long, term long")
        plan = _Plan(len(words), len(ids), pruned(numbered, term_statistics(vectors, total, length, best)).collect())
        hits = vectors.where(F.size("terms") > 0).mapInArrow(_search(spark.sparkContext.broadcast(plan), best, total, max(length, 1)), hit)
        result = ranked(hits, best).join(F.broadcast(spark.createDataFrame(list(enumerate(ids)), named)), "item")
        found = result if n_blocks == 1 else found.unionByName(scratch.store(result))
    return found.select(F.col(item), "rank", F.col("key").alias(key), "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2.0 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS wt FROM p, c GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM p JOIN f USING (t) JOIN m USING (r) JOIN q USING (t) GROUP BY item_id, r, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""

QUERIES = {"op12_lexical": op12_lexical}
ORACLES = {"op12_lexical": _SQL}
