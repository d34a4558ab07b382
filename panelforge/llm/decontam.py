"""Benchmark decontamination: an FM-index of each training shard is searched for test phrases.

A window is 13 consecutive words of a benchmark item, or a whole shorter item.  Words outside the
benchmark's vocabulary can be in no occurrence, so a shard's index holds only its documents' runs of
vocabulary words, with a separator between runs.  That loses no occurrence and keeps the index a
small part of the text.  All windows of one length are searched backward together; positions come
from sampled suffixes; the covered words are merged into removal spans.

A shard is a bounded number of documents of one input partition.  A document lies in one shard, so
nothing is shuffled.  The benchmark goes to the tasks in blocks of at most ``BLOCK_WORDS`` words.  For a
benchmark of several blocks the rows are stored once under row numbers; each block then takes a pass that reads them and writes only
what it found to the shared folder, and is freed, in the driver and the tasks, before the next one is taken.  What all passes
found is put together by row number and joined to the rows once.

Defined results: null and empty texts have no words and no hits; an empty benchmark hits nothing;
items without words have no windows; rows with one item_id count as one item, and a null item_id's
windows hit without being listed; repeated documents are judged row by row.  A text longer than a shard is a shard
of its own; an empty table stays empty.  Columns in ``carry`` named like the results are left out in their favour.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from panelforge.llm.fm_index import FMIndex
from panelforge.llm.stored import Scratch
from panelforge.llm.tables import table, unused

WINDOW = 13
#: Benchmark words in one pass, of which each begins one window at most, and words in one shard's index.
BLOCK_WORDS = 250_000
SHARD_WORDS = 400_000

#: Bytes of words keep their value, A-Z lower-cased; all others become a space.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and anything beyond ASCII."""
    return text.encode().translate(_TO_WORDS).split() if text else []


class Windows:
    """The windows of benchmark items, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text))
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                by_length.setdefault(size, {}).setdefault(ids[i : i + size], set()).add(item)
        self.sigma = len(self.vocabulary) + 2
        self.lengths = sorted(by_length)
        self.patterns = {n: np.array(list(by_length[n]), np.int64) for n in self.lengths}
        self.items = {n: list(by_length[n].values()) for n in self.lengths}

    def occurrences(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[set]]:
        """For a shard of documents as word ids (0: outside the vocabulary): the documents' starts in
        the joined shard, how many occurrences cover each word, and the items found in each document."""
        bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for x in ids])))
        joined = np.zeros(bounds[-1], np.int64)
        for at, x in zip(bounds, ids, strict=False):
            joined[at : at + len(x)] = x
        edges, found = np.zeros(len(joined) + 1, np.int64), [set() for _ in ids]
        if self.lengths:
            inside = np.diff(np.concatenate(([0], (joined > 0).view(np.int8), [0])))
            begin, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
            long = end - begin >= self.lengths[0]
            begin, end = begin[long], end[long]
            if len(begin):
                size = end - begin + 1  # a separator follows each run
                offsets = np.concatenate(([0], np.cumsum(size)))
                source = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
                text = joined[np.minimum(source, len(joined) - 1)]
                text[offsets[1:] - 1] = 1
                index = FMIndex(text, self.sigma)
                for n in self.lengths:
                    low, high = index.search(self.patterns[n])
                    hit = np.flatnonzero(high > low)
                    counts = high[hit] - low[hit]
                    rows = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
                    at = source[index.locate(rows)]
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + n, -1)
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    for d, p in set(zip(doc.tolist(), np.repeat(hit, counts).tolist(), strict=True)):
                        found[d] |= self.items[n][p]
        return bounds, np.cumsum(edges[:-1]), found


def _spans(covered: np.ndarray) -> list[dict]:
    """Runs of covered words."""
    step = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


#: The windows of the block that this worker searched last, under the block's name.
_HELD: dict[str, Windows] = {}
RESULTS = ("__n_words", "__spans", "__items")


def _search(broadcast, text: str, window: int, carry: list[str], item_type: pa.DataType):
    """One pass over whole rows, handing on ``carry``."""

    def judged(windows: Windows, rows: pa.Table, ids: list[np.ndarray]) -> pa.RecordBatch:
        bounds, cover, found = windows.occurrences(ids)
        spans = [_spans(cover[at : at + len(x)] > 0) for at, x in zip(bounds, ids, strict=False)]
        items = [sorted(i for i in s if i is not None) for s in found]
        columns = {c: rows[c].combine_chunks() for c in carry}
        columns["__n_words"] = pa.array([len(x) for x in ids], pa.int64())
        columns["__spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        columns["__items"] = pa.array(items, pa.list_(item_type))
        return pa.Table.from_pydict(columns).combine_chunks().to_batches()[0]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = broadcast.value[0]
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Windows(broadcast.value[1], window)
        windows = _HELD[key]
        word_id = windows.vocabulary.get
        rows, ids, size = [], [], 0
        for batch in batches:
            begin = 0
            for i, t in enumerate(batch.column(text).to_pylist()):
                words = words_of(t)
                ids.append(np.fromiter((word_id(w, 0) for w in words), np.int64, len(words)))
                size += len(words)
                if size >= SHARD_WORDS:
                    yield judged(windows, pa.Table.from_batches([*rows, batch.slice(begin, i + 1 - begin)]), ids)
                    rows, ids, size, begin = [], [], 0, i + 1
            if begin < batch.num_rows:
                rows.append(batch.slice(begin))
        if ids:
            yield judged(windows, pa.Table.from_batches(rows), ids)

    return shards


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[tuple[list[tuple], bool]]:
    """The benchmark's rows in blocks of at most ``block_words`` words, or of one longer item, and whether more follow."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    if (benchmark.agg(F.sum(size)).first()[0] or 0) <= block_words:  # a word takes a byte at least
        yield [(r[0], r[1]) for r in benchmark.select(item, text).collect()], False
        return
    block: list[tuple] = []
    held = 0
    for r in benchmark.select(item, text).toLocalIterator():
        n = len(words_of(r[1]))
        if block and held + n > block_words:
            yield block, True
            block, held = [], 0
        block.append((r[0], r[1]))
        held += n
    yield block, False


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns ``carry`` of every row of ``df``, with __n_words, __spans (word ranges to remove) and __items (found)."""
    spark = df.sparkSession
    carry = list(dict.fromkeys(c for c in carry if c.lower() not in RESULTS))
    rows = df.select(*dict.fromkeys([*carry, text]))
    span, kind = StructType().add("start", "long").add("stop", "long"), benchmark.schema[item].dataType
    found = StructType().add("__n_words", "long").add("__spans", ArrayType(span)).add("__items", ArrayType(kind))

    def searched(rows: DataFrame, block: list[tuple], handed: list[str]):
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        schema = StructType([*(rows.schema[c] for c in handed), *found.fields])
        return held, rows.mapInArrow(_search(held, text, window, handed, to_arrow_type(kind)), schema)

    stored, passes, number, scratch = None, [], unused(rows, "__row"), None
    for block, more in benchmark_blocks(benchmark, item, item_text, block_words):
        if stored is None and not more:
            return searched(rows, block, carry)[1]
        if stored is None:
            scratch = Scratch(spark, "decontamination")
            stored = scratch.store(rows.withColumn(number, F.monotonically_increasing_id()))
        held, judged = searched(stored, block, [number])
        # The first pass counts every row's words; the others only add what they found.
        passes.append(scratch.store(judged.where(F.size("__spans") > 0) if passes else judged))
        held.destroy()
    both = scratch.again(*passes).groupBy(number).agg(
        F.max("__n_words").alias("__n_words"), F.array_sort(F.flatten(F.collect_list("__spans"))).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items")
    )
    return stored.select(*carry, number).join(both, number).select(*carry, "__n_words", _merged(F.col("__spans")).alias("__spans"), "__items")


def _merged(spans: Column) -> Column:
    """Spans in order of their starts, those that touch put together."""
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["stop"], s["stop"]).alias("stop"))))
    return F.aggregate(spans, F.slice(spans, 1, 0), lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["stop"] >= s["start"]), grown(a, s)).otherwise(F.concat(a, F.array(s))))


def contaminated(spans: Column, n_words: Column) -> tuple[Column, Column]:
    """Words hit, and whether they are a twentieth of the document or more."""
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return n_hit, (n_hit > 0) & (20 * n_hit >= n_words)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit and items found in every whole document."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit, bad = contaminated(F.col("__spans"), F.col("__n_words"))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("__items").cast("array<string>")), ","), 256).alias("items_sha256"),
        bad.alias("contaminated"),
    )


_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT pos.r, pos.i, pos.n, win.item_id FROM pos JOIN win USING (n, s)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""

QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {"op2_decontamination": _SQL}
