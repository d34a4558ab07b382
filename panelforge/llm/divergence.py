"""Source divergence audit: how far the word use of each source of a language is from every other source's and the language's.

The terms that at least ``LEAST`` documents of a language hold are kept, and dealt to segments of about ``SEGMENT``
terms, so that a group's (a source of a language) counts are vectors of bounded length, packed in few bytes.  The
groups of a language are put into blocks of ``BLOCK`` groups.  A block's vectors stay where they are, partitioned by
language, segment and block; packed peers travel: in round 0 every block meets itself, and then round r of a round-robin
tournament brings each block together with one other, until all have met.  A meeting gives the distance of every pair of
its groups once, for both directions.  The language's own vector and its terms come along in round 0, when each group ranks its
terms in a local heap.  ``WAVE`` rounds are one Spark job, whose results are stored before the next begins.

All arithmetic is on integers: shares are quotients of 64-bit numbers by long division in three steps, exact for
languages of up to 9 * 10**15 terms.

Counting is summed within tasks before rows are shuffled, and flushed at ``HELD`` terms, so neither a hot source nor a frequent
term gathers rows.

Defined results: a null text, language or source is read as empty; a group without kept terms has rows all the same; a
language without kept terms gives every pair the value 0 and no term; repeated rows count each; texts are read whole; an
empty table gives no rows.  Equal values are ranked by item in the order of its UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.stored import Scratch
from panelforge.llm.tables import table

#: Documents that must hold a term, added to every count, the scale of a share, and ranks of terms.
LEAST, SMOOTH, SCALE, BEST = 30, 5, 1_000_000_000, 50
SEGMENT, BLOCK, WAVE, HELD = 16_384, 4, 8, 300_000

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of the documents that a task holds at once; a row without a term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [t.decode() for t in n]
            columns = [[lang] * (len(n) + 1), [source] * (len(n) + 1), [*terms, ""], [*n.values(), 0], [*map(docs.__getitem__, n), 0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        lang, source, text = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
        for one in zip(lang, source, text, strict=True):
            n, docs = groups.setdefault(one[:2], (Counter(), Counter()))
            found = Counter(one[2].encode().translate(_LETTERS).split())
            before = len(n)
            n.update(found)
            docs.update(found.keys())
            held += len(n) - before
            if held > HELD:
                yield from flushed()
                held = 0
    yield from flushed()


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs; the empty term stands for the group itself."""
    rows = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, n of the kept terms, with their segment and place in it."""
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    segments = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SEGMENT).alias("__segments"))
    dealt = kept.join(segments, "lang").withColumn("segment", F.pmod(F.xxhash64("term"), F.col("__segments")).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "segment").orderBy("term")) - 1
    return dealt.select("lang", "term", "n", "segment", place.alias("place"))


def _pack(place: np.ndarray, n: np.ndarray) -> bytes:
    width = "<u4" if not len(n) or n.max() < 1 << 32 else "<u8"
    return width.encode() + zlib.compress(np.concatenate([place.astype("<u4").view("u1"), n.astype(width).view("u1")]).tobytes(), 1)


def _unpack(packed: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, width = zlib.decompress(packed[3:]), packed[:3].decode()
    size = len(data) // (4 + int(width[2]))
    return np.frombuffer(data, "<u4", size).astype(np.int64), np.frombuffer(data, width, size, 4 * size).astype(np.int64)


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (n + SMOOTH) / total), three digits at a time, which stays within 64 bits."""
    rest, out = n + SMOOTH, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _packed(cells: DataFrame) -> DataFrame:
    """One row for each group and segment that has counts."""

    def pack(rows: pa.Table) -> pa.Table:
        place, n = rows["place"].to_numpy(), rows["n"].to_numpy()
        order = np.argsort(place)
        one = rows.slice(0, 1).select(["lang", "source", "segment"])
        return one.append_column("vector", pa.array([_pack(place[order], n[order])], pa.binary())).append_column("held", pa.array([int(n.sum())], pa.int64()))

    return cells.groupBy("lang", "source", "segment").applyInArrow(pack, "lang string, source string, segment int, vector binary, held long")


def _dictionaries(kept: DataFrame) -> DataFrame:
    """lang, segment, terms (packed), and the language's own vector."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        one = rows.slice(0, 1).select(["lang", "segment"])
        terms = zlib.compress("\n".join(rows["term"].to_pylist()).encode(), 1)
        vector = _pack(rows["place"].to_numpy(), rows["n"].to_numpy())
        return one.append_column("terms", pa.array([terms], pa.binary())).append_column("vector", pa.array([vector], pa.binary())).append_column("size", pa.array([rows.num_rows], pa.int32()))

    return kept.groupBy("lang", "segment").applyInArrow(pack, "lang string, segment int, terms binary, vector binary, size int")


def opponent(block: Column, blocks: Column, turn: Column) -> Column:
    """The block that meets ``block`` in a turn, from 1, of a round robin of ``blocks``; none where it rests.

    Of an even number of players all but the last, an odd number m, stand in a circle: in turn r, i meets j where i + j = 2r
    modulo m, and whoever would meet itself meets the last.  An odd number of blocks has nobody for its last.
    """
    m = blocks - F.when(blocks % 2 == 0, 1).otherwise(0)
    across = F.pmod(2 * turn - block, m)
    other = F.when(block == m, F.pmod(turn, m)).when(across == block, m).otherwise(across)
    return F.when(other < blocks, other)


def _meet(best: int):
    """The meeting of a resident block with its visitors: partial distances of pairs, and terms ranked in local heaps."""

    def vector(row: dict) -> np.ndarray:
        n = np.zeros(row["size"], np.int64)
        place, found = _unpack(row["vector"])
        n[place] = found
        return n

    def run(residents: pa.Table, visitors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if residents.num_rows and visitors.num_rows:
            own = residents.to_pylist()
            counts = [vector(r) for r in own]
            mine = [shares(n, r["total"]) if len(n) else n for n, r in zip(counts, own, strict=True)]
            for batch in visitors.to_batches(max_chunksize=1):
                guest = batch.to_pylist()[0]
                n = vector(guest)
                other = shares(n, guest["total"]) if len(n) else n
                if guest["terms"] is None:
                    same = guest["home"] == own[0]["block"]
                    out += [("pair", guest["source"], r["source"], int(np.abs(p - other).sum())) for r, p in zip(own, mine, strict=True) if not same or guest["source"] < r["source"]]
                    continue
                terms = np.array(zlib.decompress(guest["terms"]).decode().split("\n"), object)
                for r, held, p in zip(own, counts, mine, strict=True):
                    excess = p - other
                    over = np.flatnonzero((held > 0) & (excess > 0))
                    if len(over) > best:  # none below the kth value can be among the best
                        over = over[excess[over] >= np.partition(excess[over], len(over) - best)[len(over) - best]]
                    ranked = heapq.nsmallest(best, zip((-excess[over]).tolist(), terms[over].tolist(), strict=True))
                    out += [("term", r["source"], t, -f) for f, t in ranked]
        lang = residents["lang"][0].as_py() if residents.num_rows else None
        part, source, item, value = zip(*out, strict=True) if out else ((),) * 4
        columns = [pa.array([lang] * len(out), pa.string()), *(pa.array(c, pa.string()) for c in (part, source, item)), pa.array(value, pa.int64())]
        return pa.Table.from_arrays(columns, names=["lang", "part", "source", "item", "value"])

    return run


def audit(documents: DataFrame, least: int = LEAST, best: int = BEST, wave: int = WAVE, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` has a row for every other source of the language, by the distance of their shares summed over the kept terms;
    part ``term`` the ``best`` terms that the source uses more than its language, by the difference.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "divergence")
    counts = scratch.store(term_counts(documents))
    kept = scratch.store(kept_terms(counts, least))
    packed = scratch.store(_packed(counts.join(kept.select("lang", "term", "segment", "place"), ["lang", "term"])))
    books = scratch.store(_dictionaries(kept))

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    held = packed.groupBy("lang", "source").agg(F.sum("held").alias("held"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term = ''").select("lang", "source").join(held, ["lang", "source"], "left").join(sizes.select("lang", "v"), "lang", "left")
    groups = groups.select("lang", "source", F.floor(number / block).cast("int").alias("block"), (F.coalesce("held", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).alias("total"))
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    # A language without kept terms has one empty segment.
    segments = blocks.join(books.select("lang", "segment", "size"), "lang", "left").select("lang", "blocks", F.coalesce("segment", F.lit(0)).alias("segment"), F.coalesce("size", F.lit(0)).alias("size"))
    vectors = scratch.store(groups.join(segments, "lang").join(packed.drop("held"), ["lang", "source", "segment"], "left"))

    keys = ["lang", "segment", "block"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    residents = vectors.select(*keys, "source", "total", "size", "vector").repartition(n, *keys).persist()
    travelling = scratch.again(vectors).select(*keys, "blocks", "source", "total", "size", "vector", F.lit(None).cast("binary").alias("terms")).withColumnRenamed("block", "home")
    own = books.join(sizes, "lang").join(blocks, "lang").select(
        "lang", "segment", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(-1).alias("home"), F.lit(None).cast("string").alias("source"),
        (F.col("lang_n") + SMOOTH * F.col("v")).alias("total"), "size", "vector", "terms",
    )
    columns = [*keys, "home", "source", "total", "size", "vector", "terms"]
    schema = "lang string, part string, source string, item string, value long"
    most = (blocks.agg(F.max("blocks")).first()[0] or 1) + 1
    found = []
    try:
        for first in range(0, most, wave):
            turns = travelling.withColumn("turn", F.explode(F.sequence(F.lit(first), F.lit(min(first + wave, most) - 1))))
            real = turns.where("turn = 0 or (turn < blocks + blocks % 2)")
            host = F.when(F.col("turn") == 0, F.col("home")).otherwise(opponent(F.col("home"), F.col("blocks"), F.col("turn")))
            # One of the two travels, in turns so that no block is always the host.
            goes = F.when((F.col("home") + F.col("block")) % 2 == 0, F.col("block") <= F.col("home")).otherwise(F.col("block") > F.col("home"))
            visitors = real.withColumn("block", host).where(F.col("block").isNotNull() & goes).select(*columns)
            if not first:
                visitors = visitors.unionByName(own.select(*columns))
            found.append(scratch.store(residents.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(_meet(best), schema)))
    finally:
        residents.unpersist()
    met = scratch.again(*found)
    once = met.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = once.select("lang", F.lit("pair").alias("part"), "value", F.inline(both))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(by))
    ranked_terms = met.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best)
    order = ["lang", "source", "part", "item", "value", "rank"]
    return ranked_pairs.select(*order).unionByName(ranked_terms.select(*order))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others and its language."""
    return audit(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
c AS (SELECT lang, source, t, count(*) AS n, count(DISTINCT r) AS df FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY lang, source, t),
k AS (SELECT lang, t, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, t HAVING sum(df) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
ck AS (SELECT c.lang, c.source, c.t, c.n FROM c JOIN k ON c.lang = k.lang AND c.t = k.t),
gn AS (SELECT g.lang, g.source, CAST(coalesce(sum(ck.n), 0) AS HUGEINT) AS n FROM g LEFT JOIN ck ON g.lang = ck.lang AND g.source = ck.source GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, k.t, coalesce(ck.n, 0) AS cnt,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(ck.n, 0) + 5)) // (gn.n + 5 * l.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (l.n + 5 * l.v) AS q
  FROM gn JOIN l ON gn.lang = l.lang JOIN k ON gn.lang = k.lang LEFT JOIN ck ON ck.lang = gn.lang AND ck.source = gn.source AND ck.t = k.t),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, p - q AS value FROM p WHERE cnt > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {"op13_divergence": op13_divergence}
ORACLES = {"op13_divergence": _SQL}
