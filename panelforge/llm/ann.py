"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors get ``BITS``-bit codes: principal axes, then rotations learned so that signs lose least.  Codes
are cut into substrings, each with its own index table keyed by the leading bits of the
substring.  By the pigeonhole principle two codes within a Hamming radius of r agree in some substring, of m,
up to r // m bits, or one less beyond the first r % m + 1 tables.  A query probes every key that can hold
such a substring; inside, rows are kept by their substring's distance, then by their whole code's, each
in the first table that finds them, and only the vectors of those are read for the exact cosine.

The number of tables is that of least probing: the share of its keys that a table must probe, summed over the tables, which
follows from the radius and the number of rows.  Near neighbours make many short substrings pay; where the radius is so
wide that no key could be ruled out, one table over the whole code takes each row once and not once a table.  A table
that rules no key out has one key.

The radius comes from the fitting sample: it covers ``COVERED`` of the sample's own true neighbours.
A query that finds fewer than k neighbours is searched again in growing radius, so no one gets too few.

Keys hold blocks of at most about ``BLOCK_ROWS`` rows, a frequent key several; the queries that probe a key travel in
parts too.  Each (table, key, block, part) is one bounded group; it returns at most k rows for each query.

Defined results: vectors that are null, empty, zero, hold a null or non-finite component, or differ in
length from most vectors take no part, nor do rows with a null id.  All rows with a query's id count as
its own; rows that share another id count as one, by the best of them.  Equal scores go to the smaller id.  An empty table finds nothing; columns
other than id and vector are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.stored import Scratch
from panelforge.llm.tables import table

BITS, TABLES = 256, (1, 2, 4, 8, 16)
#: Bounds of the fitting sample, and of the queries that set the radius.
FIT_ROWS, FIT_QUERIES = 8000, 400
COVERED = 0.96
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Leading bits that make a key.
LEAST_KEY, LARGEST_KEY = 4, 16
#: Queries compared with a block at once.
CHUNK = 256


def usable(vector: Column) -> Column:
    """Not null or empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Codes:
    """Sign codes after learned rotations."""

    def __init__(self, sample: np.ndarray, seed: int = 0, rounds: int = 40):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        _, axes = np.linalg.eigh(unit.T @ unit)
        axes = axes[:, ::-1][:, :BITS]
        projected, rng = unit @ axes, np.random.default_rng(seed)
        learned = []
        while sum(r.shape[1] for r in learned) < BITS:
            rotation, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
            for _ in range(rounds):
                left, _, right = np.linalg.svd(projected.T @ np.where(projected @ rotation >= 0, 1.0, -1.0))
                rotation = left @ right
            learned.append(axes @ rotation)
        self.weights = np.concatenate(learned, axis=1)[:, :BITS]
        self.radius = self._radius(unit)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """n x (BITS / 8) bytes."""
        return np.packbits(vectors @ self.weights >= 0, axis=1)

    def _radius(self, unit: np.ndarray, k: int = 5) -> int:
        """Within which the given share of the sample's k nearest lie."""
        n = min(FIT_QUERIES, len(unit))
        cosine = unit[:n] @ unit.T
        cosine[np.arange(n), np.arange(n)] = -2
        k = min(k, len(unit) - 1)
        if k < 1:
            return BITS
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        codes = self.of(unit)
        far = np.bitwise_count(codes[:n, None, :] ^ codes[near]).sum(axis=2)
        return int(np.quantile(far, COVERED, method="higher"))


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def thresholds(radius: int, tables: int) -> np.ndarray:
    """Of each table: codes within ``radius`` are within the table's threshold in one substring at least."""
    return radius // tables - (np.arange(tables) > radius % tables)


def key_width(threshold: int, bits: int, tables: int) -> int:
    """Leading bits of a substring that make its table's key; none where the threshold rules no key out."""
    bits = min(bits, BITS // tables)
    return bits if threshold < bits else 0


def probed_share(threshold: int, width: int) -> float:
    """Share of a table's keys within the threshold of a query's."""
    return sum(math.comb(width, i) for i in range(min(threshold, width) + 1)) / 2**width if threshold >= 0 else 0.0


def least_probing(radius: int, bits: int) -> int:
    """The number of tables whose probed shares sum to least."""
    total = lambda m: sum(probed_share(t, key_width(t, bits, m)) for t in thresholds(radius, m).tolist())
    return min(TABLES, key=lambda m: (total(m), m))


def distances(asked: np.ndarray, rows: np.ndarray, table_: int, tables: int) -> np.ndarray:
    """Hamming distances of all pairs in one substring."""
    size = BITS // 8 // tables
    kind = np.dtype(f"u{min(size, 8)}")
    q, r = (np.ascontiguousarray(x[:, table_ * size : (table_ + 1) * size]).view(kind) for x in (asked, rows))
    total = np.zeros((len(q), len(r)), np.uint16)
    for word in range(q.shape[1]):
        total += np.bitwise_count(q[:, word, None] ^ r[None, :, word])
    return total


def retrieved(table_: int, tables: int, asked: np.ndarray, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of the pairs of codes within the radius that this table is the first to find, and how many pairs its substring let pass."""
    within = thresholds(radius, tables)
    q, r = np.nonzero(distances(asked, rows, table_, tables) <= within[table_])
    passed = len(q)
    apart = np.bitwise_count(asked[q] ^ rows[r]).reshape(passed, tables, BITS // 8 // tables).sum(axis=2, dtype=np.int64)
    mine = (apart.sum(axis=1) <= radius) & ~(apart[:, :table_] <= within[:table_]).any(axis=1)
    return q[mine], r[mine], passed


def _nearest(k: int, codes: Codes, radius: int, tables: int):
    """The k best rows of a block for each query of a block, of those that the block's table retrieves."""

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if queries.empty or rows.empty:
            return empty
        x, ids = _stack(rows["vector"]), rows["id"].to_numpy(np.int64)
        sizes, row_codes, table_ = np.sqrt(np.einsum("ij,ij->i", x, x)), codes.of(x), int(rows["table"].iloc[0])
        found = []
        for at in range(0, len(queries), CHUNK):
            some = queries.iloc[at : at + CHUNK]
            q, own = _stack(some["query"]), some["query_id"].to_numpy(np.int64)
            i, j, _ = retrieved(table_, tables, codes.of(q), row_codes, radius)
            other = own[i] != ids[j]
            i, j = i[other], j[other]
            # Sums in one order for every pair, so that equal vectors score alike.
            score = (x[j] * q[i]).sum(axis=1) / (np.sqrt(np.einsum("ij,ij->i", q, q))[i] * sizes[j])
            # Of rows that share an id, the best.
            order = np.lexsort((-score, ids[j], i))
            again = np.append(False, (i[order][1:] == i[order][:-1]) & (ids[j[order]][1:] == ids[j[order]][:-1]))[: len(order)]
            i, j, score = (v[order[~again]] for v in (i, j, score))
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            found.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": score})[rank < k])
        return pd.concat(found)

    return search


class Index:
    """A fitted index over ``vectors`` (id, vector)."""

    def __init__(self, vectors: DataFrame, scratch: Scratch):
        self.scratch = scratch
        usable_rows = vectors.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("vector", F.col("vector").cast("array<double>"))
        sizes = usable_rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
        self.count, size = (sizes["count"], sizes["size"]) if sizes else (0, 0)
        self.vectors = usable_rows.where(F.size("vector") == size)
        if self.count:
            sample = self.vectors.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").collect()
            self.codes = Codes(np.array([r[0] for r in sample]))

    def key_bits(self) -> int:
        """Bits of a key that leave about a block's rows to each."""
        return min(LARGEST_KEY, max(LEAST_KEY, math.ceil(math.log2(max(1, self.count / BLOCK_ROWS)))))

    def tables(self, radius: int) -> int:
        return least_probing(radius, self.key_bits())

    def probed(self, radius: int) -> float:
        """Share of all tables' keys that a query probes."""
        m = self.tables(radius)
        return sum(probed_share(t, key_width(t, self.key_bits(), m)) for t in thresholds(radius, m).tolist()) / m

    def _keyed(self, df: DataFrame, radius: int, probing: bool) -> DataFrame:
        """Adds table and key: a row's own key in each table, or all keys that a query probes."""
        codes, m = self.codes, self.tables(radius)
        within, size = thresholds(radius, m).tolist(), BITS // 8 // m
        widths = [key_width(t, self.key_bits(), m) for t in within]
        # A table with a threshold below zero finds nothing that the others do not.
        used = [t for t in range(m) if within[t] >= 0]

        @F.pandas_udf("array<int>")
        def leading(vectors: pd.Series) -> pd.Series:
            code = codes.of(_stack(vectors)).astype(np.int32)
            first = np.stack([code[:, t * size] << 8 | (code[:, t * size + 1] if size > 1 else 0) for t in range(m)], axis=1)
            return pd.Series(list((first >> (16 - np.array(widths))).astype(np.int32)))

        keyed = df.select("*", F.posexplode(leading("vector")).alias("table", "key")).where(F.col("table").isin(used))
        if not probing:
            return keyed
        masks = [[mask for mask in range(1 << w) if mask.bit_count() <= t] if t >= 0 else [] for w, t in zip(widths, within, strict=True)]
        probes = df.sparkSession.createDataFrame(list(enumerate(masks)), "table int, masks array<int>")
        return keyed.join(F.broadcast(probes), "table").withColumn("mask", F.explode("masks")).withColumn("key", F.col("key").bitwiseXOR(F.col("mask"))).drop("mask", "masks")

    def search(self, queries: DataFrame, k: int, radius: int) -> DataFrame:
        """query_id, vec_id, score: at most k best for each query and group, codes within the radius only."""
        rows, asked = self._keyed(self.vectors, radius, False), self._keyed(queries, radius, True)
        # At most 16 * 2 ** LARGEST_KEY keys.
        blocks = rows.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        parts = asked.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("parts"))
        keys = F.broadcast(self.scratch.store(blocks.join(parts, ["table", "key"])))
        place = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = rows.join(keys, ["table", "key"]).select("id", "vector", "table", "key", place(1, "blocks").alias("block"), each("parts").alias("part"))
        asked = asked.join(keys, ["table", "key"]).select(F.col("id").alias("query_id"), F.col("vector").alias("query"), "table", "key", each("blocks").alias("block"), place(2, "parts").alias("part"))
        by = ["table", "key", "block", "part"]
        return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(_nearest(k, self.codes, radius, self.tables(radius)), "query_id long, vec_id long, score double")

    def nearest(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, rank, vec_id, score of each query's k nearest; queries are rows of id and vector."""
        if not self.count:
            return self.scratch.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        queries = queries.join(self.vectors.select("id").distinct(), "id", "left_semi").withColumn("vector", F.col("vector").cast("array<double>")).dropDuplicates(["id"])
        radius, settled = self.codes.radius, []
        while True:
            found = self.scratch.store(self.search(queries, k, radius).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
            if radius >= BITS:
                settled.append(found)
                break
            full = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("id")
            settled.append(found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi"))
            queries = self.scratch.store(queries.join(full, "id", "left_anti"))
            if queries.isEmpty():
                break
            radius = min(BITS, radius + BITS // 8)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return reduce(DataFrame.unionByName, settled).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every query among all embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return Index(vectors, Scratch(spark, "ann")).nearest(vectors.where(F.col("id") % 50 == 0))


QUERIES = {"op6_ann": op6_ann}
ORACLES: dict[str, str] = {}
