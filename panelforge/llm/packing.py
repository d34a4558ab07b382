"""Packing documents into training sequences: best fit over several permitted lengths at once.

A document of n tokens becomes full pieces of the longest permitted length and one remainder.  How
the pieces pack depends on their lengths alone, so the only thing that leaves the cluster is a
histogram of lengths, with at most as many rows as the longest permitted length.  Best-fit-decreasing
runs over it in whole groups of equal bins: pieces of one length go to the open bins they fill best;
where none has room, the bin size of least cost for each token it can hold is opened; at the end
each bin takes the smallest permitted length that holds its contents.

The plan says which ranks of each length go to which bins.  Pieces are ranked within their length in
parallel, a frequent length in several parts, and meet the plan in a broadcast join; the plan's size
depends on the permitted lengths, not on the data.

Defined results: a document without tokens (null, empty or blank text) has no piece; rows with equal or
null ids are packed as separate documents, each with its own pieces; an empty table has no bins; a text of any
length is cut into pieces; of other columns only ``key`` and ``n_tokens`` are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.stored import Scratch
from panelforge.llm.tables import table

CAPACITIES = (256, 512, 1024, 2048)
#: Pieces of one length ranked together, and parts of ranked pieces summed up together.
RANKED_TOGETHER, SUMMED_TOGETHER = 512, 4096


def sequence_cost(capacity: int) -> float:
    """Tokens, a fixed share of each sequence, and attention's growth with its length."""
    return capacity + 32 + capacity * capacity / 65536


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


class _Bins:
    """``count`` bins of equal contents: ``filled`` lists (length, pieces in each bin)."""

    def __init__(self, count: int, room: int, used: int = 0, filled: tuple = ()):
        self.count, self.room, self.used, self.filled = count, room, used, filled

    def with_(self, count: int, length: int, pieces: int) -> _Bins:
        more = ((length, pieces),) if pieces else ()
        return _Bins(count, self.room - length * pieces, self.used + length * pieces, self.filled + more)


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> list[_Bins]:
    """Best-fit-decreasing over a histogram of lengths."""
    capacities = sorted(capacities)
    bins: list[_Bins] = []
    by_room: list[tuple[int, int]] = []  # (room, index into bins) of bins with room left
    lengths = sorted(histogram)
    mass, total = [0], 0  # tokens in pieces up to each length
    for n in lengths:
        total += n * histogram[n]
        mass.append(total)

    def keep(b: _Bins) -> None:
        if b.count:
            bins.append(b)
            insort(by_room, (b.room, len(bins) - 1))

    def fill(b: _Bins, length: int, left: int) -> int:
        """Puts pieces into equal bins, each as full as it gets; what they can't take is left."""
        each = b.room // length
        full, rest = divmod(min(left, each * b.count), each)
        keep(b.with_(full, length, each))
        if rest:
            keep(b.with_(1, length, rest))
        keep(b.with_(b.count - full - bool(rest), length, 0))
        return left - full * each - rest

    for length in reversed(lengths):
        left = histogram[length]
        while left:
            at = bisect_left(by_room, (length, -1))
            if at < len(by_room):
                _, i = by_room.pop(at)
                b, bins[i] = bins[i], _Bins(0, 0)
                left = fill(b, length, left)
                continue

            def per_token(c: int) -> float:
                each = c // length
                rest = c - each * length
                shorter = mass[bisect_left(lengths, min(rest + 1, length))]
                return cost(c) / (each * length + min(rest, shorter * each / left))

            size = min((c for c in capacities if c >= length), key=per_token)
            left = fill(_Bins(-(-left // (size // length)), size), length, left)
    return [b for b in bins if b.count]


def _slots(bins: list[_Bins], capacities: Sequence[int]) -> list[tuple]:
    """(length, first and end rank, pieces in each bin, first bin, capacity, offset in the bin)."""
    rows, taken, first = [], {}, 0
    for b in bins:
        offset = 0
        capacity = min(c for c in capacities if c >= b.used)
        for length, each in b.filled:
            at = taken.get(length, 0)
            taken[length] = at + b.count * each
            rows.append((length, at, taken[length], each, first, capacity, offset))
            offset += length * each
        first += b.count
    return rows


def pack(df: DataFrame, key: str = "doc_id", n_tokens: str = "n_tokens", capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """One row per piece: key, piece, start (in the document), n_tokens, bin_id, bin_capacity, bin_offset."""
    spark, longest = df.sparkSession, max(capacities)
    n = F.coalesce(F.col(n_tokens).cast("long"), F.lit(0).cast("long"))
    # Counting tokens reads every text; it is done once.
    counted = Scratch(spark, "packing").store(df.select(F.col(key), n.alias("n")).where("n > 0"))
    pieces = (
        counted.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))).alias("piece"))
        .select(key, F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("length"))
    )
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(_slots(plan(histogram, capacities, cost), capacities), "length int, first long, end long, each long, bin long, bin_capacity int, offset long")

    parts = spark.createDataFrame([(k, -(-v // RANKED_TOGETHER)) for k, v in histogram.items()], "length int, parts long")
    part = F.pmod(F.xxhash64(key, "piece", F.lit(7)), F.col("parts"))
    parted = pieces.join(F.broadcast(parts), "length").withColumn("part", part)
    sizes = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("size"))
    # Parts are summed up in blocks, and the blocks in turn, so that no task orders all parts of a frequent length.
    sizes = sizes.withColumn("block", F.floor(F.col("part") / SUMMED_TOGETHER))
    before = lambda c, *by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_block = sizes.withColumn("ahead", before("size", "length", "block", order="part"))
    blocks = sizes.groupBy("length", "block").agg(F.sum("size").alias("size"))
    blocks = blocks.select("length", "block", before("size", "length", order="block").alias("blocks_ahead"))
    offsets = in_block.join(blocks, ["length", "block"]).select("length", "part", (F.col("ahead") + F.col("blocks_ahead")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy(key, "piece")) - 1
    ranked = parted.withColumn("within", within).join(offsets, ["length", "part"]).withColumn("rank", F.col("ahead") + F.col("within"))

    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).drop(slots["length"])
    ordinal = F.col("rank") - F.col("first")
    return placed.select(
        key,
        "piece",
        "start",
        F.col("length").cast("long").alias("n_tokens"),
        (F.col("bin") + F.floor(ordinal / F.col("each"))).alias("bin_id"),
        "bin_capacity",
        (F.col("offset") + ordinal % F.col("each") * F.col("length")).alias("bin_offset"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens")))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
