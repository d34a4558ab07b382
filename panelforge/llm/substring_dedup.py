"""Exact removal of repeated substrings by suffix arrays over shards.

A byte goes when a string of ``LENGTH`` bytes that covers it starts anywhere else as well.  Beside that,
passages that documents share are counted: runs of more than ``PASSAGE_WORDS`` words in bytes that strings of
``PASSAGE`` bytes cover which also start in another document.

Every string of ``PASSAGE`` bytes, a window, has an anchor: the place of the least hash among its first ``SPREAD``
byte runs.  Equal windows have equal anchors, so windows are handled in groups, one for each anchor of
a text: those windows overlap, their common part is the group's core, and what they and the longer strings from
their starts span is its segment.
A core that occurs once cannot hold a repeated window, which rules out most of the text without moving it.
A segment that occurs again as a whole holds repeated windows only, which settles most of each copy.
The rest, where texts agree in part of a segment, goes to shards by core with one example of every
settled segment.  Cores that lie close together in the least text that holds them share a shard, their home, so that
segments of one text that overlap travel and are sorted as one.  In a shard, a suffix array built by induced sorting and its
permuted common prefixes show which windows, of either length, begin in more than one place.

A shard is bounded.  A core with more than ``CROWD`` segments is split: windows ``STRIDE`` places or fewer apart
from each other before the anchor share more text than the core, and that text is their key instead.  Where even
such a part has more than ``CROWD`` segments, these are settled as wholes, for each length of string, and the windows of
those that stay open are compared singly with one example of every settled one, by aggregated counts of hashes.

Texts are told apart by 128-bit hashes, so that equal texts count as different places and are
settled as whole segments.  Defined results: null and empty texts have no bytes; a text shorter
than ``LENGTH`` keeps all; repeated rows are copies of each other and lose what they share; an empty table
stays empty; a text of any length is read whole, in pieces.  Columns to keep are handed on under their names, but
for those named like the results, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelforge.llm.stored import Scratch, filtered_scans
from panelforge.llm.suffix_sort import permuted_lcp, suffix_array
from panelforge.llm.tables import table
from panelforge.llm.text_hash import Windows, mix, word_bounds

LENGTH = 400
#: A shared passage: bytes of the strings that must start in another document, and words that it has more than.
PASSAGE, PASSAGE_WORDS = 256, 50
SPREAD, RUN = 192, 64
#: Bytes of the core: the part that all windows of one anchor share.
CORE = PASSAGE - SPREAD + 1
#: What a range of window starts is known for: strings of LENGTH repeated anywhere, of PASSAGE in another document.
REPEATED, SHARED = 1, 2
SHARD_BYTES = 768 << 10
#: Bytes of a text whose cores go to one shard together, if no more than so many bytes come with them.
HOME, HOME_BYTES = 4096, SHARD_BYTES // 2
CROWD = 1500
STRIDE = 16
#: Window starts of one text handled at once.
PIECE = 1 << 20

KEY = ["k1", "k2"]


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _least(hashes: np.ndarray, size: int) -> np.ndarray:
    """Where the least hash is among the SPREAD from each of the first ``size`` places."""
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width < SPREAD:
        step = min(width, SPREAD - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least[:size] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchored(data: np.ndarray, hashes: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first and last window start of each group of windows of a text, or of texts in a row that end at ``ends``.

    Texts in a row bring their bytes' hashes and are no longer than a piece together.
    """
    n = len(data) - PASSAGE + 1
    if ends is not None:
        anchor = _least(hashes, n)
        inside = np.ones(n, bool)
        for end in ends[:-1].tolist():
            inside[end - PASSAGE + 1 : end] = False
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])))
        last = np.append(first[1:], n) - 1
        whole = inside[first]
        return anchor[first[whole]], first[whole], last[whole]
    found = []
    for at in range(0, n, PIECE):
        size = min(PIECE, n - at)
        anchor = _least(Windows(data[at : at + size + SPREAD + RUN - 2]).every(RUN), size)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        found.append(np.stack((anchor[first], first, np.append(first[1:], size) - 1)) + at)
    return tuple(np.concatenate(found, axis=1))


#: Rows handed on together, and bytes of short texts that are hashed together.
BATCH_ROWS = 100_000
ROW_BYTES = 64 << 10


def _groups_of(texts: list[bytes], keys: list[tuple[int, int]]) -> pd.DataFrame:
    """The groups of windows of texts, hashed in a row."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    cores = Windows(data)
    anchor, first, last = anchored(data) if len(texts) == 1 else anchored(data, cores.every(RUN), ends)
    owner = np.searchsorted(ends, first, side="right")
    # The count of windows goes in as well: near a text's end, equal bytes can hold fewer.
    segment = mix(Windows(data, 1).hash(first, np.minimum(last + LENGTH, ends[owner])) ^ (last - first).astype(np.uint64))
    begin = ends[owner] - np.array([len(x) for x in texts])[owner]
    k1, k2 = np.array(keys, np.int64)[owner].T
    core = cores.hash(anchor, anchor + CORE).view(np.int64)
    return pd.DataFrame({"k1": k1, "k2": k2, "core": core, "segment": segment.view(np.int64), "first": (first - begin).astype(np.int32), "last": (last - begin).astype(np.int32)})


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, keys, size, found = [], [], 0, []
        for k1, k2, text in zip(frame["k1"], frame["k2"], frame["text"], strict=True):
            data = text.encode()
            if texts and size + len(data) > ROW_BYTES:
                found.append(_groups_of(texts, keys))
                texts, keys, size = [], [], 0
                if sum(map(len, found)) >= BATCH_ROWS:
                    yield pd.concat(found)
                    found = []
            texts.append(data)
            keys.append((k1, k2))
            size += len(data)
        if texts:
            found.append(_groups_of(texts, keys))
        if found:
            yield pd.concat(found)


def _parted(data: bytes, core: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """Key, first and last window start of the parts of a segment: windows at up to STRIDE places before the anchor."""
    anchor = first + int(anchored(np.frombuffer(data, np.uint8, PASSAGE, first))[0][0])
    for near in range(0, SPREAD, STRIDE):
        a, b = max(first, anchor - near - STRIDE + 1), min(last, anchor - near)
        if a <= b:
            common = data[anchor - near : anchor - near - STRIDE + 1 + PASSAGE]
            yield int.from_bytes(hashlib.blake2b(common, digest_size=8, key=f"{core} {near}".encode()).digest(), "big", signed=True), a, b


def _joined(segments: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Home, first and last window start of segments; those of a home whose bytes overlap are joined."""
    out: list[tuple[int, int, int]] = []
    for home, first, last in sorted(segments):
        if out and out[-1][0] == home and first < out[-1][2] + LENGTH:
            out[-1] = (home, out[-1][1], max(last, out[-1][2]))
        else:
            out.append((home, first, last))
    return out


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each wanted segment of a text; segments of one home that overlap as one."""
    columns = ["k1", "k2", "core", "crowded", "first", "last", "bytes"]
    for frame in frames:
        rows: list[tuple] = []
        for k1, k2, text, wanted in zip(frame["k1"], frame["k2"], frame["text"], frame["wanted"], strict=True):
            data = text.encode()
            crowded = [part for w in wanted if w["crowded"] for part in _parted(data, w["core"], w["first"], w["last"])]
            joined = _joined((w["home"], w["first"], w["last"]) for w in wanted if not w["crowded"])
            rows += [(k1, k2, key, c, a, b, data[a : b + LENGTH]) for c, parts in ((True, crowded), (False, joined)) for key, a, b in parts]
            if len(rows) >= BATCH_ROWS // 10:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], mark.view(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


_SPANS = "k1 long, k2 long, first int, last int, kind int"


def repeated_in_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """Ranges of window starts in the shard's segments whose windows also begin elsewhere in it, by kind."""
    sizes = shard["bytes"].map(len).to_numpy()
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.frombuffer(b"\0".join(shard["bytes"]) + b"\0", np.uint8)
    coded = symbols.astype(np.uint16) + 1
    coded[begin + sizes] = 0
    order = suffix_array(coded, 257)
    common = permuted_lcp(symbols, order, LENGTH)[order]
    text = shard.groupby(KEY, sort=False).ngroup().to_numpy()
    owner = np.repeat(np.arange(len(shard)), sizes + 1)
    # A place is a text and a position in it.
    place = text[owner] * (1 << 40) + shard["first"].to_numpy(np.int64)[owner] + np.arange(len(symbols)) - begin[owner]
    windows = (shard["last"] - shard["first"] + 1).to_numpy()
    found = []
    for kind, length, starts, where in ((REPEATED, LENGTH, np.maximum(sizes - LENGTH + 1, 0), place), (SHARED, PASSAGE, windows, text[owner])):
        # Only whole windows of a segment's own text.
        edges = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + starts, -1)
        usable = (np.cumsum(edges[:-1]) > 0)[order]
        at, alike = order[usable], np.cumsum(common < length)[usable]
        edge = np.flatnonzero(np.append(True, alike[1:] != alike[:-1])) if len(at) else np.zeros(0, np.int64)
        mark = np.zeros(len(symbols), bool)
        if len(edge):
            several = np.minimum.reduceat(where[at], edge) < np.maximum.reduceat(where[at], edge)
            mark[at[np.repeat(several, np.diff(np.append(edge, len(at))))]] = True
        first, last = _runs(mark)
        row = owner[first]
        shift = shard["first"].to_numpy(np.int64)[row] - begin[row]
        found.append(pd.DataFrame({"k1": shard["k1"].to_numpy()[row], "k2": shard["k2"].to_numpy()[row], "first": (first + shift).astype(np.int32), "last": (last + shift).astype(np.int32), "kind": np.int32(kind)}))
    return pd.concat(found)


def _lengths(part: pd.DataFrame) -> Iterator[tuple[int, int, pd.DataFrame, list[np.ndarray], np.ndarray]]:
    """kind, length, and of the parts with windows of that length: rows, bytes, and how many windows."""
    for kind, length in ((REPEATED, LENGTH), (SHARED, PASSAGE)):
        some = part[part["bytes"].map(len) >= length]
        texts = [np.frombuffer(x, np.uint8) for x in some["bytes"]]
        yield kind, length, some, texts, np.minimum(some["last"] - some["first"] + 1, [len(x) - length + 1 for x in texts]).to_numpy(np.int64)


def _hashed(rows: pd.DataFrame, hashes: Callable[[int], list[np.ndarray]]) -> pd.DataFrame:
    for seed, name in enumerate(("h1", "h2")):
        rows[name] = np.concatenate([np.zeros(0, np.uint64), *hashes(seed)]).view(np.int64)
    return rows


def _whole_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For either length, what the windows of each crowded part span, as two hashes."""
    for part in frames:
        for kind, length, some, texts, n in _lengths(part):
            out = some[[*KEY, "first"]].reset_index(drop=True)
            out["last"] = (out["first"] + n - 1).astype(np.int32)
            out["kind"] = np.int32(kind)
            yield _hashed(out, lambda seed, texts=texts, n=n, length=length: [Windows(x, seed).hash(np.array([0]), np.array([k + length - 1])) for x, k in zip(texts, n, strict=True)])


def _single_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both hashes of every window, of the lengths asked for, of open parts."""
    for frame in frames:
        for at in range(0, len(frame), BATCH_ROWS // STRIDE):
            for kind, length, some, texts, n in _lengths(frame.iloc[at : at + BATCH_ROWS // STRIDE]):
                asked = (some["kinds"] & kind > 0).to_numpy()
                some, n, texts = some[asked], n[asked], [x for x, a in zip(texts, asked, strict=True) if a]
                out = pd.DataFrame(np.repeat(some[KEY].to_numpy(np.int64), n, axis=0), columns=KEY)
                out["kind"] = np.int32(kind)
                out["first"] = np.concatenate([np.zeros(0, np.int32), *(np.arange(a, a + k, dtype=np.int32) for a, k in zip(some["first"], n, strict=True))])
                out["last"] = out["first"]
                yield _hashed(out, lambda seed, texts=texts, n=n, length=length: [Windows(x, seed).every(length)[:k] for x, k in zip(texts, n, strict=True)])


def _covered(n: int, length: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n bytes are covered by strings that start in the ranges, as far as they fit."""
    last = np.minimum(last, n - length)
    first, last = first[first <= last], last[first <= last]
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, last + length, -1)
    return np.cumsum(edges[:-1]) > 0


def shared_passages(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> int:
    """Runs of more than PASSAGE_WORDS words under the windows whose starts are given, or that equal one of those."""
    last = np.minimum(last, len(data) - PASSAGE)
    first, last = first[first <= last], last[first <= last]
    if not len(first):
        return 0
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, last + 1, -1)
    known = np.cumsum(edges[:-1])[: len(data) - PASSAGE + 1] > 0
    if not known.all():
        # A segment that recurs within its text was compared with other texts at one of its places only.
        hashes = Windows(data).every(PASSAGE)
        ordered = np.sort(hashes)
        if (ordered[1:] == ordered[:-1]).any():
            known = np.isin(hashes, hashes[known])
    begin, end = _runs(_covered(len(data), PASSAGE, *_runs(known)))
    starts, stops = word_bounds(data)
    words = np.searchsorted(stops, end + 1, side="right") - np.searchsorted(starts, begin)
    return int((words > PASSAGE_WORDS).sum())


def _without(carry: list[str], kept: bool):
    """Counts and digest, and if wanted the bytes, of what is left of each text without the windows in its spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests, passages, left = [], [], [], [], []
            for text, marked in zip(batch.column("__text"), batch.column("spans"), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                first, last, kind = (marked.values.field(i).to_numpy() for i in range(3))
                again = kind & REPEATED > 0
                gone = _covered(len(data), LENGTH, first[again], last[again])
                rest = data[~gone].tobytes()
                removed.append(len(data) - len(rest))
                runs.append(len(_runs(gone)[0]))
                digests.append(hashlib.sha256(rest).hexdigest())
                passages.append(shared_passages(data, first[kind & SHARED > 0], last[kind & SHARED > 0]))
                if kept:
                    left.append(rest)
            columns = {c: batch.column(c) for c in carry} | {"n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "n_passages": pa.array(passages, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(left, pa.binary())} if kept else {}))

    return cut


#: Columns of the result beside the kept ones; the bytes that are left only if wanted.
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept")


class Repeats:
    """The repeated windows of one table of texts."""

    def __init__(self, docs: DataFrame, text: str):
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession, "repeats")
        whole = F.coalesce(F.col(text), F.lit(""))
        # The given columns travel in one, so that their names can't clash.
        keys = dict(zip(KEY, text_key(F.col("__text")), strict=True))
        self.docs = docs.select(F.struct("*").alias("__row"), whole.alias("__text")).withColumns(keys)

    def _texts_of(self, wanted: DataFrame, docs: DataFrame) -> tuple[DataFrame, AbstractContextManager]:
        """The rows of ``docs`` that ``wanted`` names, joined to it, behind a filter on the scan."""
        low = wanted.agg(F.min("k1")).first()[0]
        # Every row passes the condition; it marks this side as the one to filter the scan by.
        wanted = wanted.where(F.col("k1") >= (low if low is not None else 0))
        return docs.join(wanted, KEY), filtered_scans(self.spark)

    def spans(self) -> DataFrame:
        """k1, k2, first, last: ranges of starts of repeated windows, stored."""
        scratch = self.scratch
        long_texts = self.docs.where(F.octet_length("__text") >= PASSAGE).select(*KEY, F.col("__text").alias("text"))
        groups = scratch.store(long_texts.mapInPandas(_groups, "k1 long, k2 long, core long, segment long, first int, last int"))
        cores = scratch.store(groups.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
        low = cores.agg(F.min("core")).first()[0]
        with filtered_scans(self.spark):
            shared = scratch.store(groups.join(cores.where(F.col("core") >= (low if low is not None else 0)), "core"))
        # Texts that several rows have are repeated and shared as a whole.
        copied = groups.where("first = 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        whole = scratch.store(copied.select(*KEY, F.lit(0).alias("first"), F.lit(2**31 - 1).alias("last"), F.lit(REPEATED | SHARED).alias("kind")))
        scratch.drop(groups, cores)
        example = F.min(F.struct(*KEY, "first", "last"))
        segments = shared.groupBy("core", "segment").agg(F.count(F.lit(1)).alias("n"), example.alias("e"), F.max(F.struct(*KEY)).alias("other"))
        segments = scratch.store(segments.select("core", "segment", "n", "e", (F.struct("e.k1", "e.k2") != F.col("other")).alias("crosses")))
        kind = F.when(F.col("crosses"), REPEATED | SHARED).otherwise(REPEATED).alias("kind")
        settled = shared.join(segments.where("n > 1").select("core", "segment", kind), ["core", "segment"]).select(*KEY, "first", "last", "kind")

        windows = F.sum(F.col("e.last") - F.col("e.first") + 1).alias("windows")
        open_cores = segments.groupBy("core").agg(F.count_if(~F.col("crosses")).alias("own"), F.count(F.lit(1)).alias("kinds"), windows, F.min("e").alias("e")).where("own > 0 and kinds > 1")
        block = F.xxhash64("e.k1", "e.k2", F.floor(F.col("e.first") / HOME)).alias("block")
        open_cores = open_cores.select("core", "kinds", "windows", (F.col("kinds") > CROWD).alias("crowded"), block)
        # At most HOME cores are least in a block.
        near = Window.partitionBy("block", "crowded")
        roomy = F.sum("windows").over(near) + LENGTH * F.max("kinds").over(near) <= HOME_BYTES
        open_cores = open_cores.select("core", "crowded", F.when(roomy, F.col("block")).otherwise(F.col("core")).alias("home"))
        open_segments = segments.select("core", "e.*").join(open_cores, "core")
        wanted = scratch.store(open_segments.groupBy(*KEY).agg(F.collect_list(F.struct("core", "home", "crowded", "first", "last")).alias("wanted")))
        texts, filtered = self._texts_of(wanted, self.docs.select(*KEY, "__text"))
        with filtered:
            cut = texts.select(*KEY, F.col("__text").alias("text"), "wanted").mapInPandas(_cut, "k1 long, k2 long, core long, crowded boolean, first int, last int, bytes binary")
            # Equal texts bring the same segments; one is kept.
            once = scratch.store(cut.groupBy(*KEY, "core", "crowded", "first", "last").agg(F.first("bytes").alias("bytes")))
        parts = once.where("crowded").groupBy("core").agg((F.count(F.lit(1)) > CROWD).alias("crowded"))
        cut = once.where("not crowded").unionByName(once.where("crowded").drop("crowded").join(parts, "core"))
        size = cut.where("not crowded").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        shards = max(1, math.ceil(size / SHARD_BYTES))
        shard = F.pmod(F.xxhash64(F.lit(3), "core"), F.lit(shards)).alias("shard")
        sorted_ = cut.where("not crowded").select(*KEY, "first", "last", "bytes", shard)
        found = sorted_.groupBy("shard").applyInPandas(lambda pdf: repeated_in_shard(pdf), _SPANS)

        # Strings of LENGTH repeat where they start at another place, those of PASSAGE are shared where they are in another text.
        place = F.struct(*KEY, F.when(F.col("kind") == REPEATED, F.col("first")).alias("at"))
        by = ["kind", "h1", "h2"]
        known = lambda df: df.groupBy(*by).agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min(F.struct(*KEY, "first")).alias("e"))
        marked = lambda df, kinds: df.join(kinds.where("a <> b").select(*by), by).select(*KEY, "first", "last", "kind")
        hashed = "k1 long, k2 long, first int, last int, kind int, h1 long, h2 long"
        wholes = scratch.store(cut.where("crowded").mapInPandas(_whole_parts, hashed))
        kinds = scratch.store(known(wholes))
        examples = kinds.groupBy("e").agg(F.sum("kind").cast("int").alias("kinds")).select("e.*", "kinds")
        single = scratch.store(cut.where("crowded").join(examples, [*KEY, "first"]).mapInPandas(_single_windows, hashed))
        crowded = marked(wholes, kinds).unionByName(marked(single, known(single)))
        marks = settled.unionByName(whole).unionByName(found).unionByName(crowded)
        # A set, as copies of a text bring the same ranges.
        out = scratch.store(marks.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last", "kind")).alias("spans")))
        scratch.drop(shared, segments, whole, wanted, once, wholes, kinds, single)
        return out

    def removed(self, *keep: str, kept: bool = True) -> DataFrame:
        """The columns ``keep`` of every row with n_bytes, n_removed, n_spans, kept_sha256, n_passages and, if wanted, kept, the bytes that are left."""
        spans = self.spans()
        keep = [c for c in keep if c.lower() not in RESULTS]
        results = list(RESULTS[: len(RESULTS) - (not kept)])
        row = F.struct(*[F.col("__row")[c].alias(c) for c in keep]).alias("__row")
        docs = self.docs.select(row, "__text", *KEY, F.octet_length("__text").cast("long").alias("n_bytes"))
        texts, filtered = self._texts_of(spans, docs)
        rows = texts.select("__row", "n_bytes", "__text", "spans")
        schema = StructType([*(rows.schema[c] for c in ("__row", "n_bytes")), *StructType().add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("n_passages", "long").fields])
        with filtered:
            some = self.scratch.store(rows.mapInArrow(_without(["__row", "n_bytes"], kept), schema.add("kept", "binary") if kept else schema).select("__row", *results))
        # All that is wanted of the others is worked out before they are shuffled.
        zero = F.lit(0).cast("long")
        rest = docs.withColumns({"n_removed": zero, "n_spans": zero, "n_passages": zero, "kept_sha256": F.sha2(F.col("__text"), 256), "kept": F.encode(F.col("__text"), "UTF-8")})
        whole = some.unionByName(rest.select("__row", *results, *KEY).join(spans.select(*KEY), KEY, "left_anti").select("__row", *results))
        return whole.select(*[F.col("__row")[c].alias(c) for c in keep], *results)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every whole document, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Repeats(docs, "text").removed("doc_id", kept=False)


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES: dict[str, str] = {}
