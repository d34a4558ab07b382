"""BPE encoding and decoding of whole texts by a public vocabulary with word ends.

A text is cut at the vocabulary's special strings, normalised, and split into words as the vocabulary's file
says.  Of a short word the boundaries of its parts and the ranks of adjacent pairs are held in two contiguous
lists: the least rank is looked for, the boundary in that pair goes, and the two neighbouring ranks are
refreshed, until no pair has a rank.  A word of more than ``SCANNED`` symbols, where repeated looking would
take the square of its length, keeps its pairs in a heap instead, with the same merges.  A worker remembers
the stretches between white space that it has met, up to ``REMEMBERED`` of them.

The vocabulary's file is read once, by the driver, from a path that the caller can give; it goes to the tasks as
one broadcast of fixed size.  Rows stay where they are: nothing is shuffled.

Defined results: a null or empty text has no ids and decodes to the empty text; texts are never cut, whatever
their length; repeated rows are encoded alike; an empty table stays empty.  Ids that the vocabulary lacks decode
to nothing.  Columns in ``carry`` named like the results are left out in their favour.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from panelforge.llm.tables import table

#: Symbols of a word whose ranks are scanned, and stretches that a worker remembers.
SCANNED = 64
REMEMBERED = 200_000
#: Bytes of text whose results are handed back at once.
BATCH_BYTES = 4 << 20
#: Below this code point, all letters and cases are the same in every version of Unicode in use.
SETTLED = 0x530

#: Letters that stand for the bytes: printable ones for themselves, the others from U+0100 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BYTES = {ord(c): b for b, c in _BYTE_LETTERS.items()}
_SEPARATORS = regex.compile(r"[\x1C-\x1F]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBPE(dict):
    """A vocabulary and its merges by rank; as a dictionary, the ids of the stretches between white space met so far."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        told = json.loads(spec)
        vocab, end = told["model"]["vocab"], told["model"]["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        # The ids that a byte has within a word and at its end.
        self.inner, self.last = [[vocab[_BYTE_LETTERS[b] + e] for b in range(256)] for e in ("", end)]
        self.width, self.none = max(vocab.values()) + 1, len(merges)
        self.ranks = {vocab[a] * self.width + vocab[b]: r for r, (a, b) in reversed([*enumerate(merges)])}
        self.made = [vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        tokens = {i: t.encode() for t, i in (vocab | self.special).items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.has = np.array([i in tokens for i in range(len(self.tokens))] + [False])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # The file's own splitting: used for letters that versions of Unicode see differently.
        told["model"] |= {"vocab": {}, "merges": []}
        library = Tokenizer.from_str(json.dumps(told | {"added_tokens": []}))
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.pattern = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.unsettled = regex.compile(rf"[^\x00-\u{SETTLED - 1:04x}]")

    def stretches(self, text: str) -> list[str]:
        """A normalised piece of text between white space; no word goes over white space."""
        if not text.isascii():
            # A capital sigma is lower-cased without regard to its place in the word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # Four control characters are white space for split(), but not for the vocabulary.
        return text.split() if not _SEPARATORS.search(text) else self.pattern.findall(text)

    def merged(self, word: bytes) -> list[int]:
        """A word's ids.  Each entry of ``parts`` begins where the one before it ends: to delete one is to delete a boundary."""
        parts = [self.inner[c] for c in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > SCANNED:
            return self._queued(parts)
        of, made, width, none = self.ranks.get, self.made, self.width, self.none
        ranks = [of(a * width + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = of(new * width + parts[i + 1], none)
            if i:
                ranks[i - 1] = of(parts[i - 1] * width + new, none)
        return parts

    def _queued(self, parts: list[int]) -> list[int]:
        of, n = self.ranks.get, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank = lambda i: of(parts[i] * self.width + parts[after[i]]) if after[i] < n else None
        queue = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapify(queue)
        while queue:
            r, i = heappop(queue)
            if parts[i] < 0 or rank(i) != r:
                continue  # one of the two has been merged since
            j = after[i]
            parts[i], parts[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (near := rank(a)) is not None:
                    heappush(queue, (near, a))
        return [p for p in parts if p >= 0]

    def __missing__(self, stretch: str) -> bytes:
        """A stretch's ids, four bytes each, least first."""
        ids = [i for w in self.pattern.findall(stretch) for i in self.merged(w.encode())]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(stretch) <= SCANNED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """A text's ids, four bytes each, least first; special strings in it are their own ids."""
        out: list[bytes] = []
        for piece in self.cut.split(text or "") if self.cut else (text or "",):
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            elif self.unsettled.search(piece):
                words = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))]
                ids = [i for w in words for i in self.merged(w.translate(_BYTES).encode("latin-1"))]
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out += map(self.__getitem__, self.stretches(piece))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        """The tokens of ids, a space between any two, in UTF-8."""
        numbers = np.frombuffer(ids or b"", "<u4")
        known = numbers[self.has[np.minimum(numbers, len(self.has) - 1)]]
        return b" ".join(map(self.tokens.__getitem__, known.tolist()))


#: The vocabulary that this worker holds, under its broadcast's number.
_HELD: dict[int, WordBPE] = {}


def _held(broadcast) -> WordBPE:
    key, spec = broadcast.value
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = WordBPE(spec)
    return _HELD[key]


def _broadcast(spark: SparkSession, vocabulary: str | None):
    with open(vocabulary or default_vocabulary(), "rb") as f:
        spec = f.read()
    return spark.sparkContext.broadcast((hash(spec), spec))


def _runs(column: pa.Array) -> Iterator[tuple[int, list]]:
    """Rows in runs of about ``BATCH_BYTES``, or of one larger row: the first row's number, and the values."""
    begin, size, run = 0, 0, []
    for i in range(len(column)):
        value = column[i].as_py()
        run.append(value)
        size += len(value or ())
        if size >= BATCH_BYTES:
            yield begin, run
            begin, size, run = i + 1, 0, []
    if run:
        yield begin, run


def _mapped(df: DataFrame, column: str, carry: Sequence[str], results: list[StructField], make) -> DataFrame:
    """``carry``, and for each value of ``column`` what ``make`` gives for a list of them."""
    taken = {f.name.lower() for f in results}
    carry = [c for c in dict.fromkeys(carry) if c.lower() not in taken]
    rows = df.select(*dict.fromkeys([*carry, column]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, values in _runs(batch.column(column)):
                held = batch.slice(begin, len(values))
                yield pa.RecordBatch.from_arrays([*(held.column(c) for c in carry), *make(values)], names=[*carry, *(f.name for f in results)])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in carry), *results]))


def encode(df: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """``carry``, n_tokens, and ids: binary, four bytes a token, least first.  ``unpacked`` gives them as numbers."""
    shared = _broadcast(df.sparkSession, vocabulary)

    def make(texts: list) -> list[pa.Array]:
        ids = list(map(_held(shared).encode, texts))
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

    return _mapped(df, text, carry, [StructField("n_tokens", LongType()), StructField("ids", BinaryType())], make)


def decode(df: DataFrame, ids: str = "ids", carry: Sequence[str] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """``carry`` and decoded: the text of the ids, special tokens included."""
    shared = _broadcast(df.sparkSession, vocabulary)

    def make(rows: list) -> list[pa.Array]:
        return [pa.array([x.decode() for x in map(_held(shared).decode, rows)], pa.string())]

    return _mapped(df, ids, carry, [StructField("decoded", StringType())], make)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and their text again, as digests."""
    encoded = encode(table(spark, sf_dir, "documents"))
    both = decode(encoded, carry=("doc_id", "n_tokens", "ids"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {"op11_bpe": op11_bpe}
ORACLES: dict[str, str] = {}
