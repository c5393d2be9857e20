"""Byte-level BPE encoding and decoding (operator 2).

A rank file (base64 token, rank) becomes a BPE model of the ``tokenizers``
library: bytes are written as printable characters by the byte table, and
every split of a token into two tokens is a merge, in rank order. Texts come
to Python as Arrow batches. No match of the split pattern goes on from a non-space
to a space, or over the end of a run of letters, so a text is first cut into
words at such places; a new word is cut by the pattern and each match merged
by the library, and its ids are kept in a table of bounded size. Offsets are the running sums
of the token lengths in bytes; characters are counted by the bytes that start
one, so a character split over tokens belongs to the first of them. Decoding
looks the tokens up, reverses the byte table and joins the bytes before any of
them is read as UTF-8.

The library's own splitter (``Split`` + ``ByteLevel``) gives the same ids at
0.8 MB a CPU second, too slow for the corpus; the table of words makes it
several MB.

Defined results: a NULL or empty text has no tokens; texts are processed
whole, batches hold a bounded number of bytes (or one text); repeated rows are encoded each; an empty table gives no rows; input columns named like
a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CACHE_WORDS = 400_000
BLOCK = 1 << 18
_GAP = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
"""White space as the split pattern's ``\\s`` has it."""


@lru_cache(maxsize=1)
def _cut():  # noqa: ANN202
    """Finds words: white space and then letters, or other characters (with
    letters after an apostrophe, which the split pattern may join to it)."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    letters = "".join(re.escape(m[0][0]) + "-" + re.escape(m[0][-1]) for m in regex.finditer(r"\p{L}+", every))
    return re.compile(f"[{_GAP}]*(?:[{letters}]+|[^{_GAP}{letters}]+(?:(?<=')[{letters}]+)?)|[{_GAP}]+").findall


def byte_table() -> list[str]:
    """The character that stands for each byte: printable bytes for
    themselves, the others from U+0100 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class _Known(dict):
    """Word -> its ids (little-endian 32-bit); emptied when full."""

    def __init__(self, merge) -> None:  # noqa: ANN001
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        ids = self.merge(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers.models import BPE

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.chars = dict(enumerate(byte_table()))
        show = lambda t: t.decode("latin-1").translate(self.chars)
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        merges = [(show(t[:i]), show(t[i:])) for t, _ in by_rank for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = BPE({show(t): r for t, r in ranks.items()}, merges, ignore_merges=True)
        self.words, self.pieces = _cut(), regex.compile(pattern).findall
        self.known = _Known(self._merge)
        # decoding goes through the characters: tokens laid end to end, the byte table reversed
        back = {c: b for b, c in self.chars.items()}
        flat = b"".join(bytes(back[c] for c in show(t)) for t, _ in by_rank)
        ends = np.cumsum([len(t) for t, _ in by_rank])
        at = np.array([r for _, r in by_rank])
        self.flat = np.frombuffer(flat, np.uint8)
        self.start, self.size = np.zeros(at.max() + 1, np.int64), np.zeros(at.max() + 1, np.int64)
        self.start[at], self.size[at] = np.append(0, ends[:-1]), np.diff(np.append(0, ends))

    def _merge(self, word: str) -> bytes:
        """Ids of a word with the white space before it: each match of the pattern is merged by itself."""
        ids = array("I", [t.id for p in self.pieces(word) for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.chars))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.words(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for lo in range(0, len(ids), BLOCK):
            i = np.asarray(ids[lo: lo + BLOCK], np.int64)
            size = self.size[i]
            ends = np.cumsum(size)
            if len(i):
                out.append(self.flat[np.repeat(self.start[i] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in code points of the decoded text; a
        token of only the later bytes of a character is empty."""
        raw = np.frombuffer(self.decode(ids), np.uint8)
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        ends = np.cumsum(self.size[np.asarray(ids, np.int64)])
        return chars[np.append(0, ends)[:-1]], chars[ends]


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One per Python worker and rank file."""
    return ByteBpe(path, pattern)


def _batches(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches whose memory is bounded by bytes, not by a row count."""
    for b in batches:
        step = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def _map(df: DataFrame, drop: str | None, fields: list[T.StructField], make) -> DataFrame:  # noqa: ANN001
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new and c != drop]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            cols = make(b)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], [*kept, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def encode_texts(df: DataFrame, text: str, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """The rows with ``ids`` array<int> (and ``offsets`` array<struct<start,
    end>>) in place of the text."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    if offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        bpe = tokenizer(path, pattern)
        ids = [bpe.encode(t or "") for t in b.column(text).to_pylist()]
        out = [_lists(ids)]
        if offsets:
            at = [bpe.offsets(i) for i in ids]
            start, end = _lists([a for a, _ in at]), _lists([b for _, b in at])
            pairs = pa.StructArray.from_arrays([start.values, end.values], ["start", "end"])
            out.append(pa.ListArray.from_arrays(start.offsets, pairs))
        return out

    return _map(df, text, fields, make)


def decode_ids(df: DataFrame, ids: str, path: str, pattern: str) -> DataFrame:
    """The rows with ``bytes`` (and ``text``, undecodable bytes replaced) in
    place of the ids."""
    fields = [T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType())]

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        bpe = tokenizer(path, pattern)
        col = b.column(ids)
        raw = [bpe.decode(np.asarray(i.values) if i.is_valid else np.empty(0, np.int64)) for i in col]
        return [pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]

    return _map(df, ids, fields, make)


def digests(df: DataFrame, text: str, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encode and decode in one pass over the rows: ``n_tokens``,
    ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (the decoded bytes), and ``ids`` if asked, in place of
    the text."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        bpe = tokenizer(path, pattern)
        n, of_ids, of_bytes, every = [], [], [], []
        for t in b.column(text).to_pylist():
            got = bpe.encode(t or "")
            n.append(len(got))
            of_ids.append(hashlib.sha256(got.tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(bpe.decode(got)).hexdigest())
            if ids:
                every.append(got)
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), *([_lists(every)] if ids else [])]

    return _map(df, text, fields, make)
