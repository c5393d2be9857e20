"""Fill-in-middle transformation by piece tables (operator 12).

A document is one descriptor (buffer, start, length) over its immutable text.
Cutting splits that descriptor into prefix, middle and suffix; an arrangement
permutes the three and puts descriptors over the sentinel buffer before each;
restoring reads the pieces of an output back and applies the inverse
permutation. No step copies text: an output is written once, from its
descriptors, and digests are streamed descriptor by descriptor.

Cuts and form of a document are drawn from the SHA-256 of the seed and its id,
so they depend on nothing else: not on the order, partitioning or number of
rows. Work is local to a row; nothing is shuffled.

Defined results: a NULL text is the empty text; an empty text, and one that
holds a sentinel, is ``plain`` (its output is the text); a NULL id hashes as
no digits; repeated rows get equal results each; an empty table gives no rows;
texts of any length are cut by counting code points block by block
(``BLOCK`` bytes), beside the text and its output nothing grows with them.
Other columns travel along in the JVM; an input column named like a result is
replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptally.llm.common import pack, unpack

# Fixed values of the transformation: sentinels and the order of parts in each form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
ORDER = (PREFIX, MIDDLE, SUFFIX)
"""The parts in the order of the text."""

SEED = 1
PLAIN_FROM = 90
SPM_BELOW = 20
BLOCK = 1 << 18

SENTINELS = "".join(ORDER).encode()
TEXT, MARKS = 0, 1
_AT = {s: SENTINELS.index(s.encode()) for s in ORDER}


class Piece(NamedTuple):
    """``length`` bytes of a buffer (``TEXT`` or ``MARKS``) from ``start``."""

    buffer: int
    start: int
    length: int


def byte_positions(text: memoryview, points: list[int]) -> list[int]:
    """The bytes at which the code points of the given (ascending) numbers start."""
    out, seen, lo = [], 0, 0
    todo = list(points)
    while todo and lo < len(text):
        first = np.flatnonzero((np.frombuffer(text[lo: lo + BLOCK], np.uint8) & 0xC0) != 0x80)
        while todo and todo[0] < seen + len(first):
            out.append(lo + int(first[todo.pop(0) - seen]))
        seen += len(first)
        lo += BLOCK
    return out + [len(text)] * len(todo)


def cut(whole: Piece, at: list[int]) -> list[Piece]:
    """Splits one descriptor at ascending places within it."""
    edges = [0, *at, whole.length]
    return [Piece(whole.buffer, whole.start + a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def arrange(parts: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of the form, each behind its sentinel."""
    by = dict(zip(ORDER, parts, strict=True))
    return [p for s in FORMS[form] for p in (Piece(MARKS, _AT[s], len(s)), by[s])]


def parts_of(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output, inverse to ``arrange``: its parts in the
    order of the text. The text holds no sentinel and none can arise where a
    part meets one (no end of a sentinel begins one), so the first found is
    the right one."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    starts, at = [], 0
    for s in FORMS[form]:
        at = output.index(s.encode(), at) + len(s)
        starts.append(at)
    ends = [a - len(s) for a, s in zip(starts[1:], FORMS[form][1:], strict=True)] + [len(output)]
    by = {s: Piece(TEXT, a, b - a) for s, a, b in zip(FORMS[form], starts, ends, strict=True)}
    return [by[s] for s in ORDER]


def read_pieces(pieces: list[Piece], text: memoryview) -> Iterator[memoryview]:
    buffers = (text, memoryview(SENTINELS))
    for p in pieces:
        yield buffers[p.buffer][p.start: p.start + p.length]


def digest(pieces: list[Piece], text: memoryview) -> str:
    h = hashlib.sha256()
    for part in read_pieces(pieces, text):
        h.update(part)
    return h.hexdigest()


def draws(key: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of seed and id."""
    raw = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(raw[i: i + 4], "big") for i in (0, 4, 8, 12)]


def _bytes_of(texts: pa.Array) -> Iterator[memoryview]:
    """Views of the texts of a column without NULLs, nothing copied."""
    texts = texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1].tolist() if len(texts) else []
    data = memoryview(texts.buffers()[2] or b"")
    for a, b in zip(offs, offs[1:], strict=False):
        yield data[a:b]


_TABLE = T.ArrayType(T.StructType([T.StructField("buffer", T.ByteType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
_PIECES = pa.list_(pa.struct([("buffer", pa.int8()), ("start", pa.int64()), ("length", pa.int64())]))


def _transform(seed: int, plain_from: int, spm_below: int, with_output: bool, with_digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "_text"):
                texts = pc.fill_null(batch.column("_text"), "")
                marked = pc.match_substring(texts, ORDER[0])
                for s in ORDER[1:]:
                    marked = pc.or_(marked, pc.match_substring(texts, s))
                counts = pc.utf8_length(texts).to_pylist()
                form, table, prefix, middle, out, out_sha, back_sha = [], [], [], [], [], [], []
                for text, key, n, has_mark in zip(_bytes_of(texts), batch.column("_key").to_pylist(), counts, marked.to_pylist(), strict=True):
                    h1, h2, h3, h4 = draws(key, seed)
                    one = Piece(TEXT, 0, len(text))
                    if not n or has_mark or h3 % 100 >= plain_from:
                        kind, pieces, lens = "plain", [one], (None, None)
                    else:
                        kind = "spm" if h4 % 100 < spm_below else "psm"
                        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                        pieces, lens = arrange(cut(one, byte_positions(text, [a, b])), kind), (a, b - a)
                    form.append(kind)
                    prefix.append(lens[0])
                    middle.append(lens[1])
                    if with_output:
                        table.append([p._asdict() for p in pieces])
                        out.append(b"".join(read_pieces(pieces, text)))
                    if with_digest:
                        out_sha.append(digest(pieces, text))
                        written = b"".join(read_pieces(pieces, text))
                        back_sha.append(digest(parts_of(written, kind), memoryview(written)))
                columns = {"_row": batch.column("_row"), "n": pa.array(counts, pa.int64()), "form": pa.array(form, pa.string()),
                           "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64())}
                if with_output:
                    columns |= {"output": pa.array(out, pa.binary()).cast(pa.string()), "pieces": pa.array(table, _PIECES)}
                if with_digest:
                    columns |= {"output_sha256": pa.array(out_sha, pa.string()), "restored_sha256": pa.array(back_sha, pa.string())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``most`` bytes of text (or one row),
    so that what is built beside a batch doesn't grow with it."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _apply(df: DataFrame, key: Column, text: Column, keep: list[str] | None, seed: int, plain_from: int, spm_below: int,
           results: dict[str, T.DataType], **what: bool) -> DataFrame:
    df = pack(df, keep, _key=key.cast("long"), _text=text)
    out = df.mapInArrow(_transform(seed, plain_from, spm_below, **what), _schema(df, results))
    return unpack(out, **{k: F.col(k) for k in results})


def _schema(df: DataFrame, results: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema["_row"], *(T.StructField(k, v) for k, v in results.items())])


_CUT = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}


def fill_in_middle(df: DataFrame, key: Column, text: Column, keep: list[str] | None = None, seed: int = SEED,
                   plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """The rows (all input columns, or those in ``keep``) with ``n`` (code
    points), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``
    (NULL if plain), ``output`` and its ``pieces`` (buffer 0 is the text, 1 the
    sentinels; places in bytes). ``plain_from`` percent of the documents are
    rearranged, of those ``spm_below`` percent suffix first."""
    return _apply(df, key, text, keep, seed, plain_from, spm_below, _CUT | {"output": T.StringType(), "pieces": _TABLE},
                  with_output=True, with_digest=False)


def fill_in_middle_digests(df: DataFrame, key: Column, text: Column, keep: list[str] | None = None, seed: int = SEED,
                           plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """As ``fill_in_middle``, with ``output_sha256`` and ``restored_sha256``
    (of the text rebuilt from output and form alone) in place of the output."""
    return _apply(df, key, text, keep, seed, plain_from, spm_below, _CUT | {"output_sha256": T.StringType(), "restored_sha256": T.StringType()},
                  with_output=False, with_digest=True)


def restore(df: DataFrame, output: Column, form: Column, keep: list[str] | None = None) -> DataFrame:
    """The rows with ``restored``, the text that an output of the given form
    was made of. A NULL output or form gives a NULL text."""
    df = pack(df, keep, _text=output, _form=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "_text"):
                texts = batch.column("_text")
                out = []
                for text, there, kind in zip(_bytes_of(pc.fill_null(texts, "")), texts.is_valid().to_pylist(), batch.column("_form").to_pylist(), strict=True):
                    raw = bytes(text)
                    out.append(b"".join(read_pieces(parts_of(raw, kind), memoryview(raw))) if there and kind is not None else None)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.binary()).cast(pa.string())], names=["_row", "restored"])

    out = df.mapInArrow(run, _schema(df, {"restored": T.StringType()}))
    return unpack(out, restored=F.col("restored"))
