"""Benchmark decontamination (operator 4).

Every item of the benchmark is a multiset of five-word shingles (A-Z
lower-cased, ASCII punctuation as space; an item of fewer words is one
shingle), a shingle weighing the bytes of its words. Documents are compared in
windows of as many words as the item has:

1. *SimHash.* A window's 64-bit fingerprint has the sign of the weighted sum
   of its shingles' hash bits; sums of all windows come from running sums.
2. *Multi-index Hamming.* A fingerprint is 8 blocks of 8 bits. Two that differ
   in at most 23 bits differ in at most 2 bits in some block, so looking up
   every block's neighbours within 2 bits returns all items within radius 23.
   Windows of similarity 0.8 differ in 10 bits on average, 2.9 standard
   deviation, so the radius is 4.6 deviations away.
3. *Verification.* Weighted Jaccard of the shingle multisets, in integers,
   at least 80 %.

A window that shares no shingle with an item can't verify, so only windows
around a shared shingle are fingerprinted; that loses none. Documents stay
where they are: no shuffle, work per task bounded by slices of text. The
benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, each block one
pass over the documents with an index of bounded size.

Defined results: NULL or blank texts and items match nothing; equal items match
each; a document shorter than an item is one window; of a document's windows
for one item the most similar is reported, the first of equals; rows with equal
ids are reported each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptally.llm.shingles import FOLD_WORDS, combine, grams, mix, text_batches, words_of

N = 5
PERCENT = 80
RADIUS = 23
BLOCKS = 8
BLOCK_BYTES = 4 << 20
MATCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()),
                      T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def _sizes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of each word."""
    return np.add.reduceat((FOLD_WORDS[raw] != 32).astype(np.int64), at) if len(at) else at


def _signs(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of +-weight, one per shingle and bit."""
    bits = np.unpackbits(mix(shingles).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return (bits.astype(np.int64) * 2 - 1) * weights[:, None]


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """8 bytes per row of bit sums."""
    return np.packbits(sums > 0, axis=1)


def shingled(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and their weights, in order."""
    if len(words) < N:
        return (combine(words), sizes.sum(keepdims=True)) if len(words) else (words, sizes)
    run = np.append(0, np.cumsum(sizes))
    return grams(words, N), run[N:] - run[:-N]


class ItemIndex:
    """Shingles, fingerprints and block neighbours of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.bags, self.lengths, prints, keys, owners = [], [], [], [], [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w, at, _ = words_of(raw, np.array([0, len(raw)]), FOLD_WORDS)
            if not len(w):
                continue
            s, weight = shingled(w, _sizes(raw, at))
            u, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
            each = np.zeros(len(u), np.int64)
            each[inverse] = weight
            self.bags.append((u, count, each, int(weight.sum())))
            keys.append(u)
            owners.append(np.full(len(u), len(self.ids)))
            self.ids.append(item_id)
            self.lengths.append(len(w))
            prints.append(_fingerprints(_signs(s, weight).sum(axis=0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint8).reshape(-1, 8)
        every, owner = (np.concatenate(keys), np.concatenate(owners)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
        order = np.argsort(every, kind="stable")
        self.keys, self.owners = every[order], owner[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.short = sorted({n for n in self.lengths if n < N})
        # per block and value: the items whose block is within RADIUS // BLOCKS bits
        near = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
        self.near = [near[:, self.prints[:, b]] if len(self.ids) else near[:, :0] for b in range(BLOCKS)]

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of every shingle that an item has."""
        at = np.flatnonzero(self.maybe[(shingles >> np.uint64(44)).astype(np.int64)])
        lo = np.searchsorted(self.keys, shingles[at], side="left")
        n = np.searchsorted(self.keys, shingles[at], side="right") - lo
        place = np.repeat(at, n)
        return place, self.owners[np.repeat(lo - np.append(0, np.cumsum(n))[:-1], n) + np.arange(len(place))]

    def verify(self, shingles: np.ndarray, weights: np.ndarray, item: int) -> tuple[int, int]:
        """Weighted Jaccard as (shared, all)."""
        u, count, each, total = self.bags[item]
        at = np.minimum(np.searchsorted(u, shingles), len(u) - 1)
        got = np.bincount(at[u[at] == shingles], minlength=len(u))
        shared = int((np.minimum(got, count) * each).sum())
        return shared, int(weights.sum()) + total - shared


def _search(index: ItemIndex, w: np.ndarray, size: np.ndarray, first: np.ndarray, percent: int) -> dict[tuple[int, int], tuple]:
    """Best window per (text, item) of a slice: (shared, all, first word, end word)."""
    best: dict[tuple[int, int], tuple] = {}
    run = np.append(0, np.cumsum(size))
    for n in [*index.short, N]:
        g = grams(w, n)
        if n < N:  # items of fewer words are one shingle
            g = np.array([combine(w[k: k + n])[0] for k in range(len(g))], np.uint64)
        place, item = index.hits(g)
        if not len(place):
            continue
        text = np.searchsorted(first, place, side="right") - 1
        length = np.array(index.lengths)[item]
        ok = (place + n <= first[text + 1]) & ((length < N) == (n < N)) & ((length == n) | (n == N))
        weight = run[n:] - run[:-n]
        place, item, text = place[ok], item[ok], text[ok]
        order = np.lexsort((place, item, text))
        place, item, text = place[order], item[order], text[order]
        cuts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))) if len(place) else order
        for mine in np.split(np.arange(len(place)), cuts[1:]) if len(place) else ():
            t, i, mine = int(text[mine[0]]), int(item[mine[0]]), place[mine]
            a, z, size_i = int(first[t]), int(first[t + 1]), min(index.lengths[i], int(first[t + 1] - first[t]))
            # starts of all windows that hold a hit
            starts = np.unique((mine[:, None] - np.arange(size_i - n + 1)[None, :]).ravel())
            starts = starts[(starts >= a) & (starts + size_i <= z)]
            if not len(starts):
                continue
            lo, hi = int(starts[0]), int(starts[-1]) + size_i - n + 1
            sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_signs(g[lo:hi], weight[lo:hi]), axis=0)])
            prints = _fingerprints(sums[starts - lo + size_i - n + 1] - sums[starts - lo])
            found = np.zeros(len(starts), bool)
            for b in range(BLOCKS):
                found |= index.near[b][prints[:, b], i]
            found &= _ONES[prints ^ index.prints[i]].sum(axis=1) <= RADIUS
            for s in starts[found].tolist():
                e = s + size_i - n + 1
                shared, whole = index.verify(g[s:e], weight[s:e], i)
                if 100 * shared >= percent * whole and ((t, i) not in best or shared * best[t, i][1] > best[t, i][0] * whole):
                    best[t, i] = (shared, whole, s, s + size_i)
    return best


def _matches(index, percent: int, batch: pa.RecordBatch) -> Iterator[tuple]:  # noqa: ANN001
    """(row, item, shared, all, start, end) of a batch's documents, in code points."""
    for lo, hi, raw, offs in text_batches(batch.column("_text")):
        w, at, first = words_of(raw, offs, FOLD_WORDS)
        if not len(w):
            continue
        size = _sizes(raw, at)
        found = _search(index, w, size, first, percent)
        if found:
            chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
            for (t, i), (shared, whole, s, e) in sorted(found.items()):
                end = int(at[e - 1])
                last = np.flatnonzero(FOLD_WORDS[raw[end:offs[t + 1]]] == 32)
                end += int(last[0]) if len(last) else int(offs[t + 1]) - end
                base = chars[offs[t]]
                yield lo + t, i, shared, whole, int(chars[at[s]] - base), int(chars[end] - base)


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """Indexes of the benchmark, block by block."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else rows
        yield ItemIndex(sorted(map(tuple, block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str = "item_id", item_text: str = "text",
               percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity,
    and the window's start and end (code points, end exclusive)."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = None
    for index in item_blocks(items, item_id, item_text, block_bytes):
        part = rows.mapInArrow(_finder(sc.broadcast(index), percent), MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def _finder(index, percent: int) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = index.value.ids
        for b in batches:
            doc = b.column("doc_id").to_pylist()
            got = [(doc[r], ids[i], shared / whole, s, e) for r, i, shared, whole, s, e in _matches(index.value, percent, b)]
            cols = list(zip(*got, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
                                             MATCH.fieldNames())

    return run


def drop_leaks(docs: DataFrame, text: str, items: DataFrame, item_id: str = "item_id", item_text: str = "text",
               percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item is found, as they are: one pass per
    block of items, no join."""
    sc, out, names = docs.sparkSession.sparkContext, docs, docs.columns
    spare = "_text"
    while spare in names:
        spare += "_"
    for index in item_blocks(items, item_id, item_text, block_bytes):
        held = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                texts = pa.RecordBatch.from_arrays([b.column(spare)], ["_text"])
                bad = {m[0] for m in _matches(held.value, percent, texts)}
                yield b.select(names).filter(pa.array([r not in bad for r in range(b.num_rows)], pa.bool_()))

        out = out.withColumn(spare, F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, docs.schema)
    return out
