"""N-gram Jaccard join with a prefix tree (operator 10).

Documents are sets of ``n``-word shingles (A-Z lower-cased); two link when their
Jaccard similarity is at least ``percent`` % (4 words and 85 %, the query's
contract, unless the caller says otherwise). The join is exact:

1. *Global order.* Words' document frequencies are counted in a table of 2^20
   slots (a fixed size, whatever the corpus); a shingle is as rare as its
   rarest word. Shingles are ordered by (rarity, hash). Any global order gives
   right results, this one puts shingles first that few documents share, and
   lines or passages that many share last.
2. *Prefixes.* Two sets of similarity t share ``SHARED`` shingles and
   ``SHARED_PERCENT`` % of the smaller one's size (or all they share, if fewer)
   among the first n - ceil(t n) + that many of each, so only these are
   shuffled, as (shingle, set); equal sets are one set (its id a hash of its
   shingles). Shingles of several sets are found again in the prefixes through
   a bit table of fixed size; sets with too few of them have no partner and
   leave, ``ROUNDS`` times. The pairs of a shingle with at most ``FEW`` sets are
   counted: a similar pair has enough of them, or shares a shingle with more sets.
3. *Groups.* A counted pair, and all sets of a shingle of more sets, meet in the
   group of their least id: near copies of one text meet in one group or two,
   not in one per shared shingle. A group
   beyond ``CELL_SHINGLES`` is cut into blocks, and every pair of blocks is a
   cell, so no cell exceeds a task's memory and no pair is lost.
4. *Prefix tree.* In a cell, sets ordered by the cell's own frequencies (most
   frequent first) form a trie with shared runs as edges. Each set walks it:
   a run's overlap is counted once for all sets below, and a subtree is left
   when the shingles that remain on either side can't reach the threshold.
   Sets already connected aren't compared again, so a group of g copies gives
   g - 1 links, not all pairs.
5. *Components* of the links (``components.py``) are joined back to documents.

Defined results: a text without words (or NULL) has no shingles and its own
component; with fewer than ``n`` words the whole sequence is one shingle;
repeated rows are equal sets; rows with a NULL id get a NULL component and take
no part in others; an empty table gives no rows. Shingles are compared by
64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import materialize
from shoptally.llm.components import components
from shoptally.llm.shingles import FOLD_LOWER, combine, grams, mix, text_batches, words_of

N = 4
PERCENT = 85
SHARED = 4
SHARED_PERCENT = 5
FEW = 4
ROUNDS = 2
SLOT_BITS = 20
ID_BITS = 23
SHINGLE_BITS = 26
CELL_SHINGLES = 1 << 18
_U = np.uint64


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> _U(64 - SLOT_BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    for b in batches:
        for lo, hi, raw, offs in text_batches(b.column("text")):
            w, _, first = words_of(raw, offs, FOLD_LOWER)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            once = np.unique(_slots(w) * (hi - lo) + row)
            seen += np.bincount(once // (hi - lo), minlength=len(seen))
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["slot", "n"])


def rarity_table(docs: DataFrame) -> np.ndarray:
    """Per slot 8 log2 of its words' document frequency: 2^20 bytes."""
    counts = docs.select("text").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most 2^20 rows
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    table[got["slot"].to_numpy()] = np.minimum(255, 8 * np.log2(got["n"].to_numpy().astype(float) + 1))
    return table


def _set_id(s: np.ndarray) -> np.ndarray:
    return mix(np.array([np.sum(mix(s ^ _U(len(s))), dtype=np.uint64) + _U(len(s))], np.uint64))


def head_size(n: int, percent: int) -> int:
    """Shingles of a set of n that are shuffled: so many that two similar sets
    share ``SHARED`` + ``SHARED_PERCENT`` % of the smaller one's size among them,
    or all that they share."""
    return n + percent * n // -100 + SHARED + SHARED_PERCENT * n // 100


def _prefixes(table, percent: int, words: int) -> Callable:  # noqa: ANN001
    """doc_id, set, n and the set's first shingles in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = table.value
        for b in batches:
            for lo, hi, raw, offs in text_batches(b.column("text")):
                w, _, first = words_of(raw, offs, FOLD_LOWER)
                g, f = grams(w, words), rare[_slots(w)]
                m = len(g)
                r = f[:m]
                for i in range(1, words):
                    r = np.minimum(r, f[i:m + i])
                sets, sizes, heads = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.int32), []
                for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if y - x >= words:
                        s, at = np.unique(g[x: y - words + 1], return_index=True)
                        p = head_size(len(s), percent)
                        # stable: within a rarity by hash
                        heads.append(s[np.argsort(r[x + at], kind="stable")[:p]])
                    else:
                        s = combine(w[x:y]) if y > x else g[:0]
                        heads.append(s)
                    sizes[k] = len(s)
                    sets[k] = _set_id(s)[0] if len(s) else 0
                ends = np.append(0, np.cumsum([len(h) for h in heads]))
                flat = np.concatenate(heads).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(sets.view(np.int64)), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "set", "n", "head"])

    return run


def _whole_sets(bloom, words: int) -> Callable:  # noqa: ANN001
    """doc_id and all shingle hashes of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for b in batches:
            b = b.filter(pa.array(_in_table(bits, b.column("h").to_numpy())))
            for lo, hi, raw, offs in text_batches(b.column("text")):
                w, _, first = words_of(raw, offs, FOLD_LOWER)
                g = grams(w, words)
                rows = [np.unique(g[x: y - words + 1]).tobytes() if y - x >= words else combine(w[x:y]).tobytes() if y > x else b""
                        for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(rows, pa.binary())], ["x", "shingles"])

    return run


def _find(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


class PrefixTree:
    """Trie of sets given as sorted rank arrays, with runs of ranks that all
    sets below share as edges."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        # (first set, end, from depth, to depth, least size, greatest size, children)
        self.root = self._node(0, len(sets), 0)

    def _node(self, lo: int, hi: int, depth: int) -> tuple:
        stack, done = [(lo, hi, depth, False)], []
        while stack:
            lo, hi, depth, back = stack.pop()
            a, z = self.sets[lo], self.sets[hi - 1]
            m = min(len(a), len(z))
            # sets are in lexicographic order: what first and last share, all share
            differ = np.flatnonzero(a[depth:m] != z[depth:m])
            end = len(a) if hi - lo == 1 else depth + int(differ[0]) if len(differ) else m
            if hi - lo == 1:
                done.append((lo, hi, depth, end, len(a), len(a), ()))
                continue
            cuts = [lo]
            for k in range(lo + 1, hi):
                x, y = self.sets[k - 1], self.sets[k]
                if len(x) == end or x[end] != y[end]:
                    cuts.append(k)
            if not back:
                stack.append((lo, hi, depth, True))
                stack += [(p, q, end, False) for p, q in zip(cuts, [*cuts[1:], hi], strict=True)]
            else:
                kids = tuple(done[-len(cuts):])[::-1]
                del done[-len(cuts):]
                done.append((lo, hi, depth, end, min(k[4] for k in kids), max(k[5] for k in kids), kids))
        return done[0]

    def link(self, width: int, percent: int) -> list[int]:
        """Union-find parents after every set has walked the tree."""
        up = list(range(len(self.sets)))
        inside = np.zeros(width, bool)
        for x, mine in enumerate(self.sets):
            n = len(mine)
            inside[mine] = True
            stack = [(self.root, 0)]
            while stack:
                (lo, hi, a, z, least, most, kids), overlap = stack.pop()
                if hi <= x + 1 or (hi - lo == 1 and _find(up, lo) == _find(up, x)):
                    continue
                run = self.sets[lo][a:z]
                overlap += int(np.count_nonzero(inside[run]))
                rest = n if z == 0 else n - int(np.searchsorted(mine, self.sets[lo][z - 1], side="right"))
                # the size below that leaves most room: its rest as long as mine
                size = min(max(rest + z, least), most)
                if (100 + percent) * (overlap + min(rest, size - z)) < percent * (n + size):
                    continue
                if kids:
                    stack += [(k, overlap) for k in kids]
                elif 100 * overlap >= percent * (n + len(self.sets[lo]) - overlap):
                    up[_find(up, lo)] = _find(up, x)
            inside[mine] = False
        return [_find(up, x) for x in range(len(up))]


def link_cell(ids: list[int], shingles: list[bytes], percent: int) -> tuple[list[int], list[int]]:
    """Links (id, representative) that connect what is similar in a cell."""
    once = list(dict.fromkeys(zip(ids, shingles, strict=True)))
    if len(once) < 2:
        return [], []
    ids, sets = [x for x, _ in once], [np.frombuffer(s, np.uint64) for _, s in once]
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))  # the cell's order: most frequent first
    ranked = [np.sort(r) for r in np.split(rank[at], np.cumsum([len(s) for s in sets])[:-1])]
    order = sorted(range(len(ids)), key=lambda k: ranked[k].astype(">i8").tobytes())
    root = PrefixTree([ranked[k] for k in order]).link(len(n), percent)
    pairs = [(ids[order[k]], ids[order[r]]) for k, r in enumerate(root) if k != r]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def _cells(percent: int) -> Callable:
    """Rows come sorted by cell; a cell is linked when its last row is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, a, b = None, [], [], [], []
        for batch in batches:
            cells = zip(*[batch.column(c).to_pylist() for c in ("c", "i", "j")], strict=True)
            for cell, x, s in zip(cells, batch.column("x").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if cell != key:
                    got = link_cell(ids, sets, percent)
                    a += got[0]
                    b += got[1]
                    key, ids, sets = cell, [], []
                ids.append(x)
                sets.append(s)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        got = link_cell(ids, sets, percent)
        yield pa.RecordBatch.from_arrays([pa.array(a + got[0], pa.int64()), pa.array(b + got[1], pa.int64())], ["a", "b"])

    return run


def _bit_table(values: DataFrame, bits: int) -> np.ndarray:
    """One bit per value (a bigint column ``h``) in a table of 2^bits: at most
    2^(bits - 6) rows of 64 reach the driver."""
    at = F.pmod("h", F.lit(1 << bits))
    words = values.select(F.shiftright(at, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(h, 64L) as int))").alias("bit"))
    got = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy()
    return table


def _in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    word = table.view(np.uint64)[((h & _U(len(table) * 64 - 1)) >> _U(6)).astype(np.int64)]
    return (word >> (h & _U(63))) & _U(1) == 1


def _posts_in(table) -> Callable:  # noqa: ANN001
    """(set, n, shingle) of the prefixes' shingles that are in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head = b.column("head")
            flat, row = np.asarray(head.flatten()), np.repeat(np.arange(b.num_rows), np.diff(np.asarray(head.offsets)))
            on = _in_table(table.value, flat)
            row = pa.array(row[on])
            yield pa.RecordBatch.from_arrays([b.column("set").take(row), b.column("n").take(row), pa.array(flat[on])], ["set", "n", "shingle"])

    return run


def _needed(n: Column) -> Column:
    return SHARED + F.floor(SHARED_PERCENT * n / 100)


def _thinned(posts: DataFrame, percent: int) -> DataFrame:
    """(shingle, set, n, rows) without the sets that have too few shared
    shingles for any partner (of at least ``percent`` of their size), and
    without the shingles that then have one set."""
    enough = F.least(_needed(F.floor(percent * F.col("n") / 100)), F.ceil(percent * F.col("n") / 100))
    sets = posts.groupBy("set").agg(F.count(F.lit(1)).alias("got"), F.min("n").alias("n")).where(F.col("got") >= enough)
    posts = posts.select("shingle", "set", "n").withColumn("k", F.hash("set")).join(sets.select("set", F.hash("set").alias("k")), ["set", "k"], "left_semi")
    rows = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return posts.select("shingle", "set", "n", F.hash("shingle").alias("k")).join(
        rows.select("shingle", F.hash("shingle").alias("k"), "rows"), ["shingle", "k"]).drop("k")


def jaccard_components(df: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, cell_shingles: int = CELL_SHINGLES,
                       n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = spark.sparkContext.broadcast(rarity_table(docs))
    sets = materialize(docs.mapInArrow(_prefixes(table, percent, n), "doc_id long, set long, n int, head array<long>"), "ngram-sets")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("set").agg(
        F.min("doc_id").alias("x"), F.min("n").alias("n"), F.first("head").alias("head"))
    classes = materialize(classes, "ngram-classes")
    posts = classes.select("set", F.explode("head").alias("shingle"))
    shared = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = materialize(shared, "ngram-shared")
    table = spark.sparkContext.broadcast(_bit_table(shared.select(F.col("shingle").alias("h")), SHINGLE_BITS))
    posts = classes.select("set", "n", "head").mapInArrow(_posts_in(table), "set long, n int, shingle long")
    # shared is read from its files, so both sides are exchanged and a hot shingle can be split
    posts = materialize(posts.join(shared.select("shingle", "rows"), "shingle"), "ngram-posts")
    for _ in range(ROUNDS):
        posts = materialize(_thinned(posts, percent), "ngram-posts")
    few = posts.where(F.col("rows") <= FEW).groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("set", "n"))).alias("few"))
    few = few.select(F.posexplode("few").alias("i", "a"), "few").select("a", F.explode(F.slice("few", F.col("i") + 2, FEW)).alias("b"))
    many = posts.where(F.col("rows") > FEW)
    centers = many.groupBy("shingle").agg(F.min("set").alias("c")).select("shingle", F.hash("shingle").alias("k"), "c")
    many = many.withColumn("k", F.hash("shingle")).join(centers, ["shingle", "k"])
    # overlap o of a similar pair: 100 o >= percent (n + n - o)
    least = F.ceil(percent * (F.col("a.n") + F.col("b.n")) / (100 + percent))
    smaller = F.least("a.n", "b.n")
    pairs = few.groupBy("a", "b").agg(F.count(F.lit(1)).alias("got")).where(
        (F.col("got") >= F.least(_needed(smaller), least)) & (smaller >= least))
    routes = pairs.select(F.col("a.set").alias("c"), F.explode(F.array("a", "b")).alias("e")).select("c", "e.set", "e.n").unionByName(
        many.select("c", "set", "n")).distinct()
    routes = materialize(routes, "ngram-routes")
    size = routes.groupBy("c").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("sets"))
    blocks = size.select("c", F.hash("c").alias("k"), F.least(F.ceil(F.col("all") / cell_shingles), F.col("sets")).cast("int").alias("blocks"))
    routes = routes.withColumn("k", F.hash("c")).join(blocks, ["c", "k"]).join(classes.select("set", "n", "x"), ["set", "n"])
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    cells = routes.select("c", "x", mine.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    cells = materialize(cells.select("c", "x", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")), "ngram-cells")
    bloom = spark.sparkContext.broadcast(_bit_table(cells.select(F.xxhash64("x").alias("h")), ID_BITS))
    # by id: only documents that stand for a set in some cell are read into shingles again
    whole = docs.where("doc_id is not null").select(
        "doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(_whole_sets(bloom, n), "x long, shingles binary")
    cells = cells.join(whole, "x").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    links = cells.select("c", "i", "j", "x", "shingles").mapInArrow(_cells(percent), "a long, b long")
    roots = components(links)
    named = (classes.join(roots, F.col("x") == F.col("node"), "left")
             .select("set", "n", F.least("x", F.coalesce("component", "x")).alias("component_id")))
    rows = sets.select("doc_id", "set", "n")
    linked = rows.where("n > 0").join(named, ["set", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
