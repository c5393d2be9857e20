"""Vector code compression: product codes with codebooks trained in rounds,
their nearest entries found by a GNAT (operator 11).

Every component becomes an integer, a vector is cut into ``parts`` equal
pieces, and each piece is coded by the nearest of its position's ``entries``
codebook entries (squared Euclidean distance, ties to the lower index). The
codebooks start as the pieces of the first vectors and are replaced
``rounds`` times by the floored mean of the pieces assigned to them.

The entries of a codebook lie in a GNAT (geometric near-neighbour access
tree): a node has split points, every other entry belongs to its nearest split
point, and the node keeps the least and greatest distance of each split point
to each child's entries. A query measures its distance to the split points;
what the triangle inequality then proves farther than the best entry so far,
a whole subtree at a time, is never measured. Distances are integers; roots
and ranges are rounded outwards, a subtree goes only if it is *strictly*
farther, and candidates are compared by (integer distance, index), so the
result is that of comparing with all entries.

Assignment is local to a task; a round shuffles one row per task, position and
entry (sums of pieces), and the driver holds the codebooks alone, whose size
``entries * dimension`` is set by parameters, not by the rows. The integer
vectors, and at the end the codes, are written to the shared checkpoint folder
once; every round reads them there, so a lost executor costs its tasks only.

Defined results: rows whose vector is NULL or holds NULL or non-finite
components are left out; the dimension is that of the kept row of smallest id
whose length is a positive multiple of ``parts``, and vectors of other lengths
stay with a NULL code and error (they take no part in labels' sums); with fewer
vectors than ``entries`` the codebooks are shorter; of repeated ids the
smaller integer vector comes first, NULL ids come last; repeated rows are coded
each; all NULL labels are one label; an empty table gives no rows. Components
beyond ``LIMIT`` (whose squared distances a long might not hold) are refused
with a message. Other columns travel along; an input column named like a
result is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptally.llm.common import materialize, pack, unpack

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
SPLITS = 6
LEAF = 6
LIMIT = 1 << 24
CHUNK = 1 << 19
"""Numbers that one step of a search holds at a time."""

_FAR = np.iinfo(np.int64).max


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, as integers."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):  # by component: no array of rows * entries * width
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return out


class Gnat:
    """A node over the entries with the given numbers (ascending, all different
    points). ``measured`` counts the distances that searches took."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, splits: int = SPLITS, leaf: int = LEAF) -> None:
        self.measured = 0
        here = np.arange(len(ids)) if len(ids) <= leaf else self._spread(points[ids], splits)
        rest = np.setdiff1d(np.arange(len(ids)), here)
        self.ids, self.points = ids[here], points[ids[here]]
        self.children: list[tuple[int, Gnat]] = []
        if not len(rest):
            return
        d2 = squared(points[ids[rest]], self.points)
        root, owner = np.sqrt(d2.astype(np.float64)), np.argmin(d2, 1)
        for s in np.unique(owner):
            own = owner == s
            self.children.append((int(s), Gnat(points, ids[rest[own]], splits, leaf)))
        owners = [s for s, _ in self.children]
        self.low = np.stack([_down(root[owner == s].min(0)) for s in owners])  # child x split
        self.high = np.stack([_up(root[owner == s].max(0)) for s in owners])

    @staticmethod
    def _spread(points: np.ndarray, splits: int) -> np.ndarray:
        """Split points far from each other: the first entry, then always the
        entry farthest from those taken (the lowest of equal ones)."""
        chosen = [0]
        near = squared(points, points[:1])[:, 0]
        while len(chosen) < min(splits, len(points)):
            chosen.append(int(np.argmax(near)))
            near = np.minimum(near, squared(points, points[chosen[-1:]])[:, 0])
        return np.sort(np.array(chosen))

    def search(self, q: np.ndarray, best: np.ndarray, who: np.ndarray, rows: np.ndarray) -> None:
        """Improves (``best``, ``who``) of the queries ``rows``."""
        d2 = squared(q[rows], self.points)
        self.measured += d2.size
        first = np.argmin(d2, 1)  # ids ascend: the lower of equal ones
        dist, num = d2[np.arange(len(rows)), first], self.ids[first]
        better = (dist < best[rows]) | ((dist == best[rows]) & (num < who[rows]))
        best[rows[better]], who[rows[better]] = dist[better], num[better]
        if not self.children:
            return
        root = np.sqrt(d2.astype(np.float64))
        least, most = _down(root), _up(root)
        # the nearest split point's subtree first: a good best entry rules out more of the others
        for mine in (True, False):
            for c, (s, child) in enumerate(self.children):
                at = np.flatnonzero((first == s) == mine)
                if not len(at):
                    continue
                gap = _down(np.maximum(least[at] - self.high[c], self.low[c] - most[at]).max(1))
                at = at[gap <= _up(np.sqrt(best[rows[at]].astype(np.float64)))]
                if len(at):
                    child.search(q, best, who, rows[at])


def build(points: np.ndarray) -> Gnat:
    """A tree over the entries of one codebook; of equal entries only the lowest can be nearest."""
    _, first = np.unique(points, axis=0, return_index=True)
    return Gnat(points, np.sort(first))


def nearest(tree: Gnat, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every query row."""
    best, who = np.full(len(q), _FAR, np.int64), np.full(len(q), _FAR, np.int64)
    step = max(1, CHUNK // max(q.shape[1], SPLITS))
    for lo in range(0, len(q), step):
        tree.search(q, best, who, np.arange(lo, min(lo + step, len(q))))
    return who, best


# The vectors as integers

def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("_vector")
        whole = lists.is_valid().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        before = np.append(0, np.cumsum(bad))
        keep = whole & (before[ends] == before[ends - sizes])
        inside = np.repeat(keep, sizes)
        values = np.floor(flat.to_numpy(zero_copy_only=False)[inside].astype(np.float64) * SCALE)
        if len(values) and np.abs(values).max() > LIMIT:
            raise ValueError(f"a component times {SCALE:g} is beyond {LIMIT}")
        offsets = np.append(0, np.cumsum(sizes[keep])).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
        rest = b.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in ("_row", "_id", "_label")), column], ["_row", "_id", "_label", "_v"])


def _matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``dim`` components, and those as a matrix."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    fit = sizes == dim
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return fit, flat[np.repeat(fit, sizes)].astype(np.int64).reshape(-1, dim)


def _assign(books: np.ndarray, dim: int) -> Callable[[pa.ListArray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Per position: the pieces of the rows that fit, their entries, their distances."""
    parts, width = books.shape[0], books.shape[2]
    trees = [build(book) for book in books]

    def run(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        fit, m = _matrix(column, dim)
        for p in range(parts):
            q = np.ascontiguousarray(m[:, p * width: (p + 1) * width])
            yield fit, q, *nearest(trees[p], q)

    return run


def _sums(books: np.ndarray, dim: int):  # noqa: ANN202
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assign(books, dim)
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for p, (_, q, who, _) in enumerate(assign(b.column("_v"))):
                n[p] += np.bincount(who, minlength=entries)
                np.add.at(s[p], who, q)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *(pa.array(s[p, e, k]) for k in range(width))],
            ["p", "e", "n", *(f"s{k}" for k in range(width))])

    return run


def train(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) for the integer vectors ``_v`` of the
    dimension ``dim``; the first ``entries`` by ``_id`` start them."""
    fit = vectors.where(F.size("_v") == dim)
    first = fit.orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).select("_v").collect()  # bounded by the parameter
    width = dim // parts
    books = np.array([r["_v"] for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    schema = "p int, e int, n long, " + ", ".join(f"s{k} long" for k in range(width))
    for _ in range(rounds):
        # a row per part and entry at most, of any number of vectors
        found = (vectors.select("_v").mapInArrow(_sums(books, dim), schema).groupBy("p", "e")
                 .agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).collect())
        for r in found:
            books[r["p"], r["e"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return books


def _codes(books: np.ndarray, dim: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assign(books, dim)
        for b in batches:
            error, codes, fit = 0, [], np.zeros(b.num_rows, bool)
            for fit, _, who, d2 in assign(b.column("_v")):  # noqa: B007
                codes.append(who.astype(np.uint8))
                error = error + d2
            text = np.full(b.num_rows, None, object)
            text[fit] = [row.tobytes().hex() for row in np.stack(codes, 1)]
            full = np.zeros(b.num_rows, np.int64)
            full[fit] = error
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_label"), pa.array(text, pa.string()), pa.array(full, mask=~fit)],
                                             ["_row", "_label", "code", "error"])

    return run


def compress(df: DataFrame, key: Column, vector: Column, label: Column, keep: list[str] | None = None,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """The rows with a usable vector (all input columns, or those in ``keep``)
    with ``code`` (two hex digits for each part), ``error`` (squared distance
    summed over the parts), ``label_error`` (that summed over equal labels)
    and ``codebooks_sha256`` (of all entries' components, comma-joined)."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("1 to 256 entries, at least one part")
    if not isinstance(df.select(vector.alias("_v")).schema["_v"].dataType.elementType, (T.FloatType, T.DoubleType)):
        vector = vector.cast("array<double>")
    df = pack(df, keep, _id=key, _label=label, _vector=vector)
    schema = T.StructType([*(df.schema[c] for c in ("_row", "_id", "_label")), T.StructField("_v", T.ArrayType(T.IntegerType(), False))])
    vectors = materialize(df.mapInArrow(_integers, schema), "vectors")
    usable = (F.size("_v") > 0) & (F.size("_v") % parts == 0)
    top = vectors.where(usable).orderBy(F.asc_nulls_last("_id"), "_v").select(F.size("_v").alias("dim")).limit(1).collect()
    names = ("code", "error", "label_error", "codebooks_sha256")
    if not top:
        kinds = ("string", "long", "long", "string")
        return unpack(vectors, **{n: F.lit(None).cast(k) for n, k in zip(names, kinds, strict=True)})
    dim = top[0]["dim"]
    books = train(vectors, dim, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    schema = T.StructType([*(vectors.schema[c] for c in ("_row", "_label")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = materialize(vectors.select("_row", "_label", "_v").mapInArrow(_codes(books, dim), schema), "codes")
    # as (value, is NULL) both sides can be split where one label holds most rows
    coded = coded.withColumns({"_k": F.coalesce(F.col("_label").cast("string"), F.lit("")), "_none": F.col("_label").isNull()})
    sums = coded.groupBy("_k", "_none").agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, ["_k", "_none"], "left")
    fits = F.col("code").isNotNull()
    return unpack(out, code=F.col("code"), error=F.col("error"), label_error=F.when(fits, F.col("label_error")),
                  codebooks_sha256=F.lit(digest))
