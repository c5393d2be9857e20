"""Line dedup by a deletion neighbourhood (operator 1), JVM-side only.

A line goes if an earlier line (by document id, then line number) is equal to
it or within one edit. Lines are compared without the white space around them.
Every line with a word takes part. One edit is allowed where it changes a fifth
of a line at most, the similarity of 0.8 that near duplicates take: shorter
lines (under ``near_chars`` code points, 5) go only if equal. A caller may leave
short lines out altogether (``min_chars``).

Equal lines: the first of each by a grouped minimum over 128-bit hashes.

Near lines, over the distinct ones: the neighbourhood of a line are the line
and its variants with one character deleted, each a hashed key with the place
of the deletion. Two lines are within one edit exactly if both have the same
variant at the same place (a substitution), or one line is a variant of the
other (an insertion); so equal keys are joined with the earliest line of the
key, and the pair's edit distance is verified.

A line of n characters has n variants, too many for a corpus. They are emitted
only where a partner is possible, which loses none: of two lines within one
edit, cut into parts by the shorter one's length, all parts but one are equal.
First with halves (hashes only, no text leaves the scan): a line whose halves
no other line of that length has is done. Then, for the lines that remain (a
bit table of fixed size picks their texts from the scan), with eighths;
variants come from the part alone in which two lines may differ.

A common line or prefix, however frequent, combines before each shuffle, and
joins exchange both sides anew so that a hot key's partition can be split.

Defined results: NULL or blank texts have no lines that take part and stay as
they are; rows with equal ids and texts are one document (the same lines are
dropped from each), different texts under one id or NULL keep their own lines
(compared in an order of text hashes); NULL ids come first; an empty table gives no rows; input columns
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import has_word, materialize, pack, strip, unpack

MIN_CHARS = 1
NEAR_CHARS = 5
PARTS = 8
TABLE_WORDS = 1 << 15


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of the halves that a line within one edit may share. ``q`` is
    the shorter length of the two, so the line's own or one less."""
    keys = []
    for less in (0, 1):
        q = n - less
        half = F.floor(q / 2).cast("int")
        keys += [F.xxhash64(F.lit("a"), q, F.left(line, half)), F.xxhash64(F.lit("z"), q, F.right(line, q - half))]
    return F.array(*keys)


def _scan(df: DataFrame, least: int) -> DataFrame:
    """_id, no, line of every line that takes part."""
    lines = df.select("_id", F.posexplode(F.transform(_lines(F.col("_text")), strip)).alias("no", "line"))
    return lines.where(F.length("line") >= least)


def _hashes(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _table_at() -> tuple[Column, Column]:
    return F.pmod("h1", F.lit(TABLE_WORDS)).cast("int"), F.pmod("h2", F.lit(64)).cast("int")


def _bit_table(lines: DataFrame) -> DataFrame:
    """One row: TABLE_WORDS 64-bit words with a bit set per line."""
    at, bit = _table_at()
    some = lines.select(at.alias("at"), F.expr("shiftleft(1L, cast(pmod(h2, 64L) as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = lines.sparkSession.range(TABLE_WORDS).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("bits"))
    words = some.unionByName(every).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "bits"))), lambda w: w["bits"]).alias("table"))


def _candidates(df: DataFrame, firsts: DataFrame, lines: DataFrame, least: int) -> DataFrame:
    """Distinct lines (h1, h2, f: first place, n, line) that share a half with another."""
    keyed = lines.where(F.col("n") >= least).select("h1", "h2", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("_a"), F.max("h1").alias("_z")).where("_a != _z").select("key", F.hash("key").alias("k"))
    some = keyed.withColumn("k", F.hash("key")).join(shared, ["key", "k"], "left_semi").select("h1", "h2").distinct()
    some = materialize(firsts.join(some, ["h1", "h2"], "left_semi"), "line-candidates")
    at, bit = _table_at()
    texts = _scan(df, least).select("_id", "no", "line", *_hashes())
    word = F.get(_bit_table(some).scalar(), at)
    texts = texts.where(F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1).cast("long")) == 1)
    # the first occurrence alone, so each line comes once
    return (texts.withColumn("f", F.struct("_id", "no")).join(some.select("h1", "h2", F.col("f").alias("f0"), "n"), ["h1", "h2"])
            .where(F.col("f").eqNullSafe(F.col("f0"))).select("h1", "h2", "f", "n", "line").distinct())


def _part_keys(n: Column, line: Column) -> Column:
    """Struct (q, p, key) for each part: a hash of all the rest."""
    out = []
    for less in (0, 1):
        q = n - less
        for p in range(PARTS):
            a, z = F.floor(q * p / PARTS).cast("int"), F.floor(q * (p + 1) / PARTS).cast("int")
            out.append(F.struct(q.alias("q"), F.lit(p).alias("p"), F.xxhash64(q, F.lit(p), F.left(line, a), F.right(line, q - z)).alias("key")))
    return F.array(*out)


def _near(cands: DataFrame) -> DataFrame:
    """First places of the distinct lines that have an earlier line within one edit."""
    parts = cands.select("h1", "h2", F.explode(_part_keys(F.col("n"), F.col("line"))).alias("e")).select("h1", "h2", "e.*")
    shared = parts.groupBy("key").agg(F.min("h1").alias("_a"), F.max("h1").alias("_z")).where("_a != _z").select("key", F.hash("key").alias("k"))
    parts = parts.withColumn("k", F.hash("key")).join(shared, ["key", "k"], "left_semi").select("h1", "h2", "q", "p")
    rows = cands.join(parts, ["h1", "h2"])
    n, q, p = F.col("n"), F.col("q"), F.col("p")
    a, z = F.floor(q * p / PARTS).cast("int"), F.floor(q * (p + 1) / PARTS).cast("int") + (n - q)
    # deletions in the part: at the same place in both for a substitution; place 0 meets whole lines
    rows = rows.select("h1", "h2", "f", "n", "q", "line", F.explode(F.sequence(a, F.greatest(a, z - 1))).alias("i"))
    variant = F.concat(F.left("line", F.col("i")), F.substr("line", F.col("i") + 2))
    deleted = rows.select("h1", "h2", "f", F.xxhash64(variant).alias("v"),
                          F.when(F.col("n") == F.col("q"), F.col("i") + 1).otherwise(0).alias("at"), F.lit(False).alias("whole"))
    whole = cands.select("h1", "h2", "f", F.xxhash64("line").alias("v"), F.lit(0).alias("at"), F.lit(True).alias("whole"))
    keys = deleted.unionByName(whole)
    least = keys.groupBy("v", "at").agg(F.min(F.when(F.col("whole"), F.col("f"))).alias("w"), F.min(F.when(~F.col("whole"), F.col("f"))).alias("d"),
                                        F.count(F.lit(1)).alias("_n")).where("_n > 1").select("v", "at", F.hash("v", "at").alias("k"), "w", "d")
    # a substitution's partner is another deletion; an insertion joins a whole line and a deletion
    partner = F.when((F.col("at") > 0) | F.col("whole"), F.col("d")).otherwise(F.col("w"))
    hits = (keys.withColumn("k", F.hash("v", "at")).join(least, ["v", "at", "k"]).withColumn("g", partner).where("g < f")
            .select("f", "g").distinct())
    mine, other = cands.select("f", F.col("line").alias("x")), cands.select(F.col("f").alias("g"), F.col("line").alias("y"))
    return hits.join(mine, "f").join(other, "g").where(F.levenshtein("x", "y") <= 1).select("f").distinct()


def dedup_lines(df: DataFrame, id_col: Column, text: Column, max_edits: int = 1, keep: list[str] | None = None,
                min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """The rows (all input columns, or those in ``keep``) with ``n_lines``
    (lines with a word), ``n_equal`` and ``n_near`` (lines dropped as equal to,
    or within an edit of, an earlier one) and ``kept_text``. ``max_edits`` is 0
    or 1; lines under ``min_chars`` (at least 1) code points take no part, those
    under ``near_chars`` are dropped only if equal."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    if min_chars < 1:
        raise ValueError("min_chars must be at least 1")
    near_chars = max(near_chars, min_chars)
    text = F.coalesce(text, F.lit(""))
    # a text's place: ids may repeat or be NULL
    rows = pack(df, keep, _id=F.struct(id_col.alias("id"), F.xxhash64(text).alias("text")), _text=text)
    scan = _scan(rows, min_chars)
    keys = F.when(F.length("line") >= near_chars, _half_keys(F.col("line"), F.length("line"))) if max_edits else F.lit(None).cast("array<bigint>")
    lines = materialize(scan.select("_id", "no", *_hashes(), F.length("line").alias("n"), keys.alias("keys")), "lines")
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("_id", "no")).alias("f"), F.first("n").alias("n"), F.count(F.lit(1)).alias("_n"))
    again = firsts.where("_n > 1").select("h1", "h2", "n", "f")
    place = F.struct("_id", "no")
    # n, a third key, makes the join exchange the grouped side anew
    drops = (lines.select("_id", "no", "h1", "h2", "n").join(again, ["h1", "h2", "n"]).where(~place.eqNullSafe(F.col("f")))
             .select("_id", "no", F.lit(False).alias("near")))
    if max_edits:
        cands = materialize(_candidates(rows.select("_id", "_text"), firsts.select("h1", "h2", "f", "n"), lines, near_chars), "line-texts")
        drops = drops.unionByName(_near(cands).select("f._id", "f.no", F.lit(True).alias("near")))
    drops = drops.groupBy("_id").agg(F.collect_set(F.when(~F.col("near"), F.col("no"))).alias("equal"), F.collect_set(F.when(F.col("near"), F.col("no"))).alias("near"))
    drops = drops.select(F.xxhash64("_id").alias("k"), F.col("_id").alias("_d"), "equal", "near")
    out = rows.join(drops, F.col("_id").eqNullSafe(F.col("_d")) & (F.xxhash64("_id") == F.col("k")), "left")
    none = F.array().cast("array<int>")
    equal, near = F.coalesce("equal", none), F.coalesce("near", none)
    all_lines = _lines(F.col("_text"))
    gone = F.array_union(equal, near)
    kept = F.when(F.size(gone) == 0, F.col("_text")).otherwise(F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    return unpack(out, n_lines=F.size(F.filter(all_lines, has_word)).cast("long"), n_equal=F.size(equal).cast("long"),
                  n_near=F.size(F.array_except(near, equal)).cast("long"), kept_text=kept)
