"""Secret scans over a trigram inverted index (operator 6), JVM-side only.

From each rule's regular expression a Boolean query over trigrams is derived:
the literal runs that every match holds (alternatives, optional characters and
small classes are multiplied out) give clauses, a clause is a choice of
trigram sets, and a text can match only if every clause has a set that the
text holds whole. Trigrams are taken of the lower-cased text, so the index
serves rules in either case.

The index holds the trigrams that some query asks for: postings (trigram,
text), a text named by 128 bits of hash, so copies share their postings.
Queries intersect the postings by grouping; the texts that are left for a rule
are joined back to the documents and verified by the expression itself. Rules
without mandatory trigrams (``hex``) scan every text.

Spans are code points, end exclusive: the gaps between the matches (``split``)
and the matches give the places.

Defined results: NULL and empty texts have no spans; overlapping spans of
different kinds are all reported; repeated rows are reported each; an empty
table gives no rows; an input column named like a result is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import materialize, pack, unpack

MAX_CHOICES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` is valid in Java and Python alike; a match counts if group
    ``value`` has at least ``least`` code points."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


# The base kinds, then public key formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def _strings(op, arg) -> set[str] | None:  # noqa: ANN001
    """All strings that one element matches (lower-cased), if they are few."""
    from re import _constants as K

    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN:
        got: set[str] = set()
        for kind, x in arg:
            if kind is K.LITERAL:
                got.add(chr(x).lower())
            elif kind is K.RANGE and x[1] - x[0] < MAX_CHOICES:
                got |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return got if len(got) <= 8 else None
    if op is K.SUBPATTERN:
        return _sequence(arg[3])
    if op is K.BRANCH:
        each = [_sequence(a) for a in arg[1]]
        return None if None in each else set().union(*each)
    if op is K.MAX_REPEAT and tuple(arg[:2]) == (0, 1):
        inner = _sequence(arg[2])
        return None if inner is None else inner | {""}
    return None


def _sequence(parsed) -> set[str] | None:  # noqa: ANN001
    got = {""}
    for op, arg in parsed:
        each = _strings(op, arg)
        if each is None or len(got) * len(each) > MAX_CHOICES:
            return None
        got = {a + b for a, b in product(got, each)}
    return got


def mandatory(parsed) -> list[set[str]]:  # noqa: ANN001
    """Clauses: of each, some string is in every match."""
    from re import _constants as K

    clauses, run = [], {""}
    for op, arg in parsed:
        each = _strings(op, arg)
        if each is not None and len(run) * len(each) <= MAX_CHOICES:
            run = {a + b for a, b in product(run, each)}
            continue
        clauses.append(run)
        run = {""} if each is None else each
        if op is K.SUBPATTERN:
            clauses += mandatory(arg[3])
        elif op is K.MAX_REPEAT and arg[0] >= 1:
            clauses += mandatory(arg[2])
    return [c for c in [*clauses, run] if all(len(s) >= 3 for s in c)]


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses of alternatives of trigrams; empty if nothing is mandatory."""
    from re import _parser

    return [[sorted({s[i: i + 3] for i in range(len(s) - 2)}) for s in sorted(c)] for c in mandatory(_parser.parse(pattern))]


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, h1, h2) for each of the trigrams that a text holds."""
    low = texts.select("h1", "h2", F.lower("_text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("h1", "h2", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, list]) -> DataFrame:
    """(h1, h2, kinds): the rules whose query the postings satisfy."""
    spark = index.sparkSession
    terms = [(kind, c, a, len(tri), len(q), t) for kind, q in queries.items() for c, alts in enumerate(q) for a, tri in enumerate(alts) for t in tri]
    # a row per trigram of the rules, which are a parameter
    asked = F.broadcast(spark.createDataFrame(terms, "kind string, clause int, choice int, need int, clauses int, trigram string"))
    key = ["h1", "h2", "kind", "clauses"]
    whole = (index.join(asked, "trigram").groupBy(*key, "clause", "choice", "need").agg(F.count(F.lit(1)).alias("got"))
             .where("got = need"))
    met = whole.groupBy(*key).agg(F.size(F.collect_set("clause")).alias("met")).where("met = clauses")  # of a rule's clauses
    return met.groupBy("h1", "h2").agg(F.collect_set("kind").alias("kinds"))  # of the rules' kinds


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of a rule's matches."""
    pat = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    value = whole if rule.value == 0 else F.regexp_extract_all(text, pat, F.lit(rule.value))
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.transform(whole, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"), F.length(F.get(value, i)).alias("v")))

    def step(acc: Column, e: Column) -> Column:
        start = acc["at"] + e["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + e["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + e["n"]).alias("at"), F.when(e["v"] >= rule.least, F.array_append(acc["all"], span)).otherwise(acc["all"]).alias("all"))

    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return F.when(F.size(whole) > 0, F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("all")), step, lambda a: a["all"])).otherwise(none)


def scan_secrets(df: DataFrame, text: Column, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """The rows (all input columns, or those in ``keep``) with ``spans``:
    array<struct<start, order, end, kind>> by start, then the rules' order."""
    for r in rules:
        re.compile(r.pattern)
    rows = pack(df, keep, _text=F.coalesce(text, F.lit("")))
    rows = rows.withColumn("h1", F.xxhash64("_text")).withColumn("h2", F.xxhash64(F.lit(1), F.col("_text")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for alts in q for tri in alts for t in tri})
    index = materialize(postings(rows, trigrams), "trigrams")
    found = candidates(index, queries).select("h1", "h2", F.hash("h1", "h2").alias("k"), "kinds")
    # k makes the grouped side exchange anew, so that the copies of one text can be split
    rows = rows.withColumn("k", F.hash("h1", "h2")).join(found, ["h1", "h2", "k"], "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    each = []
    for order, r in enumerate(rules):
        verify = F.col("_text").rlike(r.pattern)
        if r.kind in queries:
            verify = F.array_contains("kinds", r.kind) & verify
        each.append(F.when(verify, _spans(F.col("_text"), r, order)).otherwise(none))
    rows = rows.select("_row", F.sort_array(F.concat(*each)).alias("_s"))
    return unpack(rows, spans=F.col("_s"))
