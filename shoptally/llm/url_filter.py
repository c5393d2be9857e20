"""URL filters by a temporal list join (operator 3), JVM-side only.

List entries are dated events (list ``block`` or ``allow``; kind ``domain``,
``host`` or ``prefix``; pattern; action ``add`` or ``remove``; day). They become
validity intervals [valid_from, valid_to) per entry. A capture is expanded to
the patterns that could name it (every parent domain, the host, the host with
each run of leading path segments, as many as the deepest entry has) and joined with the intervals of those patterns that hold its
fetch day, so it is judged by the lists as they stood then.

The most specific active entry decides (prefix, then host, then domain, a
longer domain first; ``allow`` wins a tie).

Intervals are few per pattern (events of one day count once, and only changes
of state count); a hot host's captures are on the other side of the join, whose
partition can be split, as both sides are exchanged by the join itself.

Defined results: on one day ``remove`` wins over ``add``; an entry removed
before it was added has no interval; a NULL or relative URL has no host and is
not blocked; a NULL fetch day meets no interval; NULL patterns are ignored;
patterns are compared as URLs are (lower-case hosts, no dots around a domain,
no slash at the end; a prefix names whole path segments, without query or
fragment); of a very long path only as many segments as an entry has are
taken; repeated captures are judged each; an empty table on either side gives
no rows or no matches; a kept column named like a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptally.llm.common import pack, unpack

KINDS = {"domain": 1, "host": 2, "prefix": 3}
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def normal(kind: Column, pattern: Column) -> Column:
    """A pattern as captures spell it; only a prefix's path keeps its case."""
    host, path = F.lower(F.substring_index(pattern, "/", 1)), F.regexp_extract(pattern, "^[^/]*(/.*?)/*$", 1)
    return F.when(kind == "prefix", F.concat(host, path)).when(kind == "domain", F.btrim(F.lower(pattern), F.lit("."))).otherwise(F.lower(pattern))


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) from (list, kind, pattern, action, day)."""
    entry = ["list", "kind", "pattern"]
    entries = entries.withColumn("pattern", normal(F.col("kind"), F.col("pattern")))
    days = (entries.where("pattern is not null and day is not null").groupBy(*entry, "day")
            .agg((F.max(F.when(F.col("action") == "remove", 1).otherwise(0)) == 0).alias("on")))
    w = Window.partitionBy(*entry).orderBy("day")
    turns = days.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("`on` != was")
    turns = turns.withColumn("next", F.lead("day").over(w)).where("`on`")
    return turns.select(*entry, F.col("day").alias("valid_from"), F.coalesce("next", F.lit(FOREVER).cast("date")).alias("valid_to"))


def _segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]+)", 1)
    return F.when(path != "", F.split(path, "/", -1))


def _patterns(host: Column, segments: Column, count: Column) -> Column:
    """array<struct<kind, pattern>> that could name a capture; prefixes of up to ``count`` path segments."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    pair = lambda kind, p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: pair("domain", F.array_join(F.slice(labels, i, n), ".")))
    prefixes = F.when(count > 0, F.transform(
        F.sequence(F.lit(1), count), lambda i: pair("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    return F.when(host.isNotNull(), F.concat(domains, F.array(pair("host", host)), F.coalesce(prefixes, none)))


def filter_urls(captures: DataFrame, url: Column, day: Column, entries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per capture: its columns (or those in ``keep``), host, fetched_on,
    matches (active entries that name it), blocked, decided_by (list:kind:pattern)."""
    spans = validity(entries).select("list", F.col("kind").alias("_kind"), F.col("pattern").alias("_pattern"), F.hash("pattern").alias("_k"), "valid_from", "valid_to")
    rows = pack(captures, keep, _id=F.monotonically_increasing_id(), _url=url, _host=host_of(url), _day=day)
    # a number from the lists, for all captures: how deep their prefixes go
    depth = entries.where("kind = 'prefix'").agg(
        F.coalesce(F.max(F.size(F.split(normal(F.col("kind"), F.col("pattern")), "/", -1)) - 1), F.lit(0)).alias("depth")).scalar()
    rows = rows.withColumn("_path", _segments(F.col("_url"))).withColumn("_count", F.least(F.size("_path"), depth))
    asked = rows.select("_id", "_row", "_host", "_day", F.explode_outer(_patterns(F.col("_host"), F.col("_path"), F.col("_count"))).alias("p"))
    asked = asked.select("_id", "_row", "_host", "_day", "p.kind", "p.pattern", F.hash("p.pattern").alias("k"))
    met = asked.join(spans, (F.col("kind") == F.col("_kind")) & (F.col("pattern") == F.col("_pattern")) & (F.col("k") == F.col("_k"))
                     & (F.col("_day") >= F.col("valid_from")) & (F.col("_day") < F.col("valid_to")), "left")
    met = met.select("_id", "_row", "_host", "_day", F.when(F.col("list").isNotNull(), F.struct(
        rank_of(F.col("_kind")).alias("rank"), F.length("_pattern").alias("n"), (F.col("list") == "allow").alias("allow"),
        F.concat_ws(":", "list", "_kind", "_pattern").alias("name"))).alias("e"))
    out = met.groupBy("_id", "_row", "_host", "_day").agg(F.count("e").alias("matches"), F.max("e").alias("e"))
    return unpack(out, host=F.col("_host"), fetched_on=F.col("_day"), matches=F.col("matches"),
                  blocked=F.coalesce(~F.col("e.allow"), F.lit(False)), decided_by=F.col("e.name"))


def rank_of(kind: Column) -> Column:
    out = F.lit(0)
    for k, r in KINDS.items():
        out = F.when(kind == k, r).otherwise(out)
    return out
