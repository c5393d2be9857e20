"""Quality rules with host verdicts (operator 8).

Every document is measured once (words, symbols, capitals, repeated lines and
repeated 5-word windows, all JVM-side). Rule failures are summed by host; a
host's failure rate per rule is shrunk towards the corpus by a beta prior that
is fitted to the hosts' rates by the method of moments, so that a host of
three pages isn't judged like one of three million. The verdicts are joined
back to the documents:

* a document that fails a base rule goes;
* a document that fails another rule goes if its host's shrunken failure rate
  for that rule is above ``max_rate`` (the failure is a habit of the host; a
  lone odd page of a clean host stays);
* every document of a host goes whose shrunken rate of documents failing any
  rule is above ``block_rate``;
* all others stay.

Defined results: a NULL or blank text has no words and fails the base rule; a
NULL host is a host of its own; repeated rows are measured and returned each;
an empty table gives an empty result; an input column named like a result is
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import has_word, materialize, pack, unpack, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_RATE = 0.01
BLOCK_RATE = 0.9
RULES = ("base", "symbols", "capitals", "dup_lines", "word_length")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: Column, host: Column, keep: list[str] | None = None) -> DataFrame:
    """``_row`` (the input), ``_host``, the measures and one flag per rule."""
    df = pack(df, keep, _text=F.coalesce(text, F.lit("")), _host=host)
    lines = F.filter(F.split("_text", "\n", -1), has_word)
    # a text's lines are gone before its words are cut
    df = df.select("_row", "_host", "_text", F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                   F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("_upper"), lines.alias("_lines"))
    df = df.select("_row", "_host", "n_symbols", "_upper", F.size("_lines").alias("_n_lines"),
                   (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), words(F.col("_text")).alias("_w"))
    df = df.select("_row", "_host", "n_symbols", "_upper", "_n_lines", "n_dup_lines", F.size("_w").alias("n_words"),
                   F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
                   F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    h = F.col("_h")
    grams = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.col("n_words") - WINDOW),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("_row", "_host", "n_words", "word_chars", "n_symbols", "_upper", "_n_lines", "n_dup_lines", grams.alias("_g"))
    # most texts repeat no window: only the others are sorted
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(
        F.transform("_g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("_s")
    same = lambda e, k: (F.get(s, k - 1)["x"].eqNullSafe(e["x"])) | (F.get(s, k + 1)["x"].eqNullSafe(e["x"]))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).withColumn("n_words", F.col("n_words").cast("long"))
    n, chars = F.col("n_words"), F.col("word_chars")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    failed = {"base": base, "symbols": 10 * F.col("n_symbols") > 3 * n, "capitals": 2 * F.col("_upper") > chars,
              "dup_lines": 2 * F.col("n_dup_lines") > F.col("_n_lines"),
              "word_length": (chars > 15 * n) | (chars < 2 * n)}
    return df.select("_row", "_host", *MEASURES, *[failed[r].alias(f"_f_{r}") for r in RULES])


def host_rates(measured: DataFrame) -> DataFrame:
    """(_host, rule, n_docs, n_failed, rate): failures by host with the rate
    shrunk by the rule's beta prior. Rule ``any`` is failing at least one."""
    any_failed = F.greatest(*[F.col(f"_f_{r}") for r in RULES])
    # one row per host and task before the shuffle, whatever the host's size
    sums = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("n_docs"), *[
        F.sum(c.cast("long")).alias(r) for r, c in [*((r, F.col(f"_f_{r}")) for r in RULES), ("any", any_failed)]])
    long = sums.select("_host", "n_docs", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_failed")) for r in (*RULES, "any")])).alias("e")).select("_host", "n_docs", "e.*")
    p, n = F.col("n_failed") / F.col("n_docs"), F.col("n_docs")
    prior = long.groupBy("rule").agg(F.sum("n_docs").alias("docs"), F.sum("n_failed").alias("failed"), F.sum(n * p * p).alias("squares"))
    m = F.col("failed") / F.col("docs")
    spread = F.col("squares") / F.col("docs") - m * m
    # alpha + beta of the beta distribution with this mean and variance; equal hosts: as strong as 10,000 documents
    strength = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e4), m * (1 - m) / F.nullif(spread, F.lit(0.0)) - 1))).otherwise(1e4)
    prior = prior.select("rule", m.alias("mean"), strength.alias("strength"))  # a row per rule
    return (long.join(F.broadcast(prior), "rule")
            .select("_host", "rule", "n_docs", "n_failed",
                    ((F.col("n_failed") + F.col("mean") * F.col("strength")) / (n + F.col("strength"))).alias("rate")))


def quality_rules(df: DataFrame, text: Column, host: Column, max_rate: float = MAX_RATE, block_rate: float = BLOCK_RATE,
                  keep: list[str] | None = None) -> DataFrame:
    """The rows (all input columns, or those in ``keep``) with their measures, ``base_failed``, ``failed_rules``,
    ``host_blocked`` and ``kept``. The measured rows are written to the shared
    checkpoint folder once, as host sums and the join back both read them."""
    measured = materialize(measure(df, text, host, keep), "quality")
    rates = host_rates(measured)
    verdicts = rates.groupBy("_host").agg(
        F.collect_set(F.when(F.col("rate") > max_rate, F.col("rule"))).alias("habits"),  # of six rules
        F.max((F.col("rule") == "any") & (F.col("rate") > block_rate)).alias("blocked"))
    verdicts = verdicts.select(F.coalesce("_host", F.lit("")).alias("vk"), F.col("_host").isNull().alias("vn"), "habits", "blocked")
    # the second key makes both sides exchange by (host, is null), so that a hot host's partition can be split
    out = measured.join(verdicts, (F.coalesce("_host", F.lit("")) == F.col("vk")) & (F.col("_host").isNull() == F.col("vn")), "left")
    fails = F.filter(F.array(*[F.when(F.col(f"_f_{r}"), F.lit(r)) for r in RULES]), lambda r: r.isNotNull())
    kept = ~F.col("_f_base") & ~F.coalesce("blocked", F.lit(False)) & ~F.arrays_overlap(fails, F.coalesce("habits", F.array().cast("array<string>")))
    return unpack(out, **{m: F.col(m) for m in MEASURES}, base_failed=F.col("_f_base"), failed_rules=fails,
                  host_blocked=F.coalesce("blocked", F.lit(False)), kept=kept)
