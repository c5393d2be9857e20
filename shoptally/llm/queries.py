"""The registered queries of this subpackage: thin calls of its operators on
whole tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptally.llm import (
    bpe,
    chat,
    decontaminate,
    fill_in_middle,
    license_scan,
    line_dedup,
    ngram_join,
    quality_rules,
    secret_scan,
    sharding,
    url_filter,
    vector_codes,
    warc,
)
from shoptally.llm.common import checkpoint_dir, read

C = F.col
RANKS = "byte_bpe_multi_50k.tiktoken"


def ranks() -> tuple[str, str]:
    """Path of the rank file and the split pattern (never copied here)."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs, C("doc_id"), C("text"), keep=["doc_id"])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, "text", *ranks())


def captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day within 2024 (the table has none)."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(C("page_id") * 7919, F.lit(366)).cast("int")).alias("day"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list events derived from the hosts that occur: every host's
    parent domain is blocked from one day of the year to another, advertising
    hosts for good, mobile hosts are allowed again for a time, and the German
    pages of every host are blocked in the second half of the year."""
    hosts = pages.select(url_filter.host_of(C("url")).alias("host")).where("host is not null").distinct()
    seed = F.ascii("host") * 31 + F.ascii(F.right("host", F.lit(9))) * 7 + F.length("host") * 17
    hosts = hosts.withColumn("v", F.pmod(seed, F.lit(300)).cast("int"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    event = lambda lst, kind, pattern, action, on: F.struct(F.lit(lst).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"),
                                                            F.lit(action).alias("action"), on.alias("day"))
    domain = F.substring_index("host", ".", -3)
    ads, mobile = F.contains("host", F.lit("ads-")), F.startswith("host", F.lit("m."))
    events = F.array(
        event("block", "domain", domain, "add", day(C("v"))), event("block", "domain", domain, "remove", day(C("v") + 40)),
        event("block", "prefix", F.concat("host", F.lit("/de")), "add", F.lit("2024-07-01").cast("date")),
        F.when(ads, event("block", "host", C("host"), "add", F.lit("2024-02-01").cast("date"))),
        F.when(mobile, event("allow", "host", C("host"), "add", day(C("v") + 10))),
        F.when(mobile, event("allow", "host", C("host"), "remove", day(C("v") + 20))))
    return hosts.select(F.explode(F.array_compact(events)).alias("e")).select("e.*")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(captures(pages), C("url"), C("day"), list_entries(pages), ["page_id", "url"])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item found in it."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(read(spark, sf_dir, "documents"), C("doc_id"), C("text"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secret_scan.scan_secrets(docs, C("text"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(C("spans")).alias("spans"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents are sharded and written; size and checksum are taken of the texts read back."""
    sharded = sharding.shard_rows(read(spark, sf_dir, "documents"), C("doc_id"), C("text"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex[:12]}"
    sharding.write_shards(sharded, path)
    back = sharding.read_shards(spark, path, sharded.schema)
    text = F.coalesce("text", F.lit(""))
    return back.select("doc_id", (F.octet_length(text) + sharding.OVERHEAD).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = quality_rules.quality_rules(docs, C("text"), C("source"), keep=["doc_id"])
    return out.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations; conversation -1
    says the template's own control strings."""
    say = "<|im_end|><|im_start|>assistant ok"
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), C("id").alias("turn"),
                                   F.when(C("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(say).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    back = chat.read_back(chat.format_chats(rows, C("conv_id"), C("turn"), C("role"), C("text")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), "doc_id", "text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return vector_codes.compress(rows, C("vec_id"), C("embedding"), C("label"), keep=["vec_id"])


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return fill_in_middle.fill_in_middle_digests(docs, C("doc_id"), C("text"), keep=["doc_id"])


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages, written and read back."""
    pages = read(spark, sf_dir, "pages")
    found = warc.read_warc(spark, warc.write_warc(pages, C("page_id"), C("url"), C("html")), payload=False)
    return found.select(C("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe": op2_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_format": op9_chat_format,
    "op10_ngram_join": op10_ngram_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_warc": op13_warc,
}
