"""The queries with SQL against DuckDB, and the contract columns of all."""

import pytest

from shoptally.llm.oracles import ORACLE
from shoptally.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck_connect


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, duck, key):
    problems, _, _, _ = compare(spark, duck, key, QUERIES[key], ORACLE[key], SF_SMALL)
    assert not problems, "\n".join(problems)


def test_all_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_sharding_query(spark):
    rows = QUERIES["op7_sharding"](spark, SF_SMALL).toPandas()
    assert len(rows) == rows.doc_id.nunique() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    sizes = rows.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert list(sizes.index) == list(range(40)) and sizes["size"].max() - sizes["size"].min() <= 1
    assert (sizes["max"] + 1 == sizes["size"]).all() and (sizes["nunique"] == sizes["size"]).all()
    import zlib

    text = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.size_ == len(text[r.doc_id]) + 16
               for r in rows.rename(columns={"size": "size_"}).itertuples())


def test_bpe_query(spark):
    import base64
    import hashlib
    import struct

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in QUERIES["op2_bpe"](spark, SF_SMALL).collect()}
    for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = enc.encode_ordinary(d.text or "")
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 3, 5, 6, 7, 8, 9])
def test_native(spark, n):
    """No Python in the plans of the operators that are to stay in the JVM, and no cross joins."""
    key = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    plan = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
