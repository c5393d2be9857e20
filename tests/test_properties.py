"""Property tests (hypothesis) for the reusable building blocks."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoptally.functions import semantics as S
from shoptally.functions.ranking import row_number_by_id

ALPHABET = "ab_%\\ xÁá"


def like_to_regex(pattern: str) -> str:
    out = []
    for ch in pattern:
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
    return "^" + "".join(out) + "$"


@settings(max_examples=25, deadline=None)
@given(values=st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=6)), min_size=1, max_size=12),
       kw=st.text(ALPHABET, max_size=3))
def test_keyword_match_is_case_insensitive_like(spark, values, kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = sorted(r["i"] for r in df.where(S.keyword_match(kw, "v", trim=False)).collect())
    if kw.rstrip(" ") == "":
        want = list(range(len(values)))
    else:
        rx = re.compile(like_to_regex(f"%{kw}%"), re.S | re.I)
        want = [i for i, v in enumerate(values) if v is not None and rx.match(v)]
    assert got == want


@settings(max_examples=15, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(0, 10_000)), min_size=1, max_size=60),
       block=st.sampled_from([1, 7, 64, 65536]))
def test_row_number_by_id_equals_row_number(spark, rows, block):
    df = spark.createDataFrame(rows, "g string, id long").dropDuplicates(["g", "id"])
    mine = {(r["g"], r["id"]): r["row_no"] for r in row_number_by_id(df, ["g"], "id", block=block).collect()}
    ref = {(r["g"], r["id"]): r["rn"] for r in
           df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id"))).collect()}
    assert mine == ref
