"""The pipeline, stage by stage, against brute force on each stage's own input."""

import corpus_pipeline as P
from shoptally.llm.queries import QUERIES, ranks
from tests.conftest import SF_SMALL
from tests.llm.test_operators import _components_by_force, _dedup_by_force, _leaks_by_force


def test_stages(spark):
    import base64

    import tiktoken

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontaminate", "bpe"]
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, SF_SMALL), name)
        after = {r.doc_id: r for r in docs.collect()}
        text = {i: r.text for i, r in before.items()}
        if name == "quality_rules":
            want = {r.doc_id for r in QUERIES["op8_quality_rules"](spark, SF_SMALL).where("kept").collect()}
            assert set(after) == want and all(after[i].text == text[i] for i in after)
        elif name == "line_dedup":
            kept = _dedup_by_force(list(text.items()), P.NEAR_LINE_CHARS)
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in kept.items() if t.split() or t == text[i]}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "ngram_join":
            assert set(after) == {i for i, (_, c) in _components_by_force(list(text.items())).items() if c == i}
        elif name == "decontaminate":
            assert set(after) == set(text) - {i for i, _ in _leaks_by_force(list(text.items()), items)}
        else:
            path, pattern = ranks()
            with open(path, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            assert {i: r.ids for i, r in after.items()} == {i: enc.encode_ordinary(t) for i, t in text.items()}
        if name != "bpe":
            assert docs.columns == columns
        before = after
    assert len(before) > 50


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, SF_SMALL), name)
    assert docs.count() == 0


def test_near_copies_by_five_words(spark):
    w = [f"w{k}" for k in range(104)]
    # 23 words more: five-word Jaccard 100/123, four-word 101/124 < 0.85; 26 words more: 100/126
    rows = [(1, w), (2, w + [f"x{k}" for k in range(23)]), (3, w + [f"y{k}" for k in range(26)])]
    sets = [{tuple(x[k:k + 5]) for k in range(len(x) - 4)} for _, x in rows]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8 > len(sets[0] & sets[2]) / len(sets[0] | sets[2])
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(P.STAGES)["ngram_join"](spark, docs, SF_SMALL).collect()) == [1, 3]
    four = P.jaccard_components(docs, "doc_id", "text").collect()
    assert {r.doc_id: r.component_id for r in four} == {1: 1, 2: 2, 3: 3}
