"""Vector codes, fill-in-middle and WARC archives: brute force, round trips
and the cases that every operator defines."""

import base64
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoptally.llm import fill_in_middle as fim
from shoptally.llm import vector_codes as vc
from shoptally.llm import warc

C = F.col


# 11 vector codes

def _codes_by_force(rows, parts, entries, rounds):
    """{row number: (code, error)} and the codebooks, in plain Python."""
    kept = [(i, v, lab, k) for k, (i, v, lab) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(x * 256) for x in v], lab, k) for i, v, lab, k in kept]
    order = sorted((r for r in kept if r[1] and len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(order[0][1])
    w = dim // parts
    order = [r for r in order if len(r[1]) == dim]
    books = [[tuple(r[1][p * w:(p + 1) * w]) for r in order[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for r in order:
                x = r[1][p * w:(p + 1) * w]
                own.setdefault(best(p, x)[1], []).append(x)
            for n, xs in own.items():
                books[p][n] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out = {r[3]: None for r in kept}
    for r in order:
        got = [best(p, r[1][p * w:(p + 1) * w]) for p in range(parts)]
        out[r[3]] = ("".join(f"{n:02x}" for _, n in got), sum(d for d, _ in got))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, k, "c", 1.5) for k, r in enumerate(rows)],
                                 "vec_id long, embedding array<float>, label int, k int, code string, _v double")


@pytest.mark.parametrize("entries", [5, 64])
def test_codes_match_brute_force(spark, entries):
    rng = random.Random(entries)
    point = lambda n: [rng.choice([rng.uniform(-1, 1), rng.randint(-3, 3) / 4]) for _ in range(n)]
    rows = [(rng.randint(0, 150), point(8), rng.choice([None, 0, 1])) for _ in range(400)]
    rows += [rows[3]] * 30  # repeated rows
    rows += [(None, point(8), 2), (1, None, 0), (2, [], 0), (3, [1.0] * 7 + [None], 0), (4, [float("nan")] * 8, 0), (5, [float("inf")] + [0.0] * 7, 1),
             (6, point(4), 1), (7, point(9), 1)]
    df = _vectors(spark, rows).repartition(5)
    out = vc.compress(df, C("vec_id"), C("embedding"), C("label"), parts=4, entries=entries)
    assert out.columns == ["vec_id", "embedding", "label", "k", "_v", "code", "error", "label_error", "codebooks_sha256"]
    want, books = _codes_by_force(rows, 4, entries, vc.ROUNDS)
    got = {r["k"]: r for r in out.collect()}
    assert {k: r["code"] and (r["code"], r["error"]) for k, r in got.items()} == want
    assert {r["codebooks_sha256"] for r in got.values()} == {books}
    for k, r in got.items():
        total = sum(e[1] for j, e in want.items() if e and rows[j][2] == rows[k][2])
        assert r["label_error"] == (total if want[k] else None)


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")], 1)], [(1, [], 0)]):
        out = vc.compress(_vectors(spark, rows), C("vec_id"), C("embedding"), C("label"))
        assert [r["code"] for r in out.collect()] == ([None] if rows and rows[0][1] == [] else [])
    with pytest.raises(Exception, match="beyond"):
        vc.compress(_vectors(spark, [(1, [1e30] * 16, 0)]), C("vec_id"), C("embedding"), C("label")).collect()


@pytest.mark.parametrize("width, spread", [(1, 5), (4, 40), (4, 3), (16, 200)])
def test_tree_equals_all_entries_and_measures_fewer(width, spread):
    rng = np.random.default_rng(width * spread)
    centres = rng.integers(-20 * spread, 20 * spread, (12, width))
    book = centres[rng.integers(0, 12, 256)] + rng.integers(-spread, spread + 1, (256, width))
    book[200:220] = book[:20]  # equal entries: the lower index
    q = np.concatenate([centres[rng.integers(0, 12, 3000)] + rng.integers(-spread, spread + 1, (3000, width)), book])
    tree = vc.build(book)
    who, dist = vc.nearest(tree, q)
    full = ((q[:, None, :] - book[None]) ** 2).sum(2)
    assert (dist == full.min(1)).all() and (who == full.argmin(1)).all()

    def measured(t):
        return t.measured + sum(measured(c) for _, c in t.children)

    assert measured(tree) < 0.5 * full.size  # whole subtrees were ruled out


# 12 fill-in-middle

TEXTS = [None, "", "a", "ab", "日本語 é😀 ſ", "x <P> y", "x<S>", "<M>", "<", "<P", "ends with <", "<S", "P>S>M>", "plain words of a text\nwith lines", "é" * 700_000,
         "word " * 300_000]


def _docs(spark, texts):
    rows = [(i, t, "o", "f", i) for t in texts for i in (None, 0, 1, 5, 17, -3, 10**12)]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, output string, form string, n long, k int"), rows


def _fim_by_force(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[j: j + 8], 16) for j in (0, 8, 16, 24))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_in_middle(spark):
    df, rows = _docs(spark, TEXTS)
    out = fim.fill_in_middle(df, C("doc_id"), C("text"))
    assert out.columns == ["doc_id", "text", "k", "n", "form", "prefix_chars", "middle_chars", "output", "pieces"]
    back = fim.restore(out, C("output"), C("form"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = {r["k"]: r for r in fim.fill_in_middle_digests(df, C("doc_id"), C("text"), keep=["k"]).collect()}
    forms = set()
    for r in back.collect():
        i, t = rows[r["k"]][:2]
        want = _fim_by_force(i, t)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["restored"] == (t or "")
        raw = ((t or "").encode(), fim.SENTINELS)  # the piece table gives the output
        assert b"".join(raw[p["buffer"]][p["start"]: p["start"] + p["length"]] for p in r["pieces"]) == want[4].encode()
        d = digests[r["k"]]
        assert (d["n"], d["form"], d["output_sha256"], d["restored_sha256"]) == (want[0], want[1], sha(want[4]), sha(t or ""))
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(spark):
    df, _ = _docs(spark, TEXTS[:1])
    empty = df.limit(0)
    assert fim.fill_in_middle(empty, C("doc_id"), C("text")).collect() == []
    assert fim.fill_in_middle_digests(empty, C("doc_id"), C("text")).collect() == []
    none = fim.restore(df, F.lit(None).cast("string"), C("form")).collect()
    assert {r["restored"] for r in none} == {None}


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 18])
def test_byte_positions(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    text = "aé😀日b"
    want = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert [fim.byte_positions(memoryview(text.encode()), [k])[0] for k in range(len(text) + 1)] == want
    assert fim.byte_positions(memoryview(text.encode()), [1, 1, 4, 5]) == [want[1], want[1], want[4], want[5]]


# 13 WARC

def _b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "e", "r") for r in rows], "page_id long, url string, html string, file string, record_type string")


PAGES = ([(None, "http://a/n", "same"), (7, "http://a/7", "same"), (3, "http://a/3 b\r\nX: y", "same"), (3, "http://a/3 b\r\nX: y", "same"), (-5, None, None),
          (9, "http://a/9", ""), (10, "http://ü/10", "<p>日本 é\r\n\r\nWARC/1.1</p>"), (11, None, "long " * 400_000), (10**15, "", "other")]
         + [(100 + i, f"http://h/{i}", f"<html>{i} " + "body " * (i % 50)) for i in range(300)] + [(1000, "http://hot", "hot " * 500)] * 400)


def _expected(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first, out = {}, []
    for k in order:
        i, _, h = rows[k]
        raw = (h or "").encode()
        kind = "revisit" if raw in first else "response"
        out.append((i, len(raw), _b32(raw), kind, first.get(raw)))
        first.setdefault(raw, i)
    return out


def _read(spark, uri, **how):
    return warc.read_warc(spark, uri, **how)


@pytest.mark.parametrize("shard, roll", [(1 << 30, 1 << 30), (20_000, 3_000)])
def test_archive_round_trip(spark, tmp_path, shard, roll):
    uri = warc.write_warc(_pages(spark, PAGES).repartition(4), C("page_id"), C("url"), C("html"), str(tmp_path / "w"), shard, roll, 2_000)
    rows = _read(spark, uri).collect()
    got = [(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    null = lambda x: tuple((v is None, v or 0) for v in x[:2]) + tuple(str(v) for v in x[2:])
    assert sorted(got, key=null) == sorted(_expected(PAGES), key=null)
    by_id = {r["record_id"]: r for r in rows}
    assert len(by_id) == len(rows)
    for r in rows:
        if r["record_type"] == "revisit":  # the referred record is there, and is the response with this payload
            first = by_id[r["refers_to_id"]]
            assert first["record_type"] == "response" and first["payload_digest"] == r["payload_digest"] and first["key"] == r["refers_to"]
            assert r["payload"] is None
        else:
            assert _b32(r["payload"]) == r["payload_digest"]
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert (len(files) > 5) == (shard < 1 << 30) and not list((tmp_path / "w").glob("_temporary*"))
    listed = {r["name"]: r for r in spark.read.parquet(f"{uri}/manifest").collect()}
    assert sorted(listed) == [f.name for f in files]
    for f in files:
        raw = f.read_bytes()
        assert len(raw) == listed[f.name]["bytes"] and hashlib.sha256(raw).hexdigest() == listed[f.name]["sha256"]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert sum(s["length"] for s in listed[f.name]["segments"]) == len(raw)


def test_hot_record_is_split(spark, tmp_path):
    uri = warc.write_warc(_pages(spark, PAGES), C("page_id"), C("url"), C("html"), str(tmp_path / "w"), 100_000, 1 << 20)
    hot = _read(spark, uri).where("key = 1000").groupBy("file").count().collect()
    assert len(hot) > 2 and max(r["count"] for r in hot) < 200


def test_equal_input_gives_equal_archives(spark, tmp_path):
    digests = []
    for k, df in enumerate([_pages(spark, PAGES).repartition(3), _pages(spark, PAGES[::-1]).repartition(7)]):
        warc.write_warc(df, C("page_id"), C("url"), C("html"), str(tmp_path / f"w{k}"), 20_000, 3_000)
        digests.append({f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in (tmp_path / f"w{k}").glob("*.warc.gz")})
    assert digests[0] == digests[1] and len(digests[0]) > 10


def test_damage_is_found(spark, tmp_path):
    uri = warc.write_warc(_pages(spark, PAGES[:9]), C("page_id"), C("url"), C("html"), str(tmp_path / "w"))
    f = next((tmp_path / "w").glob("*.warc.gz"))
    members, raw = [], f.read_bytes()
    while raw:
        z = zlib.decompressobj(31)
        members.append(z.decompress(raw))
        raw = z.unused_data
    broken = [m.replace(b"same", b"some") for m in members]
    for payload in (b"".join(map(warc.member, broken)), f.read_bytes()[:-9]):
        f.write_bytes(payload)
        with pytest.raises(Exception, match="digest|shorter|cut"):
            _read(spark, uri).collect()


def test_publishing_twice_and_by_half(tmp_path):
    temp = tmp_path / "_temporary-x"
    temp.mkdir()
    (temp / "t").write_bytes(b"abc")
    row = {"shard": 0, "seq": 0, "name": "part.warc.gz", "temp": "_temporary-x/t", "records": 1, "bytes": 3, "sha256": "", "segments": []}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([row], warc._FILES_ARROW)
    for _ in range(2):
        list(warc._publish(f"file://{tmp_path}")(iter([batch])))
    assert (tmp_path / "part.warc.gz").read_bytes() == b"abc"
    (tmp_path / "part.warc.gz").write_bytes(b"a")
    with pytest.raises(OSError, match="neither"):
        list(warc._publish(f"file://{tmp_path}")(iter([batch])))


def test_archive_of_nothing(spark, tmp_path):
    uri = warc.write_warc(_pages(spark, PAGES).limit(0), C("page_id"), C("url"), C("html"), str(tmp_path / "w"))
    assert _read(spark, uri).collect() == []
