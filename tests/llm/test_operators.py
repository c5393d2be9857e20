"""Small cases of every operator: NULLs, empty and very long texts, ties,
repeated rows, empty tables and clashing column names; brute force where SQL
doesn't reach."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shoptally.llm import (
    bpe,
    chat,
    decontaminate,
    license_scan,
    line_dedup,
    ngram_join,
    quality_rules,
    secret_scan,
    sharding,
    url_filter,
)
from shoptally.llm.components import components
from shoptally.llm.queries import ranks

C = F.col
# columns named like the operators' own and like their results
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, _row string, _text string, h1 string, kept string, "
        "n_words string, spans string, shard string, ids string, k string, line string, n string")


def docs(spark, rows):
    """(doc_id, text, source) with columns that clash."""
    full = [(i, t, "en", s, None, "r", "t", "h", "x", "w", "s", "a", "i", "k", "l", "n") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"word{i % 9973} of{i % 7}" for i in range(60_000))
EDGE = [(None, "a text without an id that has more than ten words in it, really", None), (1, None, "a"), (2, "", "a"), (3, " \t\n ", None),
        (4, LONG, "b"), (5, "one two three", "b"), (5, "one two three", "b"), (6, "one two three", "b"), (7, "日本語 のテキスト é😀 'ſ", "a")]


# 1 line dedup

def _dedup_by_force(rows, near_chars=line_dedup.NEAR_CHARS):
    ws = " \t\n\x0b\x0c\r"
    order = sorted(((i, no, l.strip(ws)) for i, t in set(rows) for no, l in enumerate((t or "").split("\n"))),
                   key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    order = [x for x in order if len(x[2]) >= line_dedup.MIN_CHARS]
    place = {}
    for i, no, l in order:
        place.setdefault(l, (i, no))
    rank = {l: k for k, l in enumerate(place)}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[k + (len(a) == len(b)):] == b[k + 1:]

    long = [l for l in place if len(l) >= near_chars]
    near = {a for a in long for b in long if rank[b] < rank[a] and one_edit(a, b)}
    gone = defaultdict(set)
    for i, no, l in order:
        if place[l] != (i, no) or l in near:
            gone[i].add(no)
    return {i: "\n".join(l for no, l in enumerate((t or "").split("\n")) if no not in gone[i]) for i, t in rows}


def test_line_dedup_near(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé fgh") for _ in range(rng.randint(8, 60))) for _ in range(40)]

    def edit(s):
        k = rng.randrange(len(s) + 1)
        return rng.choice([s[:k] + rng.choice("xyzé") + s[k:], s[:k] + s[k + 1:], s[:k] + "q" + s[k + 1:], s, " " + s + "\t"])

    rows = [(i, "\n".join(edit(edit(rng.choice(base)) if rng.random() < 0.3 else rng.choice(base)) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x" * 3000 + "\n" + "x" * 2999 + "\n" + "x" * 1500 + "y" + "x" * 1499)]
    got = line_dedup.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows]), C("doc_id"), C("text"), keep=["doc_id"])
    want = _dedup_by_force(rows)
    found = {r.doc_id: r for r in got.collect()}
    assert {i: r.kept_text for i, r in found.items()} == want
    assert sum(r.n_near for r in found.values()) > 20 and sum(r.n_equal for r in found.values()) > 20
    exact = line_dedup.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows]), C("doc_id"), C("text"), max_edits=0, keep=["doc_id"])
    assert exact.agg(F.sum("n_near")).first()[0] == 0


def test_line_dedup_near_short(spark):
    """One edit in a line of five code points or more, against brute force."""
    rng = random.Random(11)
    rows = [(i, "\n".join("".join(rng.choice("abc 日") for _ in range(rng.choice([3, 4, 5, 5, 6, 7, 9, 12]))) for _ in range(6)), "s") for i in range(90)]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows), C("doc_id"), C("text"), keep=["doc_id"]).collect()}
    assert {i: r.kept_text for i, r in found.items()} == _dedup_by_force([(i, t) for i, t, _ in rows])
    assert sum(r.n_near for r in found.values()) > 20
    longer = line_dedup.dedup_lines(docs(spark, [(1, "The anhely eran.", "s"), (2, "The, anhely eran.", "s")]), C("doc_id"), C("text"), near_chars=20)
    assert longer.agg(F.sum("n_near")).first()[0] == 0


def test_line_dedup_edges(spark):
    out = line_dedup.dedup_lines(docs(spark, EDGE), C("doc_id"), C("text"))
    assert out.count() == len(EDGE) and {"_row", "h1", "k"} <= set(out.columns)
    kept = sorted((r.doc_id, r.kept_text) for r in out.collect() if r.doc_id and r.doc_id > 4)
    # rows with equal ids are one document; the line's other document loses it
    assert kept == [(5, "one two three"), (5, "one two three"), (6, ""), (7, EDGE[-1][1])]
    assert line_dedup.dedup_lines(docs(spark, []), C("doc_id"), C("text")).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs(spark, []), C("doc_id"), C("text"), max_edits=2)


def test_line_dedup_short_lines(spark):
    rows = docs(spark, [(1, "Les.\n\nAnd ornd.\n}", "s"), (2, "Les.\n\nWh the.\n }\n日\n日", "s"), (3, "les.\n \nAnd ornd.", "s")])
    got = {r.doc_id: (r.n_equal, r.n_near, r.kept_text) for r in line_dedup.dedup_lines(rows, C("doc_id"), C("text")).collect()}
    assert got == {1: (0, 0, "Les.\n\nAnd ornd.\n}"), 2: (3, 0, "\nWh the.\n日"), 3: (1, 0, "les.\n ")}
    longer = line_dedup.dedup_lines(rows, C("doc_id"), C("text"), min_chars=9)
    assert {r.doc_id: r.n_equal for r in longer.collect()} == {1: 0, 2: 0, 3: 1}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(rows, C("doc_id"), C("text"), min_chars=0)


def test_line_dedup_texts_under_one_id(spark):
    texts = ["alpha is a line of its own\nthe second line says this", "beta is a line of its own, too\nanother second line is here",
             "the second line says this\nand gamma has a line as well"]
    for key in (None, 7):
        rows = docs(spark, [(key, t, "s") for t in [*texts, texts[1]]])
        got = [r.kept_text for r in line_dedup.dedup_lines(rows, C("doc_id"), C("text")).collect()]
        # one of the two places of the repeated line goes, by the order of the texts' hashes; the repeated row loses nothing
        assert len(got) == 4 and got.count(texts[1]) == 2
        assert sum(t.count("the second line says this") for t in got) == 1
        assert sum("alpha" in t for t in got) == sum("gamma" in t for t in got) == 1


# 2 byte-level BPE

def test_bpe_round_trip(spark):
    d = docs(spark, EDGE)
    enc = bpe.encode_texts(d, "text", *ranks(), offsets=True)
    assert "text" not in enc.columns and enc.schema["ids"].dataType.simpleString() == "array<int>"
    back = bpe.decode_ids(enc.drop("offsets").withColumnRenamed("ids", "tokens"), "tokens", *ranks())
    want = sorted(t or "" for _, t, _ in EDGE)
    assert sorted(r.text for r in back.collect()) == want and sorted(bytes(r.bytes).decode() for r in back.collect()) == want
    row = next(r for r in enc.collect() if r.doc_id == 7)
    ends = [o.end for o in row.offsets]
    # offsets cover the text in order; a character split over tokens belongs to the first
    assert ends == sorted(ends) and ends[-1] == len(EDGE[-1][1]) and len(row.offsets) == len(row.ids)
    assert all(a.end == b.start for a, b in zip(row.offsets, row.offsets[1:]))
    assert bpe.encode_texts(docs(spark, []), "text", *ranks()).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode_ids(nulls, "ids", *ranks()).first()["bytes"]) == b""


def test_bpe_like_tiktoken():
    import base64

    import tiktoken

    path, pattern = ranks()
    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    own, rng = bpe.tokenizer(path, pattern), random.Random(7)
    parts = ["a", "th", "é", "ß", " ", "  ", "\n", "\u0085", "日本", "😀", "1", "²", "'s", "'S", "ſ", "!!", "́", "\x1c", "​", "#", "'", "<|endoftext|>"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert own.encode(s).tolist() == ref.encode_ordinary(s) and own.decode(own.encode(s)) == s.encode()


# 3 URL filters

def test_url_prefixes_case_and_clashes(spark):
    """Deep prefixes, patterns in any case, very long paths, kept columns named like results."""
    import datetime as dt

    day = dt.date(2024, 1, 5)
    long = "http://long.example.com/" + "/".join("s" for _ in range(30_000))
    urls = [(1, "http://Example.com/de/private/x?q=/a"), (2, "http://example.com/de/privat"), (3, "http://example.com/DE/private"), (4, "https://a.b.example.org/"),
            (5, long), (6, None), (7, "relative/path"), (8, "http://h.example.net:80/a"), (9, "http://example.com/de/private/")]
    pages = spark.createDataFrame([(i, u, day, "h", 3, True, "r") for i, u in urls],
                                  "page_id long, url string, day date, host string, matches int, blocked boolean, _row string")
    entries = spark.createDataFrame(
        [("block", "prefix", "EXAMPLE.com/de/private/", "add", day), ("allow", "prefix", "example.com/de/private/x", "add", day),
         ("block", "domain", ".Example.ORG", "add", day), ("block", "host", "H.example.net", "add", day), ("block", "prefix", "long.example.com/s/s", "add", day),
         ("block", "domain", None, "add", day)], "list string, kind string, pattern string, action string, day date")
    out = url_filter.filter_urls(pages, C("url"), C("day"), entries)
    assert out.columns == ["page_id", "url", "day", "_row", "host", "fetched_on", "matches", "blocked", "decided_by"]
    got = {r.page_id: (r.matches, r.blocked, r.decided_by) for r in out.collect()}
    none = (0, False, None)
    assert got == {1: (2, False, "allow:prefix:example.com/de/private/x"), 2: none, 3: none, 4: (1, True, "block:domain:example.org"),
                   5: (1, True, "block:prefix:long.example.com/s/s"), 6: none, 7: none, 8: (1, True, "block:host:h.example.net"),
                   9: (1, True, "block:prefix:example.com/de/private")}


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.b.example.com/de/1", "2024-01-05"), (1, "http://a.b.example.com/de/1", "2024-01-05"), (2, "https://U:p@B.example.com:80/x", "2024-03-01"),
         (3, None, "2024-01-05"), (4, "/relative", "2024-01-05"), (5, "http://a.b.example.com/", None), (6, "http://a.b.example.com/en", "2024-02-01"),
         (7, "http://a.b.example.com/en", "2024-02-02")], "page_id long, url string, day string").withColumn("day", C("day").cast("date"))
    entries = [("block", "domain", "example.com", "add", "2024-01-01"), ("block", "domain", "example.com", "add", "2024-01-02"),
               ("block", "domain", "example.com", "remove", "2024-02-02"), ("block", "domain", "b.example.com", "remove", "2024-01-01"),
               ("allow", "prefix", "a.b.example.com/de", "add", "2024-01-05"), ("allow", "prefix", "a.b.example.com/de", "remove", "2024-01-06"),
               ("block", "host", "a.b.example.com", "add", "2024-01-09"), ("block", "host", "a.b.example.com", "remove", "2024-01-09"),
               ("block", "host", None, "add", "2024-01-01")]
    entries = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, day string").withColumn("day", C("day").cast("date"))
    out = url_filter.filter_urls(pages, C("url"), C("day"), entries, ["page_id", "url"]).collect()
    assert sorted((r.page_id, r.matches, r.blocked, r.decided_by) for r in out) == sorted([
        (1, 2, False, "allow:prefix:a.b.example.com/de"), (1, 2, False, "allow:prefix:a.b.example.com/de"), (2, 0, False, None), (3, 0, False, None),
        (4, 0, False, None), (5, 0, False, None), (6, 1, True, "block:domain:example.com"), (7, 0, False, None)], key=lambda r: (r[0], r[1]))
    assert [r.host for r in out if r.page_id == 2] == ["b.example.com"]
    assert url_filter.filter_urls(pages.limit(0), C("url"), C("day"), entries, ["page_id"]).count() == 0
    none = url_filter.filter_urls(pages, C("url"), C("day"), entries.limit(0), ["page_id"])
    assert none.count() == 8 and none.where("blocked or matches > 0").count() == 0


# 4 decontamination

def _leaks_by_force(rows, items, percent=80):
    cut = lambda t: re.sub(r"[!-/:-@\[-`{-~ \t-\r]+", " ", t or "").lower().split()
    bag = lambda w: Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    weight = lambda g: sum(len(x.encode()) for x in g)
    out = {}
    for item, text in items:
        w, size = cut(text), len(cut(text))
        if not w:
            continue
        b = bag(w)
        for doc, other in rows:
            v = cut(other)
            n = min(size, len(v))
            if not v or not b.keys() & bag(v).keys() and n >= 5:
                continue
            for s in range(len(v) - n + 1) if v else ():
                c = bag(v[s:s + n])
                shared = sum(min(c[g], k) * weight(g) for g, k in b.items())
                whole = sum(k * weight(g) for bag_ in (b, c) for g, k in bag_.items()) - shared
                if 100 * shared >= percent * whole:
                    out[doc, item] = max(out.get((doc, item), 0), shared / whole)
    return out


def test_decontaminate(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(6, 60)))) for i in range(25)] + [(30, None), (31, " "), (32, "just three words"), (33, "ab ab ab ab ab ab ab ab ab")]
    items.append((34, items[0][1]))  # an item twice
    rows = []
    for i in range(120):
        w = say(rng.randint(0, 120))
        if rng.random() < 0.7:
            p = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if p:
                    k = rng.choice([0, -1, rng.randrange(len(p))])
                    p[k] = rng.choice([p[k].upper() + ",", "zzz"])
            at = rng.randint(0, len(w))
            w[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(500, None), (501, ""), (502, "Just, three: WORDS!"), (503, LONG + " " + items[3][1])]
    d = docs(spark, [(i, t, "s") for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(d, "doc_id", "text", bench).collect()}
    want = _leaks_by_force([r for r in rows if r[0] != 503], items) | _leaks_by_force([(503, items[3][1])], items)
    assert {k: round(r.similarity, 9) for k, r in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 40 and any(v < 1 for v in want.values())
    r = got[503, 3]
    assert dict(rows)[503][r.start:r.end] == items[3][1]
    kept = decontaminate.drop_leaks(d, "text", bench)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {k for k, _ in want}
    blocks = decontaminate.find_leaks(d, "doc_id", "text", bench, block_bytes=500)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(want)
    assert decontaminate.find_leaks(d.limit(0), "doc_id", "text", bench).count() == 0
    assert decontaminate.drop_leaks(d, "text", bench.limit(0)).count() == d.count()


# 5 license scans

def test_license_scan(spark):
    mit = license_scan.TEMPLATES[3].notice
    words = mit.split()
    rows = [(1, f"x {mit.upper()} y", "s"), (2, "intro " * 300 + " ".join(words[:-3]), "s"), (3, " ".join(words[:8]), "s"), (4, None, "s"),
            (5, "", "s"), (6, "All rights\nreserved. " * 2, "s"), (6, "All rights\nreserved. " * 2, "s"), (7, LONG + " " + mit, "s")]
    out = {(r.doc_id, r.license): r for r in license_scan.find_licenses(docs(spark, rows), C("doc_id"), C("text")).collect()}
    assert set(out) == {(1, "MIT"), (2, "MIT"), (6, "all-rights-reserved"), (7, "MIT")}
    assert (out[1, "MIT"].start_word, out[1, "MIT"].end_word, out[1, "MIT"].containment) == (1, 1 + len(words), 1.0)
    assert 0.8 <= out[2, "MIT"].containment < 1 and out[6, "all-rights-reserved"].start_word == 0
    assert license_scan.find_licenses(docs(spark, []), C("doc_id"), C("text")).count() == 0


# 6 secret scans

def test_trigram_queries():
    q = secret_scan.trigram_query(r"(?i:secret|api_?key)[:=]x+")
    assert q == [[sorted({"api", "pi_", "i_k", "_ke", "key", "ey:"}), sorted({"api", "pi_", "i_k", "_ke", "key", "ey="}),
                  sorted({"api", "pik", "ike", "key", "ey:"}), sorted({"api", "pik", "ike", "key", "ey="}),
                  sorted({"sec", "ecr", "cre", "ret", "et:"}), sorted({"sec", "ecr", "cre", "ret", "et="})]]
    assert secret_scan.trigram_query("[0-9a-f]{32,}") == [] and secret_scan.trigram_query("ab|abcd") == []


def test_secret_scan(spark):
    rng = random.Random(5)
    parts = ["password", "passwd=", "SECRET", "token", "api_key", "apikey", ": ", "=", '"', "'", " ", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGHIJKL",
             "é", "😀", "\n", "-", "x", "ghp_" + "a" * 36, "AIza" + "B" * 35, "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh.eyJabcdefgh.x"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "s") for i in range(400)]
    rows += [(900, None, "s"), (901, "", "s"), (902, LONG + " token: 12345678", "s"), (903, "secret: token:abcdefghij", "s")] + [(904, "token=abcdefghi", "s")] * 2
    got = secret_scan.scan_secrets(docs(spark, rows), C("text"), keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    for r in got:
        want = sorted((m.start(), k, m.end(), rule.kind) for k, rule in enumerate(secret_scan.RULES) for m in re.finditer(rule.pattern, text[r.doc_id])
                      if len(m.group(rule.value)) >= rule.least)
        assert [tuple(s) for s in r.spans] == want, r.doc_id
    assert secret_scan.scan_secrets(docs(spark, []), C("text")).count() == 0


# 7 sharding

def test_sharding(spark, tmp_path):
    rows = [*EDGE, *[(9, "same", "s")] * 500]
    out = sharding.shard_rows(docs(spark, rows), C("doc_id"), C("text"), shards=7, bucket_bytes=4096)
    got = out.collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 7
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _, _ in rows)
    assert next(r for r in got if r.doc_id == 1)["size"] == 16 and next(r for r in got if r.doc_id == 1).text_crc32 == 0
    sharding.write_shards(out.drop("_row", "_text"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert sharding.shard_rows(docs(spark, []), C("doc_id"), C("text")).count() == 0
    few = sharding.shard_rows(docs(spark, EDGE[:2]), C("doc_id"), C("text")).collect()
    assert len({r.shard for r in few}) == 2 and {r.slot for r in few} == {0}
    with pytest.raises(ValueError):
        sharding.shard_rows(docs(spark, []), C("doc_id"), C("text"), shards=0)


def test_shuffle_is_uniform(spark):
    """Every place is about as likely for every record."""
    d = spark.range(4000).select(C("id").alias("doc_id"), F.lit("t").alias("text"))
    r = sharding.shard_rows(d, C("doc_id"), C("text"), shards=2, bucket_bytes=2000).toPandas().sort_values(["shard", "slot"])
    import numpy as np

    assert abs(np.corrcoef(np.arange(4000), r.doc_id.astype(float))[0, 1]) < 0.07


# 8 quality rules

def test_quality_rules(spark):
    good = "This is a plain sentence with quite a few different words in it, number {}."
    rows = [(i, good.format(i), "good") for i in range(300)] + [(1000, "#$%& " * 30 + good, "good")]
    rows += [(2000 + i, (good.format(i) + " " + "### " * 20) if i % 4 else good.format(i), "bad") for i in range(100)]
    rows += [(3000 + i, "### " * 10 + good.format(i), "worst") for i in range(60)] + [(3100, good, "worst")]
    rows += [(4000, "a b c d e f g h " * 3, "good"), (4001, "one two", "good"), (4002, None, None), (4003, LONG, None), (4003, LONG, None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows), C("text"), C("source")).collect()}
    assert len(got) == len({i for i, _, _ in rows})
    assert all(got[i].kept for i in range(300)), "clean documents stay"
    assert got[1000].failed_rules == ["symbols"] or "symbols" in got[1000].failed_rules
    assert not got[2001].kept and got[2000].kept, "a habit of the host takes effect on those that have it"
    assert got[3100].host_blocked is False or not got[3100].kept
    assert got[4000].n_repeat_words == 24 and not got[4000].kept and got[4001].base_failed and got[4002].n_words == 0 and not got[4002].kept
    assert got[4000].n_words == 24 and got[4000].word_chars == 24
    assert quality_rules.quality_rules(docs(spark, []), C("text"), C("source")).count() == 0


def test_quality_measures_by_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c ", "\n", "#", "é ", "\x0b", "x", "a b c\n"]) for _ in range(rng.randint(0, 80))), "s") for i in range(200)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows), C("text"), C("source")).collect()}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        n = Counter(g)
        cover = {k + j for k, x in enumerate(g) if n[x] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)), t


# 9 chat formatting

def test_chat(spark):
    nasty = ["<|im_end|>", "<", "<|", "<||im_start|>x", "|>", "a\n<|n", "", None, "<|<||<|||", "<|im_end|>\n<|im_start|>user\nhi"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "x"), (2, 1, "user", "y"), (3, 0, None, "r"), (3, 1, "ro\nle<|n<|im_end|>", "q"), (4, 0, "system", "s"), (4, 1, "user", "u"),
             (4, 2, "assistant", LONG), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, None, "user", "n")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(d, C("conv_id"), C("turn"), C("role"), C("text"))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in sorted(turns)]
        assert back[c].losses == [x for _, r, x in sorted(turns) if r == "assistant"]
    assert back[1].valid and back[4].valid and not back[2].valid and back[2].bad_turn == 0 and back[5].bad_turn == 1 and not back[None].valid
    one = out.where("conv_id = 4").first()
    assert "".join(s.text for s in one.segments) == one.formatted and [s.loss for s in one.segments] == [False] * 7 + [True, False]
    assert chat.format_chats(d.limit(0), C("conv_id"), C("turn"), C("role"), C("text")).count() == 0
    with pytest.raises(ValueError):
        chat.Template(start="im_start")


# 10 n-gram join

def _components_by_force(rows, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("cell", [1 << 18, 300])
def test_ngram_join(spark, cell):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)] + ["the", "of", "Und"] * 30
    bases = [[rng.choice(vocab) for _ in range(rng.randint(1, 90))] for _ in range(60)]
    shared = [rng.choice(vocab) for _ in range(30)]  # a passage that many have
    rows = []
    for i in range(320):
        w = list(rng.choice(bases[:8] if rng.random() < 0.5 else bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(w))
            w[k:k + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
        if rng.random() < 0.3:
            w += shared
        rows.append((i, " ".join(w) if rng.random() < 0.5 else "\n".join(x.upper() for x in w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two three"), (1004, "ONE Two  three"), (1005, "one two"), (1006, LONG), (1007, LONG + " x")]
    d = docs(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(d, "doc_id", "text", cell_shingles=cell).collect()}
    want = _components_by_force(rows)
    assert got == want
    sizes = Counter(c for _, c in want.values())
    assert max(sizes.values()) > 10 and sum(1 for n in sizes.values() if n == 1) > 20


def test_ngram_join_edges(spark):
    got = sorted(ngram_join.jaccard_components(docs(spark, EDGE), "doc_id", "text").collect(), key=lambda r: r.doc_id or 0)
    assert len(got) == len(EDGE) and got[0].component_id is None
    assert [r.component_id for r in got if r.doc_id in (5, 6)] == [5, 5, 5]
    assert ngram_join.jaccard_components(docs(spark, []), "doc_id", "text").count() == 0


@pytest.mark.parametrize(("n", "percent"), [(1, 70), (5, 80)])
def test_ngram_join_other_figures(spark, n, percent):
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 90))] for _ in range(30)]
    rows = []
    for i in range(200):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
        rows.append((i, " ".join(w)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}
    want = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if want[a] != want[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = {i: new if c == old else c for i, c in want.items()}
    d = docs(spark, [(i, t, "s") for i, t in rows])
    got = ngram_join.jaccard_components(d, "doc_id", "text", percent=percent, n=n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert 30 < len(set(want.values())) < 150


def test_components(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in chain:
        if a is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up if find(x) != x}


def test_sharding_query_moves_whole_documents(spark, monkeypatch):
    """The query writes every column of the documents, in slot order, and reads its digests back."""
    import zlib

    from shoptally.llm.queries import QUERIES

    paths = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda df, path: paths.append(path) or write(df, path))
    source = {r.doc_id: r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op7_sharding"](spark, "/root/testdata/sf0.001").collect()}
    kept = spark.read.parquet(paths[0]).collect()
    assert len(kept) == len(source) == len(rows)
    for k in kept:
        assert {c: k[c] for c in source[k.doc_id]} == source[k.doc_id]
        r, text = rows[k.doc_id], (k.text or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.slot) == (len(text) + 16, zlib.crc32(text), k.shard, k.slot)
