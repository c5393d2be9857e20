"""Requests that use up shared resources, against a loop over the calls."""

import random

import pytest

from shoptally.functions import sequential
from shoptally.functions.sequential import components, decide

REQUESTS = "request_id long, once string"
DEMANDS = "request_id long, code int, rid long, need long, used long, cap long"


def by_force(requests, demands):
    asks = {}
    for q, *d in demands:
        asks.setdefault(q, []).append(d)
    used, taken, out = {}, set(), {}
    for q, once in sorted(requests):
        fails = [c for c, r, need, _, cap in asks.get(q, []) if need > cap - used.get((c, r), 0)]
        if once is not None and once in taken:
            out[q] = ("E", None)
        elif fails:
            out[q] = ("R", min(fails))
        else:
            out[q] = ("A", None)
            taken.add(once)
            for c, r, _, u, _ in asks.get(q, []):
                used[c, r] = used.get((c, r), 0) + u
    return out


def decided(spark, requests, demands, rows):
    got = decide(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(demands, DEMANDS), rows).collect()
    assert len(got) == len(requests)
    return {r.request_id: (r.state, r.why) for r in got}


@pytest.mark.parametrize("rows", [12, 60, 10**6])
def test_decide_matches_the_loop(spark, rows):
    """Components side by side, thinned first, or all in one pass: the same answers."""
    rng = random.Random(rows)
    caps = {(c, r): rng.randint(-2, 14) for c in (51005, 51006, 51007) for r in range(25)}
    requests = [(q * 7, rng.choice([None, None, f"c{q}", f"c{rng.randint(0, 8)}"])) for q in range(120)]
    demands = []
    for q, _ in requests:
        for c, r in rng.sample(sorted(caps), rng.randint(0, 3)):
            used = rng.randint(1, 6)
            demands.append((q, c, r, rng.randint((used + 1) // 2, used), used, caps[c, r]))
    want = by_force(requests, demands)
    assert decided(spark, requests, demands, rows) == want
    assert {s for s, _ in want.values()} == {"A", "R", "E"}


def test_long_chain_takes_few_jobs(spark, monkeypatch):
    """200 requests, each sharing a scarce resource with the next: the frames
    written don't grow with the chain."""
    n = 200
    requests = [(q, None) for q in range(n)]
    demands = [(q, 51006, r, 1, 1, 1) for q in range(n) for r in (q, q + 1)]
    written = []
    write = sequential.materialize
    monkeypatch.setattr(sequential, "materialize", lambda df, name: written.append(name) or write(df, name))
    assert decided(spark, requests, demands, 10**6) == {q: ("R", 51006) if q % 2 else ("A", None) for q in range(n)}
    assert len(written) <= 4
    written.clear()
    assert decided(spark, requests, demands, 700)[n - 1] == ("R", 51006)  # by components
    assert len(written) <= 20


def test_nothing_to_decide(spark):
    assert decided(spark, [], [], 10) == {}
    assert decided(spark, [(1, None), (2, "x"), (3, "x")], [], 10) == {1: ("A", None), 2: ("A", None), 3: ("E", None)}


def test_components(spark):
    edges = [(q, f"v{q}") for q in range(40)] + [(q + 1, f"v{q}") for q in range(20)] + [(30, "v39"), (35, "v30")]
    got = {r.n: r.component for r in components(spark.createDataFrame(edges, "n long, v string"), "n", "v").collect()}
    want = {q: 0 for q in range(21)} | {q: q for q in range(21, 40)} | {35: 30, 39: 30}
    assert got == want
