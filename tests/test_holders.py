"""Values that one holder at a time may have, against a loop over the calls."""

import random

import pytest

from shoptally.functions import holders
from shoptally.functions.holders import decide_claims
from shoptally.functions.ranking import next_ids

REQUESTS = "request_id long, holder long, value string, effect boolean"
HELD = "holder long, value string"


def by_force(requests, held):
    has, out = dict(held), {}
    for q, h, v, effect in sorted(requests):
        out[q] = v is not None and any(o != h and x == v for o, x in has.items())
        if effect and not out[q]:
            has[h] = v
    return out


def decided(spark, requests, held, rows):
    got = decide_claims(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(held, HELD), rows).collect()
    assert len(got) == len(requests)
    return {r.request_id: r.refused for r in got}


@pytest.mark.parametrize(("rows", "values"), [(40, 6), (40, 60), (10**6, 20)])
def test_claims_match_the_loop(spark, rows, values):
    """From the timelines, components side by side, or all in one pass: the same
    answers. Values that several have at first, given up, asked again, only looked up."""
    rng = random.Random(rows + values)
    held = [(h, rng.choice([None, f"v{rng.randrange(values)}", f"own{h}"])) for h in range(30)]
    requests = [(q * 40_000, rng.randrange(40), rng.choice([None, *[f"v{rng.randrange(values)}"] * 5, f"new{q}"]), rng.random() < 0.8) for q in range(150)]
    want = by_force(requests, held)
    assert decided(spark, requests, held, rows) == want
    assert 10 < sum(want.values()) < 140


def test_hot_value_and_hot_holder(spark, monkeypatch):
    """A third asks for one value, a third is of one holder: two rounds decide
    them although no pass holds either."""
    requests = [(3 * q, q + 10, "hot", True) for q in range(120)] + [(3 * q + 1, 1, f"v{q}", True) for q in range(120)]
    requests += [(3 * q + 2, q + 1000, f"v{q}", True) for q in range(120)]
    written = []
    write = holders.materialize
    monkeypatch.setattr(holders, "materialize", lambda df, name: written.append(name) or write(df, name))
    held = [(5, "hot"), (6, "v3"), (7, "v3")]
    assert decided(spark, requests, held, 100) == by_force(requests, held)
    assert written.count("timeline") <= 2


def test_chain_of_values(spark):
    """Every holder takes what the one before it gives up: a chain of 100."""
    held = [(h, f"v{h}") for h in range(100)]
    requests = [(0, 99, "free", True)] + [(100 - h, h, f"v{h + 1}", True) for h in range(98, -1, -1)]
    assert not any(decided(spark, requests, held, 10**6).values())
    back = [(h, h, f"v{h + 1}", True) for h in range(99)]
    assert all(decided(spark, back, held, 10**6).values())


def test_nothing_held_or_asked(spark):
    assert decided(spark, [], [], 10) == {}
    assert decided(spark, [], [(1, "a"), (2, "a")], 10) == {}
    assert decided(spark, [(1, 1, None, True), (2, 1, "a", False), (3, 2, "a", True), (4, 1, "a", True)], [], 10) == {1: False, 2: False, 3: False, 4: True}


def test_next_ids_across_blocks(spark):
    rng = random.Random(4)
    data = [(g, i, rng.random() < 0.4) for g in ("a", "b") for i in rng.sample(range(-50, 50), 40)]
    df = spark.createDataFrame(data, "g string, i long, f boolean")
    from pyspark.sql import functions as F

    got = {(r.g, r.i): (r.flagged, r.any) for r in next_ids(df, ["g"], "i", {"flagged": F.col("f"), "any": F.lit(True)}, block=8).collect()}
    want = {(g, i): tuple(min((j for h, j, f in data if h == g and j > i and (f or every)), default=None) for every in (False, True)) for g, i, _ in data}
    assert got == want


def test_serial_numbers_given_up_in_a_batch(spark):
    """A number is free again once its serial has another; sold serials keep
    theirs; a rejected request changes nothing."""
    from types import SimpleNamespace

    from shoptally.operators import posting

    t = SimpleNamespace(product_serials=spark.createDataFrame([(1, "X", 0), (2, None, 0), (3, "S", 1), (4, "D", 0), (5, "D", 0)], "serial_id long, serial_number string, status int"))
    asks = [(1, 1, " Y ", None), (2, 2, "X", None), (3, 1, "Z", None), (4, 2, "Y", None), (5, 1, "X", -1), (6, 1, "Y", -1), (7, 2, "S", None), (8, 3, "Y", None),
            (9, 4, "D", None), (10, 5, " ", None), (11, 4, "D", None), (12, 9, "Q", None), (13, 2, "W", -5), (14, 1, "Y", None)]
    df = spark.createDataFrame(asks, "request_id long, serial_id long, serial_number string, sell_price_override long")
    df = df.selectExpr("*", "' Red ' product_color", "'' note")
    got = {r.request_id: r.outcome for r in posting.serial_update_validate(t, df).collect()}
    assert got == {1: "updated", 2: "updated", 3: "updated", 4: "updated", 5: "invalid_price", 6: "duplicate_serial", 7: "duplicate_serial", 8: "sold",
                   9: "duplicate_serial", 10: "updated", 11: "updated", 12: "not_found", 13: "invalid_price", 14: "duplicate_serial"}
    got = {r.request_id: r.outcome for r in posting.serial_set_number(t, df.where("request_id not in (5, 6, 13)")).collect()}
    assert got == {1: "updated", 2: "updated", 3: "updated", 4: "updated", 7: "duplicate_serial", 8: "duplicate_serial", 9: "duplicate_serial",
                   10: "missing_serial", 11: "duplicate_serial", 12: "not_found", 14: "duplicate_serial"}
