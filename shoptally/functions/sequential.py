"""Requests that use up shared resources, decided as if called one by one.

``decide`` answers for every request whether it is accepted, given that
requests take effect in id order and each must find enough left of everything
it needs. Only resources that the requests together could exhaust depend on
that order. Requests and such resources form a graph; requests in different
connected components can't touch each other, so every component is replayed in
one ordered streaming pass, components side by side. A component too large for
one pass is thinned first: requests that fit even if all undecided earlier ones
are accepted, or that fail with the accepted ones alone, are decided by running
sums (several tasks for one hot resource), they leave, resources with enough
for all that remain go with them, and what is left is cut into components anew.

The number of jobs grows with the logarithm of a component's diameter, and with
the rounds that a too large component needs, not with the longest chain of
requests that wait for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_lean as materialize
from ..session import release
from .ranking import running_sums_by_id

REPLAY_ROWS = 1_000_000
"""Rows of one component that one pass replays (a few seconds; it holds what is left of each resource, not the rows)."""

_C = F.col


CONTRACTIONS = 4
"""Rounds that contract the graph before labels spread through what is left of it."""


def components(edges: DataFrame, node: str, via: str) -> DataFrame:
    """(node, component): nodes that share ``via`` values, directly or through
    others; the component is its smallest node.

    The graph is contracted first: each shared value becomes its least node,
    and the nodes become the values that tie these. A round's edges are
    distinct and those of values with a single node are dropped, so dense
    graphs shrink fast and every round reads only what the last one left. In
    what remains (long chains) labels spread through the shared values and jump
    to their label's label, which doubles the distance covered in each round.
    Edges, values and labels of each round are written, so a round's job reads
    files only; they go when the next round has read them."""
    left = edges = materialize(edges.select(_C(node).alias("_n"), _C(via).alias("_v")).distinct(), "edges")
    parents: list[DataFrame] = []
    read = [edges]
    for _ in range(CONTRACTIONS):
        low = left.groupBy("_v").agg(F.min("_n").alias("_l"), (F.max("_n") != F.min("_n")).alias("_many"))
        # the first round's values are those of ``edges``, which no label has: only the join reads them
        low = materialize(low if parents else low.where("_many"), "low")
        read.append(low)
        parents.append(low.select(_C("_v").alias("_l"), _C("_l").alias("_p")))
        done, left = left, left.join(low.where("_many").select("_v", "_l"), "_v").select(_C("_l").alias("_n"), _C("_n").alias("_v")).distinct()
        left = materialize(left, "edges")
        if done is not edges:
            release(done)
        else:
            release(read.pop())
        if left.isEmpty():
            break
    else:
        parents.append(left.groupBy("_v").agg(F.min("_n").alias("_p")).withColumnRenamed("_v", "_l"))
        spread = _spread(left)
        read.append(spread)
        parents.append(spread.select(_C("_n").alias("_l"), _C("_l").alias("_p")))
    labels = edges.select("_n").distinct().withColumn("_l", _C("_n"))
    for up in parents[1:]:  # the first one's values are no nodes
        labels = labels.join(up, "_l", "left").select("_n", F.coalesce("_p", "_l").alias("_l"))
    labels = materialize(labels.select(_C("_n").alias(node), _C("_l").alias("component")), "parts")
    release(*read, left)
    return labels


def _spread(edges: DataFrame) -> DataFrame:
    """(_n, _l): the least node that each can reach, written."""
    labels = edges.groupBy("_n").agg(F.min("_n").alias("_l"))
    while True:
        low = edges.join(labels, "_n").groupBy("_v").agg(F.min("_l").alias("_l"))
        near = edges.join(low, "_v").groupBy("_n").agg(F.min("_l").alias("_m"))
        jump = near.select(_C("_n").alias("_m"), _C("_m").alias("_j"))
        new = (labels.join(near, "_n").join(jump, "_m", "left")
               .select("_n", F.least("_m", F.coalesce("_j", "_m")).alias("_new"), _C("_l").alias("_old")))
        new = materialize(new.select("_n", _C("_new").alias("_l"), (_C("_new") != _C("_old")).alias("_moved")), "labels")
        release(labels)
        labels = new
        if new.where("_moved").isEmpty():
            return labels


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (component, request_id, state, code, rid, need, used, cap, once) in
    the order of (component, request_id, code): what is left of a component's
    resources and the ``once`` values taken are all that is held."""
    component, request = None, None
    left: dict[tuple, int] = {}
    taken: set[str] = set()
    rows: list[tuple] = []
    out: list[tuple] = []

    def end() -> None:
        if request is None:
            return
        state, why = request[1], None
        once = next((r[5] for r in rows if r[0] == 0 and isinstance(r[5], str)), None)
        for code, rid, _, _, cap, _ in rows:
            if code:
                left.setdefault((code, rid), cap)
        if state == "U":
            fails = [r[0] for r in rows if r[0] and r[2] > left[r[0], r[1]]]
            state, why = ("E", None) if once in taken else ("R", min(fails)) if fails else ("A", None)
            out.append((request[0], state, why))
        if state == "A":
            for code, rid, _, used, _, _ in rows:
                if code:
                    left[code, rid] -= used
            if once is not None:
                taken.add(once)

    for pdf in batches:
        for c, q, state, *rest in zip(*(pdf[k] for k in ("component", "request_id", "state", "code", *_NUMBERS, "once")), strict=True):
            if request != (q, state) or c != component:
                end()
                rows.clear()
                if c != component:
                    component = c
                    left.clear()
                    taken.clear()
                request = (q, state)
            rows.append(tuple(rest))
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["request_id", "state", "why"])
            out.clear()
    end()
    yield pd.DataFrame(out, columns=["request_id", "state", "why"])


_NUMBERS = ("rid", "need", "used", "cap")


def _rows_of(state: DataFrame, demands: DataFrame) -> DataFrame:
    """What a replay reads of each undecided or accepted request: its demands,
    and a row with code 0 for a ``once`` value that others have too."""
    live = state.where(_C("state").isin("A", "U"))
    d = demands.join(live.select("request_id", "state"), "request_id").withColumn("once", F.lit(None).cast("string"))
    head = live.select("request_id", "state", F.lit(0).alias("code"), *[F.lit(0).cast("long").alias(c) for c in _NUMBERS], "once")
    return d.select("request_id", "state", "code", *[_C(c).cast("long").alias(c) for c in _NUMBERS], "once").unionByName(head)


def _bracket(state: DataFrame, demands: DataFrame) -> DataFrame:
    """One round by running sums. Undecided requests (U) that pass even if
    every earlier undecided one is accepted are accepted (A); those that fail
    with the accepted ones alone are rejected (R); those whose ``once`` an
    accepted earlier one has are existing (E). A request waits for earlier
    undecided ones with its ``once``. The first undecided request of a
    component is always decided."""
    live = demands.join(state.where(_C("state").isin("A", "U")).select("request_id", "state"), "request_id")
    sums = running_sums_by_id(live, ["code", "rid"], "request_id", {"most": _C("used"), "least": F.when(_C("state") == "A", _C("used"))})
    fits = sums.groupBy("request_id").agg(
        F.min((_C("need") + _C("most") <= _C("cap")).cast("int")).alias("sure"),
        F.min((_C("need") + _C("least") <= _C("cap")).cast("int")).alias("maybe"))
    codes = state.where("once IS NOT NULL").groupBy("once").agg(
        F.min(F.when(_C("state") == "A", _C("request_id"))).alias("posted"), F.min(F.when(_C("state") == "U", _C("request_id"))).alias("next"))
    j = state.join(fits, "request_id", "left").join(codes, "once", "left")
    new = (F.when(_C("state") != "U", _C("state")).when(_C("posted") < _C("request_id"), "E").when(_C("next") < _C("request_id"), "U")
           .when(F.coalesce("maybe", F.lit(1)) == 0, "R").when(F.coalesce("sure", F.lit(1)) == 1, "A").otherwise("U"))
    return j.select("request_id", "once", new.alias("state"))


def _open(state: DataFrame, demands: DataFrame) -> DataFrame:
    """The demands on resources that undecided requests touch and that the
    undecided and accepted ones together could exhaust."""
    d = demands.join(state.where(_C("state").isin("A", "U")).select("request_id", "state"), "request_id")
    scarce = d.groupBy("code", "rid").agg(F.sum("used").alias("all"), F.max((_C("state") == "U").cast("int")).alias("u"), F.min("cap").alias("most"))
    return demands.join(scarce.where((_C("all") > _C("most")) & (_C("u") == 1)).select("code", "rid"), ["code", "rid"], "left_semi")


def decide(requests: DataFrame, demands: DataFrame, replay_rows: int = REPLAY_ROWS) -> DataFrame:
    """(request_id, state, why) of every request: accepted (A), existing (E, an
    accepted earlier one has its ``once`` value) or rejected (R, ``why`` is the
    least code of a resource without enough left).

    ``requests``: request_id (unique, integral, the order), once (NULL: never
    existing). ``demands``: request_id, code (> 0), rid, need (what must be
    left), used (what an accepted request takes, at least ``need``), cap (what
    there is at first, one value a resource); integers."""
    state = materialize(requests.select("request_id", _C("once").cast("string").alias("once"), F.lit("U").alias("state")), "requests")
    every = demands = materialize(_open(state, demands), "demands")
    found: list[DataFrame] = []
    thinned = False
    while True:
        rows = _rows_of(state, demands)
        if state.count() + demands.count() <= replay_rows:  # all at once, as one component
            found.append(_replayed(rows.withColumn("component", F.lit(0).cast("long"))))
            break
        shared = rows.where("code = 0 AND once IS NOT NULL").groupBy("once").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("once")
        touched = rows.where("code > 0").select("request_id").unionByName(rows.join(shared, "once").select("request_id")).distinct()
        touched = materialize(touched, "touched")
        alone = state.where("state = 'U'").join(touched, "request_id", "left_anti")
        found.append(materialize(alone.select("request_id", F.lit("A").alias("state"), F.lit(None).cast("int").alias("why")), "alone"))
        rows = materialize(rows.join(touched, "request_id", "left_semi"), "replay")
        release(touched)
        if rows.isEmpty():
            break
        replay = rows
        via = F.when(_C("code") == 0, F.concat(F.lit("0:"), "once")).otherwise(F.concat_ws(":", "code", "rid"))
        rows = rows.withColumn("via", F.coalesce(via, F.concat(F.lit("-:"), _C("request_id").cast("string"))))
        parts = components(rows.where("state = 'U'"), "request_id", "via")
        of_via = rows.where("state = 'U'").join(parts, "request_id").groupBy("via").agg(F.min("component").alias("component"))
        rows = rows.join(of_via, "via")  # an accepted request is told to each component whose resources it used
        rows = materialize(rows.drop("via"), "components")
        release(replay, parts)
        sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        large = materialize(sizes.where(_C("n") > replay_rows).select("component"), "large")
        if large.isEmpty():
            found.append(materialize(_replayed(rows), "replayed"))
            release(rows)
            break
        found.append(materialize(_replayed(rows.join(large, "component", "left_anti")), "replayed"))
        thinned = True
        ids = materialize(rows.join(large, "component", "left_semi").select("request_id").distinct(), "large-ids")
        release(rows)
        before, state = state, _bracket(state.join(ids, "request_id", "left_semi"), demands.join(ids, "request_id", "left_semi"))
        state = materialize(state, "state")
        release(before, ids)
        # an accepted request stays for those before which it counts, and is reported once
        found.append(materialize(state.where("state <> 'U'").select("request_id", "state", F.lit(None).cast("int").alias("why")), "settled"))
        before, demands = demands, materialize(_open(state, demands), "demands")
        if before is not every:
            release(before)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if not thinned:
        decided = materialize(out, "decided")
        release(state, every, *found)
        return decided
    # of those that running sums rejected: the first check that fails on what the accepted ones before left
    out = materialize(out.groupBy("request_id").agg(F.first("state").alias("state"), F.min("why").alias("why")), "decided")
    done = every.join(out.select("request_id", "state"), "request_id")
    left = running_sums_by_id(done, ["code", "rid"], "request_id", {"least": F.when(_C("state") == "A", _C("used"))})
    why = left.where((_C("state") == "R") & (_C("need") + _C("least") > _C("cap"))).groupBy("request_id").agg(F.min("code").alias("_why"))
    decided = materialize(out.join(why, "request_id", "left").select("request_id", "state", F.coalesce("why", "_why").alias("why")), "decided")
    release(state, every, demands, out, *found)
    return decided


def _replayed(rows: DataFrame) -> DataFrame:
    columns = ["component", "request_id", "state", "code", *_NUMBERS, "once"]
    ordered = rows.select(*columns).repartition("component").sortWithinPartitions("component", "request_id", "code")
    return ordered.mapInPandas(_replay, "request_id long, state string, why int")
