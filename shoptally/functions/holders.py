"""Values that one holder at a time may have, asked for in id order.

``decide_claims`` answers every request "holder h now has value v" as if the
requests were made one by one: it is refused while another holder has v;
otherwise h has v and gives up what it had, which others may take from then
on. So whether v is free depends on earlier answers, along chains through both
holders and values.

Every claim is an interval on its value's timeline: from its request to the
holder's next accepted one. Most are decided at once: a value that one holder
alone ever names is never refused. Of the rest, requests and the values and
holders that they share form a graph whose connected components can't touch
each other; each is replayed in one ordered streaming pass, components side by
side, all of them in one pass if there are few rows. What is left of a
component too large for a pass is decided from its timelines: a request is
refused if another holder's interval that is open whatever the undecided ones
become covers it, and accepted if no interval that could be open does. Running
sums over the intervals' ends say so, in several tasks for one hot value or one
hot holder; all that wait for one holder of a hot value are decided together.
Rounds go on while each decides half of what is left, so their number grows with
the logarithm of the requests. What then remains are long chains through many
holders: an ordered pass streams over them, and holds what they have at the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_lean as materialize
from ..session import release
from .ranking import next_ids, running_sums_by_id
from .sequential import REPLAY_ROWS, components

START = -(1 << 62)
"""The time of what holders have before the first request."""

FREE, TAKE, ASK, LOOK = range(4)
_ROWS = ["component", "t", "kind", "holder", "value"]
_C = F.col


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (component, t, kind, holder, value) in that order: the answers to
    ASK (which takes effect) and LOOK (which has none). What a component's
    holders have at the time is all that is held."""
    component = None
    holders: dict[str, set[int]] = {}
    has: dict[int, str] = {}

    def take(holder: int, value: str | None) -> None:
        old = has.pop(holder, None)
        if old is not None:
            holders[old].discard(holder)
        if value is not None:
            has[holder] = value
            holders.setdefault(value, set()).add(holder)

    for pdf in batches:
        out: list[tuple] = []
        for c, t, kind, holder, value in zip(*(pdf[k] for k in _ROWS), strict=True):
            if c != component:
                component = c
                holders.clear()
                has.clear()
            if kind == FREE:
                if has.get(holder) == value:
                    take(holder, None)
            elif kind == TAKE:
                take(holder, value)
            else:
                refused = bool(holders.get(value, set()) - {holder})
                out.append((t, refused))
                if kind == ASK and not refused:
                    take(holder, value)
        yield pd.DataFrame(out, columns=["request_id", "refused"])


def _replayed(rows: DataFrame) -> DataFrame:
    ordered = rows.select(*_ROWS).repartition("component").sortWithinPartitions("component", "t", "kind")
    return ordered.mapInPandas(_replay, "request_id long, refused boolean")


def _moves(state: DataFrame, held: DataFrame) -> DataFrame:
    """What changes, or may change (U), what a holder has: t, holder, value, state."""
    live = state.where("effect AND state IN ('A', 'U')").select(_C("request_id").alias("t"), "holder", "value", "state")
    return held.select(F.lit(START).alias("t"), "holder", "value", F.lit("A").alias("state")).unionByName(live)


def _claims(state: DataFrame, held: DataFrame) -> DataFrame:
    """Moves to a value that an undecided request names, with the holder's next
    accepted move (``sure``) and its next accepted or undecided one (``maybe``)."""
    live = state.where("state = 'U'").select("value").distinct()
    moves = _moves(state, held)
    holders = moves.join(live, "value", "left_semi").select("holder").distinct()
    moves = moves.join(holders, "holder", "left_semi")
    ends = next_ids(moves, ["holder"], "t", {"sure": _C("state") == "A", "maybe": F.lit(True)})
    return ends.join(live, "value", "left_semi")


def _timeline(state: DataFrame, held: DataFrame) -> DataFrame:
    """One round: (request_id, refused) of the undecided requests that the
    intervals on their value's timeline decide. At one time all ends and
    starts on a value are the asking holder's, so what the holder itself has
    open is subtracted."""
    claims = _claims(state, held)
    point = lambda t, c, p: F.struct(t.alias("t"), c.cast("long").alias("c"), p.cast("long").alias("p"))
    a = (_C("state") == "A").cast("int")
    points = claims.select("value", "holder", F.explode(F.array(
        point(_C("t"), a, F.lit(1)), point(_C("maybe"), -a, F.lit(0)), point(_C("sure"), F.lit(0), F.lit(-1)))).alias("e")).select("value", "holder", "e.*")
    asked = state.where("state = 'U'").select("value", "holder", _C("request_id").alias("t"), _C("request_id").alias("q"),
                                              *[F.lit(0).cast("long").alias(c) for c in "cp"])
    points = points.where("t IS NOT NULL").withColumn("q", F.lit(None).cast("long")).unionByName(asked)
    points = materialize(points.groupBy("value", "holder", "t").agg(F.max("q").alias("q"), F.sum("c").alias("c"), F.sum("p").alias("p")), "timeline")
    every = running_sums_by_id(points, ["value"], "t", {"ca": _C("c"), "pa": _C("p")}).where("q IS NOT NULL").select("q", "ca", "pa")
    own = running_sums_by_id(points, ["value", "holder"], "t", {"co": _C("c"), "po": _C("p")}).where("q IS NOT NULL").select("q", "co", "po")
    held_by_others = every.join(own, "q").select(_C("q").alias("request_id"), (_C("ca") > _C("co")).alias("refused"), (_C("pa") == _C("po")).alias("free"))
    return held_by_others.where("refused OR free").select("request_id", "refused")


def _rows_of(state: DataFrame, held: DataFrame) -> DataFrame:
    """What a replay reads: undecided requests, all decided moves of holders
    with an undecided one, and of other holders their intervals on values that
    undecided requests name. ``busy`` tells the first holders' rows, ``shared``
    the rows whose value several holders name: no other was ever undecided."""
    undecided = state.where("state = 'U'")
    busy = undecided.where("effect").select("holder").distinct()
    asks = undecided.select(_C("request_id").alias("t"), F.when(_C("effect"), ASK).otherwise(LOOK).alias("kind"), "holder", "value", _C("effect").alias("busy"), "shared")
    moves = held.select(F.lit(START).alias("t"), "holder", "value", F.lit(True).alias("shared")).unionByName(
        state.where("effect AND state = 'A'").select(_C("request_id").alias("t"), "holder", "value", "shared"))
    known = moves.join(busy, "holder", "left_semi").select("t", F.lit(TAKE).alias("kind"), "holder", "value", F.lit(True).alias("busy"), "shared")
    live = undecided.select("value").distinct()
    # few others have a shared value: only their moves are looked up for the next one
    have = moves.where("shared").join(live, "value", "left_semi").select("holder").distinct().join(busy, "holder", "left_anti")
    of_others = materialize(moves.join(have, "holder", "left_semi"), "claim-others")
    claims = next_ids(of_others, ["holder"], "t", {"sure": F.lit(True)}).where("shared").join(live, "value", "left_semi")
    ends = F.array(F.struct("t", F.lit(TAKE).alias("kind")), F.struct(_C("sure").alias("t"), F.lit(FREE).alias("kind")))
    others = claims.select("holder", "value", "shared", F.explode(ends).alias("e")).select("e.t", "e.kind", "holder", "value", F.lit(False).alias("busy"), "shared").where("t IS NOT NULL")
    rows = materialize(asks.unionByName(others).unionByName(known), "claim-rows")
    release(of_others)
    return rows


def _parts(rows: DataFrame) -> DataFrame:
    """The rows with their ``component``. Values are tied by holders with an
    undecided request; such a holder's rows stay together. A component is
    named by a hash of its label: two with one name share a pass, which changes
    no answer."""
    asks = rows.where(_C("kind") >= ASK)
    live = asks.select("value").distinct()
    had = rows.where(_C("busy") & _C("shared") & (_C("kind") < ASK)).join(live, "value", "left_semi")
    ties = asks.where("busy").select("value", "holder").unionByName(had.select("value", "holder"))
    named = components(ties, "value", "holder")
    labels = named.withColumn("component", F.xxhash64("component"))
    of_holder = ties.groupBy("holder").agg(F.min("value").alias("value")).join(labels, "value").select("holder", "component")
    by_holder = rows.where("busy").join(of_holder, "holder")
    # a value that only requests without effect name is a component of its own
    by_value = rows.where("NOT busy").join(labels, "value", "left").withColumn("component", F.coalesce("component", F.xxhash64("value")))
    parts = materialize(by_holder.select(*_ROWS).unionByName(by_value.select(*_ROWS)), "claim-parts")
    release(named)
    return parts


def decide_claims(requests: DataFrame, held: DataFrame, replay_rows: int = REPLAY_ROWS) -> DataFrame:
    """(request_id, refused) of every request.

    ``requests``: request_id (unique, integral, the order), holder (long),
    value (string; NULL gives up what the holder has and is never refused),
    effect (False: the answer is wanted, but nothing changes). ``held``: holder
    (unique), value: what holders have at first; several may have one value,
    which is refused to each of them until the others give it up. NULL values
    of ``held`` count for nothing."""
    refused = refused_claims(requests, held, replay_rows).withColumn("refused", F.lit(True))
    return requests.select(_C("request_id").cast("long").alias("request_id")).join(refused, "request_id", "left").select(
        "request_id", F.coalesce("refused", F.lit(False)).alias("refused"))


def refused_claims(requests: DataFrame, held: DataFrame, replay_rows: int = REPLAY_ROWS) -> DataFrame:
    """(request_id) of the requests that ``decide_claims`` refuses, written.
    Intermediates are deleted when the next step has read them."""
    held = held.where("value IS NOT NULL").select(_C("holder").cast("long").alias("holder"), "value")
    requests = requests.select(_C("request_id").cast("long").alias("request_id"), _C("holder").cast("long").alias("holder"), "value", "effect")
    named = requests.select("value", "holder").where("value IS NOT NULL").unionByName(held.select("value", "holder"))
    shared = named.groupBy("value").agg(F.min("holder").alias("_a"), F.max("holder").alias("_z")).where("_a <> _z").select("value", F.lit(True).alias("_s"))
    # no other holder can have a value that one alone names, nor NULL, which would all meet in one task
    state = requests.where("value IS NOT NULL").join(shared, "value", "left").unionByName(
        requests.where("value IS NULL").withColumn("_s", F.lit(None).cast("boolean")))
    state = state.select("request_id", "holder", "value", "effect", F.when(_C("_s"), "U").otherwise("A").alias("state"), F.coalesce("_s", F.lit(False)).alias("shared"))
    state = materialize(state, "claims")
    held = materialize(held.join(state.where("state = 'U'").select("value").distinct(), "value", "left_semi"), "held")
    refused = []
    while not state.where("state = 'U'").isEmpty():
        rows, round_ = _rows_of(state, held), None
        if rows.count() <= replay_rows:  # all at once, as one component
            found, read = _replayed(rows.withColumn("component", F.lit(0).cast("long"))), rows
        else:
            read = parts = _parts(rows)
            release(rows)
            sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
            large = materialize(sizes.where(_C("_n") > replay_rows).select("component"), "large")
            found = _replayed(parts)
            if not large.isEmpty():
                ids = parts.where(_C("kind") >= ASK).join(large, "component", "left_semi").select(_C("t").alias("request_id"))
                round_ = materialize(_timeline(state, held).join(ids, "request_id", "left_semi"), "claims-decided")
                if 2 * round_.count() < ids.count():  # long chains: cheaper in one ordered pass
                    round_ = None
                else:
                    found = _replayed(parts.join(large, "component", "left_anti")).unionByName(round_)
        if round_ is None:  # nothing is left open
            refused.append(materialize(found.where("refused").select("request_id"), "refused"))
            release(read)
            break
        answers = found.select("request_id", F.when(_C("refused"), "R").otherwise("A").alias("_new"))
        before, state = state, state.join(answers, "request_id", "left").withColumn("state", F.coalesce("_new", "state")).drop("_new")
        state = materialize(state, "claims")
        release(before, read, round_)
    refused.append(materialize(state.where("state = 'R'").select("request_id"), "refused"))
    release(state, held)
    return refused[0].unionByName(refused[1]) if len(refused) > 1 else refused[0]
