"""Steps whose memory, rounds or rewritten bytes grew faster than the tables."""

import os
import time

from pyspark.sql import functions as F

from shoptally import session
from shoptally.functions import holders, sequential
from shoptally.operators import listings, posting
from shoptally.sources import fixtures
from shoptally.sources.fixtures import ShopTables
from tests.conftest import SF_SMALL


def _aggregates(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")


def test_cancelled_orders_are_looked_up_without_a_distinct_list(spark):
    """A semi join needs no distinct request ids, which one task's hash table would hold."""
    t = ShopTables(spark, SF_SMALL)
    twice = t.order_cancel_requests.unionByName(t.order_cancel_requests)
    once, again = posting.order_cancel_stock_delta(t, t.order_cancel_requests), posting.order_cancel_stock_delta(t, twice)
    assert _aggregates(once) == 1
    assert sorted(once.collect()) == sorted(again.collect())


def test_components_contract_dense_graphs(spark, monkeypatch):
    """Hubs that many nodes share are gone after a few contractions: no round reads all edges again."""
    edges = [(i, f"hub{i % 7}") for i in range(400)] + [(i, f"tie{i // 5}") for i in range(300, 400)] + [(1000, "alone")]
    written = []
    write = sequential.materialize

    def counted(df, name):
        out = write(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(sequential, "materialize", counted)
    got = {r.n: r.component for r in sequential.components(spark.createDataFrame(edges, "n long, v string"), "n", "v").collect()}
    assert got == {**dict.fromkeys(range(400), 0), 1000: 1000}
    sizes = [n for name, n in written if name == "edges"]
    assert sizes[0] == len(edges) and max(sizes[2:]) < 200
    assert max([n for name, n in written if name == "labels"], default=0) < 10  # 401 before


def test_components_of_long_chains(spark):
    """What the contractions leave is labelled by spreading."""
    n = 300
    edges = [((i * 7919) % n, f"v{i}") for i in range(n)] + [(((i + 1) * 7919) % n, f"v{i}") for i in range(n - 1)]
    edges += [(n + i, f"w{i}") for i in range(100)] + [(n + i + 1, f"w{i}") for i in range(100)]
    rows = sequential.components(spark.createDataFrame(edges, "n long, v string"), "n", "v").groupBy("component").agg(F.count("*").alias("c")).collect()
    assert sorted((r.component, r.c) for r in rows) == [(0, n), (n, 101)]


def test_posting_parses_the_batch_once(spark, monkeypatch):
    """Validation and posting read the items of one parse, which is written."""
    parses = []
    parse = posting.F.from_xml
    monkeypatch.setattr(posting.F, "from_xml", lambda *a: parses.append(1) or parse(*a))
    t = ShopTables(spark, SF_SMALL)
    requests = t.return_requests.where("import_id < 200")
    posted = posting.return_request_post(t, requests, "2026-08-20 09:30:00")
    assert len(parses) == 1
    v = posting.return_request_validate(t, requests)
    again = posting.return_request_post(t, requests, "2026-08-20 09:30:00", v)
    for name, frame in posted.items():
        assert sorted(map(str, frame.collect())) == sorted(map(str, again[name].collect())), name


def test_posting_keeps_requests_without_items_and_repeated_rows(spark):
    """The header comes from the parsed rows: one a request row, whatever its number of items."""
    t = ShopTables(spark, SF_SMALL)
    requests = t.return_requests.where("import_id < 200")
    header = posting.return_request_post(t, requests, "2026-08-20 09:30:00")["header"]
    accepted = posting.return_request_validate(t, requests).where("outcome = 'accepted'")
    assert header.count() == accepted.count() and header.select("return_id").distinct().count() == accepted.count()


def _rows(df):
    return sorted(map(str, df.collect()))


def _exchanged(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line]


def test_import_lines_exchange_only_the_columns_of_their_order(spark):
    """The lines are numbered below their projection; computed columns aren't exchanged."""
    t = ShopTables(spark, SF_SMALL)
    window = [f for f in t.import_details._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in f]
    assert not any("FLOOR" in line.upper() for line in window[1:])
    assert len(_exchanged(t.import_details)) == 1


def test_written_tables_have_the_same_rows_and_are_derived_once(spark, monkeypatch):
    written = []
    write = fixtures.materialize
    monkeypatch.setattr(fixtures, "materialize", lambda df, name: written.append(name) or write(df, name))
    lazy, stored = ShopTables(spark, SF_SMALL), fixtures.WrittenTables(spark, SF_SMALL)
    for name in ("import_details", "imports", "purchase_return_details", "purchase_returns", "product_serials"):
        assert _rows(getattr(lazy, name)) == _rows(getattr(stored, name)), name
    assert written == ["shop-import_details", "shop-imports"]


def test_serials_without_an_order_do_not_meet_in_the_join(spark):
    """Their NULL order ids would all go to one task; the rows stay."""
    t = ShopTables(spark, SF_SMALL)
    traced = listings.serial_trace(t)
    assert "Union" in traced._jdf.queryExecution().optimizedPlan().toString()
    rows = traced.collect()
    numbers = t.product_serials.where("serial_number IS NOT NULL").join(t.products, "product_id").select("serial_number").distinct()
    assert len(rows) == numbers.count() and {r.order_code is None for r in rows} == {True, False}


def _kept(spark):
    at = f"{session.checkpoint_dir(spark)}/materialized"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_lean_steps_leave_no_shuffle_files_and_can_be_deleted(spark):
    """The shuffles of a written step go when it ends; the session's setting stays as it was."""
    own = spark.conf.get(session._CLEANUP)
    before = _shuffle_files(spark)
    out = session.materialize_lean(spark.range(5000).repartition("id"), "lean")
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(session._CLEANUP) == own
    assert out.count() == 5000
    path = out._written_at
    assert os.path.isdir(path)
    session.release(out, spark.range(3))
    assert not os.path.exists(path)


def test_return_requests_keep_only_what_is_read_later(spark):
    """Items, demands and the rounds of the decision are deleted once read."""
    t = ShopTables(spark, SF_SMALL)
    before = _kept(spark)
    got = posting.return_request_validate(t, t.return_requests, replay_rows=1000)
    names = {n.rsplit("-", 1)[0] for n in _kept(spark) - before}
    assert not names & {"return-items", "return-stocked", "return-demands", "edges", "low", "labels", "parts", "replay", "components", "touched"}
    assert got.count() == t.return_requests.count()


def test_claims_keep_only_the_refused(spark):
    """Rows, components and rounds of claims are deleted once read, in one pass and by components."""
    asked = [(q, q % 40, f"v{q % 9}" if q % 3 else None, q % 5 > 0) for q in range(200)]
    requests = spark.createDataFrame(asked, "request_id long, holder long, value string, effect boolean")
    held = spark.createDataFrame([(h, f"v{h % 11}") for h in range(30)], "holder long, value string")
    want = None
    for rows in (10**6, 60):
        before = _kept(spark)
        got = {r.request_id for r in holders.refused_claims(requests, held, rows).collect()}
        assert {n.rsplit("-", 1)[0] for n in _kept(spark) - before} <= {"refused", "large", "timeline", "claims-decided"}  # the last two of a component too large
        want = got if want is None else want
        assert got == want and 10 < len(got) < 190


def test_items_without_a_variant_do_not_meet_in_the_join(spark):
    """Most lines have no variant: their NULLs would all go to one task; the rows and their stocks stay."""
    t = ShopTables(spark, SF_SMALL)
    items = spark.createDataFrame([(1, 2, 10, 5, 3, 30), (2, 1, 11, 5, 3, None), (3, 1, 12, None, 10**9, 10**9), (4, 1, None, None, None, None)],
                                  "request_id long, quantity int, import_detail_id long, line_left long, product_id long, _d_variant long")
    stocked = posting._stocked(t, items)
    assert "Union" in stocked._jdf.queryExecution().optimizedPlan().toString()
    got = {r.request_id: (r.q, r.line_left, r.product_left, r.variant_left) for r in stocked.collect()}
    assert got == {1: (2, 5, 3 * 37 % 500, 3 * 7 % 60 - 5), 2: (1, 5, 3 * 37 % 500, None), 3: (1, None, None, None), 4: (1, None, None, None)}
