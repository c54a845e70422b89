"""Registered queries against brute force over whole tables."""

from pathlib import Path

import duckdb
import pytest

from tidewake import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def test_components_use_all_of_lineitem(spark):
    links = duckdb.sql(f"SELECT DISTINCT l_partkey, s_nationkey FROM '{DATA}/lineitem.parquet' JOIN '{DATA}/supplier.parquet' ON l_suppkey = s_suppkey ORDER BY ALL").fetchall()
    root = {n: n for _, n in links}
    for (part, a), (other, b) in zip(links, links[1:]):
        if part == other and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
    found = {r.node: r.root for r in catalog.queries()["components"](spark, str(DATA)).collect()}
    assert found == root
    listing = catalog.queries()["component_listing"](spark, str(DATA)).collect()
    assert {r.root: r.n for r in listing} == {x: sum(r == x for r in root.values()) for x in root.values()}


def test_week_panel_covers_all_orders(spark):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = con.sql("SELECT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR), CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END, c_mktsegment, CAST(o_totalprice > 250000 AS INTEGER) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey").fetchall()
    mean = lambda v: sum(v) / len(v)
    cells, own = {}, {}
    for week, site, segment, y in rows:
        cells.setdefault((week, site, segment), []).append(y)
        own.setdefault((site, segment), []).append(y)
    want = {}
    for week in {r[0] for r in rows}:
        for site in {s for s, _ in own}:
            segments = [g for s, g in own if s == site]
            want[week, site] = mean([mean(cells.get((week, site, g)) or own[site, g]) for g in segments]), sum((week, site, g) in cells for g in segments)
    found = {(r.week, r.site): (r.rate, r.n_observed) for r in catalog.queries()["week_panel"](spark, str(DATA)).collect()}
    assert set(found) == set(want)
    assert all(abs(found[k][0] - want[k][0]) < 1e-5 and found[k][1] == want[k][1] for k in want)
