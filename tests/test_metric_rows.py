"""The definitions of whole handlers against values worked out by hand, and against the names that handlers report."""

import duckdb
import pytest

from meterline.plans import handlers as h
from meterline.plans import metric_rows as w
from meterline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WHOLE = [n for n, q in QUERIES.items() if q.__module__ == w.__name__]


def rows(definitions, table):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE t AS {table}")
    return sorted(con.sql(definitions.sql("u AS (SELECT * FROM t)", w._BOUNDS)).fetchall(), key=str)


def test_definitions_by_hand():
    """Two groups; one has no row of the condition: its counters and distinct counts are 0, its tops, marks and bounds absent."""
    table = "SELECT * FROM (VALUES (0, 'a', 'x', 1, 0), (0, 'a', 'y', 2, 0), (0, 'a', 'y', 9, 1), (0, 'b', 'z', 5, 2)) v(period, k, item, n, sec)"
    d = w.Definitions("k").counters("u", {"c": "k = 'a'"}, weight="n").distinct("u", {"d": ("item", "k = 'a'")}).tops("u", {"t": ("item", "k = 'a'")}, weight="n")
    assert rows(d, table) == sorted([(0, "a", "c", "value", 12.0), (0, "b", "c", "value", 0.0), (0, "a", "d", "value", 2.0), (0, "b", "d", "value", 0.0), (0, "a", "t", "y", 11.0), (0, "a", "t", "x", 1.0)], key=str)
    d = w.Definitions("k").quantiles("u", {"q": ("n", "k = 'a'")}).histograms("u", {"h": ("n", "k = 'a'")})
    marks = {"p50": 2, "p90": 9, "p95": 9, "p99": 9, "n": 3, "min": 1, "max": 9}
    bounds = {"1": 1, "2": 2, "10": 3, "+Inf": 3}
    found = rows(d, table)
    assert {x[3]: x[4] for x in found if x[2] == "q"} == marks
    upto = {x[3]: x[4] for x in found if x[2] == "h"}
    assert upto["+Inf"] == 3 and sorted(v for s, v in upto.items() if s != "+Inf") == sorted(v for s, v in bounds.items() if s != "+Inf")
    assert all(x[1] == "a" for x in found)
    live = {(x[1], x[3]): x[4] for x in rows(w.Definitions("k").rates("u", {"r": ("n", "true")}, "u"), table)}
    assert live["a", "live"] == 9 and live["b", "live"] == 0 and live["a", "p50"] == 0 and live["a", "p99"] == 9


@pytest.mark.parametrize("name", ["bgp_metrics", "capture_metrics", "netprobe_metrics", "dhcp_metrics"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = want.columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_handler_has_a_row():
    assert len(WHOLE) == len(h.HANDLERS)
    assert all(n in ORACLE_SQL for n in WHOLE)
