"""Periods, running values, timeouts, merging and lookups against plain loops."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from meterline.operators import lookup, merging, metrics as m, periods
from meterline.operators.running import running_max, running_sum
from meterline.plans import handlers as h
from meterline.schemas import SCHEMAS
from meterline.sources import readers, sinks

BASE = dt.datetime(2024, 1, 1)


def t(s):
    return BASE + dt.timedelta(seconds=s)


@pytest.mark.parametrize("seconds", [60, 3600])
def test_activity_starts(spark, seconds):
    r = random.Random(seconds)
    want, rows = [], []
    for stream in ("a", "b", None):
        now, last = r.randrange(10**6), None
        for _ in range(400):
            now += r.choice([1, 7, 59, 60, 61, 3599, 3600, 90_000])
            rows.append((stream, now))
            if last is None or now >= last + seconds:
                last = now
                want.append((stream, now))
    df = spark.createDataFrame(rows + rows[:50], "stream string, s bigint")
    got = [(x["_stream"], x.start) for x in periods.activity_starts(df, ["stream"], "s", seconds).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periods.activity_starts(df.limit(0), ["stream"], "s").count() == 0


def test_running_values(spark, monkeypatch):
    from meterline.operators import running

    monkeypatch.setattr(running, "ROWS", 16)
    r = random.Random(1)
    rows = [(s, i, r.randrange(-9, 9)) for s in ("a", None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, x bigint")
    high = {(x.k, x.i): x.high for x in running_max(df, "x", ["k"], "i", out="high").collect()}
    both = {(x.k, x.i): (x.total, x.least) for x in running_sum(df, "x", ["k"], ["i"], out="total", low="least").collect()}
    for s in ("a", None):
        top, total, least = -99, 0, 99
        for k, i, x in rows:
            if k == s:
                top, total = max(top, x), total + x
                least = min(least, total)
                assert high[k, i] == top and both[k, i] == (total, least)


def test_nearest_start(spark):
    starts = spark.createDataFrame([("a", 100, 1), ("a", 7300, 2), ("a", 7400, 3)], "_s string, start bigint, n int")
    df = spark.createDataFrame([("a", x) for x in (0, 100, 101, 5000, 7300, 7350, 9999)] + [("b", 5), (None, 5), ("a", None)], "s string, x bigint")
    after = {(x.s, x.x): x.n for x in periods.nearest_start(df, "x", starts, "s", after=True).collect()}
    upto = {(x.s, x.x): x.n for x in periods.nearest_start(df, "x", starts, "s", after=False).collect()}
    assert [after["a", x] for x in (0, 100, 101, 5000, 7300, 7350, 9999)] == [1, 1, 2, 2, 2, 3, None]
    assert [upto["a", x] for x in (0, 100, 101, 5000, 7300, 7350, 9999)] == [None, 1, 1, 1, 2, 2, 3]
    assert after["b", 5] is None and after[None, 5] is None and after["a", None] is None and len(after) == len(upto) == 10


def dns_row(s, response, txid, seq):
    return ("s", t(s), "in" if not response else "out", response, txid, 1, "a.example.com", 1, 0, False, False, False, 1, [1], None, "ipv4", "udp", 53 if response else 4000, 4000 if response else 53, 100, seq)


def test_unanswered_queries_time_out_in_the_period_that_purges_them(spark):
    # 1 is never answered; 2 is answered after the shift that purges it; 3 is open, but not old enough at the shift
    rows = [dns_row(0, False, 1, 0), dns_row(50, False, 2, 1), dns_row(58, False, 3, 2), dns_row(61, False, 4, 3), dns_row(62, True, 2, 4), dns_row(62, True, 3, 5), dns_row(62, True, 4, 6), dns_row(200, False, 5, 7)]
    df = spark.createDataFrame(rows, SCHEMAS["dns"])
    for fn, timeouts, pairs in ((h.dns, "timeout_queries", "xacts"), (h.dns_v1, "xact_counts_timed_out", "xact_counts_total")):
        got = {(x["name"], x.period_start): x.value for x in fn(df).where("kind = 'counter'").collect()}
        assert got[timeouts, t(0)] == 0 and got[timeouts, t(60)] == 2 and got[timeouts, t(180)] == 0
        assert got[pairs, t(60)] == 2
    assert {x.value for x in h.dns(df).where("name = 'orphan_responses'").collect()} == {0.0, 1.0}


def packet(s, src, size, seq, stream="s"):
    return (stream, t(s), "in", "ipv4", "udp", src, "2.2.2.2", 53, 1000, size, False, seq)


def test_merged_handlers_and_windows_count_items_once(spark):
    one = spark.createDataFrame([packet(0, "1.1.1.1", 100, 0), packet(61, "1.1.1.1", 100, 1), packet(121, "1.1.1.1", 100, 2)], SCHEMAS["packets"])
    v = {(x["name"], x.stat): x.value for x in merging.merge_like_handlers(h.net_v1, {"a": one, "b": one}, h.Options()).where(F.col("period_start") == F.lit(t(0))).collect()}
    assert v["cardinality_src_ips_in", "value"] == 1 and v["payload_size", "p50"] == 100 and v["total", "value"] == 2 and v["top_ipv4", "1.1.1.1"] == 2
    v = {(x["name"], x.stat): x.value for x in h.net_v1(one, h.Options(merge=3)).collect()}
    assert v["cardinality_src_ips_in", "value"] == 1 and v["payload_size", "p50"] == 100 and v["total", "value"] == 3 and v["top_ipv4", "1.1.1.1"] == 3 and v["num_events", "value"] == 3
    probes = spark.createDataFrame([("s", t(0), "x", "tcp", "send", 1, None, 0), ("s", t(1), "x", "tcp", "recv", 1, None, 1), ("s", t(70), "x", "tcp", "send", 2, None, 2), ("s", t(70.5), "x", "tcp", "recv", 2, None, 3)], SCHEMAS["probes"])
    v = {(x["name"], x.stat): x.value for x in h.netprobe(probes, h.Options(merge=2)).collect()}
    assert v["response_min_us", "value"] == 500_000 and v["response_max_us", "value"] == 1_000_000 and v["successes", "value"] == 2


def test_one_scan_of_a_table(spark):
    kinds = [m.Counter("n"), m.Cardinality("c", item=F.col("seq")), m.Quantile("q", value=F.col("bytes")), m.Histogram("h", value=F.col("bytes")), m.TopN("t", item=F.col("src_ip")), m.Rate("r")]
    df = periods.assign_periods(spark.createDataFrame([packet(0, "1.1.1.1", 100, 0)], SCHEMAS["packets"]))
    plan = m.metric_table(df, kinds, handler="x", schema="x", dims=["dir"])
    assert len(plan.collect()) == len({(x["name"], x.stat) for x in plan.collect()})
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("Scan ExistingRDD") == 1 and "ReusedExchange" in text


def test_document_quotes_keys(spark):
    df = spark.createDataFrame([('p"q', "net", "net", t(0), 60, {"d": 'a"b'}, "n", "counter", "value", 3.0), ('p"q', "net", "net", t(0), 60, {"d": "c\\d"}, "top", "topn", 'x"y', 2.0)], SCHEMAS["metrics"])
    found = json.loads(sinks.to_document(df).first().document)
    assert found['p"q']["net"]["net"]['a"b']["n"] == 3 and found['p"q']["net"]["net"]["c\\d"]["top"][0]["name"] == 'x"y'
    lines = [x.line for x in sinks.to_prometheus(df, {"n": "Number of things"}).collect()]
    assert "# HELP net_n Number of things" in lines and "# HELP net_top top" in lines


def test_lookups_of_both_families(spark):
    networks = [("10.0.0.0/8", "wide"), ("10.1.0.0/16", "narrow"), ("2001:db8::/32", "six wide"), ("2001:db8:4000::/34", "six narrow"), ("2001:db8:ffff::1/128", "one")]
    table = spark.createDataFrame([(n, 7, name) for n, name in networks], "network string, asn_number int, asn_org string")
    ips = ["10.0.0.1", "10.1.2.3", "11.0.0.1", "2001:db8::9", "2001:db8:7fff::1", "2001:db8:8000::1", "2001:db8:ffff::1", "2001:db9::", None]
    df = spark.createDataFrame([(i,) for i in ips] * 2, "ip string")
    got = {x.ip: x.asn for x in lookup.asn_lookup(df, "ip", readers.load_asn(table), ranges_v6=readers.load_asn(table, 6)).collect()}
    assert [got[i] for i in ips] == ["7/wide", "7/narrow", "Unknown", "7/six wide", "7/six narrow", "7/six wide", "7/one", "Unknown", None]
