"""Periods, pairing, metrics, filters, lookups, merging."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterline.operators import filters, lookup, merging, metrics, pairing, periods
from meterline.sources import readers

T0 = 1_700_000_040


def at(s):
    return dt.datetime.fromtimestamp(T0 + s, dt.timezone.utc).replace(tzinfo=None)


def test_activity_periods_with_gaps_and_late_rows(spark):
    secs = [0, 10, 59, 75, 130, 65, 135, 400, 460, 100]  # 65 and 100 are late
    df = spark.createDataFrame([("s", at(x), i) for i, x in enumerate(secs)], "stream string, ts timestamp, seq bigint")
    got = periods.assign_periods(df, origin="activity", stream="stream", seq="seq").orderBy("seq").select(F.unix_seconds("period_start")).collect()
    last, want, high = None, [], 0
    for x in secs:
        if last is None or x >= last + 60:
            last = x
        want.append(T0 + last)
    assert [r[0] for r in got] == want


def model(rows, ttl_us):
    """One slot a key, row by row."""
    slot, out = {}, {}
    for key, ts, seq, response in sorted(rows, key=lambda r: (r[1], r[2])):
        if not response:
            slot[key] = ts
        elif key in slot:
            out[seq] = "timed_out" if (ts - slot.pop(key)) * 1_000_000 >= ttl_us else "valid"
        else:
            out[seq] = "orphan"
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairing_equals_slot_model(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(5), r.randrange(60), i, r.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame([(k, at(t), i, b) for k, t, i, b in rows], "k int, ts timestamp, seq bigint, is_response boolean")
    got = {x.seq: x.status for x in pairing.pair_transactions(df, ["k"], "is_response", ttl_ms=5000).where("is_response").collect()}
    assert got == model(rows, 5_000_000)


def test_purge(spark):
    df = spark.createDataFrame([("s", 1, at(0), 0, False), ("s", 1, at(200), 1, True), ("s", 2, at(1), 2, False), ("s", 2, at(3), 3, True)], "stream string, k int, ts timestamp, seq bigint, is_response boolean")
    paired = pairing.pair_transactions(df, ["k"], "is_response")
    starts = spark.createDataFrame([("s", T0), ("s", T0 + 100)], "_stream string, start bigint")
    got = {r.seq: r.status for r in pairing.purge_timeouts(paired, starts, ["k"], "is_response", stream="stream").collect()}
    assert got == {0: "purged", 1: "orphan", 2: "answered", 3: "valid"}


def test_filtered_queries_count(spark):
    df = spark.createDataFrame([(1, at(0), 0, False, True), (1, at(1), 1, True, False), (2, at(0), 2, False, False), (2, at(1), 3, True, True)], "k int, ts timestamp, seq bigint, is_response boolean, ok boolean")
    got = {r.seq: (r.counted, r.filtered) for r in pairing.propagate_query_filter(df, F.col("ok"), ["k"], "is_response").collect()}
    assert got == {0: (False, 0), 1: (False, 2), 2: (False, 1), 3: (False, 1)}


def test_period_choice_and_errors(spark):
    df = spark.createDataFrame([(at(60 * i), 1) for i in range(4)], "ts timestamp, n int")
    p = periods.assign_periods(df)
    assert periods.retain(p, 2).count() == 2 and periods.retain(p).count() == 4
    assert periods.bucket(p, 1).count() == 1
    with pytest.raises(periods.PeriodError, match="invalid"):
        periods.bucket(p, 5)
    with pytest.raises(periods.PeriodError, match="not yet"):
        periods.bucket(p, 4)
    w = periods.merged_window(p, 3).select("period_start", "period_len").distinct().collect()
    assert len(w) == 1 and w[0].period_len == 180
    assert periods.heartbeat(df.withColumn("s", F.lit(1)), stream="s").count() == 7
    info = periods.period_info(p).orderBy("start").collect()
    assert [i.read_only for i in info] == [True, True, True, False] and info[0].length == 60


def test_merged_rollups_equal_the_union(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.col("id") % 300).alias("v"), (F.col("id") % 2).alias("half"))
    kinds = dict(counters=["n"], distinct=["d"], quantiles=["q"])
    args = dict(counters={"n": F.lit(1)}, distinct={"d": F.col("v")}, quantiles={"q": F.col("v")})
    parts = merging.rollup(df, ["k", "half"], **args)
    merged = merging.read_rollups(merging.merge_rollups(parts, ["k"], **kinds), ["k"], **kinds)
    whole = {r.k: r for r in df.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")).collect()}
    for r in merged.collect():
        assert r.n == whole[r.k].n and abs(r.d - whole[r.k].d) <= 0.1 * whole[r.k].d and abs(r.q[0] - 150) < 20


def test_sketch_mode(spark):
    df = spark.range(1000).select(F.lit(at(0)).alias("ts"), F.col("id").alias("v"))
    t = metrics.metric_table(periods.assign_periods(df), [metrics.Cardinality("c", item=F.col("v")), metrics.Quantile("q", value=F.col("v"))], handler="x", schema="x", mode="sketch")
    got = {(r.name, r.stat): r.value for r in t.collect()}
    assert abs(got["c", "value"] - 1000) < 60 and abs(got["q", "p50"] - 500) < 40


def test_groups_and_filter_errors(spark):
    assert "top_ips" in filters.metric_groups("net") and filters.metric_groups("net", disable=["all"]) == set()
    assert filters.metric_groups("dns", enable=["all"]) == set(filters.GROUPS["dns"])
    assert filters.metric_groups("net", enable=["counters"], disable=["all"]) == {"counters"}
    with pytest.raises(filters.FilterError):
        filters.metric_groups("net", enable=["nope"])
    with pytest.raises(filters.FilterError, match="there are"):
        filters.from_options(filters.DnsFilter, {"only_rcodes": 1})
    with pytest.raises(filters.FilterError):
        filters.NetFilter(only_asn_number=["x"]).keep()
    with pytest.raises(filters.FilterError):
        filters.DnsFilter(dnstap_msg_type="odd").keep()
    with pytest.raises(filters.FilterError):
        filters.FlowFilter(only_directions=["up"]).interface("if_in")


def test_dns_filters(spark):
    df = spark.createDataFrame([(False, 0, 1, "A.example.com", 0, [1]), (True, 0, 28, "a.example.com", 2, [46]), (True, 3, 1, "b.test", 0, [])], "is_response boolean, rcode int, qtype int, qname string, answer_count int, answer_types array<int>")
    keep = lambda **o: [r[0] for r in df.select(filters.DnsFilter(**o).keep()).collect()]
    assert keep(exclude_noerror=True) == [True, False, True]
    assert keep(only_rcode=["nxdomain"]) == [True, False, True]
    assert keep(only_rcode="nxdomain", exclude_noerror=True, version=1) == [False, False, True]
    assert keep(answer_count=2) == [True, True, False]
    assert keep(only_dnssec_response=True) == [True, True, False]
    assert keep(only_qtype=["AAAA"]) == [True, True, False]
    assert keep(only_qname=["a.EXAMPLE.com"], version=1) == [True, True, False]
    assert keep(only_qname_suffix=[".test"]) == [False, False, True]
    assert keep(only_queries=True) == [True, False, False] and keep(only_responses=True) == [False, True, True]


def test_services_and_ranges(spark):
    raw = spark.createDataFrame([("domain", "53", "udp"), ("dup", "53", "udp"), ("block", "100-110", "tcp"), ("", "7", "tcp"), ("bad", "x", "tcp"), ("other", "9", "sctp")], "`Service Name` string, `Port Number` string, `Transport Protocol` string")
    s = readers.services_table(raw.withColumn("ord", F.monotonically_increasing_id()))
    assert sorted(tuple(r) for r in s.collect()) == [("tcp", 100, 110, "block"), ("udp", 53, 53, "domain")]
    df = spark.createDataFrame([(53, "udp"), (53, "tcp"), (105, "other"), (99, "tcp")], "port int, proto string")
    assert [r.service for r in lookup.join_services(df, "port", "proto", s).orderBy("port", F.desc("proto")).collect()] == ["domain", "53", "99", "block"]


def test_geo_both_families(spark):
    table = spark.createDataFrame([("10.0.0.0/8", "EU", None, "DE", None, "Berlin", 52.5, 13.4)], "network string, continent string, country_name string, country_iso string, subdivision string, city string, latitude double, longitude double")
    v4 = readers.load_geo(table)
    assert v4.first().location == "EU/DE/Berlin" and v4.first().lat == "52.500000"
    v6 = readers.load_geo_v6(spark.createDataFrame([("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "NA/US")], "first_ip string, last_ip string, location string"))
    df = spark.createDataFrame([(1, "10.200.0.1"), (2, "11.0.0.1"), (3, "2001:db8::7"), (4, None)], "i int, ip string")
    assert [r.location for r in lookup.geo_lookup(df, "ip", v4, ranges_v6=v6).orderBy("i").collect()] == ["EU/DE/Berlin", "Unknown", "NA/US", None]


def test_sources_by_tag(spark):
    s = spark.createDataFrame([("a", "pcap", {"x": "1", "y": "2"}), ("b", "pcap", {"x": "1"})], "name string, type string, tags map<string,string>")
    assert [r.name for r in merging.select_sources(s, all_tags={"x": 1, "y": 2}).collect()] == ["a"]
    assert merging.select_sources(s, any_tags={"x": 1}).count() == 2
    with pytest.raises(ValueError):
        merging.select_sources(s, name="c")
    d, i = readers.load_device_map(spark, {"10.0.0.1": {"name": "r1", "interfaces": {4: {"name": "eth4"}}}})
    assert d.count() == 1 and i.first().if_index == 4
    for bad in ({"x": {"name": "r", "interfaces": {}}}, {"10.0.0.1": {"name": "r"}}, {"10.0.0.1": {"name": "r", "interfaces": {1: {}}}}):
        with pytest.raises(readers.ConfigError):
            readers.load_device_map(spark, bad)
