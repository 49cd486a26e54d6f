"""Handlers, policies and sinks end to end on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from meterline.plans import handlers as h
from meterline.plans import policy, reports
from meterline.schemas import SCHEMAS
from meterline.sources import sinks

BASE = dt.datetime(2024, 1, 1)


def t(s):
    return BASE + dt.timedelta(seconds=s)


def values(df, **labels):
    out = {}
    for r in df.collect():
        if all(r["labels"].get(k) == v for k, v in labels.items()):
            out[r["name"], r["stat"]] = r["value"]
    return out


def packets(spark):
    rows = [("s", t(0), "in", "ipv4", "udp", "1.1.1.1", "2.2.2.2", 53, 1000, 100, False, 0), ("s", t(1), "out", "ipv4", "tcp", "2.2.2.2", "3.3.3.3", 1, 2, 300, True, 1), ("s", t(1), "unknown", "ipv6", None, "::1", "::2", 1, 2, 50, False, 2)]
    return spark.createDataFrame(rows, SCHEMAS["packets"])


def test_net(spark):
    v = values(h.net(packets(spark)), dir="out")
    assert v["tcp_packets", "value"] == 1 and v["tcp_syn_packets", "value"] == 1 and v["top_ipv4_packets", "3.3.3.3"] == 1 and v["payload_size_bytes", "p50"] == 300
    assert v["rates_bps", "p99"] == 300 and v["rates_bps", "p50"] == 0
    v1 = values(h.net_v1(packets(spark)))
    assert v1["in", "value"] == 1 and v1["unknown_dir", "value"] == 1 and v1["total", "value"] == 3


def test_net_filter_counts(spark):
    geo = spark.createDataFrame([(16843009, 16843009, "EU/DE", "0", "0")], SCHEMAS["geo_ranges_v4"])
    out = h.net(packets(spark), h.Options(filters={"only_geoloc_prefix": ["EU"]}), h.Dimensions(geo_v4=geo))
    v = values(out)
    assert v["filtered_packets", "value"] == 2 and v["observed_packets", "value"] == 3 and v["top_geo_loc_packets", "EU/DE"] == 1


def test_dhcp(spark):
    rows = [("s", t(0), 4, "DISCOVER", 7, "aa", None, None, None, "aa", None, 0), ("s", t(1), 4, "OFFER", 7, "aa", None, "10.0.0.9", "10.0.0.1", "ss", None, 1), ("s", t(2), 4, "REQUEST", 7, "aa", "laptop", None, None, "aa", None, 2), ("s", t(3), 4, "ACK", 7, "aa", None, "10.0.0.9", "10.0.0.1", "ss", None, 3), ("s", t(4), 6, "SOLICIT", 8, "bb", None, None, None, "bb", "fe80::1", 4)]
    v = values(h.dhcp(spark.createDataFrame(rows, SCHEMAS["dhcp"])))
    assert v["wire_packets_total", "value"] == 4 and v["wire_packets_solicit", "value"] == 1 and v["top_clients", "aa/laptop/10.0.0.9"] == 1 and v["top_servers", "ss/10.0.0.1"] == 1
    head = reports.dhcp_header(h.dhcp(spark.createDataFrame(rows, SCHEMAS["dhcp"]))).first()
    assert head.total == 4 and head.offer_pct == 25


def test_bgp_capture_probe_resources(spark):
    b = values(h.bgp(spark.createDataFrame([("s", t(0), "OPEN", 0), ("s", t(1), "KEEPALIVE", 1)], SCHEMAS["bgp"])))
    assert b["wire_packets_open", "value"] == 1 and b["wire_packets_total", "value"] == 2
    c = values(h.capture(spark.createDataFrame([("s", t(0), 5, 0, False, 0), ("s", t(1), 9, 0, True, 1), ("s", t(2), 7, 3, False, 2), ("s", t(3), 10, 3, False, 3)], SCHEMAS["capture_stats"])))
    assert c["os_drops", "value"] == 5 and c["if_drops", "value"] == 3 and c["tcp_reassembly_errors", "value"] == 1
    rows = [("s", t(0), "x", "icmp", "send", 1, None, 0), ("s", t(1), "x", "icmp", "recv", 1, None, 1), ("s", t(2), "x", "icmp", "send", 2, None, 2), ("s", t(9), "x", "icmp", "recv", 2, None, 3), ("s", t(10), "x", "icmp", "fail", 3, "dns", 4)]
    p = values(h.netprobe(spark.createDataFrame(rows, SCHEMAS["probes"]), h.Options(enable=["quantiles"])), target="x")
    assert p["attempts", "value"] == 2 and p["successes", "value"] == 1 and p["packets_timeout", "value"] == 1 and p["dns_lookup_failures", "value"] == 1 and p["response_min_us", "value"] == 1_000_000
    r = values(h.resources(spark.createDataFrame([("s", t(0), 1.5, 100)], SCHEMAS["resource_samples"]), spark.createDataFrame([("s", t(0), 2, 3), ("s", t(1), -5, 1)], SCHEMAS["policy_changes"])))
    assert r["cpu_usage", "p50"] == 1.5 and r["policy_count", "value"] == 0 and r["handler_count", "value"] == 4


def test_flow_and_enrichment(spark):
    rec = dict(is_ipv6=False, proto=17, tos=184, src_ip="10.0.0.1", dst_ip="10.0.0.2", src_port=53, dst_port=4000, if_in=1, if_out=None, packets=None, octets=None, mean_skip_count=10, sampled_packet_size=100)
    df = spark.createDataFrame([("192.0.2.1", t(0), "sflow", "flow", [rec], 0), ("192.0.2.1", t(0), "sflow", "counter", [rec], 1)], SCHEMAS["flow_exports"])
    services = spark.createDataFrame([("udp", 53, 53, "domain")], SCHEMAS["services"])
    d = h.Dimensions(services=services, devices=spark.createDataFrame([("192.0.2.1", "r1", None)], SCHEMAS["devices"]), interfaces=spark.createDataFrame([("192.0.2.1", 1, "eth1", None)], SCHEMAS["interfaces"]))
    v = values(h.flow(df, h.Options(enable=["all"]), d), device="r1")
    assert v["in_udp_bytes", "value"] == 1000 and v["top_in_src_ports_packets", "domain"] == 10 and v["top_in_dscp_bytes", "EF"] == 1000 and v["records_flows", "value"] == 1 and v["top_in_interfaces_bytes", "eth1"] == 1000
    assert v["top_conversations_bytes", "10.0.0.1:domain/10.0.0.2:4000"] == 1000


def test_dnstap_to_dns(spark):
    rows = [("s", "MESSAGE", "CLIENT_QUERY", "INET", "UDP", "1.1.1.1", None, 999, t(0), None, 5, "A.b.example.com", 1, 0, False, False, 0, [], 40, 0), ("s", "MESSAGE", "CLIENT_RESPONSE", "INET", "UDP", "1.1.1.1", None, 999, t(0), t(1), 5, "A.b.example.com", 1, 0, False, False, 1, [1], 80, 1)]
    df = h.from_dnstap(spark.createDataFrame(rows, SCHEMAS["dnstap"]))
    v = values(h.dns(df, h.Options(enable=["all"])), xact_dir="in")
    assert v["xacts", "value"] == 1 and v["udp_xacts", "value"] == 1 and v["xact_time_us", "p50"] == 1_000_000 and v["response_query_size_ratio", "p50"] == 2 and v["top_qname2_xacts", ".example.com"] == 1
    only = values(h.dns(df, h.Options(filters={"dnstap_msg_type": "auth"})))
    assert only["filtered_packets", "value"] == 2
    v1 = h.dns_v1(df, h.Options(enable=["all"]))
    assert values(v1)["xact_in_total", "value"] == 1 and reports.dns_header(v1).first().queries_pct == 50


def test_policy(spark):
    taps = {"a": {"packets": packets(spark)}, "b": {"packets": packets(spark)}}
    p = policy.Policy("p1", [policy.HandlerSpec("net_v1")], window={"num_periods": 2})
    assert values(policy.run_policy(p, taps))["total", "value"] == 6
    assert values(policy.run_policy(p, taps, by_tap=True), tap="b")["total", "value"] == 3
    with pytest.raises(policy.PolicyError):
        policy.run_policy(policy.Policy("p", [policy.HandlerSpec("odd")]), taps)
    policy.register_handler("odd", lambda events, o: h.bgp(events.withColumn("msg_type", F.lit("OPEN")), o))
    assert [policy.coerce(x) for x in ("12", "TRUE", "x")] == [12, True, "x"]


def test_sinks(spark, tmp_path):
    m = h.net(packets(spark), h.Options(enable=["all"]))
    lines = {r.line for r in sinks.to_prometheus(m).collect()}
    assert '# TYPE net_payload_size_bytes summary' in lines and 'net_payload_size_bytes_sum{dir="out",policy="default"} 300' in lines and 'net_payload_size_bytes{dir="out",policy="default",quantile="0.5"} 300' in lines
    sinks.write_prometheus(m, str(tmp_path / "prom"))
    doc = json.loads(sinks.to_document(m).first().document)
    assert doc["default"]["net"]["net"]["out"]["tcp_packets"] == 1 and doc["default"]["net"]["net"]["out"]["top_ipv4_packets"] == [{"name": "3.3.3.3", "estimate": 1}] and doc["default"]["net"]["net"]["out"]["payload_size_bytes"]["p50"] == 300
    geo = spark.createDataFrame([(16843009, 16843009, "EU/DE", "52.5", "13.4")], SCHEMAS["geo_ranges_v4"])
    placed = json.loads(sinks.to_document(h.net(packets(spark), h.Options(enable=["all"]), h.Dimensions(geo_v4=geo)), geo).first().document)["default"]["net"]["net"]["in"]["top_geo_loc_packets"]
    assert placed == [{"name": "EU/DE", "estimate": 1, "lat": "52.5", "lon": "13.4"}]
    assert values(m)["num_events", "value"] == 3 and values(m)["num_samples", "value"] == 3
    flat = {r.path: r.value for r in sinks.flatten_document(spark.createDataFrame([('{"top_x":[{"name":"a","estimate":3}]}',)], "document string")).collect()}
    assert flat == {"top_x_0_name": "a", "top_x_0_estimate": "3"}
    sinks.write_metric_table(m, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == m.count()
    probe = h.netprobe(spark.createDataFrame([("s", t(0), "x", "tcp", "send", 1, None, 0), ("s", t(1), "x", "tcp", "recv", 1, None, 1)], SCHEMAS["probes"]))
    hist = sinks.to_otel_rows(probe).where("type = 'histogram'").first()
    assert hist["value"] == 1 and hist["buckets"][-1]["bound"] == "+Inf" and hist["buckets"][0]["count"] == 1


def test_all_policies_and_summary(spark):
    m = h.net_v1(packets(spark))
    assert reports.all_policies(m).count() > 0 and reports.all_policies(m, 1).count() == 0
    assert reports.summary_report({"net": h.net_v1}, {"net": packets(spark)}, h.Options()).count() > 0
