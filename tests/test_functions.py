"""Golden values of the row-level expressions."""

import pytest
from pyspark.sql import functions as F

from meterline.functions import addresses, codes, dns, flow
from meterline.operators.metrics import histogram_bound

DOMAINS = [
    ("biz.foo.bar.com", 0, ".bar.com", ".foo.bar.com"), ("a.com", 0, "a.com", ""), ("abcdefg.com.", 0, "abcdefg.com.", ""), ("foo.bar.com", 0, ".bar.com", "foo.bar.com"), (".", 0, ".", ""), ("..", 0, "..", ""), ("a", 0, "a", ""),
    ("a.", 0, "a.", ""), ("foo.bar.com.", 0, ".bar.com.", "foo.bar.com."), (".foo.bar.com", 0, ".bar.com", ".foo.bar.com"), ("a.b.c", 0, ".b.c", "a.b.c"), (".b.c", 0, ".b.c", ""),
    ("biz.foo.bar.com", 8, ".foo.bar.com", "biz.foo.bar.com"), ("biz.foo.bar.com", 7, ".foo.bar.com", "biz.foo.bar.com"), ("biz.foo.bar.com", 11, "biz.foo.bar.com", ""), ("foo.bar.com.", 15, ".bar.com.", "foo.bar.com."),
    ("www.google.co.uk", 6, ".google.co.uk", "www.google.co.uk"), ("www.google.co.uk", 12, "www.google.co.uk", ""),
]


def test_aggregate_domain(spark):
    df = spark.createDataFrame(DOMAINS, "q string, n int, a string, b string")
    got = df.select("q", "n", "a", "b", dns.aggregate_domain(F.col("q"), F.col("n")).alias("r")).collect()
    assert [(r.q, r.n, r.r.qname2, r.r.qname3) for r in got] == DOMAINS


def test_histogram_bounds(spark):
    ints = spark.createDataFrame([(12,), (8,), (0,), (-3,), (1,)], "v bigint").select(histogram_bound(F.col("v"))).collect()
    assert [r[0] for r in ints] == [12.0, 8.0, 0.0, 0.0, 1.0]
    doubles = spark.createDataFrame([(8.5,), (12.0,)], "v double").select(histogram_bound(F.col("v"), integer=False)).collect()
    assert [round(r[0], 6) for r in doubles] == [8.799225, 12.915497]


def test_subnets(spark):
    df = spark.createDataFrame([("192.168.1.5",), ("0.0.0.0",), ("2001:7f8:1::a506:2597:1",), ("10.1.2.3",), ("not an ip",), (None,)], "ip string")
    match = addresses.cidr_match(F.col("ip"), ["192.168.0.0/23", "2001:7f8:1::/48", "10.0.0.0/7", "0.0.0.0/0", "::/0"])
    assert [r[0] for r in df.select(match).collect()] == ["192.168.0.0/23", None, "2001:7f8:1::/48", "10.0.0.0/7", None, None]
    assert [r[0] for r in df.select(addresses.cidr_truncate(F.col("ip"), 22)).collect()] == ["192.168.0.0/22", "0.0.0.0/22", "2001:400::/22", "10.1.0.0/22", None, None]
    for bad in ("1.2.3.4", "1.2.3.4/x", "1.2.3.4/33", "::1/129", "1.2.3/8"):
        with pytest.raises(ValueError):
            addresses.parse_subnets([bad])


def test_ipv6_text(spark):
    import ipaddress

    ips = ["::", "::1", "2001:db8::1:0:0:1", "1:2:3:4:5:6:7:8", "fe80:0:0:1::", "1:0:0:2:0:0:0:3"]
    got = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", addresses.ipv6_text(addresses.ipv6_hex(F.col("ip"))).alias("t")).collect()
    assert [r.t for r in got] == [str(ipaddress.ip_address(r.ip)) for r in got]


def test_ip_summarize(spark):
    df = spark.createDataFrame([("10.0.0.7", "5/X"), ("10.0.1.9", "5/X"), ("10.0.2.9", "Unknown"), ("10.9.2.9", "64/Y"), ("::5", None)], "ip string, asn string")
    s = addresses.ip_summarize(F.col("ip"), asn=F.col("asn"), by_asn=True, exclude_ips=["10.0.0.7"], exclude_asns=["64"], exclude_unknown=True, subnets=["10.0.2.0/24", "0.0.0.0/16"])
    assert [r[0] for r in df.select(s).collect()] == ["10.0.0.7", "5/X", "10.0.2.0/24", "10.9.0.0/16", "::5"]
    with pytest.raises(ValueError):
        addresses.ip_summarize(F.col("ip"), subnets=["0.0.0.0/8", "0.0.0.0/16"])


def test_names(spark):
    df = spark.createDataFrame([(184, 16, 28), (3, 99, 9999)], "tos int, rcode int, qtype int")
    got = df.select(codes.dscp_name(F.col("tos")), codes.ecn_name(F.col("tos")), codes.rcode_name(F.col("rcode")), codes.qtype_name(F.col("qtype"))).collect()
    assert [tuple(r) for r in got] == [("EF", "Not-ECT", "BADVERS", "AAAA"), ("CS0", "CE", "99", "9999")]
    assert codes.rcode_number("nxdomain") == 3 and codes.qtype_number("65") == 65
    with pytest.raises(ValueError):
        codes.rcode_number("nope")


def test_directions_and_ports(spark):
    t = spark.createDataFrame([("CLIENT_QUERY",), ("RESOLVER_QUERY",), ("TOOL_RESPONSE",), ("ODD",)], "t string")
    got = t.select(codes.dnstap_packet_direction(F.col("t")), codes.dnstap_xact_direction(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("in", "in"), ("out", "out"), ("in", "out"), ("unknown", "unknown")]
    p = spark.createDataFrame([(1000, 53), (5353, 9), (1, 2)], "s int, d int").select(dns.metric_port(F.col("s"), F.col("d"))).collect()
    assert [r[0] for r in p] == [1000, 9, None]
    assert [r[0] for r in spark.createDataFrame([(5,), (99,), (443,)], "p int").select(addresses.port_in_ranges(F.col("p"), ["99-10", 443])).collect()] == [False, True, True]


def test_deep_flag_is_repeatable(spark):
    df = spark.range(20_000)
    n = df.where(flow.deep_flag(25, F.col("id"))).count()
    assert 4500 < n < 5500 and n == df.where(flow.deep_flag(25, F.col("id"))).count()
    assert df.where(flow.deep_flag(400, F.col("id"))).count() == 20_000
