"""Metrics of each protocol. A handler takes its event table and options and returns the long-form metric table.

Every event counts in ``num_events``; filtered rows add to ``filtered`` only. Deep metrics see rows with the
sampling flag only. Grouping is by stream-independent dimensions: direction, device and interface, or target.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce, wraps
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import conversation_key, ip_summarize
from ..functions.codes import dnstap_event_time, dnstap_is_response, dnstap_packet_direction, dnstap_xact_direction, dscp_name, ecn_name, qtype_name, rcode_name, transport_name
from ..functions.dns import aggregate_domain, metric_port, response_ratio, xact_direction
from ..functions.flow import deep_flag, explode_flow_records, first_ip_roles, flow_directions
from ..operators.filters import DnsFilter, FlowFilter, NetFilter, from_options, metric_groups
from ..operators.lookup import asn_lookup, enrich_devices, geo_lookup, join_services
from ..operators.metrics import FEW, Cardinality, Counter, Histogram, Metric, Quantile, Rate, TopN, among, clamped_running_total, delta_sum, metric_table, row_size
from ..operators.pairing import due_starts, match_leases, match_probes, pair_transactions, propagate_query_filter, purge_timeouts
from ..operators.periods import as_one, assign_periods, merged_periods, slow_rows
from ..storage import written


@dataclass
class Options:
    """What a policy sets for a handler. ``filters`` are the handler's own options."""

    policy: str = "default"
    origin: str = "epoch"
    deep_sample_rate: int = 100
    num_periods: int = 5
    topn_count: int = 10
    topn_percentile_threshold: int = 0
    enable: Sequence[str] = ()
    disable: Sequence[str] = ()
    mode: str = "exact"
    filters: dict = field(default_factory=dict)
    dims: Sequence[str] = ()
    only: Sequence[str] = ()  # of the metrics of the groups that are on, these alone; empty: all
    event_counts: bool = True
    merge: int = 1  # report so many of the newest periods as one
    known: DataFrame | None = None  # these periods, once a handler has seen its events


@dataclass
class Dimensions:
    """Dimension tables a handler may use; a metric whose table is missing is absent."""

    geo_v4: DataFrame | None = None
    geo_v6: DataFrame | None = None
    asn_v4: DataFrame | None = None
    asn_v6: DataFrame | None = None
    services: DataFrame | None = None
    devices: DataFrame | None = None
    interfaces: DataFrame | None = None


def _on(metrics: list[Metric], groups: set[str]) -> list[Metric]:
    return [m for m in metrics if m.group is None or all(g in groups for g in m.group.split("+"))]


def _merged(df: DataFrame, o: Options) -> DataFrame:
    return df if o.known is None else as_one(df, F.broadcast(o.known))  # ten rows at most


def _table(df: DataFrame, metrics: list[Metric], o: Options, handler: str, schema: str, dims: Sequence[str] = (), merged: bool = False, at: Sequence[str] | None = None, groups: DataFrame | None = None, mixed: bool = False) -> DataFrame:
    df, groups = (df, groups) if merged else (_merged(df, o), groups if groups is None else _merged(groups, o))
    metrics = [m for m in metrics if not o.only or m.name in o.only]
    return metric_table(df, metrics, handler=handler, schema=schema, policy=o.policy, dims=[*o.dims, *dims], topn=o.topn_count, threshold=o.topn_percentile_threshold, mode=o.mode, at=at, groups=groups, mixed=mixed)


def _prepared(df: DataFrame, o: Options, key: Sequence[str] = ("stream", "seq")) -> DataFrame:
    """Periods and the deep flag."""
    stream = "stream" if "stream" in df.columns else None
    out = assign_periods(df, origin=o.origin, stream=stream, seq="seq" if o.origin == "activity" else None)
    return out.withColumn("deep", deep_flag(o.deep_sample_rate, *[F.col(k) for k in key if k in df.columns]))


def event_metrics(df: DataFrame, o: Options, handler: str, schema: str) -> DataFrame:
    """What every handler counts of all its events, filtered ones too."""
    return _table(df, [Counter("num_events"), Counter("num_samples", where=F.col("deep")), Rate("events_rate")], o, handler, schema)


def counted(handler: str, schema: str):
    """Adds the event counts of all input rows to what a handler returns."""

    def wrap(fn):
        @wraps(fn)
        def run(events: DataFrame, *args, **options) -> DataFrame:
            o = options.pop("o", None) or next((a for a in args if isinstance(a, Options)), None) or Options()
            if o.merge > 1:
                o = replace(o, known=merged_periods(_prepared(events, o), o.merge, o.num_periods))
            args = [a for a in args if not isinstance(a, Options)]
            named = {p: a for p, a in zip([p for p in list(signature(fn).parameters)[1:] if p != "o"], args)}
            out = fn(events, o=o, **named, **options)
            return out.unionByName(event_metrics(_prepared(events, o), o, handler, schema)) if o.event_counts else out

        return run

    return wrap


@counted("net", "net")
def net(packets: DataFrame, o: Options | None = None, d: Dimensions | None = None) -> DataFrame:
    """Packets by direction."""
    o, d = o or Options(), d or Dimensions()
    groups, flt = metric_groups("net", o.enable, o.disable), from_options(NetFilter, o.filters)
    df = _prepared(packets, o).withColumn("peer", F.when(F.col("dir") == "in", F.col("src_ip")).when(F.col("dir") == "out", F.col("dst_ip")))
    geo, asn = d.geo_v4 is not None, d.asn_v4 is not None
    df = geo_lookup(df, "peer", d.geo_v4, out="peer_location", ranges_v6=d.geo_v6) if geo else df.withColumn("peer_location", F.lit(None).cast("string"))
    df = asn_lookup(df, "peer", d.asn_v4, out="peer_asn", ranges_v6=d.asn_v6) if asn else df.withColumn("peer_asn", F.lit(None).cast("string"))
    df = df.withColumn("keep", F.coalesce(flt.keep(), F.lit(False)))
    kept, deep = F.col("keep"), F.col("deep")
    l4 = F.coalesce(F.col("l4"), F.lit(""))
    by_row = among(kept, [
        Counter("udp_packets", "counters", l4 == "udp"), Counter("tcp_packets", "counters", l4 == "tcp"), Counter("other_l4_packets", "counters", ~l4.isin("udp", "tcp")),
        Counter("ipv4_packets", "counters", F.col("l3") == "ipv4"), Counter("ipv6_packets", "counters", F.col("l3") == "ipv6"),
        Counter("tcp_syn_packets", "counters", deep & (l4 == "tcp") & F.coalesce(F.col("syn"), F.lit(False))), Counter("total_packets", "counters"),
        Quantile("payload_size_bytes", "quantiles", deep, F.col("bytes")), Rate("rates_pps", "quantiles"), Rate("rates_bps", "quantiles", weight=F.col("bytes")),
    ])
    whole = [Counter("filtered_packets", "counters", ~kept, whole=True), Counter("observed_packets", "counters", whole=True), Counter("deep_sampled_packets", "counters", deep, whole=True), Rate("rates_observed_pps", whole=True)]
    out = _table(df, _on([*by_row, *whole], groups), o, "net", "net", ["dir"])
    roles = df.where("keep and deep").withColumn("ip", F.explode(first_ip_roles(F.col("dir"), F.col("src_ip"), F.col("dst_ip"))))
    if geo:
        roles = geo_lookup(roles, "ip", d.geo_v4, out="ip_location", ranges_v6=d.geo_v6)
    if asn:
        roles = asn_lookup(roles, "ip", d.asn_v4, out="ip_asn", ranges_v6=d.asn_v6)
    by_ip = _on([
        Cardinality("cardinality_ips", "cardinality", item=F.col("ip")), TopN("top_ipv4_packets", "top_ips", F.col("l3") == "ipv4", F.col("ip")), TopN("top_ipv6_packets", "top_ips", F.col("l3") == "ipv6", F.col("ip")),
        *([TopN("top_geo_loc_packets", "top_geo", item=F.col("ip_location"))] if geo else []), *([TopN("top_asn_packets", "top_geo", item=F.col("ip_asn"))] if asn else []),
    ], groups)
    return out.unionByName(_table(roles, by_ip, o, "net", "net", ["dir"])) if by_ip else out


@counted("net", "packets")
def net_v1(packets: DataFrame, o: Options | None = None, d: Dimensions | None = None) -> DataFrame:
    """Packets without dimensions, as the first version reported them."""
    o, d = o or Options(), d or Dimensions()
    groups = metric_groups("net_v1", o.enable, o.disable)
    df = _prepared(packets, o)
    deep, l4, dir = F.col("deep"), F.coalesce(F.col("l4"), F.lit("")), F.col("dir")
    metrics = [
        *[Counter(n, "counters", w) for n, w in (("udp", l4 == "udp"), ("tcp", l4 == "tcp"), ("other_l4", ~l4.isin("udp", "tcp")), ("ipv4", F.col("l3") == "ipv4"), ("ipv6", F.col("l3") == "ipv6"), ("protocol_tcp_syn", deep & (l4 == "tcp") & F.coalesce(F.col("syn"), F.lit(False))), ("in", dir == "in"), ("out", dir == "out"), ("unknown_dir", ~dir.isin("in", "out")), ("total", None), ("filtered", F.lit(False)))],
        Cardinality("cardinality_src_ips_in", "cardinality", deep & (dir == "in"), F.col("src_ip")), Cardinality("cardinality_dst_ips_out", "cardinality", deep & (dir == "out"), F.col("dst_ip")),
        Quantile("payload_size", where=deep, value=F.col("bytes")),
        Rate("rates_pps_in", where=dir == "in"), Rate("rates_pps_out", where=dir == "out"), Rate("rates_pps_total"),
        Rate("rates_bytes_in", where=dir == "in", weight=F.col("bytes")), Rate("rates_bytes_out", where=dir == "out", weight=F.col("bytes")), Rate("rates_bytes_total", weight=F.col("bytes")),
    ]
    out = _table(df, _on(metrics, groups), o, "net", "packets")
    roles = df.where("deep").withColumn("ip", F.explode(first_ip_roles(dir, F.col("src_ip"), F.col("dst_ip"), version=1)))
    tops: list[Metric] = [TopN("top_ipv4", "top_ips", F.col("l3") == "ipv4", F.col("ip")), TopN("top_ipv6", "top_ips", F.col("l3") == "ipv6", F.col("ip"))]
    if d.geo_v4 is not None:
        roles = geo_lookup(roles, "ip", d.geo_v4, out="ip_location", ranges_v6=d.geo_v6)
        tops.append(TopN("top_geoLoc", "top_geo", item=F.col("ip_location")))
    if d.asn_v4 is not None:
        roles = asn_lookup(roles, "ip", d.asn_v4, out="ip_asn", ranges_v6=d.asn_v6)
        tops.append(TopN("top_ASN", "top_geo", item=F.col("ip_asn")))
    tops = _on(tops, groups)
    return out.unionByName(_table(roles, tops, o, "net", "packets")) if tops else out


def from_dnstap(messages: DataFrame) -> DataFrame:
    """dnstap messages as DNS rows: direction, time and side come from the message type; no ECS and no CD."""
    t = F.col("msg_type")
    return messages.select(
        "stream", dnstap_event_time(t, F.col("query_ts"), F.col("response_ts")).alias("ts"), dnstap_packet_direction(t).alias("dir"), dnstap_is_response(t).alias("is_response"), "txid", F.lit(0).cast("bigint").alias("flow_key"),
        "qname", "qtype", "rcode", "aa", "ad", F.lit(False).alias("cd"), "answer_count", "answer_types", F.lit(None).cast("string").alias("ecs"),
        F.when(F.col("socket_family") == "INET6", "ipv6").when(F.col("socket_family") == "INET", "ipv4").alias("l3"), transport_name(F.lit(None), F.col("socket_protocol")).alias("transport"),
        F.col("query_port").alias("metric_port"), "bytes", "seq", "msg_type", dnstap_xact_direction(t).alias("xact_dir"), F.when(dnstap_is_response(t), F.col("query_ts")).alias("stated_query_ts"),
    )


def dns_messages(dns: DataFrame, o: Options) -> DataFrame:
    """DNS messages with ports, sides, periods and the deep flag."""
    df = dns
    if "metric_port" not in df.columns:
        # the port leaves a generator of one row, below which its test can't go to work out once more what ports are made of
        port = F.array(F.struct(metric_port(F.col("src_port"), F.col("dst_port")).alias("metric_port")))
        df = df.select("*", F.inline(port)).where("metric_port is not null")
    if "xact_dir" not in df.columns:
        df = df.withColumn("xact_dir", xact_direction(F.col("dir"), F.col("is_response")))
    return _prepared(df, o, ("stream", "xact_dir", "flow_key", "txid"))


def dns_placed(messages: DataFrame, d: Dimensions) -> DataFrame:
    """:func:`dns_messages` with lower-case names and places of clients."""
    df = messages.withColumn("qname_lower", F.lower("qname"))
    df = geo_lookup(df, "ecs", d.geo_v4, out="ecs_location", ranges_v6=d.geo_v6) if d.geo_v4 is not None else df.withColumn("ecs_location", F.lit(None).cast("string"))
    return asn_lookup(df, "ecs", d.asn_v4, out="ecs_asn", ranges_v6=d.asn_v6) if d.asn_v4 is not None else df.withColumn("ecs_asn", F.lit(None).cast("string"))


def dns_rows(dns: DataFrame, o: Options, d: Dimensions) -> DataFrame:
    """DNS messages with ports, sides, places, periods and the deep flag."""
    return dns_placed(dns_messages(dns, o), d)


_CARRY = ["bytes", "cd", "ecs", "ecs_location", "ecs_asn", "ts"]
_SLOT = ["stream", "xact_dir", "flow_key", "txid"]


def _late(purged: DataFrame) -> DataFrame:
    """``timed_out_start``, the period in which a row counts as a timeout: a purged query in the one that the shift opens
    (``opened``), a late response in its own."""
    return purged.withColumn("timed_out_start", F.when(F.col("status") == "purged", F.col("opened")).when(F.col("status") == "timed_out", F.col("period_start")))


def _shifted(rows: DataFrame, messages: DataFrame, ttl_ms: int) -> DataFrame:
    """Rows, not paired yet, with the period shift that purges a query: ``opened`` is the period that it opens.

    A shift happens at the first event of a period. One pass of the messages gives the starts and the hours in which
    queries fall due.
    """
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    due = sec + ttl_ms // 1000
    firsts = messages.groupBy(F.col("stream").alias("_stream"), F.col("period_start").alias("opened"), F.floor(due / 3600)).agg(F.min(sec).alias("start"), F.min(due).alias("_due"))
    firsts = written(firsts.select("_stream", "opened", "start", "_due"), "shifts")
    starts = firsts.groupBy("_stream", "opened").agg(F.min("start").alias("start")).select("_stream", "start", "opened")
    return due_starts(rows, starts, "is_response", ttl_ms=ttl_ms, stream="stream", asked=firsts.select("_stream", "_due"))


def _purged(paired: DataFrame, ttl_ms: int) -> DataFrame:
    """Rows of :func:`_shifted`, paired since, with what the shifts purge."""
    return _late(purge_timeouts(paired, None, _SLOT, "is_response", ttl_ms=ttl_ms, stream="stream"))


def _timeouts(rows: DataFrame) -> DataFrame:
    """``timeouts`` to sum by period: 0 in each row's own period, 1 in the period where it counts as a timeout."""
    at = lambda period, n: F.struct(period.alias("period_start"), F.lit(n).alias("timeouts"))
    both = F.array_compact(F.array(at(F.col("period_start"), 0), F.when(F.col("timed_out_start").isNotNull(), at(F.col("timed_out_start"), 1))))
    return rows.withColumn("_t", F.explode(both)).withColumns({"period_start": F.col("_t.period_start"), "timeouts": F.col("_t.timeouts")})


def dns_transactions(dns: DataFrame, o: Options | None = None, d: Dimensions | None = None, ttl_ms: int = 5000) -> DataFrame:
    """DNS rows with their pairing: status, elapsed_us, counted, filtered, and the query's columns on responses."""
    o, d = o or Options(), d or Dimensions()
    messages = dns_messages(dns, o)
    return dns_finished(_purged(dns_paired(_shifted(dns_placed(messages, d), messages, ttl_ms), o, ttl_ms), ttl_ms), o)


def dns_paired(rows: DataFrame, o: Options, ttl_ms: int = 5000) -> DataFrame:
    return propagate_query_filter(rows, from_options(DnsFilter, o.filters).keep(), _SLOT, "is_response", ttl_ms=ttl_ms, carry=_CARRY)


def dns_finished(purged: DataFrame, o: Options) -> DataFrame:
    """What metrics need of paired and purged rows."""
    names = aggregate_domain(F.col("qname_lower"), from_options(DnsFilter, o.filters).suffix_size())
    out = purged.withColumn("counted", F.col("counted") & (F.col("status") == "valid")).withColumn("slow_us", F.when(F.col("counted"), F.col("elapsed_us")))
    return out.withColumn("names", names).withColumn("ratio", response_ratio(F.col("bytes"), F.col("query_bytes")))


@counted("dns", "dns")
def dns(messages: DataFrame, o: Options | None = None, d: Dimensions | None = None, ttl_ms: int = 5000) -> DataFrame:
    """DNS transactions by direction."""
    o, d = o or Options(), d or Dimensions()
    rows = written(dns_transactions(messages, o, d, ttl_ms), "transactions")
    return dns_metrics(rows, o)


def dns_metrics(rows: DataFrame, o: Options) -> DataFrame:
    """The metrics of paired DNS rows (see :func:`dns_transactions`)."""
    groups = metric_groups("dns", o.enable, o.disable)
    slow = "xact_times" in groups and o.mode != "states"  # the mark of a period comes from the whole period before
    if slow:
        rows = slow_rows(rows, "slow_us", ["xact_dir"], o.mode)
    deep, rcode, qname = F.col("deep"), F.col("rcode"), F.col("qname_lower")
    nodata = (rcode == 0) & (F.coalesce(F.col("answer_count"), F.lit(0)) == 0)
    ecs = F.col("query_ecs").isNotNull()
    count = lambda n, w=None: Counter(f"{n}xacts", "counters", w)
    metrics: list[Metric] = [
        count(""), *[count(f"{t}_", F.col("transport") == t) for t in ("udp", "tcp", "dot", "doh", "dnscrypt_udp", "dnscrypt_tcp", "doq")],
        count("ipv4_", F.col("l3") == "ipv4"), count("ipv6_", F.col("l3") == "ipv6"), count("nxdomain_", rcode == 3), count("refused_", rcode == 5), count("srvfail_", rcode == 2), count("noerror_", rcode == 0), count("nodata_", nodata),
        Counter("ecs_xacts", "counters+top_ecs", deep & ecs), count("authenticated_data_", F.col("ad")), count("authoritative_answer_", F.col("aa")), count("checking_disabled_", F.col("query_cd")),
        Quantile("xact_time_us", "xact_times", deep, F.col("elapsed_us")), Histogram("xact_histogram_us", "xact_times", deep, F.col("elapsed_us")), Quantile("response_query_size_ratio", "top_size", deep, F.col("ratio")), Rate("xact_rates", "quantiles"),
        Cardinality("cardinality_qname", "cardinality", deep, qname),
        TopN("top_geo_loc_ecs_xacts", "top_ecs", deep & ecs, F.col("query_ecs_location")), TopN("top_asn_ecs_xacts", "top_ecs", deep & ecs, F.col("query_ecs_asn")), TopN("top_ecs_xacts", "top_ecs", deep & ecs, F.col("query_ecs")),
        TopN("top_qname2_xacts", "top_qnames", deep, F.col("names.qname2")), TopN("top_qname3_xacts", "top_qnames", deep & (F.col("names.qname3") != ""), F.col("names.qname3")),
        *[TopN(f"top_{n}_xacts", "top_rcodes", deep & w, qname) for n, w in (("nxdomain", rcode == 3), ("refused", rcode == 5), ("srvfail", rcode == 2), ("nodata", nodata), ("noerror", rcode == 0))],
        TopN("top_response_bytes", "top_size", deep, qname, F.col("bytes")), TopN("top_udp_ports_xacts", "top_ports", deep & (F.col("metric_port") > 0), F.col("metric_port")),
        TopN("top_qtype_xacts", "top_qtypes", deep, qtype_name(F.col("qtype"))), TopN("top_rcode_xacts", "top_rcodes", deep, rcode_name(rcode)), *([TopN("top_slow_xacts", "xact_times", deep & F.col("is_slow"), qname)] if slow else []),
    ]
    late = [Counter("orphan_responses", "counters", F.col("status") == "orphan"), Counter("filtered_packets", "counters", weight=F.col("filtered"), whole=True), Counter("observed_packets", whole=True)]
    out = _table(rows, _on([*among(F.col("counted"), metrics), *late], groups), o, "dns", "dns", ["xact_dir"])
    late = _on([Counter("timeout_queries", "counters", weight=F.col("timeouts"))], groups)
    return out.unionByName(_table(_timeouts(rows), late, o, "dns", "dns", ["xact_dir"])) if late else out


@counted("dns", "dns")
def dns_v1(messages: DataFrame, o: Options | None = None, d: Dimensions | None = None, ttl_ms: int = 5000, paired: DataFrame | None = None) -> DataFrame:
    """DNS wire packets and transactions without dimensions, as the first version reported them.

    ``paired``: what :func:`dns_transactions` gives of the same messages, without filters, if it is at hand already.
    """
    o, d = o or Options(), d or Dimensions()
    if paired is not None and o.filters:
        raise ValueError("pairs of unfiltered messages are not those of filtered ones")
    o = replace(o, filters={**o.filters, "version": 1})
    groups, flt = metric_groups("dns_v1", o.enable, o.disable), from_options(DnsFilter, o.filters)
    rows = dns_messages(messages, o)
    df = dns_placed(rows, d).withColumn("keep", F.coalesce(flt.keep(), F.lit(False))).withColumn("names", aggregate_domain(F.col("qname_lower"), flt.suffix_size()))
    deep, rcode, qname, reply = F.col("deep"), F.col("rcode"), F.col("qname_lower"), F.col("is_response")
    nodata = reply & (rcode == 0) & (F.coalesce(F.col("answer_count"), F.lit(0)) == 0)
    ecs = F.col("ecs").isNotNull() & ~reply
    wire = lambda n, w=None: Counter(f"wire_packets_{n}", "counters", w)
    metrics: list[Metric] = [
        wire("queries", ~reply), wire("replies", reply), *[wire(t, F.col("transport") == t) for t in ("udp", "tcp", "dot", "doh")], wire("ipv4", F.col("l3") == "ipv4"), wire("ipv6", F.col("l3") == "ipv6"),
        wire("nxdomain", reply & (rcode == 3)), wire("refused", reply & (rcode == 5)), wire("srvfail", reply & (rcode == 2)), wire("noerror", reply & (rcode == 0)), wire("nodata", nodata), wire("total"),
        Counter("wire_packets_query_ecs", "counters+top_ecs", deep & ecs), Cardinality("cardinality_qname", "cardinality", deep, qname),
        TopN("top_geoLoc_ecs", "top_ecs", deep & ecs, F.col("ecs_location")), TopN("top_asn_ecs", "top_ecs", deep & ecs, F.col("ecs_asn")), TopN("top_query_ecs", "top_ecs", deep & ecs, F.col("ecs")),
        TopN("top_qname2", "top_qnames", deep, F.col("names.qname2")), TopN("top_qname3", "top_qnames", deep & (F.col("names.qname3") != ""), F.col("names.qname3")),
        *[TopN(f"top_{n}", g, deep & reply & w, qname) for n, g, w in (("nxdomain", "top_qnames", rcode == 3), ("refused", "top_qnames", rcode == 5), ("srvfail", "top_qnames", rcode == 2), ("nodata", "top_qnames", nodata), ("noerror", "top_qnames_details", rcode == 0))],
        TopN("top_qname_by_resp_bytes", "top_qnames_details", deep & reply, qname, F.col("bytes")), TopN("top_udp_ports", "top_ports", deep & (F.col("metric_port") > 0), F.col("metric_port")),
        TopN("top_qtype", None, deep, qtype_name(F.col("qtype"))), TopN("top_rcode", None, deep & reply, rcode_name(rcode)), Rate("rates_total"),
    ]
    out = _table(df, [*_on(among(F.col("keep"), metrics), groups), wire("filtered", ~F.col("keep"))], o, "dns", "dns")
    if not {"dns_transaction", "quantiles", "histograms"} & groups:
        return out
    if paired is None:
        kept = (df if flt.places else rows).where(flt.keep()).select(*dict.fromkeys([*_SLOT, "ts", "seq", "is_response", "bytes", "qname", "period_start", "period_len", "deep", *o.dims]))
        paired = pair_transactions(_shifted(kept, rows, ttl_ms), _SLOT, "is_response", ttl_ms=ttl_ms, carry=["bytes"])
        paired = written(_purged(paired, ttl_ms).drop("flow_key", "txid", "seq", "purged_at", "opened"), "transactions")
    valid = paired.where("is_response and status = 'valid'")
    if "dns_transaction" in groups:
        valid = slow_rows(valid, "elapsed_us", ["xact_dir"], o.mode)
    valid = valid.withColumn("ratio", response_ratio(F.col("bytes"), F.col("query_bytes")))
    went, came, t = F.col("xact_dir") == "out", F.col("xact_dir") == "in", F.col("elapsed_us")
    pairs: list[Metric] = [
        Counter("xact_counts_total", "dns_transaction"), Counter("xact_in_total", "dns_transaction", came), Counter("xact_out_total", "dns_transaction", went),
        Quantile("xact_out_quantiles_us", "quantiles", deep & went, t), Quantile("xact_in_quantiles_us", "quantiles", deep & came, t), Histogram("xact_out_histogram_us", "histograms", deep & went, t), Histogram("xact_in_histogram_us", "histograms", deep & came, t),
        Quantile("xact_ratio_quantiles", "quantiles", deep, F.col("ratio")),
        *([TopN(f"xact_{n}_top_slow", "dns_transaction", deep & way & F.col("is_slow"), F.col("qname")) for n, way in (("in", came), ("out", went))] if "dns_transaction" in groups else []),
    ]
    pairs = _on(pairs, groups)
    if pairs:
        out = out.unionByName(_table(valid, pairs, o, "dns", "dns"))
    late = _on([Counter("xact_counts_timed_out", "dns_transaction", weight=F.col("timeouts"))], groups)
    return out.unionByName(_table(_timeouts(paired), late, o, "dns", "dns")) if late else out


@dataclass
class Summaries:
    """How flow addresses are summarised."""

    by_asn: bool = False
    exclude_asns: Sequence[str] = ()
    exclude_unknown: bool = False
    exclude_ips: Sequence[str] = ()
    subnets: Sequence[str] = ()

    def of(self, ip: Column, asn: Column | None) -> Column:
        return ip_summarize(ip, asn=asn, exclude_ips=self.exclude_ips, exclude_asns=self.exclude_asns, exclude_unknown=self.exclude_unknown, subnets=self.subnets, by_asn=self.by_asn)


def _flow_rows(exports: DataFrame, o: Options, d: Dimensions, summaries: Summaries, scale: bool, places: bool) -> DataFrame:
    """Records with filters, service names and summarised addresses; ``places`` are looked up where nothing but tops of places needs them, too."""
    flt = from_options(FlowFilter, o.filters)
    r = _prepared(explode_flow_records(exports, scale), o, ("device_ip", "seq", "record"))
    named = d.services is not None and "top_ports" in metric_groups("flow", o.enable, o.disable)
    for side in ("src", "dst"):
        for table, six, lookup, out, asked in ((d.geo_v4, d.geo_v6, geo_lookup, "location", flt.geoloc_notfound), (d.asn_v4, d.asn_v6, asn_lookup, "asn", flt.asn_notfound or summaries.by_asn)):
            if table is not None and (places or asked):
                r = lookup(r, f"{side}_ip", table, out=f"{side}_{out}", ranges_v6=six)
            else:
                r = r.withColumn(f"{side}_{out}", F.lit(None).cast("string"))
        r = join_services(r, f"{side}_port", "l4", d.services, out=f"{side}_service") if named else r
        r = r.withColumn(f"{side}_name", summaries.of(F.col(f"{side}_ip"), F.col(f"{side}_asn") if d.asn_v4 is not None else None))
    r = r.withColumns({s: flt.interface(s) for s in ("if_in", "if_out")})
    return r.withColumn("keep", flt.keep())


def _flow_ends(r: DataFrame) -> DataFrame:
    """Records with their endpoints and kinds of service as text; ports without names are their numbers, which travel as such."""
    r = r.withColumns({f"{side}_service": F.col(f"{side}_port").cast("string") for side in ("src", "dst") if f"{side}_service" not in r.columns})
    r = r.withColumns({f"{side}_end": F.concat_ws(":", f"{side}_name", f"{side}_service") for side in ("src", "dst")})
    r = r.withColumns({"dscp": dscp_name(F.col("tos")), "ecn": ecn_name(F.col("tos"))})
    return r.withColumn("conversation", conversation_key(F.col("src_end"), F.col("dst_end"), F.col("src_port"), F.col("dst_port")))


def flow_records(exports: DataFrame, o: Options, d: Dimensions, summaries: Summaries, scale: bool = True) -> DataFrame:
    """Records with filters, lookups, service names and summarised endpoints."""
    return _flow_ends(_flow_rows(exports, o, d, summaries, scale, True)).drop("dscp", "ecn")


def flow_kept(exports: DataFrame, kinds: dict[str, dict], d: Dimensions | None = None, scale: bool = True) -> DataFrame:
    """Records with a column for each named set of filter options, whether it keeps them: the ``keep`` of :func:`flow_records`,
    of all sets in one pass. Places and numbers are looked up if a set asks for those not found."""
    d, r = d or Dimensions(), explode_flow_records(exports, scale)
    filters = {n: from_options(FlowFilter, options) for n, options in kinds.items()}
    for side in ("src", "dst"):
        for table, six, lookup, out, asked in ((d.geo_v4, d.geo_v6, geo_lookup, "location", "geoloc_notfound"), (d.asn_v4, d.asn_v6, asn_lookup, "asn", "asn_notfound")):
            if table is not None and any(getattr(f, asked) for f in filters.values()):
                r = lookup(r, f"{side}_ip", table, out=f"{side}_{out}", ranges_v6=six)
            else:
                r = r.withColumn(f"{side}_{out}", F.lit(None).cast("string"))
    return r.withColumns({n: f.keep(f.interface("if_in"), f.interface("if_out")) for n, f in filters.items()})


@counted("flow", "flow")
def flow(exports: DataFrame, o: Options | None = None, d: Dimensions | None = None, summaries: Summaries | None = None, scale: bool = True) -> DataFrame:
    """Flows by device, and by device and interface."""
    o, d, summaries = o or Options(), d or Dimensions(), summaries or Summaries()
    groups = metric_groups("flow", o.enable, o.disable)
    rows = _flow_rows(exports, o, d, summaries, scale, False)
    devices = d.devices is not None and d.interfaces is not None

    def sides(r: DataFrame) -> DataFrame:
        s = flow_directions(r.where("keep"))
        s = enrich_devices(s, d.devices, d.interfaces) if devices else s.withColumns({"device_name": F.col("device_ip"), "interface_name": F.col("interface").cast("string")})
        return s.withColumnsRenamed({"device_name": "device", "interface_name": "device_interface"})

    deep, dims = F.col("deep"), ["device", "device_interface"]
    # metrics of few items, and of the items that an end or a conversation has
    by_interface: dict[str, list[Metric]] = {"": [], "src": [], "dst": [], "conversation": []}
    for metric in ("bytes", "packets"):
        w, g = F.col(metric), f"by_{metric}"
        for dir in ("in", "out"):
            mine = F.col("dir") == dir
            for n, test in (("udp", F.col("l4") == "udp"), ("tcp", F.col("l4") == "tcp"), ("other_l4", F.col("l4") == "other"), ("ipv4", F.col("l3") == "ipv4"), ("ipv6", F.col("l3") == "ipv6")):
                by_interface[""].append(Counter(f"{dir}_{n}_{metric}", f"counters+{g}", mine & test, w))
            by_interface[""].append(Counter(f"{dir}_{metric}", f"counters+{g}", mine, w))
            at = deep & mine
            for side in ("src", "dst"):
                port = at & (F.col(f"{side}_port") > 0)
                by_interface[side] += [TopN(f"top_{dir}_{side}_ips_{metric}", f"top_ips+{g}", at, F.col(f"{side}_name"), w), TopN(f"top_{dir}_{side}_ip_ports_{metric}", f"top_ips_ports+{g}", port, F.col(f"{side}_end"), w)]
                by_interface[""].append(TopN(f"top_{dir}_{side}_ports_{metric}", f"top_ports+{g}", port, F.col(f"{side}_service"), w))
            by_interface[""] += [TopN(f"top_{dir}_dscp_{metric}", f"top_tos+{g}", at, F.col("dscp"), w), TopN(f"top_{dir}_ecn_{metric}", f"top_tos+{g}", at, F.col("ecn"), w)]
        by_interface["conversation"].append(TopN(f"top_conversations_{metric}", f"conversations+{g}", deep, F.col("conversation"), w))
    by_interface["conversation"].append(Cardinality("cardinality_conversations", "cardinality+conversations", deep, F.col("conversation")))
    for side, dir in (("src", "in"), ("dst", "out")):
        # as the tops have them, where they are the same, so that one row serves both
        ip, port = f"{side}_name" if summaries == Summaries() else f"{side}_ip", f"{side}_service" if d.services is None else f"{side}_port"
        by_interface[side].append(Cardinality(f"cardinality_{side}_ips_{dir}", "cardinality", deep, F.col(ip)))
        by_interface[""].append(Cardinality(f"cardinality_{side}_ports_{dir}", "cardinality", deep & (F.col(f"{side}_port") > 0), F.col(port)))
    by_interface = {n: [m for m in _on(metrics, groups) if not o.only or m.name in o.only] for n, metrics in by_interface.items()}
    out = _flow_by_interface(rows, by_interface, sides, o, dims, d.services)
    tops = _on([TopN(f"top_{n}_{m}", f"top_geo+by_{m}", item=F.col(f"end.{c}"), weight=F.col(m)) for m in ("bytes", "packets") for n, c, t in (("geo_loc", "location", d.geo_v4), ("asn", "asn", d.asn_v4)) if t is not None], groups)
    if tops:
        ends = sides(_flow_rows(exports, o, d, summaries, scale, True)).where("deep").withColumn("end", F.explode(F.array(F.struct(F.col("src_location").alias("location"), F.col("src_asn").alias("asn")), F.struct(F.col("dst_location").alias("location"), F.col("dst_asn").alias("asn")))))
        out = out.unionByName(_table(ends, tops, o, "flow", "flow", dims))
    if devices:
        r = enrich_devices(rows, d.devices, d.interfaces, interface="if_in").withColumnRenamed("device_name", "device").withColumnRenamed("interface_name", "in_name")
        r = enrich_devices(r, d.devices, d.interfaces, interface="if_out").drop("device_name").withColumnRenamed("interface_name", "out_name")
    else:
        r = rows.withColumns({"device": F.col("device_ip"), "in_name": F.col("if_in").cast("string"), "out_name": F.col("if_out").cast("string")})
    by_device = _on([
        Counter("records_flows", "counters", F.col("keep")), Counter("records_filtered", "counters", ~F.col("keep")),
        *[TopN(f"top_{dir}_interfaces_{m}", f"top_interfaces+by_{m}", F.col("keep") & deep, F.col(f"{dir}_name"), F.col(m)) for m in ("bytes", "packets") for dir in ("in", "out")],
    ], groups)
    return out.unionByName(_table(r, by_device, o, "flow", "flow", ["device"])) if by_device else out


#: Records of a task that adds up items.
FLOWS_A_TASK = 100_000


def _flow_by_interface(rows: DataFrame, metrics: dict[str, list[Metric]], sides: Callable[[DataFrame], DataFrame], o: Options, dims: Sequence[str], services: DataFrame | None) -> DataFrame:
    """Metrics by device and interface. Nearly every record has items of its own, so records travel once and not a row
    for each item: to the task of their device and period, or, where one of these has more than a task takes, to those of
    their source, of their destination and of their conversation; metrics of few items are summed before a shuffle then.
    Records are counted for this."""
    table = lambda r, some, **how: _table(sides(_flow_ends(r)), some, o, "flow", "flow", dims, **how)
    every, ends = [m for some in metrics.values() for m in some], [n for n in ("src", "dst", "conversation") if metrics[n]]
    # an endpoint as text names its address if no service has a colon
    if o.mode != "exact" or not ends or services is not None and not services.where(F.col("name").contains(":")).isEmpty():
        return table(rows, every)
    n, largest = rows.where("keep").groupBy("period_start", "device_ip").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = n // FLOWS_A_TASK + 1
    if largest <= FLOWS_A_TASK:
        own = rows.where("keep").repartition(tasks, "period_start", "device_ip")
        parts = [every] if row_size(every) <= FEW else [some for some in metrics.values() if some]
        return reduce(DataFrame.unionByName, [table(own, some, at=[]) for some in parts])
    parts = [table(rows, metrics[""], mixed=True)] if metrics[""] else []
    for n in ends:
        kept = rows.where("keep")
        item = _flow_ends(kept).select("*", F.col("conversation").alias("_item")) if n == "conversation" else kept.withColumn("_item", F.col(f"{n}_name"))
        # part of an item's hash, so that tasks add up items of their own
        own = item.withColumn("_at", F.pmod(F.hash("_item"), F.lit(1 << 16))).repartition(tasks, "period_start", "device_ip", "_at")
        if n == "conversation":
            parts.append(_table(sides(own), metrics[n], o, "flow", "flow", dims, at=["_at"], groups=sides(rows)))
        else:
            parts.append(table(own, metrics[n], at=["_at"], groups=sides(rows)))
    return reduce(DataFrame.unionByName, parts)


@counted("dhcp", "dhcp")
def dhcp(events: DataFrame, o: Options | None = None) -> DataFrame:
    o = o or Options()
    df = _prepared(events, o)
    v4, kind = F.col("version") == 4, F.col("msg_type")
    names = {"discover": (4, "DISCOVER"), "offer": (4, "OFFER"), "request": (4, "REQUEST"), "ack": (4, "ACK"), "solicit": (6, "SOLICIT"), "advertise": (6, "ADVERTISE"), "request_v6": (6, "REQUEST"), "reply": (6, "REPLY")}
    server = F.when(v4 & (kind == "OFFER"), F.concat_ws("/", "src_mac", "server_id")).when(~v4 & kind.isin("REPLY", "ADVERTISE") & F.col("server_id").isNotNull(), F.concat_ws("/", "src_mac", "src_ip6"))
    metrics = [*[Counter(f"wire_packets_{n}", where=(F.col("version") == v) & (kind == t)) for n, (v, t) in names.items()], Counter("wire_packets_total", where=v4), Counter("wire_packets_filtered", where=F.lit(False)), TopN("top_servers", None, F.col("deep"), server), Rate("rates_total", where=v4)]
    leases = match_leases(df).where("deep and your_ip is not null")
    return _table(df, metrics, o, "dhcp", "dhcp").unionByName(_table(leases, [TopN("top_clients", item=F.col("client"))], o, "dhcp", "dhcp"))


@counted("bgp", "bgp")
def bgp(events: DataFrame, o: Options | None = None) -> DataFrame:
    o = o or Options()
    kinds = ("open", "update", "notification", "keepalive", "routerefresh")
    metrics = [*[Counter(f"wire_packets_{k}", where=F.lower("msg_type") == k) for k in kinds], Counter("wire_packets_total"), Counter("wire_packets_filtered", where=F.lit(False)), Rate("rates_total")]
    return _table(_prepared(events, o), metrics, o, "bgp", "bgp")


@counted("pcap", "pcap")
def capture(samples: DataFrame, o: Options | None = None) -> DataFrame:
    """Health of a capture: errors, and the increases of its drop counters."""
    o = o or Options()
    df = _prepared(samples, o)
    out = _table(df, [Counter("tcp_reassembly_errors", where=F.coalesce(F.col("tcp_error"), F.lit(False)))], o, "pcap", "pcap")
    for name in ("os_drops", "if_drops"):
        d = delta_sum(df, name, ["stream", "period_start", "period_len"], ["ts", "seq"])
        out = out.unionByName(_table(d, [Counter(name, weight=F.col("delta"))], o, "pcap", "pcap"))
    return out


@counted("netprobe", "netprobe")
def netprobe(events: DataFrame, o: Options | None = None, ttl_ms: int = 2000) -> DataFrame:
    o = o or Options()
    groups = metric_groups("netprobe", o.enable, o.disable)
    df = _prepared(events, o)
    error = F.lower(F.col("error"))
    counts = [
        Counter("attempts", "counters", F.col("event") == "send"), Counter("connect_failures", "counters", (F.col("event") == "fail") & error.isin("socket", "invalid_ip", "connect")),
        Counter("dns_lookup_failures", "counters", (F.col("event") == "fail") & (error == "dns")),
    ]
    paired = match_probes(df, ttl_ms)
    late = paired.where("status = 'timed_out'").select("period_start", "period_len", "target").unionByName(df.where((F.col("event") == "fail") & (error == "timeout")).select("period_start", "period_len", "target"))
    valid = paired.where("is_response and status = 'valid'")
    found = _on([Counter("successes", "counters"), Quantile("response_quantiles_us", "quantiles", F.col("deep"), F.col("elapsed_us")), Histogram("response_histogram_us", "histograms", F.col("deep"), F.col("elapsed_us"))], groups)
    out = _table(df, _on(counts, groups), o, "netprobe", "netprobe", ["target"]).unionByName(_table(late, [Counter("packets_timeout", "counters")], o, "netprobe", "netprobe", ["target"]))
    if "counters" in groups:
        keys = ["period_start", "period_len", "target"]
        ends = _merged(valid, o).groupBy(*keys).agg(F.min("elapsed_us").alias("a"), F.max("elapsed_us").alias("b"))
        out = out.unionByName(_table(ends, [Counter("response_min_us", weight=F.col("a")), Counter("response_max_us", weight=F.col("b"))], o, "netprobe", "netprobe", ["target"], merged=True))
    return out.unionByName(_table(valid, found, o, "netprobe", "netprobe", ["target"]))


@counted("input_resources", "input_resources")
def resources(samples: DataFrame, changes: DataFrame, o: Options | None = None) -> DataFrame:
    """CPU and memory of an input, and how many policies and handlers use it."""
    o = o or Options()
    out = _table(_prepared(samples, o), [Quantile("cpu_usage", value=F.col("cpu_pct")), Quantile("memory_bytes", value=F.col("mem_bytes"))], o, "input_resources", "input_resources")
    df = _prepared(changes, o)
    for name, delta in (("policy_count", "policy_delta"), ("handler_count", "handler_delta")):
        totals = clamped_running_total(df, delta, ["stream"], ["ts"])
        last = totals.groupBy("stream", "period_start", "period_len").agg(F.max_by("total", "ts").alias("total"))
        out = out.unionByName(_table(last, [Counter(name, weight=F.col("total"))], o, "input_resources", "input_resources"))
    return out


HANDLERS = {"net": net, "net_v1": net_v1, "dns": dns, "dns_v1": dns_v1, "flow": flow, "dhcp": dhcp, "bgp": bgp, "pcap": capture, "netprobe": netprobe, "input_resources": resources}
__all__ = ["HANDLERS", "Dimensions", "Options", "Summaries"]
