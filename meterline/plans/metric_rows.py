"""Whole handlers: every metric of every group, as registered queries, each with the SQL that gives the same rows.

The SQL is put together from the definitions of the metrics (name, rows, item, weight), written anew here and not taken
from the handlers. Events run 720 times as fast as they are stamped, so a month of them is an hour of sixty periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..operators.metrics import QUANTILES
from . import handlers as h
from . import views as v
from .queries import _epoch, query
from .row_queries import _nations, _values
from .views import DNS_PURGED_SQL, FLOWS_SQL, PACKETS_SQL

SPEED = 720
#: Time to live of pairing, in seconds.
TTL = 30


def _fast(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.expr(f"timestamp_micros(unix_micros(ts) div {SPEED})"))


def _fast_sql(sql: str) -> str:
    return sql.replace("FROM events)", f"FROM (SELECT * REPLACE (make_timestamp(epoch_us(ts) // {SPEED}) AS ts) FROM events))")


def _rows(t: DataFrame, *labels: str) -> DataFrame:
    """The long form as comparable columns; bounds of histograms are whole numbers."""
    bound = (F.col("kind") == "histogram") & (F.col("stat") != "+Inf")
    stat = F.when(bound, F.col("stat").try_cast("double").cast("bigint").cast("string")).otherwise(F.col("stat"))
    return t.select(_epoch(), *[F.col("labels")[x].alias(x) for x in labels], "name", stat.alias("stat"), "value")


class Definitions:
    """SELECTs, one for each metric, over the named tables of a WITH clause."""

    def __init__(self, *dims: str):
        self.dims, self.parts = dims, []

    def _keys(self, whole: bool = False) -> str:
        return ", ".join(["period", *[f"CAST(NULL AS VARCHAR) AS {d}" if whole else d for d in self.dims]])

    def _add(self, select: str) -> Definitions:
        self.parts.append(select)
        return self

    def counters(self, source: str, named: dict[str, str], weight: str = "1", whole: bool = False) -> Definitions:
        for name, cond in named.items():
            self._add(f"SELECT {self._keys(whole)}, '{name}' AS name, 'value' AS stat, CAST(coalesce(sum({weight}) FILTER ({cond}), 0) AS DOUBLE) AS value FROM {source} GROUP BY ALL")
        return self

    def distinct(self, source: str, named: dict[str, tuple[str, str]]) -> Definitions:
        for name, (item, cond) in named.items():
            self._add(f"SELECT {self._keys()}, '{name}' AS name, 'value' AS stat, CAST(count(DISTINCT {item}) FILTER ({cond}) AS DOUBLE) AS value FROM {source} GROUP BY ALL")
        return self

    def tops(self, source: str, named: dict[str, tuple[str, str]], weight: str = "1") -> Definitions:
        for name, (item, cond) in named.items():
            sums = f"SELECT {self._keys()}, CAST({item} AS VARCHAR) AS stat, sum({weight}) AS w FROM {source} WHERE ({cond}) AND {item} IS NOT NULL GROUP BY ALL"
            ranked = f"SELECT *, row_number() OVER (PARTITION BY {self._keys()} ORDER BY w DESC, stat) AS r FROM ({sums})"
            self._add(f"SELECT {self._keys()}, '{name}' AS name, stat, CAST(w AS DOUBLE) AS value FROM ({ranked}) WHERE r <= 10")
        return self

    def quantiles(self, source: str, named: dict[str, tuple[str, str]]) -> Definitions:
        stats = [*[q for q, _ in QUANTILES], "n", "min", "max"]
        for name, (value, cond) in named.items():
            of = [*[f"quantile_disc({value}, {p})" for _, p in QUANTILES], f"count({value})", f"min({value})", f"max({value})"]
            values = ", ".join(f"CAST({x} AS DOUBLE)" for x in of)
            self._add(f"SELECT {self._keys()}, '{name}' AS name, unnest({stats}) AS stat, unnest([{values}]) AS value FROM {source} WHERE {cond} GROUP BY {self._keys()}")
        return self

    def histograms(self, source: str, named: dict[str, tuple[str, str]]) -> Definitions:
        """Needs the table ``bounds``."""
        for name, (value, cond) in named.items():
            bound = f"SELECT {self._keys()}, (SELECT min(bound) FROM bounds WHERE bound >= {value}) AS bound FROM {source} WHERE {cond}"
            counts = f"SELECT {self._keys()}, bound, count(*) AS n FROM ({bound}) GROUP BY ALL"
            self._add(f"SELECT {self._keys()}, '{name}' AS name, CAST(CAST(bound AS BIGINT) AS VARCHAR) AS stat, CAST(sum(n) OVER (PARTITION BY {self._keys()} ORDER BY bound) AS DOUBLE) AS value FROM ({counts})")
            self._add(f"SELECT {self._keys()}, '{name}' AS name, '+Inf' AS stat, CAST(count(*) AS DOUBLE) AS value FROM {source} WHERE {cond} GROUP BY ALL")
        return self

    def rates(self, source: str, named: dict[str, tuple[str, str]], clock: str, whole: bool = False) -> Definitions:
        """Percentiles over the sixty seconds of a period; ``live`` is the second before the newest one of ``clock``."""
        for name, (weight, cond) in named.items():
            seconds = f"SELECT {self._keys(whole)}, sec, CAST(sum({weight}) AS BIGINT) AS w FROM {source} WHERE {cond} GROUP BY ALL"
            keys = self._keys()
            sixty = f"SELECT {keys}, list_sort(list_concat(list(w), [0 FOR x IN range(60 - count(*))])) AS l FROM ({seconds}) GROUP BY ALL"
            self._add(f"SELECT {keys}, '{name}' AS name, unnest({[q for q, _ in QUANTILES]}) AS stat, CAST(unnest([l[30], l[54], l[57], l[60]]) AS DOUBLE) AS value FROM ({sixty})")
            open_ = f"(SELECT max(sec) - 1 AS last, max(period) AS newest FROM {clock})"
            self._add(f"SELECT {keys}, '{name}' AS name, 'live' AS stat, CAST(coalesce(sum(w) FILTER (sec = last), 0) AS DOUBLE) AS value FROM ({seconds}), {open_} WHERE period = newest AND last >= period GROUP BY ALL")
        return self

    def events(self, source: str) -> Definitions:
        """What every handler counts of all its events."""
        return self.counters(source, {"num_events": "true", "num_samples": "true"}, whole=True).rates(source, {"events_rate": ("1", "true")}, source, whole=True)

    def sql(self, *tables: str) -> str:
        return "WITH " + ", ".join(tables) + " " + "\nUNION ALL ".join(f"SELECT * FROM ({p})" for p in self.parts)


#: Bounds of histograms of whole numbers.
_BOUNDS = "bounds AS (SELECT DISTINCT CAST(floor(pow(10::DOUBLE, CAST(CAST(k AS FLOAT) / CAST(18 AS FLOAT) AS DOUBLE)) * pow(10::DOUBLE, e) + 1e-6) AS DOUBLE) AS bound FROM (SELECT unnest(range(0, 18)) AS k), (SELECT unnest(range(-9, 18)) AS e))"
_NATIONS = "nations AS (SELECT 167772160 + n_nationkey * 1000 AS lo, r_name || '/' || n_name AS location, n_nationkey || '/' || n_name AS asn FROM nation JOIN region ON n_regionkey = r_regionkey)"
_ALL = {"enable": ["all"]}


def _places(spark, sf_dir) -> h.Dimensions:
    return h.Dimensions(geo_v4=v.geo_ranges(spark, sf_dir), asn_v4=_nations(spark, sf_dir, 1000))


# packets

_PACKETS = [
    _fast_sql(PACKETS_SQL), _NATIONS,
    """peers AS (SELECT p.* EXCLUDE (l4, syn), CASE WHEN seq % 11 = 0 THEN '' ELSE coalesce(l4, '') END AS l4, seq % 3 = 0 AS syn, CASE dir WHEN 'in' THEN src_ip WHEN 'out' THEN dst_ip END AS peer, CASE WHEN dir != 'unknown' THEN coalesce(location, 'Unknown') END AS location, CASE WHEN dir != 'unknown' THEN coalesce(asn, 'Unknown') END AS asn
  FROM packets p LEFT JOIN nations ON p.dir = 'in' AND 167772160 + (p.user_id % 256) * 256 + p.k BETWEEN lo AND lo + 999)""",
    "kept AS (SELECT * FROM peers WHERE location LIKE 'ASIA/%' OR location LIKE 'Unknown%')",
]
_L4 = {"udp": "l4 = 'udp'", "tcp": "l4 = 'tcp'", "other_l4": "l4 NOT IN ('udp', 'tcp')", "ipv4": "l3 = 'ipv4'", "ipv6": "l3 = 'ipv6'"}
_NET = (
    Definitions("dir")
    .counters("kept", {**{f"{n}_packets": c for n, c in _L4.items()}, "tcp_syn_packets": "l4 = 'tcp' AND syn", "total_packets": "true"})
    .counters("peers", {"filtered_packets": "NOT coalesce(location LIKE 'ASIA/%' OR location LIKE 'Unknown%', false)", "observed_packets": "true", "deep_sampled_packets": "true"}, whole=True)
    .distinct("kept", {"cardinality_ips": ("peer", "true")})
    .tops("kept", {"top_ipv4_packets": ("peer", "l3 = 'ipv4'"), "top_ipv6_packets": ("peer", "l3 = 'ipv6'"), "top_geo_loc_packets": ("location", "true"), "top_asn_packets": ("asn", "true")})
    .quantiles("kept", {"payload_size_bytes": ("bytes", "true")})
    .rates("kept", {"rates_pps": ("1", "true"), "rates_bps": ("bytes", "true")}, "packets")
    .rates("packets", {"rates_observed_pps": ("1", "true")}, "packets", whole=True)
    .events("packets")
)


def _packets(spark, sf_dir) -> DataFrame:
    seq = F.col("seq")
    return _fast(v.packets(spark, sf_dir)).withColumns({"l4": F.when(seq % 11 != 0, F.col("l4")), "syn": seq % 3 == 0})


@query(_NET.sql(*_PACKETS))
def net_metrics(spark, sf_dir):
    """Packets whose peer is in Asia or unknown."""
    o = h.Options(**_ALL, filters={"only_geoloc_prefix": ["ASIA/"], "geoloc_notfound": True})
    return _rows(h.net(_packets(spark, sf_dir), o, _places(spark, sf_dir)), "dir")


_SIDES = {"in": "dir = 'in'", "out": "dir = 'out'", "total": "true"}
_NET_V1 = (
    Definitions()
    .counters("peers", {**_L4, "protocol_tcp_syn": "l4 = 'tcp' AND syn", "in": "dir = 'in'", "out": "dir = 'out'", "unknown_dir": "dir = 'unknown'", "total": "true", "filtered": "false"})
    .distinct("peers", {"cardinality_src_ips_in": ("src_ip", "dir = 'in'"), "cardinality_dst_ips_out": ("dst_ip", "dir = 'out'")})
    .tops("peers", {"top_ipv4": ("peer", "l3 = 'ipv4'"), "top_ipv6": ("peer", "l3 = 'ipv6'"), "top_geoLoc": ("location", "true"), "top_ASN": ("asn", "true")})
    .quantiles("peers", {"payload_size": ("bytes", "true")})
    .rates("peers", {**{f"rates_pps_{n}": ("1", c) for n, c in _SIDES.items()}, **{f"rates_bytes_{n}": ("bytes", c) for n, c in _SIDES.items()}}, "packets")
    .events("packets")
)


@query(_NET_V1.sql(*_PACKETS))
def net_v1_metrics(spark, sf_dir):
    return _rows(h.net_v1(_packets(spark, sf_dir), h.Options(**_ALL), _places(spark, sf_dir)))


# DNS


def _dns(spark, sf_dir) -> DataFrame:
    """Messages of both directions, all transports and both families; queries of each fourth id come for a client."""
    k, reply = F.col("txid"), F.col("is_response")
    ecs = F.concat_ws(".", F.lit("10"), (k % 3).cast("string"), (k % 5).cast("string"), (k % 250).cast("string"))
    return _fast(v.dns(spark, sf_dir)).withColumns({
        "dir": F.when(reply == (k % 2 == 1), "in").otherwise("out"), "transport": F.element_at(F.array(*map(F.lit, codes.TRANSPORTS)), (F.col("seq") % 7 + 1).cast("int")),
        "l3": F.when(F.col("seq") % 3 == 0, "ipv6").otherwise("ipv4"), "ecs": F.when(~reply & (k % 4 == 0), ecs),
    })


_DNS = [
    _fast_sql(DNS_PURGED_SQL.format(ttl=TTL)), _NATIONS, _BOUNDS, f"rcodes(rc, rn) AS (VALUES {_values(codes.RCODE_NAMES)}), qtypes(qc, qn) AS (VALUES {_values(codes.QTYPE_NAMES)})",
    f"""said AS (SELECT y.*, CASE WHEN txid % 2 = 1 THEN 'out' ELSE 'in' END AS xact_dir, {list(codes.TRANSPORTS)}[CAST(seq % 7 + 1 AS BIGINT)] AS transport, CASE WHEN seq % 3 = 0 THEN 'ipv6' ELSE 'ipv4' END AS l3, 'H' || substr(qname, 2) AS spelled, txid + 1000 AS port,
  '.example.com' AS qname2, '.d' || (txid % 7) || '.example.com' AS qname3, coalesce(rn, CAST(rcode AS VARCHAR)) AS rcode_name, coalesce(qn, CAST(qtype AS VARCHAR)) AS qtype_name, rcode = 0 AND answer_count = 0 AS nodata,
  txid % 4 = 0 AS client, CASE WHEN txid % 4 = 0 THEN '10.' || (txid % 3) || '.' || (txid % 5) || '.' || (txid % 250) END AS subnet, qtype IN (1, 3) AS wanted, is_response AND was IS NOT NULL AND NOT was AS matched FROM y LEFT JOIN rcodes ON rc = rcode LEFT JOIN qtypes ON qc = qtype)""",
    "placed AS (SELECT said.*, CASE WHEN client THEN coalesce(location, 'Unknown') END AS location, CASE WHEN client THEN coalesce(asn, 'Unknown') END AS asn FROM said LEFT JOIN nations ON client AND 167772160 + (txid % 3) * 65536 + (txid % 5) * 256 + txid % 250 BETWEEN lo AND lo + 999)",
]
#: The mark of a period: the p90 of the newest earlier one that has any, of valid responses of one direction.
_SLOW = """marks AS (SELECT xact_dir, period, quantile_disc(elapsed_us, 0.9) FILTER ({valid}) AS p90 FROM placed WHERE {known} GROUP BY ALL),
before AS (SELECT xact_dir, period, last_value(p90 IGNORE NULLS) OVER (PARTITION BY xact_dir ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM marks),
valid AS (SELECT placed.*, coalesce(mark > 0 AND elapsed_us >= mark, false) AS slow FROM placed JOIN before USING (xact_dir, period) WHERE {valid})"""
_LATE = "due AS (SELECT period, xact_dir, 0 AS n FROM placed WHERE {known} UNION ALL SELECT late, xact_dir, 1 FROM placed WHERE late IS NOT NULL AND {known})"
_FAILED = {"nxdomain": "rcode = 3", "refused": "rcode = 5", "srvfail": "rcode = 2", "nodata": "nodata", "noerror": "rcode = 0"}
_FAMILY = {"ipv4": "l3 = 'ipv4'", "ipv6": "l3 = 'ipv6'"}
_DNS_V2 = (
    Definitions("xact_dir")
    .counters("valid", {"xacts": "true", **{f"{t}_xacts": f"transport = '{t}'" for t in codes.TRANSPORTS}, **{f"{n}_xacts": c for n, c in {**_FAMILY, **_FAILED}.items()}})
    .counters("valid", {"ecs_xacts": "client", "authenticated_data_xacts": "txid % 5 = 0", "authoritative_answer_xacts": "txid % 4 = 0", "checking_disabled_xacts": "query_cd"})
    .counters("placed", {"orphan_responses": "status = 'orphan'"})
    .counters("placed", {"filtered_packets": "is_response AND NOT wanted"}, weight="CASE WHEN matched THEN 2 ELSE 1 END", whole=True)
    .counters("placed", {"observed_packets": "true"}, whole=True)
    .counters("due", {"timeout_queries": "true"}, weight="n")
    .distinct("valid", {"cardinality_qname": ("qname", "true")})
    .quantiles("valid", {"xact_time_us": ("elapsed_us", "true"), "response_query_size_ratio": ("bytes / CAST(query_bytes AS DOUBLE)", "query_bytes > 0")})
    .histograms("valid", {"xact_histogram_us": ("elapsed_us", "true")})
    .rates("valid", {"xact_rates": ("1", "true")}, "valid")
    .tops("valid", {"top_geo_loc_ecs_xacts": ("location", "client"), "top_asn_ecs_xacts": ("asn", "client"), "top_ecs_xacts": ("subnet", "client"), "top_qname2_xacts": ("qname2", "true"), "top_qname3_xacts": ("qname3", "true")})
    .tops("valid", {f"top_{n}_xacts": ("qname", c) for n, c in _FAILED.items()})
    .tops("valid", {"top_udp_ports_xacts": ("port", "true"), "top_qtype_xacts": ("qtype_name", "true"), "top_rcode_xacts": ("rcode_name", "true"), "top_slow_xacts": ("qname", "slow")})
    .tops("valid", {"top_response_bytes": ("qname", "true")}, weight="bytes")
    .events("placed")
)


@query(_DNS_V2.sql(*_DNS, _SLOW.format(known="true", valid="status = 'valid' AND wanted"), _LATE.format(known="true")))
def dns_metrics(spark, sf_dir):
    """Transactions of both directions; responses of other types than A and MD are filtered."""
    o = h.Options(**_ALL, filters={"only_qtype": ["A", 3]})
    return _rows(h.dns(_dns(spark, sf_dir), o, _places(spark, sf_dir), ttl_ms=TTL * 1000), "xact_dir")


_DNS_V1 = (
    Definitions()
    .counters("kept", {f"wire_packets_{n}": c for n, c in {"queries": "NOT is_response", "replies": "is_response", **{t: f"transport = '{t}'" for t in ("udp", "tcp", "dot", "doh")}, **_FAMILY, "total": "true", "query_ecs": "client AND NOT is_response"}.items()})
    .counters("kept", {f"wire_packets_{n}": f"is_response AND {c}" for n, c in _FAILED.items()})
    .counters("placed", {"wire_packets_filtered": "NOT wanted"})
    .distinct("kept", {"cardinality_qname": ("qname", "true")})
    .tops("kept", {f"top_{n}": (c, "client AND NOT is_response") for n, c in (("geoLoc_ecs", "location"), ("asn_ecs", "asn"), ("query_ecs", "subnet"))})
    .tops("kept", {"top_qname2": ("qname2", "true"), "top_qname3": ("qname3", "true"), "top_udp_ports": ("port", "true"), "top_qtype": ("qtype_name", "true"), "top_rcode": ("rcode_name", "is_response")})
    .tops("kept", {f"top_{n}": ("qname", f"is_response AND {c}") for n, c in _FAILED.items()})
    .tops("kept", {"top_qname_by_resp_bytes": ("qname", "is_response")}, weight="bytes")
    .rates("kept", {"rates_total": ("1", "true")}, "kept")
    .counters("valid", {"xact_counts_total": "true", "xact_in_total": "xact_dir = 'in'", "xact_out_total": "xact_dir = 'out'"})
    .quantiles("valid", {**{f"xact_{d}_quantiles_us": ("elapsed_us", f"xact_dir = '{d}'") for d in ("in", "out")}, "xact_ratio_quantiles": ("bytes / CAST(query_bytes AS DOUBLE)", "query_bytes > 0")})
    .histograms("valid", {f"xact_{d}_histogram_us": ("elapsed_us", f"xact_dir = '{d}'") for d in ("in", "out")})
    .tops("valid", {f"xact_{d}_top_slow": ("spelled", f"slow AND xact_dir = '{d}'") for d in ("in", "out")})
    .counters("due", {"xact_counts_timed_out": "true"}, weight="n")
    .events("placed")
)


@query(_DNS_V1.sql(*_DNS, "kept AS (SELECT * FROM placed WHERE wanted)", _SLOW.format(known="status = 'valid' AND wanted", valid="status = 'valid' AND wanted"), _LATE.format(known="wanted")))
def dns_v1_metrics(spark, sf_dir):
    """Wire packets and transactions of the types A and MD."""
    o = h.Options(**_ALL, filters={"only_qtype": ["A", "3"]})
    return _rows(h.dns_v1(_dns(spark, sf_dir), o, _places(spark, sf_dir), ttl_ms=TTL * 1000))


# flows

_FLOWS = [
    FLOWS_SQL, f"dscp(dk, dn) AS (VALUES {_values(codes.DSCP_NAMES)}), ecn(ek, en) AS (VALUES {_values(codes.ECN_NAMES)})",
    """years AS (SELECT f.* REPLACE ('10.255.1.' || ((l_suppkey % 250) % 3) AS device, CAST(epoch(date_trunc('year', make_timestamp(period * 1000000))) AS BIGINT) AS period), coalesce(dn, CAST(tos // 4 AS VARCHAR)) AS dscp_name, coalesce(en, CAST(tos % 4 AS VARCHAR)) AS ecn_name,
  coalesce(n_name, 'Unknown') AS src_location, CASE WHEN l_orderkey < 30000 THEN 'lab' ELSE 'Unknown' END AS dst_location, coalesce(n_nationkey || '/' || n_name, 'Unknown') AS src_asn, CASE WHEN l_orderkey < 30000 THEN '900/lab' ELSE 'Unknown' END AS dst_asn,
  src_ip || ':' || src_port AS src_end, dst_ip || ':' || dst_port AS dst_end FROM f LEFT JOIN nation ON l_partkey // 50 = n_nationkey LEFT JOIN dscp ON dk = tos // 4 LEFT JOIN ecn ON ek = tos % 4)""",
    """ways AS (SELECT *, CASE WHEN src_port > 0 AND dst_port > 0 THEN least(src_end, dst_end) || '/' || greatest(src_end, dst_end) END AS conversation, CAST(interface AS VARCHAR) AS device_interface
  FROM (SELECT *, 'in' AS dir, if_in AS interface FROM years UNION ALL SELECT *, 'out', if_out FROM years WHERE if_out IS NOT NULL))""",
    "ends AS (SELECT *, src_location AS location, src_asn AS asn FROM ways UNION ALL SELECT *, dst_location, dst_asn FROM ways)", "whole AS (SELECT *, CAST(NULL AS VARCHAR) AS device_interface FROM years)",
]


def _flow_definitions() -> Definitions:
    out = Definitions("device", "device_interface")
    for w in ("bytes", "packets"):
        for dir in ("in", "out"):
            mine = f"dir = '{dir}'"
            out.counters("ways", {**{f"{dir}_{n}_{w}": f"{mine} AND {c}" for n, c in {**_L4, "other_l4": "l4 = 'other'"}.items()}, f"{dir}_{w}": mine}, weight=w)
            for side in ("src", "dst"):
                port = f"{mine} AND {side}_port > 0"
                out.tops("ways", {f"top_{dir}_{side}_ips_{w}": (f"{side}_ip", mine), f"top_{dir}_{side}_ports_{w}": (f"{side}_port", port), f"top_{dir}_{side}_ip_ports_{w}": (f"{side}_end", port)}, weight=w)
            out.tops("ways", {f"top_{dir}_dscp_{w}": ("dscp_name", mine), f"top_{dir}_ecn_{w}": ("ecn_name", mine)}, weight=w)
            out.tops("whole", {f"top_{dir}_interfaces_{w}": (f"if_{dir}", "true")}, weight=w)
        out.tops("ways", {f"top_conversations_{w}": ("conversation", "true")}, weight=w)
        out.tops("ends", {f"top_geo_loc_{w}": ("location", "true"), f"top_asn_{w}": ("asn", "true")}, weight=w)
    out.distinct("ways", {"cardinality_conversations": ("conversation", "true"), "cardinality_src_ips_in": ("src_ip", "true"), "cardinality_dst_ips_out": ("dst_ip", "true")})
    out.distinct("ways", {"cardinality_src_ports_in": ("src_port", "src_port > 0"), "cardinality_dst_ports_out": ("dst_port", "dst_port > 0")})
    return out.counters("whole", {"records_flows": "true", "records_filtered": "false"})


@query(_flow_definitions().sql(*_FLOWS))
def flow_metrics(spark, sf_dir):
    """Flows of three devices by year, each year's at its first second."""
    flows = v.flows(spark, sf_dir).withColumn("ts", F.date_trunc("year", "ts"))
    flows = flows.withColumn("device_ip", F.concat(F.lit("10.255.1."), (F.split("device_ip", r"\.")[3].cast("int") % 3).cast("string")))
    lab = spark.range(1).select(F.lit(172 << 24).cast("bigint").alias("lo"), F.lit("900/lab").alias("asn"), F.lit((172 << 24) + 29_999).cast("bigint").alias("hi"))
    asn = _nations(spark, sf_dir, 50).unionByName(lab)
    places = asn.withColumn("location", F.split("asn", "/")[1]).drop("asn")
    out = h.flow(flows, h.Options(**_ALL, event_counts=False), h.Dimensions(geo_v4=places, asn_v4=asn))
    return _rows(out, "device", "device_interface")


# DHCP, BGP, captures, probes and inputs

_E = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), t AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS period, event_id AS seq FROM e)"


def _events(spark, sf_dir) -> DataFrame:
    e = v.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _fast(e).withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "stream": F.lit("all"), "seq": F.col("event_id")})


_V4 = {"view": "REQUEST", "click": "ACK", "signup": "OFFER", "purchase": "DISCOVER", "error": "NAK"}
_V6 = {"view": "REQUEST", "click": "REPLY", "signup": "ADVERTISE", "purchase": "SOLICIT", "error": "DECLINE"}
_KINDS = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{{{e}}}'" for e in _V4) + " END"
_DHCP_SQL = [
    _fast_sql(_E), f"m AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN 6 ELSE 4 END AS version, CASE WHEN user_id % 4 = 0 THEN {_KINDS.format(**_V6)} ELSE {_KINDS.format(**_V4)} END AS kind, 'mac' || (k % 5) AS mac, CASE WHEN k % 6 != 0 THEN '10.0.0.' || (k % 3) END AS server FROM t)",
    """four AS (SELECT * FROM m WHERE version = 4), pairs AS (SELECT *, lag(kind) OVER w AS was, lag('m' || user_id) OVER w AS asker, lag(CASE WHEN user_id % 3 = 0 THEN 'host' || (user_id % 7) END) OVER w AS host, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM four WHERE kind IN ('REQUEST', 'ACK') WINDOW w AS (PARTITION BY k ORDER BY ts, seq)),
leases AS (SELECT *, asker || '/' || coalesce(host, 'Unknown') || '/10.1.0.' || k AS client FROM pairs WHERE kind = 'ACK' AND was = 'REQUEST' AND gap < 5000000),
servers AS (SELECT *, CASE WHEN version = 4 AND kind = 'OFFER' THEN mac || coalesce('/' || server, '') WHEN version = 6 AND kind IN ('REPLY', 'ADVERTISE') AND server IS NOT NULL THEN mac || '/fe80::' || (k % 4) END AS who FROM m)""",
]
_DHCP = (
    Definitions()
    .counters("m", {f"wire_packets_{t.lower()}": f"version = 4 AND kind = '{t}'" for t in ("DISCOVER", "OFFER", "REQUEST", "ACK")})
    .counters("m", {f"wire_packets_{n}": f"version = 6 AND kind = '{n.removesuffix('_v6').upper()}'" for n in ("solicit", "advertise", "request_v6", "reply")})
    .counters("m", {"wire_packets_total": "version = 4", "wire_packets_filtered": "false"})
    .tops("servers", {"top_servers": ("who", "true")})
    .tops("leases", {"top_clients": ("client", "true")})
    .rates("four", {"rates_total": ("1", "true")}, "four")
    .events("m")
)


@query(_DHCP.sql(*_DHCP_SQL))
def dhcp_metrics(spark, sf_dir):
    e, k, user = _events(spark, sf_dir), F.col("k"), F.col("user_id")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    rows = e.select(
        "stream", "ts", "seq", F.when(user % 4 == 0, 6).otherwise(4).alias("version"), F.when(user % 4 == 0, codes.lookup(_V6, F.col("event_type"))).otherwise(codes.lookup(_V4, F.col("event_type"))).alias("msg_type"), k.cast("bigint").alias("xid"), text("m", user).alias("client_mac"),
        F.when(user % 3 == 0, text("host", user % 7)).alias("hostname"), text("10.1.0.", k).alias("your_ip"), F.when(k % 6 != 0, text("10.0.0.", k % 3)).alias("server_id"), text("mac", k % 5).alias("src_mac"), text("fe80::", k % 4).alias("src_ip6"),
    )
    return _rows(h.dhcp(rows))


_BGP_KIND = {"view": "OPEN", "click": "UPDATE", "purchase": "KEEPALIVE", "signup": "NOTIFICATION", "error": "ROUTEREFRESH"}
_BGP = Definitions().counters("t", {**{f"wire_packets_{n.lower()}": f"event_type = '{e}'" for e, n in _BGP_KIND.items()}, "wire_packets_total": "true", "wire_packets_filtered": "false"}).rates("t", {"rates_total": ("1", "true")}, "t").events("t")


@query(_BGP.sql(_fast_sql(_E)))
def bgp_metrics(spark, sf_dir):
    return _rows(h.bgp(_events(spark, sf_dir).select("stream", "ts", "seq", codes.lookup(_BGP_KIND, F.col("event_type")).alias("msg_type"))))


_DROPS = """drops AS (SELECT *, greatest(CAST(floor(value) AS BIGINT) - max(CAST(floor(value) AS BIGINT)) OVER w, 0) AS os, greatest(k - max(k) OVER w, 0) AS nic FROM t WINDOW w AS (PARTITION BY period ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_CAPTURE = Definitions().counters("t", {"tcp_reassembly_errors": "event_type = 'error'"}).counters("drops", {"os_drops": "true"}, weight="os").counters("drops", {"if_drops": "true"}, weight="nic").events("t")


@query(_CAPTURE.sql(_fast_sql(_E), _DROPS))
def capture_metrics(spark, sf_dir):
    """Drops counted up from the largest value before, inside each period."""
    e = _events(spark, sf_dir)
    return _rows(h.capture(e.select("stream", "ts", "seq", F.floor("value").cast("bigint").alias("os_drops"), F.col("k").cast("bigint").alias("if_drops"), F.when(F.col("event_type") == "error", True).alias("tcp_error"))))


_PROBE_SQL = [
    _fast_sql(_E), _BOUNDS,
    """probes AS (SELECT *, 't' || (user_id % 10) AS target, user_id % 2 = 0 AS icmp, CASE WHEN event_type = 'error' THEN ['Socket', 'invalid_ip', 'connect', 'dns', 'timeout'][CAST(seq % 5 + 1 AS BIGINT)] END AS failure FROM t),
tries AS (SELECT *, lag(event_type) OVER w AS was, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM probes WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY period, target, CASE WHEN icmp THEN CAST(k AS VARCHAR) ELSE target END ORDER BY ts, seq)),
won AS (SELECT * FROM tries WHERE event_type = 'click' AND was = 'view' AND gap < 2000000), lost AS (SELECT period, target FROM tries WHERE event_type = 'click' AND was = 'view' AND gap >= 2000000 UNION ALL SELECT period, target FROM probes WHERE failure = 'timeout')""",
]
_PROBE = (
    Definitions("target")
    .counters("probes", {"attempts": "event_type = 'view'", "connect_failures": "failure IN ('Socket', 'invalid_ip', 'connect')", "dns_lookup_failures": "failure = 'dns'"})
    .counters("won", {"successes": "true"})
    .counters("lost", {"packets_timeout": "true"})
    .quantiles("won", {"response_quantiles_us": ("gap", "true")})
    .histograms("won", {"response_histogram_us": ("gap", "true")})
    ._add("SELECT period, target, unnest(['response_min_us', 'response_max_us']) AS name, 'value' AS stat, CAST(unnest([min(gap), max(gap)]) AS DOUBLE) AS value FROM won GROUP BY period, target")
    .events("probes")
)


@query(_PROBE.sql(*_PROBE_SQL))
def netprobe_metrics(spark, sf_dir):
    """Probes of even users by number, of odd ones by target."""
    failures = F.array(*map(F.lit, ("Socket", "invalid_ip", "connect", "dns", "timeout")))
    rows = _events(spark, sf_dir).select(
        "stream", "ts", "seq", F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("target"), F.when(F.col("user_id") % 2 == 0, "icmp").otherwise("tcp").alias("kind"),
        codes.lookup({"view": "send", "click": "recv", "error": "fail"}, F.col("event_type")).alias("event"), F.col("k").cast("bigint").alias("probe_id"), F.when(F.col("event_type") == "error", F.element_at(failures, (F.col("seq") % 5 + 1).cast("int"))).alias("error"),
    )
    return _rows(h.netprobe(rows, h.Options(**_ALL)), "target")


_INPUT_SQL = """steps AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -2 ELSE 0 END AS policies, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS handlers FROM t),
sums AS (SELECT *, sum(policies) OVER w AS p, sum(handlers) OVER w AS q FROM steps WINDOW w AS (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT *, p - least(min(p) OVER w, 0) AS policy_total, q - least(min(q) OVER w, 0) AS handler_total FROM sums WINDOW w AS (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
lasts AS (SELECT period, arg_max(policy_total, ts) AS policy_total, arg_max(handler_total, ts) AS handler_total FROM totals GROUP BY 1)"""
_INPUT = Definitions().quantiles("t", {"cpu_usage": ("value", "true"), "memory_bytes": ("seq", "true")}).counters("lasts", {"policy_count": "true"}, weight="policy_total").counters("lasts", {"handler_count": "true"}, weight="handler_total").events("t")


@query(_INPUT.sql(_fast_sql(_E), _INPUT_SQL))
def resource_metrics(spark, sf_dir):
    e = _events(spark, sf_dir)
    step = lambda up, down, n: F.when(F.col("event_type") == up, 1).when(F.col("event_type") == down, n).otherwise(0).cast("bigint")
    changes = e.select("stream", "ts", step("signup", "purchase", -2).alias("policy_delta"), step("view", "click", -1).alias("handler_delta"))
    return _rows(h.resources(e.select("stream", "ts", F.col("value").alias("cpu_pct"), F.col("event_id").alias("mem_bytes")), changes))
