"""Schemas of the normalised event tables and dimension tables. Always explicit, never inferred."""

from __future__ import annotations

#: Schema of each table, as DDL.
SCHEMAS: dict[str, str] = {
    "packets": "stream string, ts timestamp, dir string, l3 string, l4 string, src_ip string, dst_ip string, src_port int, dst_port int, bytes bigint, syn boolean, seq bigint",
    "dns": "stream string, ts timestamp, dir string, is_response boolean, txid int, flow_key bigint, qname string, qtype int, rcode int, aa boolean, ad boolean, cd boolean, answer_count int, answer_types array<int>, ecs string, l3 string, transport string, src_port int, dst_port int, bytes bigint, seq bigint",
    "dnstap": "stream string, type string, msg_type string, socket_family string, socket_protocol string, query_addr string, response_addr string, query_port int, query_ts timestamp, response_ts timestamp, txid int, qname string, qtype int, rcode int, aa boolean, ad boolean, answer_count int, answer_types array<int>, bytes bigint, seq bigint",
    "flow_exports": "device_ip string, ts timestamp, flow_type string, sample_type string, records array<struct<is_ipv6:boolean,proto:int,tos:int,src_ip:string,dst_ip:string,src_port:int,dst_port:int,if_in:bigint,if_out:bigint,packets:bigint,octets:bigint,mean_skip_count:bigint,sampled_packet_size:bigint>>, seq bigint",
    "dhcp": "stream string, ts timestamp, version int, msg_type string, xid bigint, client_mac string, hostname string, your_ip string, server_id string, src_mac string, src_ip6 string, seq bigint",
    "bgp": "stream string, ts timestamp, msg_type string, seq bigint",
    "probes": "stream string, ts timestamp, target string, kind string, event string, probe_id bigint, error string, seq bigint",
    "capture_stats": "stream string, ts timestamp, os_drops bigint, if_drops bigint, tcp_error boolean, seq bigint",
    "resource_samples": "stream string, ts timestamp, cpu_pct double, mem_bytes bigint",
    "policy_changes": "stream string, ts timestamp, policy_delta bigint, handler_delta bigint",
    "services": "proto string, port_lo int, port_hi int, name string",
    "geo_ranges_v4": "lo bigint, hi bigint, location string, lat string, lon string",
    "asn_ranges_v4": "lo bigint, hi bigint, asn string",
    "geo_ranges_v6": "lo string, hi string, location string, lat string, lon string",
    "asn_ranges_v6": "lo string, hi string, asn string",
    "public_suffixes": "tld string, ord int, suffix string",
    "devices": "device_ip string, name string, descr string",
    "interfaces": "device_ip string, if_index bigint, name string, descr string",
    # the long form that every handler returns and every sink reads
    "metrics": "policy string, handler string, schema string, period_start timestamp, period_len bigint, labels map<string,string>, name string, kind string, stat string, value double",
}
