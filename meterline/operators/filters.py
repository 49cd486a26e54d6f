"""Filters as boolean columns. A row that fails still counts as an event and as filtered, so nothing is dropped here."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.addresses import cidr_match, port_in_ranges
from ..functions.codes import DNSTAP_KINDS, qtype_number, rcode_number
from ..functions.dns import suffix_size
from .lookup import starts_with_any

COMMON = ("deep_sample_rate", "num_periods", "topn_count", "topn_percentile_threshold", "enable", "disable")


class FilterError(ValueError):
    """A filter that can't be built from its options."""


def _all(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def from_options(kind: type, options: dict):
    """The filter dataclass of given options; an unknown key is an error that lists the valid ones."""
    known = {f.name for f in fields(kind)}
    for k in options:
        if k not in known and k not in COMMON:
            raise FilterError(f"no option {k!r} here; there are: {', '.join(sorted(known | set(COMMON)))}")
    return kind(**{k: v for k, v in options.items() if k in known})


def _list(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


@dataclass
class DnsFilter:
    """``version`` 2 tests responses (queries for names); version 1 tests every packet."""

    exclude_noerror: bool = False
    only_rcode: object = None
    answer_count: int | None = None
    only_dnssec_response: bool = False
    only_qtype: Sequence = ()
    only_qname: Sequence[str] = ()
    only_qname_suffix: Sequence[str] = ()
    only_queries: bool = False
    only_responses: bool = False
    geoloc_notfound: bool = False
    asn_notfound: bool = False
    only_xact_directions: Sequence[str] = ()
    dnstap_msg_type: str | None = None
    version: int = 2

    def keep(self) -> Column:
        response = F.col("is_response")
        every = self.version == 1
        on = lambda test: test if every else ~response | test  # noqa: E731  version 2: other rows pass
        parts = []
        if self.exclude_noerror:
            parts.append(on(F.col("rcode") != 0))
        elif self.only_rcode is not None:
            parts.append(on(F.col("rcode").isin([rcode_number(x) for x in _list(self.only_rcode)])))
        if self.answer_count is not None:
            parts.append(on(F.col("answer_count") == self.answer_count))
        if self.only_dnssec_response:
            parts.append(on(response & F.array_contains("answer_types", 46)))
        if self.only_qtype:
            parts.append(on(F.col("qtype").isin([qtype_number(x) for x in _list(self.only_qtype)])))
        if self.only_qname:
            test = F.lower("qname").isin([x.lower() for x in self.only_qname])
            parts.append(test if every else response | test)
        if self.only_qname_suffix:
            parts.append(suffix_size(F.col("qname"), self.only_qname_suffix).isNotNull())
        if self.only_queries:
            parts.append(~response)
        if self.only_responses:
            parts.append(response)
        if self.geoloc_notfound:
            parts.append(response | (F.col("ecs").isNotNull() & (F.col("ecs_location") == "Unknown")))
        if self.asn_notfound:
            parts.append(response | (F.col("ecs").isNotNull() & (F.col("ecs_asn") == "Unknown")))
        if self.only_xact_directions:
            parts.append(F.col("xact_dir").isin(list(self.only_xact_directions)))
        if self.dnstap_msg_type is not None:
            kind = DNSTAP_KINDS.get(self.dnstap_msg_type.lower())
            if kind is None:
                raise FilterError(f"no dnstap message family {self.dnstap_msg_type!r}; there are: {', '.join(DNSTAP_KINDS)}")
            parts.append(F.col("msg_type").isin(f"{kind}_QUERY", f"{kind}_RESPONSE"))
        return _all(parts)

    @property
    def places(self) -> bool:
        """Whether the filter asks for places of clients."""
        return self.geoloc_notfound or self.asn_notfound

    def suffix_size(self) -> Column:
        """What the suffix filter leaves to name aggregation."""
        return F.coalesce(suffix_size(F.col("qname"), self.only_qname_suffix), F.lit(0)) if self.only_qname_suffix else F.lit(0)


def only_hosts(hosts: Sequence[str]) -> Column:
    """dnstap rows, at the source, with an address in the list."""
    return F.coalesce(cidr_match(F.col("query_addr"), hosts).isNotNull(), F.lit(False)) | F.coalesce(cidr_match(F.col("response_addr"), hosts).isNotNull(), F.lit(False))


@dataclass
class NetFilter:
    """Tests the peer (source when in, destination when out); columns ``peer_location`` and ``peer_asn``."""

    geoloc_notfound: bool = False
    only_geoloc_prefix: Sequence[str] = ()
    asn_notfound: bool = False
    only_asn_number: Sequence = ()

    def keep(self) -> Column:
        known = F.col("dir").isin("in", "out")
        parts = []
        places = [*self.only_geoloc_prefix, *(["Unknown"] if self.geoloc_notfound else [])]
        if places:
            parts.append(known & starts_with_any(F.col("peer_location"), places))
        numbers = []
        for n in self.only_asn_number:
            if not str(n).isdigit():
                raise FilterError(f"an AS number has digits only: {n!r}")
            numbers.append(f"{n}/")
        if numbers or self.asn_notfound:
            parts.append(known & starts_with_any(F.col("peer_asn"), [*numbers, *(["Unknown"] if self.asn_notfound else [])]))
        return _all(parts)


@dataclass
class FlowFilter:
    only_ips: Sequence[str] = ()
    only_ports: Sequence = ()
    only_device_interfaces: dict[str, Sequence] = field(default_factory=dict)
    only_directions: Sequence[str] | None = None
    geoloc_notfound: bool = False
    asn_notfound: bool = False

    def interface(self, side: str) -> Column:
        """The interface of a side (``if_in`` or ``if_out``), null where the filters drop that side."""
        out = F.col(side)
        if self.only_device_interfaces:
            ok = F.lit(False)
            for device, ranges in self.only_device_interfaces.items():
                mine = F.lit(True) if "*" in map(str, ranges) else port_in_ranges(F.col(side), ranges)
                ok = ok | ((F.col("device_ip") == device) & mine)
            out = F.when(ok, out)
        if self.only_directions is not None:
            if bad := set(self.only_directions) - {"in", "out"}:
                raise FilterError(f"directions of a flow are in and out, not {sorted(bad)}")
            out = out if side.removeprefix("if_") in self.only_directions else F.lit(None).cast("bigint")
        return out

    def keep(self, if_in: Column | None = None, if_out: Column | None = None) -> Column:
        """Whether a record counts, after its ``if_in`` and ``if_out`` (columns, unless given) went through :meth:`interface`."""
        parts = []
        if self.only_ips:
            parts.append(cidr_match(F.col("src_ip"), self.only_ips).isNotNull() | cidr_match(F.col("dst_ip"), self.only_ips).isNotNull())
        if self.only_ports:
            parts.append(port_in_ranges(F.col("src_port"), self.only_ports) | port_in_ranges(F.col("dst_port"), self.only_ports))
        if self.only_device_interfaces or self.only_directions is not None:
            sides = F.col("if_in") if if_in is None else if_in, F.col("if_out") if if_out is None else if_out
            parts.append(sides[0].isNotNull() | sides[1].isNotNull())
        if self.geoloc_notfound:
            parts.append((F.col("src_location") == "Unknown") | (F.col("dst_location") == "Unknown"))
        if self.asn_notfound:
            parts.append((F.col("src_asn") == "Unknown") | (F.col("dst_asn") == "Unknown"))
        return _all(parts)


GROUPS = {
    "net": ("counters", "cardinality", "quantiles", "top_geo", "top_ips"),
    "net_v1": ("counters", "cardinality", "top_geo", "top_ips"),
    "dns": ("cardinality", "counters", "quantiles", "top_ecs", "top_ports", "top_qnames", "top_qtypes", "top_rcodes", "top_size", "xact_times"),
    "dns_v1": ("cardinality", "counters", "quantiles", "histograms", "dns_transaction", "top_ecs", "top_qnames", "top_qnames_details", "top_ports"),
    "flow": ("by_bytes", "by_packets", "cardinality", "conversations", "counters", "top_geo", "top_interfaces", "top_ips", "top_ips_ports", "top_ports", "top_tos"),
    "netprobe": ("counters", "histograms", "quantiles"),
}
DEFAULT_GROUPS = {
    "net": ("counters", "cardinality", "quantiles", "top_geo", "top_ips"),
    "net_v1": ("counters", "cardinality", "top_geo", "top_ips"),
    "dns": ("cardinality", "counters", "quantiles", "top_qnames", "top_rcodes", "top_qtypes"),
    "dns_v1": ("cardinality", "counters", "quantiles", "dns_transaction", "top_qnames", "top_ports"),
    "flow": ("counters", "cardinality", "top_ips", "top_ports", "top_ips_ports", "by_bytes", "by_packets"),
    "netprobe": ("counters", "histograms"),
}


def metric_groups(handler: str, enable: Sequence[str] = (), disable: Sequence[str] = ()) -> set[str]:
    """The groups that are on: the defaults, less the disabled, plus the enabled. ``all`` ends either list."""
    valid, on = GROUPS.get(handler, ()), set(DEFAULT_GROUPS.get(handler, ()))
    for names, act in ((disable, on.discard), (enable, on.add)):
        for name in names:
            if name == "all":
                on = set() if act == on.discard else set(valid)
                act = on.add
                break
            if name not in valid:
                raise FilterError(f"no metric group {name!r} here; there are: all, {', '.join(valid)}")
            (on.discard if names is disable else on.add)(name)
    return on
