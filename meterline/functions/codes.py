"""Names of protocol numbers, and expressions that look them up."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, as the protocols and the reports name them.
DSCP_NAMES = {
    0: "CS0", 8: "CS1", 10: "AF11", 12: "AF12", 14: "AF13", 16: "CS2", 18: "AF21", 20: "AF22", 22: "AF23", 24: "CS3", 26: "AF31", 28: "AF32", 30: "AF33",
    32: "CS4", 34: "AF41", 36: "AF42", 38: "AF43", 40: "CS5", 43: "VOICE-ADMIT", 46: "EF", 48: "CS6", 56: "CS7",
}
ECN_NAMES = {0: "Not-ECT", 1: "ECT(1)", 2: "ECT(0)", 3: "CE"}
RCODE_NAMES = {
    0: "NOERROR", 1: "FORMERR", 2: "SRVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED", 6: "YXDOMAIN", 7: "YXRRSET", 8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE", 11: "DSOTYPENI",
    16: "BADVERS", 17: "BADKEY", 18: "BADTIME", 19: "BADMODE", 20: "BADNAME", 21: "BADALG", 22: "BADTRUNC", 23: "BADCOOKIE",
}
QTYPE_NAMES = {
    0: "Reserved (0)", 1: "A", 2: "NS", 3: "MD", 4: "MF", 5: "CNAME", 6: "SOA", 7: "MB", 8: "MG", 9: "MR", 10: "NULL", 11: "WKS", 12: "PTR", 13: "HINFO", 14: "MINFO", 15: "MX",
    16: "TXT", 17: "RP", 18: "AFSDB", 19: "X25", 20: "ISDN", 21: "RT", 22: "NSAP", 23: "NSAP-PTR", 24: "SIG", 25: "KEY", 26: "PX", 27: "GPOS", 28: "AAAA", 29: "LOC", 30: "NXT",
    31: "EID", 32: "NIMLOC", 33: "SRV", 34: "ATMA", 35: "NAPTR", 36: "KX", 37: "CERT", 38: "A6", 39: "DNAME", 40: "SINK", 41: "OPT", 42: "APL", 43: "DS", 44: "SSHFP", 45: "IPSECKEY",
    46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 53: "SMIMEA", 55: "HIP", 56: "NINFO", 57: "RKEY", 58: "TALINK", 59: "CDS",
    60: "CDNSKEY", 61: "OPENPGPKEY", 62: "CSYNC", 63: "ZONEMD", 64: "SVCB", 65: "HTTPS", 99: "SPF", 100: "UINFO", 101: "UID", 102: "GID", 103: "UNSPEC", 104: "NID", 105: "L32",
    106: "L64", 107: "LP", 108: "EUI48", 109: "EUI64", 249: "TKEY", 250: "TSIG", 251: "IXFR", 252: "AXFR", 253: "MAILB", 254: "MAILA", 255: "*", 256: "URI", 257: "CAA", 258: "AVC",
    259: "DOA", 260: "AMTRELAY", 32768: "TA", 32769: "DLV", 65535: "Reserved (65535)",
}
DNS_PORTS = (53, 5353, 5355, 53000)
#: dnstap message families; each has a QUERY and a RESPONSE type.
DNSTAP_KINDS = {"auth": "AUTH", "resolver": "RESOLVER", "client": "CLIENT", "forwarder": "FORWARDER", "stub": "STUB", "tool": "TOOL", "update": "UPDATE"}
DNSTAP_IN = ("CLIENT_QUERY", "STUB_RESPONSE", "RESOLVER_RESPONSE", "AUTH_QUERY", "FORWARDER_RESPONSE", "UPDATE_QUERY", "TOOL_RESPONSE")
DNSTAP_OUT = ("CLIENT_RESPONSE", "STUB_QUERY", "RESOLVER_QUERY", "AUTH_RESPONSE", "FORWARDER_QUERY", "UPDATE_RESPONSE", "TOOL_QUERY")
TRANSPORTS = ("udp", "tcp", "dot", "doh", "dnscrypt_udp", "dnscrypt_tcp", "doq")


def lookup(names: dict, key: Column) -> Column:
    """The name of a key; an unknown key as text."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(table[key], key.cast("string"))


def dscp_name(tos: Column) -> Column:
    return lookup(DSCP_NAMES, F.shiftright(tos, 2))


def ecn_name(tos: Column) -> Column:
    return lookup(ECN_NAMES, tos.bitwiseAND(3))


def rcode_name(code: Column) -> Column:
    return lookup(RCODE_NAMES, code)


def qtype_name(code: Column) -> Column:
    return lookup(QTYPE_NAMES, code)


def _number(value: object, names: dict[int, str], what: str) -> int:
    text = str(value).strip()
    if text.isdigit():
        return int(text)
    found = [k for k, v in names.items() if v.lower() == text.lower()]
    if not found:
        raise ValueError(f"unknown {what}: {value}")
    return found[0]


def rcode_number(value: object) -> int:
    """The number of a response code given as a number or, in any case, by name."""
    return _number(value, RCODE_NAMES, "rcode")


def qtype_number(value: object) -> int:
    return _number(value, QTYPE_NAMES, "qtype")


def transport_name(l4: Column, socket_protocol: Column) -> Column:
    """udp, tcp, dot, doh, dnscrypt_udp, dnscrypt_tcp, doq; anything else is unknown. A socket protocol wins over l4."""
    given = F.lower(F.coalesce(socket_protocol, l4))
    given = F.regexp_replace(given, "dnscrypt_?(udp|tcp)", "dnscrypt_$1")
    return F.when(given.isin(*TRANSPORTS), given).otherwise("unknown")


def dnstap_packet_direction(msg_type: Column) -> Column:
    return F.when(msg_type.isin(*DNSTAP_IN), "in").when(msg_type.isin(*DNSTAP_OUT), "out").otherwise("unknown")


def dnstap_xact_direction(msg_type: Column) -> Column:
    """Direction of the whole exchange: the client, auth and update families come in, the others go out."""
    family = F.regexp_extract(msg_type, "^([A-Z]+)_(QUERY|RESPONSE)$", 1)
    return F.when(family.isin("CLIENT", "AUTH", "UPDATE"), "in").when(family.isin("STUB", "RESOLVER", "FORWARDER", "TOOL"), "out").otherwise("unknown")


def dnstap_is_response(msg_type: Column) -> Column:
    return msg_type.endswith("_RESPONSE")


def dnstap_event_time(msg_type: Column, query_ts: Column, response_ts: Column, ingest: Column | None = None) -> Column:
    """Response time of client, auth and resolver responses, query time of queries, else the time of ingestion."""
    known = F.when(msg_type.isin("CLIENT_RESPONSE", "AUTH_RESPONSE", "RESOLVER_RESPONSE"), response_ts).when(msg_type.isin("CLIENT_QUERY", "AUTH_QUERY", "RESOLVER_QUERY"), query_ts)
    return F.coalesce(known, ingest if ingest is not None else F.current_timestamp())
