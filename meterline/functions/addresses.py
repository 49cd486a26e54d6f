"""Addresses, subnets and ports as column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_subnets(specs: Sequence[str]) -> list[tuple[str, int]]:
    """``(address, prefix length)`` of specs ``address/length``; host bits stay, bad specs are errors."""
    out = []
    for spec in specs:
        address, slash, length = spec.strip().partition("/")
        if not slash or not length.isdigit():
            raise ValueError(f"invalid subnet: {spec}")
        ip = ipaddress.ip_address(address)
        if int(length) > ip.max_prefixlen:
            raise ValueError(f"invalid prefix length: {spec}")
        out.append((address, int(length)))
    return out


def is_ipv6(ip: Column) -> Column:
    return F.contains(ip, F.lit(":"))


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null for anything but dotted IPv4."""

    octet = "([01]?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])"
    part = lambda i: F.substring_index(F.substring_index(ip, ".", i), ".", -1).cast("bigint")
    return F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * 256 + part(4))


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ipv6_hex(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address; null for anything else (embedded dotted tails are not read).

    Written without lambdas and short: code of rows grows with it, and the JVM interprets methods of over 8000 bytes.
    """
    fits = ip.rlike(r"(?i)^(?!.*::.*::)(?!.*[0-9a-f]{5})[0-9a-f:]*:[0-9a-f:]*\z")
    # groups get three zeros in front, of whose digits the last four stay; the gap is one mark, then as many zeros as lack
    groups = F.regexp_replace(F.replace(F.lower(ip), F.lit("::"), F.lit("!")), "([0-9a-f]+)", "000$1")
    digits = F.replace(F.regexp_replace(groups, "(?<![0-9a-f])0{0,3}([0-9a-f]{4})(?![0-9a-f])", "$1"), F.lit(":"))
    filled = F.replace(digits, F.lit("!"), F.repeat(F.lit("0"), F.lit(33) - F.length(digits)))
    return F.when(fits, F.try_element_at(F.regexp_extract_all(filled, F.lit(r"^(.{32})\z"), F.lit(1)), F.lit(1)))


def _hex_prefix(hex_digits: Column, length: int) -> Column:
    """The first ``length`` bits as text: whole digits, then the top bits of the next digit as a number."""
    digits, bits = divmod(length, 4)
    head = F.substring(hex_digits, 1, digits)
    if not bits:
        return head
    next_digit = F.conv(F.substring(hex_digits, digits + 1, 1), 16, 10).cast("int")
    return F.concat(head, F.lit("."), F.shiftright(next_digit, 4 - bits).cast("string"))


def _holds(subnet: str, number: Column, digits: Column) -> Column:
    """Whether a subnet holds an address given as an IPv4 number or IPv6 hex digits (the other one null)."""
    (address, length), = parse_subnets([subnet])
    base = ipaddress.ip_address(address)
    if base.version == 4:
        if length == 0:
            return number != 0
        lo = (int(base) >> (32 - length)) << (32 - length)
        return (number != 0) & number.between(lo, lo + (1 << (32 - length)) - 1)
    if length == 0:
        return F.lit(False)
    wanted = format(int(base), "032x")
    whole, bits = divmod(length, 4)
    text = wanted[:whole] + (f".{int(wanted[whole], 16) >> (4 - bits)}" if bits else "")
    return _hex_prefix(digits, length) == text


def in_subnet(ip: Column, subnet: str) -> Column:
    """Whether the address is in the subnet. IPv4 0.0.0.0 is in none, IPv4 /0 holds all others, IPv6 /0 holds none."""
    return cidr_match(ip, [subnet]).isNotNull()


def cidr_match(ip: Column, subnets: Sequence[str]) -> Column:
    """The first subnet of the list, as written, that holds the address; null if none."""

    def first(number: Column, digits: Column) -> Column:
        out = F.lit(None).cast("string")
        for s in reversed(list(subnets)):
            out = F.when(_holds(s, number, digits), F.lit(s)).otherwise(out)
        return out

    if not any(":" in s for s in subnets):
        return let(ipv4_number(ip), lambda number: first(number, F.lit(None).cast("string")))
    return let(ipv4_number(ip), lambda number: let(ipv6_hex(ip), lambda digits: first(number, digits)))


def cidr_truncate(ip: Column, length: int) -> Column:
    """``network/length`` of an address of either family."""
    cut = lambda n: F.concat(ipv4_text(F.shiftleft(F.shiftright(n, 32 - length), 32 - length)), F.lit(f"/{length}"))
    v4 = let(ipv4_number(ip), lambda n: F.when(n.isNotNull(), cut(n))) if length <= 32 else F.lit(None).cast("string")
    whole, bits = divmod(length, 4)

    def network(digits: Column) -> Column:
        kept = F.substring(digits, 1, whole)
        if bits:
            nibble = F.shiftleft(F.shiftright(F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int"), 4 - bits), 4 - bits)
            kept = F.concat(kept, F.lower(F.hex(nibble)))
        return F.concat(ipv6_text(F.rpad(kept, 32, "0")), F.lit(f"/{length}"))

    return F.when(is_ipv6(ip), let(ipv6_hex(ip), network)).otherwise(v4)


def ipv6_text(digits: Column) -> Column:
    """32 hex digits as the usual short text: no leading zeros, the first longest run of two or more zero groups as ``::``."""

    def short(text: Column) -> Column:
        run = F.coalesce(*[F.when(F.contains(text, F.lit(":" + "0:" * n)), F.lit(":" + "0:" * n)) for n in range(8, 1, -1)])
        cut = let(run, lambda z: F.when(z.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), F.position(z, text) - 1), F.lit("::"), F.substring(text, F.position(z, text) + F.length(z), F.lit(64)))))
        return F.regexp_replace(F.regexp_replace(cut, "^:(?!:)", ""), "(?<!:):$", "")

    groups = let(digits, lambda d: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(d, i * 4 + 1, F.lit(4)), "^0{1,3}", "")))
    return let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), short)


def packet_direction(src: Column, dst: Column, hosts: Sequence[str]) -> Column:
    """in if the destination is one of the hosts, else out if the source is, else unknown."""
    return F.when(cidr_match(dst, hosts).isNotNull(), "in").when(cidr_match(src, hosts).isNotNull(), "out").otherwise("unknown")


def ip_summarize(ip: Column, *, asn: Column | None = None, exclude_ips: Sequence[str] = (), exclude_asns: Sequence[str] = (), exclude_unknown: bool = False, subnets: Sequence[str] = (), by_asn: bool = False) -> Column:
    """An address as its ASN, its first matching subnet, its network under a wildcard subnet, or itself.

    Excluded addresses stay. By ASN unless the ASN is excluded (``N/`` prefixes) or, with ``exclude_unknown``,
    Unknown. A subnet of address zero is the wildcard of its family: at most one each.
    """
    wild = [(a, n) for a, n in parse_subnets(subnets) if int(ipaddress.ip_address(a)) == 0]
    if len(wild) != len({ipaddress.ip_address(a).version for a, _ in wild}):
        raise ValueError("only one wildcard subnet per family")
    listed = [s for s in subnets if int(ipaddress.ip_address(s.partition("/")[0])) != 0]
    out = ip
    for a, n in wild:
        six = ipaddress.ip_address(a).version == 6
        out = F.when(is_ipv6(ip) if six else ~is_ipv6(ip), cidr_truncate(ip, n)).otherwise(out)
    if listed:
        out = F.coalesce(cidr_match(ip, listed), out)
    if by_asn and asn is not None:
        skip = F.lit(False)
        if exclude_unknown:
            skip = skip | (asn == "Unknown")
        for n in exclude_asns:
            skip = skip | asn.startswith(f"{n}/")
        out = F.when(asn.isNotNull() & ~skip, asn).otherwise(out)
    return F.when(ip.isin(*exclude_ips), ip).otherwise(out) if exclude_ips else out


def conversation_key(a: Column, b: Column, a_port: Column, b_port: Column) -> Column:
    """The two ``ip:port`` texts, smaller first, joined by a slash; null unless both ports are positive."""
    return F.when((a_port > 0) & (b_port > 0) & a.isNotNull() & b.isNotNull(), F.concat_ws("/", F.least(a, b), F.greatest(a, b)))


def port_in_ranges(port: Column, ranges: Sequence[str | int]) -> Column:
    """Whether the port is one of the single ports or ``a-b`` ranges; a reversed range is turned round."""
    out = F.lit(False)
    for r in ranges:
        a, _, b = str(r).partition("-")
        if not a.strip().isdigit() or (b and not b.strip().isdigit()):
            raise ValueError(f"invalid port range: {r}")
        lo, hi = sorted((int(a), int(b or a)))
        out = out | port.between(lo, hi)
    return F.coalesce(out, F.lit(False))
