"""Names, ports and directions of DNS messages as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import let
from .codes import DNS_PORTS


def aggregate_domain(qname: Column, suffix_size: Column | int = 0) -> Column:
    """Struct ``qname2, qname3``: the name cut to its last two and last three labels beyond the suffix.

    Names under five characters, and names without a second dot, come back whole with an empty second part; a name
    without a dot before the suffix comes back twice.
    """
    size = F.lit(suffix_size) if isinstance(suffix_size, int) else F.coalesce(suffix_size, F.lit(0))
    n = F.length(qname)
    # characters (counted from 1) that may hold the first dot
    upto = F.when((size > 0) & (n > size), n - size + 1).when(qname.endswith("."), n - 1).otherwise(n)

    head = F.substring(qname, F.lit(1), F.greatest(upto, F.lit(0)))

    def dot(h: Column, back: int) -> Column:
        """Place, from 1, of the last dot of ``h``, the one before it, and so on; 0 if none."""
        return F.length(h) - F.length(F.substring_index(h, ".", -back))

    from_ = lambda d: F.substring(qname, d, n)

    def parts(d1: Column, d2: Column, d3: Column) -> Column:
        two = F.when((n < 5) | (d1 <= 1) | (d2 == 0), qname).otherwise(from_(d2))
        three = F.when(n < 5, "").when(d1 <= 1, qname).when(d2 == 0, "").when((d2 == 1) | (d3 == 0), qname).otherwise(from_(d3))
        return F.struct(two.alias("qname2"), three.alias("qname3"))

    return let(head, lambda h: parts(dot(h, 1), dot(h, 2), dot(h, 3)))


def suffix_size(qname: Column, suffixes: Sequence[str]) -> Column:
    """Length of the first listed suffix, in any case, that ends the name; null if none does."""
    name, out = F.lower(qname), F.lit(None).cast("int")
    for s in reversed(list(suffixes)):
        out = F.when(name.endswith(s.lower()), len(s)).otherwise(out)
    return out


def metric_port(src: Column, dst: Column) -> Column:
    """The port of the other side of a DNS exchange; null if neither port is a DNS port."""
    return F.when(dst.isin(*DNS_PORTS), src).when(src.isin(*DNS_PORTS), dst)


def xact_direction(dir: Column, is_response: Column) -> Column:
    """Direction of the query of an exchange: a response to the host belongs to a query that went out."""
    flipped = F.when(dir == "in", "out").when(dir == "out", "in").otherwise("unknown")
    return F.when(is_response, flipped).otherwise(F.when(dir.isin("in", "out"), dir).otherwise("unknown"))


def response_ratio(response_bytes: Column, query_bytes: Column) -> Column:
    return F.when(query_bytes > 0, response_bytes / query_bytes)
