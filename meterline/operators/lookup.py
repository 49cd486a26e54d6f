"""Range lookups and dimension joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import ipv4_number, ipv6_hex
from ..storage import written
from .running import ROWS, latest


#: Rows of an index that are broadcast at most; a larger one is joined by shuffles of the distinct keys.
BROADCAST_ROWS = 500_000
#: Sizes of index blocks are powers of this.
RADIX = 16
#: IPv6 ranges under one prefix that rows are tested against in place: more than 15 of them nest or overlap.
UNDER_PREFIX = 16
#: Rows that have no key are spread over so many.
SPREAD = 4096


def range_index(ranges: DataFrame, values: Sequence[str], lo: str = "lo", hi: str = "hi", levels: int = 9) -> DataFrame:
    """``level, prefix, win``: the range that wins each block of ``RADIX ** level`` numbers that some range fills.

    A range is cut into the largest blocks that it fills, at most 30 of a level below the top; an aligned one, such as
    a subnet, into 8 at most. However ranges nest or overlap, a block has one row: the one of the latest start, then the
    earliest end, then the largest values. A number lies in one block of each level, so it meets at most ``levels`` rows.
    """
    pieces = ranges.select(F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi"), F.struct(*values).alias("v")).where("hi >= lo")
    none = F.array().cast("array<struct<level:int,prefix:bigint>>")

    def blocks(level: int, begin: Column, end: Column) -> Column:
        return F.when(begin < end, F.transform(F.sequence(begin, end - 1), lambda p: F.struct(F.lit(level).alias("level"), p.alias("prefix")))).otherwise(none)

    filled = lambda level: (F.ceil(F.col("lo") / RADIX**level).cast("bigint"), F.floor((F.col("hi") + 1) / RADIX**level).cast("bigint"))
    cut = []
    for level in range(levels):
        begin, end = filled(level)
        if level == levels - 1:
            cut.append(blocks(level, begin, end))
            continue
        above, below = filled(level + 1)
        inner = above < below  # what larger blocks take
        cut += [blocks(level, begin, F.when(inner, above * RADIX).otherwise(end)), F.when(inner, blocks(level, below * RADIX, end)).otherwise(none)]
    pieces = pieces.select("lo", "hi", "v", F.inline(F.concat(*cut)))
    return pieces.groupBy("level", "prefix").agg(F.max(F.struct("lo", (-F.col("hi")).alias("to"), "v")).alias("win"))


def _split(lo: Column, hi: Column) -> tuple[Column, Column]:
    """The smallest block of ``2 ** level`` numbers that holds both ends, as ``level, node``."""
    level = F.when(lo == hi, F.lit(0)).otherwise(F.length(F.bin(lo.bitwiseXOR(hi)))).cast("int")
    return level, F.when(level < 64, F.call_function("shiftright", lo, level)).otherwise(F.lit(0).cast("bigint"))


def range_wins(keys: DataFrame, key: str, ranges: DataFrame, values: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``key, _found`` of distinct keys that some range holds, for any number of ranges: the rule is that of :func:`range_join`.

    A range is filed once, under the smallest aligned block that holds it, and gives two rows: it covers the end of the
    block's left half from its start on, and the beginning of the right half up to its end. A key lies in one half of
    one block of each size, and the ranges filed there that hold it are those up to its place, in either order.
    """
    left, right = F.col(lo).cast("bigint"), F.col(hi).cast("bigint")
    level, node = _split(F.col("lo"), F.col("hi"))
    filed = ranges.select(left.alias("lo"), right.alias("hi"), F.struct(*values).alias("v")).where("hi >= lo").select(level.alias("level"), node.alias("node"), F.struct("lo", (-F.col("hi")).alias("to"), "v").alias("win"))
    levels = sorted(r["level"] for r in filed.select("level").distinct().collect())  # at most 65
    half = lambda right, place: F.struct(F.lit(right).alias("right"), place.alias("place"))
    ends = F.when(F.col("level") == 0, F.array(half(False, F.col("win.lo")))).otherwise(F.array(half(False, F.col("win.lo")), half(True, F.col("win.to") - 1)))
    marks = filed.select("level", "node", F.inline(ends), "win")
    k = F.col(key)
    blocks = []
    for n in levels:
        second = F.shiftright(k, n - 1).bitwiseAND(F.lit(1)) == 1 if n else F.lit(False)
        if n == 64:
            second = k >= 0  # negative numbers come first
        blocks.append(F.struct(F.lit(n).alias("level"), (F.shiftright(k, n) if n < 64 else F.lit(0).cast("bigint")).alias("node"), second.alias("right"), F.when(second, -k - 1).otherwise(k).alias("place")))
    if not blocks:
        return keys.select(key, F.lit(None).cast(filed.schema["win"].dataType["v"].dataType).alias("_found"))
    asked = keys.select(key, F.inline(F.array(*blocks)))
    return latest(marks, asked, ["level", "node", "right"], "place", "win", wide=F.col("level") > ROWS.bit_length() - 2).groupBy(key).agg(F.max("win")["v"].alias("_found"))


def _found_join(df: DataFrame, key: Column, found: DataFrame, broadcast_rows: int) -> DataFrame:
    """``df`` left-joined with what was ``found`` for distinct keys (``_key``), written first: broadcast if it is small, else
    joined by shuffles that AQE may split. Rows without a key find nothing and are spread, so they don't meet in one task."""
    found = written(found, "found")
    if found.count() <= broadcast_rows:
        return df.join(F.broadcast(found), key == F.col("_key"), "left").drop("_key")
    spread = df.withColumn("_at", F.coalesce(key.cast("string"), F.concat(F.lit("none "), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))))
    return spread.join(found.withColumn("_key", F.col("_key").cast("string")), F.col("_at") == F.col("_key"), "left").drop("_at", "_key")


def range_join(df: DataFrame, key: str, ranges: DataFrame, values: Sequence[str], *, lo: str = "lo", hi: str = "hi", prefix: str = "", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` left-joined with the range that holds ``key`` (whole numbers): ``prefix + value`` columns, null if none.

    Overlapping ranges: the latest start, then the earliest end, wins. Ranges are counted: if there are at most
    ``broadcast_rows`` blocks of them (:func:`range_index`), these are broadcast, one hash probe for each level that
    the index has; else distinct keys meet the ranges by shuffles of two rows a range (:func:`range_wins`).
    """
    at = F.col(key).cast("bigint")
    sizes: dict[int, int] = {}
    small = ranges.where(F.col(hi).cast("bigint") >= F.col(lo).cast("bigint")).count() <= broadcast_rows
    if small:
        index = written(range_index(ranges, values, lo, hi), "ranges")
        sizes = {r["level"]: r["count"] for r in index.groupBy("level").count().collect()}  # a row a level
        if not sizes:
            kinds = {f.name: f.dataType for f in ranges.schema}
            return df.select("*", *[F.lit(None).cast(kinds[v]).alias(prefix + v) for v in values])
    block = lambda number, level: F.floor(number / RADIX**level).cast("bigint")
    if small and sum(sizes.values()) <= broadcast_rows:
        out = df
        for level in sorted(sizes):
            own = index.where(F.col("level") == level).select(F.col("prefix").alias(f"_p{level}"), F.col("win").alias(f"_w{level}"))
            out = out.join(F.broadcast(own), block(at, level) == F.col(f"_p{level}"), "left")
        wins = [F.col(f"_w{level}") for level in sorted(sizes)]
        out = out.withColumn("_found", (F.greatest(*wins) if len(wins) > 1 else wins[0])["v"])
    else:
        keys = df.select(at.alias("_key")).where("_key is not null").distinct()
        out = _found_join(df, at, range_wins(keys, "_key", ranges, values, lo, hi), broadcast_rows)
    return out.select(*df.columns, *[F.col(f"_found.{v}").alias(prefix + v) for v in values])


def subnet_lookup(df: DataFrame, ip: str, subnets: DataFrame, *, subnet: str = "subnet", order: str = "ord", out: str = "subnet") -> DataFrame:
    """``df`` with the first subnet by ``order`` (ties: by text), as written, that holds the address; null if none.

    For lists of any length, both families: the rules are those of ``cidr_match``, which is for short lists. Distinct
    addresses ask for their network of each prefix length that the list has (at most 33 and 128), by one equi-join.
    Rows of the list that are no subnet hold nothing.
    """
    parts = F.split(F.col(subnet), "/")
    net, length = parts[0], F.get(parts, F.lit(1)).try_cast("int")
    table = subnets.select(F.struct(F.col(order).alias("ord"), F.col(subnet).cast("string").alias("subnet")).alias("first"), ipv4_number(net).alias("n"), F.when(net.contains(":"), ipv6_hex(net)).alias("x"), length.alias("length"))
    fits = (F.col("n").isNotNull() & F.col("length").between(0, 32)) | (F.col("x").isNotNull() & F.col("length").between(1, 128))
    table = table.where(fits).withColumn("six", F.col("n").isNull())
    lengths = sorted((r["six"], r["length"]) for r in table.select("six", "length").distinct().collect())  # at most 161

    def asked(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """A row for each prefix length: the network of ``n`` or ``x`` as text."""
        each = []
        for six, bits in lengths:
            if six:
                digits, rest = divmod(bits, 4)
                tail = F.shiftright(F.conv(F.substring("x", digits + 1, 1), 16, 10).cast("int"), 4 - rest).cast("string") if rest else F.lit("")
                network = F.when(F.col("x").isNotNull(), F.concat(F.substring("x", 1, digits), F.lit("."), tail))
            else:
                network = F.shiftright(F.col("n"), 32 - bits).cast("string")
            each.append(F.when(network.isNotNull(), F.struct(F.lit(six).alias("six"), F.lit(bits).alias("length"), network.alias("network"))))
        none = F.array().cast("array<struct<six:boolean,length:int,network:string>>")
        return rows.select(*keep, F.inline(F.array_compact(F.array(*each)) if each else none))

    named = asked(table.withColumnsRenamed({"length": "own", "six": "own_six"}), ["first", "own", "own_six"]).where("own = length and own_six = six")
    first = named.groupBy("six", "length", "network").agg(F.min("first").alias("first"))
    address = F.col(ip)
    keys = df.select(address.alias("_ip")).where("_ip is not null").distinct().select("_ip", ipv4_number(F.col("_ip")).alias("n"), F.when(F.col("_ip").contains(":"), ipv6_hex(F.col("_ip"))).alias("x"))
    keys = keys.withColumn("n", F.when(F.col("n") != 0, F.col("n")))  # 0.0.0.0 is in no subnet
    hits = asked(keys, ["_ip"]).join(first, ["six", "length", "network"]).groupBy(F.col("_ip").alias("_key")).agg(F.min("first")["subnet"].alias("_hit"))
    return _found_join(df, address, hits, BROADCAST_ROWS).select(*[c for c in df.columns if c != out], F.col("_hit").alias(out))


def _v6_lookup(df: DataFrame, digits: str, ranges: DataFrame, value: str, out: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the value of the IPv6 range (hex digits ``lo``, ``hi``) that holds ``digits``: the rule is that of :func:`range_join`.

    A range is filed under the digits that its ends have in common; an address asks under its first digits, as many
    as ranges have (at most 33 lengths, read from the table). Ranges are counted: if there are at most ``broadcast_rows``,
    and no prefix has more than ``UNDER_PREFIX``, they are broadcast, one hash probe for each length; else distinct
    addresses meet them by shuffles.
    """
    same = [F.when(F.substring("lo", 1, n) == F.substring("hi", 1, n), F.lit(n)).otherwise(F.lit(0)) for n in range(33)]
    # the later start, then the earlier end, then the larger value is the greater one
    win = F.struct("lo", F.translate("hi", "0123456789abcdef", "fedcba9876543210").alias("to"), F.col(value).alias("v"), "hi").alias("_win")
    filed = ranges.select("lo", "hi", win, F.greatest(*same).alias("_length")).select("_length", F.substring(F.col("lo"), F.lit(1), F.col("_length")).alias("_prefix"), "_win")
    filed = written(filed, "ranges")
    sizes = {r["_length"]: (r["n"], r["most"]) for r in filed.groupBy("_length", "_prefix").count().groupBy("_length").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()}  # a row a length
    if not sizes:
        return df.withColumn(out, F.lit(None).cast(ranges.schema[value].dataType))
    key = F.col(digits)
    holds = lambda w: key.between(w["lo"], w["hi"])
    if sum(n for n, _ in sizes.values()) <= broadcast_rows and max(most for _, most in sizes.values()) <= UNDER_PREFIX:
        listed = filed.groupBy("_length", "_prefix").agg(F.sort_array(F.collect_list("_win"), asc=False).alias("_wins"))
        found, wins = df, []
        for n, (_, most) in sorted(sizes.items()):
            own = listed.where(F.col("_length") == n).select(F.col("_prefix").alias(f"_p{n}"), F.col("_wins").alias(f"_w{n}"))
            found = found.join(F.broadcast(own), F.substring(key, 1, n) == F.col(f"_p{n}"), "left")
            each = [F.get(F.col(f"_w{n}"), F.lit(i)) for i in range(most)]
            wins.append(F.coalesce(*[F.when(holds(w), w) for w in each]))
        best = (F.greatest(*wins) if len(wins) > 1 else wins[0])["v"]
        return found.select(*df.columns, best.alias(out))
    keys = df.select(key.alias("_key")).where("_key is not null").distinct().withColumn("_length", F.explode(F.array(*map(F.lit, sorted(sizes)))))
    hits = keys.withColumn("_prefix", F.substring(F.col("_key"), F.lit(1), F.col("_length"))).join(filed, ["_length", "_prefix"]).where(F.col("_key").between(F.col("_win.lo"), F.col("_win.hi")))
    return _found_join(df, key, hits.groupBy("_key").agg(F.max("_win")["v"].alias(out)), broadcast_rows)


def geo_lookup(df: DataFrame, ip: str, ranges: DataFrame, *, out: str = "location", ranges_v6: DataFrame | None = None, value: str = "location") -> DataFrame:
    """``df`` with the location (or any ``value``) of an address; a miss is ``Unknown``, a null address null."""
    found = range_join(df.withColumn("_n", ipv4_number(F.col(ip))), "_n", ranges, [value], prefix="_v4_")
    best = F.col(f"_v4_{value}")
    if ranges_v6 is not None:
        found = _v6_lookup(found.withColumn("_h", ipv6_hex(F.col(ip))), "_h", ranges_v6, value, "_six")
        best = F.coalesce(best, F.col("_six"))
    return found.withColumn(out, F.when(F.col(ip).isNotNull(), F.coalesce(best, F.lit("Unknown")))).select(*[c for c in df.columns if c != out], out)


def asn_lookup(df: DataFrame, ip: str, ranges: DataFrame, *, out: str = "asn", ranges_v6: DataFrame | None = None) -> DataFrame:
    return geo_lookup(df, ip, ranges, out=out, ranges_v6=ranges_v6, value="asn")


def join_services(df: DataFrame, port: str, proto: str, services: DataFrame, *, out: str = "service", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the service of a port: the first range, by its end, that ends at or after the port, if it holds the
    port; else the number as text. Protocols other than udp are looked up as tcp.

    The ports of the registry are counted: up to ``broadcast_rows`` they are broadcast; the distinct ports of ``df`` ask
    a larger one, and only their names are joined.
    """
    table = services.groupBy("proto", "port_hi").agg(F.min_by(F.struct("port_lo", "name"), "port_lo").alias("s")).select("proto", "port_hi", "s.port_lo", "s.name")
    wanted = F.when(F.lower(F.col(proto)) == "udp", "udp").otherwise("tcp")
    ports = services.agg(F.sum(F.greatest(F.col("port_hi").cast("bigint") - F.col("port_lo").cast("bigint") + 1, F.lit(1)))).first()[0] or 0
    if ports <= broadcast_rows:
        ordered = Window.partitionBy("proto").orderBy("port_hi")
        table = table.withColumn("_from", F.coalesce(F.lag("port_hi").over(ordered) + 1, F.lit(0))).where("greatest(_from, port_lo) <= port_hi")
        table = F.broadcast(table.select(F.col("proto").alias("_proto"), F.explode(F.sequence(F.greatest("_from", "port_lo"), F.col("port_hi"))).alias("_port"), F.col("name").alias("_name")))
    else:
        asked = df.select(wanted.alias("_proto"), F.col(port).cast("bigint").alias("_port"), (-F.col(port).cast("bigint")).alias("_place")).where("_port is not null").distinct()
        ends = table.where("proto is not null").select(F.col("proto").alias("_proto"), (-F.col("port_hi").cast("bigint")).alias("_place"), F.struct((-F.col("port_hi").cast("bigint")).alias("end"), "port_lo", "name").alias("_first"))
        found = latest(ends, asked, ["_proto"], "_place", "_first").where("_port >= 0 and _port >= coalesce(_first.port_lo, 0)")
        table = written(found.select("_proto", "_port", F.col("_first.name").alias("_name")), "services")
        table = F.broadcast(table) if table.count() <= broadcast_rows else table
    joined = df.join(table, (wanted == F.col("_proto")) & (F.col(port) == F.col("_port")), "left")
    return joined.withColumn(out, F.coalesce("_name", F.col(port).cast("string"))).select(*[c for c in df.columns if c != out], out)


def public_suffix_size(df: DataFrame, qname: str, suffixes: DataFrame, *, out: str = "suffix_size") -> DataFrame:
    """``df`` with the length of the public suffix of a name and the dot before it; 0 without dot, with a trailing dot, or for an unknown last label.

    The first suffix of the last label's list that ends the name counts, without regard to label boundaries. Distinct
    names ask for their last characters, once for each length that suffixes of their last label have, by one equi-join.
    """
    table = suffixes.groupBy(F.col("tld").alias("_tld"), F.col("suffix").alias("_end")).agg(F.min("ord").alias("_ord"))
    lengths = suffixes.groupBy(F.col("tld").alias("_tld")).agg(F.collect_set(F.length("suffix")).alias("_lengths"))
    name = F.lower(F.col(qname))
    label = F.when(F.contains(name, F.lit(".")) & ~name.endswith("."), F.substring_index(name, ".", -1))
    asked = df.select(name.alias("_name"), label.alias("_tld")).where("_tld is not null").distinct().join(lengths, "_tld")
    each = asked.select("_name", "_tld", F.explode("_lengths").alias("_n")).where("_n > 0 and _n <= length(_name)").withColumn("_end", F.expr("right(_name, _n)"))
    hits = each.join(table, ["_tld", "_end"]).groupBy("_name").agg(F.min(F.struct("_ord", "_n"))["_n"].alias("_hit"))
    known = asked.select("_name", F.length("_tld").alias("_short")).join(hits, "_name", "left").select(F.col("_name").alias("_of"), (F.coalesce("_hit", "_short") + 1).alias("_size"))
    return df.join(known, name == F.col("_of"), "left").withColumn(out, F.coalesce("_size", F.lit(0))).select(*[c for c in df.columns if c != out], out)


def enrich_devices(df: DataFrame, devices: DataFrame, interfaces: DataFrame, *, device: str = "device_ip", interface: str = "interface") -> DataFrame:
    """``df`` with ``device_name`` and ``interface_name``; the address and the index where there is no name."""
    d = devices.select(F.col("device_ip").alias("_d"), F.col("name").alias("_dn"))
    i = interfaces.select(F.col("device_ip").alias("_id"), F.col("if_index").alias("_ix"), F.col("name").alias("_in"))
    out = df.join(d, F.col(device) == F.col("_d"), "left").join(i, (F.col(device) == F.col("_id")) & (F.col(interface) == F.col("_ix")), "left")
    return out.select(*df.columns, F.coalesce("_dn", F.col(device).cast("string")).alias("device_name"), F.coalesce("_in", F.col(interface).cast("string")).alias("interface_name"))


def starts_with_any(value: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | value.startswith(p)
    return F.coalesce(out, F.lit(False))
