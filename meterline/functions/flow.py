"""Flow exports to records as column expressions and small plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_rate_scale(flow_type: Column, packets: Column, octets: Column, mean_skip: Column, sampled_size: Column, scale: bool = True) -> tuple[Column, Column]:
    """Packets and octets of a record; sampled (sFlow) ones scaled up by the mean skip count, or counted once."""
    sampled = F.lower(flow_type) == "sflow"
    if scale:
        return F.when(sampled, mean_skip).otherwise(packets), F.when(sampled, mean_skip * sampled_size).otherwise(octets)
    return F.when(sampled, F.lit(1)).otherwise(packets), F.when(sampled, sampled_size).otherwise(octets)


def l4_name(proto: Column) -> Column:
    return F.when(proto == 6, "tcp").when(proto == 17, "udp").otherwise("other")


def explode_flow_records(exports: DataFrame, scale: bool = True) -> DataFrame:
    """One row a record; sFlow counter samples give none. Protocol becomes tcp, udp or other."""
    kept = exports.where(~((F.lower("flow_type") == "sflow") & (F.coalesce(F.lower("sample_type"), F.lit("")) == "counter")))
    # outer, as Spark tests the size of a list else, for which it would make every record twice
    r = kept.select("device_ip", "ts", "flow_type", *[c for c in ("seq",) if c in exports.columns], F.posexplode_outer("records").alias("record", "r")).where("record is not null")
    packets, octets = sample_rate_scale(F.col("flow_type"), F.col("r.packets"), F.col("r.octets"), F.col("r.mean_skip_count"), F.col("r.sampled_packet_size"), scale)
    fields = [F.col(f"r.{c}").alias(c) for c in ("tos", "src_ip", "dst_ip", "src_port", "dst_port", "if_in", "if_out")]
    return r.select(*[c for c in r.columns if c != "r"], F.when(F.col("r.is_ipv6"), "ipv6").otherwise("ipv4").alias("l3"), l4_name(F.col("r.proto")).alias("l4"), *fields, packets.alias("packets"), octets.alias("bytes"))


def flow_directions(records: DataFrame) -> DataFrame:
    """Each record once for its input and once for its output interface; a missing interface gives no row."""
    sides = F.array(F.struct(F.lit("in").alias("dir"), F.col("if_in").alias("interface")), F.struct(F.lit("out").alias("dir"), F.col("if_out").alias("interface")))
    return records.select("*", F.inline(sides)).where("interface is not null")


def direction_totals(records: DataFrame) -> DataFrame:
    """``device, dir, bytes, packets, src_ips, interfaces, all_directions`` of records, by direction and (``dir`` null) over both.

    A record gives one row for its source, with the directions it counts in, and one for each of its interfaces, with the
    sums. These are added up by item, interfaces before the shuffle already; distinct counts are then counts of rows.
    """
    none = F.lit(None).cast("bigint")
    came, went = F.col("if_in").isNotNull(), F.col("if_out").isNotNull()

    def tag(side: Column, item: Column, ins: Column, outs: Column, sums: Sequence[Column]) -> Column:
        return F.struct(side.alias("side"), item.cast("string").alias("item"), ins.alias("ins"), outs.alias("outs"), *[s.cast("bigint").alias(n) for s, n in zip(sums, _SUMS)])

    yes, no = F.lit(True), F.lit(False)
    tags = F.array_compact(F.array(
        F.when(came | went, tag(no, F.col("src_ip"), came, went, [none] * 4)), F.when(came, tag(yes, F.col("if_in"), yes, no, [F.col("bytes"), F.col("packets"), none, none])),
        F.when(went, tag(yes, F.col("if_out"), no, yes, [none, none, F.col("bytes"), F.col("packets")])),
    ))
    items = records.select(F.col("device_ip").alias("device"), F.inline(tags)).groupBy("device", "side", "item").agg(F.max("ins").alias("ins"), F.max("outs").alias("outs"), *[F.sum(n).alias(n) for n in _SUMS])
    known, sources = F.col("item").isNotNull(), ~F.col("side")
    kinds = {"in": F.col("ins"), "out": F.col("outs"), "all": yes}
    counts = [F.count_if(known & test & mine).alias(f"{n}_{kind}") for kind, mine in kinds.items() for n, test in (("src_ips", sources), ("interfaces", F.col("side")))]
    per = items.groupBy("device").agg(F.max("ins").alias("ins"), F.max("outs").alias("outs"), *[F.sum(n).alias(n) for n in _SUMS], *counts)
    both = lambda n: F.coalesce(F.col(f"{n}_in") + F.col(f"{n}_out"), f"{n}_in", f"{n}_out")

    def line(kind: str, dir: Column, all_directions: int) -> Column:
        sums = [both(n) if kind == "all" else F.col(f"{n}_{kind}") for n in ("bytes", "packets")]
        return F.struct(dir.alias("dir"), sums[0].alias("bytes"), sums[1].alias("packets"), F.col(f"src_ips_{kind}").alias("src_ips"), F.col(f"interfaces_{kind}").alias("interfaces"), F.lit(all_directions).alias("all_directions"))

    lines = F.array_compact(F.array(F.when(F.col("ins"), line("in", F.lit("in"), 0)), F.when(F.col("outs"), line("out", F.lit("out"), 0)), line("all", F.lit(None).cast("string"), 1)))
    return per.select("device", F.inline(lines))


_SUMS = ("bytes_in", "packets_in", "bytes_out", "packets_out")


def deep_flag(rate: int, *key: Column, seed: int = 0) -> Column:
    """True for about ``rate`` per cent (1 to 100) of the keys, the same ones every time."""
    rate = min(100, max(1, rate))
    if rate == 100:
        return F.lit(True)
    text = F.concat_ws("/", *[k.cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % 100 < rate


def first_ip_roles(dir: Column, src: Column, dst: Column, version: int = 2) -> Column:
    """The peer addresses of a packet: source when in, destination when out; unknown: both (version 2) or none (1)."""
    both = F.array(src, dst) if version == 2 else F.array().cast("array<string>")
    return F.filter(F.when(dir == "in", F.array(src)).when(dir == "out", F.array(dst)).otherwise(both), lambda x: x.isNotNull())
