"""Reports over metric tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.periods import PeriodError, bucket


def share(part: Column, whole: Column) -> Column:
    """Percentage of a whole; null of nothing."""
    return F.try_divide(part * 100.0, whole)


def _wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Counters of each period as columns; missing ones are 0."""
    aggs = [F.coalesce(F.sum(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names]
    return metrics.where(F.col("kind") == "counter").groupBy("policy", "period_start").agg(*aggs)


def traffic_header(metrics: DataFrame) -> DataFrame:
    """Shares of all packets by transport and family; in and out as shares of both together."""
    w = _wide(metrics, ["udp", "tcp", "other_l4", "ipv4", "ipv6", "in", "out", "total"])
    both = F.col("in") + F.col("out")
    return w.select("policy", "period_start", "total", *[share(F.col(n), F.col("total")).alias(f"{n}_pct") for n in ("udp", "tcp", "other_l4", "ipv4", "ipv6")], share(F.col("in"), both).alias("in_pct"), share(F.col("out"), both).alias("out_pct"))


def dns_header(metrics: DataFrame) -> DataFrame:
    names = [f"wire_packets_{n}" for n in ("total", "udp", "tcp", "ipv4", "ipv6", "queries", "replies", "noerror", "nxdomain", "refused", "srvfail")] + ["xact_counts_total", "xact_in_total", "xact_out_total", "xact_counts_timed_out"]
    w = _wide(metrics, names)
    of_all = [share(F.col(f"wire_packets_{n}"), F.col("wire_packets_total")).alias(f"{n}_pct") for n in ("udp", "tcp", "ipv4", "ipv6", "queries", "replies")]
    of_replies = [share(F.col(f"wire_packets_{n}"), F.col("wire_packets_replies")).alias(f"{n}_pct") for n in ("noerror", "nxdomain", "refused", "srvfail")]
    xacts = [share(F.col(f"xact_{n}_total"), F.col("xact_counts_total")).alias(f"xact_{n}_pct") for n in ("in", "out")]
    times = metrics.where("kind = 'quantile' and name in ('xact_in_quantiles_us', 'xact_out_quantiles_us') and stat like 'p%'").groupBy("policy", "period_start").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("_", "name", "stat"), F.col("value") / 1000)))).alias("times_ms"))
    return w.select("policy", "period_start", "wire_packets_total", *of_all, *of_replies, *xacts, "xact_counts_timed_out").join(times, ["policy", "period_start"], "left")


def dhcp_header(metrics: DataFrame) -> DataFrame:
    kinds = ("discover", "offer", "request", "ack")
    w = _wide(metrics, [f"wire_packets_{n}" for n in ("total", "filtered", *kinds)])
    base = F.col("wire_packets_total") - F.col("wire_packets_filtered")
    return w.select("policy", "period_start", base.alias("total"), *[share(F.col(f"wire_packets_{n}"), base).alias(f"{n}_pct") for n in kinds])


def top_table_share(tops: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Top rows (keys, item, estimate, rank) with their share of ``base x deep / total``; only the first three show one.

    ``totals``: keys, base, deep, total.
    """
    corrected = F.try_divide(F.col("base") * F.col("deep"), F.col("total"))
    return tops.join(totals, keys).withColumn("share_pct", F.when(F.col("rank") <= 3, share(F.col("estimate"), corrected))).select(*tops.columns, "share_pct")


def fleet_top_n(rows: DataFrame, n: int = 10) -> DataFrame:
    """Tops of many hosts, ``metric, name, estimate, total, deep``, as one: lower-case names, estimates scaled by the
    rounded sampling ratio, summed; the first ``n`` of each metric."""
    scaled = F.col("estimate") * F.coalesce(F.round(F.try_divide(F.col("total").cast("double"), F.col("deep").cast("double"))), F.lit(1.0)).cast("bigint")
    sums = rows.groupBy("metric", F.lower("name").alias("name")).agg(F.sum(scaled).alias("estimate"))
    order = Window.partitionBy("metric").orderBy(F.desc("estimate"), "name")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def summary_report(handlers: dict, tables: dict[str, DataFrame], options, periods: int = 1) -> DataFrame:
    """The report on a recorded file: every handler's metrics of the newest period, or of the newest ``periods`` merged.

    ``handlers``: name → function of (table, options). Events of the merged periods are aggregated together, so
    distinct counts, quantiles and tops are those of the whole window.
    """
    out = None
    for name, fn in handlers.items():
        m = bucket(fn(tables[name], options), 0, keys=["policy", "handler"]) if periods == 1 else fn(tables[name], replace(options, merge=periods))
        out = m if out is None else out.unionByName(m)
    return out


def all_policies(metrics: DataFrame, period: int = 0, n: int | None = None) -> DataFrame:
    """The given period of every policy's handlers; policies that don't have it are skipped."""
    try:
        return bucket(metrics, period, n, keys=["policy", "handler"])
    except PeriodError:
        if period >= (5 if n is None else n):
            raise
        return metrics.limit(0)
