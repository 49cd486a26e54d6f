"""The standard tables read as telemetry: one view a table, as DataFrames and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: type gives direction and transport, user and ``k`` the addresses, value the bytes."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("u", F.col("user_id") % 256)
    kind = F.col("event_type")
    return e.select(
        F.lit("all").alias("stream"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "view", "in").when(kind == "click", "out").otherwise("unknown").alias("dir"),
        F.when(F.col("user_id") % 5 == 0, "ipv6").otherwise("ipv4").alias("l3"),
        F.when(kind == "purchase", "tcp").when(kind == "signup", "udp").when(kind != "error", F.when(F.col("k") % 2 == 1, "tcp").otherwise("udp")).alias("l4"),
        F.concat_ws(".", F.lit("10.0"), F.col("u").cast("string"), F.col("k").cast("string")).alias("src_ip"), F.concat_ws(".", F.lit("10.1"), F.col("k").cast("string"), F.col("u").cast("string")).alias("dst_ip"),
        (F.col("k") + 1000).alias("src_port"), F.lit(53).alias("dst_port"), F.round(F.col("value") * 100).cast("bigint").alias("bytes"), (F.col("k") % 10 == 0).alias("syn"), F.col("event_id").alias("seq"),
    )


PACKETS_SQL = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 256 AS u FROM events),
packets AS (SELECT ts, CASE event_type WHEN 'view' THEN 'in' WHEN 'click' THEN 'out' ELSE 'unknown' END AS dir, CASE WHEN user_id % 5 = 0 THEN 'ipv6' ELSE 'ipv4' END AS l3,
  CASE WHEN event_type = 'purchase' THEN 'tcp' WHEN event_type = 'signup' THEN 'udp' WHEN event_type = 'error' THEN NULL WHEN k % 2 = 1 THEN 'tcp' ELSE 'udp' END AS l4,
  '10.0.' || u || '.' || k AS src_ip, '10.1.' || k || '.' || u AS dst_ip, CAST(round(value * 100) AS BIGINT) AS bytes, k % 10 = 0 AS syn, event_id AS seq, k, user_id, event_type,
  CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS period, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM e)"""


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases as DNS responses, other events as queries, of one transaction id each ``k``."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    response = F.col("event_type").isin("click", "purchase")
    return e.select(
        F.lit("all").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.when(response, "out").otherwise("in").alias("dir"), response.alias("is_response"), F.col("k").alias("txid"), F.lit(0).cast("bigint").alias("flow_key"),
        F.concat(F.lit("H"), F.col("k").cast("string"), F.lit(".d"), (F.col("k") % 7).cast("string"), F.lit(".example.com")).alias("qname"), (F.col("k") % 3 + 1).alias("qtype"), (F.col("user_id") % 6).cast("int").alias("rcode"),
        (F.col("k") % 4 == 0).alias("aa"), (F.col("k") % 5 == 0).alias("ad"), (F.col("user_id") % 2 == 0).alias("cd"), (F.col("user_id") % 3).cast("int").alias("answer_count"), F.when(F.col("user_id") % 7 == 0, F.array(F.lit(46))).otherwise(F.array(F.lit(1))).alias("answer_types"),
        F.lit(None).cast("string").alias("ecs"), F.lit("ipv4").alias("l3"), F.when(F.col("k") % 2 == 0, "udp").otherwise("tcp").alias("transport"), F.when(response, 53).otherwise(F.col("k") + 1000).cast("int").alias("src_port"), F.when(response, F.col("k") + 1000).otherwise(53).cast("int").alias("dst_port"),
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"), F.col("event_id").alias("seq"),
    )


DNS_SQL = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
d AS (SELECT ts, event_id AS seq, event_type IN ('click', 'purchase') AS is_response, k AS txid, 'h' || k || '.d' || (k % 7) || '.example.com' AS qname, k % 3 + 1 AS qtype, user_id % 6 AS rcode, user_id % 3 AS answer_count, k % 2 = 0 AS udp,
  user_id % 2 = 0 AS cd, user_id % 7 = 0 AS signed, CAST(round(value * 100) AS BIGINT) AS bytes, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS period FROM e),
p AS (SELECT *, lag(is_response) OVER w AS was, lag(ts) OVER w AS then_ts, lag(bytes) OVER w AS query_bytes, lag(cd) OVER w AS query_cd, lead(is_response) OVER w AS next_is, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM d WINDOW w AS (PARTITION BY txid ORDER BY ts, seq)),
x AS (SELECT *, CASE WHEN is_response THEN CASE WHEN was IS NULL OR was THEN 'orphan' WHEN gap >= {ttl}000000 THEN 'timed_out' ELSE 'valid' END ELSE CASE WHEN next_is IS NULL THEN 'open' WHEN next_is THEN 'answered' ELSE 'replaced' END END AS status,
  CASE WHEN is_response AND NOT was THEN gap END AS elapsed_us FROM p)"""

#: The same after purging: y has the status, and ``late``, the period in which a row counts as a timeout. A shift is at
#: the first second of a period's events; it removes open queries begun ``ttl`` seconds or more before.
DNS_PURGED_SQL = (
    DNS_SQL
    + """,
st AS (SELECT period AS opened, min(sec) AS start FROM d GROUP BY 1),
ends AS (SELECT x.*, lead(sec) OVER (PARTITION BY txid ORDER BY ts, seq) AS end_sec, sec + {ttl} AS due FROM x),
sh AS (SELECT ends.*, st.start, st.opened FROM ends ASOF LEFT JOIN st ON ends.due <= st.start),
gp AS (SELECT *, NOT is_response AND start IS NOT NULL AND (end_sec IS NULL OR end_sec >= start) AS gone FROM sh),
zp AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY txid ORDER BY ts, seq), false) AS before FROM gp),
y AS (SELECT * EXCLUDE (status), CASE WHEN gone THEN 'purged' WHEN is_response AND before THEN 'orphan' ELSE status END AS status, CASE WHEN gone THEN opened WHEN is_response AND NOT before AND status = 'timed_out' THEN period END AS late FROM zp)"""
)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flow exports of one record: supplier is the device, line number the interface."""
    li = table(spark, sf_dir, "lineitem")
    ip = lambda net, c: F.concat_ws(".", F.lit(net), F.floor(F.col(c) / 65536).cast("string"), (F.floor(F.col(c) / 256) % 256).cast("string"), (F.col(c) % 256).cast("string"))
    record = F.struct(
        (F.col("l_linestatus") == "O").alias("is_ipv6"), F.when(F.col("l_returnflag") == "A", 6).when(F.col("l_returnflag") == "N", 17).otherwise(1).alias("proto"), ((F.col("l_linenumber") * 40) % 256).cast("int").alias("tos"),
        ip("10", "l_partkey").alias("src_ip"), ip("172", "l_orderkey").alias("dst_ip"), (F.col("l_partkey") % 1000).cast("int").alias("src_port"), (F.col("l_orderkey") % 500).cast("int").alias("dst_port"),
        F.col("l_linenumber").cast("bigint").alias("if_in"), F.when(F.col("l_linenumber") % 3 != 0, (F.lit(8) - F.col("l_linenumber")).cast("bigint")).alias("if_out"),
        F.floor("l_quantity").cast("bigint").alias("packets"), F.floor("l_extendedprice").cast("bigint").alias("octets"), F.lit(None).cast("bigint").alias("mean_skip_count"), F.lit(None).cast("bigint").alias("sampled_packet_size"),
    )
    return li.select(F.concat(F.lit("10.255.0."), (F.col("l_suppkey") % 250).cast("string")).alias("device_ip"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.lit("netflow").alias("flow_type"), F.lit("flow").alias("sample_type"), F.array(record).alias("records"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


FLOWS_SQL = """
f AS (SELECT '10.255.0.' || (l_suppkey % 250) AS device, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS period, CASE WHEN l_linestatus = 'O' THEN 'ipv6' ELSE 'ipv4' END AS l3, CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'udp' ELSE 'other' END AS l4, (l_linenumber * 40) % 256 AS tos,
  '10.' || (l_partkey // 65536) || '.' || (l_partkey // 256 % 256) || '.' || (l_partkey % 256) AS src_ip, '172.' || (l_orderkey // 65536) || '.' || (l_orderkey // 256 % 256) || '.' || (l_orderkey % 256) AS dst_ip, l_partkey % 1000 AS src_port, l_orderkey % 500 AS dst_port,
  CAST(l_linenumber AS BIGINT) AS if_in, CASE WHEN l_linenumber % 3 != 0 THEN CAST(8 - l_linenumber AS BIGINT) END AS if_out, CAST(floor(l_quantity) AS BIGINT) AS packets, CAST(floor(l_extendedprice) AS BIGINT) AS bytes, l_partkey, l_orderkey, l_suppkey FROM lineitem),
sides AS (SELECT *, 'in' AS dir, if_in AS interface FROM f WHERE if_in IS NOT NULL UNION ALL SELECT *, 'out' AS dir, if_out AS interface FROM f WHERE if_out IS NOT NULL)"""


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand addresses of 10.0.0.0/8 for each nation."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lo = F.lit(167772160).cast("bigint") + F.col("n_nationkey") * 1000
    return n.select(lo.alias("lo"), (lo + 999).alias("hi"), F.concat_ws("/", "r_name", "n_name").alias("location"), F.lit("0.000000").alias("lat"), F.lit("0.000000").alias("lon"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a registry of port ranges; those beyond the ports there are hold none."""
    p = table(spark, sf_dir, "part")
    return p.select(F.when(F.col("p_partkey") % 2 == 0, "tcp").otherwise("udp").alias("proto"), (F.col("p_partkey") * 10).cast("int").alias("port_lo"), (F.col("p_partkey") * 10 + 6).cast("int").alias("port_hi"), F.col("p_name").alias("name"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.expr("parse_url(url, 'HOST')")).alias("qname"))


HOSTS_SQL = "h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS qname FROM pages)"
