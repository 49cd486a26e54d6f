"""Readers of decoded event tables and dimension tables. Schemas are explicit; Spark prunes and pushes down."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import ipv4_number, ipv6_hex
from ..operators.filters import only_hosts
from ..schemas import SCHEMAS

FLOW_TYPES = ("sflow", "netflow", "ipfix")


class ConfigError(ValueError):
    """A source or dimension that can't be built from its options."""


def read_table(spark: SparkSession, kind: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).schema(SCHEMAS[kind]).options(**options).load(path)


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, "packets", path, fmt)


def stream_span(events: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last event time of a recorded stream."""
    return events.agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def read_dns(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, "dns", path, fmt)


def read_dnstap(spark: SparkSession, path: str, fmt: str = "parquet", hosts: tuple[str, ...] = ()) -> DataFrame:
    """dnstap messages; rows of another type or without a message are skipped, with ``hosts`` only theirs are read."""
    rows = read_table(spark, "dnstap", path, fmt).where((F.col("type") == "MESSAGE") & F.col("msg_type").isNotNull())
    return rows.where(only_hosts(hosts)) if hosts else rows


def read_flow_exports(spark: SparkSession, path: str, flow_type: str = "sflow", fmt: str = "parquet") -> DataFrame:
    """One row a datagram; rows without a type take ``flow_type``."""
    if flow_type not in FLOW_TYPES:
        raise ConfigError(f"invalid flow type {flow_type!r}; valid types: {', '.join(FLOW_TYPES)}")
    return read_table(spark, "flow_exports", path, fmt).withColumn("flow_type", F.coalesce("flow_type", F.lit(flow_type)))


def read_stream(spark: SparkSession, kind: str, path: str | None = None, fmt: str = "parquet", *, kafka: dict | None = None, max_files: int | None = None) -> DataFrame:
    """The same tables live: files of a folder as they come, or JSON values of a Kafka topic."""
    if kafka is not None:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        return raw.select(F.from_json(F.col("value").cast("string"), SCHEMAS[kind]).alias("e")).select("e.*")
    reader = spark.readStream.format(fmt).schema(SCHEMAS[kind])
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def services_table(rows: DataFrame, name: str = "Service Name", port: str = "Port Number", proto: str = "Transport Protocol") -> DataFrame:
    """``proto, port_lo, port_hi, name`` from registry rows: tcp and udp, named, port or ``a-b``. Of rows with one
    protocol and range end the first (by ``ord`` if there, else by name) wins; others are skipped."""
    text = F.trim(F.col(f"`{port}`").cast("string"))
    lo, hi = F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(text, r"(\d+)$", 1).try_cast("int")
    order = F.col("ord") if "ord" in rows.columns else F.col(f"`{name}`")
    good = rows.where(F.lower(F.col(f"`{proto}`")).isin("tcp", "udp") & (F.length(F.trim(F.col(f"`{name}`"))) > 0) & text.rlike(r"^\d+(-\d+)?$"))
    found = good.select(F.lower(F.col(f"`{proto}`")).alias("proto"), lo.alias("port_lo"), hi.alias("port_hi"), F.col(f"`{name}`").alias("name"), order.alias("_o")).where("port_lo is not null and port_hi is not null")
    return found.groupBy("proto", "port_hi").agg(F.min_by(F.struct("port_lo", "name"), "_o").alias("s")).select("proto", "s.port_lo", "port_hi", "s.name")


def load_services(spark: SparkSession, path: str) -> DataFrame:
    """The registry as a CSV file with its usual header; file order is kept by row number inside the file."""
    rows = spark.read.csv(path, header=True).withColumn("ord", F.monotonically_increasing_id())
    return services_table(rows)


def location_path(continent: Column, country_name: Column, country_iso: Column, subdivision: Column, city: Column) -> Column:
    """``continent/country[/subdivision][/city]``; the country's code where it has no name, Unknown without anything."""
    path = F.concat_ws("/", continent, F.coalesce(country_name, country_iso), subdivision, city)
    return F.when(path == "", "Unknown").otherwise(path)


def _cidr_bounds(network: Column) -> tuple[Column, Column]:
    base, length = F.split(network, "/")[0], F.split(network, "/")[1].cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - length).cast("bigint")
    lo = F.floor(ipv4_number(base) / size) * size
    return lo, lo + size - 1


def _cidr_bounds_v6(network: Column) -> tuple[Column, Column]:
    """First and last address of a network as 32 hex digits."""
    digits, length = ipv6_hex(F.split(network, "/")[0]), F.split(network, "/")[1].cast("int")
    whole, bits = F.floor(length / 4).cast("int"), length % 4
    span = F.pow(F.lit(2.0), F.lit(4) - bits).cast("int")  # values of the digit that the length cuts
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    low = F.floor(digit / span).cast("int") * span
    cut = lambda d: F.when(bits > 0, F.lower(F.hex(d))).otherwise("")
    head = F.substring(digits, F.lit(1), whole)
    return F.rpad(F.concat(head, cut(low)), 32, "0"), F.rpad(F.concat(head, cut(low + span - 1)), 32, "f")


def load_geo(table: DataFrame, version: int = 4) -> DataFrame:
    """Geo ranges of one address family (4 or 6) from rows ``network, continent, country_name, country_iso, subdivision,
    city, latitude, longitude``; a table of both families gives its rows to both. IPv6 bounds are 32 hex digits."""
    six = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    place = location_path(*[F.col(c) for c in ("continent", "country_name", "country_iso", "subdivision", "city")])
    return _of_version(table, version, place.alias("location"), six("latitude").alias("lat"), six("longitude").alias("lon"))


def load_asn(table: DataFrame, version: int = 4) -> DataFrame:
    """ASN ranges of one address family, ``number/organisation``, from rows ``network, asn_number, asn_org``."""
    return _of_version(table, version, F.concat_ws("/", F.col("asn_number").cast("string"), "asn_org").alias("asn"))


def _of_version(table: DataFrame, version: int, *values: Column) -> DataFrame:
    lo, hi = (_cidr_bounds if version == 4 else _cidr_bounds_v6)(F.col("network"))
    return table.where(F.contains("network", F.lit(":")) == (version == 6)).select(lo.alias("lo"), hi.alias("hi"), *values)


def load_geo_v6(table: DataFrame, value: str = "location") -> DataFrame:
    """IPv6 ranges as hex digits from rows ``first_ip, last_ip`` and a value."""
    return table.select(ipv6_hex(F.col("first_ip")).alias("lo"), ipv6_hex(F.col("last_ip")).alias("hi"), value)


def load_device_map(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """Device and interface tables from ``{device ip: {name, descr?, interfaces: {index: {name, descr?}}}}``."""
    devices, interfaces = [], []
    for ip, device in config.items():
        try:
            ipaddress.ip_address(ip)
        except ValueError as e:
            raise ConfigError(f"invalid device IP: {ip}") from e
        if "name" not in device or "interfaces" not in device:
            raise ConfigError(f"device {ip} needs name and interfaces")
        devices.append((ip, device["name"], device.get("descr")))
        for index, interface in device["interfaces"].items():
            if "name" not in interface:
                raise ConfigError(f"interface {index} of {ip} needs name")
            interfaces.append((ip, int(index), interface["name"], interface.get("descr")))
    return spark.createDataFrame(devices, SCHEMAS["devices"]), spark.createDataFrame(interfaces, SCHEMAS["interfaces"])


def load_public_suffixes(table: DataFrame) -> DataFrame:
    """``tld, ord, suffix`` from rows ``ord, suffix``: lists by last label, in the order of the table."""
    return table.select(F.lower(F.substring_index("suffix", ".", -1)).alias("tld"), F.col("ord").cast("int").alias("ord"), F.lower("suffix").alias("suffix"))
