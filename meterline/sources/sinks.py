"""Renderings of the long-form metric table. Each is a DataFrame; writing it is Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ID = ["policy", "handler", "schema", "period_start", "period_len", "labels", "name", "kind"]


#: Words of metric names that say little by themselves.
_WORDS = {
    "xacts": "transactions", "xact": "transaction", "qname": "query names", "qname2": "names of their last two labels", "qname3": "names of their last three labels", "ips": "addresses", "ipv4": "IPv4", "ipv6": "IPv6", "udp": "UDP", "tcp": "TCP",
    "dot": "DNS over TLS", "doh": "DNS over HTTPS", "doq": "DNS over QUIC", "ecs": "client subnets", "asn": "autonomous systems", "ASN": "autonomous systems", "geo": "places", "geoLoc": "places", "loc": "", "dscp": "DSCP classes", "ecn": "ECN marks", "pps": "packets", "bps": "bytes",
    "us": "in microseconds", "l4": "transports", "syn": "SYN", "qtype": "query types", "rcode": "response codes", "nxdomain": "NXDOMAIN", "srvfail": "SERVFAIL", "noerror": "NOERROR", "refused": "REFUSED", "nodata": "without data", "src": "source", "dst": "destination", "resp": "response", "num": "", "wire": "",
}
_KINDS = {"counter": ("Number of", ""), "cardinality": ("Number of distinct", "cardinality"), "topn": ("Most frequent", "top"), "quantile": ("Quantiles of", "quantiles"), "histogram": ("Histogram of", "histogram"), "rate": ("Totals a second of", "rates")}


def describe(name: str, kind: str) -> str:
    """What a metric says, in words, from its name and kind: the text of its HELP line."""
    begin, drop = _KINDS.get(kind, ("", ""))
    words = [_WORDS.get(w, w) for w in name.split("_") if w != drop]
    weight = ""
    if kind == "topn" and len(words) > 1 and words[-1] in ("bytes", "packets", "transactions"):
        weight = f", by {words.pop()}"
    return " ".join(w for w in [begin, *words] if w) + weight


def descriptions_of(metrics: DataFrame) -> dict[str, str]:
    """A description for each metric there is in a table: a few hundred names at most."""
    return {r["name"]: describe(r["name"], r["kind"]) for r in metrics.select("name", "kind").distinct().collect()}


def to_metric_table(metrics: DataFrame) -> DataFrame:
    """The long form with the full metric name, ready for ``write.partitionBy('period_day')``."""
    return metrics.select("*", F.concat_ws("_", "schema", "name").alias("metric"), F.to_date("period_start").alias("period_day"))


def write_metric_table(metrics: DataFrame, path: str) -> None:
    to_metric_table(metrics).write.mode("append").partitionBy("period_day").parquet(path)


def _number(c):
    value = F.col(c) if isinstance(c, str) else c
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _labels(labels, *more):
    """``{k="v",...}`` with labels in order; nothing without labels."""
    entries = F.array_sort(F.concat(F.map_entries(labels), F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in more]))) if more else F.array_sort(F.map_entries(labels))
    escape = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), ",")
    return F.when(F.size(entries) > 0, F.concat(F.lit("{"), text, F.lit("}"))).otherwise("")


def to_prometheus(metrics: DataFrame, descriptions: dict[str, str] | None = None) -> DataFrame:
    """Exposition text, ``metric, ord, line``: HELP and TYPE once a metric, then its samples, labels in order.

    HELP is the text of ``descriptions`` for the metric's name (see :func:`descriptions_of`), or the name in words.

    A summary's ``_sum`` is its largest item; its ``_count`` the number of items.
    """
    m = metrics.where("not (kind = 'topn' and coalesce(stat, '') = '')").withColumn("metric", F.concat_ws("_", "schema", "name"))
    base = F.map_concat(F.col("labels"), F.create_map(F.lit("policy"), F.col("policy")))
    quantile = F.regexp_replace("stat", "^p", "").cast("string")
    line = (
        F.when(F.col("kind").isin("counter", "cardinality"), F.concat("metric", _labels(base), F.lit(" "), _number("value")))
        .when(F.col("kind").isin("quantile", "rate") & F.col("stat").rlike(r"^p\d+$"), F.concat("metric", _labels(base, ("quantile", F.concat(F.lit("0."), F.regexp_replace(quantile, "0$", "")))), F.lit(" "), _number("value")))
        .when((F.col("kind") == "quantile") & (F.col("stat") == "max"), F.concat("metric", F.lit("_sum"), _labels(base), F.lit(" "), _number("value")))
        .when((F.col("kind") == "quantile") & (F.col("stat") == "n"), F.concat("metric", F.lit("_count"), _labels(base), F.lit(" "), _number("value")))
        .when(F.col("kind") == "histogram", F.concat("metric", F.lit("_bucket"), _labels(base, ("le", F.col("stat"))), F.lit(" "), _number("value")))
        .when(F.col("kind") == "topn", F.concat("metric", _labels(base, ("name", F.col("stat"))), F.lit(" "), _number("value")))
    )
    samples = m.select("metric", F.lit(2).alias("ord"), line.alias("line")).where("line is not null")
    counts = m.where("kind = 'histogram' and stat = '+Inf'").select("metric", F.lit(3).alias("ord"), F.concat("metric", F.lit("_count"), _labels(base), F.lit(" "), _number("value")).alias("line"))
    type_ = F.when(F.col("kind").isin("quantile", "rate"), "summary").when(F.col("kind") == "histogram", "histogram").otherwise("gauge")
    heads = m.select("metric", type_.alias("t"), "name").distinct()
    helps = heads.select("metric", F.lit(0).alias("ord"), F.concat(F.lit("# HELP "), "metric", F.lit(" "), _described(descriptions)).alias("line"))
    types = heads.select("metric", F.lit(1).alias("ord"), F.concat(F.lit("# TYPE "), "metric", F.lit(" "), "t").alias("line"))
    return helps.unionByName(types).unionByName(samples).unionByName(counts)


def _described(descriptions: dict[str, str] | None):
    words = F.replace("name", F.lit("_"), F.lit(" "))
    if not descriptions:
        return words
    text = F.map_from_arrays(F.array(*map(F.lit, descriptions)), F.array(*map(F.lit, descriptions.values())))
    return F.coalesce(F.try_element_at(text, F.col("name")), words)


def write_prometheus(metrics: DataFrame, path: str) -> None:
    to_prometheus(metrics).repartitionByRange("metric").sortWithinPartitions("metric", "ord", "line").select("line").write.mode("overwrite").text(path)


def to_otel_rows(metrics: DataFrame) -> DataFrame:
    """One row a point: scope (the policy), metric, type, start and end in nanoseconds, attributes, value, and for
    histograms the bounds with their cumulative counts. Top items without a name are skipped."""
    m = metrics.withColumn("metric", F.concat_ws("_", "schema", "name"))
    start = F.unix_micros("period_start") * 1000
    end = start + F.col("period_len") * 1_000_000_000
    common = [F.col("policy").alias("scope"), "metric", start.alias("start_unix_nano"), end.alias("end_unix_nano")]
    none = F.lit(None).cast("array<struct<bound:string,count:bigint>>")
    plain = m.where("kind in ('counter', 'cardinality', 'topn') and not (kind = 'topn' and coalesce(stat, '') = '')")
    attributes = F.when(F.col("kind") == "topn", F.map_concat("labels", F.create_map(F.lit("name"), F.coalesce("stat", F.lit(""))))).otherwise(F.col("labels"))
    gauges = plain.select(*common, F.lit("gauge").alias("type"), attributes.alias("attributes"), "value", none.alias("buckets"))
    summary = m.where("kind in ('quantile', 'rate') and stat rlike '^p[0-9]+$'")
    summaries = summary.select(*common, F.lit("summary").alias("type"), F.map_concat("labels", F.create_map(F.lit("quantile"), F.col("stat"))).alias("attributes"), "value", none.alias("buckets"))
    h = m.where("kind = 'histogram'").groupBy(*[c for c in _ID if c != "labels"], "metric", F.map_entries("labels").alias("l")).agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("stat") == "+Inf", float("inf")).otherwise(F.col("stat").try_cast("double")).alias("b"), F.col("stat").alias("bound"), F.col("value").cast("bigint").alias("count")))).alias("s"))
    buckets = F.transform("s", lambda x: F.struct(x["bound"].alias("bound"), x["count"].alias("count")))
    histograms = h.select(*common, F.lit("histogram").alias("type"), F.map_from_entries("l").alias("attributes"), F.element_at(buckets, -1)["count"].cast("double").alias("value"), buckets.alias("buckets"))
    return gauges.unionByName(summaries).unionByName(histograms)


def _quoted(text):
    """A JSON string with its quotes."""
    return F.regexp_replace(F.to_json(F.array(F.coalesce(text, F.lit("")))), r"^\[|\]$", "")


def to_document(metrics: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """One JSON document a period of a policy's handler: ``policy, handler, period_start, document``.

    Under the schema: the period, then each label set's metrics by name. Counters and distinct counts are numbers;
    quantiles, rates and histograms objects by mark; tops arrays of ``{name, estimate}``, with ``lat`` and ``lon`` for
    locations found in ``geo(location, lat, lon)``. Empty metrics are absent.
    """
    keys = ["policy", "handler", "schema", "period_start", "period_len"]
    label = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: e["value"]), "/")
    m = metrics.where("value is not null").withColumn("label", label)
    text = _number("value")
    pairs = m.where("kind in ('quantile', 'rate', 'histogram')").groupBy(*keys, "label", "name").agg(F.array_sort(F.collect_list(F.struct("stat", text.alias("v")))).alias("s"))
    objects = pairs.select(*keys, "label", "name", F.concat(F.lit("{"), F.array_join(F.transform("s", lambda x: F.concat(_quoted(x["stat"]), F.lit(":"), x["v"])), ","), F.lit("}")).alias("json"))
    items = m.where("kind = 'topn'").withColumns({"lat": F.lit(None).cast("string"), "lon": F.lit(None).cast("string")})
    if geo is not None:
        places = geo.groupBy(F.col("location").alias("stat")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
        items = m.where("kind = 'topn'").join(places, "stat", "left").withColumns({c: F.when(F.contains("name", F.lit("geo")), F.col(c)) for c in ("lat", "lon")})
    tops = items.groupBy(*keys, "label", "name").agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("o"), F.col("stat").alias("name"), F.col("value").cast("bigint").alias("estimate"), "lat", "lon"))).alias("s"))
    arrays = tops.select(*keys, "label", "name", F.to_json(F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["estimate"].alias("estimate"), x["lat"].alias("lat"), x["lon"].alias("lon")))).alias("json"))
    numbers = m.where("kind in ('counter', 'cardinality')").select(*keys, "label", "name", text.alias("json"))
    fields = numbers.unionByName(objects).unionByName(arrays)
    join = lambda s, k, v: F.concat(F.lit("{"), F.array_join(F.transform(s, lambda x: F.concat(_quoted(x[k]), F.lit(":"), x[v])), ","), F.lit("}"))
    by_label = fields.groupBy(*keys, "label").agg(F.array_sort(F.collect_list(F.struct("name", "json"))).alias("s")).select(*keys, "label", join("s", "name", "json").alias("json"))
    whole = by_label.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("label") == "", "all").otherwise(F.col("label")).alias("label"), "json"))).alias("s"))
    period = F.concat(F.lit('"period":{"start_ts":'), F.unix_seconds("period_start").cast("string"), F.lit(',"length":'), F.col("period_len").cast("string"), F.lit("}"))
    body = F.concat(F.lit("{"), _quoted(F.col("policy")), F.lit(":{"), _quoted(F.col("handler")), F.lit(":{"), _quoted(F.col("schema")), F.lit(":{"), period, F.lit(","), F.array_join(F.transform("s", lambda x: F.concat(_quoted(x["label"]), F.lit(":"), x["json"])), ","), F.lit("}}}}"))
    return whole.select("policy", "handler", "period_start", body.alias("document"))


def flatten_document(documents: DataFrame, column: str = "document", schema: str = "map<string,array<struct<name:string,estimate:bigint>>>", *keep: str) -> DataFrame:
    """Paths ``metric_0_name`` and ``metric_0_estimate`` with their values, from JSON maps of top tables."""
    parsed = documents.select(*keep, F.explode(F.from_json(column, schema)).alias("metric", "rows")).select(*keep, "metric", F.posexplode("rows").alias("i", "row"))
    both = F.array(F.struct(F.lit("name").alias("f"), F.col("row.name").alias("v")), F.struct(F.lit("estimate").alias("f"), F.col("row.estimate").cast("string").alias("v")))
    return parsed.select(*keep, "metric", "i", F.inline(both)).select(*keep, F.concat_ws("_", "metric", "i", "f").alias("path"), F.col("v").alias("value"))
