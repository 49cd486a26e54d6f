"""Selection, mergeable states, micro-batch steps and large lookup tables against plain loops and the batch plans."""

import datetime as dt
import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.functions import addresses
from meterline.operators import lookup, merging, pairing, periods
from meterline.operators import metrics as m
from meterline.operators.selection import percentiles_of, value_range
from meterline.plans import handlers as h
from meterline.schemas import SCHEMAS
from meterline.sources import sinks
from meterline.streaming import batches, handlers as live

BASE = dt.datetime(2024, 1, 1)
MARKS = [0.5, 0.9, 0.95, 0.99]


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def inclusive(values, marks=MARKS):
    values = sorted(values)
    return [values[max(1, int(np.ceil(len(values) * p))) - 1] for p in marks]


def test_percentiles_without_sorting_groups(spark):
    r = random.Random(3)
    rows = [(k, r.choice([float(r.randrange(50)), -r.random() * 10 ** r.randrange(9), r.random() * 10 ** r.randrange(9), 0.0, None])) for k in ("a", "b", None) for _ in range(400)] + [("c", None), ("d", 5.0), ("e", float("inf")), ("e", float("-inf")), ("e", 1e-300)]
    got = {x.k: x.marks for x in percentiles_of(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", MARKS).collect()}
    want = {k: [v for j, v in rows if j == k and v is not None] for k, _ in rows}
    assert got == {k: inclusive(v) for k, v in want.items() if v}
    weighted = percentiles_of(spark.createDataFrame([("a", 1, 3), ("a", 2, 0), ("a", 9, 4), ("a", 7, 0), ("a", 1, 2)], "k string, v int, w int"), ["k"], "v", [0.5, 0.56, 1.0], "w").first()
    assert weighted.marks == [1, 9, 9]
    x = spark.createDataFrame([(float(v),) for v in sorted(r.uniform(-1, 1) * 10.0 ** r.randrange(-300, 300) for _ in range(3000))], "v double")
    ranges = [y.r for y in x.select(value_range(F.col("v")).alias("r")).collect()]
    assert ranges == sorted(ranges) and percentiles_of(x.limit(0), [], "v", [0.5]).count() == 0


def packets(spark, n=600, seed=1, hours=1):
    r = random.Random(seed)
    rows = [("s", at(r.randrange(3600 * hours) + r.random()), r.choice(["in", "out", "unknown"]), r.choice(["ipv4", "ipv6"]), r.choice(["udp", "tcp", None]), f"1.1.1.{r.randrange(9)}", f"2.2.2.{r.randrange(9)}", 5, 6, r.randrange(2000), r.random() < 0.3, i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMAS["packets"])


def as_rows(table):
    return sorted((x["name"], x.stat, x.value, x.period_start, tuple(sorted((x.labels or {}).items()))) for x in table.collect())


def test_states_of_any_split_read_as_the_whole(spark):
    p = packets(spark)
    for handler, o in ((h.net, h.Options(deep_sample_rate=50, enable=["all"])), (h.net_v1, h.Options(enable=["all"], topn_count=3, topn_percentile_threshold=60))):
        whole = as_rows(handler(p, o))
        parts = None
        for i in range(3):
            states = handler(p.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == i), h.replace(o, mode="states"))
            parts = states if parts is None else parts.unionByName(states)
        assert as_rows(m.read_states(parts, o.topn_count, o.topn_percentile_threshold)) == whole and len(whole) > 500


def test_counters_of_more_than_one_mask_and_weight(spark):
    df = periods.assign_periods(packets(spark, 200)).withColumn("d", F.col("dir"))
    some = lambda i: F.col("seq") % 60 == i
    metrics = [*[m.Counter(f"c{i}", where=some(i)) for i in range(60)], *[m.Counter(f"w{i}", where=some(i), weight=F.col("bytes")) for i in range(60)], m.Counter("all", whole=True), m.Counter("none", where=F.lit(None).cast("boolean"))]
    want = {}
    for x in df.collect():
        for i in range(60):
            for n, w in ((f"c{i}", 1), (f"w{i}", x.bytes)):
                want[x.period_start, x.d, n] = want.get((x.period_start, x.d, n), 0) + (w if x.seq % 60 == i else 0)
        want[x.period_start, None, "all"] = want.get((x.period_start, None, "all"), 0) + 1
        want[x.period_start, x.d, "none"] = 0
    for more in ([], [m.Cardinality("few", item=F.lit(None).cast("string")), m.Rate("r", whole=True)]):  # plain sums, and masks
        got = {(x.period_start, x.labels.get("d"), x["name"]): x.value for x in m.metric_table(df, metrics + more, handler="x", schema="x", dims=["d"]).where("kind = 'counter' or kind = 'cardinality'").collect()}
        assert {k: v for k, v in got.items() if k[2] != "few"} == want and {v for k, v in got.items() if k[2] == "few"} <= {0.0}
    sketched = m.metric_table(df, [m.TopN("t", item=F.col("src_ip")), m.TopN("b", item=F.col("src_ip"), weight=F.col("bytes"))], handler="x", schema="x", mode="sketch")
    assert as_rows(sketched) == as_rows(m.metric_table(df, [m.TopN("t", item=F.col("src_ip")), m.TopN("b", item=F.col("src_ip"), weight=F.col("bytes"))], handler="x", schema="x"))


def test_rollups_carry_their_error(spark):
    r = random.Random(7)
    rows = [(at(3600 * hour + i), f"i{min(int(r.paretovariate(0.7)), 400)}", r.randrange(1, 100), r.random() * 1e6) for hour in range(6) for i in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp, item string, w bigint, v double").withColumn("hour", F.date_trunc("hour", "ts"))
    names = {"weighted_tops": {"t": (F.col("item"), F.col("w"))}, "tops": {"u": F.col("item")}, "histograms": {"h": F.col("v")}, "rates": {"r": None}, "counters": {"n": F.lit(1)}, "distinct": {"d": F.col("item")}, "quantiles": {"q": F.col("v")}}
    hours = merging.rollup(df, ["hour"], **names, size=20).withColumn("day", F.date_trunc("day", "hour"))
    day = merging.merge_rollups(hours, ["day"], **{k: list(v) for k, v in names.items()}, size=20)
    got = day.select("t", "n", merging.histogram_quantiles("h", MARKS).alias("hq"), merging.rate_quantiles("r", F.lit(86_400), [0.5, 0.99]).alias("rq"), merging.latest_second("r", F.lit(int(at(3600 * 5 + 499).replace(tzinfo=dt.timezone.utc).timestamp()))).alias("last")).first()
    true = {}
    for _, item, w, _ in rows:
        true[item] = true.get(item, 0) + w
    held = {e.item: e.weight for e in got.t["items"]}
    assert got.n == len(rows) and len(held) == 20 and 0 < got.t.error < sum(true.values()) / 10
    assert all(held.get(i, 0) <= w <= held.get(i, 0) + got.t.error for i, w in true.items())
    bounds = [min(b for b in sorted({float(np.floor(x + 1e-6)) for x in m.histogram_bounds()}) if b >= v) for *_, v in rows]
    assert got.hq == inclusive(bounds) and got.rq == [0, 1] and got.last == 1
    read = merging.read_rollups(day, ["day"], counters=["n"], distinct=["d"], quantiles=["q"], tops=["u"], weighted_tops=["t"], n=5).first()
    assert [e.item for e in read.u] and read.t_error == got.t.error and [e.weight for e in read.t] == sorted((e.weight for e in read.t), reverse=True) and len(read.t) == 5


def arrivals(df, n, late_s, seed):
    """Micro-batches in order of time, but that rows may come a batch later while the watermark allows it."""
    rows = sorted(df.collect(), key=lambda x: (x.ts, x.seq))
    r, out, size = random.Random(seed), [[] for _ in range(n)], -(-len(rows) // n)
    for i, x in enumerate(rows):
        b = i // size
        end = rows[min((b + 1) * size, len(rows)) - 1].ts
        out[min(b + (r.random() < 0.4 and (end - x.ts).total_seconds() < late_s), n - 1)].append(x)
    for b in out:
        r.shuffle(b)
    return out


def run_steps(spark, folder, step, df, n=6, late_s=100, seed=0):
    for i, rows in enumerate(arrivals(df, n, late_s, seed)):
        frame = spark.createDataFrame(rows, df.schema)
        batches.advance(spark, folder, step, i, frame)
        if i == 3:
            batches.advance(spark, folder, step, i, frame)  # the same batch after a failure
    batches.close(spark, folder, step, df.schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_in_micro_batches_equal_the_batch_plan(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.choice(["s", None]), r.randrange(12), at(r.randrange(1500) + r.randrange(4) / 4), i, r.random() < 0.45) for i in range(500)]
    df = spark.createDataFrame(rows, "stream string, k int, ts timestamp, seq bigint, is_response boolean")
    paired = pairing.pair_transactions(df, ["stream", "k"], "is_response", ttl_ms=20_000)
    shifts = periods.assign_periods(df).groupBy("stream", "period_start").agg(F.min(F.unix_seconds("ts")).alias("start")).withColumnRenamed("stream", "_stream").withColumnRenamed("period_start", "opened")
    want = pairing.purge_timeouts(paired, shifts, ["stream", "k"], "is_response", ttl_ms=20_000, stream="stream")
    step = batches.pair_step(["stream", "k"], "is_response", ttl_ms=20_000, delay_s=110)
    run_steps(spark, str(tmp_path), step, df, seed=seed)
    shape = lambda t: sorted((x.seq, x.status, x.elapsed_us, x.opened if x.status == "purged" else None) for x in t.select("seq", "status", "elapsed_us", "opened").collect())
    got = shape(batches.results(spark, str(tmp_path), "paired"))
    assert got == shape(want) and sum(s == "purged" for _, s, *_ in got) > 5 and sum(s == "orphan" for _, s, *_ in got) > 20


def test_a_response_after_the_purge_is_an_orphan(spark, tmp_path):
    schema = "stream string, k int, ts timestamp, seq bigint, is_response boolean"
    step = batches.pair_step(["k"], "is_response", ttl_ms=5000, delay_s=0)
    rows = [[("s", 1, at(50), 0, False)], [("s", 2, at(61), 1, False)], [("s", 1, at(62), 2, True)], [("s", 9, at(10), 3, False), ("s", 2, at(64), 4, True)]]
    for i, some in enumerate(rows):
        batches.advance(spark, str(tmp_path), step, i, spark.createDataFrame(some, schema))
    batches.close(spark, str(tmp_path), step, spark.createDataFrame([], schema).schema)
    got = {x.seq: (x.status, x.opened) for x in batches.results(spark, str(tmp_path), "paired").collect()}
    assert got[0] == ("purged", at(60)) and got[2][0] == "orphan" and got[4][0] == "valid" and 3 not in got  # 3 came behind the watermark


@pytest.mark.parametrize("tick", [None, 40])
def test_activity_in_micro_batches_equals_plain_loops(spark, tmp_path, tick):
    r = random.Random(5)
    rows = [(k, at(x), i) for i, (k, x) in enumerate([(k, x + r.random()) for k in ("a", "b") for x in r.sample(range(0, 1500), 60)] + [("a", 9000.5), ("b", 100_000.0), ("a", 100_500.0)])]
    df = spark.createDataFrame(rows, "stream string, ts timestamp, seq bigint")
    run_steps(spark, str(tmp_path), batches.activity_step("stream", delay_s=130, tick_s=tick), df, late_s=120)
    second = lambda t: int((t - BASE).total_seconds())
    newest, want = max(second(t) for _, t, _ in rows), []
    for k in ("a", "b"):
        events = [second(t) for j, t, _ in rows if j == k]
        clock = sorted({*events, *(range(min(events), newest + 1, tick) if tick else ())})
        starts = []
        for s in clock:
            if not starts or s >= starts[-1] + 60:
                starts.append(s)
        want += [(k, s, sum(s <= e < (starts[i + 1] if i + 1 < len(starts) else 1 << 40) for e in events)) for i, s in enumerate(starts)]
    shape = lambda t: sorted((x.stream, second(x.period_start), x.num_events) for x in t.collect())
    assert shape(batches.results(spark, str(tmp_path), "periods")) == sorted(want)
    if tick:
        assert shape(periods.clock_periods(df, "stream", every=tick)) == sorted(want) and sum(n == 0 for *_, n in want) > 1000  # a silent day has its empty periods


def test_live_handler_is_read_while_it_runs_and_compacted(spark, tmp_path):
    p = packets(spark, 400, hours=2)
    o = h.Options(enable=["all"], deep_sample_rate=100)
    source, folder = str(tmp_path / "in"), str(tmp_path / "live")
    p.limit(0).write.parquet(source)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen = 0
    for i in range(3):  # each run goes on where the one before ended
        part = p.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == i)
        part.repartition(2).write.mode("append").parquet(source)
        live.live_handler(stream, "net", folder, o).awaitTermination()
        seen += part.count()
        total = live.live_metrics(spark, folder, o).where("name = 'num_events'").agg(F.sum("value")).first()[0]
        assert total == seen
        if i == 1:
            live.compact(spark, folder)
            live.compact(spark, folder)
    assert as_rows(live.live_metrics(spark, folder, o)) == as_rows(h.net(p, o))
    with pytest.raises(ValueError):
        live.states_step("dhcp")


def test_range_join_by_both_ways(spark):
    r = random.Random(2)
    ranges = [(a := r.randrange(5000), a + r.choice([0, 1, 15, 16, 255, 300, 4095, 70_000]) - (r.random() < 0.05) * 2, f"v{r.randrange(99)}") for _ in range(300)] + [(10, 10, "x"), (10, 10, "y"), (0, (1 << 32) - 1, "all"), ((1 << 32) - 5, (1 << 32) - 1, "end")]
    probes = [*range(0, 80_000, 37), *range(200), (1 << 32) - 1, (1 << 32) - 6, 1 << 32, None]
    df = spark.createDataFrame([(p,) for p in probes], "at bigint")
    table = spark.createDataFrame(ranges, "lo bigint, hi bigint, v string")
    win = lambda p: max(((lo, -hi, v) for lo, hi, v in ranges if p is not None and lo <= p <= hi), default=(0, 0, None))[2]
    for most in (lookup.BROADCAST_ROWS, 0):
        got = lookup.range_join(df, "at", table, ["v"], broadcast_rows=most).collect()
        assert sorted(map(str, got)) == sorted(str(type(got[0])(at=p, v=win(p))) for p in probes)
    assert lookup.range_join(df, "at", table.limit(0), ["v"]).where("v is null").count() == len(probes)
    aligned = lookup.range_index(spark.createDataFrame([(1 << 24, (1 << 25) - 1, "v")], "lo bigint, hi bigint, v string"), ["v"])
    assert aligned.count() == 1  # a whole block is one row


def test_long_subnet_lists_equal_short_ones(spark):
    r = random.Random(4)
    v4 = [f"10.{r.randrange(2)}.{r.randrange(4)}.{r.randrange(256)}/{r.choice([0, 7, 8, 15, 16, 22, 24, 31, 32])}" for _ in range(30)]
    v6 = [f"{ipaddress.IPv6Address((0x20010DB8 << 96) + r.randrange(1 << 90))}/{r.choice([0, 1, 32, 33, 47, 64, 127, 128])}" for _ in range(20)]
    nets = r.sample(v4 + v6, 50) + ["10.0.0.0/22", "10.0.0.0/22", "2001:db8::/33"]
    ips = [f"10.{r.randrange(2)}.{r.randrange(4)}.{r.randrange(256)}" for _ in range(150)] + [str(ipaddress.IPv6Address((0x20010DB8 << 96) + r.randrange(1 << 90))) for _ in range(60)] + ["0.0.0.0", "255.255.255.255", "::", "not an address", "", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    for some in (nets, [n for n in nets if not n.startswith("10.") or not n.endswith("/0")][:9], ["10.0.0.0/8"], []):
        table = spark.createDataFrame([(i, n) for i, n in enumerate(some)] + [(-1, "nonsense"), (-2, "10.0.0.0"), (-3, "10.0.0.0/40"), (-4, None)], "ord int, subnet string")
        want = {x.ip: x.s for x in df.select("ip", addresses.cidr_match(F.col("ip"), some).alias("s") if some else F.lit(None).alias("s")).collect()}
        assert {x.ip: x.subnet for x in lookup.subnet_lookup(df, "ip", table).collect()} == want


def test_suffix_lists(spark):
    r = random.Random(6)
    suffixes = [(i, "".join(r.choice("ab.") for _ in range(r.randrange(1, 6))) + ".com", "com") for i in range(200)] + [(500, "org", "org"), (501, "co.org", "org")]
    names = [*("".join(r.choice("ab.") for _ in range(r.randrange(12))) + r.choice([".com", ".org", ".net", ".", ""]) for _ in range(300)), None, "com", "A.B.COM"]
    table = spark.createDataFrame(suffixes, "ord int, suffix string, tld string")

    def size(name):
        name = None if name is None else name.lower()
        if not name or "." not in name or name.endswith("."):
            return 0
        tld = name.rsplit(".", 1)[1]
        own = sorted((o, s) for o, s, t in suffixes if t == tld)
        return len(next((s for _, s in own if name.endswith(s)), tld)) + 1 if own else 0

    got = lookup.public_suffix_size(spark.createDataFrame([(n,) for n in names], "qname string"), "qname", table).collect()
    assert sorted((str(x.qname), x.suffix_size) for x in got) == sorted((str(n), size(n)) for n in names)


def test_dns_handlers_read_their_events_once_more_only_to_count_them(spark):
    rows = spark.createDataFrame([], "stream string, ts timestamp, dir string, is_response boolean, txid int, flow_key bigint, qname string, qtype int, rcode int, aa boolean, ad boolean, cd boolean, answer_count int, answer_types array<int>, ecs string, l3 string, transport string, src_port int, dst_port int, bytes bigint, seq bigint")
    plan = h.dns(rows, h.Options(enable=["all"], event_counts=False))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 0  # what is paired is written once, and all metrics read that


def test_metrics_describe_themselves(spark):
    assert sinks.describe("udp_packets", "counter") == "Number of UDP packets" and sinks.describe("cardinality_ips", "cardinality") == "Number of distinct addresses"
    assert sinks.describe("top_in_src_ips_bytes", "topn") == "Most frequent in source addresses, by bytes" and sinks.describe("rates_pps", "rate") == "Totals a second of packets"
    table = h.net_v1(packets(spark, 30), h.Options(enable=["all"]))
    lines = [x.line for x in sinks.to_prometheus(table, sinks.descriptions_of(table)).collect() if x.line.startswith("# HELP")]
    assert "# HELP packets_udp Number of UDP" in lines and "# HELP packets_top_ipv4 Most frequent IPv4" in lines and len(lines) > 15
