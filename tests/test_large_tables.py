"""What lookups and metrics do with tables that no task or driver holds."""

import random

from pyspark.sql import functions as F

from meterline.operators import lookup


def test_services_of_a_large_registry_are_asked_not_broadcast(spark):
    r = random.Random(1)
    s = [(r.choice(["tcp", "udp"]), lo, lo + r.randrange(400), f"s{i}") for i, lo in enumerate(r.sample(range(60_000), 300))] + [("tcp", 9, 5, "turned")]
    s = spark.createDataFrame(list({(p, hi): (p, lo, hi, n) for p, lo, hi, n in s}.values()), "proto string, port_lo int, port_hi int, name string")
    df = spark.createDataFrame([(r.choice(["tcp", "UDP", "other", None]), r.choice([r.randrange(-5, 61_000), None])) for _ in range(2000)], "l4 string, port int")
    both = [sorted(map(str, lookup.join_services(df, "port", "l4", s, broadcast_rows=n).collect())) for n in (0, 1_000_000)]
    assert both[0] == both[1] and any("'s" in x for x in both[0])


def test_summaries_of_parts_beyond_one_network_equal_the_sql(spark, tmp_path):
    import duckdb

    from meterline.plans import queries as q

    keys = [7, 8, 256, 300, 511, 512, 65_535, 65_536, 65_543, 65_792, 131_079, 200_000]
    spark.createDataFrame([(k,) for k in keys], "l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = duckdb.sql(q.ORACLE_SQL["cidr_summary"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, q.cidr_summary(spark, str(tmp_path)).collect())) == sorted(want)


def test_ranges_are_filed_once_however_they_nest(spark):
    r = random.Random(2)
    rows = [(lo, lo + r.choice([0, 1, 30, 5000, 400_000]), f"v{i % 7}") for i, lo in enumerate(r.randrange(-300_000, 700_000) for _ in range(600))]
    rows += [(-(1 << 62), (1 << 61), "all"), (5, 4, "none"), (10, 20, "a"), (10, 20, "b"), (10, 18, "c")]
    keys = sorted({r.randrange(-310_000, 720_000) for _ in range(500)} | {10, 19, 21, 1 << 61, (1 << 61) + 1, -(1 << 62)})
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {x.k: x._found.v if x._found else None for x in lookup.range_wins(df, "k", spark.createDataFrame(rows, "lo bigint, hi bigint, v string"), ["v"]).collect()}
    for k in keys:
        held = [(lo, -hi, v) for lo, hi, v in rows if lo <= k <= hi]
        assert got[k] == (max(held)[2] if held else None), k


def test_tops_of_more_items_than_a_sketch_tracks(spark, tmp_path):
    from meterline.plans import row_queries as q

    rows = spark.range(25_600).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 80000) as ts", "id % 256 as user_id", "'error' as event_type", "1.5d as value", "concat('{\"k\": ', id div 256, '}') as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = q.top_state_merge(spark, str(tmp_path)).collect()
    assert [tuple(r)[1:] for r in got] == [("unknown", True, True, True, True)]


def test_arrivals_of_many_files_stay_whole(spark):
    from meterline.plans import row_queries as q

    rows = spark.range(6000).selectExpr("id as seq", "timestamp_seconds(1700000000 + id * 60) as ts")
    got = []
    stream = q._arriving(rows, "live", files=3, most=400)
    stream.writeStream.foreachBatch(lambda df, n: got.append((n, df.selectExpr("min(seq)", "max(seq)", "count(*)").first(), df.rdd.getNumPartitions()))).trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _, _ in got] == [0, 1, 2] and sum(r[2] for _, r, _ in got) == 6000
    assert got[0][1][1] < 2000 and got[1][1][0] < 2000 <= got[1][1][1] < 4000 and got[2][1][1] == 5999


def test_metrics_of_one_item_share_its_row(spark):
    from meterline.operators import metrics as m

    df = spark.createDataFrame([("a", 3, True), ("a", 4, True), ("b", 9, False), (None, 1, True)], "x string, w long, d boolean").selectExpr("*", "timestamp'2024-01-01' as ts", "timestamp'2024-01-01' as period_start", "60L as period_len")
    many = [m.TopN("by_w", None, F.col("d"), F.col("x"), F.col("w")), m.TopN("by_n", None, F.col("d"), F.col("x")), m.Cardinality("items", None, F.col("d"), F.col("x")), m.TopN("all", None, None, F.col("x"), F.col("w"))]
    assert [len(f["metrics"]) for f in m._families(many)] == [3, 1]
    got = {(r.name, r.stat): r.value for r in m.metric_table(df, many, handler="net", schema="net").collect()}
    assert got == {("by_w", "a"): 7, ("by_n", "a"): 2, ("items", "value"): 1, ("all", "a"): 7, ("all", "b"): 9}


def test_ipv6_ranges_by_both_ways_and_rows_without_key_are_spread(spark):
    r = random.Random(4)
    text = lambda n: format(n, "032x")
    base = 0x20010DB8 << 96
    rows = [(lo, lo + r.choice([0, 5, 1 << 20, 1 << 70, (1 << 84) - 1]), f"v{i % 7}") for i, lo in enumerate(base + r.randrange(1 << 86) for _ in range(12))]
    rows += [(base, base + (1 << 90), "all"), (rows[0][0], rows[0][1] + 9, "later end"), (rows[0][0], rows[0][1], "z")]
    probes = [lo + d for lo, _, _ in rows for d in (-1, 0, 3, 1 << 50)] + [base + (1 << 91)]
    held = {k: max(((lo, -hi, v) for lo, hi, v in rows if lo <= k <= hi), default=(0, 0, None))[2] for k in probes}
    df = spark.createDataFrame([(text(k),) for k in held] + [(None,)] * 4000, "x string").repartition(4)
    table = spark.createDataFrame([(text(lo), text(hi), v) for lo, hi, v in rows], "lo string, hi string, v string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):
            spark.conf.set(k, v)
        for most in (1000, 0):
            out = lookup._v6_lookup(df, "x", table, "v", "found", broadcast_rows=most)
            parts = out.rdd.glom().map(lambda part: [(x.x, x.found) for x in part]).collect()
            got = [x for part in parts for x in part]
            assert len(got) == 4000 + len(held) and {x: v for x, v in got if x} == {text(k): v for k, v in held.items()}
            assert max(map(len, parts)) < 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_totals_of_directions_shuffle_one_row_a_record(spark):
    from meterline.functions import flow

    rows = [("a", "s1", 1, 2, 10, 1), ("a", "s1", None, 1, 5, 2), ("a", None, 3, None, 7, 3), ("b", "s2", None, 4, None, None), ("c", "s3", None, None, 9, 9), (None, "s4", 5, 5, 1, 1)]
    df = spark.createDataFrame(rows, "device_ip string, src_ip string, if_in bigint, if_out bigint, bytes bigint, packets bigint")
    sides = flow.flow_directions(df).withColumnRenamed("device_ip", "device")
    want = sides.groupingSets([[F.col("device"), F.col("dir")], [F.col("device")]], "device", "dir").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count_distinct("src_ip").alias("src_ips"), F.count_distinct("interface").alias("interfaces"), F.grouping("dir").cast("int").alias("all_directions"))
    got = flow.direction_totals(df)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    from meterline.plans import queries as q

    assert "Expand" not in q.QUERIES["flow_interfaces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_filters_of_flows_in_one_pass_keep_what_each_keeps(spark):
    from meterline.plans import handlers as h, row_queries as q, views as v

    sf = "/root/testdata/sf0.001"
    kinds = {"ips": {"only_ips": ["10.0.0.0/26", "172.0.1.0/24"]}, "out": {"only_directions": ["out"]}, "device": {"only_device_interfaces": {"10.255.0.1": ["2-4"]}, "only_ports": ["1-500"]}}
    one = h.flow_kept(v.flows(spark, sf), kinds).select("seq", "src_ip", *kinds).collect()
    for n, options in kinds.items():
        each = h.flow_records(v.flows(spark, sf), h.Options(filters=options), h.Dimensions(), h.Summaries()).select("seq", "src_ip", "keep").collect()
        assert sorted((x.seq, x.src_ip, x[n]) for x in one) == sorted(map(tuple, each)) and any(x.keep for x in each)
    plan = q.flow_filters(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_suppkey" in line and "Relation" in line for line in plan.splitlines()) == 1


def test_timeouts_of_both_dns_handlers_pair_once(spark, monkeypatch):
    from meterline.plans import handlers as h, queries as q

    made, pair = [], h.purge_timeouts
    monkeypatch.setattr(h, "purge_timeouts", lambda *a, **k: made.append(1) or pair(*a, **k))
    got = q.dns_timeouts(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and {x.name for x in got.select("name").distinct().collect()} == {"timeout_queries", "xact_counts_timed_out"}


def test_first_dns_handler_pairs_few_columns_by_one_window(spark, monkeypatch):
    from meterline.plans import handlers as h, metric_rows as m

    sf, seen, write = "/root/testdata/sf0.001", {}, h.written
    monkeypatch.setattr(h, "written", lambda df, tag: seen.update({tag: df}) or write(df, tag))
    o = h.Options(enable=["all"], filters={"only_qtype": ["A", "3"]})
    h.dns_v1(m._dns(spark, sf), o, m._places(spark, sf), ttl_ms=30_000)
    plan = seen["transactions"]._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in line for line in plan.splitlines()) == 1
    assert "prefix" not in plan and "ecs_location" not in plan  # clients' places are not looked up
    firsts = seen["shifts"]._jdf.queryExecution().optimizedPlan().toString()
    assert "prefix" not in firsts and "Window [" not in firsts
    assert not any("Filter" in line and line.count("get_json_object") > 1 for line in firsts.splitlines())
    # a filter of places still has them
    odd = h.dns_v1(m._dns(spark, sf), h.Options(enable=["all"], filters={"geoloc_notfound": True}), m._places(spark, sf), ttl_ms=30_000)
    assert odd.where("name = 'wire_packets_total'").count() and seen["transactions"].where("not is_response").count()


def test_timeouts_joined_before_pairing_are_those_joined_after(spark):
    from meterline.operators import pairing

    r = random.Random(5)
    rows = [(r.choice("st"), r.randrange(4), i, r.choice([r.randrange(40_000), None]), r.random() < 0.4) for i in range(1500)]
    df = spark.createDataFrame(rows, "stream string, k int, seq int, t int, is_response boolean").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    starts = spark.createDataFrame([(s, x, x // 60) for s in "st" for x in r.sample(range(40_000), 60)], "_stream string, start long, opened long")
    keys, order = ["stream", "k"], ["seq", "status", "elapsed_us", "purged_at", "opened"]
    pair = lambda d: pairing.pair_transactions(d, keys, "is_response", ttl_ms=20_000)
    after = pairing.purge_timeouts(pair(df), starts, keys, "is_response", ttl_ms=20_000, stream="stream")
    asked = df.select(F.col("stream").alias("_stream"), (F.unix_seconds("ts") + 20).alias("_due"))
    before = pairing.purge_timeouts(pair(pairing.due_starts(df, starts, "is_response", ttl_ms=20_000, stream="stream", asked=asked)), None, keys, "is_response", ttl_ms=20_000, stream="stream")
    assert set(before.columns) == set(after.columns)
    got = sorted(map(str, before.select(order).collect()))
    assert got == sorted(map(str, after.select(order).collect()))
    # brute force: each slot by its events in order
    first = lambda s, due: min((x for t, x in at[s] if x >= due), default=None)
    at = {s: [(x.opened, x.start) for x in starts.where(F.col("_stream") == s).collect()] for s in "st"}
    want = {}
    for key in {(s, k) for s, k, *_ in rows}:
        open_ = None
        for _, _, n, t, reply in sorted((x for x in rows if x[:2] == key), key=lambda x: (x[3] is not None, x[3] or 0, x[2])):
            shift = open_ and open_[1] is not None and first(key[0], open_[1] + 20)
            if open_ and shift and t is not None and t >= shift:
                want[open_[0]], open_ = "purged", None
            if reply:
                want[n] = "orphan" if open_ is None else "valid" if t is None or open_[1] is None or t - open_[1] < 20 else "timed_out"
                if open_:
                    want[open_[0]], open_ = "answered", None
            else:
                if open_:
                    want[open_[0]] = "replaced"
                open_ = (n, t)
        if open_:
            want[open_[0]] = "purged" if open_[1] is not None and first(key[0], open_[1] + 20) else "open"
    assert {x.seq: x.status for x in before.collect()} == want


def test_last_labels_of_odd_names(spark):
    from meterline.functions import dns

    def cut(q, size):
        n = len(q)
        upto = n - size + 1 if 0 < size < n else n - 1 if q.endswith(".") else n
        last = lambda limit: q[: max(limit, 0)].rfind(".") + 1
        d1 = last(upto)
        d2 = last(d1 - 1)
        d3 = last(d2 - 1)
        part = lambda d: q[max(d - 1, 0) :]
        two = q if n < 5 or d1 <= 1 or d2 == 0 else part(d2)
        return two, "" if n < 5 else q if d1 <= 1 else "" if d2 == 0 else q if d2 == 1 or d3 == 0 else part(d3)

    r = random.Random(6)
    names = [("".join(r.choice("ab.é") for _ in range(r.randrange(12))), r.randrange(5)) for _ in range(600)] + [(None, 1)]
    df = spark.createDataFrame(names, "q string, n int")
    for x in df.select("q", "n", dns.aggregate_domain(F.col("q"), F.col("n")).alias("r")).collect():
        assert tuple(x.r) == (cut(x.q, x.n) if x.q is not None else (None, None)), x


def _odd_flows(spark, r, n):
    ip = lambda: r.choice([None, "", "fe80::1", "fe80::", f"10.0.{r.randrange(3)}.{r.randrange(4)}", "10.0.0.1"])
    port = lambda: r.choice([None, 0, -1, 80, 443, r.randrange(5)])
    side = lambda: r.choice([None, 1, 2, 3])
    rec = lambda: (r.random() < 0.3, r.choice([6, 17, 1, None]), r.randrange(256), ip(), ip(), port(), port(), side(), side(), r.choice([None, r.randrange(9)]), r.choice([None, r.randrange(9000)]), None, None)
    exports = [(f"r{r.randrange(3)}", r.choice([0, 30, 61, 300]), "netflow", "flow", i, r.choice([None, [], *[[rec() for _ in range(k)] for k in (1, 1, 2, 3)]])) for i in range(n)]
    record = "is_ipv6 boolean, proto int, tos int, src_ip string, dst_ip string, src_port int, dst_port int, if_in bigint, if_out bigint, packets bigint, octets bigint, mean_skip_count bigint, sampled_packet_size bigint"
    return spark.createDataFrame(exports, f"device_ip string, t int, flow_type string, sample_type string, seq int, records array<struct<{record}>>").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_flow_records_travel_once_and_not_a_row_for_each_item(spark, monkeypatch):
    from meterline.operators import metrics as m
    from meterline.plans import handlers as h

    df = _odd_flows(spark, random.Random(7), 200).localCheckpoint()
    rows = lambda out: sorted(map(str, out.select("period_start", F.to_json("labels"), "name", "kind", "stat", "value").collect()))
    some = ["cardinality", "conversations", "top_ips", "top_ips_ports", "top_ports", "by_bytes"]
    run = lambda **o: h.flow(df, h.Options(disable=["all"], enable=some, event_counts=False, **o))
    want = rows(m.read_states(run(mode="states")))
    for most in (10_000, 25):  # by device and period, by item
        monkeypatch.setattr(h, "FLOWS_A_TASK", most)
        assert rows(run()) == want


def test_flow_steps_are_compiled(spark, monkeypatch):
    from meterline.plans import handlers as h

    monkeypatch.setattr(h, "FLOWS_A_TASK", 4)
    df = _odd_flows(spark, random.Random(8), 60).localCheckpoint()
    plan = h.flow(df, h.Options(enable=["all"], event_counts=False))._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate" in line and ("struct(m," in line or "dir, in" in line)]
    assert made and not any("filter(" in line for line in made)  # lambdas are interpreted, with all that is inside
    places = spark.createDataFrame([(10 << 24, (10 << 24) + 257, "near")], "lo bigint, hi bigint, location string")
    some = ["cardinality", "conversations", "top_ips", "top_ips_ports", "by_bytes", "by_packets"]
    plan = h.flow(df, h.Options(disable=["all"], enable=some, event_counts=False), h.Dimensions(geo_v4=places))._jdf.queryExecution().optimizedPlan().toString()
    # once for each end and for conversations, in each of the reads for tops and counts; places are looked up for their own tops alone
    assert plan.count("RepartitionByExpression") == 6 and "prefix" not in plan


def test_tops_of_small_groups_are_ranked_where_their_records_came_together(spark, monkeypatch):
    from meterline.plans import handlers as h, row_queries as q, views as v

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(h, "FLOWS_A_TASK", 1000)
    out = q.flow_tops(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "top_in_ecn_bytes" not in plan  # no shuffle by item or for ranks, and no metric that isn't asked for
    some = h.Options(disable=["all"], enable=["top_ips", "top_ips_ports", "top_ports", "top_tos", "by_bytes", "by_packets"], event_counts=False)
    names = {x.name for x in out.select("name").distinct().collect()}
    assert len(names) == 7 and sorted(out.collect()) == sorted(q._long(h.flow(v.flows(spark, sf), some).where(F.col("name").isin(*names)), "device", "device_interface").collect())
