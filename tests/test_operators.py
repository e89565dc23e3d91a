"""Invariants and edge frames (built inside the tests) for the operators."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from starlayer.operators import advise, classify, clean, dims, facts, hierarchy, layers, metrics, quality
from starlayer.plans.context import Ctx, change_log, part_edges
from starlayer.sources.trade import zero_pad

D = dt.date
TS = dt.datetime
RAW_SCHEMA = ("order_id string, user_id bigint, item_id bigint, merchant_id bigint, order_date date, "
              "order_amount decimal(18,2), order_status string, order_no string, created_at timestamp_ntz")


def raw(spark, data):
    return spark.createDataFrame(data, RAW_SCHEMA)


def test_kept_plus_rejected_equals_input(spark):
    c = Ctx(spark, SF_SMALL)
    t = c.trade_order()
    kept, rej = clean.dwd_trade_order(t), clean.dwd_reject(t)
    assert kept.count() + rej.count() == t.count()
    reasons = {r[0] for r in rej.select("reject_reason").distinct().collect()}
    assert reasons == {"null_key", "bad_amount", "superseded"}


def test_dedup_ties_and_nulls(spark):
    a = Decimal("10.00")
    df = raw(spark, [
        ("k", 1, 5, 1, D(2020, 1, 1), a, " PAID", "NO1", TS(2020, 1, 2)),
        ("k", 1, 3, 1, D(2020, 1, 1), a, "paid", "NO1", TS(2020, 1, 2)),   # tie → smaller item wins
        ("k", 1, 1, 1, D(2020, 1, 1), a, "paid", "NO1", None),             # NULL time never wins
        (None, 1, 1, 1, D(2020, 1, 1), a, "paid", "NO2", TS(2020, 1, 3)),  # NULL key dropped
        ("m", 1, 1, 1, D(2020, 1, 1), None, "paid", "NO3", TS(2020, 1, 3)),  # NULL amount dropped
        ("n", 1, 1, 1, D(2020, 1, 1), Decimal("-1.00"), "paid", "NO4", TS(2020, 1, 3)),
    ])
    out = clean.dwd_trade_order(df)
    assert rows(out, ["order_id", "item_id", "order_status"]) == [("k", 3, "paid")]
    assert clean.dwd_trade_order(df.limit(0)).count() == 0


def test_ratio_zero_and_null_denominators(spark):
    from starlayer.functions.exprs import ratio
    df = spark.createDataFrame([(1, 0), (1, None), (2, 8), (201, 200)], "n int, d int")
    out = [r[0] for r in df.select(ratio("n", "d", 2).alias("r")).collect()]
    assert out == [None, None, 0.25, 1.0]   # 1.005 as a double rounds down, like SQL ROUND on DOUBLE


def test_ratio_formula_validation():
    assert facts.parse_ratio("a / b") == ("a", "b")
    for bad in ["a", "a/b/c", " ", "/b"]:
        with pytest.raises(ValueError):
            facts.parse_ratio(bad)


def test_metric_validation():
    with pytest.raises(ValueError):
        metrics.AtomicMetric("x", "order", "MEDIAN", "amount")
    with pytest.raises(ValueError):
        metrics.AtomicMetric("x", "order", "SUM", " ")
    m = metrics.DerivedMetric(metrics.AtomicMetric("gmv", "order", "sum", "amount"), (("paid", "s = 1"),), "7d")
    assert m.name == "7d paid gmv" and m.atomic.aggregation == "SUM"


def test_incremental_dwt_equals_full(spark):
    c = Ctx(spark, SF_SMALL)
    dws = c.dws(None)
    cut = F.lit("2000-06-01").cast("date")
    prev = layers.dwt_user_topic(dws.filter(F.col("order_date") < cut), c.as_of)
    inc = layers.dwt_incremental(prev, dws.filter(F.col("order_date") >= cut), c.as_of)
    full = layers.dwt_user_topic(dws, c.as_of)
    cols = ["user_id", "active_days", "lifetime_order_cnt", "lifetime_gmv", "last_order_date"]
    assert rows(inc, cols) == rows(full, cols)


def test_scd2_merge_batches_equal_build_and_rerun_is_stable(spark):
    c = Ctx(spark, SF_SMALL)
    log = change_log(c)
    key, dc, attrs = "customer_key", "change_date", ["priority"]
    full = dims.scd2_build(log, key, dc, attrs)
    cut = F.lit("1999-01-01").cast("date")
    dim = dims.scd2_build(log.filter(F.col(dc) < cut), key, dc, attrs)
    later = log.filter(F.col(dc) >= cut)
    merged = dims.scd2_merge(dim, later, key, dc, attrs)
    assert rows(merged) == rows(full.select(*merged.columns))
    # the same batch applied twice changes nothing (no new change dates)
    again = dims.scd2_merge(merged, later, key, dc, attrs)
    assert rows(again) == rows(merged)


def test_zipper_chain_has_no_overlap_or_gap(spark):
    c = Ctx(spark, SF_SMALL)
    z = dims.zipper_build(change_log(c), "customer_key", "change_date", ["priority"])
    chk = dims.zipper_check(z, "customer_key")
    assert chk.filter(~F.col("ok")).count() == 0


def test_zipper_check_flags_overlap(spark):
    z = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 2, 1)), (1, D(2020, 1, 15), D(9999, 12, 31)),
                               (2, D(2020, 1, 1), D(2020, 1, 10)), (2, D(2020, 1, 20), D(9999, 12, 31))],
                              "k int, start_date date, end_date date")
    r = {x.k: (x.overlaps, x.gaps, x.ok) for x in dims.zipper_check(z, "k").collect()}
    assert r == {1: (1, 0, False), 2: (0, 1, False)}


def test_bridge_weights_sum_to_one(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    b = dims.bridge_build(li, "l_orderkey", "l_partkey")
    bad = b.groupBy("l_orderkey").agg(F.sum("weight").alias("w")).filter(F.col("w") != 1)
    assert bad.count() == 0
    w3 = dims.bridge_build(spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "g int, m int"), "g", "m")
    assert [r.weight for r in w3.orderBy("m").collect()] == [Decimal("0.3333"), Decimal("0.3333"), Decimal("0.3334")]


def test_junk_round_trip_keeps_flags(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    flags = ["l_returnflag", "l_linestatus", "l_linenumber"]
    junk = dims.junk_build(li, flags)
    att = dims.junk_attach(li.select("l_orderkey", "l_partkey", "l_suppkey", *flags), junk, flags)
    back = att.join(junk, "junk_id").select("l_orderkey", "l_partkey", "l_suppkey", *flags)
    assert rows(back) == rows(li.select("l_orderkey", "l_partkey", "l_suppkey", *flags))


def test_dense_keys_without_a_row_limit(spark):
    df = spark.range(20_002).select((F.col("id") % 10_001).cast("int").alias("a"), F.lit("x").alias("b"))
    got = [(r.junk_id, r.a) for r in dims.junk_build(df, ["a", "b"]).collect()]
    assert sorted(got) == [(k + 1, k) for k in range(10_001)]


def test_bridge_weights_of_a_large_group(spark):
    df = spark.range(10_050).select(F.lit(1).alias("g"), F.col("id").alias("m"))
    w = dims.bridge_build(df.unionByName(spark.createDataFrame([(2, 5), (2, 6), (2, 7)], "g int, m long")), "g", "m")
    r = {x.g: x for x in w.groupBy("g").agg(F.sum("weight").alias("s"), F.min("weight").alias("lo"), F.max("weight").alias("hi")).collect()}
    assert r[1].s == 1 and r[2].s == 1 and r[1].lo > 0 and r[1].hi < r[1].lo * 2
    assert sorted(float(x.weight) for x in w.where("g = 2").collect()) == [0.3333, 0.3333, 0.3334]


def test_long_order_numbers_stay_whole(spark):
    got = spark.createDataFrame([(7,), (1234567890,), (1234567891,)], "n long").select(zero_pad(F.col("n"), 8).alias("p"))
    assert [r.p for r in got.collect()] == ["00000007", "1234567890", "1234567891"]


def test_orders_count_once_by_default(spark):
    one = ("1-1", 1, 1, 1, dt.date(2001, 1, 1), 5.0, "paid")
    df = spark.createDataFrame([one, one], "order_id string, user_id int, item_id int, merchant_id int, order_date date, "
                               "order_amount double, order_status string").withColumn("order_amount", F.col("order_amount").cast("decimal(18,2)"))
    assert layers.dws_trade_order_1d(df, "2001-01-02").first().order_cnt == 1
    assert layers.dws_subject_rollup(df, "merchant_id").first().paid_order_cnt == 1
    only = layers.dws_subject_rollup(df, "user_id", metrics={"rows": F.count(F.lit(1))}).first()
    assert only.asDict() == {"period_date": dt.date(2001, 1, 1), "user_id": 1, "rows": 2}


def brute_closure(edges):
    out = {(n, n, 0) for n, _ in edges}
    up = {}
    for n, p in edges:
        if p is not None:
            up.setdefault(n, set()).add(p)
    for n, _ in edges:
        seen, front, d = {}, set(up.get(n, ())), 1
        while front:
            for a in front:
                seen[a] = d
            front = {b for a in front for b in up.get(a, ())} - set(seen)
            d += 1
        out |= {(a, n, -1 if a == n else k) for a, k in seen.items()}
    return out


@pytest.mark.parametrize("edges", [
    [("R", None), ("a", "R"), ("b", "R"), ("x", "a"), ("x", "b"), ("y", "x")],
    [(1, 2), (2, 1), (3, 1), (4, 3), (9, 9)],
    [(0, None)] + [(k, k - 1) for k in range(1, 71)],
])
def test_closure_one_row_per_pair(spark, edges):
    kind = "string" if isinstance(edges[0][0], str) else "long"
    e = spark.createDataFrame(edges, f"node_id {kind}, parent_id {kind}")
    got = [tuple(r) for r in hierarchy.hier_closure(e).select("ancestor", "descendant", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_closure(edges)


def test_closure_cycle_and_depth(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (10, 11), (11, 10)],
                              "node_id int, parent_id int")
    clo = hierarchy.hier_closure(e)
    good = clo.filter("distance >= 0 and descendant <= 5")
    assert good.count() == 5 + 4 + 3 + 2 + 1
    err = {(r.ancestor, r.descendant) for r in clo.filter("distance = -1").collect()}
    assert err == {(10, 10), (11, 11)}
    d4 = advise.advise_hierarchy(clo.filter("descendant <= 4")).first()
    d5 = advise.advise_hierarchy(clo.filter("descendant <= 5")).first()
    assert (d4.depth, d4.strategy) == (4, "flatten") and (d5.depth, d5.strategy) == (5, "bridge")


def test_closure_pair_count_matches_fixture(spark):
    c = Ctx(spark, "/root/testdata/sf0.01")
    assert hierarchy.hier_closure(part_edges(c)).count() == 19954  # part 0 included


def test_flatten_levels(spark):
    e = spark.createDataFrame([("R", None), ("N", "R"), ("C", "N")], "node_id string, parent_id string")
    r = {x.node_id: (x.depth, x.level_1, x.level_2, x.level_3, x.level_4)
         for x in hierarchy.hier_flatten(e, depth=4).collect()}
    assert r == {"R": (1, "R", None, None, None), "N": (2, "R", "N", None, None), "C": (3, "R", "N", "C", None)}


def test_flatten_below_the_last_level(spark):
    chain = [("n1", "gone")] + [(f"n{i}", f"n{i - 1}") for i in range(2, 8)] + [(None, "n1"), ("a", "b"), ("b", "a")]
    out = {x.node_id: x for x in hierarchy.hier_flatten(
        spark.createDataFrame(chain, "node_id string, parent_id string"), depth=3).collect()}
    for i in range(1, 8):
        levels = [f"n{j}" if j <= i else None for j in (1, 2, 3)]
        x = out[f"n{i}"]
        assert (x.depth, [x.level_1, x.level_2, x.level_3], x.deeper_than_k) == (i, levels, i > 3)
    assert out["a"].depth == 2 and {out["a"].level_1, out["a"].level_2} == {"a", "b"}
    assert set(out) == {f"n{i}" for i in range(1, 8)} | {"a", "b"}
    none = spark.createDataFrame([], "node_id string, parent_id string")
    assert hierarchy.hier_flatten(none).count() == 0


def test_fact_type_rules(spark):
    from starlayer.functions.lexicon import SNAPSHOT_KEYWORDS

    def rule(rows, **kw):
        return advise.advise_fact_type(spark.createDataFrame(rows, "k int, p string, ts date"), "k", "p", "ts", **kw).first().rule
    day = [D(2020, 1, i) for i in range(1, 6)]
    assert rule([]) == 0
    assert rule([(1, "a", day[0]), (1, "b", day[1])], end_process="b") == 1
    assert rule([(1, p, d) for p, d in zip("abcd", day)]) == 1                     # four processes need no end
    assert rule([(1, SNAPSHOT_KEYWORDS[0], day[0])]) == 2
    assert rule([(1, "a", day[0])], high_volume_per_day=1) == 3
    assert rule([(1, "a", day[0]), (2, "b", day[1])]) == 4
    assert rule([(1, "a", day[0]), (1, "b", day[0])], end_process="b") == 4        # same time: no interval
    assert rule([(1, "a", day[0])]) == 5
    assert rule([(1, None, day[0]), (None, "a", None)]) == 5                       # NULLs are no process, no time


def test_junk_advice_boundaries(spark):
    def df_with(card):
        return spark.range(400).select((F.col("id") % card).alias("a"), (F.col("id") % 2).alias("b"),
                                       (F.col("id") % 3).alias("c"))
    assert advise.advise_junk(df_with(20), ["a", "b", "c"]).first().rule == 4
    assert advise.advise_junk(df_with(21), ["a", "b", "c"]).first().rule == 1
    assert advise.advise_junk(df_with(5), ["a", "b"]).first().rule == 2


def test_zipper_advice_boundaries(spark):
    def log_with(changes):
        return spark.range(changes + 1).select(F.lit(1).alias("k"), F.date_add(F.lit(D(2000, 1, 1)), F.col("id").cast("int")).alias("d"),
                                               (F.col("id") % 2).alias("v"))
    assert advise.advise_zipper(log_with(100), "k", "d", ["v"]).first().rule == 3
    assert advise.advise_zipper(log_with(101), "k", "d", ["v"]).first().rule == 2
    assert advise.advise_zipper(log_with(5), "k", "d", ["v"], need_history=False).first().rule == 1


def test_scd_advice_keywords(spark):
    log = spark.createDataFrame([(1, D(2020, 1, 1), "a")], "k int, d date, addr_fix string")
    assert advise.advise_scd(log, "k", "d", "addr_fix").first().scd_type == 1
    log2 = log.withColumnRenamed("addr_fix", "addr_history")
    assert advise.advise_scd(log2, "k", "d", "addr_history").first().rule == 2
    log3 = log.withColumnRenamed("addr_fix", "addr")
    r = advise.advise_scd(log3, "k", "d", "addr").first()
    assert (r.change_frequency, r.scd_type, r.rule) == ("low", 1, 3)


def test_process_tagging_each_lexicon_entry(spark):
    from starlayer.functions.lexicon import PROCESS_KEYWORDS
    data = [(i, kw) for i, (p, kws) in enumerate(PROCESS_KEYWORDS.items()) for kw in kws[:1]]
    df = spark.createDataFrame(data, "id int, text string")
    out = classify.tag_business_process(df, "id", "text")
    got = {(r.id, r.process) for r in out.collect()}
    for i, p in enumerate(PROCESS_KEYWORDS):
        assert (i, p) in got


def test_process_confidence_rules(spark):
    df = spark.createDataFrame([(1, "user will place order and pay"), (2, "用户 商品 订单 下单"), (3, "nothing")],
                               "id int, text string")
    out = {(r.id, r.process): r.confidence for r in classify.tag_business_process(df, "id", "text").collect()}
    # id 1: 下单 hits 'place order' + 'order' = 2 → 0.8; entity words 'user', 'order' → 0.8 - 0.1
    assert out[(1, "下单")] == pytest.approx(0.7)
    # id 2: 下单 hit once (0.65) minus 3 entity words (0.15) → exactly 0.5 in double → kept
    assert out[(2, "下单")] == 0.5
    boosted = {(r.id, r.process): r.confidence
               for r in classify.process_known_boost(df, "id", "text", ["下单", "盘点"]).collect()}
    assert boosted[(3, "盘点")] == pytest.approx(0.7)
    assert boosted[(1, "下单")] == pytest.approx(0.89)  # min(0.8 + 0.2, 0.99) - 0.1


def test_domain_ties_go_to_lexicon_order(spark):
    df = spark.createDataFrame([(1, "order click"), (2, "zzz")], "id int, text string")
    r = {x.id: x.domain for x in classify.tag_data_domain(df, "id", "text").collect()}
    assert r == {1: "trade", 2: "uncategorized"}


def test_date_gaps(spark):
    df = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 4),)], "order_date date")
    assert [r[0] for r in quality.edge_date_gaps(df).orderBy("missing_date").collect()] == [D(2020, 1, 2), D(2020, 1, 3)]


def test_completeness_and_accuracy_scores(spark):
    df = spark.createDataFrame([(None,), ("a",), ("a",), ("b",)], "order_id string")
    c = quality.report_completeness(quality.completeness_counts(df)).first()
    assert (c.score, c.passed) == (90.0, True)
    cnt = spark.createDataFrame([(100, 79)], "source_count bigint, target_count bigint")
    a = quality.report_accuracy(cnt).first()
    assert (a.score, a.passed) == (79.0, False)
    assert quality.performance_score(100) == 100 and quality.performance_score(550) == 50
    assert quality.performance_score(1000) == 0


def test_consistency_skips_absent_layers(spark):
    t = spark.createDataFrame([(Decimal(1), 1, Decimal(1), 1, Decimal(1), 1, None, None, None, None)],
                              "dwd_gmv decimal(28,2), dwd_orders bigint, dws_gmv decimal(28,2), dws_orders bigint, "
                              "ads_gmv decimal(28,2), ads_orders bigint, dwt_gmv decimal(28,2), dwt_orders bigint, "
                              "dws_all_gmv decimal(28,2), dws_all_orders bigint")
    r = quality.report_consistency(t).first()
    assert (r.score, r.passed, r.notes) == (100.0, True, "4 of 4 layer checks hold")


def test_sessions_stitch_across_midnight(spark):
    ev = spark.createDataFrame([
        (1, TS(2024, 1, 1, 23, 50), 1), (2, TS(2024, 1, 2, 0, 10), 1),   # one session across midnight
        (3, TS(2024, 1, 2, 5, 0), 1),                                    # bounce
        (4, TS(2024, 1, 2, 23, 59), 2), (5, TS(2024, 1, 3, 0, 20), 2), (6, TS(2024, 1, 3, 0, 45), 2),
    ], "event_id int, ts timestamp_ntz, user_id int")
    r = {x.day: (x.sessions, x.bounces) for x in metrics.sessions_bounce(ev).collect()}
    assert r == {D(2024, 1, 1): (1, 0), D(2024, 1, 2): (2, 1)}


def test_dense_snapshot_carries_forward(spark):
    sp = spark.createDataFrame([(1, D(2024, 1, 1), 5), (1, D(2024, 1, 3), 7)], "u int, snapshot_date date, v int")
    out = rows(facts.fact_periodic_dense(sp, "u", ["v"], D(2024, 1, 4)), ["snapshot_date", "v"])
    assert out == [(D(2024, 1, 1), 5), (D(2024, 1, 2), 5), (D(2024, 1, 3), 7), (D(2024, 1, 4), 7)]


def test_accumulating_status(spark):
    ev = spark.createDataFrame([
        (1, "a", TS(2020, 1, 1)), (1, "b", TS(2020, 1, 2)),
        (2, "a", TS(2020, 1, 3)), (2, "b", TS(2020, 1, 2)),
        (3, "a", TS(2020, 1, 1)),
    ], "k int, p string, ts timestamp_ntz")
    r = {x.k: (x.end_status, x.a_to_b_sec) for x in facts.fact_accumulating(ev, "k", "p", "ts", ["a", "b"]).collect()}
    assert r == {1: ("complete", 86400), 2: ("abnormal", -86400), 3: ("in_progress", None)}


def test_accumulating_upsert_keeps_first_value(spark):
    ev = spark.createDataFrame([(1, "a", TS(2020, 1, 1)), (1, "b", TS(2020, 1, 5)), (1, "b", TS(2020, 1, 9))],
                               "k int, p string, ts timestamp_ntz")
    full = facts.fact_accumulating(ev, "k", "p", "ts", ["a", "b"])
    inc = facts.fact_accumulating_batches(ev, "k", "p", "ts", ["a", "b"], ["2020-01-03", "2020-01-07"])
    assert rows(inc) == rows(full.select(*inc.columns))


def test_window_filter_reaches_orders_scan(spark):
    c = Ctx(spark, SF_SMALL)
    plan = c.dws(30)._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "orders.parquet" in ln]
    assert scans and all("GreaterThanOrEqual(o_orderdate" in ln for ln in scans)


def test_dwd_scan_is_pruned(spark):
    c = Ctx(spark, SF_SMALL)
    plan = c.dwd()._jdf.queryExecution().executedPlan().toString()
    li = [ln for ln in plan.splitlines() if "lineitem.parquet" in ln][0]
    assert "l_comment" not in li and "l_quantity" not in li and "l_extendedprice" in li


def test_with_scalars_attaches_one_row(spark):
    from starlayer.functions.joins import with_scalars
    df = spark.range(5).withColumnRenamed("id", "k")
    out = with_scalars(df, df.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("mx")))
    assert rows(out) == [(i, 5, 4) for i in range(5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_edge_skew_flags_hot_key(spark):
    df = spark.range(100).select(F.when(F.col("id") < 40, 0).otherwise(F.col("id")).alias("k"))
    hot = quality.edge_skew(df, "k", 2.0).collect()
    assert [(r.k, r.row_count) for r in hot] == [(0, 40)]


def test_recon_extra_all_reads_the_whole_source(spark):
    from starlayer.plans import catalog
    source = Ctx(spark, SF_SMALL).trade_order()
    extra = catalog.queries()["recon_extra_all"](spark, SF_SMALL).collect()
    known = {r.order_id for r in source.select("order_id").collect()}
    assert extra and not known & {r.order_id for r in extra}
    assert len(extra) == source.where("order_id IS NULL").count()


def test_profile_columns_all_profiles_every_column(spark):
    from starlayer.plans import catalog
    got = [r.column_name for r in catalog.queries()["profile_columns_all"](spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(Ctx(spark, SF_SMALL).trade_order().columns) and len(got) == 9


def test_evidence_keywords_of_a_process(spark):
    df = spark.createDataFrame([(1, "Please PLACE ORDER, then checkout"), (2, "订购后付款"), (3, None), (4, ""), (5, "nothing")], "id int, text string")
    out = {(r.id, r.process): (r.hits, r.evidence_keywords) for r in classify.tag_business_process(df, "id", "text", 0.0).collect()}
    assert out[1, "下单"] == (2, ["place order", "order"]) and out[2, "下单"] == (1, ["订购"]) and out[2, "支付"] == (1, ["付款"])
    assert {i for i, _ in out} == {1, 2}
    known = {r.process: r.evidence_keywords for r in classify.process_known_boost(df.where("id = 5"), "id", "text", ["盘点"]).collect()}
    assert known == {"盘点": []}


def test_found_words_overlap_and_equal_words(spark):
    from starlayer.functions.keywords import found_words
    words = ["pay", "payment", "men", "pay", "", "日本", "absent"]
    df = spark.createDataFrame([("a payment in 日本",), ("pa y",), (None,)], "t string")
    assert [r[0] for r in df.select(found_words(F.col("t"), words)).collect()] == [[0, 1, 2, 3, 4, 5], [4], [4]]


def test_profile_of_odd_columns(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, -0.0, D(2024, 1, 2), TS(2024, 1, 1, 0, 0, 0, 500000), b"\xff", True, None),
                                (None, 0.0, None, TS(2024, 1, 1), b"\x00", False, None), (1, nan, D(99, 1, 1), None, None, True, None)],
                               "i int, f double, d date, t timestamp_ntz, b binary, o boolean, v string")
    r = {x.column_name: x for x in advise.profile_columns(df).collect()}
    assert {c: (x.row_count, x.null_count, x.distinct_count) for c, x in r.items()} == {
        "i": (3, 1, 1), "f": (3, 0, 2), "d": (3, 1, 2), "t": (3, 1, 2), "b": (3, 1, 2), "o": (3, 0, 2), "v": (3, 3, 0)}
    assert (r["i"].min_num, r["i"].max_num, r["i"].min_str) == (1.0, 1.0, None)
    assert (r["d"].min_str, r["d"].max_str, r["t"].max_str) == ("0099-01-01", "2024-01-02", "2024-01-01 00:00:00.5")
    none = {x.column_name: tuple(x)[1:4] for x in advise.profile_columns(df.limit(0)).collect()}
    assert len(none) == 7 and set(none.values()) == {(0, 0, 0)}


def test_profile_reads_once_and_the_sketch_is_near(spark):
    li = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.1')}/lineitem.parquet")
    plan = advise.profile_columns(li)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 1 and "Expand" not in plan
    exact = {x.column_name: x for x in advise.profile_columns(li, ["l_orderkey", "l_partkey", "l_comment" if "l_comment" in li.columns else "l_shipdate"]).collect()}
    near = {x.column_name: x for x in advise.profile_columns(li, list(exact), exact=False).collect()}
    for c, x in exact.items():
        assert abs(near[c].distinct_count - x.distinct_count) <= 0.2 * x.distinct_count
        assert (near[c].null_count, near[c].min_num, near[c].max_num, near[c].min_str, near[c].max_str) == (
            x.null_count, x.min_num, x.max_num, x.min_str, x.max_str)


def test_bus_matrix_of_wide_rows_equals_the_long_form(spark):
    """NULL keys, unknown keys, a process without rows, a dimension no process
    uses, one dimension held by two columns, keys of different types."""
    df = spark.createDataFrame([(1, "x", 7, 8, True), (1, "y", 9, None, None), (2, None, 7, 9, False), (None, "z", None, 1, True)],
                               "cust int, code string, d1 int, d2 int, back boolean")
    dimensions = {"customer": spark.createDataFrame([(1,), (3,), (None,)], "k bigint"),
                  "code": spark.createDataFrame([("x",), ("z",), ("z",)], "k string"),
                  "day": spark.createDataFrame([(7,), (8,), (9,)], "k int"), "unused": spark.createDataFrame([(1,)], "k int")}
    uses = {"order": (F.lit(True), {"customer": "cust", "day": "d1"}), "ship": (F.lit(True), {"customer": "cust", "day": "d2"}),
            "return": (F.col("back"), {"customer": "cust", "code": "code", "day": "d2"}), "never": (F.lit(None).cast("boolean"), {"day": "d1"})}
    none = F.lit(None).cast("string")
    long = None
    for p, (cond, keys) in uses.items():
        f = df.where(cond).select(F.lit(p).alias("process"), *[
            (F.col(keys[d]).cast("string") if d in keys else none).alias(d) for d in dimensions])
        long = f if long is None else long.unionByName(f)
    want = classify.bus_matrix_long(long, "process", dimensions)
    got = classify.bus_matrix_wide(df, uses, dimensions)
    cols = ["process", "dimension", "resolved_keys", "used"]
    assert rows(got, cols) == rows(want, cols) and got.count() == 12
    assert classify.bus_matrix_wide(df.limit(0), uses, dimensions).count() == 0
    one = classify.bus_matrix_wide(df, {"order": uses["order"]}, dimensions)
    assert rows(one, cols) == rows(want.where("process = 'order'"), cols)


def test_funnel_against_brute_force_reads_each_step_once(spark):
    import random
    rng = random.Random(3)
    steps = ("view", "click", "purchase")
    data = [(rng.choice([1, 2, 3, 4, None]), rng.choice(steps + ("other", None)),
             rng.choice([None, TS(2024, 1, 1) + dt.timedelta(hours=rng.randrange(72))])) for _ in range(80)]
    df = spark.createDataFrame(data, "user_id int, event_type string, ts timestamp")
    want = {}
    for u in {d[0] for d in data} - {None}:
        t = None
        for i, s in enumerate(steps):
            late = [x for w, e, x in data if w == u and e == s and x is not None and (i == 0 or x >= t)]
            if not late:
                break
            t = min(late)
            day = t.date() if i == 0 else day
            want.setdefault(day, [0, 0, 0])[i] += 1
    out = metrics.kpi_conversion_funnel(df.where("user_id is not null"))
    got = {r.cohort_date: [r.view_users, r.click_users, r.purchase_users] for r in out.where("cohort_date is not null").collect()}
    assert got == want
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    plan = metrics.kpi_conversion_funnel(ev)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 3
