"""Calendar, frames, joins, panel, sentiment and events on small rows with known results."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardlens.operators import calendar, events, frames, joins, panel, sentiment

D = dt.date
T = dt.datetime


@pytest.fixture(scope="module")
def cal3(spark):
    return calendar.trading_days(spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 8),), (D(2024, 1, 9),), (D(2024, 1, 9),)], "date date")).cache()


def test_cutoffs(spark, cal3):
    times = [T(2024, 1, 5, 13, 29), T(2024, 1, 5, 13, 30), T(2024, 1, 6, 10), T(2024, 1, 8, 0, 10), T(2024, 1, 9, 13, 30), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz")
    got = {r.i: (r.trade_date, r.pos) for r in calendar.assign_trade_date(df, "t", cal3).collect()}
    assert got == {0: (D(2024, 1, 5), 0), 1: (D(2024, 1, 8), 1), 2: (D(2024, 1, 8), 1), 3: (D(2024, 1, 8), 1), 4: (None, None), 5: (None, None)}


def test_times_before_the_calendar(spark, cal3):
    times = [T(2023, 11, 26, 14), T(2023, 12, 5), T(2024, 1, 5) - dt.timedelta(days=5000), T(2024, 1, 4, 13, 30), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz")
    got = {r.i: (r.trade_date, r.pos) for r in calendar.assign_trade_date(df, "t", cal3).collect()}
    assert got == {**dict.fromkeys(range(4), (D(2024, 1, 5), 0)), 4: (None, None)}
    assert calendar.day_parts(df, "t", cal3).filter("pre").count() == 4
    assert [tuple(r)[2:] for r in calendar.assign_trade_date(df, "t", cal3.limit(0)).collect()] == [(None, None)] * 5


def test_preopen_counts(spark, cal3):
    times = [T(2024, 1, 5, 13, 30), T(2024, 1, 8, 8, 59), T(2024, 1, 7, 12), T(2024, 1, 8, 9), T(2024, 1, 8, 13, 30)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert [r.n for r in calendar.preopen_counts(df, "t", cal3).orderBy("pos").collect()] == [None, 3, 1]
    assert [r.n for r in calendar.preopen_counts(df, "t", cal3, start="2024-01-06").orderBy("pos").collect()] == [None, None, 1]


def test_account_weighting(spark, cal3):
    rows = [("article", "a", 1.0, None)] * 3 + [("comment", "b", -1.0, "push"), ("comment", "c", None, "boo"), ("comment", None, 1.0, "arrow")]
    df = spark.createDataFrame([(D(2024, 1, 5), *r) for r in rows], "trade_date date, kind string, account string, score double, tag string")
    got = sentiment.daily_sentiment(df, cal3).orderBy("trade_date").collect()
    a = got[0]
    assert (a.sent_mean, a.bull_ratio, a.sent_std, a.n_polar, a.n_accounts, a.n_articles, a.n_comments, a.push_ratio) == (0.0, 0.5, 1.0, 2, 3, 3, 3, 0.5)
    assert (got[1].sent_mean, got[1].n_articles, got[1].push_ratio) == (None, 0, None)
    few = sentiment.sentiment(df, ["trade_date"], 3).first()
    assert few.sent_mean is None and few.n_polar == 2


def test_frames_are_gated_and_look_back_only(spark):
    df = spark.createDataFrame([("a", i, None if i == 3 else float(i)) for i in range(8)], "k string, i int, x double")
    w = frames.ordered(["k"], "i")
    x = F.col("x")
    q = df.select("i", frames.rolling(F.sum, x, w, 2).alias("s"), frames.rolling(F.avg, x, w, 3, 2, until=-1).alias("b"), frames.forward_sum(x, w, 2).alias("f"), frames.expanding(F.avg, x, w, 2).alias("e"), frames.rolling_quantile(x, 0.5, w, 3, 2).alias("q"), frames.last_known(x, w).alias("l"))
    r = {x.i: x for x in q.collect()}
    assert [r[i].s for i in range(8)] == [None, 1.0, 3.0, None, None, 9.0, 11.0, 13.0]
    assert [r[i].b for i in range(8)] == [None, None, 0.5, 1.0, 1.5, 3.0, 4.5, 5.0]
    assert [r[i].f for i in range(8)] == [3.0, None, None, 9.0, 11.0, 13.0, None, None]
    assert (r[2].e, r[2].q, r[3].l) == (0.5, 0.5, 2.0)


def test_ranks_and_groups(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (3, 1, 3, 2)] + [("a", None)], "k string, x double")
    got = sorted((r.x, r.r) for r in df.select("x", frames.average_rank(["k"], "x").alias("r")).collect() if r.x is not None)
    assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]
    n = spark.range(52).withColumn("k", F.lit(1))
    sizes = {r.g: r["count"] for r in n.select(frames.quantile_group(["k"], ["id"], 5).alias("g")).groupBy("g").count().collect()}
    assert sizes == {0: 11, 1: 10, 2: 10, 3: 10, 4: 11}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, seed, strict):
    r = random.Random(seed)
    left = [(i, r.choice("ab"), r.randint(0, 30)) for i in range(40)]
    right = [(k, t, float(t)) for k in "ab" for t in r.sample(range(31), 8)]
    got = {x.i: x.v for x in joins.as_of(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, u int, v double"), ["k"], "t", "u", ["v"], strict=strict).collect()}
    for i, k, t in left:
        before = [u for kk, u, _ in right if kk == k and (u < t if strict else u <= t)]
        assert got[i] == (float(max(before)) if before else None)


@pytest.mark.parametrize("seed", range(3))
def test_band_and_near(spark, seed):
    r = random.Random(seed)
    a = [(i, r.choice("ab"), r.randint(0, 60)) for i in range(30)]
    b = [(i, r.choice("ab"), r.randint(0, 60)) for i in range(30)]
    got = {(x.i, x.j) for x in joins.band(spark.createDataFrame(a, "i int, k string, p int"), spark.createDataFrame(b, "j int, k string, q int"), ["k"], "p", "q", -3, 5).collect()}
    assert got == {(i, j) for i, k, p in a for j, m, q in b if k == m and p - 3 <= q <= p + 5}
    near = joins.near_event(spark.createDataFrame(a, "i int, k string, p int").withColumn("e", F.col("i") % 4 == 0), ["k"], "p", F.col("e"), 5)
    assert all(x.near == any(k == x.k and abs(p - x.p) <= 5 and i % 4 == 0 for i, k, p in a) for x in near.collect())


def test_intervals_outer_semi_null_safe(spark):
    days = spark.createDataFrame([("a", D(2024, 1, d)) for d in range(1, 8)], "code string, date date")
    p = spark.createDataFrame([("a", D(2024, 1, 2), D(2024, 1, 3)), ("a", D(2024, 1, 3), D(2024, 1, 4)), ("a", None, D(2024, 1, 7)), ("b", D(2024, 1, 6), D(2024, 1, 6))], "code string, start date, end date")
    assert [r.date.day for r in joins.in_intervals(days, p, ["code"], "date", "start", "end").filter("inside").orderBy("date").collect()] == [2, 3, 4]
    left = spark.createDataFrame([(1, "x", 1), (2, None, 2)], "id int, name string, n int")
    right = spark.createDataFrame([(2, "y", 5), (3, "z", 6)], "id int, name string, m int")
    got = {r.id: (r.name, r.n, r.m, r.in_left, r.in_right) for r in joins.outer_with_source(left, right, ["id"], ["name"]).collect()}
    assert got == {1: ("x", 1, None, True, False), 2: ("y", 2, 5, True, True), 3: ("z", None, 6, False, True)}
    assert {r.id for r in joins.semi_or(left, right, "id", F.col("n") == 1).collect()} == {1, 2}
    values = spark.createDataFrame([(None, 9), ("x", 8)], "name string, v int")
    assert {r.id: r.v for r in joins.null_safe(left, values, ["name"], ["v"]).collect()} == {1: 8, 2: 9}


def test_accumulated(spark):
    src = spark.createDataFrame([("a", D(2024, 1, d), float(v)) for d, v in ((1, 1), (2, 2), (5, 4), (6, 8))], "k string, at date, x double")
    days = spark.createDataFrame([("a", D(2024, 1, d)) for d in (2, 3, 4, 7)], "k string, day date")
    got = [(r.x, r.none) for r in joins.accumulated(src, days, ["k"], "at", "day", "x").orderBy("day").collect()]
    assert got == [(None, None), (2.0, False), (0.0, True), (12.0, False)]


def test_panel(spark):
    rows = [("1", "TWSE", D(2024, 1, d), c, o, v) for d, c, o, v in ((1, 100.0, 99.0, 1.0), (2, 95.0, None, 2.0), (3, 50.0, 60.0, 3.0), (4, 54.9, 52.0, 0.0), (5, 54.8, 50.0, 2.0))]
    df = spark.createDataFrame([*rows, rows[0]], "code string, market string, date date, close double, open double, volume double").withColumn("value", F.col("volume") * 10)
    ref = spark.createDataFrame([("1", D(2024, 1, 2), 95.0)], "code string, date date, ref double")
    got = {r.date.day: r for r in panel.returns(panel.traded(df), ref).collect()}
    assert sorted(got) == [1, 2, 3, 5]
    assert got[1].ret is None and got[2].ret == 0.0 and got[2].oc is None
    assert got[3].ret is None and got[3].gap is None and got[3].limit_down_close and not got[1].limit_up_close
    assert got[5].base == 50.0 and got[5].limit_up_close and not got[5].limit_up_open and math.isclose(got[5].ret, math.log(54.8 / 50))
    next_day = [("9", "TPEx", D(2024, 1, d), c, o, 1.0, 95.0, 104.5, 10.0) for d, c, o in ((1, 100.0, 100.0), (2, 104.4, 99.0), (3, 95.0, 85.9))]
    otc = spark.createDataFrame(next_day, "code string, market string, date date, close double, open double, volume double, ref_next double, limit_up_next double, shares double")
    t = panel.returns(otc, ref.withColumn("code", F.lit("9")))
    o = {r.date.day: r for r in t.collect()}
    assert o[1].base is None and o[2].base == 95.0 and o[2].limit_up_close and not o[2].limit_up_open and not o[1].limit_up_close and o[3].limit_down_open and not o[3].limit_down_close
    by_cap = panel.market_returns(t.unionByName(t.withColumn("code", F.lit("8")).withColumn("shares", F.lit(30.0)).withColumn("ret", F.lit(0.0))), "shares", "base").filter("date = '2024-01-02'").first()
    assert math.isclose(math.expm1(by_cap.mkt_ret), (104.4 / 95 - 1) / 4)
    names = spark.createDataFrame([("2330", "x"), ("0050", "x"), ("9103", "x-DR"), ("23301", "x"), ("2330", None)], "c string, n string")
    assert [r.x for r in names.select(panel.common(F.col("c"), F.col("n")).alias("x")).collect()] == [True, False, False, False, False]
    m = panel.market_returns(panel.returns(panel.traded(df), ref)).filter("date = '2024-01-05'").first()
    assert math.isclose(m.mkt_ret, math.log(54.8 / 50))


def test_suspension_has_no_return(spark, cal3):
    rows = spark.createDataFrame([("1", D(2024, 1, 5), 0.1, "TWSE"), ("1", D(2024, 1, 9), 0.2, "TPEx"), ("2", D(2024, 1, 8), 0.3, "TPEx")], "code string, date date, ret double, market string")
    got = [(r.code, r.pos, r.ret, r.market) for r in panel.dense_returns(rows, cal3).orderBy("code", "pos").collect()]
    assert got == [("1", 0, 0.1, "TWSE"), ("1", 1, 0.0, "TWSE"), ("1", 2, 0.2, "TPEx"), ("2", 1, 0.3, "TPEx")]


def test_market_model_sees_the_past_only(spark):
    r = random.Random(0)
    mkt = [r.gauss(0, 0.01) for _ in range(200)]
    rows = [("a", i, 2 * m + (0.05 if i == 170 else 0), m) for i, m in enumerate(mkt)]
    got = {x.pos: x for x in events.market_model(spark.createDataFrame(rows, "code string, pos int, ret double, mkt_ret double")).collect()}
    assert all(got[i].beta is None for i in range(120))
    assert math.isclose(got[170].beta, 2, abs_tol=1e-9) and abs(got[171].beta - 2) > 1e-6
    assert math.isclose(got[170].ar, 0.05, abs_tol=1e-9)


def test_follow_on_and_windows(spark):
    ev = spark.createDataFrame([("a", p) for p in (10, 13, 16, 30)], "code string, pos int")
    assert [r.follows for r in joins.follow_on(ev, ["code"], "pos", 5).orderBy("pos").collect()] == [False, True, True, False]
    assert [r.pos for r in events.drop_close_repeats(ev, ["code"], "pos", ["pos"], 5).orderBy("pos").collect()] == [10, 30]
    rows = spark.createDataFrame([("a", p, None if p == 33 else p % 3) for p in range(40)], "code string, pos int, n int").withColumn("none", F.lit(0))
    w = events.window_counts(rows, "n", "none")
    got = {r.pos: r for r in w.collect()}
    assert got[20].preopen == 2 and got[20].intraday == 0 and got[33].preopen is None and got[32].next is None and got[31].next == 2
    cal = spark.createDataFrame([(p, D(2024, 1, 1) + dt.timedelta(days=p)) for p in range(40)], "pos int, date date")
    known = [r.pos for r in events.known_windows(w, cal, "2024-01-03", "2024-02-05").filter("intraday is not null").orderBy("pos").collect()]
    assert known == [28, 29]
    assert got[4].pre5 is None and got[5].pre5 == sum(p % 3 for p in range(5)) and got[38].post is None and got[30].post is None and got[20].post == sum(p % 3 for p in range(22, 26))
    assert got[24].base is None and math.isclose(got[25].base, sum(math.log1p(p % 3) for p in range(20)) / 20)


def test_first_touch_and_hit_rate(spark):
    bars = spark.createDataFrame([("a", p, h, lo) for p, h, lo in ((1, 10.0, 9.0), (2, 12.0, 9.5), (3, 11.0, 5.0))], "code string, pos int, high double, low double")
    ev = spark.createDataFrame([(i, "a", 0, t, s) for i, (t, s) in enumerate([(12.0, 5.0), (20.0, 5.0), (12.0, 9.5), (20.0, 1.0)])], "event_id int, code string, pos int, target double, stop double")
    assert {r.event_id: r.outcome for r in events.first_touch(ev, bars, ["code"], 60).collect()} == {0: "target", 1: "stop", 2: "stop", 3: "none"}
    h = spark.createDataFrame([("x", p, hit) for p, hit in ((0, True), (1, False), (2, True), (23, True), (22, False))], "a string, e int, hit boolean")
    got = {r.e: r.r for r in h.select("e", events.past_hit_rate(h, ["a"], "e", "hit", 20, 3).alias("r")).collect()}
    assert got[23] == pytest.approx(2 / 3) and got[22] is None


def test_days_that_bar_an_event(spark):
    rows = spark.createDataFrame([("a", 1, 10.0, None), ("a", 2, 11.0, 10.0), ("a", 3, 9.0, 10.5), ("a", 9, 9.0, 9.0)], "code string, pos int, close double, base double")
    got = {r.pos: (r.adj, r.halt) for r in events.day_flags(rows).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, False), 9: (False, True)}
    m = spark.createDataFrame([("a", D(2024, 1, 1), 0.1, 0.01), ("b", D(2024, 1, 1), -0.1, 0.01), ("c", D(2024, 1, 1), 0.01, 0.001)], "code string, date date, ar double, sigma double")
    got = {r.code: (r.eligible, r.event) for r in events.flag_events(m, barred=F.col("code") == "b").collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (True, False)}


def test_targets_and_periods(spark):
    p = spark.createDataFrame([("a", "TWSE", D(2024, 1, d), r) for d, r in ((1, 0.1), (2, 0.0), (3, -0.1), (4, None), (5, 0.2))], "code string, market string, date date, ret double").withColumn("mkt_ret", F.lit(0.01))
    t = panel.targets(p)
    got = {r.date.day: (r.up_next, r.excess_next) for r in t.collect()}
    assert [got[d][0] for d in range(1, 6)] == [0, 0, None, 1, None] and math.isclose(got[1][1], -0.01)
    days = lambda **k: [r.date.day for r in panel.period(t, "2024-01-02", "2024-01-05", "2024-01-04", **k).orderBy("date").collect()]
    assert days() == [2] and days(final=True) == [2, 3, 4]
    assert [r.x for r in p.orderBy("date").select(panel.signed(F.col("ret")).alias("x")).collect()] == [1, None, 0, None, 1]


def test_factor_choice(spark):
    rows = [(D(2024, 1, 31), c, m, v, q, n) for c, m, v, q, n in (("a", 0.3, 0.1, 9.0, 250), ("b", 0.2, 0.3, 8.0, 250), ("c", 0.1, 0.2, 7.0, 250), ("d", 9.0, 0.0, 1.0, 250), ("e", 9.0, 0.0, 9.0, 199), ("f", None, 0.4, 7.5, 250))]
    s = spark.createDataFrame(rows, "date date, code string, mom double, vol double, liq double, n_obs long")
    got = {f: [r.code for r in panel.factor_choice(s, liquid=4, n=2, fewer=1).filter(F.col("factor") == f).orderBy("rank").collect()] for f in ("momentum", "momentum_fewer", "low_volatility", "liquidity", "combined")}
    assert got == {"momentum": ["a", "b"], "momentum_fewer": ["a"], "low_volatility": ["a", "c"], "liquidity": ["a", "b"], "combined": ["a", "b"]}


def test_abnormal_returns(spark):
    r = random.Random(3)
    n, codes = 320, ["a", "b", "c"]
    mkt = [r.gauss(0, 0.01) for _ in range(n)]
    ret = {c: [0.001 + (1 + i) * m + r.gauss(0, 0.001) for m in mkt] for i, c in enumerate(codes)}
    dense = spark.createDataFrame([(c, p, ret[c][p], mkt[p], 1.0 + i) for i, c in enumerate(codes) for p in range(n)], "code string, pos int, ret double, mkt_ret double, value double")
    ev = spark.createDataFrame([("b", 300), ("b", 100), ("b", 318)], "code string, pos int")
    got = {x.pos: x for x in events.abnormal_returns(ev, dense, (1, 5), (5,), least=3).collect()}
    x, y = np.array(mkt[50:271]), np.array(ret["b"][50:271])
    slope, level = np.polyfit(x, y, 1)
    assert got[300].mm_5 == pytest.approx(sum(ret["b"][301:306]) - (5 * level + slope * sum(mkt[301:306])))
    assert got[300].car_5 == pytest.approx(sum(ret["b"][301:306]) - sum(mkt[301:306])) and got[300].pre_5 == pytest.approx(sum(ret["b"][295:300]) - sum(mkt[295:300]))
    assert got[100].mm_1 is None and got[318].car_5 is None and got[318].car_1 is not None
    assert got[300].bm_1 == pytest.approx(0)


def test_calendar_flags(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    days = [d for d in days if d.weekday() < 5 and d not in (D(2024, 1, 17), D(2024, 2, 28))]
    f = {r.date: r for r in calendar.period_flags(calendar.trading_days(spark.createDataFrame([(d,) for d in days], "date date"))).collect()}
    assert f[D(2024, 1, 18)].settle and f[D(2024, 2, 21)].settle and sum(r.settle for r in f.values()) == 3
    assert f[D(2024, 1, 31)].month_end and f[D(2024, 2, 29)].month_end and not f[max(days)].month_end
    assert math.isclose(f[D(2024, 1, 8)].log_gap, math.log(3)) and f[D(2024, 1, 8)].dow == 0


@pytest.mark.parametrize("seed", range(2))
def test_as_of_days_agrees_with_as_of(spark, seed):
    r = random.Random(seed)
    day = lambda: D(2024, 1, 1) + dt.timedelta(days=r.randint(0, 40))
    left = spark.createDataFrame([(i, r.choice("ab"), day()) for i in range(60)] + [(90, "c", D(2024, 1, 5)), (91, "a", None), (92, None, D(2024, 1, 5))], "i int, k string, d date")
    right = spark.createDataFrame([(r.choice("ab"), day(), r.randint(0, 9)) for _ in range(20)] + [("a", None, 1)], "k string, at date, v int")
    got = {x.i: x.v for x in joins.as_of_days(left, right, ["k"], "d", "at", ["v"]).collect()}
    want = {x.i: x.v for x in joins.as_of(left, right, ["k"], "d", "at", ["v"]).collect()}
    assert got == want and len(got) == 63


def test_overnight(spark):
    us = [(D(2024, 1, d), a, h, lo, v) for d, a, h, lo, v in ((1, 100.0, 101.0, 99.0, 5.0), (2, 102.0, 103.0, 100.0, 6.0), (4, 99.0, 104.0, 98.0, 7.0), (5, 98.0, 99.0, 97.0, 0.0))]
    s = spark.createDataFrame(us, "date date, adj double, high double, low double, volume double")
    cal = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 2, 3, 4, 8)], "date date")
    got = {x.date.day: x for x in joins.overnight(s, cal, window=1).collect()}
    pk = lambda h, lo: math.log(h / lo) ** 2 / (4 * math.log(2))
    assert got[1].abs is None and got[2].abs is None and got[4].none == 1.0 and got[4].abs == 0.0 and got[4].lvol == 0.0
    assert got[3].abs == pytest.approx(math.log(1.02)) and got[3].neg == 0 and got[3].lvol == pytest.approx(math.log(6 / 5)) and got[3].none == 0.0
    assert got[8].neg == pytest.approx(math.log(98 / 102)) and got[8].pk == pytest.approx(math.sqrt(pk(104, 98) + pk(99, 97))) and got[8].lvol is None


def test_volume_design(spark):
    rows = [("a", p, 10.0 + p, 12.0 + p, 9.0, 1.0 + p, 0.01 * (-1) ** p, p == 3, False, -0.02) for p in range(30)]
    d = spark.createDataFrame(rows, "code string, pos int, close double, high double, low double, volume double, ret double, limit_up_close boolean, limit_down_close boolean, gap double")
    got = {x.pos: x for x in events.volume_design(d).collect()}
    lv = [math.log(1 + p) for p in range(30)]
    assert got[0].y_lv_l1 is None and got[4].y_lv_l5 is None and got[5].y_lv_l5 == pytest.approx(sum(lv[:5]) / 5) and got[22].y_lv_l22 == pytest.approx(sum(lv[:22]) / 22)
    assert got[4].lock_up1 == 1.0 and got[2].abs_r1 == pytest.approx(0.01) and got[2].neg_r1 == pytest.approx(-0.01) and got[1].neg_r1 == 0.0 and got[7].gap_neg == -0.02
    assert got[3].y_vol == pytest.approx(math.log(math.log(15 / 9)))


def test_weekly(spark):
    days = [(D(2024, 1, d), float(d), 0.01 * d if d != 18 else None) for d in (4, 5, 6, 8, 11, 15, 18, 22)]
    d = spark.createDataFrame([("a", "TWSE", x, c, r) for x, c, r in days], "code string, market string, date date, close double, ret double").withColumn("sent", F.col("close"))
    got = {r.date.day: r for r in panel.weekly(d, ["close"], ["sent"]).collect()}
    assert set(got) == {5, 11, 18, 22} and got[5].close == 5.0 and got[5].sent == 4.5 and got[11].sent == pytest.approx(25 / 3)
    assert got[5].ret_next == pytest.approx(0.25) and got[5].target_end == D(2024, 1, 11) and got[11].ret_next is None and got[22].target_end is None
    assert [r.date.day for r in panel.weekly(d, ["close"], ["sent"], "2024-01-06", "2024-01-19").collect()] == [11]
    x = d.limit(1).select(panel.hedged(F.lit(0.1), F.lit(0.05)).alias("x")).first().x
    assert x == pytest.approx(math.log(1 + math.exp(0.1) - math.exp(0.05)))
