"""Estimators against numpy, and known results of tests, back-tests and models."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boardlens.functions import distributions as dist
from boardlens.operators import frames, models, portfolio, resampling, stats, strategies


def _panel(seed=0, n=400):
    r = np.random.default_rng(seed)
    df = pd.DataFrame({"code": r.integers(0, 8, n), "date": r.integers(0, 15, n), "x": r.normal(size=n), "z": r.normal(size=n)})
    df["y"] = 0.5 * df.x - 0.2 * df.z + df.code * 0.3 + df.date * 0.1 + r.normal(size=n)
    df["t"] = range(n)
    return df


def test_distributions():
    assert dist.t_sf(2.0, 10) == pytest.approx(0.0366940174)
    assert dist.f_sf(3.0, 2, 20) == pytest.approx(0.0725381503)
    assert dist.normal_sf(1.959963985) == pytest.approx(0.025)
    assert dist.normal_quantile(0.95) == pytest.approx(1.644853627)


def test_ols_and_hac(spark):
    p = _panel()
    d = spark.createDataFrame(p)
    x = np.column_stack((np.ones(len(p)), p.x, p.z))
    b = np.linalg.lstsq(x, p.y, rcond=None)[0]
    e = p.y.to_numpy() - x @ b
    bread = np.linalg.inv(x.T @ x)
    u = x * e[:, None]
    meat = u.T @ u
    for m in range(1, 6):
        g = u[m:].T @ u[:-m]
        meat += (1 - m / 6) * (g + g.T)
    fit = stats.ols_hac(d, "y", ["x", "z"], "t")
    assert np.allclose(fit.beta, b) and np.allclose(fit.cov, bread @ meat @ bread)
    assert stats.ols(d, "y", ["x", "z"]).ssr == pytest.approx(e @ e)
    diff, se = fit.contrast({"x": 1, "z": -1})
    assert diff == pytest.approx(b[1] - b[2]) and se > 0


def test_fixed_effects_equal_dummies_and_two_way_clusters(spark):
    p = _panel(1)
    d = spark.createDataFrame(p)
    fit = stats.fe_ols(d, "y", ["x", "z"], ["code", "date"], ["code", "date"])
    dummies = pd.get_dummies(p[["code", "date"]].astype(str)).to_numpy(float)
    full = np.column_stack((p.x, p.z, dummies))
    assert np.allclose(fit.beta, np.linalg.lstsq(full, p.y, rcond=None)[0][:2], atol=1e-8)
    q = lambda v: v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
    x = np.column_stack((q(p.x.to_numpy()), q(p.z.to_numpy())))
    e = q(p.y.to_numpy()) - x @ fit.beta
    bread, n, k, cov = np.linalg.inv(x.T @ x), len(p), 2, 0
    for key, sign in ((p.code.astype(str), 1), (p.date.astype(str), 1), (p.code.astype(str) + "|" + p.date.astype(str), -1)):
        s = pd.DataFrame(x * e[:, None]).groupby(key.to_numpy()).sum().to_numpy()
        g = len(s)
        cov = cov + sign * g / (g - 1) * (n - 1) / (n - k) * bread @ s.T @ s @ bread
    assert np.allclose(fit.cov, cov, atol=1e-9)


def test_granger_finds_direction(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=400)
    y = np.concatenate(([0], 0.8 * x[:-1])) + r.normal(size=400) * 0.5
    d = spark.createDataFrame(pd.DataFrame({"t": range(400), "x": x, "y": y}))
    assert all(p < 1e-6 for _, _, p in stats.granger(d, "x", "y", "t", 2))
    assert all(p > 0.001 for _, _, p in stats.granger(d, "y", "x", "t", 2))


def test_spread_welch_power(spark):
    p = _panel(2)
    p["up"] = p.x > 0
    p["v"] = p.up * 0.5 + np.random.default_rng(5).normal(size=len(p))
    d = spark.createDataFrame(p)
    diff, t, n = stats.spread_test(d, "v", "up", ["date", "code"])
    assert diff == pytest.approx(p.v[p.up].mean() - p.v[~p.up].mean()) and n == 400 and t > 2
    assert stats.spread_test(d, "v", "up", ["date"], 0.05)[0] < diff + 0.2
    tw, pw = stats.welch(d, "v", "up")
    assert tw > 2 and pw > 0.95
    assert stats.expected_power(1.645, 100, 100) == pytest.approx(0.5, abs=1e-3)


def test_multiple_tests_and_kappa(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "h string, p double")
    assert {r.h: r.holm for r in stats.holm(d, "p").collect()} == {"d": True, "a": True, "c": False, "b": False}
    assert {r.h: round(r.p_bh, 6) for r in stats.benjamini_hochberg(d, "p").collect()} == {"d": 0.02, "a": 0.02, "c": 0.04, "b": 0.04}
    k = spark.createDataFrame([("x", "x"), ("y", "y"), ("x", None)], "a string, b string")
    assert stats.kappa(k, "a", "b").first().kappa == 1.0
    k = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")], "a string, b string")
    assert stats.kappa(k, "a", "b").first().kappa == 0.0


def test_auc(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.4), (1, 0.4), (0, 0.1)], "y int, s double")
    assert stats.auc(d, "y", "s").first().auc == pytest.approx(0.875)
    assert stats.auc(d.filter("y = 1"), "y", "s").first().auc is None


def test_backtest_costs(spark):
    rows = [(i, r, p) for i, (r, p) in enumerate([(0.1, 1.0), (None, -1.0), (0.0, -1.0), (0.1, 0.0)])]
    d = spark.createDataFrame(rows, "t int, r double, p double").withColumn("k", F.lit("s"))
    b = portfolio.backtest(d, ["k"], "t", "r", "p", 0.01, 0.02, short_fee=0.005).orderBy("t").collect()
    assert [round(x.cost, 6) for x in b] == [0.01, 0.045, 0.0, 0.01]
    assert b[1].net is None and b[2].equity == pytest.approx(math.exp(0.1) - 0.01)
    rt = portfolio.backtest(d, ["k"], "t", "r", "p", 0.01, 0.02, round_trip=True).orderBy("t").collect()
    assert [round(x.cost, 6) for x in rt] == [0.03, 0.03, 0.03, 0.0]
    s = portfolio.summary(portfolio.backtest(d, ["k"], "t", "r", "p", 0.01, 0.02), ["k"], "t").first()
    assert s.turnover == 4.0 and s.n == 3


def test_weights_drift_band_hold_and_untradable(spark):
    ln = math.log
    rows = [("s", 0, ln(1.1), 0.0, 0.5, 0.5, True, True), ("s", 1, 0.0, 0.0, None, None, True, True), ("s", 2, 0.0, 0.0, 0.5, 0.5, True, False), ("s", 3, 0.0, 0.0, 0.5, 0.5, None, None), ("s", 4, ln(1.2), 0.0, 0.52, 0.48, True, True)]
    d = spark.createDataFrame(rows, "k string, t int, r_a double, r_b double, t_a double, t_b double, o_a boolean, o_b boolean")
    g = portfolio.weights_backtest(d, ["k"], "t", ["a", "b"], 0.01, 0.02).orderBy("t").collect()
    drift = 0.55 / 1.05
    assert g[0].cost == pytest.approx(0.01) and g[0].gross == pytest.approx(0.05) and g[0].net == pytest.approx(0.99 * 1.05 - 1)
    assert g[1].traded == 0 and g[1].w_a == pytest.approx(drift)
    assert g[2].traded == 0
    assert g[3].traded == 0 and g[3].w_a == pytest.approx(drift) and g[3].position == pytest.approx(1.0)
    free = portfolio.weights_backtest(d.drop("o_a", "o_b"), ["k"], "t", ["a", "b"], 0.01, 0.02).orderBy("t").collect()
    assert free[2].traded == pytest.approx(2 * (drift - 0.5)) and free[2].w_a == pytest.approx(0.5)
    assert g[4].gross == pytest.approx(0.52 * 0.2)
    held = portfolio.weights_backtest(d, ["k"], "t", ["a", "b"], 0.01, 0.02, band=0.05).orderBy("t").collect()
    assert held[3].traded == 0 and held[4].traded == 0


@pytest.mark.parametrize("seed", range(3))
def test_weights_against_a_day_by_day_book(spark, seed):
    r = np.random.default_rng(seed)
    n, band = 120, 0.04
    p = pd.DataFrame({"k": "s", "t": range(n), **{f"r_{a}": r.normal(0, 0.05, n) for a in "ab"}, **{f"o_{a}": r.random(n) > 0.2 for a in "ab"}})
    goal = r.random((n, 2)) * 0.7
    goal[r.random(n) < 0.6] = np.nan
    p["t_a"], p["t_b"] = goal.T
    got = portfolio.weights_backtest(spark.createDataFrame(p), ["k"], "t", ["a", "b"], 0.01, 0.02, band).orderBy("t").collect()
    money, cash, wealth = {"a": 0.0, "b": 0.0}, 1.0, 1.0
    for row, x in zip(p.to_dict("records"), got, strict=True):
        paid = 0.0
        if not math.isnan(row["t_a"]):
            want = {a: row[f"t_{a}"] * wealth for a in "ab"}
            if any(abs(want[a] - money[a]) / wealth > band for a in "ab") and all(row[f"o_{a}"] or want[a] == money[a] for a in "ab"):
                paid = sum((0.01 if want[a] > money[a] else 0.02) * abs(want[a] - money[a]) for a in "ab") / wealth
                money, cash = want, wealth - sum(want.values())
        assert x.cost == pytest.approx(paid) and x.w_a == pytest.approx(money["a"] / wealth)
        money = {a: m * math.exp(row[f"r_{a}"]) for a, m in money.items()}
        after = cash + sum(money.values())
        assert x.net == pytest.approx((1 - paid) * after / wealth - 1)
        wealth = after


def test_periodic_portfolio(spark):
    ln = math.log
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rets = spark.createDataFrame([(day(i), i, c, r) for i, c, r in [(0, "a", 0.0), (1, "a", ln(1.2)), (2, "a", 0.0), (3, "a", ln(1.5)), (0, "b", 0.0), (1, "b", 0.0), (3, "c", 0.0), (4, "c", ln(2.0)), (4, "a", 0.0)]], "date date, pos int, code string, ret double")
    picks = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 2, "a"), (2, 2, "c")], "period bigint, pos int, code string")
    g = {r.date.day: r for r in portfolio.periodic_portfolio(rets, picks, 0.01, 0.02).collect()}
    assert g[2].gross == pytest.approx(0.1) and g[2].cost == pytest.approx(0.01) and g[2].net == pytest.approx(0.99 * 1.1 - 1) and g[2].n == 2
    assert g[3].gross == pytest.approx(0.0) and g[3].cost == 0
    assert g[4].gross == pytest.approx(0.25)
    old_a, old_b = 0.6 / 1.1, 0.5 / 1.1
    assert g[4].cost == pytest.approx(0.01 * 0.5 + 0.02 * (old_a - 0.5 + old_b))
    assert g[5].gross == pytest.approx((0.75 + 1.0) / 1.25 - 1)


def test_splits_and_front_contract(spark):
    day = lambda i: dt.date(2024, 1, i)
    rows = spark.createDataFrame([("x", day(1), 100.0), ("x", day(2), 25.0), ("x", day(3), 20.0)], "code string, date date, close double")
    splits = spark.createDataFrame([("x", 4.0, day(1))], "code string, ratio double, last_trade date")
    assert [r.ret for r in portfolio.split_adjusted(rows, splits).orderBy("date").collect()] == [None, 0.0, pytest.approx(math.log(0.8))]
    tx = [("A", 1, 100.0), ("B", 1, 110.0), ("A", 2, 101.0), ("B", 2, 112.0), ("B", 3, 115.0), ("B", 4, 116.0)]
    f = portfolio.front_returns(spark.createDataFrame([(c, day(d), s) for c, d, s in tx], "contract string, date date, settle double"))
    assert [(r.date.day, r.contract, round(math.exp(r.ret), 6)) for r in f.orderBy("date").collect()] == [(2, "B", round(112 / 110, 6)), (3, "B", round(115 / 112, 6)), (4, "B", round(116 / 115, 6))]


def test_missing_settlement_is_an_error(spark):
    tx = spark.createDataFrame([("A", dt.date(2024, 1, d), s) for d, s in ((1, 100.0), (2, 0.0), (3, 101.0))], "contract string, date date, settle double")
    with pytest.raises(Exception, match="no settlement of A"):
        portfolio.front_returns(tx).collect()


def test_stationary_rows_are_blocks():
    rows = resampling.stationary_rows(50, 20_000, 10, np.random.default_rng(0))
    jumps = ((rows[1:] - rows[:-1]) % 50 != 1).sum()
    assert len(rows) == 20_000 and rows.min() >= 0 and rows.max() < 50 and 1700 < jumps < 2200


def test_resampling(spark):
    r = np.random.default_rng(0)
    y = (r.random(300) > 0.5).astype(int)
    d = spark.createDataFrame(pd.DataFrame({"t": range(300), "y": y, "a": y * 0.5 + r.random(300), "b": r.random(300), "ret": r.normal(size=300) + 0.5}))
    lo, hi = resampling.auc_difference(d, "t", "y", "b", "a", reps=100)
    assert 0 < lo < hi < 1
    assert resampling.win_probability(d, "t", "ret", 200, reps=50) == 1.0
    assert resampling.win_probability(d.withColumn("ret", -F.abs("ret")), "t", "ret", 200, reps=50) == 0.0
    assert resampling.permutation_percentile(d.withColumn("p", F.signum(F.col("ret") - 0.5)), "t", "ret", "p", reps=100) > 0.99
    assert resampling.permutation_percentile(d.withColumn("p", F.lit(1.0)), "t", "ret", "p", reps=10) is None
    assert resampling.auc_difference(d, "t", "y", "a", "b", reps=20) == resampling.auc_difference(d.repartition(5), "t", "y", "a", "b", reps=20)


def test_walk_forward_has_no_look_ahead(spark):
    r = np.random.default_rng(0)
    p = pd.DataFrame({"k": "a", "t": range(400), "x": r.normal(size=400)})
    p["y"] = 2 * p.x + 0.1 * r.normal(size=400)
    p["up"] = (p.y > 0).astype(float)
    q = p.copy()
    q.loc[330:, ["x", "y"]] = 9.0
    for kind, target in (("ols", "y"), ("ridge", "y"), ("logit", "up")):
        a, b = (models.walk_forward(spark.createDataFrame(z), ["k"], "t", ["x"], target, kind).toPandas().set_index("t") for z in (p, q))
        assert a.index.min() == 250 and len(a) == 150 and (a.train_end < a.index).all()
        assert np.allclose(a.pred[:330 - 250], b.pred[:330 - 250])
        assert np.corrcoef(a.pred, p.y[250:])[0, 1] > 0.7
    with pytest.raises(ValueError, match="unknown kind"):
        models.walk_forward(spark.createDataFrame(p), ["k"], "t", ["x"], "y", "tree")


def test_text_classifier(spark, tmp_path):
    texts = [("漲停 看多 創高", "long")] * 6 + [("跌停 看空 破底", "short")] * 6 + [("請問 開戶", "none")] * 6 + [(None, "none")]
    d = spark.createDataFrame(texts, "text string, label string")
    assert spark.createDataFrame([("abca",)], "t string").select(models.char_ngrams(F.col("t")).alias("g")).first().g == ["a", "b", "c", "a", "ab", "bc", "ca", "abc", "bca"]
    m = models.TextClassifier().fit(d, "text", "label")
    got = {r.text: r.label for r in m.predict(d, "text").collect()}
    assert got["漲停 看多 創高"] == "long" and got["跌停 看空 破底"] == "short"
    whole = {r.text: r.probability.toArray() for r in m.model.transform(m._vectors(d, "text")).collect()}
    for r in m.predict(d, "text").collect():
        assert [r[f"p_{x}"] for x in m.labels] == pytest.approx(list(whole[r.text]))
    two = models.TextClassifier().fit(d.filter("label != 'none'"), "text", "label")
    assert {(r.text, r.label) for r in two.predict(d.filter("label != 'none'"), "text").collect()} == set(texts[:12])
    m.save(str(tmp_path / "m"))
    again = models.TextClassifier.load(str(tmp_path / "m"))
    assert again.meta == m.meta and {r.text: r.label for r in again.predict(d, "text").collect()} == got
    report = {r.label: r for r in models.class_report(m.predict(d.withColumnRenamed("label", "actual"), "text"), "actual", "label").collect()}
    assert report["long"].f1 == 1.0
    with pytest.raises(FileNotFoundError):
        models.TextClassifier.load(str(tmp_path / "none"))


def test_strategy_signals(spark):
    d = spark.createDataFrame([("a", i, 0.01 * (-1) ** i) for i in range(250)], "k string, t int, r double")
    w = frames.ordered(["k"], "t")
    got = d.withColumn("level", portfolio.level(F.col("r"), w)).select("t", portfolio.volatility_target(F.col("r"), w, 0.24).alias("v"), portfolio.above_average(F.col("level"), w).alias("a")).orderBy("t").collect()
    assert got[10].v == 1.0 and 1.4 < got[100].v < 1.6 and got[100].a is None and got[220].a is not None


def test_strategies(spark):
    r = np.random.default_rng(1)
    days = [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(400) if (dt.date(2023, 1, 2) + dt.timedelta(days=i)).weekday() < 5]
    p = pd.DataFrame({"date": days, "ret": r.normal(0, 0.01, len(days))})
    p["r_x1"], p["r_x2"] = p.ret, 2 * p.ret
    s = strategies.signals(spark.createDataFrame(p), "ret", 0.2, (20, 60), (100, 150, 200, 250), (1.25, 1.5, 1.75)).withColumns({f"leverage_120_{k}": F.lit(1.0) for k in (1.25, 1.5, 1.75)})
    t = strategies.targets(s, strategies.registered() | strategies.variants(), ["x1", "x2"], ["r_x1"])
    assert t.select("strategy").distinct().count() == 4 + 25
    rows = {(x.strategy, x.date): x for x in t.collect()}
    assert rows["C1", days[0]].t_x1 == 0.5 and rows["C1", days[1]].t_x1 is None and rows["C2", days[0]].t_x2 == 0.0
    assert rows["C2", days[4]].t_x1 == 1.0 and rows["C2", days[3]].t_x1 is None and rows["C3", days[150]].t_x1 == 1.0
    assert all(0 <= x.t_x2 <= 1 for x in rows.values() if x.t_x2 is not None)
    mix = strategies.targets(s, strategies.allocations({"m": ({"x1": 0.4, "bond": 0.6}, "quarterly")}) | {"rp": strategies.risk_parity(["x1", "x2"])}, ["x1", "x2", "bond"])
    got = {(x.strategy, x.date): x for x in mix.collect()}
    assert (got["m", days[0]].t_x1, got["m", days[0]].t_x2, got["m", days[0]].t_bond) == (0.4, 0.0, 0.6)
    assert [d.month for k, d in got if k == "m" and got[k, d].t_x1 is not None and d > days[0]] == [4, 7, 10, 1]
    later = next(d for d in days[65:] if got["rp", d].t_x1 is not None)
    assert got["rp", days[0]].t_x1 == 0.5 and got["rp", later].t_x1 == pytest.approx(2 / 3)
    c = strategies.Costs(0.001425, 0.6, 0.003, 0.0015, 0.001, 0.0008, 0.0001, 0.00002)
    assert c.stock() == pytest.approx((0.000855, 0.003855, 0.0008)) and c.stock(True) == pytest.approx((0.000855, 0.002355, 0.0)) and c.future() == pytest.approx((0.00012, 0.00012, 0.0)) and c.fund() == pytest.approx((0.000855, 0.001855))


def test_splice_and_rolling_choice(spark):
    day = lambda i: dt.date(2024, 1, i)
    index = spark.createDataFrame([(day(i), 0.01) for i in (1, 2, 5, 8)], "date date, ret double")
    two = spark.createDataFrame([(day(i), 0.02) for i in (2, 5)], "date date, ret double")
    funds = spark.createDataFrame([(day(5), 0.011, 0.021), (day(8), None, 0.03)], "date date, x1 double, x2 double")
    got = strategies.spliced(index, two, funds, "2024-01-05", 0.0365).orderBy("date").collect()
    assert [x.r_x1 for x in got] == [pytest.approx(math.log(math.exp(0.01) - 0.0001)), pytest.approx(math.log(math.exp(0.01) - 0.0001)), 0.011, None]
    assert [(x.r_x2, x.o_x1, x.o_x2) for x in got] == [(None, True, True), (0.02, True, True), (0.021, True, True), (0.03, False, True)]
    nets = spark.createDataFrame([(s, dt.date(y, 1, 2 + i), 0.1, w, 1 - w) for s, w in (("a", 1.0), ("b", 0.2)) for y in (2020, 2021, 2022) for i in (0, 1)], "strategy string, date date, net double, w_x1 double, w_x2 double")
    choice = spark.createDataFrame([(2020, "a"), (2021, "b"), (2022, "b")], "year int, strategy string")
    assert [round(x.net, 6) for x in strategies.rolling_choice(nets, choice, ["x1", "x2"], 0.01).orderBy("date").collect()] == [0.1, 0.1, round(1.1 * (1 - 0.008) - 1, 6), 0.1, 0.1, 0.1]


def test_small_helpers(spark):
    assert stats.one_sided(1.645) == pytest.approx(0.05, abs=1e-3) and stats.detectable(1.0) == pytest.approx(2.4865, abs=1e-3)
    d = spark.createDataFrame([(i, 1.0 if i % 2 else -1.0, (1.0 if i % 2 else 0.0) + (i % 3) / 10) for i in range(60)], "t int, side double, v double")
    diff, t, n = stats.side_difference(d, "v", "side", "t")
    assert diff == pytest.approx(1.0, abs=0.05) and t > 5 and n == 60 and stats.side_difference(d.limit(15), "v", "side", "t") is None
    assert [x.train for x in models.time_split(d.limit(9), "t").orderBy("t").collect()] == [True] * 7 + [False] * 2
    p = spark.createDataFrame([(0.5, 0.3, 0.2), (0.2, 0.3, 0.5), (0.4, 0.2, 0.4)], "a double, b double, c double")
    assert [x.x if x.x is None else round(x.x, 6) for x in p.select(models.polarity(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == [0.2, None, 0.2]
    b = spark.createDataFrame([(0.5, "bullish"), (-1.0, "bullish"), (0.0, "bearish"), (None, "bearish")], "s double, l string")
    assert tuple(models.lexicon_baseline(b, "s", "l").first()) == (0.5, 0.5)


def test_demean_says_when_it_does_not_converge(spark):
    d = spark.createDataFrame([(i % 3, i % 4, float(i * i)) for i in range(11)], "a int, b int, x double")
    with pytest.raises(ArithmeticError):
        stats.demean(d, ["x"], ["a", "b"], most=1)


def test_extreme_spread(spark):
    r = np.random.default_rng(2)
    p = pd.DataFrame({"t": range(300), "x": r.normal(size=300)})
    p["low"], p["high"] = p.x < -0.5, p.x > 0.5
    p["y"] = np.where(p.low, 0.5, 0.0) + 0.1 * r.normal(size=300)
    got = stats.extreme_spread(spark.createDataFrame(p), "y", "low", "high", ["x"], "t", 5)
    assert got["n"] == 300 and got["raw_diff"] == pytest.approx(0.5, abs=0.05) and got["diff"] == pytest.approx(0.5, abs=0.15) and got["t"] > 5 and got["p"] < 1e-3


def test_correlations_of_what_does_not_vary_are_nan(spark):
    r = np.random.default_rng(7)
    rows = [("a", float(x), float(x + e)) for x, e in r.normal(size=(50, 2))]
    rows += [("x", 0.1, float(i)) for i in range(9)] + [("y", float(i), 0.1) for i in range(9)] + [("one", 1.0, 2.0), ("none", 1.0, None)]
    rows += [("nulls", 0.3, float(i)) for i in range(5)] + [("nulls", 5.0, None), ("nulls", None, 7.0)]
    got = {x.code: x for x in stats.correlations(spark.createDataFrame(rows, "code string, x double, y double"), "x", "y", ["code"]).collect()}
    a = pd.DataFrame([x[1:] for x in rows if x[0] == "a"])
    assert got["a"].n == 50 and got["a"].pearson == pytest.approx(a.corr().iloc[0, 1]) and got["a"].spearman == pytest.approx(a.rank().corr().iloc[0, 1])
    assert {k: x.n for k, x in got.items() if k != "a"} == {"x": 9, "y": 9, "one": 1, "nulls": 5}
    assert all(math.isnan(x.pearson) and math.isnan(x.spearman) for k, x in got.items() if k != "a")


def test_pearson_of_a_constant_is_nan_when_put_together_from_parts(spark):
    d = spark.range(0, 10_000, 1, 7).select("id", (F.col("id") % 3).alias("k"), F.lit(0.1).alias("x"), F.col("id").cast("double").alias("y"))
    got = d.groupBy("k").agg(stats.pearson("x", "y").alias("r"), stats.pearson("y", "y").alias("own")).collect()
    assert len(got) == 3 and all(math.isnan(x.r) and x.own == pytest.approx(1) for x in got)
    assert d.filter("id < 0").agg(stats.pearson("x", "y").alias("r")).first().r is None


def test_cross_correlation_of_what_does_not_vary_is_nan(spark):
    x = np.random.default_rng(8).normal(size=40)
    rows = [("a", i, float(v), float(x[i - 2]) if i > 1 else None) for i, v in enumerate(x)] + [("flat", i, 0.1, float(v)) for i, v in enumerate(x)]
    rows += [("part", i, float(v) if i > 1 else 0.3, float(i) if i < 2 else None) for i, v in enumerate(x)] + [("empty", i, None, float(v)) for i, v in enumerate(x)]
    got = {(r.code, r.lag): r.r for r in stats.cross_correlation(spark.createDataFrame(rows, "code string, t int, x double, y double"), "x", "y", "t", ["code"], 2).collect()}
    assert len(got) == 4 * 5 and got["a", 2] == pytest.approx(1) and got["a", 0] == pytest.approx(np.corrcoef(x[2:], x[:-2])[0, 1])
    assert all(math.isnan(got["flat", k]) for k in range(-2, 3)) and all(got["empty", k] is None for k in range(-2, 3))
    assert math.isnan(got["part", 0]) and math.isnan(got["part", 1]) and got["part", 2] is None and abs(got["part", -1]) == pytest.approx(1)
