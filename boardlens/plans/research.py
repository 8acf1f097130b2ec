"""Queries on statistics, back-tests and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.operators import calendar, frames, models, panel, portfolio, stats, strategies
from boardlens.plans.market import DENSE, MARKET, RETS, cal, dense, model, rets
from boardlens.plans.registry import Registry, rounded
from boardlens.session import cut, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

_WIN = "win as (select distinct code, date, pre_abn, ptt_base from windows)"
_J = f"{RETS}, {_WIN}, j as (select r.code, r.date, r.ret, r.volume, w.pre_abn, w.ptt_base, lead(r.ret) over (partition by r.code order by r.date) as ret_next from (select code, date, max(ret) as ret, max(volume) as volume from rets group by all) r left join win w on w.code = r.code and w.date = r.date)"


def joined(spark: SparkSession, d: str) -> DataFrame:
    """Per code and day the return, the next one and the windows' figures."""
    r = rets(spark, d).groupBy("code", "date").agg(F.max("ret").alias("ret"), F.max("volume").alias("volume"))
    w = table(spark, d, "windows").select("code", "date", "pre_abn", "ptt_base").distinct()
    return r.join(w, ["code", "date"], "left").withColumn("ret_next", F.lead("ret").over(frames.ordered(["code"], "date")))


@R.add(f"""with {_J}, c as (select code, pre_abn as x, ret_next as y from j where pre_abn is not null and ret_next is not null),
r as (select *, rank() over (partition by code order by x) + (count(*) over (partition by code, x) - 1) / 2.0 as rx, rank() over (partition by code order by y) + (count(*) over (partition by code, y) - 1) / 2.0 as ry from c)
select code, count(*) as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r group by code""")
def correlations(spark, d):
    return rounded(stats.correlations(joined(spark, d), "pre_abn", "ret_next", ["code"]))


@R.add(f"""with {_J}, l as (select code, pre_abn as x, {', '.join(f'lead(ret, {k}) over w as y{k + 5}' if k >= 0 else f'lag(ret, {-k}) over w as y{k + 5}' for k in range(-5, 6))} from j window w as (partition by code order by date)),
u as (select code, x, unnest([{', '.join(f'y{k}' for k in range(11))}]) as y, unnest(range(-5, 6)) as lag from l)
select code, cast(lag as int) as lag, round(corr(x, y), 6) as r from u group by code, lag""")
def cross_correlation(spark, d):
    return rounded(stats.cross_correlation(joined(spark, d), "pre_abn", "ret", "date", ["code"]))


@R.add(f"""with {RETS}, x as (select code, market, date, ret, avg(ret) over (partition by code, market) as m from rets where ret is not null),
u as (select code, market, m, ret - m as u, {', '.join(f'lag(ret - m, {k}) over w as u{k}' for k in range(1, 6))} from x window w as (partition by code, market order by date))
select code, market, count(*) as n, round(max(m), 7) as mean, round(sqrt(greatest(sum(u * u) + {' + '.join(f'2 * (1 - {k} / 6.0) * coalesce(sum(u * u{k}), 0)' for k in range(1, 6))}, 0)) / count(*), 7) as se, round(case when sum(u * u) > 0 then max(m) / (sqrt(greatest(sum(u * u) + {' + '.join(f'2 * (1 - {k} / 6.0) * coalesce(sum(u * u{k}), 0)' for k in range(1, 6))}, 0)) / count(*)) end, 4) as t from u group by code, market""")
def hac_means(spark, d):
    h = stats.hac_mean(rets(spark, d), "ret", "date", ["code", "market"], 5)
    return h.select("code", "market", "n", *[(F.round(c, k) + 0.0).alias(c) for c, k in (("mean", 7), ("se", 7), ("t", 4))])


_LABELS = "lab as (select code, date, case when pre_abn > 0 then 'up' when pre_abn <= 0 then 'down' end as a, case when ret_next > 0 then 'up' when ret_next <= 0 then 'down' end as b from j)"


@R.add(f"""with {_J}, {_LABELS}, ok as (select * from lab where a is not null and b is not null), t as (select code, count(*) as n, avg(case when a = b then 1.0 else 0.0 end) as po from ok group by code),
pa as (select code, a as l, count(*) as na from ok group by all), pb as (select code, b as l, count(*) as nb from ok group by all), pe as (select pa.code, sum(na * nb) as c from pa join pb on pa.code = pb.code and pa.l = pb.l group by pa.code)
select t.code, n, round(case when coalesce(c, 0) / (n * n) < 1 then (po - coalesce(c, 0) / (n * n)) / (1 - coalesce(c, 0) / (n * n)) end, 6) as kappa from t left join pe using (code)""")
def kappa(spark, d):
    label = lambda c: F.when(F.col(c) > 0, "up").when(F.col(c) <= 0, "down")
    return rounded(stats.kappa(joined(spark, d).select("code", label("pre_abn").alias("a"), label("ret_next").alias("b")), "a", "b", ["code"]))


@R.add(f"""with {_J}, p as (select code, case when ret_next > 0 then 1 when ret_next <= 0 then 0 end as y, 1 / (1 + exp(-pre_abn)) as s from j), ok as (select * from p where y is not null and s is not null),
r as (select *, rank() over (partition by code order by s) + (count(*) over (partition by code, s) - 1) / 2.0 as rk from ok)
select code, count(*) as n, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 6) as auc, round(avg((s - y) ** 2), 6) as brier, round(avg(case when cast(s > 0.5 as int) = y then 1.0 else 0.0 end), 6) as accuracy from r group by code""")
def auc(spark, d):
    j = joined(spark, d).select("code", F.when(F.col("ret_next") > 0, 1).when(F.col("ret_next") <= 0, 0).alias("y"), (1 / (1 + F.exp(-F.col("pre_abn")))).alias("s"))
    return rounded(stats.auc(j, "y", "s", ["code"]))


@R.add(f"""with {_J}, h as (select code, ret_next as y, ret as p, case when count(ret) over e >= 20 then avg(ret) over e end as b from j window e as (partition by code order by date rows between unbounded preceding and 1 preceding)), ok as (select * from h where y is not null and p is not null and b is not null)
select code, count(*) as n, round(avg((y - p) ** 2), 8) as mse, round(1 - sum((y - p) ** 2) / sum((y - b) ** 2), 6) as r2, round(1 - sum((y - p) ** 2) / sum(y ** 2), 6) as r2_zero, round(corr(y, p), 6) as ic,
 round(avg(case when y <> 0 then case when sign(y) = sign(p) then 1.0 else 0.0 end end), 6) as sign_acc, round(avg((y - b) ** 2 - ((y - p) ** 2 - (b - p) ** 2)), 8) as cw from ok group by code""")
def regression_metrics(spark, d):
    w = frames.ordered(["code"], "date")
    h = joined(spark, d).select("code", F.col("ret_next").alias("y"), F.col("ret").alias("p"), frames.expanding(F.avg, F.col("ret"), w, 20).alias("b"))
    m = stats.regression_metrics(h, "y", "p", "b", ["code"])
    cw = h.dropna().groupBy("code").agg(F.avg(stats.clark_west(F.col("y"), F.col("b"), F.col("p"))).alias("cw"))
    j = m.join(cw, "code")
    return j.select("code", "n", F.round("mse", 8).alias("mse"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("r2", "r2_zero", "ic", "sign_acc")], (F.round("cw", 8) + 0.0).alias("cw"))


_P = "ps as (select o_orderpriority as grp, o_orderstatus as h, round(avg(o_totalprice) / 1000000, 9) as p from orders group by all)"


@R.add(f"""with {_P}, r as (select *, row_number() over (partition by grp order by p, h) as k, count(*) over (partition by grp) as m from ps), o as (select *, p <= 0.25 / (m - k + 1) as ok, p * m / k as x from r)
select grp, h, p, bool_and(ok) over (partition by grp order by k rows unbounded preceding) as holm, round(least(min(x) over (partition by grp order by k desc rows unbounded preceding), 1.0), 9) as p_bh from o""")
def multiple_tests(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("h")).agg(F.round(F.avg("o_totalprice") / 1_000_000, 9).alias("p"))
    return rounded(stats.benjamini_hochberg(stats.holm(p, "p", 0.25, ["grp"]).select("grp", "h", "p", "holm"), "p", ["grp"]), 9)


_BT = f"""{_J}, s as (select code, date, ret_next, cast(case when pre_abn > 0.3 then 1.0 when pre_abn < -0.3 then -1.0 else 0.0 end as double) as p from j where ptt_base is not null),
b as (select *, coalesce(lag(p) over (partition by code order by date), 0) as q from s),
c as (select *, abs(p - q) as traded, greatest(p - q, 0) * 0.001425 + greatest(q - p, 0) * 0.004425 + greatest(greatest(-p, 0) - greatest(-q, 0), 0) * 0.0008 as cost, p * (exp(ret_next) - 1) as gross from b),
d as (select *, gross - cost as net from c), e as (select *, product(1 + net) over (partition by code order by date) as equity from d)"""


def _single(spark: SparkSession, d: str) -> DataFrame:
    j = joined(spark, d).filter("ptt_base is not null").withColumn("p", F.when(F.col("pre_abn") > 0.3, 1.0).when(F.col("pre_abn") < -0.3, -1.0).otherwise(0.0))
    return portfolio.backtest(j, ["code"], "date", "ret_next", "p", 0.001425, 0.004425, short_fee=0.0008)


@R.add(f"with {_BT} select code, cast(date as varchar) as date, p as position, round(cost, 8) as cost, round(net, 6) as net, round(equity, 6) as equity from e")
def backtest(spark, d):
    b = _single(spark, d)
    return b.select("code", F.col("date").cast("string").alias("date"), "position", (F.round("cost", 8) + 0.0).alias("cost"), (F.round("net", 6) + 0.0).alias("net"), F.round("equity", 6).alias("equity"))


@R.add(f"""with {_BT}, m as (select *, equity / max(equity) over (partition by code order by date) - 1 as dd from e), g as (select *, max_by(equity, date) filter (where equity is not null) over (partition by code) as last, count(net) over (partition by code) as k from m)
select code, count(net) as n, round(max(last) - 1, 6) as total, round(case when max(last) > 0 then pow(max(last), 252.0 / nullif(max(k), 0)) - 1 end, 6) as cagr, round(stddev_samp(net) * sqrt(252), 6) as vol, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 6) as sharpe, round(min(dd), 6) as max_dd, round(avg(abs(p)), 6) as exposure, round(sum(traded), 6) as turnover, round(sum(cost), 6) as cost from g group by code""")
def backtest_summary(spark, d):
    s = portfolio.summary(_single(spark, d), ["code"], "date")
    return rounded(s.select("code", "n", "total", "cagr", "vol", "sharpe", "max_dd", "exposure", "turnover", "cost"))


@R.add(f"with {_BT} select code, round(avg(case when p > 0 then 1.0 else 0.0 end), 6) as long, round(avg(case when p < 0 then 1.0 else 0.0 end), 6) as short, round(sum(gross), 6) as gross, round(sum(traded), 6) as turnover, round(sum(gross) / nullif(sum(traded), 0), 6) as breakeven, round(sum(cost) / nullif(sum(traded), 0), 6) as avg_cost from e group by code")
def trade_stats(spark, d):
    return rounded(portfolio.trade_stats(_single(spark, d), ["code"]))


@R.add(f"""with {RETS}, b as (select code, market, date, case when count(ret) over v = 60 then stddev_samp(ret) over v * sqrt(252) end as sigma, exp(sum(coalesce(ret, 0)) over (partition by code, market order by date rows unbounded preceding)) as level,
 row_number() over w as k, date_trunc('month', date) is distinct from date_trunc('month', lag(date) over w) as monthly from rets window w as (partition by code, market order by date), v as (partition by code, market order by date rows between 59 preceding and current row))
select code, market, cast(date as varchar) as date, monthly, round(coalesce(least(greatest(0.2754 / nullif(sigma, 0), 1.0), 2.0), 1.0), 6) as leverage, case when count(*) over a = 200 then level > avg(level) over a end as trend from b window a as (partition by code, market order by date rows between 199 preceding and current row)""")
def strategy_signals(spark, d):
    w = frames.ordered(["code", "market"], "date")
    b = rets(spark, d).withColumn("level", portfolio.level(F.col("ret"), w))
    monthly = ~F.trunc("date", "MM").eqNullSafe(F.trunc(F.lag("date").over(w), "MM"))
    return b.select("code", "market", F.col("date").cast("string").alias("date"), monthly.alias("monthly"), F.round(portfolio.volatility_target(F.col("ret"), w, 0.2754), 6).alias("leverage"), portfolio.above_average(F.col("level"), w).alias("trend"))


@R.add(f"""with {DENSE}, me as (select date, pos from (select *, lead(date) over (order by date) as nx from cal) where date_trunc('month', nx) <> date_trunc('month', date)),
mom as (select code, pos, case when count(ret) over b = 20 then sum(ret) over b end as m from dense window b as (partition by code order by pos rows between 19 preceding and current row)),
pk as (select pos, code from (select mom.pos, code, row_number() over (partition by mom.pos order by round(m, 9) desc, code) as k from mom join me on me.pos = mom.pos where m is not null) where k <= 5),
per as (select pos as a, lead(pos) over (order by pos) as b, row_number() over (order by pos) as period from (select distinct pos from pk)),
days as (select distinct d.date, d.pos, period from dense d join per on d.pos > a and (b is null or d.pos <= b)),
n as (select period, count(*) as n from pk join per on pk.pos = per.a group by period),
held as (select y.date, y.pos, y.period, k.code, exp(sum(coalesce(d.ret, 0)) over (partition by y.period, k.code order by y.pos)) / n.n as v from days y join per using (period) join pk k on k.pos = per.a join n using (period) left join dense d on d.code = k.code and d.pos = y.pos),
tot as (select period, pos, date, sum(v) as total from held group by all),
g as (select *, total / coalesce(lag(total) over (partition by period order by pos), 1) - 1 as gross, row_number() over (partition by period order by pos) = 1 as first from tot),
left_over as (select h.period + 1 as period, h.code, h.v / t.total as old from held h join tot t on t.period = h.period and t.pos = h.pos where h.pos = (select max(pos) from tot x where x.period = h.period)),
goal as (select per.period, pk.code, 1.0 / n.n as new from pk join per on pk.pos = per.a join n on n.period = per.period),
moved as (select coalesce(g.period, e.period) as period, coalesce(new, 0) - coalesce(old, 0) as c from goal g full join left_over e on e.period = g.period and e.code = g.code),
paid as (select period, sum(greatest(c, 0)) * 0.001425 + sum(greatest(-c, 0)) * 0.004425 as cost from moved group by period)
select g.period, cast(date as varchar) as date, round(gross, 6) as gross, round(case when first then cost else 0 end, 6) as cost, round((1 - case when first then cost else 0 end) * (1 + gross) - 1, 6) as net, n.n from g join paid using (period) join n using (period)""")
def periodic_portfolio(spark, d):
    g = dense(spark, d)
    w = frames.ordered(["code"], "pos")
    m = g.select("code", "pos", frames.rolling(F.sum, F.col("ret"), w, 20).alias("m")).filter("m is not null")
    ends = calendar.period_flags(cal(spark, d)).filter("month_end").select("pos")
    picks = frames.top_n(m.join(F.broadcast(ends), "pos", "left_semi"), ["pos"], [F.round("m", 9).desc(), F.col("code")], 5).select("pos", "code")
    periods = picks.select("pos").distinct().selectExpr("pos", "row_number() over (order by pos) as period")
    p = portfolio.periodic_portfolio(g.select("date", "pos", "code", "ret"), picks.join(F.broadcast(periods), "pos").select(F.col("period").cast("bigint").alias("period"), "pos", "code"), 0.001425, 0.004425)
    return rounded(p.withColumn("date", F.col("date").cast("string")))


@R.add(f"""with {_BT}, l as (select *, sum(ln(1 + net)) over (partition by code order by date rows unbounded preceding) as le from e where net is not null and ret_next is not null),
x as (select *, exp(le - max(le) over (partition by code order by date rows unbounded preceding)) - 1 as dd, case when count(*) over y = 246 then exp(sum(ln(1 + net)) over y) - 1 end as yr, case when count(*) over z = 492 then sum(ln(1 + net) - ret_next) over z end as ahead
  from l window y as (partition by code order by date rows between 245 preceding and current row), z as (partition by code order by date rows between 491 preceding and current row))
select code, round(exp(sum(ln(1 + net)) * 365.25 / nullif(max(date) - min(date), 0)) - 1, 6) as cagr, round(avg(case when ahead > 0 then 1.0 when ahead <= 0 then 0.0 end), 6) as win_rate, round(stddev_samp(ln(1 + net)) * sqrt(252), 6) as vol, round(min(dd), 6) as max_dd, round(min(yr), 6) as worst_year from x group by code""")
def evaluate(spark, d):
    b = _single(spark, d).filter("net is not null and ret_next is not null").withColumn("bench", F.expm1("ret_next"))
    return rounded(portfolio.evaluate(b, ["code"], "date", "net", "bench", ahead=2).select("code", "cagr", "win_rate", "vol", "max_dd", "worst_year"))


@R.add()
def weights_fold(spark, d):
    """Three codes' weights with a band, drifting between trades; one strategy per market."""
    p = rets(spark, d).filter("ret is not null")
    three = frames.top_n(p.groupBy("market", "code").agg(F.count("*").alias("n")), ["market"], [F.col("n").desc(), F.col("code")], 3, "k")
    q = p.join(F.broadcast(three.select("market", "code", "k")), ["market", "code"])
    wide = q.groupBy("market", "date").pivot("k", [1, 2, 3]).agg(F.max("ret")).withColumnsRenamed({str(k): f"r_a{k}" for k in (1, 2, 3)})
    first = F.trunc("date", "MM") != F.trunc(F.lag("date").over(frames.ordered(["market"], "date")), "MM")
    w = wide.withColumn("__first", F.coalesce(first, F.lit(True))).select("*", *[F.when(F.col("__first"), 1 / 3).alias(f"t_a{k}") for k in (1, 2, 3)], *[F.col(f"r_a{k}").isNotNull().alias(f"o_a{k}") for k in (1, 2, 3)])
    return portfolio.weights_backtest(w, ["market"], "date", ["a1", "a2", "a3"], 0.001425, 0.004425, 0.05)


@R.add()
def walk_forward(spark, d):
    """Per code, tomorrow's direction from today's figures by expanding refits."""
    j = joined(spark, d).withColumn("up", F.when(F.col("ret_next") > 0, 1.0).when(F.col("ret_next") < 0, 0.0))
    return models.walk_forward(j, ["code"], "date", ["ret", "pre_abn", "ptt_base"], "up", "logit")


@R.add()
def large_move_regression(spark, d):
    """Forward abnormal returns on the size of the move and its direction, within codes and months, errors clustered by code and date."""
    m = model(spark, d)
    w = frames.ordered(["code"], "pos")
    e = m.withColumn("fwd", frames.forward_sum(F.col("ar"), w, 5)).filter("event and fwd is not null").withColumn("month", F.trunc("date", "MM")).withColumn("size", F.abs("z")).withColumn("upward", F.col("up").cast("double"))
    fit = stats.fe_ols(e, "fwd", ["size", "upward"], ["month"], ["code", "date"])
    return spark.createDataFrame([(n, float(b), float(s), fit.n) for n, b, s in zip(fit.names, fit.beta, fit.se, strict=True)], "name string, coef double, se double, n bigint")




_GRID = f"""{_J}, v as (select code, date, ret_next, ptt_base, pre_abn from j where ptt_base is not null),
g as (select code, date, ret_next, 'follow' as strategy, cast(case when pre_abn > 0 then 1 when pre_abn < 0 then -1 else 0 end as double) as p from v union all select code, date, ret_next, 'contrary', cast(case when pre_abn > 0 then -1 when pre_abn < 0 then 1 else 0 end as double) from v union all select code, date, ret_next, 'hold', cast(1 as double) from v),
gn as (select code, strategy, date, p * (exp(ret_next) - 1) as net from g where ret_next is not null)"""


_SIGNAL = f"""{MARKET}, sig as (select date, mkt_ret as ret from mkt where market = 'TWSE'), lv as (select *, exp(sum(coalesce(ret, 0)) over (order by date)) as level, date_trunc('month', date) is distinct from date_trunc('month', lag(date) over (order by date)) as monthly, lead(date) over (order by date) as nx, row_number() over (order by date) as rn from sig),
g as (select *, coalesce(nx is not null and date_trunc('week', date) <> date_trunc('week', nx), false) or rn = 1 as weekly, coalesce(case when count(ret) over a = 200 then level > avg(level) over a end, false) as up,
 coalesce(least(greatest(0.2754 / nullif(case when count(ret) over v = 60 then stddev_samp(ret) over v end * sqrt(252), 0), 1.0), 2.0), 1.0) as lev from lv window a as (order by date rows between 199 preceding and current row), v as (order by date rows between 59 preceding and current row)),
rules as (select date, 'C0' as strategy, 1.0 as x, true as keep from g union all select date, 'C1', 1.5, monthly from g union all select date, 'C2', lev, weekly from g union all select date, 'C3', case when up then 2.0 else 1.0 end, true from g)"""


def leverage_days(spark: SparkSession, d: str) -> DataFrame:
    """The market's days with its return, twice that as a two-fold asset's, and the signals of all rules."""
    r = rets(spark, d)
    m = panel.market_returns(r).filter("market = 'TWSE'").select("date", F.col("mkt_ret").alias("ret"))
    return strategies.signals(cut(m), "ret", 0.1836, (20, 60, 120), (100, 150, 200, 250), (1.25, 1.5, 1.75))


@R.add(f"with {_SIGNAL} select strategy, cast(date as varchar) as date, round(cast(case when keep then 2 - x end as double), 6) as t_x1, round(cast(case when keep then x - 1 end as double), 6) as t_x2 from rules")
def leverage_targets(spark, d):
    t = strategies.targets(leverage_days(spark, d), strategies.registered(), ["x1", "x2"])
    return rounded(t.select("strategy", F.col("date").cast("string").alias("date"), "t_x1", "t_x2"))


@R.add(f"""with recursive {_SIGNAL}, asked as (select strategy, date, lead(ret) over (partition by strategy order by date) as nr, case when keep then 2 - x end as t1, case when keep then x - 1 end as t2, case when strategy = 'C2' then 0.1 else 0 end as band, row_number() over (partition by strategy order by date) as n from rules join sig using (date)),
ready as (select *, exp(coalesce(nr, 0)) - 1 as r1, exp(ln(1 + 2 * (exp(coalesce(nr, 0)) - 1))) - 1 as r2 from asked),
book as (select strategy, n, date, cast(t1 as double) as w1, cast(t2 as double) as w2, cast((abs(t1) + abs(t2)) * 0.001 as double) as cost, cast(t1 * r1 + t2 * r2 as double) as gross, cast(t1 * (1 + r1) / (1 + t1 * r1 + t2 * r2) as double) as h1, cast(t2 * (1 + r2) / (1 + t1 * r1 + t2 * r2) as double) as h2 from ready where n = 1
 union all select r.strategy, r.n, r.date, k.w1, k.w2, k.cost, k.w1 * r1 + k.w2 * r2, k.w1 * (1 + r1) / (1 + k.w1 * r1 + k.w2 * r2), k.w2 * (1 + r2) / (1 + k.w1 * r1 + k.w2 * r2)
  from book b join ready r on r.strategy = b.strategy and r.n = b.n + 1, lateral (select t1 is not null and greatest(abs(t1 - h1), abs(t2 - h2)) > band + 1e-12 as trade) y,
  lateral (select case when trade then cast(t1 as double) else h1 end as w1, case when trade then cast(t2 as double) else h2 end as w2, case when trade then (greatest(t1 - h1, 0) + greatest(t2 - h2, 0)) * 0.001 + (greatest(h1 - t1, 0) + greatest(h2 - t2, 0)) * 0.002 else 0 end as cost) k)
select strategy, cast(date as varchar) as date, round(w1, 6) as w_x1, round(w2, 6) as w_x2, round(cost, 8) as cost, round((1 - cost) * (1 + gross) - 1, 6) as net from book""")
def leverage_books(spark, d):
    """The registered strategies traded: weights that drift, bands, costs and net returns, day by day."""
    days = leverage_days(spark, d)
    nxt = F.lead("ret").over(frames.ordered([], "date"))
    days = days.withColumns({"r_x1": nxt, "r_x2": F.log1p(2 * F.expm1(nxt))})
    t = cut(strategies.targets(days, strategies.registered(), ["x1", "x2"], ["r_x1", "r_x2"]))
    books = [portfolio.weights_backtest(t.filter(F.col("band") == b), ["strategy"], "date", ["x1", "x2"], 0.001, 0.002, b) for b in (0.0, strategies.BAND)]
    out = books[0].unionByName(books[1])
    return out.select("strategy", F.col("date").cast("string").alias("date"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("w_x1", "w_x2")], (F.round("cost", 8) + 0.0).alias("cost"), (F.round("net", 6) + 0.0).alias("net"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    v = joined(spark, d).filter("ptt_base is not null")
    follow = F.coalesce(F.signum("pre_abn"), F.lit(0.0))
    g = portfolio.with_strategies(v.select("code", "date", "ret_next", "pre_abn"), {"follow": follow, "contrary": -follow, "hold": F.lit(1.0)})
    return portfolio.backtest(g, ["code", "strategy"], "date", "ret_next", "position", 0.0, 0.0)


@R.add(f"with {_GRID} select strategy, count(net) as n, round(avg(net), 7) as mean, round(stddev_samp(net), 7) as sd from gn group by strategy")
def strategy_grid(spark, d):
    return rounded(_grid(spark, d).groupBy("strategy").agg(F.count("net").alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("sd")), 7)


@R.add(f"""with {_GRID}, day as (select strategy, date, round(avg(net), 9) as net from gn group by all),
lv as (select *, sum(ln(1 + net)) over (partition by strategy order by date) as e from day), dd as (select *, e - greatest(max(e) over (partition by strategy order by date), 0) as dd from lv),
ends as (select strategy, cast(year(date) as int) as y, max_by(e, date) as total, min(dd) as m from dd group by all),
past as (select strategy, y + 1 as year, total, min(m) over (partition by strategy order by y) as dd from ends), ok as (select p.* from past p join past r on r.year = p.year and r.strategy = 'hold' where p.dd >= r.dd and p.year >= 2023)
select year, max_by(strategy, (total, strategy)) as strategy from ok group by year""")
def yearly_choice(spark, d):
    day = _grid(spark, d).filter("net is not null").groupBy("strategy", "date").agg(F.round(F.avg("net"), 9).alias("net"))
    return portfolio.yearly_choice(day, "hold", 2023)
