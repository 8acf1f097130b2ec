"""Queries on the panel, the windows and the board's texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.operators import calendar, events, frames, joins, panel, sentiment
from boardlens.plans.registry import Registry, rounded
from boardlens.session import cut, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

CAL = "cal as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from panel))"
UNIQ = "uniq as (select uid, any_value(kind) as kind, any_value(code) as code, any_value(time) as time, any_value(account) as account, any_value(tag) as tag, any_value(score) as score from texts group by uid)"
SHIFTED = "case when cast(time as time) >= time '13:30:00' then cast(cast(time as date) + 1 as date) else cast(time as date) end"
ALIGNED = f"{CAL}, {UNIQ}, shifted as (select *, {SHIFTED} as d from uniq), aligned as (select s.*, c.date as trade_date, c.pos from shifted s asof left join cal c on c.date >= s.d)"
TRADED = "traded as (select code, market, date, max(name) as name, max(open) as open, max(high) as high, max(low) as low, max(close) as close, max(volume) as volume, max(value) as value from panel where close > 0 and volume > 0 group by code, market, date)"
RETS = f"""{TRADED}, based as (select *, lag(close) over (partition by code, market order by date) as base from traded),
raw as (select *, case when base > 0 then ln(close / base) end as r from based),
rets as (select code, market, date, name, open, high, low, close, volume, value, base,
  case when not coalesce(abs(exp(r) - 1) > 0.105, false) then r end as ret, case when open > 0 then ln(close / open) end as oc,
  case when base > 0 and open > 0 and not coalesce(abs(exp(r) - 1) > 0.105, false) then ln(open / base) end as gap,
  market = 'TWSE' and coalesce(open >= base * 1.095, false) as limit_up_open, market = 'TWSE' and coalesce(close >= base * 1.095, false) as limit_up_close,
  coalesce(open <= base * 0.905, false) as limit_down_open, coalesce(close <= base * 0.905, false) as limit_down_close from raw)"""
MARKET = f"""{RETS}, weighed as (select *, lag(value) over (partition by code, market order by date) as w from rets),
mkt as (select date, market, ln(1 + sum(w * (exp(ret) - 1)) / sum(w)) as mkt_ret, count(*) as n from weighed where ret is not null and w > 0 group by date, market)"""
DENSE = f"""{CAL}, {MARKET}, one as (select code, date, max(ret) as ret, min(market) as market from rets group by code, date),
ends as (select code, min(pos) as a, max(pos) as b from one join cal using (date) group by code),
grid as (select e.code, c.date, c.pos from ends e join cal c on c.pos between e.a and e.b),
filled as (select g.code, g.date, g.pos, case when o.code is not null then o.ret else 0.0 end as ret, o.market as m, o.code is not null as traded from grid g left join one o on o.code = g.code and o.date = g.date),
dense as (select code, date, pos, ret, coalesce(last_value(m ignore nulls) over (partition by code order by pos rows between unbounded preceding and current row), first_value(m ignore nulls) over (partition by code order by pos rows between current row and unbounded following)) as market, traded from filled)"""
MODEL = f"""{CAL}, {MARKET}, placed as (select r.*, k.mkt_ret, c.pos, lag(r.date) over (partition by r.code order by r.date, r.market) as before from rets r left join mkt k on k.date = r.date and k.market = r.market join cal c on c.date = r.date),
px as (select * exclude (before) from placed where before is distinct from date),
beta as (select *, case when count(case when ret is not null and mkt_ret is not null then 1 end) over b >= 120 then regr_slope(ret, mkt_ret) over b end as beta,
  coalesce(abs(base / lag(close) over w - 1) > 1e-6, false) as adj, coalesce(pos - lag(pos) over w > 5, false) as halt from px
  window b as (partition by code order by pos rows between 250 preceding and 1 preceding), w as (partition by code order by pos)),
ars as (select *, ret - beta * mkt_ret as ar from beta),
model as (select *, case when count(ar) over s >= 40 then stddev_samp(ar) over s end as sigma from ars window s as (partition by code order by pos rows between 60 preceding and 1 preceding)),
flagged as (select *, ar / nullif(sigma, 0) as z, coalesce(ar > 0, false) as up, limit_up_close or limit_down_close as locked, exists(select 1 from twse_punish t where t.code = model.code and model.date between t.start and t."end") as disp from model),
able as (select *, ar is not null and z is not null and not adj and not halt and not disp as eligible from flagged),
evented as (select *, eligible and coalesce(abs(z) >= 3 and abs(ar) >= 0.03, false) as event from able)"""
SPREAD = f"""{DENSE}, valued as (select d.*, k.mkt_ret, d.ret - k.mkt_ret as x, t.value from dense d left join mkt k on k.date = d.date and k.market = d.market left join (select code, date, max(value) as value from traded group by all) t on t.code = d.code and t.date = d.date)"""


def cal(spark: SparkSession, d: str) -> DataFrame:
    return calendar.trading_days(table(spark, d, "panel"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Each text once; repeated rows of a uid are equal in all but their arrival, so that a hash aggregation of keys alone does it."""
    return table(spark, d, "texts").select("uid", "kind", "code", "time", "account", "tag", "score").distinct()


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return calendar.assign_trade_date(texts(spark, d), "time", cal(spark, d))


def rets(spark: SparkSession, d: str) -> DataFrame:
    return panel.returns(panel.traded(table(spark, d, "panel")))


def dense(spark: SparkSession, d: str) -> DataFrame:
    p = cut(rets(spark, d).select("code", "market", "date", "ret", "value"))
    grid = panel.dense_returns(p, cal(spark, d))
    return panel.with_market(grid, panel.market_returns(p))


def stock_rows(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """A row per code and traded day, with its market's return and the day's position, whole: with high and low too; of a day with rows in two markets the first."""
    r = rets(spark, d)
    r = cut(r if whole else r.drop("high", "low"))
    p = panel.with_market(r, panel.market_returns(r)).join(F.broadcast(cal(spark, d)), "date")
    before = F.lag("date").over(frames.ordered(["code"], ["date", "market"]))
    return p.withColumn("__before", before).filter("not date <=> __before").drop("__before")


def model(spark: SparkSession, d: str) -> DataFrame:
    """The market model's rows with their flags: restrictions, halts and changes of base bar a day."""
    m = events.day_flags(events.market_model(stock_rows(spark, d)))
    m = joins.in_intervals(m, table(spark, d, "twse_punish"), ["code"], "date", "start", "end", "disp")
    m = m.withColumn("locked", F.col("limit_up_close") | F.col("limit_down_close"))
    return events.flag_events(m, barred=F.col("adj") | F.col("halt") | F.col("disp"))


def valued(spark: SparkSession, d: str) -> DataFrame:
    """The dense grid with each day's value traded."""
    value = panel.traded(table(spark, d, "panel")).groupBy("code", "date").agg(F.max("value").alias("value"))
    return dense(spark, d).join(value, ["code", "date"], "left")


@R.add(f"with {ALIGNED} select uid, cast(trade_date as varchar) as trade_date, coalesce(pos, -1) as pos from aligned")
def assign_trade_date(spark, d):
    return aligned(spark, d).select("uid", F.col("trade_date").cast("string").alias("trade_date"), F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"))


_DAILY = """per_day as (select trade_date, count(case when kind = 'article' then 1 end) as n_articles, count(case when kind = 'comment' then 1 end) as n_comments, count(distinct account) as n_accounts,
  count(case when tag = 'push' then 1 end) / nullif(count(case when tag in ('push', 'boo') then 1 end), 0) as push_ratio from aligned where trade_date is not null {0} group by trade_date),
acct as (select trade_date, account, round(avg(score), 12) as m from aligned where trade_date is not null and account is not null and score is not null {0} group by all),
polar as (select trade_date, avg(m) as sent_mean, avg(case when m > 0 then 1.0 else 0.0 end) as bull_ratio, stddev_pop(m) as sent_std, count(*) as n_polar from acct group by trade_date)"""


@R.add(f"""with {ALIGNED}, {_DAILY.format('')}
select cast(c.date as varchar) as trade_date, coalesce(n_articles, 0) as n_articles, coalesce(n_comments, 0) as n_comments, coalesce(n_accounts, 0) as n_accounts, coalesce(n_polar, 0) as n_polar,
  round(push_ratio, 10) as push_ratio, round(sent_mean, 10) as sent_mean, round(bull_ratio, 10) as bull_ratio, round(sent_std, 10) as sent_std
from cal c left join per_day p on p.trade_date = c.date left join polar q on q.trade_date = c.date""")
def daily_sentiment(spark, d):
    out = sentiment.daily_sentiment(aligned(spark, d), cal(spark, d))
    return rounded(out.withColumn("trade_date", F.col("trade_date").cast("string")), 10)


@R.add(f"""with {ALIGNED}, acct as (select code, pos, account, round(avg(score), 12) as m from aligned where pos is not null and account is not null and score is not null group by all)
select code, pos, round(case when count(*) >= 3 then avg(m) end, 10) as sent, count(*) as n_polar from acct group by code, pos""")
def code_sentiment(spark, d):
    s = sentiment.sentiment(aligned(spark, d).filter("pos is not null"), ["code", "pos"], 3)
    return rounded(s.select("code", F.col("pos").cast("bigint").alias("pos"), F.col("sent_mean").alias("sent"), "n_polar"), 10)


_PRE = "(cast(time as date) < trade_date or (cast(time as date) = trade_date and cast(time as time) < time '{0}'))"


@R.add(f"""with {ALIGNED}, n as (select pos, count(*) as n from aligned where pos is not null and {_PRE.format('09:00:00')} group by pos)
select cast(date as varchar) as date, case when lag(date) over (order by date) >= date '2022-02-01' then coalesce(n, 0) end as n from cal left join n using (pos)""")
def preopen_counts(spark, d):
    return calendar.preopen_counts(texts(spark, d), "time", cal(spark, d), start="2022-02-01").select(F.col("date").cast("string").alias("date"), "n")


@R.add(f"with {ALIGNED} select code, pos, count(case when {_PRE.format('09:00:00')} then 1 end) as n_pre, count(case when not {_PRE.format('09:00:00')} then 1 end) as n_intra from aligned where pos is not null group by code, pos")
def daily_counts(spark, d):
    parts = calendar.day_parts(texts(spark, d), "time", cal(spark, d))
    return parts.groupBy("code", F.col("pos").cast("bigint").alias("pos")).agg(F.count_if("pre").alias("n_pre"), F.count_if(~F.col("pre")).alias("n_intra"))


@R.add(f"with {ALIGNED} select code, pos, count(case when {_PRE.format('08:30:00')} then 1 end) as early, count(case when not {_PRE.format('08:30:00')} then 1 end) as late from aligned where pos is not null and {_PRE.format('09:00:00')} group by code, pos")
def preopen_split(spark, d):
    parts = calendar.day_parts(texts(spark, d), "time", cal(spark, d)).filter("pre")
    early = calendar.before_clock(F.col("time"), F.col("trade_date"), "08:30")
    return parts.groupBy("code", F.col("pos").cast("bigint").alias("pos")).agg(F.count_if(early).alias("early"), F.count_if(~early).alias("late"))


@R.add(f"""with {CAL}, n as (select *, lead(date) over (order by date) as nxt, lag(date) over (order by date) as prv from cal),
months as (select distinct date_trunc('month', date) as m from cal), third as (select cast(m + to_days(cast((10 - isodow(m)) % 7 as int) + 14) as date) as w3 from months),
settle as (select min(c.date) as date from third t join cal c on c.date >= t.w3 group by t.w3 having min(c.date) - t.w3 < 7)
select cast(date as varchar) as date, pos, coalesce(date_trunc('month', nxt) <> date_trunc('month', date), false) as month_end, coalesce(date_trunc('week', nxt) <> date_trunc('week', date), false) as week_end,
 coalesce(date_trunc('month', prv) <> date_trunc('month', date), true) as new_month, round(ln(date - prv), 6) as log_gap, cast(isodow(date) - 1 as int) as dow, date in (select date from settle) as settle, month(date) % 3 = 2 and (nxt is null or date_trunc('month', nxt) <> date_trunc('month', date)) as review from n""")
def calendar_flags(spark, d):
    f = calendar.period_flags(cal(spark, d))
    return rounded(f.withColumn("date", F.col("date").cast("string")).withColumn("pos", F.col("pos").cast("bigint")))


@R.add("select code, name, cast(min(date) as varchar) as first, cast(max(date) as varchar) as last from panel where code is not null and name is not null group by code, name")
def listed_names(spark, d):
    n = panel.listed_names(table(spark, d, "panel"))
    return n.select("code", "name", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@R.add(f"with {RETS} select code, market, cast(date as varchar) as date, round(base, 6) as base, round(ret, 6) as ret, round(oc, 6) as oc, round(gap, 6) as gap, limit_up_open, limit_up_close, limit_down_open, limit_down_close from rets")
def panel_returns(spark, d):
    p = rets(spark, d).select("code", "market", F.col("date").cast("string").alias("date"), "base", "ret", "oc", "gap", "limit_up_open", "limit_up_close", "limit_down_open", "limit_down_close")
    return rounded(p)


@R.add("select distinct code, name, regexp_full_match(code, '[1-9][0-9]{3}') and not ends_with(name, '-DR') as common from panel where code is not null and name is not null")
def common_stocks(spark, d):
    n = table(spark, d, "panel").filter("code is not null and name is not null").select("code", "name").distinct()
    return n.withColumn("common", panel.common(F.col("code"), F.col("name")))


@R.add(f"with {MARKET} select cast(date as varchar) as date, market, round(mkt_ret, 6) as mkt_ret, n from mkt")
def market_return(spark, d):
    return rounded(panel.market_returns(rets(spark, d)).withColumn("date", F.col("date").cast("string")))


_FEATURES = f"""{', '.join(f'lag(ret, {k}) over w as ret_lag{k}' for k in (1, 2, 3, 4))},
 case when count(ret) over w5 = 5 then sum(ret) over w5 end as ret_5, case when count(ret) over w20 = 20 then stddev_samp(ret) over w20 end as vol_20,
 case when count(ln(volume)) over b20 = 20 then (ln(volume) - avg(ln(volume)) over b20) / nullif(stddev_samp(ln(volume)) over b20, 0) end as vlm_z"""
_FRAMES = """window w as (partition by code, market order by date), w5 as (partition by code, market order by date rows between 4 preceding and current row), w20 as (partition by code, market order by date rows between 19 preceding and current row),
 b20 as (partition by code, market order by date rows between 20 preceding and 1 preceding), b5 as (partition by code, market order by date rows between 5 preceding and 1 preceding)"""
_NAMES = ["ret", "ret_lag1", "ret_lag2", "ret_lag3", "ret_lag4", "ret_5", "vol_20", "vlm_z", "oc", "mkt_ret", "close"]


def features(spark: SparkSession, d: str) -> DataFrame:
    r = cut(rets(spark, d).select("code", "market", "date", "close", "volume", "value", "ret", "oc"))
    return panel.with_market(r, panel.market_returns(r))


@R.add(f"""with {MARKET}, f as (select r.code, r.market, r.date, r.ret, r.oc, k.mkt_ret, r.close, {_FEATURES} from rets r left join mkt k on k.date = r.date and k.market = r.market {_FRAMES.replace('code, market', 'r.code, r.market').replace('order by date', 'order by r.date')})
select code, market, cast(date as varchar) as date, {', '.join(f'round({c}, 6) as {c}' for c in _NAMES)} from f""")
def price_features(spark, d):
    return rounded(panel.price_features(features(spark, d)).withColumn("date", F.col("date").cast("string")))


@R.add(f"""with {ALIGNED}, {MARKET}, day as (select code, trade_date, count(case when kind = 'article' then 1 end) + count(case when kind = 'comment' then 1 end) as posts,
  count(case when tag = 'push' then 1 end) / nullif(count(case when tag in ('push', 'boo') then 1 end), 0) as push_ratio from aligned where trade_date is not null group by all),
acct as (select code, trade_date, account, round(avg(score), 12) as m from aligned where trade_date is not null and account is not null and score is not null group by all),
polar as (select code, trade_date, avg(m) as sent_mean, avg(case when m > 0 then 1.0 else 0.0 end) as bull_ratio, stddev_pop(m) as sent_std from acct group by code, trade_date),
j as (select r.code, r.market, r.date, r.ret, k.mkt_ret, p.sent_mean, coalesce(p.bull_ratio, 0.5) as bull_ratio, coalesce(p.sent_std, 0) as sent_std, y.push_ratio, coalesce(p.sent_mean, 0) as sent, ln(1 + coalesce(y.posts, 0)) as log_posts
  from rets r left join mkt k on k.date = r.date and k.market = r.market left join day y on y.code = r.code and y.trade_date = r.date left join polar p on p.code = r.code and p.trade_date = r.date)
select code, market, cast(date as varchar) as date, cast(sent_mean is not null as double) as has_sent, round(sent, 10) as sent, round(sent - case when count(*) over b5 = 5 then avg(sent) over b5 end, 10) as sent_chg,
 round(bull_ratio, 10) as bull_ratio, round(sent_std, 10) as sent_std, round(coalesce(push_ratio, median(push_ratio) over (partition by code, market)), 10) as push_ratio, round(log_posts, 10) as log_posts,
 round(log_posts - case when count(*) over b20 = 20 then avg(log_posts) over b20 end, 10) as attn_abn, round(lead(ret) over w, 10) as ret_next, case when lead(ret) over w > 0 then 1 when lead(ret) over w is not null then 0 end as up_next,
 round(lead(ret - mkt_ret) over w, 10) as excess_next, cast(lead(date) over w as varchar) as target_date from j {_FRAMES}""")
def build_daily(spark, d):
    return rounded(daily_rows(spark, d).withColumns({c: F.col(c).cast("string") for c in ("date", "target_date")}), 10)


def daily_rows(spark: SparkSession, d: str) -> DataFrame:
    """Prices joined with the day's sentiment: what is missing is filled and marked, so that models take it."""
    figures = sentiment.day_figures(aligned(spark, d), ["code"]).withColumnRenamed("trade_date", "date")
    j = panel.targets(features(spark, d)).join(figures, ["code", "date"], "left")
    w = frames.ordered(["code", "market"], "date")
    posts = F.log1p(F.coalesce("n_articles", F.lit(0)) + F.coalesce("n_comments", F.lit(0)))
    j = j.withColumns({"sent": F.coalesce("sent_mean", F.lit(0.0)), "log_posts": posts})
    middle = j.groupBy("code", "market").agg(F.median("push_ratio").alias("__m"))
    return j.withColumns({"sent_chg": F.col("sent") - frames.rolling(F.avg, F.col("sent"), w, 5, until=-1), "attn_abn": F.col("log_posts") - frames.rolling(F.avg, F.col("log_posts"), w, 20, until=-1)}).join(middle, ["code", "market"]).select(
        "code", "market", "date", F.col("sent_mean").isNotNull().cast("double").alias("has_sent"), "sent", "sent_chg", F.coalesce("bull_ratio", F.lit(0.5)).alias("bull_ratio"), F.coalesce("sent_std", F.lit(0.0)).alias("sent_std"),
        F.coalesce("push_ratio", "__m").alias("push_ratio"), "log_posts", "attn_abn", "ret_next", "up_next", "excess_next", "target_date",
    )


_DEV = "date >= date '2022-03-01' and target_date <= date '2023-11-30' and target_date < date '2023-07-01'"


@R.add(f"with {RETS}, t as (select code, market, date, lead(date) over (partition by code, market order by date) as target_date from rets) select code, market, cast(min(date) as varchar) as first, cast(max(target_date) as varchar) as last, count(*) as n from t where {_DEV} group by code, market")
def development_period(spark, d):
    """What remains of each code for study while the final test is kept out."""
    t = panel.period(panel.targets(rets(spark, d)), "2022-03-01", "2023-11-30", "2023-07-01")
    return t.groupBy("code", "market").agg(F.min("date").cast("string").alias("first"), F.max("target_date").cast("string").alias("last"), F.count("*").alias("n"))


@R.add(f"with {DENSE} select d.code, cast(d.date as varchar) as date, d.pos, round(d.ret, 6) as ret, d.market, d.traded, round(k.mkt_ret, 6) as mkt_ret from dense d left join mkt k on k.date = d.date and k.market = d.market")
def dense_panel(spark, d):
    g = dense(spark, d).select("code", F.col("date").cast("string").alias("date"), F.col("pos").cast("bigint").alias("pos"), "ret", "market", "traded", "mkt_ret")
    return rounded(g)


@R.add(f"with {MODEL} select code, cast(date as varchar) as date, round(beta, 5) as beta, round(ar, 5) as ar, round(sigma, 5) as sigma from model where beta is not null")
def market_model(spark, d):
    m = events.market_model(stock_rows(spark, d)).filter("beta is not null")
    return rounded(m.select("code", F.col("date").cast("string").alias("date"), "beta", "ar", "sigma"), 5)


@R.add(f"""with {MODEL}, day as (select date, count(*) as n, count(case when event and up then 1 end) as u, count(case when event and not up then 1 end) as dn from evented where eligible group by date),
e as (select e.*, coalesce(e.event and (case when up then u else dn end) / n >= 0.05, false) as cluster from evented e left join day using (date)),
f as (select *, coalesce(pos - lag(pos) over (partition by code order by pos) <= 5, false) as follows from e where event),
g as (select e.*, coalesce(f.follows, false) as follows, coalesce(bool_or(e.event) over (partition by e.code order by e.pos range between 5 preceding and 5 following), false) as near from e left join f on f.code = e.code and f.pos = e.pos)
select code, cast(date as varchar) as date, round(z, 4) as z, up, cluster, follows, event, event and not follows as main, not near as control from g where eligible""")
def stock_days(spark, d):
    g = event_days(spark, d).filter("eligible")
    return rounded(g.select("code", F.col("date").cast("string").alias("date"), "z", "up", "cluster", "follows", "event", "main", "control"), 4)


def event_days(spark: SparkSession, d: str) -> DataFrame:
    """model's rows with follows, main (an event that follows none) and control (eligible, no event around)."""
    e = cut(model(spark, d))
    f = joins.follow_on(e.filter("event").select("code", "pos"), ["code"], "pos", 5)
    g = joins.near_event(e, ["code"], "pos", F.col("event"), 5).join(f, ["code", "pos"], "left").withColumn("follows", F.coalesce("follows", F.lit(False)))
    return g.withColumns({"main": F.col("event") & ~F.col("follows"), "control": F.col("eligible") & ~F.col("near")}).drop("near")


@R.add(f"with {MODEL} select code, cast(date as varchar) as date, adj, halt, disp, locked from flagged where adj or halt or disp or locked")
def barred_days(spark, d):
    return model(spark, d).filter("adj or halt or disp or locked").select("code", F.col("date").cast("string").alias("date"), "adj", "halt", "disp", "locked")


_GRIDC = f"""{ALIGNED}, n as (select code, pos, count(case when {_PRE.format('09:00:00')} then 1 end) as pre, count(case when not {_PRE.format('09:00:00')} then 1 end) as intra from aligned where pos is not null and code is not null group by all), codes as (select distinct code from n),
g as (select k.code, c.pos, coalesce(n.pre, 0) as pre, coalesce(n.intra, 0) as intra, coalesce(n.pre, 0) + coalesce(n.intra, 0) as n from codes k cross join cal c left join n on n.code = k.code and n.pos = c.pos)"""


def _win(name, a, b):
    f = lambda x: f"{-x} preceding" if x < 0 else (f"{x} following" if x else "current row")
    return f"{name} as (partition by code order by pos range between {f(a)} and {f(b)})"


_SUMS = {"pre5": (-5, -1), "next": (1, 1), "post": (2, 5)}
_WINDOWED = f"""{_GRIDC}, s as (select code, pos, pre as preopen, intra as intraday, {', '.join(f'case when count(*) over {k} = {b - a + 1} then cast(sum(n) over {k} as bigint) end as {k}' for k, (a, b) in _SUMS.items())}, case when count(*) over base = 20 then avg(ln(1 + n)) over base end as base
 from g window {', '.join(_win(k, a, b) for k, (a, b) in _SUMS.items())}, {_win('base', -25, -6)})"""


def windowed(spark: SparkSession, d: str) -> DataFrame:
    """The five windows of every code and trading day."""
    parts = calendar.day_parts(texts(spark, d), "time", cal(spark, d)).filter("code is not null")
    n = parts.groupBy("code", "pos").agg(F.count_if("pre").alias("pre"), F.count_if(~F.col("pre")).alias("intra"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    grid = calendar.every_day(n.select("code").distinct(), cal(spark, d)).join(n, ["code", "pos"], "left").select("code", "pos", zero("pre"), zero("intra"))
    return events.window_counts(grid, "pre", "intra")


@R.add(f"with {_WINDOWED} select code, pos, {', '.join(events.WINDOWS)}, round(base, 6) as base from s")
def window_counts(spark, d):
    return rounded(windowed(spark, d).select("code", F.col("pos").cast("bigint").alias("pos"), *events.WINDOWS, "base"))


@R.add(f"""with {_WINDOWED}, ok as (select pos, coalesce(lag(date, 26) over (order by pos) >= date '2022-02-01' and lead(date, 5) over (order by pos) < date '2023-12-01', false) as ok from cal)
select code, s.pos, {', '.join(f"case when ok and {k} is not null then cast({k} > 0 as double) end as any_{k}, round(case when ok then ln(1 + {k}) end, 6) as log_{k}, round(case when ok then ln(1 + {k} / {n}) - base end, 6) as abn_{k}" for k, n in events.WINDOWS.items())} from s join ok on ok.pos = s.pos""")
def window_outcomes(spark, d):
    """Of each window whether there is any text, how many, and how unusual that is; null where the data don't hold the window."""
    w = events.known_windows(windowed(spark, d), cal(spark, d), "2022-02-01", "2023-12-01")
    out = [c.alias(f"{kind}_{k}") for k, n in events.WINDOWS.items() for kind, c in zip(("any", "log", "abn"), events.outcome(F.col(k), n, F.col("base")), strict=True)]
    return rounded(w.select("code", F.col("pos").cast("bigint").alias("pos"), *out))


@R.add(f"""with {MODEL}, s as (select code, date, event, sign(ar) * case when count(ar) over f5 = 5 then sum(ar) over f5 end as scar5, abs(lag(ar) over w) / nullif(sigma, 0) as abs_z1, case when sigma > 0 then ln(sigma) end as log_sigma, lag(cast(locked as double)) over w as lock1,
 lag(ln(volume)) over w - case when count(ln(volume)) over b = 20 then avg(ln(volume)) over b end as lvol_abn1 from evented
 window w as (partition by code order by pos), f5 as (partition by code order by pos rows between 1 following and 5 following), b as (partition by code order by pos rows between 21 preceding and 2 preceding))
select code, cast(date as varchar) as date, round(scar5, 5) as scar5, round(abs_z1, 4) as abs_z1, round(log_sigma, 5) as log_sigma, lock1, round(lvol_abn1, 5) as lvol_abn1 from s where event""")
def scar(spark, d):
    m = events.stock_lags(model(spark, d), "locked").withColumn("scar5", events.signed_forward(F.col("ar"), 5)).filter("event")
    return m.select("code", F.col("date").cast("string").alias("date"), *[(F.round(c, 4 if c == "abs_z1" else 5) + 0.0).alias(c) for c in ("scar5", "abs_z1", "log_sigma", "lock1", "lvol_abn1")])


_H, _K = (1, 5, 20), (20, 5)
_CELLS = ", ".join(f"""r{h} as (select code, pos, raw_{h} as r, row_number() over (partition by pos order by liq, code) as i, row_number() over (partition by pos order by past, code) as j, count(*) over (partition by pos) as n from a where raw_{h} is not null and liq is not null and past is not null),
c{h} as (select code, pos, r - avg(r) over (partition by pos, greatest(ceil((i - 1) * 5 / greatest(n - 1, 1)) - 1, 0), greatest(ceil((j - 1) * 5 / greatest(n - 1, 1)) - 1, 0)) as bm from r{h} where n >= 50)""" for h in _H)


@R.add(f"""with {MODEL}, {SPREAD[SPREAD.index('one as'):]}, ev as (select code, pos, up from evented where event),
a as (select *, {', '.join(f'case when count(x) over h{h} = {h} then sum(x) over h{h} end as car_{h}, case when count(ret) over h{h} = {h} then sum(ret) over h{h} end as raw_{h}, case when count(mkt_ret) over h{h} = {h} then sum(mkt_ret) over h{h} end as m_{h}' for h in _H)},
 {', '.join(f'case when count(x) over k{k} = {k} then sum(x) over k{k} end as pre_{k}' for k in _K)}, case when pos >= 250 and regr_count(ret, mkt_ret) over p >= 120 then regr_slope(ret, mkt_ret) over p end as b, case when pos >= 250 and regr_count(ret, mkt_ret) over p >= 120 then regr_intercept(ret, mkt_ret) over p end as a,
 case when count(value) over l >= 10 then avg(value) over l end as liq, case when count(ret) over l >= 15 then sum(ret) over l end as past
 from valued window {', '.join(f'h{h} as (partition by code order by pos rows between 1 following and {h} following)' for h in _H)}, {', '.join(f'k{k} as (partition by code order by pos rows between {k} preceding and 1 preceding)' for k in _K)},
 p as (partition by code order by pos rows between 250 preceding and 30 preceding), l as (partition by code order by pos rows between 19 preceding and current row)),
{_CELLS}
select ev.code, ev.pos, ev.up, {', '.join(f'round(car_{h}, 5) as car_{h}, round(raw_{h}, 5) as raw_{h}, round(raw_{h} - (a.a * {h} + a.b * m_{h}), 5) as mm_{h}, round(c{h}.bm, 5) as bm_{h}' for h in _H)}, {', '.join(f'round(pre_{k}, 5) as pre_{k}' for k in _K)}, round(x, 5) as day0
from ev left join a using (code, pos) {' '.join(f'left join c{h} on c{h}.code = ev.code and c{h}.pos = ev.pos' for h in _H)}""")
def event_car(spark, d):
    ev = cut(model(spark, d).filter("event").select("code", "pos", "up"))
    g = cut(valued(spark, d).select("code", "pos", "ret", "mkt_ret", "value"))
    return rounded(events.abnormal_returns(ev, g, _H, _K).withColumn("pos", F.col("pos").cast("bigint")), 5)


@R.add(f"""with {MODEL}, {SPREAD[SPREAD.index('one as'):]}, legs as (select g.pos, avg(case when e.up then g.x end) as l, avg(case when not e.up then g.x end) as s from evented e join valued g on g.code = e.code and g.pos between e.pos + 1 and e.pos + 5 where e.event group by g.pos)
select pos, round(l, 5) as long, round(s, 5) as short, round(l - s, 5) as spread from legs where l is not null and s is not null""")
def calendar_time(spark, d):
    g = dense(spark, d).select("code", "pos", (F.col("ret") - F.col("mkt_ret")).alias("ar"))
    c = events.calendar_time(model(spark, d).filter("event"), g, 5)
    return rounded(c.withColumn("pos", F.col("pos").cast("bigint")), 5)


@R.add(f"""with {RETS}, s as (select code, market, date, case when count(value) over a >= 10 then avg(value) over a end as liq, case when count(ret) over a >= 15 then sum(ret) over a end as mom from rets
 window a as (partition by code, market order by date rows between 19 preceding and current row)),
ok as (select *, row_number() over (partition by date order by liq, code, market) as i, row_number() over (partition by date order by mom, code, market) as j, count(*) over (partition by date) as n from s where liq is not null and mom is not null)
select code, market, cast(date as varchar) as date, cast(case when n >= 50 then greatest(ceil((i - 1) * 5 / greatest(n - 1, 1)) - 1, 0) * 5 + greatest(ceil((j - 1) * 5 / greatest(n - 1, 1)) - 1, 0) end as int) as cell from ok""")
def benchmark_cells(spark, d):
    w = frames.ordered(["code", "market"], "date")
    s = rets(spark, d).select("code", "market", "date", frames.rolling(F.avg, F.col("value"), w, 20, 10).alias("liq"), frames.rolling(F.sum, F.col("ret"), w, 20, 15).alias("mom"))
    g = events.benchmark_cells(s, "date", "liq", "mom", ["code", "market"])
    return g.select("code", "market", F.col("date").cast("string").alias("date"), "cell")


@R.add("""with one as (select distinct code, date, pre_abn from windows) select code, cast(date as varchar) as date,
 coalesce(pre_abn <= case when count(pre_abn) over b >= 60 then quantile_cont(pre_abn, 0.4) over b end, false) as low40, coalesce(pre_abn <= case when count(pre_abn) over b >= 60 then quantile_cont(pre_abn, 0.1) over b end, false) as low10,
 coalesce(pre_abn >= case when count(pre_abn) over b >= 60 then quantile_cont(pre_abn, 0.9) over b end, false) as high10 from one window b as (partition by code order by date rows between 250 preceding and 1 preceding)""")
def extremes(spark, d):
    one = table(spark, d, "windows").select("code", "date", "pre_abn").distinct()
    w, x = frames.ordered(["code"], "date"), F.col("pre_abn")
    one = one.withColumn("q", frames.rolling_quantiles(x, (0.4, 0.1, 0.9), w, 250, 60))
    q = lambda p: F.get("q", F.lit((0.4, 0.1, 0.9).index(p)))
    f = lambda c: F.coalesce(c, F.lit(False))
    return one.select("code", F.col("date").cast("string").alias("date"), f(x <= q(0.4)).alias("low40"), f(x <= q(0.1)).alias("low10"), f(x >= q(0.9)).alias("high10"))


_WEEKLY_LAST, _WEEKLY_MEAN = ["close", "ret_5", "vol_20", "vlm_z"], ["sent", "sent_chg", "bull_ratio", "log_posts"]


@R.add(f"""with b as ({SQL['build_daily']}), p as ({SQL['price_features']}), j as (select p.code, p.market, cast(p.date as date) as date, p.ret, {', '.join(f'p.{c}' for c in _WEEKLY_LAST)}, {', '.join(f'b.{c}' for c in _WEEKLY_MEAN)} from p join b on b.code = p.code and b.market = p.market and b.date = p.date),
w as (select code, market, cast(date_trunc('week', date + 2) + interval 4 days as date) as week, max(date) as date, {', '.join(f'arg_max_null({c}, date) as {c}' for c in _WEEKLY_LAST)}, {', '.join(f'avg({c}) as {c}' for c in _WEEKLY_MEAN)}, case when count(ret) = count(*) then sum(ret) end as r from j group by all),
n as (select *, lead(r) over (partition by code, market order by week) as ret_next, lead(date) over (partition by code, market order by week) as target_end from w)
select code, market, cast(date as varchar) as date, {', '.join(f'round({c}, 8) as {c}' for c in _WEEKLY_LAST + _WEEKLY_MEAN)}, round(ret_next, 8) as ret_next, cast(target_end as varchar) as target_end from n where date >= date '2022-02-01' and target_end < date '2023-12-01'""")
def weekly(spark, d):
    key = ["code", "market", "date"]
    j = price_features(spark, d).select(*key, "ret", *_WEEKLY_LAST).join(build_daily(spark, d).select(*key, *_WEEKLY_MEAN), key).withColumn("date", F.col("date").cast("date"))
    w = panel.weekly(j, _WEEKLY_LAST, _WEEKLY_MEAN, "2022-02-01", "2023-12-01")
    return rounded(w.withColumns({c: F.col(c).cast("string") for c in ("date", "target_end")}), 8)


@R.add(f"""with {ALIGNED}, acct as (select code, pos, account, round(avg(score), 12) as m from aligned where pos is not null and account is not null and score is not null and {_PRE.format('08:30:00')} group by all)
select code, pos, round(case when count(*) >= 3 then avg(m) end, 10) as sent, count(*) as n_polar from acct group by code, pos""")
def preopen_sentiment(spark, d):
    """The sentiment of what was said from the close before to half an hour before the open."""
    a = aligned(spark, d).filter("pos is not null")
    s = sentiment.sentiment(a.filter(calendar.before_clock(F.col("time"), F.col("trade_date"), "08:30")), ["code", "pos"], 3)
    return rounded(s.select("code", F.col("pos").cast("bigint").alias("pos"), F.col("sent_mean").alias("sent"), "n_polar"), 10)


@R.add(f"""with {RETS} select code, market, cast(date as varchar) as date, round(case when count(ret) over f = 3 then sum(ret) over f end, 6) as fwd3, round(case when count(ret) over e >= 20 then avg(ret) over e end, 6) as hist_mean,
 round(case when count(ret) over e >= 20 then avg(case when ret > 0 then 1.0 when ret <= 0 then 0.0 end) over e end, 6) as up_rate from rets
 window f as (partition by code, market order by date rows between 1 following and 3 following), e as (partition by code, market order by date rows between unbounded preceding and 1 preceding)""")
def forward_and_history(spark, d):
    w, r = frames.ordered(["code", "market"], "date"), F.col("ret")
    up = F.when(r > 0, 1.0).when(r <= 0, 0.0)
    return rounded(rets(spark, d).select("code", "market", F.col("date").cast("string").alias("date"), frames.forward_sum(r, w, 3).alias("fwd3"), frames.expanding(F.avg, r, w, 20).alias("hist_mean"), frames.expanding(F.avg, up, w, 20).alias("up_rate")))


@R.add("""with one as (select distinct code, date, pre_abn from windows), p as (select code, date, case when pre_abn > 0.5 then 1 when pre_abn < -0.5 then -1 end as s from one)
select code, cast(date as varchar) as date, coalesce(last_value(s ignore nulls) over (partition by code order by date rows between unbounded preceding and current row), 0) as held,
 coalesce(last_value(s ignore nulls) over (partition by code order by date rows between 2 preceding and current row), 0) as held3 from p""")
def signal_position(spark, d):
    one = table(spark, d, "windows").select("code", "date", "pre_abn").distinct()
    s = F.when(F.col("pre_abn") > 0.5, 1).when(F.col("pre_abn") < -0.5, -1)
    w = frames.ordered(["code"], "date")
    return one.withColumn("s", s).select("code", F.col("date").cast("string").alias("date"), F.coalesce(frames.last_known(F.col("s"), w), F.lit(0)).alias("held"), F.coalesce(frames.last_known(F.col("s"), w, 2), F.lit(0)).alias("held3"))


@R.add(f"""with {SPREAD}, s as (select code, date, pos, sum(coalesce(ret, 0)) over a - sum(coalesce(ret, 0)) over b as mom, case when count(ret) over a >= 200 then stddev_samp(ret) over a end as vol, case when count(value) over l >= 40 then avg(value) over l end as liq, count(ret) over a as n_obs from valued
 window a as (partition by code order by pos rows between 251 preceding and current row), b as (partition by code order by pos rows between 20 preceding and current row), l as (partition by code order by pos rows between 59 preceding and current row)),
me as (select date from (select date, lead(date) over (order by date) as n from cal) where date_trunc('month', n) <> date_trunc('month', date)),
named as (select code, date, bool_and(regexp_full_match(code, '[1-9][0-9]{{3}}') and not ends_with(coalesce(name, ''), '-DR')) as common from panel where close > 0 and volume > 0 group by all),
able as (select code, date from (select code, date, bool_or(limit_up_close or limit_down_close) as locked from rets group by all) join named using (code, date) where common and not locked),
pool as (select * from (select s.*, row_number() over (partition by date order by liq desc, code) as lr from s join able using (code, date) where date in (select date from me) and liq is not null and n_obs >= 200) where lr <= 300),
q as (select *, round(mom, 9) as m, round(vol, 9) as v from pool), ranks as (select *, rank() over (partition by date order by -m) + (count(*) over (partition by date, m) - 1) / 2.0 + rank() over (partition by date order by v) + (count(*) over (partition by date, v) - 1) / 2.0 as score from q where mom is not null and vol is not null),
orders as (select date, code, 'momentum' as factor, -m as o, 50 as k from q union all select date, code, 'momentum_fewer', -m, 30 from q union all select date, code, 'low_volatility', v, 50 from q union all select date, code, 'liquidity', -liq, 50 from q union all select date, code, 'combined', score, 50 from ranks),
ranked as (select *, row_number() over (partition by date, factor order by o, code) as rank from orders where o is not null)
select code, cast(date as varchar) as date, factor, cast(rank as int) as rank from ranked where rank <= k""")
def factor_picks(spark, d):
    return factor_rows(spark, d).select("code", F.col("date").cast("string").alias("date"), "factor", "rank")


def factor_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each month's last day and factor: common stocks that traded that day without a limit at the close."""
    s = panel.trailing_signals(valued(spark, d))
    ends = calendar.period_flags(cal(spark, d)).filter("month_end").select("date")
    flag = panel.common(F.col("code"), F.coalesce("name", F.lit("")))
    named = table(spark, d, "panel").filter("close > 0 and volume > 0").groupBy("code", "date").agg(F.min(flag).alias("common"))
    free = rets(spark, d).groupBy("code", "date").agg(F.max(F.col("limit_up_close") | F.col("limit_down_close")).alias("locked")).join(named, ["code", "date"]).filter("common and not locked")
    ok = s.join(F.broadcast(ends), "date", "left_semi").join(free.join(F.broadcast(ends), "date", "left_semi").select("code", "date"), ["code", "date"], "left_semi")
    return panel.factor_choice(cut(ok.select("code", "date", "mom", "vol", "liq", "n_obs")))


@R.add(f"""with {UNIQ}, p as (select code, date, min(close) as close from panel where close > 0 group by all), a as (select uid, code, cast(time as date) as day from uniq where kind = 'article')
select uid, p.close, cast(p.date as varchar) as at from a asof left join p on p.code = a.code and a.day >= p.date""")
def asof_panel(spark, d):
    a = texts(spark, d).filter("kind = 'article'").select("uid", "code", F.to_date("time").alias("day"))
    p = table(spark, d, "panel").filter("close > 0").groupBy("code", "date").agg(F.min("close").alias("close")).withColumn("at", F.col("date").cast("string"))
    return joins.as_of_days(a, p, ["code"], "day", "date", ["at", "close"]).select("uid", "close", "at")


@R.add("""with p as (select distinct code, date from panel) select code, cast(date as varchar) as date, exists(select 1 from twse_punish t where t.code = p.code and p.date between t.start and t."end") as inside from p""")
def interval_flag(spark, d):
    p = table(spark, d, "panel").select("code", "date").distinct()
    return joins.in_intervals(p, table(spark, d, "twse_punish"), ["code"], "date", "start", "end").withColumn("date", F.col("date").cast("string"))


@R.add(f"""with {MODEL}, {UNIQ}, {ALIGNED[ALIGNED.index('shifted as'):]}, it as (select uid, code, pos from aligned where pos is not null), ev as (select code, pos, row_number() over (order by code, pos) as e from evented where event),
near as (select ev.code, ev.pos, it.uid, it.pos - ev.pos as off, row_number() over (partition by ev.code, ev.pos order by abs(it.pos - ev.pos), it.uid) as k from ev join it on it.code = ev.code and it.pos between ev.pos - 2 and ev.pos + 1)
select code, pos, uid, off, cast(k as int) as k from near where k <= 15""")
def window_items(spark, d):
    ev = model(spark, d).filter("event").select("code", F.col("pos").alias("e"))
    it = aligned(spark, d).filter("pos is not null").select("uid", "code", "pos")
    near = joins.band(ev, it, ["code"], "e", "pos", -2, 1)
    top = frames.top_n(near, ["code", "e"], [F.abs(F.col("pos") - F.col("e")), F.col("uid")], 15, "k")
    return top.select("code", F.col("e").cast("bigint").alias("pos"), "uid", (F.col("pos") - F.col("e")).cast("bigint").alias("off"), "k")


@R.add(f"""with {CAL}, {RETS}, r as (select code, date, sum(ret) as ret from rets group by all), days as (select distinct code, date from windows),
t as (select code, date, sum(coalesce(ret, 0)) over (partition by code order by date) as s, row_number() over (partition by code order by date) as n from r),
seen as (select d.code, d.date, coalesce(t.s, 0) as s, coalesce(t.n, 0) as n from days d asof left join t on t.code = d.code and d.date > t.date)
select code, cast(date as varchar) as date, round(s - lag(s) over w, 6) as ret, case when lag(n) over w is not null then n = lag(n) over w end as none from seen window w as (partition by code order by date)""")
def accumulated_between(spark, d):
    r = rets(spark, d).groupBy("code", "date").agg(F.sum("ret").alias("ret")).withColumnRenamed("date", "at")
    days = table(spark, d, "windows").select("code", "date").distinct()
    return rounded(joins.accumulated(r, days, ["code"], "at", "date", "ret").withColumn("date", F.col("date").cast("string")))


@R.add(f"""with {RETS}, ev as (select code, market, date, close, row_number() over (partition by code, market order by date) as pos from rets),
h as (select e.code, e.market, e.date, e.pos, min(case when b.high >= e.close * 1.05 then b.pos end) as t, min(case when b.low <= e.close * 0.95 then b.pos end) as s from ev e
 left join (select r.*, ev.pos from rets r join ev using (code, market, date)) b on b.code = e.code and b.market = e.market and b.pos between e.pos + 1 and e.pos + 10 group by all)
select code, market, cast(date as varchar) as date, case when t is null and s is null then 'none' when t = s then 'both' when s is null or t < s then 'target' else 'stop' end as outcome from h""")
def first_touch(spark, d):
    p = rets(spark, d).withColumn("pos", F.row_number().over(frames.ordered(["code", "market"], "date")))
    ev = p.select("code", "market", "date", "pos", F.concat_ws("|", "code", "market", "pos").alias("event_id"), (F.col("close") * 1.05).alias("target"), (F.col("close") * 0.95).alias("stop"))
    return events.first_touch(ev, p, ["code", "market"], 10).select("code", "market", F.col("date").cast("string").alias("date"), "outcome")


@R.add(f"""with {ALIGNED}, a as (select uid, code, account, pos, score from aligned where kind = 'article' and pos is not null and account is not null),
b as (select *, pos - lag(pos) over (partition by account, code order by pos, uid) as back from a),
kept as (select * from b where back is null or back > 5),
rate as (select uid, account, code, pos, case when count(score) over r >= 3 then avg(case when score > 0 then 1.0 else 0.0 end) filter (where score is not null) over r end as hits from kept window r as (partition by account order by pos range between unbounded preceding and 21 preceding))
select uid, account, code, pos, round(hits, 6) as hits from rate""")
def author_history(spark, d):
    a = aligned(spark, d).filter("kind = 'article' and pos is not null and account is not null").select("uid", "code", "account", "pos", "score")
    kept = events.drop_close_repeats(a, ["account", "code"], "pos", ["pos", "uid"], 5)
    kept = kept.withColumn("hit", F.col("score") > 0)
    return rounded(kept.select("uid", "account", "code", F.col("pos").cast("bigint").alias("pos"), events.past_hit_rate(kept, ["account"], "pos", "hit", 20, 3).alias("hits")))


@R.add(f"""with {CAL}, us as (select * from (select date, close as adj, high, low, volume, row_number() over (partition by date order by market, code) as k from traded where high is not null and low > 0 and code < '3') where k = 1),
s as (select date, row_number() over (order by date) as n, ln(adj) as lr, sum(pow(ln(high / low), 2) / (4 * ln(2.0))) over (order by date) as pk, case when count(*) over b = 20 then ln(volume) - avg(ln(volume)) over b end as lvol from us window b as (order by date rows between 20 preceding and 1 preceding)),
seen as (select c.date, s.n, s.lr, s.pk, s.lvol from cal c asof left join s on c.date > s.date), d as (select *, lag(n) over (order by date) as n0, lr - lag(lr) over (order by date) as r, pk - lag(pk) over (order by date) as v from seen)
select cast(date as varchar) as date, round(case when n0 is not null then case when n > n0 then abs(r) else 0 end end, 6) as abs, round(case when n0 is not null then case when n > n0 then least(r, 0) else 0 end end, 6) as neg, round(case when n0 is not null then case when n > n0 then sqrt(greatest(v, 0)) else 0 end end, 6) as pk,
 round(case when n0 is not null then case when n > n0 then lvol else 0 end end, 6) as lvol, case when n0 is not null then cast(n <= n0 as double) end as none from d""".replace("with cal", f"with {TRADED}, cal", 1))
def overnight(spark, d):
    """What a market that closes between two trading days did; one stock a day stands for it."""
    w = frames.ordered(["date"], ["market", "code"])
    t = panel.traded(table(spark, d, "panel")).filter("high is not null and low > 0 and code < '3'").withColumn("k", F.row_number().over(w)).filter("k = 1")
    o = joins.overnight(t.select("date", F.col("close").alias("adj"), "high", "low", "volume"), cal(spark, d))
    return rounded(o.withColumn("date", F.col("date").cast("string")))


_LAGS = ", ".join(f"case when count({y}) over w{n} = {n} then avg({y}) over w{n} end as {y}_l{n}" for y in ("y_lv", "y_vol") for n in (1, 5, 22))
_DESIGN = ["y_lv", "y_vol", *[f"{y}_l{n}" for y in ("y_lv", "y_vol") for n in (1, 5, 22)], "abs_r1", "neg_r1", "lock_up1", "lock_dn1", "gap_abs", "gap_neg"]


@R.add(f"""with {MODEL}, y as (select code, date, pos, ret, gap, limit_up_close, limit_down_close, case when volume > 0 then ln(volume) end as y_lv, case when high > low and low > 0 then ln(ln(high / low)) end as y_vol from px),
d as (select code, date, y_lv, y_vol, {_LAGS}, abs(lag(ret) over w) as abs_r1, case when lag(ret) over w is not null then least(lag(ret) over w, 0) end as neg_r1, lag(cast(limit_up_close as double)) over w as lock_up1, lag(cast(limit_down_close as double)) over w as lock_dn1, abs(gap) as gap_abs, case when gap is not null then least(gap, 0) end as gap_neg
 from y window w as (partition by code order by pos), {', '.join(f'w{n} as (partition by code order by pos rows between {n} preceding and 1 preceding)' for n in (1, 5, 22))})
select code, cast(date as varchar) as date, {', '.join(f'round({c}, 6) as {c}' for c in _DESIGN)} from d""")
def volume_design(spark, d):
    """Targets and lags of a volume and range model, per code and traded day."""
    v = events.volume_design(stock_rows(spark, d, whole=True))
    return rounded(v.select("code", F.col("date").cast("string").alias("date"), *_DESIGN))
