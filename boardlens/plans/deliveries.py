"""Queries p1, p2, p4, p5 and p6 over the board, news and exchange tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.operators import intervals, redelivery, rolling
from boardlens.session import table
from boardlens.sources import csv_lines, drift

# What the daily quote and disposition files hold, and the names a reduction file's fields go by.
LINE_FEEDS = {
    "twse_day": csv_lines.Feed(numbers=("本益比",), span=("成交股數", "收盤價")),
    "twse_punish": csv_lines.Feed(days=("announced", "start", "end")),
}
REDUCTION = [
    drift.Target("code", "text", ("代號", "證券代號", "股票代號")),
    drift.Target("name", "text", ("名稱", "證券簡稱", "簡稱")),
    drift.Target("day", "day", ("恢復日期", "日期", "恢復買賣日")),
    drift.Target("close_before", "number", ("停止前收盤", "停牌前價", "前收盤")),
    drift.Target("reference", "number", ("參考價", "恢復參考價", "基準參考價")),
    drift.Target("limit_up", "number", ("漲停價", "上限", "漲停價格")),
    drift.Target("limit_down", "number", ("跌停價", "下限", "跌停價格")),
    drift.Target("opening", "number", ("開始基準", "競價基準", "開盤基準")),
    drift.Target("ratio", "number", ("減資比率", "比率", "減資率")),
    drift.Target("refund", "number", ("退還股款", "退款", "每股退還")),
    drift.Target("exchange", "number", ("換發股數", "每千股換發", "換股數")),
    drift.Target("reason", "text", ("原因", "事由", "減資原因")),
    drift.Target("note", "text", ("備考", "附註", "說明")),
]

#: Days that the rolling state of whole tables moves at a time.
BLOCK_DAYS = 256


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "newsfeed").select("delivery_id", "newsid", "received_at")
    return redelivery.repeats(news, "newsid", "received_at", "delivery_id").select("delivery_id")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = redelivery.keep_one(table(spark, d, "newsfeed"), "newsid", "received_at", "delivery_id")
    return kept.select("delivery_id", F.trim("newsid").alias("newsid"), "publishat", "title", F.size(F.coalesce("stock", F.expr("cast(array() as array<string>)"))).alias("n_stock"))


def _amounts(spark: SparkSession, d: str, buckets: int) -> DataFrame:
    panel = table(spark, d, "panel").select(F.lit("panel.value").alias("src"), "code", "date", "market", "value", "loaded_at")
    w = table(spark, d, "windows").select("code", "date", F.lit("").alias("market"), "ptt_base", "pre_abn", "loaded_at")
    w = w.unpivot(["code", "date", "market", "loaded_at"], ["ptt_base", "pre_abn"], "src", "value").withColumn("src", F.concat(F.lit("windows."), "src"))
    rows = panel.unionByName(w.select(*panel.columns))
    return rolling.daily_amounts(rows, ["code", "src"], "date", "value", ["market"], "loaded_at", block_days=BLOCK_DAYS, buckets=buckets)


def _state(spark: SparkSession, d: str) -> DataFrame:
    state = rolling.State(spark, ["code", "src"], block_days=BLOCK_DAYS)
    return state.replay(_amounts(spark, d, state.buckets))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array_compact(
        F.array(
            F.when(F.col("nz7") == 0, F.lit("silent7")),
            F.when(F.col("nz30") == 0, F.lit("silent30")),
            F.when((F.col("src") == "panel.value") & (F.col("sum7") * 10 > F.col("sum30") * 7), F.lit("burst")),
        )
    )
    return _state(spark, d).filter(F.datediff("day", "first_day") >= 29).select("src", "code", F.col("day").cast("string").alias("day"), F.explode(kinds).alias("kind"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    state = rolling.averages(_state(spark, d))
    exact = [F.round(F.col(c).cast("double"), 9).alias(c) for c in ("sum7", "sum30", "avg7", "avg30", "mean7", "mean30")]
    return state.select("src", "code", F.col("day").cast("string").alias("day"), "n7", "nz7", "n30", "nz30", *exact)


def _punish_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "twse_punish").filter("code is not null").select("code", F.unix_date("start").alias("start"), F.unix_date("end").alias("end"))
    return intervals.periods(rows, ["code"], "start", "end")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    both = intervals.with_gaps(_punish_runs(spark, d), ["code"], "start", "end")
    return both.select("code", "kind", *[F.date_from_unix_date(F.col(c).cast("int")).cast("string").alias(c) for c in ("start", "end")])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return csv_lines.classify_lines(table(spark, d, "raw_lines"), LINE_FEEDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return csv_lines.bad_lines(_lines(spark, d)).select("line_id", "reason")


def p5_good(spark: SparkSession, d: str) -> DataFrame:
    """The good rows with their main columns typed."""
    from boardlens.functions.parse import number, roc_day

    v = csv_lines.good_rows(_lines(spark, d))
    get = lambda n: F.try_element_at("values", F.lit(n))
    return v.select("line_id", "feed", F.coalesce(get("證券代號"), get("code")).alias("code"), number(get("成交股數")).alias("volume"), number(get("收盤價")).alias("close"), roc_day(get("start")).cast("string").alias("start"), roc_day(get("end")).cast("string").alias("end"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "twtauu"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    t = drift.common_table(table(spark, d, "twtauu"), REDUCTION)
    rest = F.array_join(F.transform("rest", lambda x: F.concat_ws("|", x["pos"].cast("string"), F.coalesce(x["name"], F.lit("")), x["raw"])), ";")
    return t.withColumns({"day": F.col("day").cast("string"), "failed": F.array_join("failed", ","), "rest": rest})


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p2_found, p2_totals, p4_found, p5_found, p5_good, p6_found, p6_table)}

_P1_RANKED = """select *, row_number() over (partition by trim(newsid, ' ') order by received_at desc nulls last, delivery_id desc) as rn from newsfeed where newsid is not null"""

_P2_TOTALS = """
with raw as (
  select 'panel.value' as src, code, market, date, value as v from panel
  union select 'windows.ptt_base', code, '', date, ptt_base from windows
  union select 'windows.pre_abn', code, '', date, pre_abn from windows),
amount as (select src, code, date, sum(cast(v as decimal(28,6))) as s, count(v) as n, count(case when v <> 0 then 1 end) as nz from raw group by all),
ends as (select src, code, min(date) as d0, max(date) as d1 from amount group by all),
grid as (select src, code, d0, cast(unnest(generate_series(d0, d1, interval 1 day)) as date) as date from ends),
filled as (select g.src, g.code, g.d0, g.date, coalesce(s, 0) as s, coalesce(n, 0) as n, coalesce(nz, 0) as nz from grid g left join amount a on a.src = g.src and a.code = g.code and a.date = g.date),
state as (select src, code, d0, date,
    sum(s) over w7 as sum7, cast(sum(n) over w7 as bigint) as n7, cast(sum(nz) over w7 as bigint) as nz7,
    sum(s) over w30 as sum30, cast(sum(n) over w30 as bigint) as n30, cast(sum(nz) over w30 as bigint) as nz30
  from filled
  window w7 as (partition by src, code order by date rows between 6 preceding and current row),
         w30 as (partition by src, code order by date rows between 29 preceding and current row))
"""

_P4 = """
with ok as (select distinct code, start as s, "end" as e from twse_punish where start is not null and "end" is not null and start <= "end" and code is not null),
marked as (select *, case when s <= max(e) over (partition by code order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as fresh from ok),
grouped as (select *, sum(fresh) over (partition by code order by s, e rows unbounded preceding) as run from marked),
runs as (select code, run, min(s) as s, max(e) as e from grouped group by code, run),
nexts as (select *, lead(s) over (partition by code order by s) as s2 from runs)
select code, 'period' as kind, cast(s as varchar) as start, cast(e as varchar) as "end" from runs
union all select code, 'gap', cast(e + 1 as varchar), cast(s2 - 1 as varchar) from nexts where s2 is not null
"""

_F = '(?:"(?:[^"]|"")*"|[^",]*)'
_NUM = "^(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\\.[0-9]+)?$"
_ROC_Y = "^([0-9]{1,3})(?:/[0-9]{1,2}/[0-9]{1,2}|年[0-9]{1,2}月[0-9]{1,2}日)$"
_P5 = f"""
with head as (select feed, file, list_transform(regexp_extract_all(',' || raw, ',({_F})', 1), lambda x: trim(x, '"')) as names from raw_lines where line_no = 1),
body as (select l.line_id, l.feed, coalesce(l.raw, '') as raw, h.names from raw_lines l left join head h on h.feed = l.feed and h.file = l.file where line_no > 1),
split as (select *, regexp_matches(raw, '^{_F}(?:,{_F})*$') as quoted,
    list_transform(regexp_extract_all(',' || raw, ',({_F})', 1), lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) as fields from body),
cells as (select line_id, feed, unnest(names) as name, unnest(fields) as v from split where quoted and len(names) = len(fields)),
parts as (select *, nullif(regexp_extract(v, '{_ROC_Y}', 1), '') as y, regexp_extract_all(v, '[0-9]+') as nums from cells),
bad as (select distinct line_id from parts where
    (feed = 'twse_day' and name in ('成交股數','成交金額','開盤價','最高價','最低價','收盤價','本益比') and not (v in ('', '--', '---') or regexp_matches(v, '{_NUM}')))
    or (feed = 'twse_punish' and name in ('announced','start','end') and
        (y is null or cast(y as int) < 1 or try_cast(printf('%04d-%02d-%02d', cast(y as int) + 1911, cast(nums[2] as int), cast(nums[3] as int)) as date) is null)))
"""

_P6 = """
with one as (select feed, seq, any_value(list_transform(fields, lambda n: replace(n, ' ', ''))) as own, any_value(data) as data from twtauu group by feed, seq),
named as (select feed, seq, data, last_value(own ignore nulls) over (partition by feed order by seq) as names from one),
pairs as (select *, lag(names) over (partition by feed order by seq) as old from named),
node as (select feed, seq, unnest(names) as field, unnest(range(1, len(names) + 1)) as pos from named),
gone as (select feed, seq, names, old, unnest(old) as field, unnest(range(1, len(old) + 1)) as pos from pairs where old is not null),
come as (select feed, seq, names, old, unnest(names) as field, unnest(range(1, len(names) + 1)) as pos from pairs where old is not null),
renamed as (select feed, seq, field, old[pos] as before from come where len(names) = len(old) and not list_contains(old, field) and not list_contains(names, old[pos])),
added as (select feed, seq, field from come c where not list_contains(old, field) and not exists (select 1 from renamed r where r.feed = c.feed and r.seq = c.seq and r.field = c.field)),
removed as (select feed, seq, field from gone g where not list_contains(names, field) and not exists (select 1 from renamed r where r.feed = g.feed and r.seq = g.seq and r.before = g.field)),
vals as (select o.feed, o.seq, n.field, r.row[n.pos] as v from one o, unnest(o.data) as r(row), node n where n.feed = o.feed and n.seq = o.seq),
kinds as (select feed, seq, field, min(case when regexp_matches(v, '^[0-9,]*\\.?[0-9,]*$') then 'number' when regexp_matches(v, '^[0-9]{1,3}(/[0-9]{1,2}/[0-9]{1,2}|年[0-9]{1,2}月[0-9]{1,2}日)$') then 'roc' when regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then 'iso' else 'text' end) as kind
  from vals where v is not null and v not in ('', '-', '--') group by all),
full_node as (select n.feed, n.seq, n.field, k.kind, case when list_contains(p.old, n.field) then n.field else r.before end as before
  from node n join pairs p on p.feed = n.feed and p.seq = n.seq left join kinds k on k.feed = n.feed and k.seq = n.seq and k.field = n.field left join renamed r on r.feed = n.feed and r.seq = n.seq and r.field = n.field)
"""
_P6_RECURSIVE = _P6.replace("with one as", "with recursive one as", 1) + """
, walk(feed, seq, field, known) as (
  select feed, seq, field, kind from full_node where seq = 1
  union all
  select f.feed, f.seq, f.field, coalesce(f.kind, w.known) from (select distinct feed, seq + 1 as seq from walk) s join full_node f on f.feed = s.feed and f.seq = s.seq left join walk w on w.feed = f.feed and w.seq = f.seq - 1 and w.field = f.before)
select feed, seq, field, 'renamed' as change from renamed
union all select feed, seq, field, 'added' from added
union all select feed, seq, field, 'removed' from removed
union all select f.feed, f.seq, f.field, 'retyped' from full_node f join walk w on w.feed = f.feed and w.seq = f.seq - 1 and w.field = f.before where f.kind <> w.known
"""

def _p6_table() -> str:
    """Each target's place in the names, its raw value, the value typed, and what is left."""
    names = [t.name for t in REDUCTION]
    place = ", ".join("coalesce(" + ", ".join(f"nullif(list_position(names, '{n}'), 0)" for n in t.known_as) + f") as at_{t.name}" for t in REDUCTION)
    raw = ", ".join(f"case when trim(row[at_{n}]) not in ('', '-', '--') then row[at_{n}] end as raw_{n}" for n in names)
    plain = "case when regexp_full_match(replace(trim({0}), ',', ''), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(replace(trim({0}), ',', '') as double) end"
    roc = "case when regexp_full_match({0}, '[0-9]{{1,3}}(/[0-9]{{1,2}}/[0-9]{{1,2}}|年[0-9]{{1,2}}月[0-9]{{1,2}}日)') then try_cast(printf('%04d-%02d-%02d', cast(regexp_extract_all({0}, '[0-9]+')[1] as int) + 1911, cast(regexp_extract_all({0}, '[0-9]+')[2] as int), cast(regexp_extract_all({0}, '[0-9]+')[3] as int)) as date) else try_cast({0} as date) end"
    typed = ", ".join({"number": plain, "day": roc, "text": "{0}"}[t.kind].format(f"raw_{t.name}") + f" as {t.name}" for t in REDUCTION)
    failed = ", ".join(f"case when raw_{t.name} is not null and {t.name} is null then '{t.name}' end" for t in REDUCTION if t.kind != "text")
    held = ", ".join(f"case when {n} is not null then at_{n} end" for n in names)
    return _P6.split(",\npairs as")[0].replace("any_value(data) as data", "arg_min(data, file_id) as data") + f""",
rowed as (select feed, seq, names, unnest(data) as row, unnest(range(len(data))) as row_no from named),
placed as (select *, {place} from rowed), raws as (select *, {raw} from placed), typed as (select *, {typed} from raws),
ended as (select *, [{held}] as held, [{failed}] as failing from typed)
select feed, seq, cast(row_no as int) as row_no, {", ".join("cast(day as varchar) as day" if n == "day" else n for n in names)}, array_to_string(list_filter(failing, lambda x: x is not null), ',') as failed,
 array_to_string(list_transform(list_filter(range(1, len(row) + 1), lambda i: row[i] is not null and trim(row[i]) not in ('', '-', '--') and not coalesce(list_contains(held, i), false)), lambda i: concat_ws('|', cast(i as varchar), coalesce(names[i], ''), row[i])), ';') as rest from ended"""


SQL = {
    "p1_found": f"select delivery_id from ({_P1_RANKED}) where rn > 1",
    "p1_kept": f"select delivery_id, trim(newsid, ' ') as newsid, publishat, title, cast(coalesce(len(stock), 0) as int) as n_stock from (select * exclude (rn) from ({_P1_RANKED}) where rn = 1 union all select * from newsfeed where newsid is null)",
    "p2_found": _P2_TOTALS + """, late as (select * from state where date >= d0 + 29)
select src, code, cast(date as varchar) as day, 'silent7' as kind from late where nz7 = 0
union all select src, code, cast(date as varchar), 'silent30' from late where nz30 = 0
union all select src, code, cast(date as varchar), 'burst' from late where src = 'panel.value' and sum7 * 10 > sum30 * 7""",
    "p2_totals": _P2_TOTALS + """select src, code, cast(date as varchar) as day, n7, nz7, n30, nz30, round(cast(sum7 as double), 9) as sum7, round(cast(sum30 as double), 9) as sum30,
  round(cast(sum7 as double) / 7, 9) as avg7, round(cast(sum30 as double) / 30, 9) as avg30, round(case when n7 > 0 then cast(sum7 as double) / n7 end, 9) as mean7, round(case when n30 > 0 then cast(sum30 as double) / n30 end, 9) as mean30 from state""",
    "p4_found": _P4,
    "p5_found": _P5 + "select line_id, case when not quoted then 'quoting' when names is null or len(names) <> len(fields) then 'column_count' else 'value' end as reason from split where not quoted or names is null or len(names) <> len(fields) or line_id in (select line_id from bad)",
    "p5_good": _P5 + """select line_id, feed, max(case when name in ('證券代號', 'code') then v end) as code, max(case when name = '成交股數' then try_cast(replace(v, ',', '') as double) end) as volume,
  max(case when name = '收盤價' then try_cast(replace(v, ',', '') as double) end) as close, max(case when name = 'start' then printf('%04d-%02d-%02d', cast(y as int) + 1911, cast(nums[2] as int), cast(nums[3] as int)) end) as start,
  max(case when name = 'end' then printf('%04d-%02d-%02d', cast(y as int) + 1911, cast(nums[2] as int), cast(nums[3] as int)) end) as "end" from parts where line_id not in (select line_id from bad) group by line_id, feed""",
    "p6_found": _P6_RECURSIVE,
    "p6_table": _p6_table(),
}
