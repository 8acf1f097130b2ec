"""Queries on titles, news and names: text functions, matches, samples and cross tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.functions import lexicon
from boardlens.functions import text as tx
from boardlens.operators import joins, labels, matching, panel, redelivery
from boardlens.plans.market import RETS, UNIQ, rets, texts
from boardlens.plans.registry import Registry, rounded
from boardlens.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

_NEWS = "news as (select * from (select *, row_number() over (partition by trim(newsid, ' ') order by received_at desc, delivery_id desc) as rn from newsfeed where newsid is not null) where rn = 1)"


def news(spark: SparkSession, d: str) -> DataFrame:
    """One delivery of each news item."""
    return redelivery.keep_one(table(spark, d, "newsfeed").filter("newsid is not null"), "newsid", "received_at", "delivery_id")


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "universe_267").select(F.col("ticker").alias("code"), F.col("name_short").alias("name"))


_WS = r"[\s\p{Z}\x{0b}\x{85}]"
_TITLE = rf"^(Re:{_WS}*|Fw:{_WS}*)?\[([^\]]+)\]"


@R.add(rf"""select article_id, case when regexp_matches(title, '{_TITLE}') then regexp_replace(regexp_extract(title, '{_TITLE}', 2), '^{_WS}+|{_WS}+$', '', 'g') end as category,
 coalesce(regexp_matches(title, '{_TITLE}') and regexp_extract(title, '{_TITLE}', 1) <> '', false) as is_reply, length(regexp_replace(title, '^(?:{_WS}*(?:Re|Fw|R|F):{_WS}*)+', '')) as n from articles""")
def parse_category(spark, d):
    cat, reply = tx.title_category(F.col("title"))
    return table(spark, d, "articles").select("article_id", cat.alias("category"), reply.alias("is_reply"), F.char_length(tx.strip_reply(F.col("title"))).cast("bigint").alias("n"))


@R.add(rf"""select doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: not regexp_matches(x, '^{_WS}*(?:※{_WS}*引述|[:：]|ex{_WS}*\[)|板規|標題請使用以下格式')), chr(10)),
 '[(（]例[^)）\n]*[)）]', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g')) as body from documents""")
def strip_quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.strip_quotes(F.col("text"))).alias("body"))


@R.add(rf"""with t as (select article_id, list_distinct(regexp_extract_all(replace(title, '[標的]', ' '), '(?:^|[\s\p{{Z}}(（\]】\-－/])(多|空)(?:$|[\s\p{{Z}})）】!！?？,，.。])', 1)) as said, regexp_extract(content, '分類{_WS}*[:：]{_WS}*([^\n]{{0,8}})', 1) as own from articles)
select article_id, case when len(said) = 1 then case when said[1] = '多' then 'bullish' else 'bearish' end end as title_label, case when contains(own, '多') and not contains(own, '空') then 'bullish' when contains(own, '空') and not contains(own, '多') then 'bearish' end as own_label from t""")
def post_labels(spark, d):
    """What a title says of the direction, and what the author's own line in the body says."""
    return table(spark, d, "articles").select("article_id", tx.title_direction(F.col("title")).alias("title_label"), tx.weak_label(F.col("content")).alias("own_label"))


@R.add("select ticker as code, replace(regexp_replace(replace(name_short, '*', ''), '(?i:-(?:KY|DR))$', ''), '臺', '台') as name from universe_267")
def norm_names(spark, d):
    return names(spark, d).select("code", tx.norm_name(F.col("name")).alias("name"))


_UNI = "uni as (select ticker as code, name_short as name from universe_267 where name_short is not null and name_short <> '')"


@R.add(f"with {_UNI} select distinct article_id, code from articles join uni on contains(title, name)")
def name_mentions(spark, d):
    return matching.name_hits(table(spark, d, "articles"), "article_id", "title", names(spark, d), "code", "name")


@R.add("select distinct article_id, code from (select article_id, unnest(list_distinct(regexp_extract_all(title, '[0-9]+'))) as code from articles) where code in (select ticker from universe_267)")
def code_mentions(spark, d):
    return matching.code_hits(table(spark, d, "articles"), "article_id", "title", names(spark, d), "code")


@R.add(f"with {_UNI} select a.code, a.name, string_agg(distinct b.name, '/' order by b.name) as longer from uni a join uni b on contains(b.name, a.name) and a.name <> b.name group by all")
def superstrings(spark, d):
    return matching.superstrings(names(spark, d), "code", "name")


@R.add(f"""with {_UNI}, {_NEWS} select distinct trim(newsid, ' ') as newsid, code from (
 select newsid, unnest(stock) as code from news union all select newsid, code from news join uni on contains(title, name)) where code in (select ticker from universe_267)""")
def news_items(spark, d):
    n = news(spark, d).withColumn("newsid", F.trim("newsid"))
    tagged = n.select("newsid", F.explode("stock").alias("code")).join(names(spark, d).select("code").distinct(), "code", "left_semi").select("newsid", "code")
    return tagged.unionByName(matching.name_hits(n, "newsid", "title", names(spark, d), "code", "name")).distinct()


@R.add(f"with {UNIQ} select uid from uniq where tag = 'push' or split_part(uid, ':', 2) in (select article_id from articles where category = '標的')")
def thread_or_push(spark, d):
    ids = table(spark, d, "articles").filter("category = '標的'").select(F.col("article_id").alias("thread"))
    return joins.semi_or(texts(spark, d).withColumn("thread", F.split_part("uid", F.lit(":"), F.lit(2))), ids, "thread", F.col("tag") == "push").select("uid")


@R.add("""with p as (select code, any_value(market) as market, max(name) as name, count(*) as n from panel group by code), u as (select ticker as code, name_short as name, sector from universe_267)
select code, coalesce(u.name, p.name) as name, sector, n, u.code is not null as in_left, p.code is not null as in_right from u full join p using (code)""")
def outer_with_source(spark, d):
    p = table(spark, d, "panel").groupBy("code").agg(F.max("name").alias("name"), F.count("*").alias("n"))
    return joins.outer_with_source(table(spark, d, "universe_267").select(F.col("ticker").alias("code"), F.col("name_short").alias("name"), "sector"), p, ["code"], ["name"])


@R.add("""with m as (select author, category, round(avg(n_push), 9) as mean_push, count(*) as n from articles group by author, category)
select article_id, n, mean_push from articles a left join m on a.author is not distinct from m.author and a.category is not distinct from m.category""")
def null_safe_lookup(spark, d):
    a = table(spark, d, "articles")
    m = a.groupBy("author", "category").agg(F.avg("n_push").alias("mean_push"), F.count("*").alias("n"))
    return rounded(joins.null_safe(a, m, ["author", "category"], ["mean_push", "n"]).select("article_id", "n", "mean_push"), 9)


@R.add("select code, cast(date as varchar) as date, 'panel' as only_in from (select code, date from panel except select code, date from windows) union all select code, cast(date as varchar), 'windows' from (select code, date from windows except select code, date from panel)")
def missing_days(spark, d):
    p, w = (table(spark, d, t).select("code", "date") for t in ("panel", "windows"))
    both = p.subtract(w).withColumn("only_in", F.lit("panel")).unionByName(w.subtract(p).withColumn("only_in", F.lit("windows")))
    return both.select("code", F.col("date").cast("string").alias("date"), "only_in")


@R.add("select a.author, cast(count(*) as bigint) as n from articles a where author is not null and not exists (select 1 from texts t where t.account = a.author) group by a.author")
def silent_authors(spark, d):
    a = table(spark, d, "articles").filter("author is not null").select("author")
    t = table(spark, d, "texts").select(F.col("account").alias("author")).filter("author is not null").distinct()
    return a.join(t, "author", "left_anti").groupBy("author").agg(F.count("*").alias("n"))


@R.add(f"with {UNIQ} select case when grouping(y) = 1 then -1 else y end as year, case when grouping(kind) = 1 then 'all' else kind end as kind, count(*) as n, count(case when tag = 'push' then 1 end) as push from (select *, cast(year(time) as int) as y from uniq) group by cube (y, kind)")
def crosstab_margins(spark, d):
    t = texts(spark, d).withColumn("y", F.year("time"))
    c = t.cube("y", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("tag") == "push").alias("push"), F.grouping("y").alias("gy"), F.grouping("kind").alias("gk"))
    return c.select(F.when(F.col("gy") == 1, -1).otherwise(F.col("y")).alias("year"), F.when(F.col("gk") == 1, "all").otherwise(F.col("kind")).alias("kind"), "n", "push")


@R.add("""with n as (select category, cast(month(time) as int) as month, count(*) as n from articles where category is not null group by all) select category, month, round(n / sum(n) over (partition by category), 6) as by_row, round(n / sum(n) over (partition by month), 6) as by_column from n""")
def crosstab_shares(spark, d):
    n = table(spark, d, "articles").filter("category is not null").groupBy("category", F.month("time").alias("month")).agg(F.count("*").alias("n"))
    return rounded(n.selectExpr("category", "month", "n / sum(n) over (partition by category) as by_row", "n / sum(n) over (partition by month) as by_column"))


@R.add("select cast(year(time) as int) as year, category = '標的' as target, count(*) as posts, count(case when not is_reply then 1 end) as originals, count(case when not is_reply and content <> '' then 1 end) as with_body, count(case when not is_reply and content <> '' and n_push > n_boo then 1 end) as liked from articles where category is not null group by all")
def funnel(spark, d):
    first = ~F.col("is_reply")
    body = first & (F.col("content") != "")
    return table(spark, d, "articles").filter("category is not null").groupBy(F.year("time").alias("year"), (F.col("category") == "標的").alias("target")).agg(F.count("*").alias("posts"), F.count_if(first).alias("originals"), F.count_if(body).alias("with_body"), F.count_if(body & (F.col("n_push") > F.col("n_boo"))).alias("liked"))


@R.add(f"""with {_NEWS} select trim(newsid, ' ') as newsid, cast(timezone('Asia/Taipei', to_timestamp(publishat)) as varchar) as time, len(title) as n from news where title is not null""")
def news_times(spark, d):
    t = F.from_utc_timestamp(F.timestamp_seconds("publishat"), "Asia/Taipei").cast("string")
    return news(spark, d).filter("title is not null").select(F.trim("newsid").alias("newsid"), t.alias("time"), F.char_length("title").cast("bigint").alias("n"))


@R.add("select title, arg_min(article_id, (time, article_id)) as article_id, count(*) as n from articles where title is not null group by title having count(*) > 1")
def first_of_title(spark, d):
    a = table(spark, d, "articles").filter("title is not null").groupBy("title").agg(F.min_by("article_id", F.struct("time", "article_id")).alias("article_id"), F.count("*").alias("n"))
    return a.filter("n > 1")


@R.add(f"""with {RETS}, yearly as (select code, market, cast(year(date) as int) as year, exp(sum(ret)) - 1 as total, count(ret) as n, min(ret) as worst from rets group by all) select code, market, year, round(total, 6) as total, n, round(worst, 6) as worst from yearly""")
def yearly_returns(spark, d):
    g = rets(spark, d).groupBy("code", "market", F.year("date").alias("year")).agg(F.expm1(F.sum("ret")).alias("total"), F.count("ret").alias("n"), F.min("ret").alias("worst"))
    return rounded(g)


@R.add(f"""with {UNIQ}, k as (select uid, cast(year(time) as int) as year, kind, row_number() over (partition by year(time), kind order by md5(uid || '42'), uid) as k from uniq)
select uid, year, kind from k where (kind = 'article' and k <= 70) or (kind = 'comment' and k <= 30)""")
def stratified_sample(spark, d):
    """Of each year and kind the same texts at every run: 70 articles and 30 comments, by a hash of the identifier."""
    t = texts(spark, d).select("uid", "kind", F.year("time").alias("year")).withColumn("__h", F.md5(F.concat("uid", F.lit("42"))))
    return labels.stratified(t, ["year"], "kind", {"article": 70, "comment": 30}, ["__h", "uid"]).select("uid", "year", "kind")


@R.add()
def resolved_titles(spark, d):
    """The one stock that each title names on its day, by codes and names longest first."""
    known = tx.bounded_names(panel.listed_names(table(spark, d, "panel")))
    a = table(spark, d, "articles").select("article_id", "title", "time")
    return a.withColumn("r", tx.name_resolver(known)("title", "time")).select("article_id", "r.code", "r.how")


@R.add()
def lexicon_scores(spark, d):
    """Distinct contents scored once, then joined back."""
    score = tx.lexicon_scorer(lexicon.RISE, lexicon.FALL, lexicon.ALONE, lexicon.TURNS)
    a = table(spark, d, "articles").select("article_id", "content").filter("content is not null and content != ''")
    s = a.select("content").distinct().withColumn("score", score("content"))
    return a.join(s, "content").select("article_id", "score")


@R.add(f"""with {_UNI}, {_NEWS}, n as (select distinct trim(newsid, ' ') as item, code from news join uni on contains(title, name)), t as (select distinct trim(newsid, ' ') as item, unnest(stock) as code from news),
k as (select * from t where code in (select ticker from universe_267))
select code, count(n.item) as hits, count(case when n.item is not null and k.item is not null then 1 end) as tagged_hits, count(k.item) as tags, round(count(case when n.item is not null and k.item is not null then 1 end) / nullif(count(n.item), 0), 6) as tag_frac
from (select item, code, item as i from n) n0(item, code, i) full join (select item, code, item as i from k) k0(item, code, i) using (item, code), lateral (select n0.i as item) n, lateral (select k0.i as item) k group by code""")
def hit_stats(spark, d):
    n = news(spark, d).withColumn("item", F.trim("newsid"))
    named = matching.name_hits(n, "item", "title", names(spark, d), "code", "name")
    tagged = n.select("item", F.explode("stock").alias("code")).distinct().join(names(spark, d).select("code").distinct(), "code", "left_semi").select("item", "code")
    return rounded(labels.hit_stats(tagged, named))


def rules(spark: SparkSession, d: str) -> DataFrame:
    """Each code's short name with the longer names that hold it, of those listed in the panel too."""
    own = names(spark, d).filter("name is not null and name != ''").withColumn("name", tx.norm_name(F.col("name")))
    listed = table(spark, d, "panel").select(F.lit("").alias("code"), tx.norm_name(F.col("name")).alias("name")).filter("name is not null").distinct()
    longer = matching.superstrings(own.unionByName(listed), "code", "name").filter("code != ''").select("code", "name", F.col("longer").alias("exclude"))
    return own.join(longer, ["code", "name"], "left").select("code", "name", F.coalesce("exclude", F.lit("")).alias("exclude"), F.lit(True).alias("by_name"), F.lit(True).alias("by_code"))


_NORM = "replace(regexp_replace(replace({0}, '*', ''), '(?i:-(?:KY|DR))$', ''), '臺', '台')"
_RULES = f"""own as (select ticker as code, {_NORM.format('name_short')} as name from universe_267 where name_short is not null and name_short <> ''), every as (select name from own union select {_NORM.format('name')} from panel where name is not null),
ruled as (select o.code, o.name, coalesce(list_sort(list_distinct(list(e.name) filter (where e.name is not null))), []) as words from own o left join every e on contains(e.name, o.name) and e.name <> o.name group by all),
t as (select article_id, replace(coalesce(title, ''), '臺', '台') as t from articles),
hits as (select distinct article_id, code from t join ruled on name <> '' and (contains(t, name) or (regexp_matches(name, '[A-Za-z]') and contains(lower(t), lower(name))))
  where case when regexp_matches(name, '[A-Za-z]') then contains(lower(list_reduce(list_prepend(t, words), lambda a, w: replace(a, w, ''))), lower(name)) else contains(list_reduce(list_prepend(t, words), lambda a, w: replace(a, w, '')), name) end
 union select article_id, code from (select article_id, unnest(list_distinct(regexp_extract_all(t, '[0-9]+'))) as code from t) where code in (select code from own))"""


@R.add(f"with {_RULES} select article_id, code from hits")
def rule_hits(spark, d):
    return matching.rule_hits(table(spark, d, "articles"), "article_id", "title", rules(spark, d))


@R.add(f"""with {_RULES}, {UNIQ}, c as (select split_part(uid, ':', 2) as article_id, split_part(uid, ':', 3) as idx, time from uniq where kind = 'comment')
select code, cast(time as varchar) as time, count(*) as n from (select code, time from articles join hits using (article_id) union all select code, c.time from c join articles a using (article_id) join hits using (article_id) where epoch(c.time) - epoch(a.time) <= 30 * 86400) group by all""")
def board_items(spark, d):
    """When each code is talked of: articles that name it, and the comments of their threads up to 30 days on."""
    a = table(spark, d, "articles").select("article_id", "time")
    c = texts(spark, d).filter("kind = 'comment'").select(F.split_part("uid", F.lit(":"), F.lit(2)).alias("article_id"), F.split_part("uid", F.lit(":"), F.lit(3)).alias("idx"), "time")
    lag = F.unix_seconds(F.col("time").cast("timestamp")) - F.unix_seconds(F.col("__t").cast("timestamp"))
    c = c.join(a.select("article_id", F.col("time").alias("__t")), "article_id").select("article_id", "idx", "time", lag.alias("lag_sec"))
    items = matching.thread_items(a, c, matching.rule_hits(table(spark, d, "articles"), "article_id", "title", rules(spark, d)))
    return items.groupBy("code", F.col("time").cast("string").alias("time")).agg(F.count("*").alias("n"))
