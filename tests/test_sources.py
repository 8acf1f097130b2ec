"""Files of each kind, written and read."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from boardlens.functions import text as tx
from boardlens.operators import matching
from boardlens.sources import board_files, market_files as mf, sinks
from boardlens.streaming import deliveries


def put(path, name, content):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False))
    return str(path)


def test_day_quotes(spark, tmp_path):
    f = ["證券代號", "證券名稱", "成交股數", "成交金額", "開盤價", "最高價", "最低價", "收盤價"]
    one = {"tables": [{"title": "x", "fields": ["指數"], "data": [["y"]]}, {"title": "q", "fields": f, "data": [["2330", "甲", "1,000", "2,000.5", "--", "10", "9", "9.5"], ["0050", "乙", "1", "1", "1", "1", "1", "1"], ["712345", "丙", "1", "1", "1", "1", "1", "1"]]}]}
    two = {"tables": [{"fields": f[::-1], "data": [["9.6", "9", "10", "9.1", "5", "6", "甲", "2330"]]}]}
    p = put(tmp_path, "20240105.json", one)
    put(tmp_path, "20240108.json", two)
    got = {(r.code, str(r.date)): r for r in mf.day_quotes(spark, p, mf.TWSE_DAY, "TWSE").collect()}
    assert set(got) == {("2330", "2024-01-05"), ("0050", "2024-01-05"), ("2330", "2024-01-08")}
    r = got["2330", "2024-01-05"]
    assert (r.volume, r.value, r.open, r.close, r.market) == (1000.0, 2000.5, None, 9.5, "TWSE")
    assert got["2330", "2024-01-08"].close == 9.6
    one["tables"][1]["data"].append(one["tables"][1]["data"][0][:-1] + ["99"])
    one["tables"][0] = {"fields": ["指數", "收盤指數"], "data": [["發行量加權股價指數", "17,000.5"], ["別的", "1"]]}
    one["tables"].append({"fields": ["報酬指數", "收盤指數"], "data": [["發行量加權股價報酬指數", "36,000"]]})
    p = put(tmp_path / "again", "20240105.json", one)
    assert {r.close for r in mf.day_quotes(spark, p, mf.TWSE_DAY, "TWSE").filter("code = '2330'").collect()} == {9.5}
    assert [tuple(r) for r in mf.day_indices(spark, p).collect()] == [(dt.date(2024, 1, 5), 17000.5, 36000.0)]


def test_index_reference_disposition(spark, tmp_path):
    put(tmp_path / "i", "201901.json", {"fields": [], "data": [["108/01/02", "1", "9,700.5"], ["x", "1", "2"]]})
    p = put(tmp_path / "i", "201902.json", {"fields": [], "data": [["108/01/02", "1", "9,800"], ["108/01/03", "1", "3", "0.5", "2"]]})
    assert [tuple(r)[1:] for r in mf.index_levels(spark, p).orderBy("date").collect()] == [(None, None, None, 9800.0), (1.0, 3.0, 0.5, 2.0)]
    a = put(tmp_path / "e", "a.json", [["110年01月05日", "1111 ", "n", "100", "95"], ["110年01月06日", "2222", "n", 100, "--"], ["110年01月07日", "3333", "n", 100, 90.5]])
    assert {(r.code, r.ref) for r in mf.reference_prices(spark, a).collect()} == {("1111", 95.0), ("3333", 90.5)}
    for form in ({"data": [["110/01/05", "1111", "n", "100", "94"]]}, [["110/01/05", "1111", "n", "100", "94"]]):
        b = put(tmp_path / "r", "b.json", form)
        assert {(r.code, r.ref) for r in mf.reference_prices(spark, a, b).collect()} == {("1111", 94.0), ("3333", 90.5)}
    c = put(tmp_path / "d", "c.json", [["", "", "1111", "", "", "", "110/01/05～110/01/18"]] * 2 + [["", "", "2222", "", "", "", "bad"]])
    assert [(r.code, str(r.start), str(r.end)) for r in mf.dispositions(spark, c).collect()] == [("1111", "2021-01-05", "2021-01-18")]


def test_vendor_chart_news(spark, tmp_path):
    v = put(tmp_path / "v", "a.json", {"data": [{"date": "2024-01-02", "stock_id": "2330", "open": 1, "max": 3, "min": 1, "close": 2, "Trading_Volume": 5}, {"date": "2024-01-03", "stock_id": "2330", "close": 0, "Trading_Volume": 5}]})
    assert [(r.code, r.high, r.volume) for r in mf.vendor_daily(spark, v).collect()] == [("2330", 3.0, 5.0)]
    q = {"high": [2.0, None], "low": [1.0, 1.0], "volume": [7, 8]}
    c = put(tmp_path / "c", "a.json", {"chart": {"result": [{"timestamp": [1704205800, 1704292200], "indicators": {"quote": [q], "adjclose": [{"adjclose": [1.5, 1.6]}]}}]}})
    assert [(str(r.date), r.adj) for r in mf.chart_daily(spark, c).collect()] == [("2024-01-02", 1.5)]
    item = {"newsId": " 1 ", "publishAt": 1704205800, "title": "old", "content": "&amp;lt;b&amp;gt;x&lt;/b&gt;  y", "stock": ["2330"]}
    put(tmp_path / "n", "1.json", {"items": {"data": [item]}})
    n = put(tmp_path / "n", "2.json", {"items": {"data": [item | {"title": "new"}]}})
    r = mf.news_pages(spark, n).collect()
    assert [(x.newsid, x.title, x.content, x.time, x.stock) for x in r] == [("1", "new", "x y", dt.datetime(2024, 1, 2, 22, 30), ["2330"])]


def test_futures(spark, tmp_path):
    line = lambda d, c, s, cl, v, h="105", lo="100": f"{d},TX,{c},101,{h},{lo},{cl},1,1%,{v},{cl},9,1,1,1,1,,{s},,"
    rows = ["h" + "," * 19, line("2024/01/02", "202401  ", "一般", "100", "10"), line("2024/01/02", "202402", "一般", "110", "5"), line("2024/01/03", "202401  ", "盤後", "102", "3"), line("2024/01/03", "202402", "盤後", "121", "8", "122", "118"), line("2024/01/03", "202401/202402", "盤後", "1", "99")]
    f = mf.futures_csv(spark, put(tmp_path, "a.csv", "\n".join(rows)))
    assert f.count() == 4
    r = mf.night_sessions(f).first()
    assert r.contract == "202402" and r.n_abs == pytest.approx(math.log(121 / 110)) and r.n_range == pytest.approx(math.log(math.log(122 / 118))) and r.n_lvol is None


def test_filings(spark, tmp_path):
    row = lambda c, d, n: f"<tr class='even'><td>{c}</td><td>{d}</td><td>16:36:51</td><td>{n}</td><td>公告&nbsp;<b>本公司</b></td></tr>"
    put(tmp_path, "1616_108.html", f"<table>{row('1616', '108/03/26', 1)}<tr class='odd'><td>x</td></tr>{row('1616', 'bad', 1)}</table>")
    put(tmp_path, "1617_108.html", row("1617", "108/01/01", 1))
    p = put(tmp_path, "1617_108_02.html", row("1617", "108/02/01", 2) * 2)
    got = {(r.code, r.time, r.seq_no, r.subject) for r in mf.filing_pages(spark, p).collect()}
    assert got == {("1616", dt.datetime(2019, 3, 26, 16, 36, 51), 1, "公告 本公司"), ("1617", dt.datetime(2019, 2, 1, 16, 36, 51), 2, "公告 本公司")}
    pages = spark.createDataFrame([(row("1", "108/01/01", 1),), ("查無資料",), ("查詢過於頻繁",)], "p string")
    assert [r.s for r in pages.select(mf.page_status(F.col("p")).alias("s")).collect()] == ["ok", "empty", "blocked"]


def test_small_csvs(spark, tmp_path):
    s = mf.splits(spark, put(tmp_path / "s", "a.csv", "code,date,ratio,last_trade,source\n0050,2024-01-03,4,2024-01-01,x\n")).first()
    assert (s.code, s.ratio, str(s.last_trade)) == ("0050", 4.0, "2024-01-01")
    assert mf.policy_rates(spark, put(tmp_path / "p", "a.csv", "d,r\n20240322,2.0\nx,1\n")).collect()[0].rate == 2.0
    assert [tuple(r) for r in mf.universe(spark, put(tmp_path / "u", "a.csv", "﻿ticker,name\n2330,臺甲-KY*\n")).collect()] == [("2330", "台甲")]
    assert [tuple(r) for r in mf.review_sheet(spark, put(tmp_path / "r", "a.csv", 'code,ok\n0050,""\n2330,1\n')).collect()] == [("0050", ""), ("2330", "1")]


def test_board_archive(spark, tmp_path):
    posts = [
        {"article_id": "M.1.A", "date": "2024-01-05 10:00:00", "author_id": "x", "title": "Re: [新聞] 2330 台甲", "content": "本文\n※ 引述 y\n: 引", "n_push": 1, "comments": [{"index": 4, "time": "2024-01-05 10:01:00", "user_id": "u", "tag_en": "push", "content": "讚"}, {"index": 5, "time": None, "user_id": "v", "content": "無"}, {"index": 6, "time": "2024-03-05 10:01:00", "user_id": "w", "tag_en": "boo", "content": "晚"}]},
        {"article_id": "M.2.A", "date": "2024-01-05 11:00:00", "author_id": "y", "title": "[閒聊] 別的", "content": "", "comments": [{"index": 0, "time": "2024-01-05 11:00:30", "user_id": "u", "tag_en": "arrow", "content": "台甲好"}, {"index": 1, "time": "2024-01-05 11:01:00", "user_id": "u", "tag_en": "arrow", "content": "12330"}]},
        {"article_id": "M.3.A", "title": "沒日期"},
    ]
    raw = board_files.archive(spark, put(tmp_path / "in", "stock_2024.jsonl", "\n".join(json.dumps(p, ensure_ascii=False) for p in posts)))
    board_files.write_archive(raw, str(tmp_path / "out"))
    a, c = (spark.read.parquet(str(tmp_path / "out" / t)) for t in ("articles", "comments"))
    assert {(r.article_id, r.author, r.category, r.is_reply, r.content, r.n_push, r.n_boo, r.year) for r in a.collect()} == {("M.1.A", "x", "新聞", True, "本文", 1, 0, 2024), ("M.2.A", "y", "閒聊", False, "", 0, 0, 2024)}
    assert {(r.article_id, r.idx, r.user, r.tag, r.lag_sec) for r in c.collect()} == {("M.1.A", 4, "u", "push", 60), ("M.1.A", 6, "w", "boo", 5184060), ("M.2.A", 0, "u", "arrow", 30), ("M.2.A", 1, "u", "arrow", 60)}
    got = {r.uid: r for r in board_files.texts_about(a, c, "2330", ["台甲"]).collect()}
    assert set(got) == {"A:M.1.A", "C:M.1.A:4", "C:M.2.A:0"}
    assert got["A:M.1.A"].text == "Re: [新聞] 2330 台甲\n本文" and (got["C:M.2.A:0"].title, got["C:M.2.A:0"].category) == ("[閒聊] 別的", "閒聊")
    put(tmp_path / "web", "1.json", {"article_id": "M.1704205800.A", "title": "[標的] 2330 已刪文", "body": "c\n: 引", "pushes": [{"t": "x"}, {"t": "y"}]})
    w = board_files.web_archive(spark, put(tmp_path / "web", "2.json", {"article_id": "M.1.A", "timestamp": 5, "title": "[閒聊]", "body": "x"}))
    assert [(r.article_id, r.n_comments, r.body) for r in w.collect()] == [("M.1704205800.A", 2, "c\n: 引")]
    assert board_files.target_posts(a).count() == 0
    both = {r.article_id: r for r in board_files.combined(a.select("article_id", "time", "author", "title", "content", "n_push", "n_boo"), w).collect()}
    assert both["M.1704205800.A"].content == "c" and both["M.1704205800.A"].n_comments_web == 2 and not both["M.1.A"].deleted
    assert both["M.1704205800.A"].deleted and both["M.1704205800.A"].title == "[標的] 2330" and both["M.1704205800.A"].in_right and not both["M.1.A"].in_right
    assert both["M.1704205800.A"].time == dt.datetime(2024, 1, 2, 22, 30)


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c.alias("x")).first().x
    t = F.col("t")
    assert one(tx.strip_quotes(t), "　甲\n ※ 引述 x\nex [標]\n：引\n※引述 z\nex  [標]\n照板規\n標題請使用以下格式:\r\n乙(例如)\n") == "甲\n乙"
    assert one(tx.strip_quotes(t), None) == ""
    titles = ("[標的] 2330 多", "2330 (空)", "多，空", "多空", "無", "[多] x", "2330-多", "多!", "2330 空。", "【空】", "x 多 空", None)
    assert [one(tx.title_direction(t), x) for x in titles] == ["bullish", "bearish", "bullish", None, None, None, "bullish", "bullish", "bearish", None, "bullish", None]
    heads = ("[新聞] a", "Re: [新聞 ] a", "Fw:[x]", "R: [x] a", "Re: Re: [x]", " [x]", "Re: a", "[] a", None)
    assert [one(F.struct(*tx.title_category(t)), x) for x in heads] == [("新聞", False), ("新聞", True), ("x", True), *[(None, False)] * 6]
    assert [one(tx.mentions(t, tx.mention_pattern("2330", ["台甲", "ABC"]), ["台甲乙"]), x) for x in ("2330!", "12330", "23301", "台甲", "台甲乙", "abc", None)] == [True, False, False, True, False, True, False]
    assert [one(tx.weak_label(t), x) for x in ("1. 標的\n2. 分類：多\n", "分類: 空", "分類：多/空", "無")] == ["bullish", "bearish", None, None]
    assert [one(tx.weak_label(t), x) for x in ("分類 : 多", "分類多", "分類：討論\n分類：多", "分類：空單 不是多x多")] == ["bullish", None, None, None]
    posts = spark.createDataFrame([("1", "標的", False, "分類：多\n" + "x" * 20), ("2", "標的", False, "分類：多\n" + "x" * 19), ("3", "標的", True, "分類：多\n" + "x" * 20), ("4", "標的", False, "x" * 30)], "article_id string, category string, is_reply boolean, content string").withColumn("time", F.lit(1))
    assert [tuple(r) for r in tx.labelled_posts(posts).collect()] == [("1", 1, "x" * 20, "bullish")]
    assert [one(tx.clean_markup(t), x) for x in ("&amp;eacute;<br>&#20013;  x", "a & b", None)] == ["é 中 x", "a & b", None]
    assert one(tx.without_label_lines(t), "a\n分類：多\nb") == "a\nb"
    assert one(tx.remove_words(t, ["ab", "cd"]), "cabd") == ""
    assert one(tx.norm_name(t), "臺甲-ky") == "台甲"


def test_lexicon_and_resolver(spark):
    score = tx.lexicon_scorer(["看多", "看多頭"], ["崩"], {"空": -1})
    texts = ["看多", "不會看多", "看多頭 崩", "崩崩看多", "空!", "平", None, "ＡＢ看多"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", score("t")).orderBy("i").collect()
    assert [None if r.s is None or r.s != r.s else round(r.s, 3) for r in got] == [1.0, -1.0, 0.0, -0.333, -1.0, None, None, 1.0]
    a, z = dt.date(2019, 1, 1), dt.date(2023, 12, 31)
    names = [("2603", "長榮", a, z), ("2618", "長榮航", a, z), ("2027", "大成", a, z), ("5871", "中租-KY", a, z), ("00653L", "富邦2X", a, z), ("2887", "台新金", a, dt.date(2022, 6, 30)), ("2887", "台新新光金", dt.date(2022, 7, 1), z), ("2050", "遠", a, z)]
    resolve = tx.name_resolver(names)
    titles = ["2603 長榮", "長榮航 漲", "長榮航 長榮", "2618", "2027 目標", "大成 2027", "[標的] 大盤 多", None, "中租", "00653L 多", "2050 看好", "12603", "期指", "台新金", "台新新光金"]
    want = [("2603", "code+name"), ("2618", "name"), (None, "multi"), ("2618", "code"), (None, "no_tw_stock"), ("2027", "code+name"), (None, "index"), (None, "no_tw_stock"), ("5871", "name"), ("00653L", "code"), (None, "no_tw_stock"), (None, "no_tw_stock"), (None, "index"), ("2887", "name"), (None, "no_tw_stock")]
    at = dt.datetime(2022, 1, 5, 10)
    got = spark.createDataFrame([(i, t, at) for i, t in enumerate(titles)], "i int, t string, at timestamp_ntz").withColumn("r", resolve("t", "at")).orderBy("i").collect()
    assert [(r.r.code, r.r.how) for r in got] == want
    day = spark.createDataFrame([(dt.datetime(2022, 7, 10),), (dt.datetime(2022, 7, 10, 1),), (None,)], "at timestamp_ntz").select(resolve(F.lit("台新金"), "at").alias("r")).collect()
    assert [r.r.code for r in day] == ["2887", None, None]


def test_matching(spark):
    texts = spark.createDataFrame([("1", "南亞科漲 1303"), ("2", "東南亞"), ("3", "x13035"), ("4", None), ("5", "統")], "k string, t string")
    names = spark.createDataFrame([("1303", "南亞"), ("2408", "南亞科"), ("9", "統"), ("0", "")], "code string, name string")
    got = {(r.k, r.code) for r in matching.name_hits(texts, "k", "t", names, "code", "name").collect()}
    assert got == {("1", "1303"), ("1", "2408"), ("2", "1303"), ("5", "9")}
    assert {(r.k, r.code) for r in matching.code_hits(texts, "k", "t", names, "code").collect()} == {("1", "1303")}
    assert [(r.code, r.longer) for r in matching.superstrings(names, "code", "name").collect()] == [("1303", "南亞科")]


def test_sinks(spark, tmp_path):
    d = spark.range(3).withColumn("y", F.col("id") % 2)
    sinks.write_table(d, str(tmp_path / "t"), ["y"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    sinks.write_new(d, str(tmp_path / "c"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_new(d, str(tmp_path / "c"))
    sinks.write_new(d, str(tmp_path / "c"), force=True)
    assert sinks.cached(spark, str(tmp_path / "k"), lambda: d).count() == 3
    assert sinks.cached(spark, str(tmp_path / "k"), lambda: 1 / 0).count() == 3
    seen = []
    work = lambda x: seen.append(x.count()) or x
    assert sinks.resume(spark, d.limit(2), "id", str(tmp_path / "s"), work).count() == 2
    assert sinks.resume(spark, d, "id", str(tmp_path / "s"), work).count() == 3 and seen == [2, 1]


def test_streams(spark, tmp_path):
    rows = [(1, " a", dt.datetime(2024, 1, 1)), (2, "a", dt.datetime(2024, 1, 2)), (3, "b", dt.datetime(2024, 1, 1)), (4, None, dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "id bigint, newsid string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, newsid string, at timestamp").parquet(str(tmp_path / "in"))
    q = deliveries.first_deliveries(stream, "newsid", "at").writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("firsts").collect()) == [1, 3]


def test_stream_corrections(spark, tmp_path):
    from boardlens.operators import rolling

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    a = rolling.daily_amounts(spark.createDataFrame([("a", day(n), 1.0) for n in range(40) if n != 20], "code string, date date, value double"), ["code"], "date", "value")
    path = str(tmp_path / "state")
    rolling.rolling_state(a, ["code"]).write.parquet(f"{path}/batch=0")
    late = spark.createDataFrame([("a", day(20), 5.0)], "code string, date date, value double")
    batch = rolling.daily_amounts(late, ["code"], "date", "value").select("code", "day", "sum", "n", "nz")
    deliveries.rolling_corrections(path, ["code"])(batch, 0)
    new = spark.read.parquet(f"{path}/batch=1").orderBy("day").collect()
    assert [r.day for r in new] == [day(n) for n in range(20, 40)] and float(new[0].sum7) == 11.0 and float(new[7].sum7) == 7.0 and new[0].version == 1
