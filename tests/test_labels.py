"""Answers of labelling services, evidence, timing; the remaining portfolio operators; settings."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from boardlens import config
from boardlens.operators import labels, matching, portfolio

T = dt.datetime


def test_answers_counts_cost(spark):
    rows = [(1, '{"label": "long", "cause_ids": ["N1"]}', "end", "m", 100, 10), (2, '{"label":', "end", "m", 100, None), (3, "", "refusal", "m", 1, 1), (4, None, "max_tokens", "x", 1, 1), (5, None, "end", "m", 0, 0)]
    d = spark.createDataFrame(rows, "id int, answer string, stop string, model string, input int, output int")
    p = labels.parse_answers(d, "answer", "stop", "label string, cause_ids array<string>").cache()
    assert {r.id: (r.status, r.label) for r in p.collect()} == {1: ("ok", "long"), 2: ("bad_json", None), 3: ("refusal", None), 4: ("max_tokens", None), 5: ("bad_json", None)}
    assert {(r.status, r.label): (r.n, r.share) for r in labels.label_counts(p, "label").collect()}[("ok", "long")] == (1, 1.0)
    cost = {r.model: r.cost for r in labels.usage_cost(p, "model", {"m": {"input": 1.0, "output": 5.0}}, half_price=True).collect()}
    assert cost["x"] is None and cost["m"] == pytest.approx((201 + 55) / 2e6)


def test_items_evidence_timing(spark):
    day = T(2024, 1, 5)
    items = spark.createDataFrame([("e", i, s, day + dt.timedelta(hours=h), f"t{i}") for i, (s, h) in enumerate([("news", 8), ("news", 10), ("news", 20), ("board", 9)])], "event string, item_id int, source string, time timestamp_ntz, text string")
    away = F.abs(F.unix_seconds(F.col("time").cast("timestamp")) - F.unix_seconds(F.lit(day + dt.timedelta(hours=9)).cast("timestamp")))
    near = labels.nearest_items(items, "event", away, {"news": 2, "board": 5}).cache()
    assert {(r.item_id, r.item_no) for r in near.collect()} == {(0, "N1"), (1, "N2"), (3, "B1")}
    text = labels.evidence(near, "event", labels.item_line()).first().evidence
    assert text.split("\n") == ["[N1] 01-05 08:00 news: t0", "[B1] 01-05 09:00 board: t3", "[N2] 01-05 10:00 news: t1"]
    said = spark.createDataFrame([("e", ["N2", "B1"]), ("f", []), ("g", None)], "event string, cause_ids array<string>")
    first = {r.event: r.first for r in labels.earliest_cause(said, near, "event").collect()}
    assert first == {"e": day + dt.timedelta(hours=9), "f": None, "g": None}
    times = spark.createDataFrame([(None,), (day + dt.timedelta(hours=8, minutes=59),), (day + dt.timedelta(hours=13, minutes=30),), (day + dt.timedelta(hours=14),)], "t timestamp_ntz")
    got = [r.x for r in times.select(labels.timing(F.col("t"), F.lit(dt.date(2024, 1, 5))).alias("x")).collect()]
    assert got == ["none", "before", "intraday", "after"]


def test_names(spark):
    checks = spark.createDataFrame([("1", "name", 1, False), ("1", "name", 2, True), ("1", "name", 2, False), ("1", "code", 1, None)], "code string, kind string, round int, ok boolean")
    assert [tuple(r) for r in labels.name_precision(checks).collect()] == [("1", "name", 0.5, 2)]
    named = spark.createDataFrame([("a", "1"), ("b", "1")], "item string, code string")
    tagged = spark.createDataFrame([("b", "1"), ("c", "1"), ("c", "2")], "item string, code string")
    assert {tuple(r) for r in labels.hit_stats(tagged, named).collect()} == {("1", 2, 1, 2, 0.5), ("2", 0, 0, 1, None)}


def test_leverage_and_deviation(spark):
    day = lambda i: dt.date(2024, 1, i)
    rets = spark.createDataFrame([(day(5), 0.01), (day(8), 0.02), (day(9), -0.01)], "date date, ret double")
    rates = spark.createDataFrame([(day(1), 2.0), (day(8), 5.0)], "date date, rate double")
    got = portfolio.leveraged(rets, rates, cost=0.01).orderBy("date").collect()
    assert [r.date for r in got] == [day(8), day(9)]
    assert math.expm1(got[0].ret) == pytest.approx(2 * math.expm1(0.02) + (0.02 - 0.01) * 3 / 365)
    assert math.expm1(got[1].ret) == pytest.approx(2 * math.expm1(-0.01) + (0.05 - 0.01) / 365)
    index = spark.createDataFrame([(day(i), 0.01) for i in range(1, 10)], "date date, ret double")
    fund = spark.createDataFrame([(day(1), 0.02), (day(2), 0.02), (day(5), math.log1p(2 * math.expm1(0.03))), (day(6), 0.3)], "date date, ret double")
    assert [r.date for r in portfolio.deviations(fund, index, 2.0).collect()] == [day(6)]


def test_yearly_choice_and_grid(spark):
    rows = [(s, dt.date(y, m, 1), r) for s, by in (("a", (0.02, -0.01, 0.0)), ("b", (0.01, 0.05, 0.0)), ("ref", (0.005, 0.0, 0.0))) for y, r in zip((2020, 2021, 2022), by, strict=True) for m in (1, 6)]
    d = spark.createDataFrame(rows, "strategy string, date date, net double")
    assert {r.year: r.strategy for r in portfolio.yearly_choice(d, "ref", 2021).collect()} == {2021: "a", 2022: "b", 2023: "b"}
    g = portfolio.with_strategies(d.select("date", "net").limit(2), {"long": F.lit(1), "none": F.lit(None)})
    assert sorted((r.strategy, r.position) for r in g.collect()) == [("long", 1.0), ("long", 1.0), ("none", None), ("none", None)] or g.count() == 4


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("data_dir: d\nx: 1\n")
    monkeypatch.delenv("BOARDLENS_DATA", raising=False)
    assert config.load_config(tmp_path / "c.yaml") == {"data_dir": str(tmp_path / "d"), "x": 1}
    (tmp_path / "d.yaml").write_text("data_dir: d\nwork_dir: w\noutput_dir: /tmp\n")
    cfg = config.load_config(tmp_path / "d.yaml")
    assert cfg["output_dir"] == "/tmp" and config.path_in(cfg, "work_dir", "a", "b").parent.is_dir()
    assert config.model_path(cfg, "weak", "2330") == config.model_path(cfg, "weak", "2603") != config.model_path(cfg, "own", "2330") and config.target_suffix("open_to_close") == "_oc"
    monkeypatch.setenv("BOARDLENS_DATA", "/abs")
    assert config.load_config(tmp_path / "c.yaml")["data_dir"] == "/abs"
    (tmp_path / ".env").write_text("A_KEY='v'\nB_KEY=\n# C_KEY=1\n")
    monkeypatch.delenv("A_KEY", raising=False)
    config.load_env(tmp_path / ".env")
    assert os.environ.pop("A_KEY") == "v" and "B_KEY" not in os.environ and "C_KEY" not in os.environ


def test_rules_and_sheets(spark):
    rules = spark.createDataFrame([("1303", "南亞", True, True, "南亞科/東南亞"), ("3008", "ABC光", True, False, ""), ("2008", "高興昌", False, True, "")], "code string, name string, by_name boolean, by_code boolean, exclude string")
    texts = spark.createDataFrame([("1", "南亞科 好"), ("2", "南亞與南亞科"), ("3", "東南亞"), ("4", "abc光 漲"), ("5", "1303!"), ("6", "3008"), ("7", "2008年 高興昌"), ("8", None)], "id string, title string")
    hits = matching.rule_hits(texts, "id", "title", rules)
    assert {tuple(r) for r in hits.collect()} == {("2", "1303"), ("4", "3008"), ("5", "1303"), ("7", "2008")}
    arts = spark.createDataFrame([("2", 1), ("9", 2)], "article_id string, time int")
    comms = spark.createDataFrame([("2", 0, 5, 60), ("2", 1, 6, 40 * 86400), ("9", 0, 7, 10)], "article_id string, idx int, time int, lag_sec bigint")
    said = spark.createDataFrame([("9", 0, "1303"), ("2", 0, "1303")], "article_id string, idx int, code string")
    items = matching.thread_items(arts, comms, hits.withColumnRenamed("id", "article_id"), said)
    assert sorted((r.code, r.time) for r in items.collect()) == [("1303", 1), ("1303", 5), ("1303", 7)]
    s = spark.createDataFrame([("1990", "長榮", 10, 0.5, 100), ("2330", "甲乙", 2, None, 30), ("2331", "甲乙丙", 2, None, 30), ("2332", "丁戊", 9, 0.9, 99)], "code string, name string, hits int, tag_frac double, board_hits int")
    flags = matching.name_flags(s)
    assert {r.code: (r.low_tag, r.no_news, r.code_year) for r in flags.collect()} == {"1990": (True, False, True), "2330": (False, True, False), "2331": (False, False, False), "2332": (False, False, False)}
    p = spark.createDataFrame([("1990", "code", 0.5), ("1990", "name", 0.9), ("2330", "name", 0.7), ("2332", "name", None)], "code string, kind string, precision double")
    final = {r.code: (r.by_name, r.by_code, r.by_title) for r in matching.match_rules(flags, p).collect()}
    assert final == {"1990": (True, False, False), "2330": (False, True, False), "2331": (True, True, True), "2332": (True, True, True)}


def test_sheets_for_checking(spark):
    hits = spark.createDataFrame([("a", f"t{i}") for i in range(5)] + [("b", "x"), ("b", "y")], "code string, title string")
    first = labels.check_sheet(hits, ["code"], F.col("title"), 3)
    assert sorted((r.code, r.title, r.n_hits) for r in first.collect()) == [("a", "t0", 5), ("a", "t1", 5), ("a", "t2", 5), ("b", "x", 2), ("b", "y", 2)]
    again = labels.recheck_sheet(hits, first.filter("title != 'y'"), ["code"], "title", F.col("title"), 2)
    assert sorted((r.code, r.title, r.from_first) for r in again.collect()) == [("a", "t3", 0), ("a", "t4", 0), ("b", "x", 1), ("b", "y", 0)]
    marks = labels.carried_marks(again.withColumn("ok", F.lit(None).cast("int")), first.withColumn("ok", F.lit(1)), ["code"], "title")
    assert {(r.title, r.ok) for r in marks.collect()} == {("t3", None), ("t4", None), ("x", 1), ("y", None)}
    checks = spark.createDataFrame([("1", "name", 1, 1), ("2", "name", 1, 0)], "code string, kind string, round int, ok int")
    gone = spark.createDataFrame([("2", "name")], "code string, kind string")
    assert {tuple(r) for r in labels.name_precision(checks, gone).collect()} == {("1", "name", 1.0, 1), ("2", "name", None, 0)}
