"""Redelivery, rolling state, intervals, CSV lines, drift: against brute force, and the odd cases."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from boardlens import session
from boardlens.operators import intervals, redelivery, rolling
from boardlens.sources import csv_lines, drift


# redelivery
def test_keep_one_and_repeats(spark):
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = [(1, " a", t(1), "x"), (2, "a ", t(2), "y"), (3, "a", t(2), "z"), (4, None, t(1), "n"), (5, None, t(1), "n"), (6, "b", None, None), (7, "b", t(0), "w"), (8, "c", None, "v"), (9, "c", None, "u"), (10, "", t(1), "e"), (11, " ", t(0), "e")]
    df = spark.createDataFrame(rows, "id bigint, newsid string, at timestamp, title string").withColumn("__key", F.lit(1)).withColumn("__row", F.lit(2))
    kept = redelivery.keep_one(df, "newsid", "at", "id")
    assert sorted(r.id for r in kept.collect()) == [3, 4, 5, 7, 9, 10]
    assert kept.columns == df.columns
    assert sorted(r.id for r in redelivery.repeats(df, "newsid", "at", "id").collect()) == [1, 2, 6, 8, 11]
    assert redelivery.keep_one(df.limit(0), "newsid", "at", "id").count() == 0


def test_keep_one_text_order_and_equal_rows(spark):
    df = spark.createDataFrame([("a", "2024", "x"), ("a", "2025", "y"), ("a", "2025", "y")], "k string, v string, i string")
    assert [tuple(r) for r in redelivery.keep_one(df, "k", "v", "i").collect()] == [("a", "2025", "y")]


def test_hash_aggregation_is_planned(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "id bigint, k string, at timestamp")
    for kept in (redelivery.kept_ids, redelivery.keep_one):
        plan = kept(df, "k", "at", "id")._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


# rolling state
def _rows(seed):
    r = random.Random(seed)
    day = lambda n: dt.date(2023, 1, 1) + dt.timedelta(days=n)
    rows = []
    for code in "ABC":
        for n in range(100):
            if r.random() < 0.4 and not 40 <= n < 75:
                value = r.choice([None, 0.0, 1.5, 2.25, -3.0, float("nan")])
                late = 20 if r.random() < 0.2 else 0
                rows += [(code, day(n), value, dt.datetime.combine(day(n + late), dt.time(12)))] * r.choice([1, 1, 2])
    return rows


def _brute(rows, n):
    by = defaultdict(dict)
    for c, d, v, _ in rows:
        by[c][d] = None if v is None or v != v else v
    out = {}
    for c, days in by.items():
        d, first = min(days), min(days)
        while d <= max(days):
            span = [days[x] for k in range(n) if (x := d - dt.timedelta(days=k)) in days and days[x] is not None]
            out[c, d] = (Decimal(str(sum(span))).quantize(Decimal("0.000001")), len(span), sum(1 for v in span if v), first)
            d += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def amounts(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "code string, date date, value double, at timestamp").withColumn("sum", F.lit("clash"))
    return rows, rolling.daily_amounts(df, ["code"], "date", "value", arrived="at").cache()


@pytest.mark.parametrize("n", [7, 30])
def test_state_against_brute_force(amounts, n):
    rows, a = amounts
    got = {(r.code, r.day): (r[f"sum{n}"], r[f"n{n}"], r[f"nz{n}"], r.first_day) for r in rolling.rolling_state(a, ["code"]).collect()}
    assert got == _brute(rows, n)


def test_versions(amounts):
    rows, a = amounts
    both = rolling.rolling_state(a, ["code"], superseded=True).collect()
    late = {(c, d) for c, d, _, at in rows if (at.date() - d).days > 1}
    touched = {(r.code, r.day) for r in both if r.version == 1}
    assert touched == {(r.code, r.day) for r in both if any((r.code, r.day - dt.timedelta(days=k)) in late for k in range(30))}
    on_time = _brute([x for x in rows if (x[0], x[1]) not in late], 7)
    assert all(r.sum7 == on_time[r.code, r.day][0] for r in both if r.version == 0 and (r.code, r.day) in on_time)


def test_advance_and_correct_reach_the_same_state(spark, amounts):
    rows, a = amounts
    full = rolling.rolling_state(a, ["code"]).cache()
    parts = ["sum", "n", "nz"]
    whole = a.select("code", "day", *[(F.col(p) + F.col(f"late_{p}")).cast(dict(a.dtypes)[p]).alias(p) for p in parts]).cache()
    cols = ["code", *[f"{p}{n}" for n in (7, 30) for p in parts]]
    day = dt.date(2023, 3, 1)
    state = full.filter(F.col("day") == day - dt.timedelta(days=1))
    for k in range(3):
        d = day + dt.timedelta(days=k)
        expiring = {n: whole.filter(F.col("day") == d - dt.timedelta(days=n)) for n in (7, 30)}
        state = rolling.advance_day(state, whole.filter(F.col("day") == d), expiring, ["code"], str(d)).cache()
        assert sorted(tuple(r) for r in state.select(*cols).collect()) == sorted(tuple(r) for r in full.filter(F.col("day") == d).select(*cols).collect())
    both = rolling.rolling_state(a, ["code"], superseded=True)
    late = a.filter("late").select("code", "day", *[F.col(f"late_{p}").alias(p) for p in parts])
    fixed = rolling.correct(both.filter("version = 0"), late, ["code"])
    assert sorted(map(tuple, fixed.select("day", *cols).collect())) == sorted(map(tuple, both.filter("version = 1").select("day", *cols).collect()))


@pytest.mark.parametrize("block_days", [1, 32, 64])
def test_state_by_blocks(spark, amounts, block_days):
    rows = [x for x in amounts[0] if block_days > 1 or x[1] < dt.date(2023, 1, 12)]
    df = spark.createDataFrame(rows, "code string, date date, value double, at timestamp")
    a = rolling.daily_amounts(df, ["code"], "date", "value", arrived="at", block_days=block_days, buckets=3)
    kept = rolling.State(spark, ["code"], block_days=block_days, buckets=3)
    got = kept.replay(a)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for n in (7, 30):
        assert {(r.code, r.day): (r[f"sum{n}"], r[f"n{n}"], r[f"nz{n}"], r.first_day) for r in got.collect()} == _brute(rows, n)
    close = lambda d: ((d - dt.date(1970, 1, 1)).days // block_days + 1) * block_days - 1
    late = {(c, d) for c, d, _, at in rows if (at.date() - dt.date(1970, 1, 1)).days - close(d) > 1}
    assert {(r.code, r.day) for r in got.collect() if r.version == 1} == {(r.code, r.day) for r in got.collect() if any((r.code, r.day - dt.timedelta(days=k)) in late for k in range(30))}
    assert late
    session.drop_table(spark, f"{kept.name}_states")


def test_steps_join_without_a_shuffle(spark, amounts):
    df = spark.createDataFrame(amounts[0], "code string, date date, value double, at timestamp")
    kept = rolling.State(spark, ["code"], block_days=64, buckets=3)
    kept.own.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plans, append = [], kept.append
    kept.append = lambda rows, table: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), append(rows, table))
    kept.replay(rolling.daily_amounts(df, ["code"], "date", "value", arrived="at", block_days=64, buckets=3))
    assert len(plans) in (6, 8)  # amounts, days, and of each block its states and their corrections
    assert all(p.count("ShuffledHashJoin") == (1 if i % 2 else 4) and "Exchange" not in p for i, p in enumerate(plans[2:]))
    session.drop_table(spark, f"{kept.name}_states")


def test_tiny_and_huge_figures_count(spark):
    values = [1e-9, -1e-300, 1e22, 0.0, -0.0, float("inf"), float("nan"), None, 2.5]
    df = spark.createDataFrame([(str(i), dt.date(2023, 1, 1), v) for i, v in enumerate(values)], "code string, date date, value double")
    got = {int(r.code): (r.sum7, r.n7, r.nz7) for r in rolling.rolling_state(rolling.daily_amounts(df, ["code"], "date", "value"), ["code"]).collect()}
    no = (Decimal(0), 0, 0)
    assert got == {0: (Decimal(0), 1, 1), 1: (Decimal(0), 1, 1), 2: (Decimal(10) ** 22, 1, 1), 3: (Decimal(0), 1, 0), 4: (Decimal(0), 1, 0), 5: no, 6: no, 7: no, 8: (Decimal("2.5"), 1, 1)}
    with pytest.raises(Exception, match="beyond decimal"):
        rolling.daily_amounts(df.withColumn("value", F.lit(1e33)), ["code"], "date", "value").collect()


def test_rolling_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, dt.date(2023, 1, 1), 1.0), ("a", None, 1.0)], "code string, date date, value double")
    assert rolling.rolling_state(rolling.daily_amounts(df, ["code"], "date", "value"), ["code"]).count() == 0
    assert rolling.State(spark, ["code"]).replay(rolling.daily_amounts(df, ["code"], "date", "value")).count() == 0


# intervals
@pytest.mark.parametrize("levels", [2, 5, 16])
def test_periods_against_brute_force(spark, levels):
    r = random.Random(levels)
    rows = [(c, s, s + r.choice([-1, 0, 0, 1, 5, 30])) for c in ["a", "b", None] for s in [r.randint(-100, 300) for _ in range(30)]]
    rows += [("a", None, 3), ("a", 3, None), ("z", 5, 4), ("long", -1000, 1000), *rows[:10]]
    df = spark.createDataFrame(rows, "code string, start int, end int").withColumn("__lvl", F.lit("clash"))
    days = defaultdict(set)
    for c, s, e in rows:
        if s is not None and e is not None:
            days[c].update(range(s, e + 1))
    want, holes = set(), set()
    for c, d in days.items():
        runs, last = [], None
        for x in sorted(d):
            if last is None or x > last + 1:
                runs.append([x, x])
            runs[-1][1] = last = x
        want |= {(c, s, e) for s, e in runs}
        holes |= {(c, a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:], strict=False)}
    got = intervals.periods(df, ["code"], "start", "end", levels)
    assert {tuple(x) for x in got.collect()} == want
    assert {tuple(x) for x in intervals.gaps(got, ["code"], "start", "end").collect()} == holes
    both = [tuple(x) for x in intervals.with_gaps(got, ["code"], "start", "end").collect()]
    assert len(both) == len(set(both)) and set(both) == {(c, "period", s, e) for c, s, e in want} | {(c, "gap", s, e) for c, s, e in holes}


def test_periods_empty(spark):
    assert intervals.periods(spark.createDataFrame([], "code string, start int, end int"), ["code"], "start", "end").count() == 0


# CSV lines
FEEDS = {"q": csv_lines.Feed(numbers=("pe",), span=("open", "close")), "d": csv_lines.Feed(days=("start",))}


def _line_frame(spark, files):
    rows = [(f"{f}{i}" if i != 1 else f"{f}head", "d" if f.startswith("d") else "q", f, i, raw) for f, lines in files.items() for i, raw in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "line_id string, feed string, file string, line_no int, raw string")


def test_reasons(spark):
    files = {
        "q1": ["code,open,close", "1,2,3", '"1","2,000.5",--', "1,2", "1,2,3,4", "", None, '1,"2,3', '1,"2"x,3', '1,2"3,4', '1,"a""b",3', "1,-2,3", "1, 2,3", "1,1234,12,3", '1,"12,34",3', "1,,---", '"a\nb",1,2', '1,"",""'],
        "q2": ["open,note,close,pe", "1,2,3,4", "x,2,3,4", '1,"a, ""b""",3,x', "1,,,"],
        "d1": ["code,start", "1,110/02/28", "1,110/02/29", "1,109年2月29日", "1,110-02-01", "1,", "1,00/00/00", "1,1100/1/1", "1,１10/1/1"],
        "q3": ['"open', "1"],
        "q4": ["open"],
        "q5": ["c1,c2,c3,c4", "", " ", "1,2,3,4"],
    }
    df = csv_lines.classify_lines(_line_frame(spark, files).withColumn("names", F.lit("clash")), FEEDS)
    got = {r.line_id: r.reason for r in df.collect()}
    q, n, v = "quoting", "column_count", "value"
    want = {"q1": [None, None, n, n, n, n, q, q, q, v, v, v, n, v, None, None, None], "q2": [None, v, v, None], "d1": [None, v, None, v, v, v, v, v], "q3": [n], "q5": [n, n, None]}
    assert got == {f"{f}{i}": r for f, rs in want.items() for i, r in enumerate(rs, 2)}


def test_lines_without_a_number(spark):
    rows = [("h", 1, "code,open"), ("good", None, "1,2"), ("value", None, "1,x"), ("count", None, "1"), ("zero", 0, "1,2,3"), ("two", 2, "1,2")]
    df = spark.createDataFrame([(i, "q", "q1", n, raw) for i, n, raw in rows], "line_id string, feed string, file string, line_no int, raw string")
    c = csv_lines.classify_lines(df, {"q": csv_lines.Feed(numbers=("open",))})
    assert sorted((r.line_id, r.reason) for r in csv_lines.bad_lines(c).collect()) == [("count", "column_count"), ("value", "value"), ("zero", "column_count")]
    assert sorted(r.line_id for r in csv_lines.good_rows(c).collect()) == ["good", "two"]


def test_values_and_kept_columns(spark):
    df = csv_lines.classify_lines(_line_frame(spark, {"q1": ["code,open,open", '1,"2",3', "1,2"]}).withColumn("extra", F.lit(7)), {})
    good = csv_lines.good_rows(df).collect()
    assert [(r.extra, r["values"]) for r in good] == [(7, {"code": "1", "open": "2"})]
    assert [r.reason for r in csv_lines.bad_lines(df).collect()] == ["column_count"]


def test_long_line_and_empty(spark):
    df = _line_frame(spark, {"q1": ["code,open", '"' + 'ab""' * 100_000 + '",1', "x" * 300_000 + ",1", '"' + "x" * 300_000]})
    assert [r.reason for r in csv_lines.classify_lines(df, FEEDS).orderBy("line_no").collect()] == [None, None, "quoting"]
    assert csv_lines.classify_lines(df.limit(0), FEEDS).count() == 0


# drift
def test_changes(spark):
    f = lambda seq, fields, *data: (seq, "f", seq, fields, [list(r) for r in data])
    files = [
        f(1, ["code", "day", "ref"], ("1", "110/01/01", "5")),
        f(2, ["co de", "day", "price"], ("1", "110/01/02", "--")),
        f(3, None),
        f(4, None, ("1", "2021-01-04", "NT5")),
        f(5, ["day", "price", "code"], ("2021-01-05", "NT6", "2")),
        f(6, ["day", "code"], ("2021-01-06", "2")),
        f(7, ["day", "code", "price", None], ("110年1月7日", "x", "5", None)),
        f(7, ["day", "code", "price", None], ("110年1月7日", "x", "5", None)),
    ]
    df = spark.createDataFrame(files, "file_id bigint, feed string, seq int, fields array<string>, data array<array<string>>").withColumn("own", F.lit("clash"))
    got = sorted(tuple(r)[1:] for r in drift.changes(df).collect())
    assert got == sorted([(2, "price", "renamed"), (4, "day", "retyped"), (4, "price", "retyped"), (6, "price", "removed"), (7, "price", "added"), (7, "", "added"), (7, "day", "retyped"), (7, "code", "retyped")])
    t = drift.common_table(df, [drift.Target("price", "number", ("price", "ref")), drift.Target("day", "day", ("day",))]).orderBy("seq").collect()
    assert [(r.seq, r.price, str(r.day), r.failed) for r in t] == [(1, 5.0, "2021-01-01", []), (2, None, "2021-01-02", []), (4, None, "2021-01-04", ["price"]), (5, None, "2021-01-05", ["price"]), (6, None, "2021-01-06", []), (7, 5.0, "2021-01-07", [])]
    assert drift.changes(df.limit(0)).count() == 0


def test_changes_across_missing_files(spark):
    rows = [(1, ["a", "b"], [["1", "x"]]), (3, None, [["x", "y"]]), (4, ["a", "c"], [["z", "--"]]), (9000, ["a", "d"], [["2", "3"]]), (20000, ["d"], [["4"]])]
    df = spark.createDataFrame([(s, f, s, *r) for s, *r in rows for f in ("f", "g")], "file_id bigint, feed string, seq int, fields array<string>, data array<array<string>>")
    want = [(3, "a", "retyped"), (4, "c", "renamed"), (9000, "a", "retyped"), (9000, "d", "renamed"), (9000, "d", "retyped"), (20000, "a", "removed")]
    assert sorted(tuple(r) for r in drift.changes(df).collect()) == sorted((f, *w) for w in want for f in ("f", "g"))
    assert {(r.seq, tuple(r.names)) for r in drift.file_names(df).filter("feed = 'f'").collect()} == {(1, ("a", "b")), (3, ("a", "b")), (4, ("a", "c")), (9000, ("a", "d")), (20000, ("d",))}


def test_common_table_keeps_every_value(spark):
    rows = [(1, None, [["7"]]), (2, ["a", "new", "a", "b"], [["1", "n", "2", "x", "5"], ["--", "", "3", "4"]]), (3, ["old a", "a"], [["NT6", "8"], ["NT6", "y"], None])]
    df = spark.createDataFrame([(s, "f", s, *r) for s, *r in rows], "file_id bigint, feed string, seq int, fields array<string>, data array<array<string>>")
    t = drift.common_table(df, [drift.Target("a", "number", ("a", "olda")), drift.Target("b", "text", ("b",))]).collect()
    got = {(r.seq, r.row_no): (r.a, r.b, r.failed, [tuple(x) for x in r.rest]) for r in t}
    assert got == {
        (1, 0): (None, None, [], [(1, None, "7")]),
        (2, 0): (1.0, "x", [], [(2, "new", "n"), (3, "a", "2"), (5, None, "5")]),
        (2, 1): (None, "4", [], [(3, "a", "3")]),
        (3, 0): (8.0, None, [], [(1, "olda", "NT6")]),
        (3, 1): (None, None, ["a"], [(1, "olda", "NT6"), (2, "a", "y")]),
        (3, 2): (None, None, [], []),
    }


def test_drift_with_nulls(spark):
    rows = [(1, None, 1, ["a"], [["1"]]), (2, "f", None, ["a"], [["1"]]), (3, "f", 1, None, None), (4, "f", 2, ["a", None], [None, ["1"], ["1", "2", "3"]]), (5, "f", 3, ["a", "b"], [["x", "2"]]), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "file_id bigint, feed string, seq int, fields array<string>, data array<array<string>>")
    assert sorted(tuple(r) for r in drift.changes(df).collect()) == [("f", 3, "a", "retyped"), ("f", 3, "b", "renamed")]
    t = drift.common_table(df, [drift.Target("a", "number", ("a",))]).collect()
    assert sorted((r.seq, r.row_no, r.a, r.failed) for r in t) == [(2, 0, None, []), (2, 1, 1.0, []), (2, 2, 1.0, []), (3, 0, None, ["a"])]


def test_inherit_long_chain(spark):
    from boardlens.operators.ancestry import inherit

    nodes = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.when(F.col("id").isin(5, 250), F.col("id")).alias("v"))
    got = {r.id: r.v for r in inherit(nodes, ["id"], ["up"], "v").collect()}
    assert got == {i: None if i < 5 else 5 if i < 250 else 250 for i in range(300)}
