"""Exchange, futures, index, news and filing files, as tables of one form each.

Schemas are stated, never inferred; numbers come as text and are read tolerantly. Where files
repeat a key, the last by file name counts, whatever order they are read in; of daily quotes the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.functions import text as tx
from boardlens.functions.parse import number, roc_day
from boardlens.operators.frames import gated, ordered
from boardlens.operators.joins import as_of

_TABLES = "tables array<struct<title: string, fields: array<string>, data: array<array<string>>>>"
_ROWS = "fields array<string>, data array<array<string>>"
# Names of columns in exchange files.
TWSE_DAY = {"code": "證券代號", "name": "證券名稱", "volume": "成交股數", "value": "成交金額", "open": "開盤價", "high": "最高價", "low": "最低價", "close": "收盤價"}
TPEX_DAY = {"code": "代號", "name": "名稱", "volume": "成交股數", "value": "成交金額(元)", "open": "開盤", "high": "最高", "low": "最低", "close": "收盤", "shares": "發行股數", "ref_next": "次日參考價", "limit_up_next": "次日漲停價"}
_TEXT = ("code", "name")
INDICES = {"taiex": "發行量加權股價指數", "taiex_tr": "發行量加權股價報酬指數"}
CODES = r"^(?:[1-9][0-9]{3}|00[0-9]{2,4}[A-Z]?)$"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__file", F.col("_metadata.file_name"))


def _file_day() -> Column:
    return F.to_date(F.regexp_extract("__file", r"(\d{8})", 1), "yyyyMMdd")


def last_file_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of the greatest file name."""
    row = F.struct(*[c for c in df.columns if c not in ("__file", *keys)])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct("__file", row)).alias("__r")).select(*keys, "__r.*")


def first_row_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of the least file name, and there the first."""
    row = F.struct(*[c for c in df.columns if c not in ("__file", "__at", *keys)])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct("__file", "__at")).alias("__r")).select(*keys, "__r.*")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(__file, __at, r): the rows of files that are a bare list of lists, or an object with such a list as data; any cell as text."""
    t = spark.read.text(path, wholetext=True).withColumn("__file", F.col("_metadata.file_name"))
    bare, within = F.from_json("value", "array<array<string>>"), F.from_json("value", _ROWS)["data"]
    return t.select("__file", F.posexplode(F.when(F.ltrim("value").startswith("["), bare).otherwise(within)).alias("__at", "r"))


def day_quotes(spark: SparkSession, path: str, columns: dict[str, str], market: str) -> DataFrame:
    """(date, code, market, ...) of daily quote files: the tables whose fields hold the code's column, their cells taken by name."""
    t = _json(spark, path, _TABLES)
    bare = lambda xs: F.transform(xs, lambda n: F.regexp_replace(n, r"\s+", ""))
    own = F.filter("tables", lambda x: F.exists(bare(x["fields"]), lambda n: n == columns["code"]))
    rows = t.select("__file", _file_day().alias("date"), F.posexplode(own).alias("__p", "t")).select("__file", "date", "__p", bare(F.col("t.fields")).alias("f"), F.posexplode("t.data").alias("__q", "r")).withColumn("__at", F.struct("__p", "__q"))
    cell = lambda name: F.get("r", (F.nullif(F.array_position("f", name), F.lit(0)) - 1).cast("int"))
    out = rows.select("__file", "__at", "date", *[(F.trim(cell(n)) if c in _TEXT else number(cell(n))).alias(c) for c, n in columns.items()], F.lit(market).alias("market"))
    return first_row_wins(out.filter(F.col("code").rlike(CODES)), ["date", "code", "market"])


def day_indices(spark: SparkSession, path: str) -> DataFrame:
    """(date, taiex, taiex_tr) of daily quote files: levels of the price and the return index, by the rows' names."""
    t = _json(spark, path, _TABLES)
    own = F.filter("tables", lambda x: x["fields"][0].isin("指數", "報酬指數"))
    rows = t.select(_file_day().alias("date"), F.explode(own).alias("t")).select("date", F.explode("t.data").alias("r")).select("date", F.trim(F.get("r", F.lit(0))).alias("name"), number(F.get("r", F.lit(1))).alias("level"))
    return rows.groupBy("date").agg(*[F.max(F.when(F.col("name") == n, F.col("level"))).alias(c) for c, n in INDICES.items()])


def index_levels(spark: SparkSession, path: str) -> DataFrame:
    """(date, open, high, low, close) of monthly index files: ROC day first, close last in each row; the others are null in files of levels alone."""
    rows = listed(spark, path)
    cell = lambda i: F.when(F.size("r") >= 5, number(F.get("r", F.lit(i))))
    return last_file_wins(rows.select("__file", roc_day(F.trim(F.col("r")[0])).alias("date"), cell(1).alias("open"), cell(2).alias("high"), cell(3).alias("low"), number(F.element_at("r", -1)).alias("close")).filter("date is not null"), ["date"])


def reference_prices(spark: SparkSession, exrights: str, reductions: str | None = None) -> DataFrame:
    """(code, date, ref): ex-rights reference prices by position, over which those of capital reductions win; of each kind the last row of the last file. A last row without a price takes the others away."""
    ref = listed(spark, exrights).withColumn("__p", F.lit(0))
    if reductions:
        ref = ref.unionByName(listed(spark, reductions).withColumn("__p", F.lit(1)))
    ref = ref.select("__p", "__file", "__at", F.trim(F.get("r", F.lit(1))).alias("code"), roc_day(F.trim(F.get("r", F.lit(0)))).alias("date"), number(F.get("r", F.lit(4))).alias("ref"))
    ref = ref.filter("code is not null and date is not null")
    return ref.groupBy("code", "date").agg(F.max_by("ref", F.struct("__p", "__file", "__at")).alias("ref")).filter("ref is not null")


def dispositions(spark: SparkSession, path: str, code: int = 2, period: int = 6) -> DataFrame:
    """(code, start, end) of disposition files, periods written start～end in ROC days; rows that can't be read are left out, repeats count once."""
    r = listed(spark, path)
    ends = F.split(F.get("r", F.lit(period)), "[～~]")
    return r.select(F.trim(F.get("r", F.lit(code))).alias("code"), roc_day(F.trim(F.get(ends, F.lit(0)))).alias("start"), roc_day(F.trim(F.get(ends, F.lit(1)))).alias("end")).filter("start is not null and end is not null").distinct()


def vendor_daily(spark: SparkSession, path: str) -> DataFrame:
    """(date, code, open, high, low, close, volume, value) of rows with a price and a volume."""
    s = "date string, stock_id string, open double, max double, min double, close double, Trading_Volume double, Trading_money double"
    v = spark.read.schema(f"data array<struct<{s.replace(' ', ': ').replace(',: ', ', ')}>>").option("multiLine", True).json(path)
    v = v.select(F.inline("data")).select(F.col("date").try_cast("date").alias("date"), F.col("stock_id").alias("code"), "open", F.col("max").alias("high"), F.col("min").alias("low"), "close", F.col("Trading_Volume").alias("volume"), F.col("Trading_money").alias("value"))
    return v.filter("close > 0 and volume > 0")


def chart_daily(spark: SparkSession, path: str, zone: str = "America/New_York") -> DataFrame:
    """(date, adj, high, low, volume) of chart files: parallel arrays with epoch seconds, days of the exchange's zone; rows that lack a price are dropped."""
    q = "quote: array<struct<high: array<double>, low: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>"
    c = spark.read.schema(f"chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<{q}>>>>").option("multiLine", True).json(path)
    c = c.select(F.explode("chart.result").alias("r")).select(F.arrays_zip(F.col("r.timestamp").alias("ts"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("adj"), F.col("r.indicators.quote")[0]["high"].alias("high"), F.col("r.indicators.quote")[0]["low"].alias("low"), F.col("r.indicators.quote")[0]["volume"].alias("volume")).alias("z"))
    return c.select(F.inline("z")).select(F.to_date(F.from_utc_timestamp(F.timestamp_seconds("ts"), zone)).alias("date"), "adj", "high", "low", "volume").dropna(subset=["date", "adj", "high", "low"])


def news_pages(spark: SparkSession, path: str, zone: str = "Asia/Taipei", limit: int | None = None) -> DataFrame:
    """(newsid, time, title, content, stock) of news pages; one row per identifier, of the last file."""
    item = "newsId: string, publishAt: bigint, title: string, content: string, stock: array<string>"
    n = _json(spark, path, f"items struct<data: array<struct<{item}>>>").select("__file", F.explode("items.data").alias("i"))
    n = n.select("__file", F.trim("i.newsId").alias("newsid"), F.from_utc_timestamp(F.timestamp_seconds("i.publishAt"), zone).cast("timestamp_ntz").alias("time"), "i.title", tx.clean_markup(F.col("i.content"), limit).alias("content"), "i.stock")
    return last_file_wins(n.filter("newsid is not null"), ["newsid"])


def futures_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, contract, session, open, high, low, close, volume, settle) of futures files: month contracts only, a comma at each line's end.

    Column names are stated; files whose own header differs are read by position all the same.
    """
    names = ["day", "product", "contract", "open", "high", "low", "close", "change", "change_pct", "volume", "settle", "open_interest", "bid", "ask", "hist_high", "hist_low", "halt", "session", "spread", "rest"]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).option("enforceSchema", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    nums = [number(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume", "settle")]
    return raw.select(F.coalesce(F.expr("try_to_date(day, 'yyyy/MM/dd')"), F.expr("try_to_date(day, 'yyyy-MM-dd')")).alias("date"), F.trim("contract").alias("contract"), F.trim("session").alias("session"), *nums).filter(F.col("contract").rlike("^[0-9]{6}$") & F.col("date").isNotNull())


def night_sessions(rows: DataFrame, day: str = "一般", night: str = "盤後") -> DataFrame:
    """(date, contract, n_range, n_abs, n_lvol): of each night the contract with the most volume, its range, its move from the same contract's close of the day session before, and its volume against the 20 nights before."""
    n = rows.filter(F.col("session") == night)
    top = n.groupBy("date").agg(F.max_by(F.struct("contract", "high", "low", "close", "volume"), F.struct("volume", "contract")).alias("m")).select("date", "m.*")
    days = rows.filter(F.col("session") == day).select(F.col("date").alias("__d"), "contract", F.col("close").alias("__c"))
    one = lambda d: d.withColumn("__k", F.lit(1))
    before = as_of(one(top.select("date").distinct()), one(days.select("__d").distinct()), ["__k"], "date", "__d", ["__d"], strict=True).drop("__k")  # one row per day and side
    j = top.join(before, "date", "left").join(days, ["__d", "contract"], "left")
    w = ordered([], "date")
    spread = F.when((F.col("high") > F.col("low")) & (F.col("low") > 0), F.log(F.log(F.col("high") / F.col("low"))))
    lv = F.when(F.col("volume") > 0, F.log("volume"))
    return j.select("date", "contract", spread.alias("n_range"), F.when(F.col("__c") > 0, F.abs(F.log(F.col("close") / F.col("__c")))).alias("n_abs"), (lv - gated(F.avg(lv), lv, w.rowsBetween(-20, -1), 20)).alias("n_lvol"))


def filing_pages(spark: SparkSession, path: str) -> DataFrame:
    """(code, time, seq_no, subject) of company pages <code>_<year>[_<month>].html: monthly files stand in for the yearly one; repeats count once."""
    p = spark.read.text(path, wholetext=True).withColumn("__f", F.col("_metadata.file_name"))
    stem = F.regexp_replace("__f", r"\.[^.]*$", "")
    p = p.select("value", F.split(stem, "_").alias("s")).select("value", F.concat_ws("_", F.col("s")[0], F.col("s")[1]).alias("unit"), (F.size("s") > 2).alias("monthly"))
    covered = p.filter("monthly").select("unit").distinct()
    use = p.filter("monthly").select("value").unionByName(p.filter("not monthly").join(covered, "unit", "left_anti").select("value"))
    return tx.filing_rows(use, "value").dropDuplicates(["code", "time", "seq_no", "subject"])


def page_status(page: Column) -> Column:
    """blocked, empty or ok."""
    return F.when(page.contains("查詢過於頻繁") | page.contains("THE PAGE CANNOT BE ACCESSED"), "blocked").when(page.contains("查無") | (F.size(tx.table_rows(page)) == 0), "empty").otherwise("ok")


def splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("code string, date date, ratio double, last_trade date, source string").option("header", True).csv(path)


def policy_rates(spark: SparkSession, path: str) -> DataFrame:
    """(date, rate): days of change, in percent as written."""
    r = spark.read.schema("day string, rate string").option("header", True).csv(path)
    return r.select(F.expr("try_to_date(day, 'yyyyMMdd')").alias("date"), number(F.col("rate")).alias("rate")).dropna()


def universe(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) of a list of names; a byte order mark is none of the first column's name, as columns are read by position."""
    u = spark.read.schema("code string, name string").option("header", True).option("enforceSchema", True).csv(path)
    return u.select(F.trim("code").alias("code"), tx.norm_name(F.trim("name")).alias("name"))


def review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with all columns as text, empty cells as empty text."""
    return spark.read.option("header", True).option("nullValue", "\x00").option("emptyValue", "").csv(path).na.fill("")
