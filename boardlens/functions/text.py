"""Text functions for board posts, news and filings."""

from __future__ import annotations

import datetime as dt
import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How posts mark what isn't the author's own, and what titles and bodies hold.
QUOTED = r"(?U)^\s*(?:※\s*引述|[:：]|ex\s*\[)|板規|標題請使用以下格式"
TEMPLATE = r"[(（]例[^)）\n]*[)）]"
TITLE = r"(?U)^(Re:\s*|Fw:\s*)?\[([^\]]+)\]"
REPLY = r"(?U)^(?:\s*(?:Re|Fw|R|F):\s*)+"
DIRECTION = r"(?U)(?:^|[\s(（\]】\-－/])(多|空)(?:$|[\s)）】!！?？,，.。])"
LABEL = r"(?U)分類\s*[:：]\s*([^\n]{0,8})"
STOCK_CODE = r"(?<![0-9A-Za-z])([0-9]{4}|00[0-9]{2,4}[A-Z]?)(?![0-9])"
YEARS = r"(?:19|20)[0-9][0-9]"
INDEX = r"大盤|台指|加權指數|期指|小台|微台|台股指數"
TARGET = "[標的]"
LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BLANKS = "[\\s　]"


def literal(word: str) -> str:
    """word as a pattern, for Java's expressions."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", word)


def strip_quotes(text: Column) -> Column:
    """text without quoted lines, lines of the board's template, hints in parentheses that begin with 例, and outer blanks; empty for null."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), LINES), lambda x: ~x.rlike(QUOTED))
    return trim_blanks(F.regexp_replace(F.array_join(lines, "\n"), TEMPLATE, ""))


def trim_blanks(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def title_category(title: Column) -> tuple[Column, Column]:
    """(category, is_reply) of a title that begins with [category], or Re: or Fw: before it; without a category it is no reply."""
    has = F.coalesce(title.rlike(TITLE), F.lit(False))
    return F.when(has, trim_blanks(F.regexp_extract(title, TITLE, 2))), has & (F.coalesce(F.regexp_extract(title, TITLE, 1), F.lit("")) != "")


def strip_reply(title: Column) -> Column:
    return F.regexp_replace(title, REPLY, "")


def norm_text(x: Column) -> Column:
    return F.translate(x, "臺", "台")


def norm_name(x: Column) -> Column:
    """A stock's name without marks (*, -KY, -DR) and in one spelling."""
    return norm_text(F.regexp_replace(F.replace(x, F.lit("*"), F.lit("")), r"(?i:-(?:KY|DR))$", ""))


def code_pattern(code: str) -> str:
    """The code, not within a longer number."""
    return f"(?:^|[^0-9]){literal(code)}(?:[^0-9]|$)"


def mention_pattern(code: str, aliases: Sequence[str]) -> str:
    """The code or any alias, whatever the case."""
    return "(?i)(?:" + "|".join([code_pattern(code), *map(literal, aliases)]) + ")"


def mentions(text: Column, pattern: str, exclude: Sequence[str] = ()) -> Column:
    """Whether pattern stands in text once the words of exclude are gone; false for null."""
    t = F.regexp_replace(text, "|".join(map(literal, exclude)), "") if exclude else text
    return F.coalesce(t.rlike(pattern), F.lit(False))


def remove_words(x: Column, words: Sequence[str]) -> Column:
    """x without each word, one after the other: what a removal brings together may go with a later one."""
    for w in words:
        x = F.replace(x, F.lit(w), F.lit(""))
    return x


def title_direction(title: Column) -> Column:
    """bullish or bearish where exactly one of 多 and 空 stands between delimiters, the marker [標的] being one, else null. A delimiter serves one of two neighbours only."""
    found = F.array_distinct(F.regexp_extract_all(F.replace(title, F.lit(TARGET), F.lit(" ")), F.lit(DIRECTION), F.lit(1)))
    return F.when(F.size(found) == 1, F.when(found[0] == "多", "bullish").otherwise("bearish"))


def weak_label(content: Column) -> Column:
    """bullish or bearish: of the up to 8 characters after the first 分類 with a colon, 多 xor 空; else null."""
    part = F.regexp_extract(content, LABEL, 1)
    long, short = part.contains("多"), part.contains("空")
    return F.when(long & ~short, "bullish").when(short & ~long, "bearish")


def without_label_lines(content: Column) -> Column:
    return trim_blanks(F.array_join(F.filter(F.split(F.coalesce(content, F.lit("")), LINES), lambda x: ~x.contains("分類")), "\n"))


def labelled_posts(posts: DataFrame, least: int = 20) -> DataFrame:
    """(article_id, time, text, label) of first posts of the category 標的 with a label of their own and at least `least` characters beside its lines."""
    own = posts.filter("category = '標的' and not is_reply").withColumn("label", weak_label(F.col("content"))).filter("label is not null")
    return own.select("article_id", "time", without_label_lines(F.col("content")).alias("text"), "label").filter(F.char_length("text") >= least)


def clean_markup(x: Column, limit: int | None = None) -> Column:
    """Entities resolved twice, tags dropped, blanks collapsed; of the result the first `limit` characters, if given."""
    x = F.trim(F.regexp_replace(F.regexp_replace(unescaped(x), "<[^>]*>", " "), f"{BLANKS}+", " "))
    return x if limit is None else F.substring(x, 1, limit)


def unescaped(x: Column) -> Column:
    """x with all HTML entities resolved, twice; the rest of the texts, without a &, doesn't go to Python."""
    twice = F.pandas_udf(lambda s: s.map(html_text, na_action="ignore"), T.StringType())
    return F.when(x.contains("&"), twice(x)).otherwise(x)


def table_rows(page: Column) -> Column:
    """The cells of a page's odd and even table rows, an array per row."""
    rows = F.regexp_extract_all(page, F.lit(r"(?s)<tr class=['\"]?(?:even|odd)['\"]?[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "&nbsp;", " "), f"{BLANKS}+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), cell))


def filing_rows(pages: DataFrame, page: str) -> DataFrame:
    """(code, time, seq_no, subject) of company pages: rows of five cells and more whose second is an ROC day."""
    from boardlens.functions.parse import roc_day

    r = pages.select(*[c for c in pages.columns if c != page], F.explode(table_rows(F.col(page))).alias("c")).filter(F.size("c") >= 5)
    day = roc_day(F.col("c")[1])
    rest = [c for c in pages.columns if c not in (page, "code")]
    return r.select(*rest, F.col("c")[0].alias("code"), F.concat_ws(" ", day.cast("string"), F.col("c")[2]).try_cast("timestamp_ntz").alias("time"), F.col("c")[3].try_cast("int").alias("seq_no"), F.col("c")[4].alias("subject")).filter("time is not null")


def html_text(x: str) -> str:
    return html.unescape(html.unescape(x))


def lexicon_scorer(positive: Sequence[str], negative: Sequence[str], solo: dict[str, int] | None = None, negations: str = "不沒別未無"):
    """A column function: (p - n) / (p + n) over terms, longest first and without overlap, null without any.

    A term's sign turns if one of negations stands in the three characters before it. solo gives
    the sign of texts that, without punctuation, are one such character. Text is taken in NFKC
    form and lower case. Terms are matched where they stand, which no built-in function tells, so
    that texts go to Python by Arrow batches; score distinct texts.
    """
    fold = lambda t: unicodedata.normalize("NFKC", t).lower()
    sign = {fold(w): 1 for w in positive} | {fold(w): -1 for w in negative}
    pattern = re.compile("|".join(map(re.escape, sorted(sign, key=len, reverse=True))) or "(?!)")
    solo = solo or {}

    def one(t: str | None) -> float | None:
        if t is None:
            return None
        t = fold(t)
        bare = re.sub(r"[\W_]", "", t)
        if bare in solo:
            return float(solo[bare])
        p = n = 0
        for m in pattern.finditer(t):
            s = sign[m[0]] * (-1 if any(c in negations for c in t[max(0, m.start() - 3) : m.start()]) else 1)
            p, n = p + (s > 0), n + (s < 0)
        return (p - n) / (p + n) if p + n else None

    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t) if isinstance(t, str) else None).astype("float64")

    return F.pandas_udf(score, T.DoubleType())


#: Names a resolver holds in each task: a market lists thousands.
MOST_NAMES = 500_000


def bounded_names(listed: DataFrame) -> list[tuple[str, str, dt.date, dt.date]]:
    """(code, name, first, last) of panel.listed_names as a list; an error beyond MOST_NAMES."""
    rows = [tuple(r) for r in listed.select("code", "name", "first", "last").limit(MOST_NAMES + 1).collect()]
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return rows


def name_resolver(names: list[tuple[str, str, dt.date, dt.date]], pad: int = 10):
    """A column function (title, time) -> struct(code, how): the one stock that a title names on its day.

    names: (code, name, first day, last day), as panel.listed_names has them; one counts within pad
    days around. how is code+name, code, name, multi, index or no_tw_stock; code is null for the
    last three. Codes are of four digits or an ETF's; one that could be a year counts only beside
    its name. Names are tried longest first, each hit taken out, also without their -KY; those
    shorter than two characters don't count. Names are found by their first two characters, so that
    a title is tried with few of them.
    """
    code_re, index_re, year_re = re.compile(STOCK_CODE), re.compile(INDEX), re.compile(YEARS)
    slack = dt.timedelta(days=pad)
    listed = sorted(names)
    forms = [(n, c, a, z) for c, n, a, z in listed] + [(n[:-3], c, a, z) for c, n, a, z in listed if n.endswith("-KY")]
    by_start: dict[str, list[tuple]] = {}
    for rank, form in enumerate(sorted(forms, key=lambda f: -len(f[0]))):
        if len(form[0]) >= 2:
            by_start.setdefault(form[0][:2], []).append((rank, form))
    by_code: dict[str, list[tuple]] = {}
    for c, n, a, z in listed:
        by_code.setdefault(c, []).append((n, a, z))

    def there(first: dt.date, last: dt.date, at: dt.datetime) -> bool:
        return dt.datetime.combine(first, dt.time()) <= at + slack and dt.datetime.combine(last, dt.time()) >= at - slack

    def one(title: str | None, at: dt.datetime | None) -> tuple[str | None, str]:
        t = (title or "").replace(TARGET, " ")
        codes, rest = set(), code_re.sub(" ", t)
        for c in code_re.findall(t) if at is not None else ():
            own = [n for n, a, z in by_code.get(c, ()) if there(a, z, at)]
            if own and not (year_re.fullmatch(c) and own[-1] not in t):
                codes.add(c)
        starts = {rest[i : i + 2] for i in range(len(rest) - 1)}
        hits = set()
        for _, (n, c, a, z) in sorted(f for s in starts for f in by_start.get(s, ())) if at is not None else ():
            if n in rest and there(a, z, at):
                hits.add(c)
                rest = rest.replace(n, " ")
        both = codes | hits
        if not both:
            return None, "index" if index_re.search(t) else "no_tw_stock"
        if len(both) > 1:
            return None, "multi"
        return both.pop(), "code+name" if codes and hits else "code" if codes else "name"

    def resolve(titles: pd.Series, times: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t if isinstance(t, str) else None, None if pd.isna(at) else at.to_pydatetime()) for t, at in zip(titles, times, strict=True)], columns=["code", "how"])

    return F.pandas_udf(resolve, T.StructType([T.StructField("code", T.StringType()), T.StructField("how", T.StringType())]))
