"""Visually identical text with different characters: one consistent form.

Most text is stable: a quick check by character properties finds the segments that aren't, only
those are normalised, together with the character before them that a combining mark may join, and
put back into the unchanged rest. The check of whole texts runs in the JVM; only texts with an
unstable character reach Python.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlens.session import cut

# Letters of other scripts that are drawn like Latin ones.
LATIN_LIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Ү": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "d",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
}
# Kana that are drawn like Chinese characters, and kana drawn alike.
CHINESE_LIKE = {"エ": "工", "オ": "才", "カ": "力", "タ": "夕", "チ": "千", "ト": "卜", "ニ": "二", "ハ": "八", "ロ": "口", "ー": "一", "ヌ": "又", "ム": "厶", "ノ": "丿", "ヘ": "へ"}
# Radicals without a decomposition and the character they show.
RADICALS = dict(zip("⺁⺄⺅⺆⺇⺈⺉⺊⺋⺌⺍⺎⺏⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺶⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "厂乙亻冂几刀刂卜㔾小小兀尣尢巳幺彑彐忄㣺扌攵旡日月歺民氵氺灬爫爫丬牛犭王疋罒示礻竹糹纟罓罒羊耂肀聿肉臼艹艹艹虎衤覀西见角角讠贝足车辶辶辶钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀", strict=True))
# Invisible marks that aren't format characters.
_BLANK_MARKS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
_BLANKS = "\t\n\x0b\x0c\r\x85  "
#: Texts of these characters only are stable for certain; the others are checked in full.
_SURE = r"\A(?! )[\x20-\x7EÀ-ÖØ-öø-ÿ㐀-䶿一-鿿、。〈-】]*+(?<! )\z"


@functools.cache
def _tables() -> tuple[dict[int, str | None], dict[int, str], re.Pattern[str]]:
    """What replaces single characters, what replaces letters once accents are split off, and the pattern of an unstable segment. By rule, over all of Unicode."""
    first: dict[int, str | None] = {}
    letters = {ord(k): v for k, v in (LATIN_LIKE | CHINESE_LIKE).items()}
    joins: set[int] = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    unstable: list[int] = []
    split: dict[int, str] = {}
    for n in range(sys.maxunicode + 1):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        kind, parts = unicodedata.category(c), unicodedata.decomposition(c).split()
        if c in _BLANKS or (kind == "Zs" and c != " "):
            first[n] = " "
        elif kind in ("Cf", "Cc") or c in _BLANK_MARKS or 0xE0100 <= n < 0xE01F0:
            first[n] = None
        elif parts[:1] in (["<wide>"], ["<narrow>"]) or (parts and 0x2E80 <= n < 0x2FE0):
            first[n] = "".join(chr(int(p, 16)) for p in parts[1:])
        elif c in RADICALS:
            first[n] = RADICALS[c]
        elif len(parts) == 2 and parts[0][0] != "<":
            joins.add(int(parts[1], 16))
        if parts and parts[0][0] != "<":
            split[n] = unicodedata.normalize("NFD", c)
    for n in range(sys.maxunicode + 1):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        if n in first or n in letters or n in joins or unicodedata.combining(c) or (n in split and (unicodedata.normalize("NFC", c) != c or any(ord(x) in letters for x in split[n]))):
            unstable.append(n)
    ranges, start = [], None
    for a, b in zip(unstable, [*unstable[1:], -1], strict=True):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    u = "".join(ranges)
    return first, letters, re.compile(f"[^{u}]?[{u}]+")


def _segment(found: re.Match[str]) -> str:
    first, letters, _ = _tables()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", found[0].translate(first)).translate(letters))


def canonical_text(text: str) -> str:
    """The consistent form of text: width, composition, invisible characters, kinds of blank, blanks at either end, compatibility and radical forms and the script of letters drawn alike don't count; all else does.

    A segment ends where a stable character follows, which joins nothing before it.
    """
    return _tables()[2].sub(_segment, text).strip(" ")


@F.arrow_udf(T.StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else canonical_text(t) for t in texts.to_pylist()], pa.string())


def canonical(text: Column) -> Column:
    """The consistent form of a text column; null stays null, and a text of nothing but invisible characters and blanks becomes empty."""
    sure = text.rlike(_SURE)
    return F.when(text.isNull() | sure, text).otherwise(_canonical(F.when(~sure, text)))


def look_alikes(df: DataFrame, key: str, text: str, by: list[str] | None = None) -> DataFrame:
    """(by, key_a, key_b): the pairs of rows with equal by whose texts look the same and differ in characters, key_a < key_b as strings.

    Each distinct text is brought into its form once, and forms with one text only are dropped, so
    that a title used a million times meets no other row unless it is also written differently;
    what is joined then is exactly what comes out. Rows with null text or key take no part; rows
    that share a key pair with each other's partners but not among themselves. by columns are
    compared as values, null being one.
    """
    by = list(by or [])
    ks = [f"__b{i}" for i in range(len(by))]
    rows = df.select(*[F.coalesce(F.concat(F.lit("v"), F.col(f"`{b}`").cast("string")), F.lit("")).alias(k) for b, k in zip(by, ks, strict=True)], F.col(f"`{key}`").cast("string").alias("__key"), F.col(f"`{text}`").alias("__text")).filter("__key is not null and __text is not null")
    forms = rows.select(*ks, "__text").distinct().withColumn("__form", canonical(F.col("__text")))
    forms = cut(forms)
    several = forms.groupBy(*ks, "__form").agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    forms = forms.join(several, [*ks, "__form"], "left_semi")
    pairs = forms.withColumnRenamed("__text", "__text_a").join(forms.withColumnRenamed("__text", "__text_b"), [*ks, "__form"]).filter("__text_a < __text_b").drop("__form")
    a, b = (rows.select(*ks, F.col("__text").alias(f"__text_{x}"), F.col("__key").alias(f"__key_{x}")).distinct() for x in "ab")
    met = pairs.join(a, [*ks, "__text_a"]).join(b, [*ks, "__text_b"]).filter("__key_a != __key_b")
    return met.select(*[F.expr(f"if(__b{i} = '', null, substr(__b{i}, 2))").alias(b_) for i, b_ in enumerate(by)], F.least("__key_a", "__key_b").alias("key_a"), F.greatest("__key_a", "__key_b").alias("key_b")).distinct()
