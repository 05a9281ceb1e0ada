"""Numbers as words: English, Mandarin, Japanese and Hindi readings.

The kernels are plain functions of one number; `spelled` runs one over the distinct values of a column only. What fits
Column expressions (four-digit kana readings, digit by digit readings) has such a form as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = dict(zip(ONES[1:13], "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split(), strict=True))
_SMALL_ILLIONS = "m b tr quadr quint sext sept oct non".split()
_ILLION_UNITS = ["", "un", "duo", "tre", "quattuor", "quin", "sex", "sept", "octo", "novem"]
_ILLION_TENS = "dec vigint trigint quadragint quinquagint sexagint septuagint octogint nonagint".split()
#: Names of 1000 ** n, from n = 1.
SCALES = ["thousand", *(s + "illion" for s in [*_SMALL_ILLIONS, *(u + t for t in _ILLION_TENS for u in _ILLION_UNITS), "cent"])]

# Numerals of other languages.
HANZI = "零一二三四五六七八九"
HANZI_UNITS = ["", "十", "百", "千"]
KANA_ONES = "ゼロ,いち,に,さん,よん,ご,ろく,なな,はち,きゅう".split(",")
KANA_HUNDREDS = {1: "ひゃく", 3: "さんびゃく", 6: "ろっぴゃく", 8: "はっぴゃく"}
KANA_THOUSANDS = {3: "さんぜん", 8: "はっせん"}
KANA_TOO_LONG = "Number length too long, choose less than 10 digits"


def _below_thousand(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    parts = [f"{ONES[hundreds]} hundred"] if hundreds else []
    if rest or not hundreds:
        tens, ones = divmod(rest, 10)
        parts.append(ONES[rest] if rest < 20 else TENS[tens - 2] + (f"-{ONES[ones]}" if ones else ""))
    return " and ".join(parts)


def cardinal(n: int) -> str:
    """1234: one thousand, two hundred and thirty-four. The last group joins with "and" below a hundred, else a comma."""
    if n < 0:
        return "minus " + cardinal(-n)
    groups: list[int] = []
    while n or not groups:
        n, g = divmod(n, 1000)
        groups.append(g)
    if len(groups) > len(SCALES) + 2 or (len(groups) == len(SCALES) + 2 and groups[-1] == 0):
        raise OverflowError("the number is beyond the names of scales")
    if len(groups) == len(SCALES) + 2:  # thousands of the last scale
        groups[-2:] = [groups[-2] + 1000 * groups[-1]]
    out = ""
    for k in range(len(groups) - 1, -1, -1):
        g = groups[k]
        if g or (k == 0 and not out):
            text = (cardinal(g) if g >= 1000 else _below_thousand(g)) + (f" {SCALES[k - 1]}" if k else "")
            out += (" and " if k == 0 and g < 100 else ", ") * bool(out) + text
    return out


def ordinal(n: int) -> str:
    head, sep, last = re.fullmatch(r"(?s)(.*?)([ -]?)([a-z]+)", cardinal(n)).groups()
    return head + sep + (ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th"))


def year(n: int) -> str:
    high, low = divmod(n, 100)
    if not high or high >= 100 or (high % 10 == 0 and low < 10):
        return cardinal(n)
    return f"{cardinal(high)} " + ("hundred" if not low else f"oh-{cardinal(low)}" if low < 10 else cardinal(low))


def decimal(x: float) -> str:
    """The integer part, "point" and the digits of the shortest text that reads back as x."""
    if x == int(x):
        return cardinal(int(x))
    mantissa, _, exponent = repr(abs(x)).partition("e")
    digits = mantissa.split(".")[1] if "." in mantissa else ""
    shift = -int(exponent or 0)
    if shift > 0:
        digits = ("0" * (shift - 1) + mantissa.replace(".", "")).rstrip("0")
    whole = int(x)
    return cardinal(whole) + " point " + " ".join(ONES[int(d)] for d in digits)


def replay_words(n: int, british: bool = False) -> list[str]:
    """Number words one by one; only the British reading has "and"."""
    out: list[str] = []
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand")):
        if n >= size:
            out += [*replay_words(n // size, british), name]
            n %= size
            if not n:
                return out
            if british and n < 100:
                out.append("and")
    if n >= 100:
        out += [ONES[n // 100], "hundred"]
        n %= 100
        if not n:
            return out
        if british:
            out.append("and")
    return out + ([TENS[n // 10 - 2], *([ONES[n % 10]] if n % 10 else [])] if n >= 20 else [ONES[n]])


# -- Mandarin


def ascii_digits(digits: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in digits)


def hanzi_digits(digits: str) -> str:
    return "".join(HANZI[int(d)] for d in ascii_digits(digits))


def hanzi_legacy(digits: str) -> str:
    """By groups of four; a gap of zeros inside reads as one zero. Above 16 digits, digit by digit."""
    if len(digits) > 16:
        return hanzi_digits(digits)
    if not digits.strip("0"):
        return HANZI[0]
    out = ""
    names = ["", "万", "亿", "万亿"]
    for g in range((len(digits) - 1) // 4, -1, -1):
        group = digits[max(0, len(digits) - 4 * g - 4) : len(digits) - 4 * g]
        if not group.strip("0"):
            continue
        if out and (len(group) < 4 or group[0] == "0"):
            out += HANZI[0]
        for i, d in enumerate(group):
            if d != "0":
                out += HANZI[int(d)] + HANZI_UNITS[len(group) - 1 - i]
            elif out and out[-1] != HANZI[0] and group[i:].strip("0"):
                out += HANZI[0]
        out += names[g]
    out = out.rstrip(HANZI[0])
    return out[1:] if out.startswith("一十") else out


def hanzi_integer(digits: str) -> str | None:
    """Digit and unit for each place, then zeros are thinned out in fixed steps; none above 16 digits."""
    digits = ascii_digits(digits).lstrip("0") or "0"
    if len(digits) > 16:
        return None
    out = ""
    for i, d in enumerate(digits):
        place = len(digits) - i - 1
        unit = {0: "", 4: "万", 8: "亿", 12: "万"}.get(place, HANZI_UNITS[place % 4])
        if d != "0":
            out += HANZI[int(d)] + unit
        else:
            out += HANZI[0] + unit if place % 4 == 0 else ""
            out += HANZI[0] if i and out[-1] != HANZI[0] else ""
    for old, new in (("零零", "零"), ("零万", "万"), ("零亿", "亿"), ("亿万", "亿")):
        out = out.replace(old, new)
    out = re.sub("([万亿])零([一二三四五六七八九壹贰叁肆伍陆柒捌玖][千仟])", r"\1\2", out.strip(HANZI[0]))
    return (out[1:] if out.startswith("一十") else out) or HANZI[0]


def hanzi_number(number: str) -> str | None:
    minus, digits = number.startswith("-"), number.removeprefix("-")
    whole, dot, rest = digits.partition(".")
    made = hanzi_integer(whole)
    return None if made is None else "负" * minus + made + (("点" + hanzi_digits(rest.split(".")[0][:16])) if dot else "")


# Measure words before which a dash means "to".
MEASURES = "斤|克|千克|公斤|吨|米|厘米|毫米|公里|升|毫升|元|角|分|个|只|条|张|块|瓶|杯|份|本|辆|台|匹|头|位|亩|小时|分钟|秒|天|半"


def _both(m: re.Match, sep: str, read: Callable, join: str) -> str:
    parts = m[0].split(sep)
    read_parts = [read(p) for p in parts] if len(parts) == 2 else [None]
    return m[0] if None in read_parts else join.format(*read_parts)


def hanzi_numbers(text: str) -> str:
    """Ranges, dates, fractions, percentages, degrees, then what numbers remain, in this order."""
    keep = lambda form: lambda m: m[0] if (n := hanzi_number(m[0].rstrip("%℃"))) is None else form.format(n)
    text = re.sub(rf"\d+(?:\.\d+)?-\d+(?:\.\d+)?(?=(?:{MEASURES}))", lambda m: _both(m, "-", hanzi_number, "{}到{}"), text)
    date = lambda m: m[0] and re.sub(r"\d+", lambda d: hanzi_integer(d[0]), re.sub(r"\d+(?=年)", lambda y: hanzi_digits(y[0]), m[0]))
    text = re.sub(r"(?:\d{2,4}年)?(?:\d{1,2}月)?(?:\d{1,2}日)?", date, text)
    text = re.sub(r"\d+/\d+", lambda m: _both(m, "/", hanzi_integer, "{1}分之{0}"), text)
    text = re.sub(r"-?(?:\d+\.)?\d+%", keep("百分之{}"), text)
    text = re.sub(r"\d+℃", keep("{}摄氏度"), text)
    return re.sub(r"-?(?:\d+\.)?\d+", keep("{}"), text)


def hanzi_numbers_legacy(text: str) -> str:
    text = re.sub(r"(\d+)年", lambda m: hanzi_digits(m[1]) + "年", text)
    return re.sub(r"(\d+)(\.\d+)?", lambda m: hanzi_legacy(ascii_digits(m[1])) + ("点" + hanzi_digits(m[2][1:]) if m[2] else ""), text)


# -- Japanese


def _kana_below(n: int, alone: bool) -> str:
    """1 to 9999."""
    thousands, rest = divmod(n, 1000)
    out = ""
    if thousands:
        out = ("せん" if alone else "いっせん") if thousands == 1 else KANA_THOUSANDS.get(thousands, KANA_ONES[thousands] + "せん")
    hundreds, rest = divmod(rest, 100)
    if hundreds:
        out += KANA_HUNDREDS.get(hundreds, KANA_ONES[hundreds] + "ひゃく")
    tens, ones = divmod(rest, 10)
    if tens:
        out += ("" if tens == 1 else KANA_ONES[tens]) + "じゅう"
    return out + (KANA_ONES[ones] if ones else "")


def kana_number(digits: str) -> str:
    """Up to nine digits; the thousand is いっせん but where it stands alone."""
    if len(digits) > 9:
        return KANA_TOO_LONG
    n = int(ascii_digits(digits))
    if n < 10000:
        return _kana_below(n, True) if n else KANA_ONES[0]
    high, low = divmod(n, 10000)
    oku, man = divmod(high, 10000)
    return (KANA_ONES[oku] + "おく" if oku else "") + (_kana_below(man, False) + "まん" if man else "") + (_kana_below(low, False) if low else "")


# -- Hindi


def hindi_number(digits: str, slots: dict[tuple[str, int], str]) -> str:
    """slots: (slot, n) -> phonemes. N whole numbers to 99, NH hundreds, NT what follows a hundred, NF the last group
    after higher ones, NG multiples of a scale, ND single digits, NS scales by power of ten."""
    digits = "".join(str(unicodedata.digit(c)) for c in digits)
    one = [slots["ND", int(d)] for d in digits]
    if digits[0] == "0" or len(digits) > 13:
        return " ".join(one) if len(one) == 2 else f"{one[0]}{one[1]} {one[2]}" if len(one) == 3 else "".join(one)
    n, out = int(digits), []
    for power in (11, 9, 7, 5, 3):
        g = n // 10**power % 100
        if g:
            out.append(f"{slots['NG', g]} {slots['NS', power]}")
    last = n % 1000
    if last:
        if last < 100:
            out.append(slots["NF" if n >= 1000 else "N", last])
        else:
            out.append(slots["NH", last // 100] + (f" {slots['NT', last % 100]}" if last % 100 else ""))
    return " ".join(out)


# -- columns


def spelled(df: DataFrame, value: str, into: str, read: Callable) -> DataFrame:
    """Adds the reading of a column's values; each distinct value is read once. The distinct values are hash-partitioned
    and the join back is an equi-join, so nothing is collected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_value": b["_value"], into: [read(v) for v in b["_value"]]})

    kind = df.schema[value].dataType.simpleString()
    distinct = df.select(F.col(value).alias("_value")).filter("_value IS NOT NULL").distinct()
    return df.join(distinct.mapInPandas(run, f"_value {kind}, `{into}` string"), F.col(value) == F.col("_value"), "left").drop("_value")


def hanzi_digits_column(digits: Column) -> Column:
    return F.translate(digits, "0123456789", HANZI)


def fold_digits(text: Column) -> Column:
    """Devanagari digits as ASCII ones."""
    return F.translate(text, "०१२३४५६७८९", "0123456789")


def kana_column(n: Column) -> Column:
    """0 to 9999 without leaving the JVM."""
    pick = lambda d, names: F.element_at(F.array(*map(F.lit, names)), (d + 1).cast("int"))
    digit = lambda power: F.pmod(F.floor(n / power), F.lit(10))
    thousands = ["", "せん", *(KANA_THOUSANDS.get(d, KANA_ONES[d] + "せん") for d in range(2, 10))]
    hundreds = ["", *(KANA_HUNDREDS.get(d, KANA_ONES[d] + "ひゃく") for d in range(1, 10))]
    tens = ["", "じゅう", *(KANA_ONES[d] + "じゅう" for d in range(2, 10))]
    return F.when(n == 0, KANA_ONES[0]).otherwise(F.concat(pick(digit(1000), thousands), pick(digit(100), hundreds), pick(digit(10), tens), pick(digit(1), ["", *KANA_ONES[1:]])))


def cardinal_column(n: Column) -> Column:
    """0 to 999,999 as English words without leaving the JVM."""
    words = F.array(*map(F.lit, [_below_thousand(i) for i in range(100)]))
    pick = lambda d: F.element_at(words, (d + 1).cast("int"))

    def below(x: Column) -> Column:
        hundreds, rest = F.floor(x / 100), F.pmod(x, F.lit(100))
        return F.concat_ws(" and ", F.when(hundreds > 0, F.concat(pick(hundreds), F.lit(" hundred"))), F.when((rest > 0) | (hundreds == 0), pick(rest)))

    thousands, rest = F.floor(n / 1000), F.pmod(n, F.lit(1000))
    joint = F.when((thousands == 0) | (rest == 0), "").when(rest < 100, " and ").otherwise(", ")
    return F.concat(F.when(thousands > 0, F.concat(below(thousands), F.lit(" thousand"))).otherwise(""), joint, F.when((rest > 0) | (thousands == 0), below(rest)).otherwise(""))


def year_column(n: Column) -> Column:
    high, low = F.floor(n / 100), F.pmod(n, F.lit(100))
    tail = F.when(low == 0, "hundred").when(low < 10, F.concat(F.lit("oh-"), cardinal_column(low))).otherwise(cardinal_column(low))
    return F.when((high == 0) | (high >= 100) | ((F.pmod(high, F.lit(10)) == 0) & (low < 10)), cardinal_column(n)).otherwise(F.concat_ws(" ", cardinal_column(high), tail))
