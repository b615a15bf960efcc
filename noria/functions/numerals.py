"""Numbers, dates, times, shares and amounts of money as Egyptian Arabic words.

Single numbers are built-in expressions; running text takes one Arrow-batched function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import alphabet as A
from .arabic import let


def _small(n: Column) -> Column:
    """Words of 0 to 999, from a list made on the driver and folded into a constant."""
    return F.element_at(F.split(F.lit("|".join(A.below_thousand())), "[|]"), n.cast("int") + 1)


def digit_by_digit(digits: Column) -> Column:
    for d, word in enumerate(A.ONES):
        digits = F.replace(digits, F.lit(str(d)), F.lit(word + " "))
    return F.trim(digits)


def _and(head: Column, rest: Column, words: Column) -> Column:
    return F.when(rest == 0, head).otherwise(F.concat(head, F.lit(" و"), words))


def _below_million(n: Column) -> Column:
    thousands, rest = F.floor(n / 1000), n % 1000
    head = F.when(thousands == 1, "الف").when(thousands == 2, "الفين").when(thousands <= 10, F.concat(_small(thousands), F.lit(" تلاف"))).otherwise(F.concat(_small(thousands), F.lit(" الف")))
    return F.when(n < 1000, _small(n)).otherwise(_and(head, rest, _small(rest)))


def number_words(n: Column) -> Column:
    """Words of a whole number; from 10**9 on digit by digit."""
    return let(n.cast("long"), _number_words)


def _number_words(n: Column) -> Column:
    m = F.abs(n)
    millions, rest = F.floor(m / 1_000_000), m % 1_000_000
    head = F.when(millions == 1, "مليون").when(millions == 2, "اتنين مليون").otherwise(F.concat(_small(millions), F.lit(" مليون")))
    words = F.when(m < 1_000_000, _below_million(m)).when(m < 1_000_000_000, _and(head, rest, _below_million(rest))).otherwise(digit_by_digit(m.cast("string")))
    return F.when(n < 0, F.concat(F.lit("سالب "), words)).otherwise(words)


def digit_words(digits: Column) -> Column:
    """Words of a string of digits; more than nine are read one by one."""
    return F.when(F.length(digits) > 9, digit_by_digit(digits)).otherwise(number_words(F.when(F.length(digits) <= 9, digits).cast("long")))


def decimal_words(token: Column) -> Column:
    """Words of digits with or without a point."""
    whole, part = F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2))
    return F.when(token.contains("."), F.concat(digit_words(F.when(whole == "", "0").otherwise(whole)), F.lit(" فاصلة "), digit_words(part))).otherwise(digit_words(token))


# ``expand`` replaces matches by computed words, rule after rule. Spark has no such replacement, and as
# nested expressions ten rules take minutes to plan; one Arrow-batched function does it in one pass.
# What counts as a number, a date and a time of day.
_NUMBER = r"\d+(?:\.\d+)?"
_AR = "؀-ۿ"
_DMY = re.compile(r"\b(?P<d>\d{1,2})[/-](?P<m>\d{1,2})[/-](?P<y>\d{4})\b")
_YMD = re.compile(r"\b(?P<y>\d{4})[/-](?P<m>\d{1,2})[/-](?P<d>\d{1,2})\b")
_CLOCK = re.compile(r"(?P<said>الساع[ةه]\s+)?\b(?P<h>\d{1,2}):(?P<m>\d{2})\b")
_SMALL = A.below_thousand()


def spoken(n: int) -> str:
    """As ``number_words``, for one number."""
    if n < 0:
        return "سالب " + spoken(-n)
    if n >= 10**9:
        return spoken_digits(str(n))
    parts = []
    millions, n = divmod(n, 10**6)
    thousands, units = divmod(n, 1000)
    if millions:
        parts.append({1: "مليون", 2: "اتنين مليون"}.get(millions) or _SMALL[millions] + " مليون")
    if thousands:
        parts.append({1: "الف", 2: "الفين"}.get(thousands) or _SMALL[thousands] + (" تلاف" if thousands <= 10 else " الف"))
    if units or not parts:
        parts.append(_SMALL[units])
    return " و".join(parts)


def spoken_digits(digits: str) -> str:
    """As ``digit_by_digit``."""
    return " ".join(A.ONES[int(d)] for d in digits)


def spoken_token(token: str) -> str:
    """As ``decimal_words``."""
    whole, point, part = token.partition(".")
    said = [spoken_digits(x) if len(x) > 9 else spoken(int(x or 0)) for x in (whole, part)]
    return " فاصلة ".join(said) if point else said[0]


def _said_date(m: re.Match) -> str:
    month = int(m["m"])
    return f"{spoken(int(m['d']))} {A.MONTHS[month - 1]} سنة {spoken(int(m['y']))}" if 1 <= month <= 12 else m[0]


def _said_clock(m: re.Match) -> str:
    hour, minute = int(m["h"]), int(m["m"])
    if hour > 24 or minute > 59:
        return m[0]
    return (m["said"] or "الساعة ") + spoken(hour) + (f" و{spoken(minute)} دقيقة" if minute else "")


def _said_with(ending: str):
    return lambda m: f"{spoken_token(m[1])} {ending}"


#: (signs, pattern, replacement), applied one after the other to texts that have one of the signs; to all for "".
_WITHIN = [
    (",٬", re.compile(r"[,٬](?<=\d[,٬])(?=\d{3}(?!\d))"), ""),
    ("٫", re.compile(r"٫(?<=\d٫)(?=\d)"), "."),
]
#: A space between Arabic characters and digits. Where Arabic digits are both, pairs count from the left.
_FOREIGN_DIGIT = re.compile(f"[{A.ARABIC_DIGITS}{A.PERSIAN_DIGITS}]")
_PAIRS = [("", re.compile(rf"([{_AR}])(\d)"), r"\1 \2"), ("", re.compile(rf"(\d)([{_AR}])"), r"\1 \2")]
_APART = [("", re.compile(rf"\d(?<=[{_AR}]\d)"), r" \g<0>"), ("", re.compile(rf"\d(?=[{_AR}])"), r"\g<0> ")]
_RULES = [
    ("/-", _DMY, _said_date),
    ("/-", _YMD, _said_date),
    (":", _CLOCK, _said_clock),
    ("%٪", re.compile(rf"({_NUMBER})\s*[%٪]"), _said_with("في المية")),
]
for _sign, _word in A.CURRENCIES.items():
    _RULES += [(_sign, re.compile(rf"{re.escape(_sign)}\s*({_NUMBER})"), _said_with(_word)), (_sign, re.compile(rf"({_NUMBER})\s*{re.escape(_sign)}"), _said_with(_word)), (_sign, re.compile(re.escape(_sign)), f" {_word} ")]
_RULES += [("", re.compile(r"\d+(?:\.\d+)?"), lambda m: spoken_token(m[0]))]
_ANY_DIGIT = re.compile(r"\d")


def expanded(text: str) -> str:
    if not _ANY_DIGIT.search(text):
        return text
    for signs, pattern, new in (*_WITHIN, *(_PAIRS if _FOREIGN_DIGIT.search(text) else _APART), *_RULES):
        if not signs or any(c in text for c in signs):
            text = pattern.sub(new, text)
    return " ".join(text.split())


@F.pandas_udf(StringType())
def _expand(text: pd.Series) -> pd.Series:
    return text.map(expanded, na_action="ignore")


def expand(text: Column) -> Column:
    """All numbers, dates, times, shares and amounts as words. Texts without a digit stay as they are, and don't leave the JVM."""
    digits = text.rlike("(?U)\\d")
    return F.when(digits, _expand(F.when(digits, text))).otherwise(text)
