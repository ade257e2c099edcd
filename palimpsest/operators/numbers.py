"""Figures in words and quotations by context: work on characters that no Column expresses, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number words and their values, and words that make a bare 'one' a number (fixed values).
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
DECADES = "twenty thirty forty fifty sixty seventy eighty ninety".split()
COUNTED = frozenset("hundred thousand million billion people persons cases days months years".split())
VALUE = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(DECADES)}
TOKEN = re.compile(r"\w+|\W")
GROUPED = re.compile(r"(?<![\w.,])\d{1,3}(?:,\d{3})+(?![\d,])")


def number_at(tokens: list[str], at: int) -> tuple[int, int]:
    """(value, tokens taken) of the number that is written in words from a token on, up to 999; nothing taken if there is none.

    number := units [hundred [[and] below]] | below;  below := decade [(blank or hyphen) units under ten] | units
    """
    word = lambda i: tokens[i].lower() if i < len(tokens) else ""

    def below(i: int) -> tuple[int, int]:
        v = VALUE.get(word(i))
        if v is None:
            return 0, i
        if v >= 20 and word(i + 1) in (" ", "-") and 0 < VALUE.get(word(i + 2), 0) < 10:
            return v + VALUE[word(i + 2)], i + 3
        return v, i + 1

    value, end = below(at)
    if end == at + 1 and 0 < value < 10 and word(end) == " " and word(end + 1) == "hundred":
        value, end = value * 100, end + 2
        more = end + 1 if word(end) == " " else 0
        if more and word(more) == "and" and word(more + 1) == " ":
            more += 2
        if more:
            rest, stop = below(more)
            if stop > more:
                value, end = value + rest, stop
    return value, end - at


def as_digits(text: str) -> str:
    """Number words from 0 to 999 and grouped figures as plain digits; a bare 'one' only before what is counted."""
    tokens, out, i = TOKEN.findall(text), [], 0
    while i < len(tokens):
        value, n = number_at(tokens, i) if tokens[i].lower() in VALUE else (0, 0)
        k = i + n
        if n == 1 and tokens[i].lower() == "one":
            while k < len(tokens) and tokens[k].isspace():
                k += 1
            if k == i + n or k >= len(tokens) or tokens[k].lower() not in COUNTED:
                n = 0
        out.append(str(value) if n else tokens[i])
        i += max(n, 1)
    return GROUPED.sub(lambda m: m.group().replace(",", ""), "".join(out))


def _plain(text: pd.Series) -> pd.Series:
    return text.map(as_digits, na_action="ignore")


def plain_figures(text: Column) -> Column:
    return F.pandas_udf(_plain, "string")(text)


def locate(text: str, quote: str, before: str, after: str, near: int) -> int:
    """Place of the quotation whose surroundings agree best with `before` and `after`; then the nearest to `near`; -1 if there is none."""

    def agreement(a: str, b: str) -> int:
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        return n

    best, at = None, text.find(quote)
    while at >= 0:
        score = agreement(before[::-1], text[:at][::-1][: len(before)]) + agreement(after, text[at + len(quote) : at + len(quote) + len(after)])
        key = (score, -abs(at - near), -at)
        if best is None or key > best[0]:
            best = (key, at)
        at = text.find(quote, at + 1)
    return best[1] if best else -1


#: Quotations of any length.
QUOTE = re.compile("“([^”]+)”")
CONTEXT = 32


def locate_quotes(df: DataFrame, key: str, text: str, other: str) -> DataFrame:
    """`key`, `at`, `found_at` for each quotation of a text: its place there, and in the other text (-1: not there)."""

    def run(it):
        for p in it:
            rows = []
            for k, t, o in zip(p["k"], p["t"], p["o"], strict=True):
                for m in QUOTE.finditer(t or ""):
                    a, b = m.span(1)
                    rows.append((k, a, locate(o or "", m[1], t[max(0, a - CONTEXT) : a], t[b : b + CONTEXT], a)))
            yield pd.DataFrame(rows, columns=["k", "at", "found_at"])

    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(other).alias("o"))
    return src.mapInPandas(run, "k long, at int, found_at int").withColumnRenamed("k", key)
