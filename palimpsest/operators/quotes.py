"""Quotations that a source has in nearly the same words, and what differs between the two.

A near match is a window of the source between the quotation's first and last four words. Windows are found by the places of these runs, each
start with the first end after it; every one is compared. Literal texts are never altered: figures are brought to one writing only to
compare quantities.

Defined cases: quotations of fewer than twelve words, with an omission or an insertion have no near match; nor have those that stand word for
word in the source, or two different windows of nearly the same likeness; null texts have none.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.operators.numbers import as_digits

LEAST_WORDS, EDGE, LIKE, MARGIN = 12, 4, 0.9, 0.03
#: What is compared apart from the words.
NUMBER = re.compile(r"(?<!\w)[−+-]?\d+(?:,\d{3})*(?:\.\d+)?(?:\s*%)?(?!\w)")
NEGATION = re.compile(r"(?i)\b(?:not|no|never|neither|without|cannot|can't|didn't|doesn't|isn't|wasn't)\b")
QUALIFIER = re.compile(r"(?i)\b(?:at least|at most|up to|approximately|estimated|estimate|reportedly|alleged|some|may|could|likely|unlikely)\b")
UNITS = "per cent|percent|percentage|people|persons|families|households|deaths|cases|incidents|million|billion|thousand|days|months|years|dollars|pounds"
UNIT_AFTER = re.compile(rf"(?i)\s*({UNITS})\b")
CURRENCY_BEFORE = re.compile(r"([£$€])\s*$")
ATTRIBUTION = re.compile(r"(?i)\((?:e-?mail|personal communication|interview)[^()]*\b(?:19|20)\d{2}\)")
QUOTE_MARKS = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "­": ""})


def exact(text: str) -> str:
    """Case, width, spacing and typographic marks aside; words, figures and signs as they are."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(QUOTE_MARKS).casefold().split())


def plain_words(text: str) -> list[str]:
    """Words without punctuation; signs of quantity apart."""
    return re.sub(r"[\"'“”‘’.,;:()–—]", " ", re.sub(r"([%£$€])", r" \1 ", text)).split()


def quantities(text: str) -> list[tuple[str, str | None]]:
    """(figure, its unit) in order; the figure without a percent sign, which is a unit."""
    out: list[tuple[str, str | None]] = []
    for m in NUMBER.finditer(text):
        after, before = UNIT_AFTER.match(text, m.end()), CURRENCY_BEFORE.search(text[: m.start()])
        share = m.group().rstrip().endswith("%")
        out.append((m.group().rstrip("% "), "%" if share else after[1].lower() if after else before[1] if before else None))
    return out


def windows(words: list[str], source: list[str], longest: int) -> list[list[str]]:
    """Windows of the source from the first to the last EDGE words, at most `longest` characters long."""
    first, last = words[:EDGE], words[-EDGE:]
    places = lambda run: [i for i, w in enumerate(source) if w == run[0] and source[i : i + EDGE] == run]
    starts, ends = places(first), places(last)
    out, k = [], 0
    for i in starts:
        while k < len(ends) and ends[k] < i + EDGE:
            k += 1
        if k < len(ends) and sum(len(w) + 1 for w in source[i : ends[k] + EDGE]) <= longest:
            out.append(source[i : ends[k] + EDGE])
    return out


def changed(q: str, s: str) -> list[str]:
    """Which of number, negation, qualifier, unit differ between two texts whose figures are in one writing."""
    a, b = quantities(q), quantities(s)
    out = []
    if [x for x, _ in a] != [x for x, _ in b]:
        out.append("number")
    for name, pattern in (("negation", NEGATION), ("qualifier", QUALIFIER)):
        if [x.lower() for x in pattern.findall(q)] != [x.lower() for x in pattern.findall(s)]:
            out.append(name)
    if [x for _, x in a if x] != [x for _, x in b if x]:
        out.append("unit")
    return out


def near(quote: str | None, source: str | None) -> dict | None:
    """The near match of a quotation: similarity, excerpt, differences, what changed, whether only its form does."""
    if not quote or not source:
        return None
    q, s = exact(quote), exact(source)
    words = q.split()
    if len(words) < LEAST_WORDS or "…" in q or "..." in q or "[" in q or q in s:
        return None
    q_figures, ranked = as_digits(q), {}
    for w in windows(words, s.split(), max(500, int(len(q) * 1.5))):
        text = " ".join(w)
        if text in ranked or text == q:
            continue
        s_figures = as_digits(text)
        ratio = max(SequenceMatcher(None, words, w, autojunk=False).ratio(), SequenceMatcher(None, plain_words(q_figures), plain_words(s_figures), autojunk=False).ratio())
        if ratio >= LIKE:
            ranked[text] = ratio
    if not ranked:
        return None
    (best, ratio), *rest = sorted(ranked.items(), key=lambda e: (-e[1], e[0]))
    if rest and ratio - rest[0][1] < MARGIN:
        return None
    w, s_figures = best.split(), as_digits(best)
    differences = [f"{' '.join(words[a:b])} -> {' '.join(w[c:d])}" for tag, a, b, c, d in SequenceMatcher(None, words, w, autojunk=False).get_opcodes() if tag != "equal"]
    left_out = [x for x in ATTRIBUTION.findall(best) if x not in q]
    for x in left_out:
        s_figures = s_figures.replace(x, "")
    what = changed(q_figures, s_figures)
    a, b = ([u for _, u in quantities(t) if u] for t in (q_figures, s_figures))
    share = a.count("%") != b.count("%") and [u for u in a if u != "%"] == [u for u in b if u != "%"]
    if share and "unit" in what:
        what.remove("unit")
    return {
        "quote": quote, "similarity": round(ratio, 4), "excerpt": best, "differences": differences, "changed": what, "form_only": plain_words(q_figures) == plain_words(s_figures) and not what,
        "figures_only": q_figures != q or as_digits(best) != best, "attribution": bool(left_out), "share": share, "marker": marker_shaped(words, w),
    }


def marker_shaped(words: list[str], source: list[str]) -> bool:
    """Whether all that differs are numbers in brackets, or figures stuck to the end of a sentence: they may be marks of notes."""
    rows = [x for x in SequenceMatcher(None, words, source, autojunk=False).get_opcodes() if x[0] != "equal"]
    for _, a, b, c, d in rows:
        q, s = " ".join(words[a:b]), " ".join(source[c:d])
        bracket = re.sub(r"\[\d{1,4}\]", "", s).strip() == q and s != q
        stuck = bool(q) and re.search(r"[A-Za-z][.!?]['\"]?$", q) and s.startswith(q) and re.fullmatch(r"\d{1,4}", s[len(q) :])
        if not bracket and not stuck:
            return False
    return bool(rows)


NEAR = "array<struct<quote string, similarity double, excerpt string, differences array<string>, changed array<string>, form_only boolean, figures_only boolean, attribution boolean, share boolean, marker boolean, agreed boolean>>"


def _near(quotes: pd.Series, source: pd.Series, second: pd.Series) -> pd.Series:
    out = []
    for qs, s, t in zip(quotes, source, second, strict=True):
        found = []
        for q in qs if qs is not None and s else ():
            n = near(q, s)
            if n:
                again = near(q, t) if t else None
                found.append({**n, "agreed": t is None or (exact(q) not in exact(t) and again is not None and again["differences"] == n["differences"])})
        out.append(found)
    return pd.Series(out)


def near_matches(quotes: Column, source: Column, second: Column) -> Column:
    """The near matches of some quotations in a source; `agreed`: an independent reading of it, if there is one, differs in the same way."""
    return F.pandas_udf(_near, NEAR)(quotes, source, second)
