"""Column functions on text. All stay in the JVM but `decoded`, which needs the table of HTML entities."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: What a text's fingerprint doesn't see: white space, the arrow back from a footnote and its variation selectors.
UNSEEN = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{21a9}\x{fe0e}\x{fe0f}]+"
MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def without_markup(html: Column, blank: str = "") -> Column:
    return F.regexp_replace(html, MARKUP, blank)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def _decoded(text: pd.Series) -> pd.Series:
    return text.map(unescape, na_action="ignore")


def decoded(text: Column) -> Column:
    """HTML entities decoded; unknown ones are kept."""
    return F.pandas_udf(_decoded, "string")(text)


def _decoded_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [unescape(t) for t in a])


def decoded_all(texts: Column) -> Column:
    """As `decoded`, of an array of texts."""
    return F.pandas_udf(_decoded_all, "array<string>")(texts)


def visible_text(html: Column) -> Column:
    """Text that a reader sees, with white space collapsed; '' for null."""
    return F.coalesce(collapsed(decoded(without_markup(html))), F.lit(""))


def fingerprint(text: Column) -> Column:
    """Hash of a text without white space and return arrows."""
    return F.sha2(F.regexp_replace(text, UNSEEN, ""), 256)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once: a lambda's variable isn't inlined, as a projected column would be, into each use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def grams(w: Column, n: int) -> Column:
    """Distinct runs of n words; fewer words are one run, none an empty set."""

    def of(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, n), " "))
        return F.when(F.size(x) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return bound(w, of)


def gram_hashes(w: Column, n: int, whole: bool = True) -> Column:
    """As `grams`, as 64-bit hashes: eight bytes a run instead of its words. `whole` False: every run, repeats too, and none of fewer words."""

    def of(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(x, i, n), " ")))
        return F.when(F.size(x) < (1 if whole else n), F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs) if whole else runs)

    return bound(w, of)


def kept_share(a: Column, b: Column) -> Column:
    """Common members / members of the larger set, to 3 places; 1 if both are empty."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger == 0, F.lit(1.0)).otherwise(F.round(F.size(F.array_intersect(a, b)) / larger, 3))


def dates(text: Column) -> Column:
    """English dates 'd Month yyyy' in a text as yyyy-MM-dd; impossible ones are dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b(\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}})\b"), F.lit(1))
    return F.filter(F.transform(found, english_date), lambda d: d.isNotNull())


def english_date(text: Column) -> Column:
    """'9 February 2022' -> '2022-02-09'; null if there is no such day."""
    d, m, y = (F.regexp_extract(text, rf"(?i)(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})", i) for i in (1, 2, 3))
    number = F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(m, 1, 3))) + 2) / 3)
    return F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(number.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def version_banner(text: Column, window: int = 200) -> Column:
    """The version number that a text states near 'version control', else near its beginning."""
    pattern = r"(?i)\bversion\s+(\d+\.\d+)(?![\d.]\d)"
    at = F.regexp_instr(text, F.lit("(?i)version control"))
    near = F.when(at > 0, F.regexp_extract(F.substring(text, at + F.lit(15), F.lit(window)), pattern, 1))
    return F.coalesce(F.nullif(near, F.lit("")), F.nullif(F.regexp_extract(F.substring(text, 1, window), pattern, 1), F.lit("")))


#: Quoted spans in typographic double, single and straight marks.
QUOTED = '“[^”]+”|‘[^’]+’|"[^"]+"'


def quotations(text: Column, least: int = 8, most: int = 300, first: int = 6) -> Column:
    """Quoted spans of `least` to `most` words, the first few distinct ones. A text that begins with a quotation mark is one span up to the last closing one."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\[footnote\s+\d+\]", ""))
    n = lambda q: F.size(F.split(F.trim(q), r"\s+"))
    whole = F.regexp_extract(t, "(?s)^(?:“(.+)”|‘(.+)’)", 0)
    spans = F.when(whole != "", F.array(whole)).otherwise(F.regexp_extract_all(t, F.lit(QUOTED), F.lit(0)))
    inner = F.transform(spans, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    return F.slice(F.array_distinct(F.filter(inner, lambda q: n(q).between(least, most))), 1, first)


def names_in(text: Column, names: Column) -> Column:
    """The given names that stand in a text as whole words, in order, never overlapping; of names that begin at one place the longest. A final s may come or go."""
    plain = F.transform(names, lambda n: collapsed(n))
    known = F.array_sort(F.filter(plain, lambda n: F.length(n) >= 4), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(known, lambda n: F.concat(F.regexp_replace(F.regexp_replace(n, "s$", ""), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit("s?")))
    pattern = F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    found = F.call_function("regexp_extract_all", collapsed(text), pattern, F.lit(0))
    return F.when(F.size(known) == 0, F.array().cast("array<string>")).otherwise(F.transform(found, lambda m: F.lower(m)))


def claim_text(text: Column) -> Column:
    """A claim without the number of its paragraph and the marks of its footnotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\d+(?:\.\d+)+\.?\s+", ""), r"(?i)\[footnote\s+\d+\]", ""))


def headings(html: Column) -> Column:
    """Distinct headings of up to fourteen words, as they are compared."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]\s*>"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda h: normal_quotation(without_markup(h))), lambda h: F.size(F.split(h, r"\s+")).between(1, 14) & (h != "")))


def comparison_text(text: Column, heads: Column) -> Column:
    """A text without the headings that stand in it exactly once: quotations may run on over them."""
    once = lambda t, h: (F.length(t) - F.length(F.replace(t, h, F.lit("")))) == F.length(h)
    return F.aggregate(heads, text, lambda t, h: F.when(once(t, h), F.replace(t, h, F.lit(" "))).otherwise(t), lambda t: normal_quotation(t))


#: References to notes of the page itself, with their label.
NOTE_REF = r'(?is)<sup[^>]*>\s*<a[^>]*href="#(?:fn|ftn|edn|note|cite)[^"]*"[^>]*>\s*((?:footnote\s*)?\[?(?:footnote\s+)?\d{1,4}\]?)\s*</a>\s*</sup>'


def without_notes(html: Column) -> Column:
    """A fragment without its references to notes; other raised figures (exponents, provisions) stay."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), NOTE_REF, " ")


# four normalisers, kept apart: each forgets other things


def normal_quotation(text: Column) -> Column:
    """Case, spacing, typographic quotation marks and soft hyphens aside."""
    return F.lower(collapsed(F.translate(text, "‘’“”­", "''\"\"")))


def normal_key(text: Column) -> Column:
    """Letters and digits only, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normal_topic(text: Column) -> Column:
    """Lower case, '&' as 'and', no punctuation but hyphens."""
    return collapsed(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\- ]+", " "))


def normal_heading(text: Column) -> Column:
    """Headings without numbering and closing punctuation."""
    return F.lower(collapsed(F.regexp_replace(F.regexp_replace(text, r"^\s*\d+(?:\.\d+)*\.?\s+", ""), r"[\s:.;]+$", "")))
