"""Search over documents: queries taken apart, matches, facets, groups."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import words
from palimpsest.operators.relational import top_k_with_overflow

#: Words of a query that say nothing about what is sought (fixed values).
FILLER = {"the", "a", "an", "of", "in", "on", "for", "about", "and", "to", "with"}
#: Words that may be dropped if nothing has them all (fixed values).
SOFT = {"latest", "current", "new", "report", "reports", "note", "notes", "situation", "conditions"}


@dataclass
class Query:
    countries: list[str] = field(default_factory=list)
    hard: list[str] = field(default_factory=list)
    soft: list[str] = field(default_factory=list)


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def parse(raw: str, countries: list[str], synonyms: dict[str, str] | None = None) -> Query:
    """Countries by name (longest first), then hard and soft words; fillers are dropped."""
    rest, q = folded(raw), Query()
    for c in sorted(countries, key=lambda c: (-len(c), c)):
        pattern = rf"(?<!\w){re.escape(folded(c))}(?!\w)"
        if re.search(pattern, rest):
            q.countries.append(c)
            rest = re.sub(pattern, " ", rest)
    for w in re.findall(r"[^\W_]+", rest):
        w = (synonyms or {}).get(w, w)
        if w not in FILLER:
            (q.soft if w in SOFT else q.hard).append(w)
    return q


def starts_words(text: Column, wanted: list[str]) -> Column:
    """Each wanted word starts a word of the text."""
    out = F.lit(True)
    for w in wanted:
        out = out & F.lower(text).rlike(rf"(?U)(?<![\p{{L}}\p{{N}}]){re.escape(w)}")
    return out


def match(df: DataFrame, q: Query, text: Column, country: Column) -> DataFrame:
    """Rows with all words; if there are none and something else constrains the search, soft words are dropped."""
    base = df.where(country.isin(q.countries)) if q.countries else df
    hard = base.where(starts_words(text, q.hard))
    full = hard.withColumn("__full", starts_words(text, q.soft))
    if not q.soft or not (q.hard or q.countries):
        return full.where("__full").drop("__full")
    any_full = full.agg(F.coalesce(F.bool_or("__full"), F.lit(False)).alias("__any"))
    return full.join(F.broadcast(any_full)).where("__full OR NOT __any").drop("__full", "__any")  # one row beside each: no product


def facets(df: DataFrame, a: Column, b: Column, want_a: list[str], want_b: list[str]) -> DataFrame:
    """Counts of each facet's values, with the other facet's filter applied: one scan, each row counted under both facets."""
    in_a = a.isin(want_a) if want_a else F.lit(True)
    in_b = b.isin(want_b) if want_b else F.lit(True)
    x = F.array(F.when(in_b, F.struct(F.lit("a").alias("facet"), a.alias("value"))), F.when(in_a, F.struct(F.lit("b").alias("facet"), b.alias("value"))), F.when(in_a & in_b, F.struct(F.lit("all").alias("facet"), F.lit(None).cast("string").alias("value"))))
    return df.select(F.explode(F.filter(x, lambda v: v.isNotNull())).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """`word`, `key`, `n`: occurrences of each word by document."""
    return df.select(key, F.explode(words(F.col(text))).alias("word")).groupBy("word", key).agg(F.count("*").alias("n"))


def grouped_hits(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """First k hits of each group with the group's number of hits. A null group is one."""
    return top_k_with_overflow(df, [group], order, k).drop("overflow").join(df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("hits")), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
