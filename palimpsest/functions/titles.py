"""Titles of notes taken apart: kind, topic, country, month; keys of series; slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Words that don't tell one series from another (fixed values).
FILLER = ("and", "or", "the", "of", "in", "on", "for", "a", "an", "to", "with", "including", "their", "issues", "provision")
#: Series that were renamed (parameter): old key -> key.
RENAMED = {"note:debt-disputes": "note:debt-disputes-lending"}
MARK = r"(?i)\s*\((?:large print|accessible|accesible|accessible version)\)\s*$"
MONTH = rf"(?i)[,\s]\s*({MONTHS})\s+(\d{{4}})\s*$"


def month_number(name: Column) -> Column:
    return F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3))) + 2) / 3)


def parse_title(title: Column, country: Column) -> dict[str, Column]:
    """kind, topic, month (yyyy-MM), accessible, names_country. White space of any kind counts as a blank."""
    t = F.trim(F.regexp_replace(title, r"[\s\p{Z}]+", " "))
    accessible = t.rlike(MARK)
    t = F.regexp_replace(t, MARK, "")
    m = F.regexp_extract(t, MONTH, 1)
    month = F.when(m != "", F.concat(F.regexp_extract(t, MONTH, 2), F.lit("-"), F.lpad(month_number(m).cast("string"), 2, "0")))
    t = F.regexp_replace(F.regexp_replace(t, MONTH, ""), r"[ ,]+$", "")
    names = F.lower(t).endswith(F.lower(country))
    t = F.when(names, F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(country)), r"[ ,]+$", "")).otherwise(t)
    has = t.contains(":")
    kind = F.when(has, F.lower(F.trim(F.substring_index(t, ":", 1)))).otherwise("")
    topic = F.trim(F.when(has, F.substring(t, F.instr(t, F.lit(":")) + F.lit(1), F.lit(1_000_000))).otherwise(t))
    return {"kind": kind, "topic": topic, "month": month, "accessible": accessible, "names_country": names}


def series_key(kind: Column, topic: Column) -> Column:
    """Family and the sorted distinct telling words of the topic; renamed series keep their key."""
    family = F.when(kind.contains("bulletin"), "bulletin").when(kind.contains("fact-finding"), "fact-finding").otherwise("note")
    found = F.regexp_extract_all(F.lower(F.replace(topic, F.lit("&"), F.lit(" and "))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    core = F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda w: ~w.isin(*FILLER)))), "-")
    key = F.concat(family, F.lit(":"), F.when(core == "", "untitled").otherwise(core))
    names = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])
    return F.coalesce(F.try_element_at(names, key), key)


#: First pattern that matches gives the label (fixed values).
LABELS = (("information summary", "Summary"), ("conditions note", "Conditions"), ("situation note", "Situation"), ("bulletin", "Bulletin"))


def kind_label(kind: Column) -> Column:
    out = F.when(kind == "", "Notice").otherwise(F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 1_000_000)))
    for pattern, label in reversed(LABELS):
        out = F.when(kind.contains(pattern), label).otherwise(out)
    return out


def title_from_slug(slug: Column) -> Column:
    """'prison-conditions-jurande-2cb' -> 'prison conditions jurande': the last part is a counter."""
    return F.replace(F.regexp_replace(slug, r"-[0-9a-f]{1,4}$", ""), F.lit("-"), F.lit(" "))
