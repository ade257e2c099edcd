
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from palimpsest.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(ids: str, sql: str | None = None):
    """Registers the function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        IDS[f.__name__] = ids
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Spark's names of functions -> those of the comparison.
DIALECT = ((r"\bexplode\(", "unnest("), (r"\barray_sort\(collect_set\(([^()]*)\)\)", r"list_sort(list(DISTINCT \1))"), (r"\bsize\(", "len("), (r"(?<![\w_])split\(", "string_split_regex("), (r"\brlike\(", "regexp_matches("), (r"\bstruct\(", "row("), (r"\barray_join\(", "array_to_string("))


def both(name: str, ids: str, sql: str) -> None:
    """A query that is one SQL text for Spark and, with other names of functions, for the comparison; tables are written {name}."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def f(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(sql, **{n: table(spark, sf, n) for n in names})

    f.__name__, f.__doc__ = name, ids
    twin = re.sub(r"\{(\w+)\}", r"\1", sql)
    for a, b in DIALECT:
        twin = re.sub(a, b, twin)
    query(ids, twin)(f)
