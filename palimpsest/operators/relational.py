"""Joins, windows, groupings and graph steps that Spark has no single operator for.

Keys may be skewed: as-of joins split a key by time, interval joins bin time, nearest neighbours use grid cells, components shuffle edges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import normal_key
from palimpsest.operators.align import ratio
from palimpsest.operators.neighbours import ranges, with_running_sum
from palimpsest.session import checkpoint


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], width_us: int | None = None) -> DataFrame:
    """Each left row with the columns `take` of the last right row of its key not later than it; nulls where there is none.

    Times are longs. With `width_us` a key's time is cut into bins: each bin is a task's group of its own, and takes over the last right row of
    the bins before it, of which there is one row a bin. Ties of right rows: the greatest columns. Left rows are kept as they are.
    """
    size = F.lit(width_us or (1 << 62))
    cols = F.struct(F.col(right_at).alias("__r"), *take)
    r = right.where(F.col(right_at).isNotNull()).groupBy(*keys, F.col(right_at)).agg(F.max(cols).alias("__v")).select(*keys, F.col(right_at).alias("__t"), "__v").withColumn("__b", F.floor(F.col("__t") / size))
    rows = left.withColumn("__l", F.struct(*[F.col(c) for c in left.columns])).select(*keys, F.col(left_at).alias("__t"), "__l").withColumn("__b", F.floor(F.col("__t") / size))
    w = Window.partitionBy(*keys).orderBy("__b")
    last = r.groupBy(*keys, "__b").agg(F.max_by("__v", "__t").alias("__v"))
    bins = rows.select(*keys, "__b").distinct().join(last, [*keys, "__b"], "full")
    carried = bins.select(*keys, "__b", F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__v")).where("__v IS NOT NULL")
    none_l, none_v = F.lit(None).cast(rows.schema["__l"].dataType), F.lit(None).cast(r.schema["__v"].dataType)
    union = (
        rows.select(*keys, "__b", "__t", F.lit(2).alias("__o"), "__l", none_v.alias("__v"))
        .unionByName(r.select(*keys, "__b", "__t", F.lit(1).alias("__o"), none_l.alias("__l"), "__v"))
        .unionByName(carried.select(*keys, "__b", F.lit(None).cast("long").alias("__t"), F.lit(0).alias("__o"), none_l.alias("__l"), "__v"))
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(F.col("__t").asc_nulls_first(), "__o").rowsBetween(Window.unboundedPreceding, 0)
    out = union.withColumn("__v", F.last("__v", ignorenulls=True).over(inside)).where("__l IS NOT NULL")
    return out.select("__l.*", *[F.col(f"__v.{c}").alias(c) for c in take], F.col("__v.__r").alias(right_at))


def interval_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, before: int, after: int, on: list[str] | None = None) -> DataFrame:
    """Pairs with right time between left time - before and + after. Time is binned by the span, so the join is an equi-join of at most three bins."""
    span = max(1, before + after)
    lo, hi = F.floor((F.col(left_at) - before) / span), F.floor((F.col(left_at) + after) / span)
    a = left.withColumn("__bin", F.explode(F.sequence(lo, hi)))
    b = right.withColumn("__bin", F.floor(F.col(right_at) / span))
    j = a.join(b, ["__bin", *(on or [])])
    return j.where(F.col(right_at).between(F.col(left_at) - before, F.col(left_at) + after)).drop("__bin")


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """`run`: number of the unbroken run of equal `flag` that a row belongs to."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(flag.eqNullSafe(F.lag(flag).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w)).drop("__new")


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str, weight: str | None = None) -> DataFrame:
    """Overlapping or touching intervals of a key as one, with their number (and sum of weights)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = df.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    more = [F.sum(weight).alias(weight)] if weight else []
    return m.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged"), *more).drop("__run")


def rank_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Element number floor(n x q) of the ascending values, exact: values are put in order by ranges of (key, value), so a key may hold all rows."""
    rows = ranges(df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("__key"), F.col(value).alias("__v"), F.lit(1).alias("__one")), "__key", ["__v"], ["__one"])
    n = rows.groupBy(F.col("__key").alias("__k")).agg(F.count("*").alias("__n"))
    places = with_running_sum(rows, "__key", ["__v"], "__one", "__i").join(n, F.col("__key").eqNullSafe(F.col("__k")))
    at = {k: F.least(F.floor(F.col("__n") * q), F.col("__n") - 1) for k, q in shares.items()}
    asked = places.where(F.array_contains(F.array(*at.values()), F.col("__i") - 1))
    out = asked.groupBy("__key").agg(*[F.max(F.when(F.col("__i") - 1 == i, F.col("__v"))).alias(k) for k, i in at.items()])
    return out.select(*[F.col(f"__key.{k}").alias(k) for k in keys], *shares)


def top_k_with_overflow(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, and how many more there were. Ranks are cut at k before the shuffle, counts are partial sums."""
    top = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
    n = df.groupBy(*[F.col(x).alias(f"__{x}") for x in keys]).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("overflow"))
    same = None
    for x in keys:
        c = F.col(x).eqNullSafe(F.col(f"__{x}"))
        same = c if same is None else same & c
    return top.join(n, same).select(*df.columns, "place", "overflow")


def unique_matches(left: DataFrame, right: DataFrame, condition: Column, left_key: str) -> DataFrame:
    """Joined rows whose left row matches exactly once."""
    j = left.join(right, condition)
    return j.withColumn("__n", F.count("*").over(Window.partitionBy(left_key))).where("__n = 1").drop("__n")


def listing_diff(ours: DataFrame, theirs: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Two listings side by side: only_ours, only_theirs, differs (beyond the tolerance), same."""
    a, b = ours.select(key, F.col(value).alias("ours")), theirs.select(key, F.col(value).alias("theirs"))
    state = F.when(F.col("theirs").isNull(), "only_ours").when(F.col("ours").isNull(), "only_theirs").when(F.abs(F.col("ours") - F.col("theirs")) > tolerance, "differs").otherwise("same")
    return a.join(b, key, "full").withColumn("state", state)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `component` (smallest node) of an undirected graph: alternating large-star and small-star steps until nothing changes.

    The number of rounds grows with the logarithm of the nodes and isn't bounded. Only edges are shuffled; each round ends in a reliable
    checkpoint, so the lineage stays short and a lost executor loses nothing. A hub's edges meet one row, its smallest neighbour, which is
    found by partial minima; adaptive execution splits the hub's side of that join.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    e = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    # equal sets of edges have equal counts and sums of hashes
    seen = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))).first())
    e, before = checkpoint(e), None
    while (now := seen(e)) != before:
        before = now
        # large star: a node's larger neighbours hang on its smallest one
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = checkpoint(small)
    return nodes.join(e, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def near(points: DataFrame, queries: DataFrame, key: str, x: str, y: str, reach: float, qkey: str, qx: str, qy: str) -> DataFrame:
    """For each query the nearest point within reach (ties: smaller key). Cells of the reach's size make it an equi-join of nine cells."""
    p = points.withColumns({"__cx": F.floor(F.col(x) / reach), "__cy": F.floor(F.col(y) / reach)})
    around = F.array(*[F.struct((F.floor(F.col(qx) / reach) + i).alias("__cx"), (F.floor(F.col(qy) / reach) + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = queries.withColumn("__c", F.explode(around)).select("*", "__c.*").drop("__c")
    d = F.hypot(F.col(x) - F.col(qx), F.col(y) - F.col(qy))
    j = q.join(p, ["__cx", "__cy"]).withColumn("distance", d).where(F.col("distance") <= reach)
    return j.groupBy(qkey).agg(F.min(F.struct("distance", key)).alias("m")).select(qkey, F.col(f"m.{key}").alias(key), F.col("m.distance").alias("distance"))


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a fixed ring."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            odd = odd != (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1))
    return odd


def greedy_pairs(scored: DataFrame, block: str, a: str, b: str, score: str) -> DataFrame:
    """One-to-one pairs, best score first (ties: smaller a, then b), within each block.

    A pair that is the best of both its sides is one that the greedy order takes, whatever comes before it: such pairs are taken at once, what
    touches them falls away, and so on until no pair is left. No block is gathered in a task. Null scores come last.
    """
    # the block is a struct, so a null block is a block
    rest = scored.select(F.struct(F.col(block).alias("v")).alias("g"), F.col(a).alias("p"), F.col(b).alias("q"), F.col(score).alias("s")).where("p IS NOT NULL AND q IS NOT NULL")
    rest, out = checkpoint(rest), None
    while rest.limit(1).count():
        # the least place is the best
        place = F.struct(F.when(F.col("s").isNull(), 1).otherwise(0).alias("none"), (-F.col("s")).alias("less"), F.col("p").alias("x"), F.col("q").alias("y"))
        ranked = rest.withColumn("place", place)
        best_p, best_q = (ranked.groupBy("g", k).agg(F.min("place").alias(f"best_{k}")) for k in "pq")
        mutual = ranked.join(best_p, ["g", "p"]).join(best_q, ["g", "q"]).where((F.col("place") == F.col("best_p")) & (F.col("place") == F.col("best_q")))
        taken = checkpoint(mutual.select("g", "p", "q", "s").dropDuplicates(["g", "p", "q"]))
        out = taken if out is None else out.unionByName(taken)
        rest = checkpoint(rest.join(taken.select("g", "p"), ["g", "p"], "left_anti").join(taken.select("g", "q"), ["g", "q"], "left_anti").select("g", "p", "q", "s"))
    return (out if out is not None else rest).select(F.col("g.v").alias(block), F.col("p").alias(a), F.col("q").alias(b), F.col("s").alias(score))


def paired_by_title(left: DataFrame, right: DataFrame, block: str, key: str, title: str) -> DataFrame:
    """`key`, `twin`, `by` (title, likeness): rows of two sides of a block paired one to one.

    Rows of equal normalised titles are paired first, in the order of their keys. What is left is paired title by title, likest first: titles that
    state a month need the same month and a likeness of 0.6, others 0.9. Each title is compared once; rows of two paired titles are then
    paired in the order of their keys.
    """
    norm = normal_key(F.regexp_replace(title, r"(?i)\(accessible[^)]*\)", ""))
    month = F.nullif(F.lower(F.regexp_extract(title, r"(?i)\b((?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4})\b", 1)), F.lit(""))

    def ordered(df: DataFrame, names: dict[str, str], by: list[str]) -> DataFrame:
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__key"))).withColumnsRenamed(names)

    sides = [df.select(F.col(block).alias("__block"), F.col(key).alias("__key"), norm.alias("__title"), month.alias("__month")) for df in (left, right)]
    a, b = (ordered(s, {}, ["__block", "__title"]) for s in sides)
    exact = checkpoint(a.withColumnRenamed("__key", "x").join(b.select("__block", "__title", "__n", F.col("__key").alias("y")), ["__block", "__title", "__n"]).select("x", "y"))
    rest = [s.join(exact.select(F.col(c).alias("__key")), "__key", "left_anti") for s, c in zip(sides, "xy", strict=True)]
    titles = [r.groupBy("__block", "__title").agg(F.min("__month").alias("__month")) for r in rest]
    j = titles[0].join(titles[1].select(F.col("__block").alias("__block2"), F.col("__title").alias("__title2"), F.col("__month").alias("__month2")), F.col("__block") == F.col("__block2"))
    dated = F.col("__month").isNotNull() & F.col("__month2").isNotNull()
    j = j.where(~dated | (F.col("__month") == F.col("__month2"))).withColumn("__like", ratio(F.col("__title"), F.col("__title2"))).where(F.col("__like") >= F.when(dated, 0.6).otherwise(0.9))
    likest = greedy_pairs(j, "__block", "__title", "__title2", "__like").select("__block", "__title", "__title2")
    c, d = (ordered(r, {}, ["__block", "__title"]) for r in rest)
    near = c.withColumnRenamed("__key", "x").join(likest, ["__block", "__title"]).join(d.select("__block", F.col("__title").alias("__title2"), "__n", F.col("__key").alias("y")), ["__block", "__title2", "__n"]).select("x", "y")
    both = exact.withColumn("by", F.lit("title")).unionByName(near.withColumn("by", F.lit("likeness")))
    return both.select(F.col("x").alias(key), F.col("y").alias("twin"), "by")


def last_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key wins; whole rows, partial maxima before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in rest])
