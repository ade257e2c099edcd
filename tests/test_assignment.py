"""Customers and suppliers paired one to one, against a plain loop over all their pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators.assignment import nearest_pairs, within
from palimpsest.plans.relational import greedy_assignment

C, S = "c_custkey long, c_nationkey int, c_acctbal double", "s_suppkey long, s_nationkey int, s_acctbal double"


def loop(customers, suppliers):
    """Rows (nation, customer, supplier, score): all pairs in order of score, customer, supplier; null scores last."""
    pairs = [(g, c, s, None if x is None or y is None else -abs(x - y)) for c, g, x in customers for s, h, y in suppliers if g is not None and g == h]
    taken, out = set(), []
    for g, c, s, d in sorted(pairs, key=lambda r: (r[3] is None, -(r[3] or 0), r[1], r[2])):
        if ("c", g, c) not in taken and ("s", g, s) not in taken:
            taken |= {("c", g, c), ("s", g, s)}
            out.append((g, c, s, d))
    return sorted(out, key=repr)


def assigned(spark, folder, customers, suppliers):
    spark.createDataFrame(customers, C).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(suppliers, S).write.parquet(f"{folder}/supplier.parquet")
    return sorted(map(tuple, greedy_assignment(spark, str(folder)).select("block", "c_custkey", "s_suppkey", "score").collect()), key=repr)


def test_partners_far_apart_and_without_balance(spark, tmp_path):
    customers = [(1, 7, 0.0), (2, 7, 400.0), (3, 7, 9000.0), (4, 8, -900.0), (5, 9, None), (6, 9, 1.0), (7, None, 1.0), (8, 10, 1.0)]
    suppliers = [(1, 7, 100.0), (2, 7, 5000.0), (3, 7, -999.0), (4, 8, 9999.0), (5, 9, 3.0), (6, 9, None), (7, None, 1.0), (8, 11, 1.0)]
    got = assigned(spark, tmp_path, customers, suppliers)
    assert got == loop(customers, suppliers)
    assert got == [(7, 1, 1, -100.0), (7, 2, 3, -1399.0), (7, 3, 2, -4000.0), (8, 4, 4, -10899.0), (9, 5, 6, None), (9, 6, 5, -2.0)]


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf, name):
    sf = sf.replace("sf0.001", name)
    c, s = (list(map(tuple, spark.read.parquet(f"{sf}/{t}.parquet").select(*k).collect())) for t, k in (("customer", ("c_custkey", "c_nationkey", "c_acctbal")), ("supplier", ("s_suppkey", "s_nationkey", "s_acctbal"))))
    want = loop(c, s)
    assert want and sorted(map(tuple, greedy_assignment(spark, sf).select("block", "c_custkey", "s_suppkey", "score").collect()), key=repr) == want


def test_a_chain_takes_few_jobs(spark, tmp_path):
    """All customers below all suppliers: each pair is the nearest only when the one inside it is gone."""
    customers, suppliers = [(i, 1, -float(i)) for i in range(40)], [(i, 1, 100.0 + i) for i in range(40)]
    spark.sparkContext.setJobGroup("chain", "a chain of pairs")
    try:
        got = assigned(spark, tmp_path, customers, suppliers)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted(((1, i, i, -100.0 - 2 * i) for i in range(40)), key=repr)
    assert jobs < 40


def first_pairs(points):
    taken, out = set(), set()
    for _, a, b in sorted((abs(x - y), a, b) for x, s, a in points if s == 0 for y, u, b in points if u == 1):
        if (0, a) not in taken and (1, b) not in taken:
            taken |= {(0, a), (1, b)}
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed", range(300))
def test_ranges_decide_only_what_holds(seed):
    """Values cut anywhere, also such whose distances are equal when rounded: rounds with fewer and fewer ranges find what the loop finds."""
    r = random.Random(seed)
    value = r.choice([lambda: round(r.uniform(-100, 100), 2), lambda: float(r.randrange(12)), lambda: r.choice([1e16, 3.0, 0.1]) + r.randrange(5) * r.choice([1e-16, 1e-15, 2.0]), lambda: r.choice([-1, 1]) * r.choice([1.7e308, 1e308, 3.0])])
    n, m = r.choice([(3, 3), (40, 5), (5, 40), (25, 25), (1, 30)])
    away = r.choice([0, 0, 150.0])
    points = rest = sorted([(value(), 0, i) for i in r.sample(range(1000), n)] + [(value() + away, 1, i) for i in r.sample(range(1000), m)])
    got, parts = set(), r.choice([1, 2, 3, 8])
    while all(sides := [sum(p[1] == s for p in rest) for s in (0, 1)]):
        values = sorted({p[0] for p in rest})
        cuts = r.sample(values, min(parts - 1, len(values)))
        groups, more = {}, []
        for p in sorted(rest):
            groups.setdefault(sum(c <= p[0] for c in cuts), []).append(p)
        for g in groups.values():
            v, s, k = map(np.array, zip(*g, strict=True))
            with np.errstate(over="ignore", invalid="ignore"):
                first, second, open_ = within(v, s, k, (sides[1], sides[0]), values[-1] - values[0], parts > 1, parts > 1)
            got |= {(int(k[i]), int(k[j])) for i, j in zip(first, second, strict=True)}
            more += [g[i] for i in open_]
        assert parts > 1 or not more
        rest, parts = more, max(1, parts // 2)
    assert got == first_pairs(points)


@pytest.mark.parametrize("rows_a_task", [7, 1000])
def test_odd_rows_in_many_ranges(spark, rows_a_task):
    """Blocks of equal values, NaNs, nulls, infinities, repeated rows, and keys with several values."""
    r = random.Random(3)
    nan, inf = float("nan"), float("inf")
    money = lambda: round(r.uniform(-50, 50), 1)
    odd = {1: [], 2: [nan, None, nan, None, nan], 3: [nan, nan], 4: [inf, -inf, inf, nan, None], 5: [None] * 4, 6: []}
    sides = []
    for most in (30, 12):
        rows = [(i, g, money() if g != 6 else 5.0) for g in odd for i in range(r.randrange(5, most))]
        rows += [(100 + i, g, x) for g, xs in odd.items() for i, x in enumerate(xs)]
        rows += [(1, 7, 2.0), (1, 7, 9.0), (2, 7, 2.0), (3, 7, -4.0), (1, None, 1.0), (None, 1, 1.0)]
        sides.append(rows + r.sample(rows, 9))
    a, b = (spark.createDataFrame(s, "k long, g int, v double") for s in sides)
    pairs = [(g, i, j, None if x is None or y is None else -abs(x - y)) for i, g, x in sides[0] for j, h, y in sides[1] if g is not None and g == h and i is not None and j is not None]
    taken, want = set(), []
    for g, i, j, d in sorted(pairs, key=lambda p: (p[3] is None, p[3] is not None and math.isnan(p[3]), 0 if p[3] is None or math.isnan(p[3]) else -p[3], p[1], p[2])):
        if (0, g, i) not in taken and (1, g, j) not in taken:
            taken |= {(0, g, i), (1, g, j)}
            want.append((g, i, j, d))
    got = nearest_pairs(a.select("g", "k", "v"), b.select("g", F.col("k").alias("l"), "v"), "g", "k", "l", F.col("v"), F.col("v"), rows_a_task)
    assert got.columns == ["g", "k", "l", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert nearest_pairs(a.limit(0).select("g", "k", "v"), b.select("g", F.col("k").alias("l"), "v"), "g", "k", "l", F.col("v"), F.col("v")).count() == 0
