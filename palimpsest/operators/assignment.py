"""Two sides of a block paired one to one by their distance on a line, nearest first.

Pairs are never listed: of the points that are left, the nearest two of different sides are always neighbours in the order of their values. Blocks of
many points are cut by ranges of their values. A range takes only pairs that nothing beyond its ends can undo; the points that something beyond may
reach go on to the next round, whose ranges are twice as long. Nothing is left out: a point is put aside only when its block has too few points of
the other side to come to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.neighbours import ranges, with_running_sum
from palimpsest.operators.relational import greedy_pairs
from palimpsest.session import written

ROWS_A_TASK = 50_000


def within(v: np.ndarray, side: np.ndarray, key: np.ndarray, most: tuple[int, int], span: float, before: bool, after: bool) -> tuple[list[int], list[int], list[int]]:
    """Positions of pairs (side 0, side 1) and of what is undecided, of one block's points in order of (v, side, key).

    `before`, `after`: whether the block may go on beyond the ends. `most`: how many points of each side the other side of the whole block can take;
    `span`: the largest distance in it.
    """
    n = len(v)
    if not n:
        return [], [], []
    # equal values: the sides' keys in order, one by one
    node = np.concatenate([[0], np.cumsum(v[1:] != v[:-1])])
    part = node * 2 + side
    size = np.bincount(part, minlength=2 * node[-1] + 2)
    rank = np.arange(n) - (np.cumsum(size) - size)[part]
    same = rank < np.minimum(size[0::2], size[1::2])[node]
    first, second = np.flatnonzero(same & (side == 0)).tolist(), np.flatnonzero(same & (side == 1)).tolist()
    at = np.flatnonzero(~same)
    if not len(at):
        return first, second, []
    edges = float(v[0]), float(v[-1])

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return begin, np.append(begin[1:], len(x))

    # the other side comes to a run of one side from its two ends, and takes no more than it has points
    begin, end = bounds(side[at])
    nodes, stop = bounds(node[at])
    run, mine = np.repeat(np.arange(len(begin)), end - begin), np.repeat(np.arange(len(nodes)), stop - nodes)
    pos, limit = np.arange(len(at)), np.asarray(most)[side[at]]
    keep = (pos - begin[run] < limit) | (end[run] - stop[mine] + pos - nodes[mine] < limit)
    if not keep.all():
        # values so close that distances may be rounded to the same (or a span too large for a double): all stay
        gap = ~(np.diff(v[at][nodes], append=np.inf) > np.spacing(span))
        keep |= np.logical_or.reduceat(gap[mine], begin)[run]
        at = at[keep]
        nodes, stop = bounds(node[at])
    val, of, left, stop = v[at][nodes].tolist(), side[at][nodes].tolist(), nodes.tolist(), stop.tolist()
    keys, at = key[at].tolist(), at.tolist()
    m = len(val)
    nxt, prv, alive, frozen = list(range(1, m + 1)), list(range(-1, m - 1)), [True] * m, []
    nxt[-1] = -1

    def best(i: int, j: int) -> tuple:
        """The first pair at the distance of the neighbours i, j: theirs, but where others around them are, when rounded, as near."""
        d = val[j] - val[i]
        lo, hi = prv[i], nxt[j]
        if (lo < 0 or val[j] - val[lo] != d) and (hi < 0 or val[hi] - val[i] != d):
            p, q = (i, j) if not of[i] else (j, i)
            return d, keys[left[p]], keys[left[q]], p, q
        lows, highs = [i], [j]
        while lo >= 0 and val[j] - val[lo] == d:
            lows.append(lo)
            lo = prv[lo]
        while hi >= 0 and val[hi] - val[i] == d:
            highs.append(hi)
            hi = nxt[hi]
        ways = [(x, y) if not of[x] else (y, x) for x in lows for y in highs if of[x] != of[y] and val[y] - val[x] == d]
        return min((d, keys[left[p]], keys[left[q]], p, q) for p, q in ways)

    heap = []

    def add(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and of[i] != of[j]:
            heapq.heappush(heap, (*best(i, j)[:3], i, j))

    def drop(i: int) -> None:
        alive[i] = False
        if prv[i] >= 0:
            nxt[prv[i]] = nxt[i]
        if nxt[i] >= 0:
            prv[nxt[i]] = prv[i]

    for i in range(m - 1):
        add(i, i + 1)
    # an end: direction, nodes of each side from there on, how many of them are done with, nearest value of each side that is beyond or undecided
    ends = []
    if before:
        ends.append((1, [[i for i in range(m) if of[i] == s] for s in (0, 1)], [0, 0], [edges[0]] * 2))
    if after:
        ends.append((-1, [[i for i in range(m - 1, -1, -1) if of[i] == s] for s in (0, 1)], [0, 0], [edges[1]] * 2))

    def reached(d: float) -> bool:
        """Sets nodes aside that something beyond an end may reach at this distance."""
        for way, lines, done, near in ends:
            for s in (0, 1):
                line, k = lines[s], done[s]
                while k < len(line) and not alive[line[k]]:
                    k += 1
                done[s] = k
                if k < len(line) and (val[line[k]] - near[1 - s]) * way <= d:
                    i = line[k]
                    while i >= 0:  # and what lies between it and the end
                        further = prv[i] if way > 0 else nxt[i]
                        drop(i)
                        frozen.append(i)
                        near[of[i]] = max(near[of[i]], val[i]) if way > 0 else min(near[of[i]], val[i])
                        i = further
                    return True
        return False

    while heap:
        d, p, q, i, j = heap[0]
        if not (alive[i] and alive[j] and nxt[i] == j):
            heapq.heappop(heap)
            continue
        if ends and reached(d):
            continue
        heapq.heappop(heap)
        now = best(i, j)
        if now[:3] != (d, p, q):
            heapq.heappush(heap, (*now[:3], i, j))
            continue
        for k, out in ((now[3], first), (now[4], second)):
            out.append(at[left[k]])
            left[k] += 1
            if left[k] == stop[k]:
                around = prv[k], nxt[k]
                drop(k)
                add(*around)
        if alive[i] and alive[j]:
            add(i, j)
    if not ends:
        return first, second, []
    rest = [at[k] for i in range(m) if alive[i] for k in range(left[i], stop[i])] + [at[k] for i in frozen for k in range(left[i], stop[i])]
    return first, second, rest


def step(batches: Iterator[pa.RecordBatch], cut: bool) -> Iterator[pa.RecordBatch]:
    """Points in order of (block, value): pairs, and points that are undecided (without a twin). `cut`: the first and last block may go on elsewhere."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    code = t["g"].combine_chunks().dictionary_encode().indices.to_numpy()
    v, side, key, m0, m1, span = (t[c].to_numpy() for c in ("v", "side", "key", "n1", "n0", "span"))
    begin = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
    p, q, rest = [], [], []
    for i, (lo, hi) in enumerate(zip(begin, begin[1:], strict=False)):
        x = within(v[lo:hi], side[lo:hi], key[lo:hi], (int(m0[lo]), int(m1[lo])), float(span[lo]), cut and i == 0, cut and i == len(begin) - 2)
        for out, more in zip((p, q, rest), x, strict=True):
            out += [lo + k for k in more]
    at, twins = p + rest, np.array(q, dtype=np.int64)
    none = len(rest)
    yield pa.RecordBatch.from_arrays(
        [
            t["g"].combine_chunks().take(pa.array(at, pa.int64())), pa.array(side[at], pa.int32()), pa.array(key[at], pa.int64()), pa.array(v[at], pa.float64()),
            pa.array(key[twins].tolist() + [None] * none, pa.int64()), pa.array(v[twins].tolist() + [None] * none, pa.float64()),
        ],
        names=["g", "side", "key", "v", "twin", "at"],
    )


def by_rank(points: DataFrame) -> DataFrame:
    """The two sides of each block one by one in the order of their keys."""
    rows = ranges(points.select(F.struct("g", "side").alias("k"), "key", "v", F.lit(1).alias("one")), "k", ["key"], ["v", "one"])
    x = with_running_sum(rows, "k", ["key"], "one", "i").select("k.g", "k.side", "key", "v", "i")
    return x.where("side = 0").join(x.where("side = 1").select("g", "i", F.col("key").alias("twin"), F.col("v").alias("at")), ["g", "i"]).select("g", "key", "v", "twin", "at")


def nearest_pairs(left: DataFrame, right: DataFrame, block: str, a: str, b: str, x: Column, y: Column, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """`block`, `a`, `b`, `score` (-|x - y|): what `greedy_pairs` makes of all pairs of a block (ties: smaller a, then b), without listing them.

    Both sides have a column named `block`; keys are whole numbers, values doubles. Rows without block or key have no pair. Of what is left in the end, NaNs
    and then nulls are paired in the order of keys. Blocks in which a key has several values or a value is infinite take the way of all pairs. Blocks up to
    `rows_a_task` points are one task's, and so are the points of one value in a block.
    """
    sides = [df.select(F.col(block).alias("g"), F.lit(i).alias("side"), F.col(k).cast("long").alias("key"), (v.cast("double") + F.lit(0.0)).alias("v")) for i, (df, k, v) in enumerate(((left, a, x), (right, b, y)))]
    all_points = sides[0].unionByName(sides[1]).where("g IS NOT NULL AND key IS NOT NULL")
    inf = F.lit(float("inf"))
    odd = ~F.col("v").eqNullSafe(F.col("w")) | ~F.col("known").isin(0, 1) | F.coalesce(F.abs("v") == inf, F.lit(False))
    points = all_points.groupBy("g", "side", "key").agg(F.min("v").alias("v"), F.max("v").alias("w"), (F.count("v") / F.count("*")).alias("known"))
    points = written(points.select("g", "side", "key", "v", odd.alias("odd")), "points")
    found = points.agg(F.max("odd").alias("odd"), F.max(F.col("v").isNull() | F.isnan("v")).alias("open")).first()
    slow = None
    if found.odd:
        blocks = points.where("odd").select("g").distinct()
        own = all_points.join(blocks, "g", "left_semi")
        j = own.where("side = 0").select("g", "key", "v").join(own.where("side = 1").select("g", F.col("key").alias("twin"), F.col("v").alias("at")), "g")
        slow = greedy_pairs(j.withColumn("score", -F.abs(F.col("v") - F.col("at"))), "g", "key", "twin", "score")
        points = points.join(blocks, "g", "left_anti")
    rest, pairs, limit = points.where("v IS NOT NULL AND NOT isnan(v)").select("g", "side", "key", "v"), None, rows_a_task
    fields = [f.simpleString().replace(":", " ", 1) for f in rest.schema]
    while True:
        n = rest.groupBy("g").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"), (F.max("v") - F.min("v")).alias("span")).where("n0 > 0 AND n1 > 0")
        size, left_over = F.col("n0") + F.col("n1"), None
        small, large = n.agg(F.sum(F.when(size <= limit, size)), F.sum(F.when(size > limit, size))).first()
        for total, cut in ((small, False), (large, True)):
            if not total:
                continue
            rows = rest.join(n.where(size > limit if cut else size <= limit), "g")
            rows = rows.repartitionByRange(-(-total // limit), "g", "v") if cut else rows.repartition(-(-total // rows_a_task), "g")
            done = written(rows.sortWithinPartitions("g", "v", "side", "key").mapInArrow(partial(step, cut=cut), ", ".join([*fields, "twin long", "at double"])), "pairs")
            new = done.where("twin IS NOT NULL").select("g", "key", "v", "twin", "at")
            pairs = new if pairs is None else pairs.unionByName(new)
            if cut:
                left_over = done.where("twin IS NULL").select("g", "side", "key", "v")
        if left_over is None:
            break
        rest, limit = left_over, limit * 2
    if pairs is None:
        pairs = points.where("false").select("g", "key", "v", F.col("key").alias("twin"), F.col("v").alias("at"))
    if found.open:
        blocks = points.where("v IS NULL OR isnan(v)").select("g").distinct()

        def without(df: DataFrame, taken: DataFrame) -> DataFrame:
            gone = taken.select("g", F.lit(0).alias("side"), "key").unionByName(taken.select("g", F.lit(1).alias("side"), F.col("twin").alias("key")))
            return df.join(gone, ["g", "side", "key"], "left_anti")

        free = without(points.join(blocks, "g", "left_semi").select("g", "side", "key", "v"), pairs)
        # no two numbers of different sides are left: each of these pairs has a NaN, and each of the next a null
        nans = by_rank(free.where("v IS NOT NULL"))
        pairs = pairs.unionByName(nans).unionByName(by_rank(without(free, nans)))
    out = pairs.select("g", "key", "twin", (-F.abs(F.col("v") - F.col("at"))).alias("score"))
    out = out if slow is None else out.unionByName(slow)
    return out.select(F.col("g").alias(block), F.col("key").cast(left.schema[a].dataType).alias(a), F.col("twin").cast(right.schema[b].dataType).alias(b), "score")
