"""Operators on small made-up rows: nulls, ties, empty tables, hot keys, clashing names; against plain loops."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import align as A
from palimpsest.operators import editions as E
from palimpsest.operators import history as H
from palimpsest.operators import relational as R
from palimpsest.operators import rules as U
from palimpsest.operators import search as Q
from palimpsest.operators import snapshots as N
from palimpsest.operators import state as S

SNAP = "snapshot_no int, country string, note string, title string, status string, text_sha256 string, first_seen string, last_seen string, delivered_at timestamp"


def snap(spark, rows):
    import datetime

    t = lambda d: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=d)
    return spark.createDataFrame([(n, "c", k, None, "live", h, f, s, t(d) if d is not None else None) for n, k, h, f, s, d in rows], SNAP)


def test_snapshots(spark):
    f, g = "2025-01-01T10:00:00Z", "2025-01-01T11:00:00+01:00"
    rows = [
        (1, "same", "AB", f, "2026-01-01T00:00:00Z", 1), (3, "same", "ab", g, "2026-01-08T00:00:00.000Z", 9), (1, "gone", "x", f, None, 1), (3, "new", "x", f, None, 9), (1, "text", "x", f, None, 1), (3, "text", None, f, None, 9),
        (1, "back", "x", f, "2026-01-08T00:00:00Z", 1), (3, "back", "x", f, "2026-01-01T00:00:00Z", 9), (1, "ends", "x", f, "2026-01-08T00:00:00Z", 1), (3, "ends", "x", f, None, 9), (1, "first", "x", f, None, 1), (3, "first", "x", "2025-01-02T10:00:00Z", None, 9),
        (1, "late", "old", f, None, 1), (1, "late", "new", f, None, 20), (3, "late", "new", f, None, 9), (3, "late", "new", f, None, 9), (None, "none", "x", f, None, 1), (3, None, "x", f, None, 9), (1, "null", None, f, None, None), (3, "null", None, f, None, 2),
    ]
    want = [(3, "back", "changed"), (3, "ends", "changed"), (3, "first", "changed"), (3, "gone", "removed"), (3, "new", "added"), (3, "text", "changed")]
    df = snap(spark, rows)
    assert sorted(map(tuple, N.note_changes(df).collect())) == want
    assert sorted(map(tuple, N.note_changes(df.withColumn("bucket", F.lit("x")).withColumn("key", F.lit(1)), 3).collect())) == want
    assert N.note_changes(df.limit(0)).count() == 0 and N.note_changes(df.where("snapshot_no = 1")).count() == 0


LOG = "log_id long, edition_id long, country string, note string, at string, title string, public_updated_at string, received_at timestamp"


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_history(spark, partitions):
    """A hot edition spans many partitions; the result is that of a plain loop."""
    import datetime

    r = random.Random(4)
    base = datetime.datetime(2026, 1, 1)
    rows = []
    for i in range(900):
        e = 7 if r.random() < 0.4 else r.randrange(20)
        at = base + datetime.timedelta(minutes=r.randrange(2000))
        title = r.choice([None, "A", " A\n", "B", "C"]) if e != 3 else None
        rows.append((i, e, "c", "n", at.strftime("%Y-%m-%dT%H:%M:%SZ") if r.random() > 0.02 else None, title, r.choice([None, None, "2025-01-01T00:00:00Z", "2025-01-01T01:00:00+01:00", "2025-02-01T00:00:00Z"]), base + datetime.timedelta(seconds=i)))
    rows += rows[:50]
    df = spark.createDataFrame(rows, LOG).withColumn("k", F.lit("x")).withColumn("p", F.lit(1))
    want = []
    by = {}
    for x in sorted({x for x in rows if x[4]}, key=lambda x: x[7]):
        by.setdefault(x[1], {})[x[4]] = x
    for e, reads in by.items():
        state, starts = None, []
        for t in sorted(reads):
            x = reads[t]
            now = (x[5].strip() if x[5] is not None else None, {"2025-01-01T01:00:00+01:00": "2025-01-01T00:00:00Z"}.get(x[6], x[6]))
            full = now if state is None else tuple(a if a is not None else b for a, b in zip(now, state, strict=True))
            if state is None or full != state:
                starts.append(t)
            state = full
        want += [(e, a, b) for a, b in zip(starts, [*starts[1:], H.END], strict=True)]
    assert sorted(map(tuple, H.title_history(df, partitions).collect())) == sorted(want)
    assert H.title_history(df.limit(0), partitions).count() == 0


def test_asof(spark):
    r = random.Random(2)
    right = [(r.choice([1, 1, 1, 2]), r.randrange(1000), i) for i in range(300)]
    left = [(r.choice([1, 1, 1, 2, 3]), r.randrange(1000), i) for i in range(300)]
    a, b = spark.createDataFrame(left, "k int, t long, id int"), spark.createDataFrame(right, "k int, u long, v int")
    want = {}
    for k, t, i in left:
        us = sorted((u, v) for kk, u, v in right if kk == k)
        at = bisect_right(us, (t, 1 << 60))
        want[i] = us[at - 1][1] if at else None
    for width in (None, 7, 100, 5000):
        got = {x.id: x.v for x in R.asof_join(a, b, ["k"], "t", "u", ["v"], width).collect()}
        assert got == want
    assert R.asof_join(a.limit(0), b, ["k"], "t", "u", ["v"]).count() == 0
    assert {x.v for x in R.asof_join(a, b.limit(0), ["k"], "t", "u", ["v"], 9).collect()} == {None}


def test_intervals(spark):
    r = random.Random(3)
    a, b = [(i, r.randrange(500)) for i in range(80)], [(i, r.randrange(500)) for i in range(80)]
    x, y = spark.createDataFrame(a, "i int, s long"), spark.createDataFrame(b, "j int, t long")
    got = sorted((p.i, p.j) for p in R.interval_join(x, y, "s", "t", 5, 12).collect())
    assert got == sorted((i, j) for i, s in a for j, t in b if s - 5 <= t <= s + 12)
    m = R.merged_intervals(spark.createDataFrame([(1, 0, 5, 2), (1, 5, 7, 1), (1, 3, 4, 1), (1, 9, 9, 1), (2, 1, 1, 1)], "k int, s int, e int, w int"), ["k"], "s", "e", "w")
    assert sorted(map(tuple, m.collect())) == [(1, 0, 7, 3, 4), (1, 9, 9, 1, 1), (2, 1, 1, 1, 1)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in R.components(spark.createDataFrame(edges, "u int, v int"), "u", "v").collect()}
    assert got == {x: root(x) for x in parent}
    assert R.components(spark.createDataFrame([], "u int, v int"), "u", "v").count() == 0
    long = [(i, i + 1) for i in range(400)] + [(1000, i) for i in range(1001, 1200)]  # a chain and a hub
    got = {x.node: x.component for x in R.components(spark.createDataFrame(long, "u int, v int"), "u", "v").collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 601


def test_greedy_and_unique(spark):
    rows = [(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.85), (1, "b", "y", 0.1), (2, "a", "x", 0.5)]
    got = sorted(map(tuple, R.greedy_pairs(spark.createDataFrame(rows, "g int, a string, b string, s double"), "g", "a", "b", "s").collect()))
    assert got == [(1, "a", "x", 0.9), (1, "b", "y", 0.1), (2, "a", "x", 0.5)]
    r = random.Random(7)
    rows = list({(x[0], x[1], x[2]): x for x in ((r.choice([None, 1, 2]), r.randrange(15), r.randrange(15), r.choice([None, 0.1, 0.5, 0.5, 0.9])) for _ in range(250))}.values())
    taken, want = set(), []
    for g, a, b, x in sorted(rows, key=lambda x: (x[3] is None, -(x[3] or 0), x[1], x[2])):
        if ("a", g, a) not in taken and ("b", g, b) not in taken:
            taken |= {("a", g, a), ("b", g, b)}
            want.append((g, a, b, x))
    df = spark.createDataFrame(rows, "g int, a int, b int, s double")
    assert set(map(tuple, R.greedy_pairs(df, "g", "a", "b", "s").collect())) == set(want)
    assert R.greedy_pairs(df.limit(0), "g", "a", "b", "s").count() == 0
    q = R.top_k_with_overflow(spark.createDataFrame([(None, 3), (None, 1), (None, 2), (1, 5)], "k int, v int"), ["k"], [F.col("v")], 2)
    assert sorted((str(x.k), x.v, x.place, x.overflow) for x in q.collect()) == [("1", 5, 1, 0), ("None", 1, 1, 1), ("None", 2, 2, 1)]
    q = R.rank_quantiles(spark.createDataFrame([(1, float(i)) for i in range(10)] + [(1, None)], "k int, v double"), ["k"], "v", {"a": 0.5, "b": 1.0})
    assert [tuple(x) for x in q.collect()] == [(1, 5.0, 9.0)]


def test_paired_by_title(spark):
    left = [(1, "n", "Note on land, May 2020"), (2, "n", "Note on land, May 2020"), (3, "n", "Prison rules, June 2021"), (4, "n", "Prison rules, July 2021"), (5, "m", "Plain words of a title"), (6, "m", None), (7, None, "x y z")]
    right = [(11, "n", "note on LAND: may 2020 (accessible version)"), (12, "n", "Prison rule, June 2021"), (13, "n", "Wholly other, July 2021"), (14, "m", "Plain words of a titles"), (15, "m", "Plain title")]
    a, b = (spark.createDataFrame(x, "id long, g string, t string") for x in (left, right))
    got = sorted(map(tuple, R.paired_by_title(a.where("t IS NOT NULL"), b, "g", "id", "t").collect()))
    assert got == [(1, 11, "title"), (3, 12, "likeness"), (5, 14, "likeness")]
    assert R.paired_by_title(a.limit(0), b, "g", "id", "t").count() == 0


def test_names_and_readings(spark):
    from palimpsest.functions import links as L
    from palimpsest.functions import text as T

    one = spark.createDataFrame([("Updated Country information and assessments, not the overassessment; see General (part a).", ["Assessment", "Country information", "Country", "General (part a)", "x"])], "t string, n array<string>")
    assert one.select(T.names_in(F.col("t"), F.col("n"))).first()[0] == ["country information", "assessments", "general (part a)"]
    assert one.select(T.names_in(F.col("t"), F.array().cast("array<string>"))).first()[0] == []
    r = A.readings(F.lit("Left[3] the town¹\n 12 \nBack to contents\nearly [footnote 4] on"))
    got = one.select(*[T.words(r[k]).alias(k) for k in r]).first()
    assert got.plain[:2] == ["left", "3"] and got.flow == ["left", "the", "town", "early", "on"] and "12" in got.without_marks
    pages = F.transform(F.array(F.lit("a b"), F.lit("x y z"), F.lit("y z")), lambda p: F.concat(F.lit(" "), p, F.lit(" ")))
    assert tuple(one.select(A.page_of(pages, F.lit(" y z ")), A.page_of(pages, F.lit(" y "))).first()) == (2, 2) and one.select(A.page_of(pages, F.lit(" q "))).first()[0] is None
    hosts = spark.createDataFrame([("10.1.2.3", "private"), ("8.8.8.8", "public"), ("172.15.0.1", "public"), ("172.16.0.1", "private"), ("a.example", "name"), ("999.1.1.1", "name"), ("localhost", "private"), ("192.168.0.1:80", "private")], "h string, k string")
    assert all(r.h_kind == r.k for r in hosts.withColumn("h_kind", L.host_kind(F.col("h"))).collect())


def test_state(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), ("c", 2, None)], "k string, at int, value string")
    new = spark.createDataFrame([("b", 4, "z"), ("c", 3, None), ("d", 1, "n")], "k string, at int, value string")
    got = {r.k: (r.action, r.at, r.value) for r in S.merge_batch(old, new, "k").collect()}
    assert got == {"a": ("kept", 1, "x"), "b": ("updated", 5, "z"), "c": ("seen", 3, None), "d": ("inserted", 1, "n")}
    again = S.merge_batch(spark.createDataFrame([(k, *v[1:]) for k, v in got.items()], "k string, at int, value string"), new, "k")
    assert {r.action for r in again.collect()} <= {"seen", "kept"}
    b = spark.createDataFrame([(i // 3, i, 10) for i in range(12)], "block int, i int, size int")
    assert sorted(r.i for r in S.within_budget(b, ["i"], "size", 75, "block").collect()) == list(range(7))


def test_editions(spark):
    d = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "a"), ("s", 4, "a"), ("t", 1, "a")], "s string, o int, h string")
    got = sorted((r.s, r.kept, r.copies) for r in E.collapse_copies(d, "s", "o", "h", F.col("o")).collect())
    assert got == [("s", 1, 1), ("s", 2, 1), ("s", 4, 2), ("t", 1, 1)]
    t = spark.createDataFrame([("s", 1, "a b c d e f"), ("s", 2, "a b c d e f g"), ("s", 3, None), ("s", 4, ""), ("t", 9, "x y")], "s string, o int, t string")
    got = {(r.s, r.o): r.similarity for r in E.similarity_to_previous(t, "s", "o", "t").collect()}
    assert got == {("s", 1): None, ("s", 2): 0.667, ("s", 3): 0.0, ("s", 4): 1.0, ("t", 9): None}


def test_alignment():
    """Kept words are as many as a plain table finds, for any cut of the table and any size."""
    r = random.Random(8)
    strip = A.STRIP
    try:
        for A.STRIP in (1, 3, 64, strip):
            for _ in range(150):
                k = r.choice([1, 2, 5, 20])
                a, b = ([r.randrange(k) for _ in range(r.randrange(30))] for _ in range(2))
                m = A.common_subsequence(a, b)
                assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
                assert len(m) == plain_length(a, b)
    finally:
        A.STRIP = strip
    for n in (40, 80, 1200, 5000):
        assert len(A.common_subsequence(["x", "y"] * n, ["y", "x"] * n)) == 2 * n - 1
    a = [f"w{r.randrange(400)}" for _ in range(3000)]
    b = [x for i, x in enumerate(a) if i % 50]
    assert len(A.common_subsequence(a, b)) == len(b) and A.common_subsequence(a, a) == [(i, i) for i in range(3000)] and A.common_subsequence([], b) == []
    assert [v for v in map([3, 1, 2, 0, 5].__getitem__, A.rising([3, 1, 2, 0, 5]))] == [1, 2, 5]
    assert A.uncovered([(1, 0), (2, 3)], 4, 4) == [(0, 1, 0, 0), (2, 2, 1, 3), (3, 4, 4, 4)]
    assert A.dice(["a", "a", "b"], ["a", "b", "c"]) == pytest.approx(4 / 6) and A.dice([], []) == 1.0


def plain_length(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        above = rows[:]
        for j, y in enumerate(b):
            rows[j + 1] = above[j] + 1 if x == y else max(above[j + 1], rows[j])
    return rows[-1]


def test_blocks():
    old = "<h2>One</h2><p>Alpha beta gamma delta.</p><p>Stays the same here.</p><p>Goes away entirely now.</p>"
    new = "<h2>One</h2><p>Alpha beta gamma epsilon.</p><p>Stays the same here.</p><li>Quite new words come.</li>"
    assert sorted(x[0] for x in A.block_rows(old, new)) == ["add", "del", "eq", "eq", "mod"]
    assert A.block_rows(old, old) == [("eq", i, i, 0, 0) for i in range(4)] and A.block_rows(None, None) == []
    old = "<h2>Head</h2><p>1.1 Alpha beta gamma delta.</p><li>one two three four five six seven eight nine ten</li><p>1.2 gone away now</p>"
    new = "<h2>Head</h2><p>1.2 Alpha beta gamma delta.</p><li>one two three four five</li><li>six seven eight nine ten</li><p>brand new thing</p>"
    assert A.block_rows(old, new) == [("eq", 0, 0, 0, 0), ("renum", 1, 1, 0, 0), ("split", 2, 2, 0, 0), ("split", 2, 3, 0, 0), ("del", 3, None, 0, 5), ("add", None, 4, 3, 0)]
    assert [x[0] for x in A.block_rows(new, old)] == ["eq", "renum", "merge", "merge", "add", "del"]
    # words are neither lost nor counted twice, whatever stands for what
    r = random.Random(3)
    for _ in range(60):
        side = lambda: "".join(f"<{t}>{' '.join(r.choice('abcdefgh') for _ in range(r.randrange(1, 9)))}</{t}>" for t in r.choices(["p", "li"], k=r.randrange(9)))
        x, y = side(), side()
        rows, count = A.block_rows(x, y), lambda s: sum(len(A.WORD.findall(t)) for _, t in A.blocks(s))
        assert count(y) - count(x) == sum(x[3] - x[4] for x in rows)
        assert sorted({x[1] for x in rows if x[1] is not None}) == list(range(len(A.blocks(x)))) and sorted({x[2] for x in rows if x[2] is not None}) == list(range(len(A.blocks(y))))


def test_paragraph_map():
    old = "<p>1.1 Alpha beta.</p><p>1.2 Gamma delta.</p><p>1.3 Old words only.</p><p>1.4 One.</p><p>1.4 Two.</p><p>1.5 Epsilon zeta eta.</p>"
    new = "<p>1.1 Alpha beta.</p><p>1.3 Gamma delta.</p><p>1.4 One.</p><p>Epsilon zeta eta.</p>"
    assert A.paragraph_map(old, new) == [("1.1", "1.1", "same"), ("1.2", "1.3", "different"), ("1.3", None, "gone"), ("1.4", None, "repeated"), ("1.5", None, "unnumbered")]
    assert A.paragraph_map(None, new) == []


def test_differences(spark):
    """Kind, size, verdict and second opinion of planted differences."""
    cases = {
        "numbering": ("<p>1.1 Alpha beta.</p>", "<p>1.2 Alpha beta.</p>"), "spacing": ("<p>a as long as it lasts here</p>", "<p>a as longas it lasts here</p>"),
        "ligature": ("<p>the specific case stood there</p>", "<p>the speci c case stood there</p>"), "number format": ("<p>on 05 May it came to be</p>", "<p>on 5 May it came to be</p>"),
        "heading": ("<h2>Old name here now</h2>", "<h2>Old title here now</h2>"), "table cell": ("<td>Zaniri 40 people</td>", "<td>Zaniri 50 people</td>"),
        "withheld notice": ("<p>before this</p>", "<p>before this</p><p>The information in this section has been removed</p>"), "back to contents": ("<p>x y</p>", "<p>x y</p><p>Back to contents</p>"),
        "bibliography": ("<h2>Sources</h2><p>A press and more</p>", "<h2>Sources</h2><p>B press and more</p>"), "text": ("<p>many people left the town early</p>", "<p>many persons left the town early</p>"),
        "address as text": ("<p>see the page</p>", "<p>see the page at https example</p>"), "section updated": ("<p>x y</p>", "<p>x y</p><p>Section updated 5 May 2024</p>"),
    }
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases.values())] + [(99, None, None)], "id long, a string, b string")
    d = A.word_differences(df, "id", "a", "b")
    c = {x: F.col(x) for x in d.columns}
    rows = d.select("id", A.difference_kind(c).alias("kind"), A.difference_size(c["old_words"], c["new_words"]).alias("size"), A.difference_group(A.difference_kind(c)).alias("g")).collect()
    assert {list(cases)[r.id]: r.kind for r in rows} == {k: k for k in cases} and len(rows) == len(cases)
    sizes = {list(cases)[r.id]: r.size for r in rows}
    assert (sizes["text"], sizes["table cell"], sizes["withheld notice"], sizes["heading"]) == ("word", "number", "passage", "word")
    assert {r.g for r in rows} == {"numbering", "form", "wording", "withheld", "furniture", "address"}
    one = spark.createDataFrame([(["two"], ["three"], ["there", "were"], ["people", "here"])], "old_words array<string>, new_words array<string>, before array<string>, after array<string>")
    c = {x: F.col(x) for x in one.columns}
    says = lambda t: one.select(A.second_opinion(c, F.lit(t)).alias("o"), A.verdict(c, F.lit(""), F.lit(t)).alias("v")).first()
    assert tuple(says(" there were three people here ")) == ("agrees", "real") and tuple(says(" there were two people here ")) == ("disputes", "artefact") and tuple(says(" else ")) == ("cannot tell", "unresolved")


@pytest.mark.parametrize("partitions", [1, 2, 9])
def test_neighbours(spark, partitions):
    """Rows before and running sums over ranges are those of a plain loop; one series holds half of the rows, one is null."""
    from palimpsest.operators import neighbours as M

    r = random.Random(6)
    rows = [(i, "hot" if r.random() < 0.5 else r.choice([None, "a", "b", "c"]), r.randrange(40), f"t{i}", r.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s string, o int, t string, n int")
    got = {x.id: (x.previous, x.t, x.previous_t) for x in M.beside_previous(df, "s", ["o", "id"], "id", ["t"], partitions).collect()}
    sums = {x.id: x.total for x in M.with_running_sum(M.ranges(df, "s", ["o", "id"], ["n"], partitions), "s", ["o", "id"], "n", "total").collect()}
    want, total, by = {}, {}, {}
    for i, s, o, t, n in rows:
        by.setdefault(s, []).append((o, i, t, n))
    for x in by.values():
        before, sofar = (None, None), 0
        for o, i, t, n in sorted(x):
            want[i], sofar = (before[0], t, before[1]), sofar + n
            before, total[i] = (i, t), sofar
    assert got == want and sums == total
    assert M.beside_previous(df.limit(0), "s", ["o", "id"], "id", ["t"], partitions).count() == 0


def test_passages():
    a = "<h2>A</h2><p>First words stand here.</p><h2>B</h2><p>Second words follow later on.</p>"
    b = "<h2>A</h2><p>Second words follow later on.</p><h2>B</h2><p>Entirely other matter now.</p>"
    got = A.passages(a, b)
    # either the heading or the passage keeps its place; the other one has moved
    assert {("add", 1, True, False), ("del", 1, True, False)} <= set(got) or {("add", 5, True, True), ("del", 5, True, False)} <= set(got)
    assert A.passages(a, a) == [] and A.passages(None, None) == []


def test_large_gaps():
    r = random.Random(5)
    old = [[f"w{r.randrange(5000)}" for _ in range(12)] for _ in range(1200)]
    new = [w[:10] + ["changed"] for w in old if r.random() < 0.9]
    p = A.paired(old, new)
    assert len(p) >= 0.97 * len(new) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:], strict=False))


def plain_pairs(old, new, least=0.5):
    """The whole table, cell by cell."""
    s = [[d if x + y and (d := A.dice(x, y)) >= least else 0.0 for y in new] for x in old]
    best = [[0.0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        for j in range(len(new) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], s[i][j] + best[i + 1][j + 1] if s[i][j] else 0.0)
    out, i, j = [], 0, 0
    while i < len(old) and j < len(new):
        if s[i][j] and best[i][j] == s[i][j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def test_pairs_equal_the_whole_table():
    r = random.Random(11)
    for n in [*range(8)] * 20 + [60, 90]:
        old = [[f"w{r.randrange(9)}" for _ in range(r.randrange(7))] for _ in range(n)]
        new = [[x if r.random() < 0.8 else "new" for x in w] for w in old if r.random() < 0.8] + [["w1", "w2"]] * r.randrange(3)
        assert A.paired(old, new) == plain_pairs(old, new) and A.paired(new, old) == plain_pairs(new, old)


@pytest.mark.parametrize("n", [900, 1500])
def test_repeated_words_in_large_gaps(n):
    """Rows of a table with a small vocabulary: each changed in one word, every word at more than 256 places; no pair may be lost at any size."""
    old = [["row", "of", "the", "list", f"a{i % 3}", f"b{i % 2}", "was"] for i in range(n)]
    new = [[*w[:-1], "is"] for w in old]
    assert A.paired(old, new) == [(i, i) for i in range(n)]
    body = lambda rows: "".join(f"<p>{' '.join(w)}</p>" for w in rows)
    assert {k for k, *_ in A.block_rows(body(old), body(new))} == {"mod"}


def occurrence(spark, **have):
    from pyspark.sql.types import StructType

    base = dict.fromkeys(StructType.fromDDL(U.SCHEMA).names) | {"occurrence": 1} | have
    return spark.createDataFrame([tuple(base.values())], U.SCHEMA)


def screened(spark, cases):
    """States of many occurrences at once: case -> rule -> state."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(U.SCHEMA).names
    rows = [tuple((dict.fromkeys(names) | {"occurrence": i} | have).values()) for i, have in enumerate(cases.values())]
    out = {k: {} for k in cases}
    for r in U.screen(U.with_near(spark.createDataFrame(rows, U.SCHEMA))).collect():
        out[list(cases)[r.occurrence]][r.rule] = r.state
    return out


def states(spark, **have):
    return {r.rule: r.state for r in U.screen(U.with_near(occurrence(spark, **have))).collect()}


def test_rules(spark):
    none = states(spark)
    assert len(none) == 56 and none["contextual-support"] == "unable" and none["quotation-exact"] == "not_applicable" and "candidate" not in none.values()
    doc = "the report says that many people were seen in the north of the country during the year and that all was calm"
    quote = "“many people were seen in the north of the country during the year”"
    s = states(spark, claim=f"It states {quote}. 12 of 50 (30%) left. Figures ranged from 9 to 3 in all. 140% of them.", doc=doc, second=doc, refs=["1", "2"], targets=["1", "1"], url="https://a.example/x.pdf", href="https://a.example/x.pdf).", status="downloaded", final_url="https://a.example/y.pdf", kind="html", fetched_at="2026",
               cite="A. Press, ‘A report on the north of it’, 5 May 2024, page 9, ISBN 0-306-40615-3, 31 February 2020, accessed 1 May 2024", published="2024-03-01", headers="A report on the north of it 2024 Access denied", doc_dates=["2024-05-06"], pages=4, content=doc, receipt_sha="00", url_dates=["a", "b"])
    want = {
        "reference-target": "candidate", "duplicate-reference": "candidate", "source-url-boundary": "candidate", "source-retrieval": "pass", "source-redirect": "observation", "source-integrity": "candidate", "source-readable": "unable", "citation-title": "pass",
        "publication-date": "candidate", "source-future-date": "candidate", "access-before-publication": "candidate", "isbn-checksum": "candidate", "invalid-calendar-date": "candidate", "source-physical-page": "observation", "quotation-exact": "pass",
        "quotation-independent-reader": "pass", "quotation-repetition": "pass", "percentage-arithmetic": "candidate", "impossible-percentage": "candidate", "reversed-range": "candidate", "duplicate-url-citation-date": "candidate", "source-content-type": "observation", "source-pinpoint-present": "pass", "capture-applicability": "unable",
    }
    assert {k: s[k] for k in want} == want
    e = states(spark, claim="“many people were seen … during the year and that all was calm”", doc=doc)
    assert e["quotation-ellipsis"] == "pass"
    assert states(spark, claim="“during the year and that all … many people were seen in the north”", doc=doc)["quotation-ellipsis"] == "unable"


def test_changed_quotations(spark):
    """What differs between a quotation and its source, and that equal wording changes nothing."""
    source = "the office said that at least 40 people had not left the town by the end of the month because of the rain"
    said = lambda q, **have: {"claim": f"It said: “{q}”.", "doc": source} | have
    kinds = ("changed-number", "changed-negation", "changed-qualifier", "changed-unit")
    swaps = {"changed-number": (" 40 ", " 50 "), "changed-negation": ("had not left", "had just left"), "changed-qualifier": ("at least 40", "nearly about 40"), "changed-unit": ("40 people", "40 families")}
    cases = {"same": said(source), "form": said(source.replace(" 40 ", " forty ")), "insertion": said(source.replace("rain", "rain [and snow]"))}
    cases |= {k: said(source.replace(a, b)) for k, (a, b) in swaps.items()} | {k + "-second": said(source.replace(a, b), second="an entirely other reading of the page") for k, (a, b) in swaps.items()}
    cases |= {"gap": {"claim": "“the office said that … by the end of the month because of the rain”", "doc": source}}
    cases |= {f"page {i}": {"claim": f"“{source}”", "doc": source, "cite": f"A, ‘B’, page {i}", "page_texts": ["other", source]} for i in (1, 2)}
    got = screened(spark, cases)
    assert got["same"]["quotation-exact"] == "pass" and {got["same"][k] for k in kinds} == {"pass"} and got["same"]["quotation-near-match"] == "not_applicable"
    for k in swaps:
        assert got[k]["quotation-near-match"] == "candidate" and [x for x in kinds if got[k][x] == "candidate"] == [k]
        assert got[k + "-second"][k] != "candidate"
    assert got["form"]["quotation-near-match"] == "observation" and got["form"]["quotation-number-format"] == "observation" and got["form"]["changed-number"] == "pass"
    assert got["insertion"]["editorial-insertion"] == "observation"
    assert got["gap"]["changed-qualifier"] == "candidate" and got["gap"]["quotation-ellipsis"] == "pass"
    assert got["page 2"]["quotation-pinpoint"] == "observation" and got["page 1"]["quotation-pinpoint"] == "unable"


def test_near_windows():
    """Every start is compared, however many there are; two windows of nearly one likeness decide nothing."""
    from palimpsest.operators import quotes as M

    q = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    far = " ".join(["one two three four other words follow here and on"] * 40)
    assert M.near(q, f"{far} {q.replace('eight', 'ate')}")["differences"] == ["8 -> ate"] or M.near(q, f"{far} {q.replace('eight', 'ate')}")["differences"] == ["eight -> ate"]
    assert M.near(q, f"{q.replace('eight', 'ate')} and {q.replace('nine', 'none')}") is None
    assert M.near(q, q) is None and M.near(None, q) is None and M.near(q, "") is None and M.near("a short one", q) is None
    assert M.near(q, q.replace("eight", "eight[12]"))["marker"] or M.near(q, q.replace(" eight", " [12] eight"))["marker"]
    assert M.quantities("5% of $40, 12 million people and 3 days") == [("5", "%"), ("40", "$"), ("12", "million"), ("3", "days")]


def test_near_quotes(spark):
    q = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, q, f"before {q.replace('ten', 'tin')} after"), (2, q, f"x {q} y"), (3, q, "nothing alike"), (4, None, q), (5, "short one", q)]
    got = {r.id: r.similarity for r in U.near_quotes(spark.createDataFrame(rows, "id long, q string, d string"), "id", "q", "d").collect()}
    assert got == {1: 0.95}


def test_search(spark):
    q = Q.parse("The latest notes on Prisons in Grünwald Republic", ["Grünwald Republic", "Maravel"], {"prisons": "prison"})
    assert (q.countries, q.hard, q.soft) == (["Grünwald Republic"], ["prison"], ["latest", "notes"])
    df = spark.createDataFrame([("Maravel", "Prison latest notes"), ("Maravel", "prisoners"), ("Maravel", "imprisoned"), (None, None)], "c string, t string")
    m = lambda **k: sorted(r.t for r in Q.match(df, Q.Query(**k), F.col("t"), F.col("c")).collect())
    assert m(hard=["prison"], soft=["latest"]) == ["Prison latest notes"]
    assert m(hard=["prison"], soft=["unheard"]) == ["Prison latest notes", "prisoners"]
    assert m(soft=["unheard"]) == []


def test_figures_and_quotes():
    from palimpsest.operators import numbers as M

    assert M.as_digits("three hundred and forty-two people, one of 1,234 and one million, twenty one") == "342 people, one of 1234 and 1 million, 21"
    assert M.as_digits("One hundred, five hundred and that; ninety-nine x twenty zero one_two seven7 two  hundred") == "100, 500 and that; 99 x 20 0 one_two seven7 2  hundred"
    assert M.as_digits("someone nineteen hundred 1,23") == "someone 19 hundred 1,23"
    text = "aa quote here bb ... cc quote here dd"
    assert M.locate(text, "quote here", "cc ", " dd", 0) == text.rindex("quote")
    assert M.locate(text, "quote here", "", "", 0) == 3 and M.locate(text, "none", "", "", 0) == -1
