import random
from fractions import Fraction

import numpy as np
import pytest

from palimpsest.llm import neardup as N
from palimpsest.session import table


def brute(rows, threshold):
    ps = N.PhraseSets()
    sets = {k: (s or "", ps.of(b)) for k, s, b in rows}
    sets = {k: v for k, v in sets.items() if v[1] is not None}
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            (sa, x), (sb, y) = sets[a], sets[b]
            if sa != sb and len(np.intersect1d(x, y)) >= threshold * max(len(x), len(y)):
                out.add((a, b))
    return out


def found(df, threshold):
    return sorted((r.edition_a, r.edition_b) for r in N.edition_pairs(*N.class_links(df, "edition_id", "text_sha256", "body", threshold)).collect())


def made(seed, n=220):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    boiler = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            words = list(r.choice(rows)[3])
            for _ in range(r.randrange(0, 12)):
                at = r.randrange(len(words) + 1)
                what = r.random()
                words[at : at + (what < 0.6)] = [r.choice(vocabulary)] if what > 0.3 else []
            if r.random() < 0.2:
                words = words[len(words) // 2 :] + words[: len(words) // 2]
        else:
            words = [r.choice(vocabulary) for _ in range(r.randrange(1, 90))]
            if r.random() < 0.5:
                words += boiler
        rows.append((i, f"s{i % 97}" if r.random() < 0.9 else None, "<p>" + " ".join(words) + "</p>", words))
    rows += [(n, "a", None, []), (n + 1, "b", "", []), (n + 2, "c", "<p>!</p>", []), (3, *rows[3][1:])]
    return [x[:3] for x in rows]


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.5), (2, 0.8), (3, 0.5), (4, 0.3)])
def test_against_brute_force(spark, seed, threshold, monkeypatch):
    monkeypatch.setattr(N, "SPLIT", 3)
    monkeypatch.setattr(N, "PHRASES_A_GROUP", 500)
    monkeypatch.setattr(N, "BLOCK", 1)
    rows = made(seed)
    df = spark.createDataFrame(rows, "edition_id long, text_sha256 string, body string")
    got = found(df, threshold)
    assert len(got) == len(set(got))
    assert set(got) == brute({r[0]: r for r in rows}.values(), threshold)


def test_hot_group(spark):
    """A third of all rows are copies of one text under few hashes."""
    rows = [(i, f"s{i}", " ".join(f"x{i}y{j}" for j in range(30))) for i in range(200)] + [(1000 + i, "hot" if i else "cold", " ".join(f"h{j}" for j in range(60))) for i in range(100)]
    df = spark.createDataFrame(rows, "edition_id long, text_sha256 string, body string")
    assert found(df, 0.5) == [(1000, 1000 + i) for i in range(1, 100)]


def test_members_and_links(spark):
    """Classes and their links hold all pairs: expanded, they are what `edition_pairs` gives."""
    df = spark.createDataFrame(made(7), "edition_id long, text_sha256 string, body string")
    members, links = N.class_links(df, "edition_id", "text_sha256", "body", 0.5)
    rows, linked = N.member_rows(members).collect(), {(r.class_a, r.class_b) for r in N.link_rows(members, links).collect()}
    want = {(a.edition_id, b.edition_id) for a in rows for b in rows if a.edition_id < b.edition_id and a.text_sha256 != b.text_sha256 and (a.class_id == b.class_id or tuple(sorted((a.class_id, b.class_id))) in linked)}
    assert set(found(df, 0.5)) == want and all(a < b for a, b in linked)


def test_counts_and_cells(spark):
    """Levels are never too low, at any width; every pair of a cut list meets in exactly one cell."""
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 500, 40).astype(np.uint64) ** 3) for _ in range(300)]
    df = spark.createDataFrame([(i, bytearray(N.pack(x))) for i, x in enumerate(sets)], "cls long, tokens binary")
    names, count = np.unique(np.concatenate(sets), return_counts=True)
    for total in (1, 12_000):
        levels = N.phrase_levels(df, total, 3)
        got = levels[N._place(names, len(levels))]
        assert (got >= N.level_of(count)).all() and (total == 1 or (got == N.level_of(count)).mean() > 0.9)
    cls = np.arange(50, dtype=np.int64) * 7919
    entry, cell, side = N.cells(np.full(50, 9, np.uint64), np.full(50, N.level_of(np.array([50]))[0], np.uint8), cls, 8)
    met = {}
    for i in range(len(entry)):
        for j in range(i):
            if cell[i] == cell[j] and (side[i] == 0 or side[i] != side[j]):
                p = tuple(sorted((entry[i], entry[j])))
                met[p] = met.get(p, 0) + 1
    assert met == {(i, j): 1 for j in range(50) for i in range(j)}


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "edition_id long, text_sha256 string, body string, cls string, a string, n string")
    assert found(df, 0.5) == []
    long = " ".join(f"v{i}" for i in range(120_000))
    df = spark.createDataFrame([(1, "x", long, "c"), (2, "y", long + " tail", "c")], "edition_id long, text_sha256 string, body string, cls string")
    assert found(df, 0.8) == [(1, 2)]
    got = {r.edition_id: (r.class_id, r.copies, r.links) for r in N.classes(*N.class_links(df, "edition_id", "text_sha256", "body", 0.8)).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 1, 1)}


def test_answers_by_difference():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 39, 400).astype(np.uint64))
    sets = {i: np.unique(np.concatenate((base[r.random(len(base)) < 0.97], r.integers(0, 1 << 39, 5).astype(np.uint64)))) for i in range(30)}
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30)]
    assert N.overlaps(pairs, sets) == [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    assert N.needed(5, Fraction("0.8")) == 4
    assert (N.unpack(N.pack(base)) == base).all()


def test_editions(spark, sf):
    df = table(spark, sf, "export_editions").select("edition_id", "text_sha256", "body")
    rows = {r[0]: tuple(r) for r in df.collect()}
    assert set(found(df, 0.5)) == brute(rows.values(), 0.5)
