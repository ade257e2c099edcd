import unicodedata

from palimpsest.llm import lookalike as L


def twins(spark, bodies, titles=((1, "Plain title"),)):
    e = spark.createDataFrame([(i, None, s, b) for i, s, b in bodies], "edition_id long, title string, text_sha256 string, body string")
    t = spark.createDataFrame(list(titles), "title_id long, title string")
    return sorted((r.edition_id, r.twin_id) for r in L.body_twins(e, t).collect())


def test_same_and_different_looks():
    same = [("café", "café"), ("office", "oﬃce"), ("Country", "Соuntry"), ("a b", "a b"), ("abc", "ａｂｃ"), ("abc", "a​b­c"), ("well-kept", "well‑kept"), ("Ё".replace("Ё", "Ë"), "Ё"), ("gala", "ɡɑlа")]
    other = [("abc", "Abc"), ("café", "cafe"), ("O", "0"), ("l", "1"), ("x²", "x2"), ("a-b", "a–b"), ("k", "к"), ("…", "..."), ("l", "I")]
    for a, b in same:
        assert L.by_table(a) == L.by_table(b), (a, b)
    for a, b in other:
        assert L.by_table(a) != L.by_table(b), (a, b)


def test_table_and_trie_agree():
    words = {w: w for w in ("naïve", "office", "Country", "co-op", "ﬁne", "São")}
    trie = L.Trie(words)
    back = {b: a for a, b in zip(*L.SAME_SHAPE, strict=True)}
    for w in words:
        for v in (w, unicodedata.normalize("NFD", w), "⁠".join(w), "".join(back.get(c, c) for c in w), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in w)):
            assert trie.walk(v) == (0, w)
            assert L.by_table(v) == L.by_table(w)
    assert trie.walk("Countri") is None
    assert trie.walk("Соuntri", 1) == (1, "Country")
    assert trie.walk("Cuntry", 1) == (1, "Country")
    assert trie.walk("Counttry", 1) == (1, "Country")
    assert trie.walk("Cntry", 1) is None


def test_automaton_on_raw_text():
    """Spellings are kept as they are written, in any alphabet: the table alone would write them otherwise."""
    trie = L.Trie({w: w for w in ("ОРЕС", "Ελλάδα", "ﬁne", "co\u00adop")})
    for seen, spelt in (("OPEC", "ОРЕС"), ("ОPЕC", "ОРЕС"), ("ＯＰＥＣ", "ОРЕС"), ("fine", "ﬁne"), ("f\u200bine", "ﬁne"), ("coop", "co\u00adop"), ("Eλλάδα", "Ελλάδα"), ("Ελλα\u0301δα", "Ελλάδα")):
        assert trie.walk(seen) == (0, spelt), seen
    assert L.canonical_words("OPEC and Eλλάδα", trie) == "ОРЕС and Ελλάδα" != L.by_table("OPEC and Eλλάδα")
    assert L.canonical_words("ОPEC", trie) == L.canonical_words("OPEC", trie) == L.canonical_words("ОРЕС", trie)
    assert trie.walk("fin", 1) == (1, "ﬁne") and trie.walk("ne", 1) is None and trie.walk("ne", 2) == (2, "ﬁne") and trie.walk("finer", 1) == (1, "ﬁne") and trie.walk("", 0) is None
    assert L.Trie({}).walk("x") is None and L.Trie({}).walk("x", 3) is None


def test_automaton_against_edit_distance():
    """Costs are those of a plain table over what is shown."""
    import random

    r = random.Random(2)
    shown = lambda w: "".join(L.look(c) for c in unicodedata.normalize("NFD", w))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    letters = "abcаоﬁ\u200bé"
    for _ in range(300):
        known = {"".join(r.choices(letters, k=r.randrange(1, 6))): i for i in range(r.randrange(1, 5))}
        text, budget = "".join(r.choices(letters, k=r.randrange(6))), r.randrange(3)
        costs = {w: distance(shown(w), shown(text)) for w in known}
        near = min(costs.values())
        hit = L.Trie({w: w for w in known}).walk(text, budget)
        assert (hit is None and near > budget) or (hit is not None and hit[0] == near <= budget and costs[hit[1]] == near), (known, text, budget, hit)


def test_groups(spark):
    rows = [(1, "a", "<p>One café.</p>"), (2, "b", "Onе cafe&#x301;."), (3, "c", "Other"), (4, None, None), (5, "a", "One café."), (1, "a", "<p>One café.</p>")]
    e = spark.createDataFrame([(i, None, s, b) for i, s, b in rows], "edition_id long, title string, text_sha256 string, body string")
    got = sorted(map(tuple, L.body_groups(e, spark.createDataFrame([(1, "x")], "title_id long, title string")).collect()))
    assert got == [(1, 1, 3, 2), (2, 1, 3, 2), (3, 3, 1, 1), (5, 1, 3, 2)]


def test_titles(spark):
    e = spark.createDataFrame([(1, "Plаin title"), (2, "Plain title"), (3, None), (4, "plain title"), (1, "Plаin title"), (5, "Plain title"), (6, ""), (7, "Plain  title")], "edition_id long, title string")
    t = spark.createDataFrame([(9, "Plain title"), (8, "Рlain other")], "title_id long, title string")
    assert sorted(map(tuple, L.title_twins(e, t).collect())) == [("title", 1, 9), ("title", 5, 9)]
    assert L.title_twins(e.limit(0), t).count() == 0
    forms = {r.edition_id: r.title_form for r in L.normalised_titles(e, t).collect()}
    assert forms == {1: "Plain title", 2: "Plain title", 3: None, 4: "plain title", 5: "Plain title", 6: "", 7: "Plain  title"}


def test_bodies(spark):
    rows = [
        (1, "a", "<p>One café.</p>"), (2, "b", "<!-- x --><p>One cafe&#x301;.</p>"), (3, "c", "Onе&nbsp;café. ↩"), (4, "d", "One cafe."), (5, None, None), (6, "e", ""), (7, "f", "<p> </p>"), (8, "g", "<i></i>"),
        (9, "a", "<p>One café.</p>"), (1, "a", "<p>One café.</p>"), (10, "z", "x" * 200_000), (11, "y", "x" * 199_999 + "х"),
    ]
    assert twins(spark, rows) == [(1, 2), (1, 3), (2, 3), (2, 9), (3, 9), (10, 11)]
    assert twins(spark, [(i, "hot", "same") for i in range(50)] + [(99, "other", "sаme")]) == [(i, 99) for i in range(50)]


def test_against_table_only(spark, sf):
    """Groups by the table of characters over whole texts, without trie and Spark."""
    from collections import defaultdict

    from palimpsest.llm.markup import without_markup
    from palimpsest.session import table

    e, t = table(spark, sf, "export_editions"), table(spark, sf, "official_titles")
    groups = defaultdict(dict)
    for r in e.select("edition_id", "text_sha256", "body").collect():
        if r.body:
            f = "".join(unicodedata.normalize("NFC", unicodedata.normalize("NFD", without_markup(r.body, "").replace("↩", "").translate(L.images()))).split())
            if f:
                groups[f][r.edition_id] = r.text_sha256
    want = {(a, b) for g in groups.values() for a in g for b in g if a < b and g[a] != g[b]}
    assert {(r.edition_id, r.twin_id) for r in L.body_twins(e, t).collect()} == want
