import numpy as np

from palimpsest.llm import subjects as S
from palimpsest.session import table

NOUNS = {"fish": "trout salmon carp pike eel perch".split(), "music": "violin trumpet drum flute cello harp".split(), "stone": "granite marble basalt slate chalk gneiss".split()}


def sentence(r, subject=None):
    if subject is None:
        return r.choice(["Earlier notes are kept in the archive.", "The sources are listed at the end.", "Nothing else has changed since then."])
    a, b = r.choice(NOUNS[subject], 2, replace=False)
    return r.choice([f"Access to the {a} depends on a {b}.", f"They compared the {a} with the {b}."])


def samples(spark, r):
    rows = [(i, s, "en", " ".join([sentence(r, s) for _ in range(5)] + [sentence(r) for _ in range(4)])) for i, s in enumerate(sorted(NOUNS) * 12)]
    return spark.createDataFrame(rows, "sample_id long, subject string, lang string, text string")


def sentence_words(text):
    """Last two words of each sentence, by their hashes."""
    names = {S.word_hash(w): w for t in S.tokens_of(text or "") for w in S.words(t)}
    hashes, ends = S.sentences(text, S.Tokens())
    return [[names[x] for x in hashes[a:z]][-2:] for a, z in zip([0, *ends], ends, strict=False)]


def test_sentences():
    t = "## Heading without end\nTo the desk,\n\nQ: It was cold in May. 3.1.2 “They left early,” said one.\r\n- A broken\nline ends here! 12. Second item follows.\nYours sincerely"
    assert sentence_words(t) == [["in", "may"], ["said", "one"], ["ends", "here"], ["item", "follows"]]
    assert sentence_words("") == [] and sentence_words(None) == [] and sentence_words("No end") == [] and sentence_words("Word.") == []
    assert [len(x) for x in sentence_words("法院审理了案件。球队赢得了比赛。")] == [1, 1]


def test_updates_do_not_increase_divergence():
    """Rounds of mixtures and components on made sentences: the divergence falls, zeros stay zero, weights sum to the sentences."""
    r = np.random.default_rng(1)
    columns = np.arange(0, 60, 2)
    texts = [[r.integers(0, 60, r.integers(1, 9)) for _ in range(r.integers(1, 7))] for _ in range(40)]
    e = S.Entries(np.concatenate([w for t in texts for w in t]), [np.cumsum([len(w) for w in t]) for t in texts], columns)
    assert np.isclose(np.bincount(e.row, e.value, e.rows), e.sentences).all()
    v = np.zeros((e.rows, len(columns) + 1))
    np.add.at(v, (e.row, e.column), e.value)
    h = r.uniform(0.5, 1.5, (4, len(columns) + 1))
    h[0, :5] = 0
    h /= h.sum(1, keepdims=True)
    kl = lambda w, h: (np.where(v > 0, v * np.log(np.maximum(v, 1e-12) / (w @ h + 1e-12)), 0) - v + w @ h).sum()
    last = np.inf
    for _ in range(15):
        w = S.folded(e, h, 3)
        assert kl(w, h) <= last + 1e-6
        names, more, own = S.numerators(e, w, h)
        # the update of the whole matrix, plainly
        assert np.allclose(own, (h * (w.T @ (v / (w @ h + 1e-12)))).T)
        assert set(names) == {x for t in texts for s in t for x in s if x % 2}
        x = int(names[3])
        q = w[:, None, :] * h.T[None] * (v / np.maximum(w @ h, 1e-12))[:, :, None]
        assert np.isclose(more.sum(), sum(len({x for x in s.tolist() if x % 2}) for t in texts for s in t)) and np.isclose(more[3].sum(), sum(x in s for t in texts for s in t)) and np.isclose(q.sum(), v.sum())
        last = kl(w, h)
        h = own.T / own.sum(0)[:, None]
        assert (h[0, :5] == 0).all()


def test_planted(spark):
    r = np.random.default_rng(3)
    docs, want = [], set()
    names = sorted(NOUNS)
    for i in range(400):
        n = int(r.integers(8, 20))
        a, b = r.choice(names, 2, replace=False)
        share = r.choice([0.0, 0.1, 0.45, 0.9])
        k = int(round(n * share))
        text = [sentence(r, a) for _ in range(k)] + [sentence(r) for _ in range(n - k)]
        if k / n >= 0.25:
            want.add((i, a))
        docs.append((i, "\n".join(text), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, "no sentence at all", "x"), (0, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    rows = [(x.doc_id, x.subject) for x in S.subjects(df, samples(spark, r)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert S.subjects(df.limit(0), samples(spark, r)).count() == 0
    assert S.subjects(df, samples(spark, r).limit(0)).count() == 0


def test_held_out(spark, sf):
    """Examples that the fit hasn't seen are recognised, the better with rounds over the corpus."""
    by_kind: dict = {}
    for x in sorted(table(spark, sf, "subject_samples").collect()):  # ids are dealt to languages in turn: hold out within each
        by_kind.setdefault((x.subject, x.lang), []).append((x.sample_id, x.subject, x.text))
    train, held = [x for g in by_kind.values() for i, x in enumerate(g) if i % 4], [x for g in by_kind.values() for x in g[::4]]

    def right(m):
        p = S.shares_of(S.entries([t for _, _, t in held], m.columns, S.Tokens()), m)
        return sum(m.subjects[int(x.argmax())] == s for x, (_, s, _) in zip(p, held, strict=True)) / len(held)

    m = S.fit([(s, t) for _, s, t in train])
    alone = right(m)
    rows = S.matrix(table(spark, sf.replace("sf0.001", "sf0.01"), "documents").selectExpr("doc_id AS k", "text AS t")).cache()
    after = right(S.updated(S.updated(m, rows), rows))
    assert alone >= 0.97 and after >= 0.97 and after >= alone, (alone, after)


def test_independent_of_partitions(spark, sf):
    """Sums of numerators don't depend on how the rows are dealt out."""
    docs, examples = table(spark, sf, "documents"), table(spark, sf, "subject_samples")
    m, src = S.model_of(examples), docs.selectExpr("doc_id AS k", "text AS t")
    a, b = (S.updated(m, S.matrix(src.repartition(n))) for n in (1, 7))
    assert (a.columns == b.columns).all() and np.allclose(a.h, b.h)
