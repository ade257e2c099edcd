"""Subjects of documents by anchored non-negative factorisation of the document-term matrix.

Rows of the matrix are documents, columns words. Each sentence spreads a weight of one over its telling words, so that a row sums to the
document's sentences; a sentence without telling words weighs on one column of its own. V is factored into mixtures W and components H by
seeded alternating multiplicative updates for the Kullback-Leibler divergence, which keep zeros zero. Components are anchored by their zeros:

* on labelled examples, a row for each of them, a mixture may hold its own subject and the background, a subject's component only words of
  its own examples, and the background only words that several subjects share, so that it can't take a language of one subject;
* on the corpus, a row for each document, components go on from there. Numerators of the update are summed within partitions, then by word.
  A word that isn't telling yet follows the other words of its sentences: its numerators are its sentences' weights by component. After the
  first round, words that one subject holds are telling, and words that several hold are not; later rounds move weights only.

The corpus is read and split into words once; the matrix is a written table of word hashes, and each round is arithmetic on arrays. The fit on
examples sees at most MOST_SAMPLES rows (by smallest hash); all else covers every document. A telling word has at least 1 / RAREST of all
sentences of known subject, so there are at most RAREST x (words a sentence) of them; nothing else is broadcast or collected.

Sentences end with . ! ? or their counterparts. Headings, numbering, greetings and speaker marks are no sentences of their own.

Defined cases: null, empty and blank texts, and texts without sentences, have no subject; keys delivered twice count once; without examples
no document has a subject; equal shares all count.
"""

from __future__ import annotations

import re
from array import array
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.lookalike import PLAIN, by_table
from palimpsest.session import once, spread, written

MOST_SAMPLES = 20_000
ROUNDS, FOLD_ROUNDS, CORPUS_ROUNDS = 80, 12, 2
SEED = 20_240_517
SHARE = 0.25
#: In the fit on examples: part of a word's weight that subjects hold, and that one subject holds of it; least examples with the word.
TELLING, EXAMPLES = 0.6, 3
#: The background may hold words that at least this many subjects' examples share.
SHARED_BY = 3
#: In the corpus: part of a word's weight that one subject must have (to become telling, and to stay so), and that known subjects must have.
PURE, STAYS, KNOWN = 0.75, 0.5, 0.3
#: Part of its largest weight that a telling word starts a round with in each subject, so that updates can move it there; less than LEAST is dropped after it.
FLOOR, LEAST = 0.05, 0.05
#: Sentences of no subject that every word is credited with, so that a few sentences prove nothing.
PRIOR = 6
#: A telling word has at least this part of all sentences of known subject.
RAREST = 20_000
MOST_WORDS = 2_000_000

CLOSED = re.compile(r"[.!?。！？؟।…][\"'”’»“‘)\]]*$")
#: Full stops of scripts that put no blank after them (fixed values), and words of such scripts.
INNER_STOP = re.compile("([。！？])(?=[^\\s\"'”’»)\\]])")
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]{4,}")
WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
HEADING = re.compile(r"^[ \t]*#.*$", re.M)
KEPT_TOKENS = 500_000
#: Stand for no word: all sentences together, and sentences without telling words.
TOTAL = -(1 << 63)


def tokens_of(text: str) -> list[str]:
    """What stands between blanks; headings are left out, entities decoded, look-alike characters brought to one form."""
    t = unescape(text) if "&" in text else text
    if PLAIN.search(t):
        t = INNER_STOP.sub(r"\1 ", by_table(t))
    return (HEADING.sub("", t) if "#" in t else t).split()


def words(token: str) -> list[str]:
    return WORD.findall(token.lower())


def word_hash(word: str) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


class Tokens(dict):
    """token -> (hashes of its words, whether it ends a sentence, whether it may be a sentence alone)."""

    def __missing__(self, token: str):
        if len(self) >= KEPT_TOKENS:
            self.clear()
        v = self[token] = (tuple(map(word_hash, words(token))), CLOSED.search(token) is not None, UNSPACED.search(token) is not None)
        return v


def sentences(text: str | None, known: Tokens) -> tuple[list[int], list[int]]:
    """(hashes of the words of all sentences, end of each sentence in them). One token alone (numbering, a mark) is no sentence, nor is one without a stop."""
    hashes: list[int] = []
    ends: list[int] = []
    if not text:
        return hashes, ends
    last, begun = 0, 0
    for i, (hs, closed, alone) in enumerate(map(known.__getitem__, tokens_of(text))):
        hashes.extend(hs)
        if closed:
            if i > last or alone:
                ends.append(len(hashes))
                begun = len(hashes)
            else:
                del hashes[begun:]
            last = i + 1
    del hashes[begun:]
    return hashes, ends


class Model:
    """`columns`: sorted hashes of the telling words; `h`: components x (columns + 1), rows sum to one; the last column and component are those of sentences without telling words."""

    def __init__(self, subjects: list[str], columns: np.ndarray, h: np.ndarray):
        self.subjects, self.columns, self.h = subjects, columns, h


def model(subjects: list[str], weights: dict[int, np.ndarray]) -> Model:
    """`weights`: word hash -> weight by subject."""
    names = np.array(sorted(weights), np.int64)
    h = np.zeros((len(subjects) + 1, len(names) + 1))
    for i, w in enumerate(names.tolist()):
        h[:-1, i] = weights[w]
    h[-1, -1] = 1
    return Model(subjects, names, h / (h.sum(1, keepdims=True) + 1e-12))


class Entries:
    """Non-zero entries of some rows of the matrix: row, column, value, sentence; and the sentences' rows."""

    def __init__(self, hashes: np.ndarray, ends: list[np.ndarray], columns: np.ndarray):
        per = np.fromiter(map(len, ends), np.int64, len(ends))
        flat = np.concatenate(ends) if len(ends) else np.zeros(0, np.int64)
        self.rows, self.sentence_row = len(ends), np.repeat(np.arange(len(ends)), per)
        self.sentences = per
        # ends count from each text's beginning
        first = np.ones(len(flat), bool)
        first[1:] = self.sentence_row[1:] != self.sentence_row[:-1]
        before = np.where(first, 0, np.concatenate(([0], flat[:-1])) if len(flat) else flat)
        self.word_sentence = np.repeat(np.arange(len(flat)), flat - before)
        self.words = hashes
        at = np.searchsorted(columns, hashes)
        at[at == len(columns)] = 0
        self.telling = columns[at] == hashes if len(columns) else np.zeros(len(hashes), bool)
        col, sent = at[self.telling], self.word_sentence[self.telling]
        count = np.bincount(sent, minlength=len(flat))
        none = np.flatnonzero(count == 0)
        sent = np.concatenate((sent, none))
        order = np.argsort(sent, kind="stable")
        self.sentence = sent[order]
        self.column = np.concatenate((col, np.full(len(none), len(columns))))[order]
        self.value = (1.0 / np.maximum(count[self.sentence], 1)).astype(np.float32)
        self.row = self.sentence_row[self.sentence]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting: several times faster here than by hashing."""
    s = np.sort(x)
    return s[_starts(s)]


def _sums(part: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `part` by the ascending numbers `at`, as n rows."""
    out = np.zeros((n, part.shape[1]), part.dtype)
    if len(at):
        first = _starts(at)
        out[at[first]] = np.add.reduceat(part, first, axis=0)
    return out


def folded(e: Entries, h: np.ndarray, rounds: int = FOLD_ROUNDS) -> np.ndarray:
    """Mixtures of the rows by multiplicative updates with the components fixed; a row's mixture sums to its sentences."""
    # cells of the matrix: a row's entries of one column together
    code = e.row * h.shape[1] + e.column
    order = np.argsort(code, kind="stable")
    first = _starts(code[order])
    value = np.add.reduceat(e.value[order], first) if len(first) else e.value
    row, col = e.row[order][first], e.column[order][first]
    hk, begin = h.T.astype(np.float32)[col], _starts(row)
    w = np.ones((e.rows, h.shape[0]), np.float32)
    some = row[begin]
    for _ in range(rounds if len(row) else 0):
        g = hk * (value / np.maximum(np.einsum("ij,ij->i", hk, w[row]), 1e-12))[:, None]
        w[some] *= np.add.reduceat(g, begin, axis=0)
    w[np.bincount(row, minlength=e.rows) == 0] = 0
    return w


def numerators(e: Entries, w: np.ndarray, h: np.ndarray, others: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, their numerators by component, weights of telling words by component) of one update of the components.

    A telling word's are those of the update, H x (W' V / WH). Another word's are the weights of the sentences it stands in, once for each; they
    are left out unless `others`.
    """
    part = h.T.astype(np.float32)[e.column] * w[e.row].astype(np.float32)
    part *= (e.value / np.maximum(part.sum(1), 1e-12))[:, None]
    order = np.argsort(e.column, kind="stable")
    own = _sums(part[order].astype(np.float64), e.column[order], h.shape[1])
    if not others:
        return np.zeros(0, np.int64), np.zeros((0, h.shape[0])), own
    by_sentence = _sums(part, e.sentence, len(e.sentence_row))
    rest = ~e.telling
    names = _distinct(e.words[rest])
    # each word once a sentence
    n = max(len(e.sentence_row), 1)
    code = _distinct(np.searchsorted(names, e.words[rest]) * n + e.word_sentence[rest])
    return names, _sums(by_sentence[code % n], code // n, len(names)).astype(np.float64), own


def entries(texts: list[str | None], columns: np.ndarray, known: Tokens) -> Entries:
    rows = [sentences(t, known) for t in texts]
    return Entries(np.array([x for hs, _ in rows for x in hs], np.int64), [np.array(e, np.int64) for _, e in rows], columns)


def fit(samples: list[tuple[str, str]], rounds: int = ROUNDS) -> Model:
    """The model of labelled examples: (subject, text)."""
    subjects = sorted({s for s, _ in samples})
    known = Tokens()
    texts = [t for _, t in samples]
    vocabulary = np.unique(np.array([x for t in texts for x in sentences(t, known)[0]], np.int64))
    k = len(subjects)
    if not k or not len(vocabulary):
        return Model([], np.zeros(0, np.int64), np.zeros((0, 1)))
    e = entries(texts, vocabulary, known)
    inside = e.column < len(vocabulary)
    # a word's entries: once a sentence, whole
    cell = np.unique(np.stack((e.sentence[inside], e.column[inside])), axis=1)
    row, col = e.sentence_row[cell[0]], cell[1]
    code, value = np.unique(row * len(vocabulary) + col, return_counts=True)
    row, col = code // len(vocabulary), code % len(vocabulary)
    label = np.array([subjects.index(s) for s, _ in samples])
    has = np.zeros((k + 1, len(vocabulary)), bool)
    has[label[row], col] = True
    several = has[:k].sum(0)
    has[k] = several >= min(SHARED_BY, k)
    rng = np.random.default_rng(SEED)
    h = rng.uniform(0.5, 1.5, has.shape) * has
    h /= h.sum(1, keepdims=True) + 1e-12
    w = np.zeros((len(samples), k + 1))
    w[np.arange(len(samples)), label] = rng.uniform(0.5, 1.5, len(samples))
    w[:, k] = rng.uniform(0.5, 1.5, len(samples))
    spread_over = lambda g, at, n: np.stack([np.bincount(at, g[:, x], n) for x in range(k + 1)], axis=1)
    for _ in range(rounds):
        hk = h.T[col]
        w = w * spread_over(hk * (value / np.maximum((hk * w[row]).sum(1), 1e-12))[:, None], row, len(samples))
        wk = w[row]
        h = h * spread_over(wk * (value / np.maximum((hk * wk).sum(1), 1e-12))[:, None], col, len(vocabulary)).T
        h = h / (h.sum(1, keepdims=True) + 1e-12)
    mass = h * w.sum(0)[:, None]
    own = mass[:k]
    part = own / (mass.sum(0) + 1e-12)
    seen = np.bincount(col, minlength=len(vocabulary))
    telling = (part.sum(0) >= TELLING) & (own.max(0) >= TELLING * own.sum(0)) & (seen >= EXAMPLES)
    return model(subjects, {int(vocabulary[j]): own[:, j] for j in np.flatnonzero(telling)})


MATRIX = "k long, words array<long>, ends array<int>"


def matrix(docs: DataFrame) -> DataFrame:
    """`k`, `words` (hashes of the words of the text's sentences), `ends` (of each sentence in them), from `k`, `t`."""

    def run(batches):
        known = Tokens()
        for b in batches:
            flat, stops, cuts = array("q"), array("i"), [(0, 0)]
            for t in b.column(1).to_pylist():
                hashes, ends = sentences(t, known)
                flat.extend(hashes)
                stops.extend(ends)
                cuts.append((len(flat), len(stops)))
            at = np.array(cuts, np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at[:, i]), pa.array(np.frombuffer(x, d))) for i, (x, d) in enumerate(((flat, np.int64), (stops, np.int32)))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["k", "words", "ends"])

    return docs.mapInArrow(run, MATRIX)


def _entries(b: pa.RecordBatch, columns: np.ndarray) -> Entries:
    ends, words_ = b.column(2), b.column(1)
    cuts = ends.offsets.to_numpy()
    flat = ends.values.to_numpy().astype(np.int64)
    hashes = words_.values.to_numpy()[words_.offsets[0].as_py() : words_.offsets[-1].as_py()]
    return Entries(hashes, [flat[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)], columns)


def updated(m: Model, rows: DataFrame, others: bool = True) -> Model:
    """The model after one update of the components over all rows of the matrix. `others`: words that aren't telling may become so."""
    spark = rows.sparkSession
    k = len(m.subjects)
    h = m.h.copy()
    h[:-1, :-1] = np.maximum(h[:-1, :-1], FLOOR * h[:-1, :-1].max(0))
    m = Model(m.subjects, m.columns, h / (h.sum(1, keepdims=True) + 1e-12))
    shared = spark.sparkContext.broadcast(m)
    names = [f"c{i}" for i in range(k + 1)]
    schema = pa.schema([("word", pa.int64()), *[(n, pa.float64()) for n in names]])

    def run(batches):
        m = shared.value
        own, held = np.zeros((len(m.columns) + 1, k + 1)), []

        def table(x: np.ndarray, c: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(x), *[pa.array(np.ascontiguousarray(c[:, i])) for i in range(k + 1)]], schema=schema)

        def merged():
            x, c = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.argsort(x, kind="stable")
            names = _distinct(x)
            return names, _sums(c[order], np.searchsorted(names, x[order]), len(names))

        for b in batches:
            e = _entries(b, m.columns)
            x, c, o = numerators(e, folded(e, m.h), m.h, others)
            own += o
            held.append((x, c))
            if sum(len(a) for a, _ in held) > 1_000_000:
                held = [merged()]
                if len(held[0][0]) > 500_000:
                    yield table(*held.pop())
        if held:
            yield table(*merged())
        # the update's numerators sum to the weights of all sentences
        yield table(np.concatenate((m.columns, np.array([TOTAL]))), np.concatenate((own[:-1], own.sum(0)[None])))

    counted = written(rows.mapInArrow(run, "word long, " + ", ".join(f"{n} double" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names]), "subject-words")
    total = counted.where(F.col("word") == TOTAL).first()
    if total is None:
        return m
    known, best = sum(F.col(n) for n in names[:-1]), F.greatest(*names[:-1], F.lit(0.0))
    own = spark.createDataFrame([(int(w),) for w in m.columns] or [(TOTAL,)], "own long")
    stays = F.col("own").isNotNull() & (best >= STAYS * known)
    comes = F.col("own").isNull() & (best >= PURE * (known + PRIOR)) & (known >= KNOWN * (known + F.col(names[-1])))
    # at least this weight each: their number is bounded by the words of a sentence, not by the corpus
    least = sum(total[n] for n in names[:-1]) / RAREST
    kept = counted.where(F.col("word") != TOTAL).join(F.broadcast(own), F.col("word") == F.col("own"), "left").where(stays | (comes & (known >= least))).drop("own")
    found = kept.limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError("sentences of very many words: too many telling words for a model")
    weights = {}
    for r in found:
        c = np.array(r[1 : k + 1])
        weights[r[0]] = np.where(c >= LEAST * c.sum(), c, 0)
    return model(m.subjects, weights)


def model_of(samples: DataFrame) -> Model:
    h = F.xxhash64("subject", "text")
    rows = samples.where("subject IS NOT NULL AND text IS NOT NULL").select("subject", "text").distinct().orderBy(h, "subject", "text").limit(MOST_SAMPLES).collect()
    return fit([(r.subject, r.text) for r in sorted(rows, key=lambda r: (r.subject, xxhash.xxh3_64_intdigest(r.text), r.text))])


def shares_of(e: Entries, m: Model) -> np.ndarray:
    """Rows x subjects: part of the row's sentences."""
    return folded(e, m.h)[:, :-1] / np.maximum(e.sentences, 1)[:, None]


def subject_shares(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", least: float = SHARE) -> DataFrame:
    """`key`, `subject`, `share` of sentences, where it is at least `least`."""
    src = spread(once(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), "k"))
    m = model_of(samples)
    if not m.subjects:
        return src.where("false").select(F.col("k").alias(key), F.lit("").alias("subject"), F.lit(0.0).alias("share"))
    rows = written(matrix(src), "subject-matrix")
    for i in range(CORPUS_ROUNDS):
        m = updated(m, rows, others=i == 0)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        m = shared.value
        for b in batches:
            part = shares_of(_entries(b, m.columns), m)
            i, j = np.nonzero(part >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int32())), pa.array([m.subjects[x] for x in j], pa.string()), pa.array(part[i, j])], ["k", "subject", "share"])

    return rows.mapInArrow(run, "k long, subject string, share double").withColumnRenamed("k", key)


def subjects(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", least: float = SHARE) -> DataFrame:
    return subject_shares(docs, samples, key, text, least).select(key, "subject")
