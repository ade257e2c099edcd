"""Text that looks the same but is made of other characters, brought to one form.

A trie of known spellings, written as they are, is walked by a weighted edit automaton over the text as it is written: look-alike letters,
other widths, joined letters and separate accents cost nothing, as do ignorable characters; any other edit costs 1 and the budget (0 by
default) bounds it. Where the walk ends in a known spelling, that spelling is the word's form, whatever alphabet it is written in. Words
that match none are normalised by the table of characters alone. Equal looks have equal forms: known spellings that look the same are one.

Left out: width, composed or separate accents, invisible characters, kinds of blank and hyphen, joined letters, letters of one shape in
different alphabets. Kept: case, missing accents, other letters, punctuation, digits, superscripts.

Groups of equal-looking texts are joined by the hash of the form, class by class (form, text hash), so a group of copies is never paired
with itself; only groups with two or more text hashes are joined at all.

Defined cases: null titles and bodies, and bodies without visible characters, take no part; a null text hash counts as empty; keys
delivered twice count once; of official titles that look the same the one with the smallest id counts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.markup import without_markup
from palimpsest.session import spread, written

#: Letters of one shape (fixed values): Cyrillic, Greek, Armenian and phonetic letters, and the Latin ones they look like.
SAME_SHAPE = (
    "аеорсухѕіјһԁԛԝӏ" "АВЕКМНОРСТХЅІЈҮӀԌԚԜ" "ον" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ϲϳϹͿ" "օՕ" "ɑɡ",
    "aeopcyxsijhdqwl" "ABEKMHOPCTXSIJYIGQW" "ov" "ABEZHIKMNOPTYX" "cjCJ" "oO" "ag",
)
HYPHENS = "‐‑﹣－"
#: Invisible characters outside the category of format characters (fixed values): joiner, fillers, variation selectors.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
RETURN_ARROW = "↩"
MOST_SPELLINGS = 1_000_000


@lru_cache(maxsize=1)
def images() -> dict[int, str]:
    """What each character stands for, in separate accents; characters that stand for themselves are missing."""
    out: dict[int, str] = {}
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cs":
            continue
        if kind == "Cf" or ch in INVISIBLE:
            out[c] = ""
        elif kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
            out[c] = " "
        elif d := unicodedata.decomposition(ch):
            tag = d.split()[0]
            if tag in ("<wide>", "<narrow>"):
                out[c] = unicodedata.normalize("NFKD", ch)
            elif tag == "<compat>" and kind[0] == "L":
                long = unicodedata.normalize("NFKD", ch)
                if sum(x.isalpha() for x in long) > 1 and all(unicodedata.name(x, "").startswith("LATIN") for x in long if x.isalpha()):
                    out[c] = long
            elif tag[0] != "<" and not 0xAC00 <= c <= 0xD7A3:
                out[c] = unicodedata.normalize("NFD", ch)
    out.update({ord(h): "-" for h in HYPHENS})
    shape = dict(zip(*SAME_SHAPE, strict=True))
    for a, b in shape.items():
        out[ord(a)] = b
    for c, image in list(out.items()):
        if any(x in shape for x in image):
            out[c] = "".join(shape.get(x, x) for x in image)
    del out[ord(" ")]
    return out


#: Characters whose texts stand for themselves if their accents are composed: Latin, common punctuation.
PLAIN = re.compile("[^\\n\\r\\t -~¡-¬®-ÿĀ-ıĴ-ňŊ-ž‘’“”–—…€↩]")


def by_table(text: str) -> str:
    """The form of a text by the table of characters."""
    if not PLAIN.search(text):
        return text
    t = unicodedata.normalize("NFD", text.translate(images()))
    # base letters in front of separate accents may have been look-alikes
    return unicodedata.normalize("NFC", t)


class Trie:
    """Known spellings, letter by letter as they are written (accents apart), walked by a weighted edit automaton.

    A state is a node, what is still to be read of the edge that led to it, and the least cost. Reading a letter costs nothing along an edge
    that looks the same, whichever of the two is the look-alike; a letter that shows as several (or the other way round) takes several
    steps; ignorable letters and edges cost nothing. A letter too many, missing or other costs 1, within the budget.
    """

    def __init__(self, spellings: dict[str, object]):
        self.root: dict = {}
        self.follow: dict[int, dict[str, list[tuple[dict, str]]]] = {}
        self.silent: dict[int, list[dict]] = {}
        #: Form by the table -> value, of spellings that the table would write otherwise.
        self.foreign = {by_table(w): v for w, v in sorted(spellings.items(), reverse=True) if by_table(w) != unicodedata.normalize("NFC", w)}
        for word in sorted(spellings):
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                node = node.setdefault(c, {})
            node.setdefault(None, spellings[word])

    def edges(self, node: dict) -> dict[str, list[tuple[dict, str]]]:
        """First shown letter -> (next node, shown letters left) of the node's edges."""
        found = self.follow.get(id(node))
        if found is None:
            found = self.follow[id(node)] = {}
            for c, m in node.items():
                if c is not None and (shown := look(c)):
                    found.setdefault(shown[0], []).append((m, shown[1:]))
            self.silent[id(node)] = [m for c, m in node.items() if c is not None and not look(c)]
        return found

    def reached(self, states: list[tuple[dict, str, int]], budget: int) -> dict[tuple[int, str], tuple[dict, str, int]]:
        """The states and all that are reached from them without reading: over ignorable edges, and over letters left out."""
        out: dict[tuple[int, str], tuple[dict, str, int]] = {}
        while states:
            node, rest, cost = states.pop()
            at = (id(node), rest)
            if cost > budget or (at in out and out[at][2] <= cost):
                continue
            out[at] = (node, rest, cost)
            if rest:
                if cost < budget:
                    states.append((node, rest[1:], cost + 1))
                continue
            edges = self.edges(node)
            states.extend((m, "", cost) for m in self.silent[id(node)])
            if cost < budget:
                states.extend((m, left, cost + 1) for found in edges.values() for m, left in found)
        return out

    def walk(self, text: str, budget: int = 0):
        """Value of the spelling nearest to `text`, none farther than `budget`: (cost, value) or None; of equally near ones the first by value."""
        states = self.reached([(self.root, "", 0)], budget)
        for letter in unicodedata.normalize("NFD", text):
            for x in look(letter):
                after: list[tuple[dict, str, int]] = []
                for node, rest, cost in states.values():
                    if rest:
                        after.append((node, rest[1:], cost + (rest[0] != x)))
                    else:
                        edges = self.edges(node)
                        after.extend((m, left, cost) for m, left in edges.get(x, ()))
                        if cost < budget:
                            after.extend((m, left, cost + 1) for first, found in edges.items() if first != x for m, left in found)
                    if cost < budget:
                        after.append((node, rest, cost + 1))  # a letter too many
                states = self.reached(after, budget)
                if not states:
                    return None
        ends = [(cost, node[None]) for node, rest, cost in states.values() if not rest and None in node]
        return min(ends, key=lambda e: (e[0], str(e[1]))) if ends else None


@lru_cache(maxsize=200_000)
def look(letter: str) -> str:
    """What a letter shows as: nothing, itself, a look-alike or several letters, accents apart."""
    return unicodedata.normalize("NFD", letter.translate(images()))


SPLIT_BLANKS = re.compile("([\\s\\u2000-\\u200a\\u202f\\u205f\\u3000\\xa0]+)")
KEPT_WORDS = 200_000


class Speller:
    """Canonical spellings of words: those of the trie, else by the table. Words once looked up are kept, a bounded number of them."""

    def __init__(self, trie: Trie):
        self.trie, self.known = trie, {}

    def word(self, part: str) -> str:
        if not PLAIN.search(part):
            return self.trie.foreign.get(part, part) if self.trie.foreign else part
        form = self.known.get(part)
        if form is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            hit = self.trie.walk(part)
            form = self.known[part] = hit[1] if hit else by_table(part)
        return form

    def text(self, text: str) -> str:
        """Each word's known spelling, or its form by the table; blanks become single spaces of the same number."""
        if not self.trie.foreign and not PLAIN.search(text):
            return text
        parts = (self.word(p) if i % 2 == 0 else (by_table(p) if PLAIN.search(p) else p) for i, p in enumerate(SPLIT_BLANKS.split(text)))
        return unicodedata.normalize("NFC", "".join(parts))


def canonical_words(text: str, trie: Trie) -> str:
    return Speller(trie).text(text)


def body_form(body: str, speller: Speller) -> str:
    """Form of a body's visible text without any white space."""
    return "".join(speller.text(without_markup(body, "")).replace(RETURN_ARROW, "").split())


def _vocabulary(titles: list[tuple[int, str]]) -> tuple[dict[str, int], dict[str, str]]:
    """Titles with their ids, and their words. Words that look the same count as one, spelt like the first of them."""
    whole: dict[str, int] = {}
    for i, t in sorted(titles):
        whole.setdefault(t, i)
    one: dict[str, str] = {}
    for w in sorted({w for t in whole for w in t.split(" ") if w}):
        one.setdefault(by_table(w), unicodedata.normalize("NFC", w))
    return whole, {w: w for w in one.values()}


def official(titles: DataFrame) -> list[tuple[int, str]]:
    """The list of official titles is the vocabulary: one bounded list, checked, that goes to every executor."""
    rows = titles.where("title IS NOT NULL").select("title_id", "title").limit(MOST_SPELLINGS + 1).collect()
    if len(rows) > MOST_SPELLINGS:
        raise ValueError("too many official titles for a vocabulary")
    return [(r[0], r[1]) for r in rows]


def title_twins(editions: DataFrame, titles: DataFrame) -> DataFrame:
    """`field`, `edition_id`, `twin_id`: titles that look the same as an official title as a whole without being one."""
    shared = editions.sparkSession.sparkContext.broadcast(_vocabulary(official(titles)))

    def run(batches):
        whole, _ = shared.value
        # titles that look the same end at several places of the trie: the smallest id holds at each
        least: dict[str, int] = {}
        for t, i in whole.items():
            f = by_table(t)
            least[f] = min(i, least.get(f, i))
        trie, known = Trie({t: least[by_table(t)] for t in whole}), {}
        for b in batches:
            ids, twins = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t is None or t in whole:
                    continue
                if t not in known:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[t] = trie.walk(t)
                if known[t]:
                    ids.append(i)
                    twins.append(known[t][1])
            yield pa.RecordBatch.from_arrays([pa.array(["title"] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(twins, pa.int64())], ["field", "edition_id", "twin_id"])

    src = editions.select(F.col("edition_id").cast("long").alias("edition_id"), "title").where("title IS NOT NULL AND edition_id IS NOT NULL")
    return src.mapInArrow(run, "field string, edition_id long, twin_id long").dropDuplicates(["edition_id"])


def body_forms(editions: DataFrame, titles: DataFrame) -> DataFrame:
    """`edition_id`, `sha`, `form`: 128-bit hash of the form of each visible text."""
    shared = editions.sparkSession.sparkContext.broadcast(_vocabulary(official(titles)))

    def run(batches):
        speller = Speller(Trie(shared.value[1]))
        for b in batches:
            keep, forms = [], []
            for i, body in enumerate(b.column(2).to_pylist()):
                f = body_form(body, speller) if body else ""
                if f:
                    keep.append(i)
                    forms.append(xxhash.xxh3_128_digest(f))
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(forms, pa.binary())], ["edition_id", "sha", "form"])

    src = editions.select(F.col("edition_id").cast("long").alias("edition_id"), F.coalesce("text_sha256", F.lit("")).alias("sha"), "body").where("edition_id IS NOT NULL")
    return spread(src).mapInArrow(run, "edition_id long, sha string, form binary")


def body_groups(editions: DataFrame, titles: DataFrame) -> DataFrame:
    """`edition_id`, `group_id` (the smallest edition with the same look), `editions`, `texts` (different text hashes in the group): a row for each edition with visible text."""
    forms = written(body_forms(editions, titles), "lookalike-forms").dropDuplicates(["edition_id"])
    # texts are counted over (form, hash) pairs, so a group of copies is no task's list
    kinds = forms.groupBy("form", "sha").agg(F.count("*").alias("n"), F.min("edition_id").alias("m"))
    groups = kinds.groupBy(F.col("form").alias("f")).agg(F.min("m").alias("group_id"), F.sum("n").alias("editions"), F.count("*").alias("texts"))
    return forms.join(groups, F.col("form") == F.col("f")).select("edition_id", "group_id", "editions", "texts")


def body_twins(editions: DataFrame, titles: DataFrame) -> DataFrame:
    """`field`, `edition_id`, `twin_id`: pairs of editions with different text hashes whose visible texts look the same."""
    forms = written(body_forms(editions, titles), "lookalike-forms").dropDuplicates(["edition_id"])
    several = forms.groupBy("form").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).where("lo <> hi").select(F.col("form").alias("f"))
    forms = forms.join(several, F.col("form") == F.col("f"), "left_semi")
    kinds = forms.select("form", "sha").distinct()
    x, y = kinds.select("form", F.col("sha").alias("sa")), kinds.select(F.col("form").alias("f2"), F.col("sha").alias("sb"))
    pairs = x.join(y, (F.col("form") == F.col("f2")) & (F.col("sa") < F.col("sb"))).select("form", "sa", "sb")
    a, b = forms.select("form", F.col("sha").alias("sa"), F.col("edition_id").alias("ea")), forms.select("form", F.col("sha").alias("sb"), F.col("edition_id").alias("eb"))
    out = pairs.join(a, ["form", "sa"]).join(b, ["form", "sb"])
    return out.select(F.lit("body").alias("field"), F.least("ea", "eb").alias("edition_id"), F.greatest("ea", "eb").alias("twin_id"))


def normalised_titles(editions: DataFrame, titles: DataFrame) -> DataFrame:
    """`edition_id`, `title_form`: each title in one consistent form, known spellings first."""
    shared = editions.sparkSession.sparkContext.broadcast(_vocabulary(official(titles)))

    def run(batches):
        speller = Speller(Trie(shared.value[1]))
        for b in batches:
            out = [None if t is None else speller.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["edition_id", "title_form"])

    return editions.select(F.col("edition_id").cast("long").alias("edition_id"), "title").dropDuplicates(["edition_id"]).mapInArrow(run, "edition_id long, title_form string")
