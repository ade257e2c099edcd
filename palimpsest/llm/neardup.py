"""Pairs of documents that share most of their phrases: an exact set-similarity join with set-relation skipping.

A document is the set of its five-word phrases. Two sets match if common phrases / phrases of the larger set >= threshold.

1. *Classes.* Documents with equal sets form one class, so groups of copies cost one set. Sets are written once, packed, to the shared folder.
   Phrases are counted over all classes, in a table of counters of bounded size, and those that several classes share come last in the
   global order (by the level of their count, then hash); the rest is ordered by hash.
2. *Index lists.* The larger set of a matching pair has `needed` common phrases, and the first COUNTED of them lie in both prefixes (size -
   needed + counted phrases in global order). Prefixes go, packed and bucketed by phrase, to the index lists. In a list, entries are kept in
   blocks of one set size, ordered by position. A probe skips blocks outside its size window and, in a block, everything after the last
   position from which enough phrases can follow (index-level skipping). Common phrases in prefixes are summed by pair; pairs with fewer than
   the counted ones can't match and go no further.
3. *Answers.* Candidates are verified in groups around their smallest neighbour, so sets of one cluster travel once. A set's overlaps are
   derived from the known ones of a highly similar set by the few phrases in which both differ (answer-level skipping).

Skew: copies collapse before the shuffle (a class goes once from each task); shared phrases are last in the order; index lists and groups of
many neighbours are cut in two dimensions into cells of bounded size. No pairs are lost by any of it; there are no caps.

Broadcast: the levels of phrase counts (at most 2 ^ WIDEST bytes), and the groups of sets to verify, if they are at most MOST_ROUTES, else they
are joined by a shuffle.

Phrases are 40-bit hashes: two sets of a thousand phrases have a false common phrase in one of a million pairs, worth 0.001 of similarity.

Defined cases: null and empty bodies and bodies without words take no part; a body of fewer than five words is one phrase; keys delivered
twice count once; equal sets with different text hashes match with similarity 1.
"""

from __future__ import annotations

import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.markup import without_markup
from palimpsest.session import spread, written

WORDS = re.compile(r"[^\W_]+")
PHRASE = 5
BITS = np.uint64((1 << 40) - 1)
#: Part of the needed phrases that is counted before verification.
COUNTED = 4
#: Least count of a shared phrase, and most of them.
HOT_LEAST = 6
#: Bits of the least and the largest table of phrase counts, and counters that are summed at once.
NARROWEST, WIDEST = 12, 24
SLICE = 1 << 20
#: Entries of an index list that meet in one task; longer lists are cut in two dimensions.
SPLIT = 20_000
#: Phrases of the sets that one task verifies.
PHRASES_A_GROUP = 1_000_000
MOST_ROUTES = 2_000_000
POSTINGS_A_BUCKET = 1_500_000
BLOCK = 2_048
CHUNK = 3_000_000
KEPT_WORDS = 1_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class PhraseSets:
    """Phrase sets of bodies as sorted arrays of 64-bit hashes."""

    def __init__(self, size: int = PHRASE):
        self.size, self.hashes = size, WordHashes()

    def of(self, body: str | None) -> np.ndarray | None:
        if not body:
            return None
        words = WORDS.findall(without_markup(body, " ").lower())
        n, k = len(words), self.size
        if not n:
            return None
        w = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        m = min(n, k)
        count = n - m + 1
        mul = np.uint64(0x9E3779B97F4A7C15)
        h = w[:count].copy()
        for i in range(1, m):
            h *= mul
            h += w[i : i + count]
        h = np.sort(_mix(h + np.uint64(m)) & BITS)
        if count > 1:
            h = h[np.concatenate(([True], h[1:] != h[:-1]))]
        return h


def class_of(tokens: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def needed(n: int, threshold: Fraction) -> int:
    """Common phrases that a set of n, the larger one, needs."""
    return -(-n * threshold.numerator // threshold.denominator)


def _needed(n: np.ndarray, threshold: Fraction) -> np.ndarray:
    return -(-n.astype(np.int64) * threshold.numerator // threshold.denominator)


def counted(need):
    """How many of the needed phrases both prefixes hold."""
    return -(-need // COUNTED)


def pack(tokens: np.ndarray) -> bytes:
    """Five bytes a phrase."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(n, 5)
    return out.reshape(-1).view("<u8")


# 1. classes


def _features(df: DataFrame) -> DataFrame:
    """Key, sha, class, size of each document, and the packed set at a class's first sight in a partition."""
    names = ["key", "sha", "cls", "n", "tokens"]

    def run(batches):
        sets, seen = PhraseSets(), set()
        for batch in batches:
            keep, cls, sizes, blobs = [], [], [], []
            for i, body in enumerate(batch.column(2).to_pylist()):
                t = sets.of(body)
                if t is None:
                    continue
                c = class_of(t)
                keep.append(i)
                cls.append(c)
                sizes.append(len(t))
                blobs.append(None if c in seen else pack(t))
                seen.add(c)
            if len(seen) > KEPT_WORDS:
                seen.clear()
            keep = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(cls, pa.int64()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names)

    return df.mapInArrow(run, "key long, sha string, cls long, n int, tokens binary")


# phrases by their counts over all classes


def _place(tokens: np.ndarray, width: int) -> np.ndarray:
    return (_mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(width - 1)).astype(np.int64)


def level_of(count: np.ndarray) -> np.ndarray:
    """0 for counts below HOT_LEAST, then eight levels for each doubling."""
    x = np.maximum(count, HOT_LEAST).astype(np.float64) / HOT_LEAST
    return np.where(count < HOT_LEAST, 0, np.minimum(1 + np.floor(8 * np.log2(x)), 255)).astype(np.uint8)


def most_at(level: int) -> int:
    """The largest count of a level."""
    return int(HOT_LEAST * 2 ** (level / 8)) + 1


def phrase_levels(sets: DataFrame, total: int, tasks: int) -> np.ndarray:
    """Levels of the counts of all phrases of all classes, by the phrase's place in a table of about as many counters as phrases.

    Two phrases with one place count together, so a level is never too low. The table has at most WIDEST counters whatever the corpus; a
    task counts in a table of its own, and the tables are summed slice by slice.
    """
    width = 1 << max(NARROWEST, min(WIDEST, int(total).bit_length()))
    step = min(width, SLICE)

    def run(batches):
        counts, held, size = np.zeros(width, np.uint32), [], 0

        def add():
            u, c = np.unique(_place(np.concatenate(held), width), return_counts=True)
            counts[u] += c.astype(np.uint32)

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(unpack(blob))
                size += len(held[-1])
                if size > CHUNK:
                    add()
                    held, size = [], 0
        if held:
            add()
        for i in range(0, width, step):
            part = counts[i : i + step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i // step], pa.int32()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def summed(t: pa.Table) -> pa.Table:
        whole = np.zeros(step, np.uint64)
        for blob in t.column("counts").to_pylist():
            whole += np.frombuffer(zlib.decompress(blob), np.uint32)
        return pa.table({"slice": t.column("slice").slice(0, 1), "levels": pa.array([zlib.compress(level_of(whole).tobytes(), 1)], pa.binary())})

    rows = sets.select("tokens").coalesce(max(1, tasks)).mapInArrow(run, "slice int, counts binary").groupBy("slice").applyInArrow(summed, "slice int, levels binary").collect()
    out = np.zeros(width, np.uint8)
    for r in rows:
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return out


def _prefix(tokens: np.ndarray, levels: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of the prefix and their levels: rare ones first, by hash, then by level."""
    level = levels[_place(tokens, len(levels))]
    if level.any():
        order = np.lexsort((tokens, level))
        tokens, level = tokens[order], level[order]
    need = needed(len(tokens), threshold)
    n = len(tokens) - need + counted(need)
    return tokens[:n], level[:n]


def cells(tokens: np.ndarray, level: np.ndarray, cls: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the entry, list, side) of the index entries of phrases. A list of more than about `split` entries is cut in two dimensions.

    Classes of such a list fall into g parts by hash, and its pairs into cells of two parts; an entry goes to the g cells of its part. In a
    cell of two different parts only pairs of different sides (1, 2) count, else (side 0) all do, so no pair is lost or counted twice.
    """
    most = np.array([most_at(x) for x in range(256)])
    g = np.maximum(1, -(-most[level] // split))
    g[level == 0] = 1
    entry = np.repeat(np.arange(len(tokens)), g)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(g) - g, g)
    parts = g[entry].astype(np.uint64)
    mine = (_mix(cls[entry].view(np.uint64) + np.uint64(0x2545F4914F6CDD1D)) % parts).astype(np.int64)
    lo, hi = np.minimum(mine, other), np.maximum(mine, other)
    cell = _mix(tokens[entry] + np.uint64(0x9E3779B97F4A7C15) * (lo * g[entry] + hi + 1).astype(np.uint64)) & BITS
    side = np.where(lo == hi, 0, np.where(mine == lo, 1, 2)).astype(np.uint8)
    return entry, np.where(g[entry] == 1, tokens[entry], cell), side


# 2. index lists


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: high ones are mostly zero and compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def _postings(sets: DataFrame, levels: np.ndarray, threshold: Fraction, buckets: int) -> DataFrame:
    """A row for each bucket that a chunk of a partition's classes touches: packed arrays."""
    split = SPLIT
    shared = sets.sparkSession.sparkContext.broadcast(zlib.compress(levels.tobytes(), 1))
    names = ["bucket", "cls", "size", "many", "tok", "pos", "side"]
    schema = pa.schema([("bucket", pa.int32()), *[(x, pa.binary()) for x in names[1:]]])

    def run(batches):
        levels = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        prefixes, cls, sizes, total = [], [], [], 0

        def packed():
            lens = np.fromiter((len(t) for t, _ in prefixes), np.int64, len(prefixes))
            tok, level = (np.concatenate([p[i] for p in prefixes]) for i in (0, 1))
            doc = np.repeat(np.arange(len(lens)), lens)
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)
            c, s = np.array(cls, np.int64), np.array(sizes, np.uint32)
            entry, tok, side = cells(tok, level, c[doc], split)
            doc, pos = doc[entry], pos[entry]
            b = (_mix(tok) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")  # by document, then position, within a bucket
            b, doc, pos, tok, side = b[order], doc[order], pos[order], tok[order], side[order]
            cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            rows = {k: [] for k in names}
            for lo, hi in zip(cuts, [*cuts[1:], len(b)], strict=True):
                d, p = doc[lo:hi], pos[lo:hi]
                new = np.concatenate(([True], d[1:] != d[:-1]))
                mine, at = d[new], np.flatnonzero(new)
                step = p.copy()
                step[1:] -= p[:-1]
                step[at] = p[at]
                rows["bucket"].append(int(b[lo]))
                rows["cls"].append(c[mine].tobytes())
                rows["size"].append(_planes(s[mine]))
                rows["many"].append(_planes(np.diff(np.append(at, hi - lo))))
                rows["tok"].append(tok[lo:hi].astype("<u4").tobytes())
                rows["pos"].append(_planes(step))
                rows["side"].append(side[lo:hi].tobytes() if side[lo:hi].any() else b"")
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = unpack(blob)
                prefixes.append(_prefix(t, levels, threshold))
                cls.append(c)
                sizes.append(len(t))
                total += len(prefixes[-1][0])
            if total > CHUNK:
                yield packed()
                prefixes, cls, sizes, total = [], [], [], 0
        if prefixes:
            yield packed()

    return sets.mapInArrow(run, "bucket int, cls binary, size binary, many binary, tok binary, pos binary, side binary")


def _spans(count: np.ndarray, most: int = 2_000_000):
    """Slices of `count` whose sums stay near `most`."""
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, side="right")))
        yield slice(lo, hi)
        lo = hi


def _expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the row, start + 0 .. count - 1) for each row."""
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, start[row] + inner


def list_pairs(tok: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: np.ndarray, threshold: Fraction, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of document indices (codes lower * documents + higher) of one bucket's index lists and their numbers of common phrases."""
    order = np.lexsort((pos, size[doc], tok))
    tok, doc, pos = tok[order], doc[order], pos[order]
    side = side[order] if side is not None else None
    new_list = np.concatenate(([True], tok[1:] != tok[:-1])) if len(tok) else np.zeros(0, bool)
    listed = np.cumsum(new_list) - 1
    several = np.bincount(listed)[listed] > 1 if len(tok) else new_list
    tok, doc, pos = tok[several], doc[several], pos[several].astype(np.int64)
    side = side[several] if side is not None else None
    none = np.zeros(0, np.int64)
    if not len(tok):
        return none, none
    s = size[doc].astype(np.int64)
    new_block = np.concatenate(([True], (tok[1:] != tok[:-1]) | (s[1:] != s[:-1])))
    start = np.flatnonzero(new_block)
    end = np.append(start[1:], len(tok))
    block = np.cumsum(new_block) - 1
    btok, bsize = tok[start], s[start]
    bneed = _needed(bsize, threshold)
    place = block * (1 << 40) + pos  # ascending: blocks, then positions
    found, held = [], 0
    codes: list[np.ndarray] = []

    def fold() -> None:
        nonlocal held
        if codes:
            u, c = np.unique(np.concatenate(codes), return_counts=True)
            found.append((u, c))
            codes.clear()
            held = 0

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        if side is not None:
            meet = (side[i] == 0) | (side[i] != side[j])
            i, j = i[meet], j[meet]
        a, b = doc[i], doc[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        code = (lo * len(size) + hi)[lo != hi]
        codes.append(code)
        held += len(code)
        if held > 4_000_000:
            fold()

    # within a block: equal sizes, the prefix alone bounds the position
    later = end[block] - np.arange(len(tok)) - 1
    for part in _spans(later):
        row, j = _expand(np.arange(part.start, part.stop) + 1, later[part])
        keep(row + part.start, j)
    # between blocks of one list: smaller sizes inside the window
    for d in range(1, len(start)):
        small, large = np.arange(len(start) - d), np.arange(d, len(start))
        ok = (btok[small] == btok[large]) & (bsize[small] >= bneed[large])
        small, large = small[ok], large[ok]
        if not len(small):
            break
        limit = bsize[small] - bneed[large] + counted(bneed[large]) - 1
        stop = np.searchsorted(place, small * (1 << 40) + limit, side="right")  # the block's rest is skipped
        many = np.maximum(stop - start[small], 0)
        width = end[large] - start[large]
        some = many > 0
        small, large, many, width = small[some], large[some], many[some], width[some]
        for part in _spans(many * width):
            row, i = _expand(start[small[part]], many[part])
            row2, j = _expand(start[large[part]][row], width[part][row])
            keep(i[row2], j)
    fold()
    if not found:
        return none, none
    if len(found) == 1:
        return found[0]
    u, inverse = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate([c for _, c in found])).astype(np.int64)


def _candidates(postings: DataFrame, threshold: Fraction, buckets: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        cols = {x: t.column(x).to_pylist() for x in ("cls", "size", "many", "tok", "pos", "side")}
        cls = np.concatenate([np.frombuffer(x, np.int64) for x in cols["cls"]])
        size, many, step = (np.concatenate([_from_planes(x) for x in cols[c]]).astype(np.int64) for c in ("size", "many", "pos"))
        tok = np.concatenate([np.frombuffer(x, "<u4") for x in cols["tok"]])
        # one copy of each class
        known, first = np.unique(cls, return_index=True)
        keep = np.zeros(len(cls), bool)
        keep[first] = True
        row = np.repeat(np.arange(len(cls)), many)
        total = np.cumsum(step)
        begin = np.cumsum(many) - many
        pos = total - np.repeat(total[begin] - step[begin], many)
        use = keep[row]
        doc = np.searchsorted(known, cls)[row[use]]
        size = size[first]
        sides = cols["side"]
        side = np.concatenate([np.frombuffer(x, np.uint8) if x else np.zeros(len(y) // 4, np.uint8) for x, y in zip(sides, cols["tok"], strict=True)])[use] if any(sides) else None
        pairs, count = list_pairs(tok[use], doc, pos[use], size, threshold, side)
        a, b = pairs // len(known), pairs % len(known)
        least = counted(_needed(np.maximum(size[a], size[b]), threshold))
        return pa.table({"a": known[a], "b": known[b], "c": pa.array(count.astype(np.int32)), "least": pa.array(least.astype(np.int32))})

    # as many partitions as buckets, whatever the session's number is
    found = postings.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "a long, b long, c int, least int")
    return found.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("least").alias("least")).where("c >= least").select("a", "b")


# 3. answers


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted sets; the smaller one is looked up."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def overlaps(pairs: list[tuple[int, int]], sets: dict[int, np.ndarray]) -> list[int]:
    """Overlap of each pair; sets that are highly similar to a set with known answers get theirs by difference."""
    asked: dict[int, list[int]] = {}
    for a, b in pairs:
        asked.setdefault(a, []).append(b)
    known: dict[int, dict[int, int]] = {}
    like: dict[int, int] = {}  # set -> earlier set it hardly differs from
    for a in sorted(asked):
        x, answers = sets[a], {}
        r = like.get(a)
        if r is not None:
            y, base = sets[r], known[r]
            gone, come = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
        for b in asked[a]:
            z = sets[b]
            if r is not None and b in base:
                answers[b] = base[b] - common(gone, z) + common(come, z)
            else:
                answers[b] = common(x, z)
            if b not in like and answers[b] >= 0.9 * max(len(x), len(z)):
                like[b] = a
        known[a] = answers
    return [known[a][b] for a, b in pairs]


def _blocks(cand: DataFrame) -> DataFrame:
    """The candidates with the block in which they are verified: around the smallest neighbour of either, split where there are many."""
    both = cand.unionByName(cand.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lead = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("lead"))
    la, lb = lead.withColumnsRenamed({"a": "a_", "lead": "la"}), lead.withColumnsRenamed({"a": "b_", "lead": "lb"})
    pairs = cand.join(la, F.col("a") == F.col("a_")).join(lb, F.col("b") == F.col("b_")).select("a", "b", F.least("la", "lb").alias("g"))
    size = pairs.groupBy("g").count().select(F.col("g").alias("g_"), F.ceil(F.sqrt(F.col("count") / F.lit(8.0 * BLOCK))).cast("int").alias("k"))
    pairs = pairs.join(size, F.col("g") == F.col("g_"))
    return pairs.select("a", "b", F.xxhash64("g", F.pmod(F.xxhash64("a"), F.col("k")), F.pmod(F.xxhash64("b"), F.col("k"))).alias("block"))


def _grouped(pairs: DataFrame, phrases_a_set: float) -> tuple[DataFrame, int]:
    """The pairs with `p`, the task that verifies their block: as many tasks as the sets that travel to the blocks need."""
    ends = pairs.select("block", F.explode(F.array("a", "b")).alias("a")).distinct().count()
    groups = int(max(2 * pairs.sparkSession.sparkContext.defaultParallelism, ends * phrases_a_set // PHRASES_A_GROUP + 1))
    return pairs.withColumn("p", F.pmod(F.col("block"), F.lit(groups)).cast("int")), groups


def _verified(pairs: DataFrame, groups: int, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """`a`, `b`, `similarity` of the class pairs that match. `pairs`: as from `_blocks`; `sets`: `cls`, `tokens`."""
    route = pairs.select("a", "p").unionByName(pairs.select(F.col("b").alias("a"), "p")).distinct()
    if route.limit(MOST_ROUTES + 1).count() <= MOST_ROUTES:
        route = F.broadcast(route)
    sent = sets.join(route, F.col("a") == F.col("cls")).select("p", "a", F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("block"), "tokens")
    rows = sent.unionByName(pairs.select("p", "a", "b", "block", F.lit(None).cast("binary").alias("tokens")))

    def run(t: pa.Table) -> pa.Table:
        a, b, block = (t.column(x).to_pylist() for x in ("a", "b", "block"))
        blobs = t.column("tokens")
        packed: dict[int, bytes] = {}
        todo: dict[int, list[tuple[int, int]]] = {}
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if y is None:
                packed[x] = blobs[i].as_py()
            else:
                todo.setdefault(block[i], []).append((x, y))
        out_a, out_b, out_s = [], [], []
        for pairs in todo.values():
            sets = {x: unpack(packed[x]) for x in {x for p in pairs for x in p}}
            for (x, y), n in zip(pairs, overlaps(pairs, sets), strict=True):
                larger = max(len(sets[x]), len(sets[y]))
                if n * threshold.denominator >= larger * threshold.numerator:
                    out_a.append(x)
                    out_b.append(y)
                    out_s.append(n / larger)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "similarity": pa.array(out_s, pa.float64())})

    return rows.repartition(groups, "p").groupBy("p").applyInArrow(run, "a long, b long, similarity double")


def class_sets(df: DataFrame, key: str, sha: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(members: `key`, `sha`, `cls`, `n`; the written sets they come from)."""
    src = spread(df.select(F.col(key).cast("long").alias("key"), F.col(sha).cast("string").alias("sha"), F.col(body).alias("body")))
    light = written(_features(src), "neardup-sets")
    return light.select("key", F.coalesce("sha", F.lit("")).alias("sha"), "cls", "n").where("key IS NOT NULL").dropDuplicates(["key"]), light


def class_links(df: DataFrame, key: str, sha: str, body: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members: `key`, `sha`, `cls`, `n`; links between classes: `a`, `b`, `similarity`)."""
    spark = df.sparkSession
    exact = Fraction(str(threshold))
    members, light = class_sets(df, key, sha, body)
    sets = light.where("tokens IS NOT NULL").select("cls", "tokens")
    some = light.where("tokens IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("c")).first()
    cores = spark.sparkContext.defaultParallelism
    levels = phrase_levels(sets, some.n, cores)
    buckets = int(max(cores, some.n * (1 - 0.75 * float(exact)) // POSTINGS_A_BUCKET + 1))
    cand = written(_candidates(_postings(sets, levels, exact, buckets), exact, buckets), "neardup-candidates")
    pairs, groups = _grouped(written(_blocks(cand), "neardup-blocks"), some.n / max(some.c, 1))
    return members, _verified(pairs, groups, sets, exact)


def edition_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of keys with different text hashes, smaller key first: across linked classes and within a class."""
    kinds = members.select("cls", "sha").distinct()
    across = links.select("a", "b").join(kinds.select(F.col("cls").alias("a"), F.col("sha").alias("sa")), "a").join(kinds.select(F.col("cls").alias("b"), F.col("sha").alias("sb")), "b").where("sa <> sb")
    x, y = kinds.select(F.col("cls").alias("a"), F.col("sha").alias("sa")), kinds.select(F.col("cls").alias("b"), F.col("sha").alias("sb"))
    within = x.join(y, (F.col("a") == F.col("b")) & (F.col("sa") < F.col("sb")))
    both = across.select("a", "sa", "b", "sb").unionByName(within.select("a", "sa", "b", "sb"))
    ma, mb = members.select(F.col("cls").alias("a"), F.col("sha").alias("sa"), F.col("key").alias("ka")), members.select(F.col("cls").alias("b"), F.col("sha").alias("sb"), F.col("key").alias("kb"))
    return both.join(ma, ["a", "sa"]).join(mb, ["b", "sb"]).select(F.least("ka", "kb").alias("edition_a"), F.greatest("ka", "kb").alias("edition_b"))


def member_rows(members: DataFrame) -> DataFrame:
    """`edition_id`, `class_id` (smallest edition with the same phrases), `text_sha256`: a row for each edition with words."""
    rep = members.groupBy("cls").agg(F.min("key").alias("class_id")).withColumnRenamed("cls", "c")
    return members.join(rep, F.col("cls") == F.col("c")).select(F.col("key").alias("edition_id"), "class_id", F.col("sha").alias("text_sha256"))


def link_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """`class_a`, `class_b` (smaller first), `similarity` of the linked classes, named by their smallest editions."""
    rep = members.groupBy("cls").agg(F.min("key").alias("class_id"))
    ra, rb = rep.select(F.col("cls").alias("a"), F.col("class_id").alias("x")), rep.select(F.col("cls").alias("b"), F.col("class_id").alias("y"))
    return links.join(ra, "a").join(rb, "b").select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each key: its class (the smallest key with the same phrases), copies in the class, links of the class to other classes."""
    n = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").count().select(F.col("a").alias("cls"), F.col("count").alias("links"))
    rep = members.groupBy("cls").agg(F.min("key").alias("class_id"), F.count("*").alias("copies"))
    return members.join(rep, "cls").join(n, "cls", "left").select(F.col("key").alias("edition_id"), "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
