"""Mixing sources to target shares by capped water-filling.

Sizes are tokens of a public tokenizer. Every source wants its share of a whole as large as the corpus. Sources that can't fill it with their
most repetitions are clamped there; what they leave is redistributed over the others in proportion to their shares, until no source overflows.
A source then takes each document `floor(epochs)` times and a seeded random part of them once more: documents in the order of a seeded hash,
as long as the extra tokens are not reached; the document that crosses the mark is used if that comes nearer to it.

The extra part is cut without sorting a source in one task: hashes are cut into SLOTS ranges, tokens are summed by source and slot (partial
sums before the shuffle), and only the documents of the one slot that holds the mark are ordered. A slot holds 1 / SLOTS of a source.

Defined cases: sources without documents or tokens, without a share, or null get nothing; documents without tokens count no tokens and
are used like the rest of their source; shares that don't sum to one are scaled; if all sources are clamped the whole stays smaller, and
the report says so; a source listed twice counts once (its largest share, then its most repetitions); keys delivered twice count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.bpe import token_counts
from palimpsest.session import written

SEED = 7_919
SLOTS = 4_096
#: Sources go to the driver; their number is that of the target table.
MOST_SOURCES = 100_000


def water_fill(whole: float, shares: dict[str, float], capacity: dict[str, float]) -> dict[str, float]:
    """Tokens that each source contributes: its share, at most its capacity, excess redistributed in proportion to the shares."""
    given = {s: 0.0 for s in shares}
    open_ = {s for s, w in shares.items() if w > 0 and capacity.get(s, 0) > 0}
    rest = float(whole)
    while open_ and rest > 0:
        weight = sum(shares[s] for s in sorted(open_))
        full = {s for s in open_ if rest * shares[s] / weight >= capacity[s]}
        if not full:
            for s in open_:
                given[s] = rest * shares[s] / weight
            break
        for s in full:
            given[s] = float(capacity[s])
        rest -= sum(capacity[s] for s in sorted(full))
        open_ -= full
    return given


def counted(docs: DataFrame) -> DataFrame:
    """`doc_id`, `source`, `n_tokens`: counted once, then read from the shared folder."""
    return written(token_counts(docs, "doc_id", "text", keep=("source",)), "mix-tokens")


def plan(tokens: DataFrame, targets: DataFrame) -> list[dict]:
    """One entry for each target source: its tokens, budget and epochs."""
    rows = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("most"))).alias("t")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources")
    share = {r.source: max(0.0, r.t.share) for r in rows}
    scale = sum(share.values())
    share = {s: x / scale if scale else 0.0 for s, x in share.items()}
    most = {r.source: max(0, r.t.most) for r in rows}
    # sources of the documents that have no target are one row, however many they are
    wanted = tokens.sparkSession.createDataFrame([(s,) for s in share], "s string")
    has = tokens.join(F.broadcast(wanted), F.col("source") == F.col("s"), "left").groupBy("s").agg(F.sum("n_tokens").alias("n")).collect()
    size = {r.s: r.n for r in has if r.s is not None}
    whole = sum(r.n or 0 for r in has)
    given = water_fill(whole, share, {s: most[s] * size.get(s, 0) for s in share})
    return [{"source": s, "target_share": share[s], "max_repeats": most[s], "tokens": size.get(s, 0), "budget": given[s], "epochs": given[s] / size[s] if size.get(s) else 0.0} for s in sorted(share)]


def mix(tokens: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """`doc_id`, `source`, `n_tokens`, `uses` (at least 1)."""
    spark = tokens.sparkSession
    entries = plan(tokens, targets)
    schema = "s string, whole int, extra double, most int"
    few = spark.createDataFrame([(e["source"], int(e["epochs"] + 1e-12), (e["epochs"] - int(e["epochs"] + 1e-12)) * e["tokens"], e["max_repeats"]) for e in entries if e["epochs"] > 0], schema)
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = tokens.join(F.broadcast(few), tokens["source"] == few["s"]).withColumn("h", h).withColumn("slot", F.pmod(F.shiftright(F.col("h"), 20), F.lit(SLOTS)).cast("int")).drop("s")
    sums = rows.where("extra > 0").groupBy("source", "slot").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("source").orderBy("slot")
    # sources x SLOTS rows
    marks = sums.join(F.broadcast(few), sums["source"] == few["s"]).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = marks.where("before < extra AND before + n >= extra").groupBy("source").agg(F.min("slot").alias("cut_slot"), F.min("before").alias("cut_before")).select(F.col("source").alias("cs"), "cut_slot", "cut_before")
    rows = rows.join(cut, F.col("source") == F.col("cs"), "left").drop("cs")
    inside = F.col("slot") == F.col("cut_slot")
    rest = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("one_more", F.coalesce(F.col("slot") < F.col("cut_slot"), F.lit(False)))
    wi = Window.partitionBy("source").orderBy("h", "doc_id")
    edge = rows.where(inside).withColumn("sofar", F.col("cut_before") + F.coalesce(F.sum("n_tokens").over(wi.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = edge.withColumn("one_more", (F.col("sofar") < F.col("extra")) & ((F.col("sofar") + F.col("n_tokens") <= F.col("extra")) | (F.col("sofar") + F.col("n_tokens") - F.col("extra") < F.col("extra") - F.col("sofar"))))
    both = rest.unionByName(edge.drop("sofar"))
    uses = F.least(F.col("most"), F.col("whole") + F.col("one_more").cast("int"))
    return both.select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")


def shares(tokens: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """`source`, `target_share`, `reached_share` (of the tokens in the mixture), `documents`, `uses`, `tokens`, `epochs`, `clamped`: a row for each target source."""
    spark = tokens.sparkSession
    entries = plan(tokens, targets)
    wanted = spark.createDataFrame([(e["source"], e["target_share"], e["epochs"], bool(e["target_share"] > 0 and e["epochs"] >= e["max_repeats"])) for e in entries], "source string, target_share double, epochs double, clamped boolean")
    used = mix(tokens, targets, seed).groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    out = wanted.join(used, "source", "left").fillna(0, ["documents", "uses", "tokens"])
    whole = out.agg(F.sum("tokens").alias("whole"))  # one row
    total = F.col("whole")
    return out.join(F.broadcast(whole)).select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("reached_share"), "documents", "uses", "tokens", "epochs", "clamped")
