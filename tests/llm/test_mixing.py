import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import mixing as M
from palimpsest.session import table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1000), st.integers(0, 5)), min_size=1, max_size=8))
def test_water_fill(rows):
    shares, capacity = {str(i): r[0] for i, r in enumerate(rows)}, {str(i): r[1] * r[2] for i, r in enumerate(rows)}
    whole = sum(r[1] for r in rows)
    g = M.water_fill(whole, shares, capacity)
    assert all(0 <= g[s] <= capacity[s] + 1e-6 for s in g)
    able = sum(c for s, c in capacity.items() if shares[s] > 0)
    assert sum(g.values()) == pytest.approx(min(whole, able), rel=1e-6, abs=1e-6)
    free = [s for s in g if shares[s] > 1e-6 and g[s] < capacity[s] - 1e-6]
    for s in free:  # sources that aren't clamped keep the proportions of their shares
        assert g[s] / shares[s] == pytest.approx(g[free[0]] / shares[free[0]], rel=1e-6)


def made(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    return M.counted(d), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix(spark):
    docs = [(i, f"some words {i}", "big") for i in range(3000)] + [(10_000 + i, f"other words here {i}", "small") for i in range(50)] + [(20_000, None, "big"), (20_001, "", None), (20_002, "unlisted", "nowhere"), (0, "some words 0", "big")]
    tokens, targets = made(spark, docs, [("big", 0.5, 2), ("small", 0.3, 4), ("none", 0.1, 3), ("zero", 0.0, 3), ("big", 0.5, 2), (None, 0.1, 1)])
    assert tokens.count() == 3053
    plan = {e["source"]: e for e in M.plan(tokens, targets)}
    assert plan["small"]["epochs"] == 4
    rows = M.mix(tokens, targets).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    whole = sum(r.n_tokens for r in tokens.collect())
    total = {s: sum(r.uses * r.n_tokens for r in rows if r.source == s) for s in ("big", "small")}
    assert total["small"] == 4 * plan["small"]["tokens"]
    assert abs(total["big"] - plan["big"]["budget"]) <= 5
    assert abs(sum(total.values()) - whole) <= 10
    assert all(1 <= r.uses <= {"big": 2, "small": 4}[r.source] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix(tokens, targets).collect()))
    share = {r.source: r for r in M.shares(tokens, targets).collect()}
    assert set(share) == {"big", "small", "none", "zero"}
    assert share["none"].tokens == 0 and share["small"].clamped and not share["big"].clamped
    assert sum(r.reached_share for r in share.values()) == pytest.approx(1)


def test_all_clamped_and_empty(spark):
    tokens, targets = made(spark, [(1, "a b c", "x"), (2, "d e f", "y")], [("x", 1.0, 1)])
    assert [(r.doc_id, r.uses) for r in M.mix(tokens, targets).collect()] == [(1, 1)]
    assert M.mix(tokens.limit(0), targets).count() == 0
    assert M.mix(tokens, targets.limit(0)).count() == 0
    assert M.shares(tokens, targets.limit(0)).count() == 0


def test_corpus(spark, sf):
    tokens, targets = M.counted(table(spark, sf, "documents")), table(spark, sf, "mix_targets")
    plan = {e["source"]: e for e in M.plan(tokens, targets)}
    for r in M.shares(tokens, targets).collect():
        assert abs(r.tokens - plan[r.source]["budget"]) <= 6000  # within a document
