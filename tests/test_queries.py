"""Every core query against its SQL in DuckDB, over whole tables."""

import datetime
import decimal
import glob
import importlib
import os

import pytest

duckdb = pytest.importorskip("duckdb")

MODULES = [importlib.import_module(m) for m in ("palimpsest.plans.problems", "palimpsest.plans.catalogue")]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


#: Queries without SQL that find nothing in the test tables; their operators are tested on made-up rows.
MAY_BE_EMPTY: set[str] = {"paragraph_map", "near_quotations"}


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    if isinstance(v, datetime.datetime) and v.tzinfo:
        v = v.astimezone(datetime.UTC).replace(tzinfo=None)
    return str(v)


def connected(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return c


@pytest.fixture(scope="module")
def folders(sf):
    """The tables and, for queries that find nothing in them, those of ten times the scale."""
    return [(f, connected(f)) for f in dict.fromkeys((sf, sf.replace("sf0.001", "sf0.01")))]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, folders, name):
    got = []
    for sf, con in folders:
        df = QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        res = con.execute(SQL[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())
        assert got == want
        if got:
            break
    assert got, "empty was compared with empty"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert df.columns and (rows or name in MAY_BE_EMPTY) and len({repr(r) for r in rows}) == len(rows)


def test_text_equals_the_tables_own_columns(spark, sf):
    """Visible texts and versions against the hash and banner that the table states."""
    import hashlib
    import re

    from palimpsest.session import table

    e = {r.edition_id: r for r in table(spark, sf, "export_editions").collect()}
    texts = {r.edition_id: r.text for r in QUERIES["visible_texts"](spark, sf).collect()}
    for i, r in e.items():
        if r.body:
            t = re.sub(r"[\s↩]+", "", texts[i])
            assert hashlib.sha256(t.encode()).hexdigest() == r.text_sha256, i
    versions = {r.edition_id: r.version for r in QUERIES["version_banners"](spark, sf).collect()}
    assert {i: r.version_banner for i, r in e.items() if r.body and r.version_banner} == {i: versions[i] for i, r in e.items() if r.body and r.version_banner}
