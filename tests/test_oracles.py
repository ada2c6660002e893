import glob
import math
import os
from collections import Counter

import pytest

from codequarry.plans.driver_queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(round(v[i], 6) if isinstance(v[i], float) and math.isfinite(v[i]) else v[i] for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_whole_table_queries_leave_nothing_out(spark):
    """By hand, over all edges and records of the tables."""
    from codequarry.plans.views import frame

    edges = [(e.caller_id, e.callee_id, e.line) for e in frame(spark, DATA, "v_calls").collect()]
    found = {(a, f"f{b}") for a, b, line in edges if line % 20 == 0}
    copies = {(a, b) for a, b, line in edges if line % 20}
    assert any(a <= b for a, b in copies)
    while more := {(a, t) for a, b in copies for p, t in found if p == b} - found:
        found |= more
    assert {tuple(r) for r in QUERIES["points_to_closure"](spark, DATA).collect()} == found
    records = frame(spark, DATA, "v_rec").collect()
    known = {(r.variant, r.symbol, r.usr_id) for r in records if r.kind == 7 and r.record == 0 and r.usr_id is not None}
    got = QUERIES["resolve_functions"](spark, DATA).collect()
    assert {(r.variant, r.symbol, r.usr_id) for r in got} == known
    own = lambda r: () if r.usr_id else (r.path, r.context, r.local)
    identity = lambda r: (r.variant, r.symbol, r.kind, r.usr_id or 0, *own(r))
    assert Counter(map(identity, QUERIES["position_dedup_identity"](spark, DATA).collect())) == Counter({identity(r) for r in records})
    places = {(r.variant, r.path, r.line, r.col + 2) for r in records if len(r.symbol.split(".")[-1]) > 2}
    assert places <= {(r.variant, r.path, r.line, r["at"]) for r in QUERIES["position_lookup_batch"](spark, DATA).collect()}
