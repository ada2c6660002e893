import json

import pytest
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.operators import calls, merge, search
from codequarry.plans.catalog import IndexStore, StaleCache
from codequarry.plans.service import IndexService
from codequarry.sources import documents, extract, text, trace
from codequarry.streaming import flows


def rec(symbol, path, line, col=1, record=1, action=0, kind=1, mode=4, context="", usr=1, ctx=None, local=0, variant="general"):
    return (symbol, record, action, kind, mode, variant, path, line, col, context, usr, ctx, local)


def frames(spark, rows, files, main):
    f = spark.createDataFrame([("general", p, m, s, int(p in main)) for p, m, s in files], "variant string, path string, mtime_ns long, size long, is_main int")
    return {"files": f, "records": spark.createDataFrame(rows, S.RECORDS)}


def test_shared_header_and_replacement(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    for k in range(3):
        rows = [rec("s.f", "h.h", 1, record=0, action=1, mode=0), rec("s.f", f"{k}.c", 5)]
        store.store(frames(spark, rows, [("h.h", 1, 1), (f"{k}.c", 1, 1)], {f"{k}.c"}))
    assert store.symbol("s.f").count() == 4
    store.store(frames(spark, [rec("s.f", "0.c", 9), rec("t", "0.c", 10)], [("0.c", 2, 2)], {"0.c"}))
    assert sorted((r.path, r.line) for r in store.symbol("s.f").collect()) == [("0.c", 9), ("1.c", 5), ("2.c", 5), ("h.h", 1)]
    assert store.table("files").where("path = '0.c'").first().size == 2
    n = store.version()
    pointers = sorted(x.name for x in (tmp_path / "index").glob("current-*"))
    assert n == 4 and pointers == [f"current-{S.SCHEMA_VERSION}-{k}" for k in (3, 4)]
    (tmp_path / "index" / "current-3-9").write_text("")
    with pytest.raises(ValueError, match="schema"):
        store.tables()


def test_store_writes_what_changes(spark, tmp_path):
    root = tmp_path / "index"
    store = IndexStore(spark, str(root))
    many = [rec(f"sym{k % 97}", f"f{k % 200}.c", k, col=k % 60) for k in range(20_000)]
    all_files = [(f"f{k}.c", 1, 1) for k in range(200)]
    store.store(frames(spark, many, all_files, set()))

    def size():
        return {p: p.stat().st_size for p in (root / "data" / "records").rglob("*.parquet")}

    first = size()
    changed = [rec(f"new{k}", "f7.c", k) for k in range(100)] + [rec(f"new{k}", "f8.c", k) for k in range(100)]
    store.store(frames(spark, changed, [("f7.c", 2, 1), ("f8.c", 1, 2)], {"f7.c", "f8.c"}))
    fresh = {p: n for p, n in size().items() if p not in first}
    assert first.keys() <= size().keys()  # nothing was rewritten
    rows = spark.read.parquet(*map(str, {next(q for q in p.parents if q.name.startswith("writer=")) for p in fresh})).count()
    assert rows == 200  # 1 % of the records
    want = [r for r in many if r[6] not in ("f7.c", "f8.c")] + changed
    assert sorted(store.tables()["records"].collect(), key=str) == sorted((spark.createDataFrame(want, S.RECORDS)).collect(), key=str)
    assert store.symbol("sym3").count() == sum(r[0] == "sym3" for r in want) and store.symbol("new5").count() == 2
    files = {r.path: (r.mtime_ns, r["size"]) for r in store.table("files").collect()}
    assert len(files) == 200 and files["f7.c"] == (2, 1) and files["f8.c"] == (1, 2) and files["f9.c"] == (1, 1)
    # the same file again, and a first writer's rows stay
    store.store(frames(spark, [rec("again", "f7.c", 1)], [("f7.c", 3, 1)], {"f7.c"}))
    store.store(frames(spark, [rec("sym9", "f9.c", 9, col=9, context="late"), rec("other", "f9.c", 1)], [("f9.c", 1, 1)], set()))
    now = store.tables()["records"]
    assert [r.symbol for r in now.where("path = 'f7.c'").collect()] == ["again"] and now.where("symbol = 'other'").count() == 1
    assert now.where("path = 'f9.c' AND context = 'late'").count() == (0 if any(r[0] == "sym9" and r[6:9] == ("f9.c", 9, 9) for r in many) else 1)


def test_store_gathers_fragments_and_survives_crashes(spark, tmp_path, monkeypatch):
    from codequarry.plans import catalog

    monkeypatch.setattr(catalog, "MOST_FRAGMENTS", 3)
    root = tmp_path / "index"
    store = IndexStore(spark, str(root))
    for k in range(6):
        store.store(frames(spark, [rec(f"s{k}", f"{k % 4}.c", k)], [(f"{k % 4}.c", k, 1)], {f"{k % 4}.c"}))
        assert len(store._current()) <= 3
    assert sorted(r.symbol for r in store.tables()["records"].collect()) == ["s2", "s3", "s4", "s5"]
    listed = {x for v in store._pointers() for x in store._fragments(v)}
    on_disk = {p.name.removeprefix("writer=") for p in (root / "data" / "records").iterdir()}
    assert on_disk == listed
    # a writer that ends while it writes, and one that ends at its pointer
    left = root / "data" / "records" / "writer=7-crashed"
    left.mkdir()
    (left / "part-0.parquet").write_bytes(b"half")
    (root / f"current-{S.SCHEMA_VERSION}-{store.version() + 1}").write_text("7-crashed")
    before = store.version()
    assert sorted(r.symbol for r in store.tables()["records"].collect()) == ["s2", "s3", "s4", "s5"]
    store.store(frames(spark, [rec("s6", "9.c", 1)], [("9.c", 1, 1)], {"9.c"}))
    assert store.version() == before + 2 and store.tables()["records"].count() == 5
    assert "7-crashed" not in store.vacuum(hours=1) and store.vacuum(hours=0) == ["7-crashed"] and not left.exists()
    # two writers of one version
    other = IndexStore(spark, str(root))
    monkeypatch.setattr(other, "_pointers", lambda n=store._pointers(): n)
    store.store(frames(spark, [rec("s7", "9.c", 2)], [("9.c", 2, 1)], {"9.c"}))
    with pytest.raises(OSError, match="another writer"):
        other._commit(other._fragments(store._pointers()[-2]), {}, None)
    assert store.tables()["records"].where("symbol = 's7'").count() == 1


def test_cached_files_bring_no_rows_and_are_staged_anew(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.store(frames(spark, [rec("s.f", "h.h", 1, record=0, action=1, mode=0)], [("h.h", 1, 1), ("0.c", 1, 1)], {"0.c"}))

    def staged(time, cached):
        out = frames(spark, [rec("x", "h.h", 7), rec("s.f", "1.c", 5)], [("h.h", time, 1), ("1.c", 1, 1)], {"1.c"})
        mark = F.when(F.col("path") == "h.h", cached).otherwise(0)
        return out | {"files": out["files"].withColumn("cached", mark)}

    store.store(staged(1, 1))
    assert sorted(r.symbol for r in store.table("records").where("path = 'h.h'").collect()) == ["s.f"]
    with pytest.raises(StaleCache):
        store.store(staged(2, 1))
    asked = []
    store.store(staged(2, 1), lambda stale: asked.extend(r.path for r in stale.collect()) or staged(2, 0))
    assert asked == ["h.h"] and [r.symbol for r in store.table("records").where("path = 'h.h'").collect()] == ["x"]


def test_first_writer_wins_and_caches(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "k int, v string, seq int")
    assert sorted((r.k, r.v) for r in merge.keep_first(rows, ["k"], ["seq"]).collect()) == [(1, "a"), (2, "c")]
    files = spark.createDataFrame([("g", "h.h", 1, 1)], "variant string, path string, mtime_ns long, size long")
    prints = spark.createDataFrame([("g", "h.h", "x"), ("g", "h.h", "y")], "variant string, path string, fingerprint string")
    staged = spark.createDataFrame([("g", "h.h", 1, 1, 0, "y"), ("g", "h.h", 1, 2, 0, "y"), ("g", "m.c", 1, 1, 1, None)], "variant string, path string, mtime_ns long, size long, is_main int, fingerprint string")
    assert sorted(r.cached for r in merge.mark_cached(staged, files, prints).collect()) == [0, 0, 1]


def test_pages_make_the_whole_scan(spark):
    rows = [rec(f"s{i % 4}", f"p{i % 3}", i % 5, col=i) for i in range(20)]
    r = spark.createDataFrame(rows, S.RECORDS)
    service = IndexService(spark, r, workspace="/w", variant="general")
    found, cursor = [], None
    while True:
        page = service.search_symbols("s*", limit=3, cursor=cursor)
        found += page["records"]
        if not page["truncated"]:
            break
        cursor = page["next_cursor"]
    assert found == [x.asDict() for x in search.query(r).collect()]
    with pytest.raises(ValueError):
        service.search_symbols("s*", variant="other")
    with pytest.raises(ValueError):
        service.confined("/etc/passwd")
    assert service.symbol_at("p0", 99, 0).count() == 0


def test_position_and_overlay(spark):
    r = spark.createDataFrame([rec("a.xyz", "f.c", 3, col=5), rec("a.xyz", "f.c", 3, col=5, action=1)], S.RECORDS)
    assert search.at_position(r, "f.c", 3, 7).count() == 2 and search.at_position(r, "f.c", 3, 8).count() == 0
    cand = spark.createDataFrame([("none", 0), ("f.c", 1)], "path string, prio int")
    assert search.position_service(r, cand, 3, 6).count() == 1
    over = spark.createDataFrame([rec("b", "f.c", 1)], S.RECORDS)
    assert [x.symbol for x in search.overlaid(r, over).collect()] == ["b"]


def test_walk_limits_and_cycles():
    graph = {1: [2, 3], 2: [1, 4], 3: [3], 4: []}
    fetch = lambda n: [{"to": t} for t in graph[n]]
    w = calls.walk(fetch, 1, 3)
    assert [(e["to"], e["depth"]) for e in w.edges] == [(2, 1), (3, 1), (1, 2), (4, 2), (3, 2)] and w.cycles and not w.truncated
    assert calls.walk(fetch, 1, 3, limit=2).truncated
    w = calls.walk(fetch, 1, 2, nodes=2)
    assert w.node_limit_hit and [e["to"] for e in w.edges] == [2, 1]
    with pytest.raises(ValueError):
        calls.walk(fetch, 1, 17)


def test_walk_by_frontier_is_the_walk_by_node(spark):
    import random

    tracker = spark.sparkContext.statusTracker()
    for seed in range(6):
        r = random.Random(seed)
        n = r.choice([4, 12, 40])
        rows = {("g", f"n{a}", a, f"n{b}", b, f"p{r.randint(0, 2)}", r.randint(1, 9), 1) for a, b in ((r.randint(1, n), r.randint(1, n)) for _ in range(3 * n))}
        rows |= {("h", "n1", 1, "n2", 2, "p", 1, 1), ("g", "n1", 1, "", 0, "p", 1, 1), ("g", "n2", None, "n1", 1, "p", 1, 1)}
        edges = spark.createDataFrame(sorted(rows, key=str), "variant string, caller string, caller_id long, callee string, callee_id long, path string, line long, col long").coalesce(1).cache()
        for direction in ("callees", "callers"):
            depth, limit, nodes = r.randint(1, 5), r.choice([3, 20, 200]), r.choice([2, 5, 200])
            want = calls.walk(calls.spark_fetch(edges, direction, limit + 1), ("g", "n1", 1), depth, limit, nodes)
            spark.sparkContext.setJobGroup(f"walk{seed}{direction}", "")
            got = calls.walk_levels(calls.frontier_fetch(edges, direction, limit + 1), ("g", "n1", 1), depth, limit, nodes)
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            assert got == want, (seed, direction)
            assert len(tracker.getJobIdsForGroup(f"walk{seed}{direction}")) <= 4 * depth  # a few stages of one query a level


def test_numbers_over_splits(spark, tmp_path):
    good = {"pid": 1, "command": "index", "source": "a.c", "phase": "total", "start_ns": 5, "duration_ns": 7}
    rows = [json.dumps({**good, "start_ns": k, "source": "é" * (k % 40) + "x"}) for k in range(5_000)]
    rows[3_210] = rows[3_210].replace("1", "-1", 1) + " "
    p = tmp_path / "t.jsonl"
    p.write_text("\n".join(rows) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = text.numbered(spark, str(p))
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 10
        assert sorted((r.line, r.value) for r in found.collect()) == list(enumerate(rows, 1))
        with pytest.raises(ValueError, match="line 3211"):
            trace.read(spark, str(p))
        rows[3_210] = rows[0]
        p.write_text("\n".join(rows))
        assert trace.read(spark, str(p)).count() == 5_000
        p.write_text("\n".join(rows[:100]) + "\n\n" + "\n".join(rows[100:]))
        with pytest.raises(ValueError, match="line 101"):
            trace.read(spark, str(p))
        (tmp_path / "none").write_text("")
        assert text.numbered(spark, str(tmp_path / "none")).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_listing_over_ranges(spark):
    rows = [rec(f"s{k // 3 % 5}", f"p{k // 400}", k // 6 + 1, col=5, record=int(k % 7 > 0), action=k % 2, mode=k % 3, context="f" * (k % 20), variant="ab"[k % 2 if k > 50 else 0]) for k in range(2_000)]
    r = spark.createDataFrame(rows, S.RECORDS)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges are joined
        listed = text.listing(text.dissect(r)).collect()
        assert text.ranked(r, "variant", S.RECORD_ORDER[1:]).select("part").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = []
    for variant in "ab":
        before = None
        ordered = sorted((x for x in r.collect() if x.variant == variant), key=lambda x: [x[c] for c in S.RECORD_ORDER])
        for i, x in enumerate(ordered, 1):
            key = (x.path, x.line, x.col, x.symbol, x.record)
            if x.record == 0 or before != key:
                want.append((variant, i, int(before is None or before[0] != x.path)))
            before = key
    assert sorted((x.variant, x.seq, x.header) for x in listed) == sorted(want)
    one = spark.createDataFrame([rec("S.f", "a.c", 12, col=3, record=1, mode=8, context="main", local=1)], S.RECORDS)
    first = text.listing(text.dissect(one)).first().text
    assert first == "\nFILE: a.c\n\n  12:3   main             -w- . m S.f"
    typed = text.listing(text.dissect(one).withColumn("type", F.lit("int"))).first().text
    assert typed.endswith(". m S.f" + " " * 30 + "int")


def test_calls_on_spark(spark):
    edges = spark.createDataFrame([("g", "a", 1, "b", 2, "f", 1, 1), ("g", "b", 2, "a", 1, "f", 2, 1), ("g", "b", 2, "c", None, "f", 3, 1)], "variant string, caller string, caller_id long, callee string, callee_id long, path string, line long, col long")
    start = spark.createDataFrame([("g", "a", 1)], "variant string, name string, id long")
    assert sorted((r.name, r.depth) for r in calls.reachable(edges, start, 6).collect()) == [("a", 0), ("b", 1)]
    assert calls.by_name(edges, "b", "callees").count() == 2
    w = calls.walk(calls.spark_fetch(edges, "callees", 10), ("g", "a", 1), 2)
    assert w.cycles and len(w.edges) == 2


def test_trace_lines(spark, tmp_path):
    good = {"pid": 1, "command": "index", "source": "a.c", "phase": "total", "start_ns": 5, "duration_ns": 7}
    p = tmp_path / "t.jsonl"
    p.write_text("\n".join(map(json.dumps, [good, {**good, "items_in": 1, "items_out": 0}])) + "\n")
    assert trace.read(spark, str(p)).count() == 2
    for bad in ({**good, "pid": -1}, {**good, "pid": True}, {**good, "pid": "1"}, {**good, "extra": 1}, {**good, "phase": ""}, {**good, "items_in": 1}):
        p.write_text(json.dumps(bad) + "\n")
        with pytest.raises(ValueError, match="line 1"):
            trace.read(spark, str(p))
    p.write_text(json.dumps(good)[:-1] + ', "pid": 2}\n')
    with pytest.raises(ValueError, match="line 1"):
        trace.read(spark, str(p))


def test_documents_and_streams(spark, tmp_path):
    sym = {"kind": "field", "name": "f", "owner": "s", "usr": "u", "usr_id": "f" * 16, "file": "a.c", "line": 1, "column": 2, "local": False, "definition": True}
    use = {"kind": "write", "symbol_kind": "var", "mode": "-w-", "mode_bits": 8, "name": "v", "file": "a.c", "line": 2, "column": 1, "local": True}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "d.json").write_text(json.dumps({"version": 1, "symbols": [sym], "uses": [use]}))
    rows = documents.read(spark, str(folder / "d.json"), "g").orderBy("seq").collect()
    assert [(r.symbol, r.kind, r.action, r.usr_id) for r in rows] == [("s.f", 1, 1, -1), ("v", 0, 1, None)]
    store = IndexStore(spark, str(tmp_path / "index"))
    flows.merge_stream(spark, str(folder), store, "g", str(tmp_path / "cp")).awaitTermination()
    assert store.table("records").count() == 2
    (tmp_path / "bad.json").write_text(json.dumps({"version": 2, "symbols": [], "uses": []}))
    with pytest.raises(ValueError):
        documents.read(spark, str(tmp_path / "bad.json"), "g")


def test_rolling_stats(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"pid": 1, "command": "c", "source": "s", "phase": "parse", "start_ns": i * 10**9, "duration_ns": i}) for i in range(4)))
    q = flows.rolling_stats(flows.trace_stream(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("rolling").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT n, total_ns FROM rolling").first()[:] == (4, 6)


def test_extraction(spark):
    c = '#include <a.h>\n#define M(x) x\nstruct s { int f; };\nenum e { A, B };\nint g(int);\nint h(void) { return g(1) + M(2); } // g(3)\n'
    s = "\t.type foo, @function\nfoo:\n\tcall bar\n\tcall *%rax\n"
    rows = extract.extract(spark.createDataFrame([("v", "x.c", c), ("v", "y.S", s)], "variant string, path string, content string")).collect()
    got = {(r.path, r.symbol, r.record, r.action, r.kind) for r in rows}
    assert {("x.c", "<a.h>", 1, 0, 9), ("x.c", "M", 0, 1, 8), ("x.c", "s.f", 0, 1, 1), ("x.c", "A", 0, 1, 5), ("x.c", "g", 0, 0, 7), ("x.c", "h", 0, 1, 7), ("x.c", "g", 1, 3, 7), ("x.c", "M", 1, 0, 8), ("y.S", "foo", 0, 1, 7), ("y.S", "bar", 1, 3, 7)} <= got
    assert sum(r.symbol == "g" and r.record == 1 for r in rows) == 1


def test_line_range(spark):
    d = spark.createDataFrame([(1, "a\r\nbb\nccc\n")], "doc_id long, text string")
    assert [(r.line, r.text) for r in text.line_range(text.lines(d), 1, 9, 5).orderBy("line").collect()] == [(1, "a"), (2, "bb")]


def test_closure(spark):
    d = spark.createDataFrame([("p", "f")], "pointer string, target string")
    c = spark.createDataFrame([("q", "p"), ("r", "q"), ("p", "r")], "pointer string, source string")
    assert sorted(r.pointer for r in calls.points_to(d, c).collect()) == ["p", "q", "r"]


def test_empty_tables(spark):
    r = spark.createDataFrame([], S.RECORDS)
    assert search.query(r, symbol="*").count() == 0 and search.highlights(r).count() == 0
    assert calls.hierarchy(calls.call_edges(r), "incoming").count() == 0
    assert merge.file_fingerprints(r.withColumn("seq", F.lit(1))).count() == 0


C_TEXT = """#define N 3
struct s { int f; struct { int in; } named; union { int u1; char u2; }; int arr[N]; };
typedef struct { int q; } T;
enum e { A, B = N };
typedef int (*fp)(int);
static struct s glob = { .f = 1, .named = { .in = 2 } };
int g(int);
int later(void);
static int h(struct s *p, T t, fp cb) {
    int x = p->f + t.q, *r = &x;
    p->named.in += 2; p->u1++;
    *r = g(1) + N; cb(3); (*cb)(4);
    fp k = g; k = &g;
    if (x == B) return sizeof(struct s) + (int)glob.f; // g(3)
    return h(&glob, t, cb) ? "g(1)"[0] : later();
}
int later(void) { return 0; }
"""


def test_c_records():
    rows = {(r[5], r[6], *r[:5], r[7], r[8]) for r in extract.c_records(C_TEXT)}
    found = {(line, *rest[1:]) for line, *rest in rows}
    sym, use = S.SYMBOL, S.USE
    assert {
        (2, "s", sym, 1, 2, 0, "", 0), (2, "s.f", sym, 1, 1, 0, "", 0), (2, ":named.in", sym, 1, 1, 0, "", 0), (2, "s.u2", sym, 1, 1, 0, "", 0), (2, "s.arr", sym, 1, 1, 0, "", 0),
        (2, "N", use, 0, 8, 4, "", 0), (3, ":T", sym, 1, 2, 0, "", 0), (3, ":T.q", sym, 1, 1, 0, "", 0), (3, "T", sym, 1, 6, 0, "", 0), (4, "e", sym, 1, 4, 0, "", 0), (4, "B", sym, 1, 5, 0, "", 0), (5, "fp", sym, 1, 6, 0, "", 0),
        (6, "glob", sym, 1, 0, 0, "", 0), (6, "glob", use, 1, 0, 8, "", 0), (6, "s.f", use, 1, 1, 8, "", 0), (6, ":named.in", use, 1, 1, 8, "", 0), (6, "s", use, 0, 2, 4, "", 0),
        (7, "g", sym, 0, 7, 0, "", 0), (9, "h", sym, 1, 7, 0, "", 0), (9, "p", sym, 1, 0, 0, "h", 1), (9, "T", use, 0, 6, 4, "h", 1),
        (10, "x", sym, 1, 0, 0, "h", 1), (10, "x", use, 1, 0, 8, "h", 1), (10, "p", use, 0, 0, 16, "h", 1), (10, "s.f", use, 0, 1, 4, "h", 0), (10, ":T.q", use, 0, 1, 4, "h", 0), (10, "x", use, 2, 0, 3, "h", 1),
        (11, ":named.in", use, 1, 1, 8, "h", 0), (11, "s.u1", use, 1, 1, 8, "h", 0), (12, "r", use, 0, 0, 16, "h", 1), (12, "g", use, 3, 7, 16, "h", 0), (12, "cb", use, 3, 0, 16, "h", 1),
        (13, "g", use, 0, 7, 16, "h", 0), (13, "g", use, 2, 7, 3, "h", 0), (13, "k", use, 1, 0, 8, "h", 1), (14, "B", use, 0, 5, 4, "h", 1), (14, "glob", use, 0, 0, 4, "h", 1), (14, "s", use, 0, 2, 4, "h", 1),
        (15, "h", use, 3, 7, 16, "h", 0), (15, "glob", use, 2, 0, 3, "h", 1), (15, "later", use, 3, 7, 16, "h", 0), (17, "later", sym, 1, 7, 0, "", 0),
    } <= found
    calls_of_g = [r for r in rows if r[2] == "g" and r[4] == S.CALL]
    assert [(r[0], r[1]) for r in calls_of_g] == [(12, 10)]  # not those in comments and texts
    assert not [r for r in rows if r[2] == "later" and r[3] == sym and r[4] == S.DECLARATION]


def test_c_records_of_broken_and_long_texts():
    import time

    broken = "int f(void) { int a = ; a = 2; ((( }\nstruct { int x;\nint g(void) { return f(); }\n} v; int after(void) { return g(); }"
    assert {"f", "after"} <= {r[0] for r in extract.c_records(broken) if r[3] == S.FUNCTION}
    for text_ in ("", "}", "{{{{", "(" * 5_000, "#define", "int", 'char *s = "unclosed', "/* open", "struct s { struct { int x; } in; int y[3]; };"):
        extract.c_records(text_)
    assert {r[0] for r in extract.c_records("struct a { struct { int x; } in; int y[3]; };")} == {"a", ":in.x", "a.in", "a.y"}
    start = time.time()
    extract.c_records("x y z\n" * 60_000 + "int a;\n" * 20_000 + "int f(void) { return a; }\n" * 5_000)
    assert time.time() - start < 30


def test_further_service_pages(spark):
    rows = [rec("f", f"{i}.c", i, action=S.CALL, kind=S.FUNCTION, context="g", usr=5, ctx=6) for i in range(5)] + [rec("f", "0.c", 9, record=0, action=1, kind=S.FUNCTION, mode=0, usr=5)]
    types = spark.createDataFrame([("f", 7, 5, "general", f"{i}.c", "int", "int", "", -1, 0) for i in range(3)], S.SYMBOL_TYPES)
    signature = spark.createDataFrame([("f", 5, "general", "0.c", p, "a", "int", "int", "", -1, 0, 0) for p in (1, -1, 0)], S.FUNCTION_TYPES)
    variants = spark.createDataFrame([(n, None, "/src") for n in ("b", "a", "c")], S.VARIANTS)
    commands = spark.createDataFrame([("general", "0.c", "/w", ["cc"])], S.COMMANDS)
    files = spark.createDataFrame([("general", "0.c", 1, 1), ("general", "1.c", 1, 1)], S.FILES)
    service = IndexService(spark, spark.createDataFrame(rows, S.RECORDS), workspace="/w", tables={"symbol_types": types, "function_types": signature, "variants": variants, "commands": commands, "files": files})

    def all_pages(fetch, name):
        found, cursor = [], None
        while True:
            page = fetch(cursor)
            found += page[name]
            if not page["truncated"]:
                return found
            cursor = page["next_cursor"]

    assert [r["line"] for r in all_pages(lambda c: service.related_records("general", "f", 5, limit=2, cursor=c), "records")] == [0, 9, 1, 2, 3, 4]
    assert [r["path"] for r in all_pages(lambda c: service.declared_types("general", "f", 7, 5, limit=2, cursor=c), "types")] == ["0.c", "1.c", "2.c"]
    assert [r["position"] for r in service.function_signature("general", "f", 5)] == [-1, 0, 1]
    assert [r["name"] for r in all_pages(lambda c: service.list_variants(limit=2, cursor=c), "variants")] == ["a", "b", "c"]
    assert [r["path"] for r in all_pages(lambda c: service.calls_page("callers", "general", "f", 5, limit=2, cursor=c), "edges")] == [f"{i}.c" for i in range(5)]
    with pytest.raises(ValueError, match="cursor does not match"):
        service.calls_page("callers", "general", "f", 5, cursor=service_cursor())
    present = spark.createDataFrame([("0.c", 1, 1), ("1.c", 2, 1), ("3.c", 1, 1)], "path string, mtime_ns long, size long")
    status = {r["path"]: (r["status"], r["command_available"]) for r in service.index_status(present, ["0.c", "1.c", "3.c"], "general")}
    assert status == {"0.c": ("Current", True), "1.c": ("Drifted", False), "3.c": ("NotIndexed", False)}
    with pytest.raises(ValueError):
        service.symbol_at("../etc/x", 1, 1)


def service_cursor():
    from codequarry.functions.scalars import encode_cursor

    return encode_cursor({"variant": "general", "caller": "g", "path": "9.c", "line": 1, "col": 1})


def test_outputs(spark, tmp_path):
    from codequarry.functions import scalars as fn

    rows = spark.createDataFrame([rec("s.f", "a.c", 2, record=0, action=1, mode=0, usr=-1), rec("v", "a.c", 3, action=1, kind=0, mode=8, usr=None, local=1)], S.RECORDS)
    doc = documents.to_documents(rows).first()
    (tmp_path / "d.json").write_text(doc.json)
    again = documents.read(spark, str(tmp_path / "d.json"), "general")
    want = {(r.symbol, r.record, r.action, r.kind, r.mode, r.line, r.col, r.usr_id, r.local) for r in rows.collect()}
    assert {(r.symbol, r.record, r.action, r.kind, r.mode, r.line, r.col, r.usr_id, r.local) for r in again.collect()} == want
    commands = spark.createDataFrame([("g", f, "/w", ["cc", "-c", 'a"b']) for f in ("b.c", "a.c")], S.COMMANDS)
    whole = "\n".join(r.value for r in documents.export_lines(commands, "g").collect())
    assert [c["file"] for c in json.loads(whole)] == ["a.c", "b.c"] and json.loads(whole)[0]["arguments"][2] == 'a"b'
    t = spark.createDataFrame([(1, "index", "a.c", "fingerprint", 5, 7, 10, 9), (1, "index", "a.c", "total", 4, 9, None, None)], S.TRACE)
    trace.to_lines(t).coalesce(1).write.text(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("part-*"))
    assert trace.read(spark, str(part)).count() == 2
    assert tuple(trace.fingerprint_cache(t).first()) == (10, 9) and [r.phase for r in trace.phases_by_total(t).collect()] == ["total", "fingerprint"]
    kinds = ["callsite"] * 3 + ["identified"] * 3 + ["direct"] * 2 + ["copy"]
    c = spark.createDataFrame([(k, f"p{i % 2}", f"f{i}") for i, k in enumerate(kinds)], "kind string, pointer string, target string")
    assert trace.points_to_summary(c).first().asDict() == {"callsites": 3, "identified": 3, "direct": 2, "copies": 1, "pointers": 2, "functions": 2}
    lines = spark.createDataFrame([("/src/a.c", 3, "\tv = 1;")], "path string, line long, text string")
    variants = spark.createDataFrame([("general", None, "/src")], S.VARIANTS)
    assert {r.source for r in search.with_source(rows, lines, variants).collect()} == {"", "v = 1;"}
    assert search.overlay_query(rows, "v", mode=8).count() == 1 and search.overlay_query(rows, "v", mode=4).count() == 0
    f = spark.createDataFrame([rec("f", "a.c", 1, kind=S.FUNCTION, usr=5)] * 2, S.RECORDS)
    assert [tuple(r) for r in search.functions_at(f).collect()] == [("general", "f", 5)]
    args = spark.createDataFrame([(["cc", "-o", "x.o", "-MF", "d", "-MD", "-Werror", "-Ia", "a.c", "-c"],)], "a array<string>")
    assert args.select(fn.sanitise_arguments(F.col("a")).alias("a")).first().a == ["cc", "-Ia", "a.c"]
    assert fn.display_column("\ta\tb", 2) == 9 and fn.display_column("\ta\tb", 4) == 17
    status = spark.createDataFrame([(0, 0, True), (1, 2, True), (1, 2, False)], "r int, e int, d boolean")
    assert [x[0] for x in status.select(fn.parse_status(F.col("r"), F.col("e"), F.col("d"))).collect()] == ["clean", "partial", "failed"]


def _shuffles(df):
    """Exchanges of the plan, without those it reuses."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_records_are_dealt_by_file_once(spark):
    from codequarry.plans import driver_queries
    from codequarry.plans.views import frame

    data, name = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        assert _shuffles(frame(spark, data, "v_rec")) <= 4
        assert _shuffles(driver_queries.QUERIES["file_fingerprint"](spark, data)) <= 5
        base, staged, replaced = (spark.createDataFrame([("v", "p", 1)], "variant string, path string, k int") for _ in range(3))
        assert _shuffles(merge.merged_rows(base, staged, replaced, ["variant", "path", "k"])) <= 3
    finally:
        spark.conf.set(name, before)


def test_merged_rows_of_null_and_repeated_keys(spark):
    kind, key = "variant string, path string, k int, x int", ["variant", "path", "k"]
    base = spark.createDataFrame([("v", "a", 1, 1), ("v", "a", 1, 2), ("v", "a", None, 3), ("v", "b", 1, 4), (None, "a", 1, 5)], kind)
    staged = spark.createDataFrame([("v", "a", 1, 6), ("v", "a", None, 8), ("v", "a", None, 7), ("v", "b", 1, 9), ("v", "c", 2, 11), ("v", "c", 2, 10), (None, "a", 1, 12)], kind)
    replaced = spark.createDataFrame([("v", "b"), ("v", "b")], "variant string, path string")
    assert sorted(r.x for r in merge.merged_rows(base, staged, replaced, key).collect()) == [1, 2, 3, 5, 7, 9, 10, 12]
    plain = base.join(replaced, ["variant", "path"], "left_anti").unionByName(merge.fresh_rows(base, staged, replaced, key))
    assert sorted(r.x for r in plain.collect()) == [1, 2, 3, 5, 7, 9, 10, 12]


def test_listings_move_rows_once(spark):
    """Behind the ranges only a row of each range is moved."""
    from codequarry.plans import driver_queries

    plan = driver_queries.QUERIES["dissect_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(variant") <= 4 and plan.count("row_number") == 0
