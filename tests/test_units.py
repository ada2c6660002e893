"""Preprocessing, include resolution, ids, types and constraints of C units, by hand-derived rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.operators import calls
from codequarry.plans import unit_queries, update
from codequarry.plans.catalog import IndexStore
from codequarry.sources import extract, includes
from codequarry.sources.cpp import Unit, lines
from test_oracles import DATA, duck, rows  # noqa: F401


def preprocessed(files, main="m.c", define=None):
    unit = Unit(lambda p: lines(files[p]) if p in files else None, lambda p: len(files[p]), lambda path, target, angled: target if target in files and not angled else None, define)
    unit.enter(main)
    return unit


def words(text, **files):
    return " ".join(t.text for t in preprocessed({"m.c": text} | {k.replace("_h", ".h"): v for k, v in files.items()}).tokens)


def one(text, main="m.c", **more):
    files = extract.Files()
    files.texts = {main: text} | more.get("files", {})
    found = {(p, t.rsplit("/", 1)[-1], False): t for p in files.texts for t in files.texts}
    return extract.UnitRows(main, files, found)


def test_macros():
    assert words("#define A 1\n#define F(x, y) x + y\nF(A, (2, 3)) F\nF (4,5)") == "1 + ( 2 , 3 ) F 4 + 5"
    assert words("#define X X + 1\nX") == "X + 1"
    assert words("#define f(a) a*g\n#define g(a) f(a)\nf(2)(9)") in ("2 * 9 * g", "2 * f ( 9 )")
    assert words("#define S(x) #x\n#define C(a, b) a ## b\nS(a \"b\") C(x, 1) C(,y) C(z,)") == '"a \\"b\\"" x1 y z'
    assert words("#define V(f, ...) f(__VA_ARGS__)\n#define W(f, a...) p(f, ## a)\nV(g, 1, 2) W(h) W(h, 3)") == "g ( 1 , 2 ) p ( h ) p ( h , 3 )"
    assert words("#define E()\n#define L(x) [x]\nE() L() L(\n1\n)") == "[ ] [ 1 ]"
    assert words("#define A 1\n#undef A\nA\n# define B \\\n 2\nB // c\n/* d\n */ 3") == "A 2 3"
    assert words("#define Q(x) x\nQ(1\n") == "Q ( 1"


def test_conditions():
    assert words("#if 0\na\n#elif 1 + 1 == 2\nb\n#else\nc\n#endif\nd") == "b d"
    assert words("#ifdef X\na\n#ifdef Y\nb\n#else\nc\n#endif\n#else\ne\n#endif") == "e"
    assert words("#define N 3\n#if defined(N) && N > 2 && !defined M\na\n#endif\n#ifndef N\nb\n#elifdef N\nc\n#endif") == "a c"
    assert words("#if (1 ? 2 : 0) == 2 && -7 / 2 == -3 && 0x10 == 020 && 'a' == 97 && (1 || 1 / 0) && ~0 == -1 && 5 % 3 << 1 == 4\nyes\n#endif") == "yes"
    unit = preprocessed({"m.c": "#if (\n#endif\n#endif\n#error no\n#if 1\n"})
    assert [m.split(":")[0] for _, m in unit.problems] == ["unreadable condition", "#endif without #if", "#error no", "unterminated conditional directive"]
    assert words("#if __has_include(\"a.h\") && !__has_include(\"b.h\")\nx\n#endif", a_h="") == "x"


def test_includes_in_order_and_places():
    files = {"m.c": '#include "a.h"\n#define T int\n#include "a.h"\n#include "b.h"\nT x;', "a.h": "#ifndef A\n#define A\n#define M(x) x y\n#endif\n", "b.h": "#pragma once\n#include \"b.h\"\nM(1) T z;"}
    unit = preprocessed(files)
    assert " ".join(t.text for t in unit.tokens) == "1 y int z ; int x ;"
    at = {t.text: unit.where(t.place) for t in unit.tokens}
    assert at["y"] == ("a.h", files["a.h"].index("y")) and at["1"] == ("b.h", files["b.h"].index("1")) and at["x"] == ("m.c", files["m.c"].index("x;"))
    assert {unit.where(t.place) for t in unit.tokens if t.text == "int"} == {("m.c", files["m.c"].index("int"))}  # a macro's body is where it is defined
    assert preprocessed({"m.c": '#include "m.c"\n'}).problems and preprocessed({"m.c": '#include <x>\n#include\n#include 3\n'}).problems


def named(own, **want):
    return [r for r in own.records.values() if all(r[k] == v for k, v in want.items())]


def test_faults_of_lone_files():
    """An indented directive, a word before a declaration, and calls of macros at file level."""
    assert {r["symbol"] for r in one("int a;\n  #define X 5\nint b;").records.values()} == {"a", "b", "X"}
    own = one("__init int q(void) { int l; return l; }\nSTATIC foo_t w(foo_t *p) { foo_t k = *p; return k; }\nfoo_t v, *u;")
    assert {(r["symbol"], r["kind"]) for r in named(own, record=S.SYMBOL)} == {("q", 7), ("l", 0), ("w", 7), ("p", 0), ("k", 0), ("v", 0), ("u", 0)}
    assert not named(one("LIST(a);\nDEFINE_FOO(bar)\nint z;"), kind=7) and named(one("LIST(a);\nint z;"), symbol="z")
    assert not named(one("#define LIST(x) int x\nLIST(a);"), kind=7) and named(one("#define LIST(x) int x\nLIST(a);"), symbol="a", kind=0)
    assert named(one("main() { return 0; }"), symbol="main", kind=7)


def test_ids_follow_linkage():
    a = one("static int s(void) { return 1; }\nint e(void) { static int k; return s() + k; }\nextern int v; static int w;", "d/a.c")
    b = one("static int s(void) { return 2; }\nint e(void);\nint t(void) { return e() + s(); } int v = 3;", "d/b.c")
    id_of = lambda own, name, **more: {r["usr_id"] for r in named(own, symbol=name, **more)}
    assert id_of(a, "e") == id_of(b, "e") == {extract.usr_number("c:@F@e")} and id_of(a, "v") == id_of(b, "v") == {extract.usr_number("c:@v")}
    assert len(id_of(a, "s")) == 1 and id_of(a, "s") != id_of(b, "s") and id_of(a, "w") == {extract.usr_number("c:a.c@w")}
    assert len(id_of(a, "k")) == 1 and id_of(a, "k") != {extract.usr_number("c:@k")}
    call = named(b, symbol="e", action=S.CALL, record=S.USE)[0]
    assert call["context_usr_id"] == extract.usr_number("c:@F@t") and all(r["context_usr_id"] is None for r in named(b, kind=0))
    # a later declaration has the linkage of the first, an inner name is another
    c = one("static int f(void);\nint f(void) { int v; v = 1; return v; }\nint v;", "c.c")
    assert id_of(c, "f") == {extract.usr_number("c:c.c@F@f")} and len(id_of(c, "v")) == 2


def test_types_and_signatures():
    own = one("typedef unsigned int u; struct s; typedef int (*cb)(struct s *, ...);\nconst u *f(cb c, long unsigned x[3], char *const *n, int (*g)(void), ...);\nu a[2][3]; struct { int q; } one; enum e { A } en; void z(void) {}\nvolatile unsigned char r; long long int ll; double long d; short unsigned sh; signed k;")
    got = {r["symbol"]: (r["declared_type"], r["canonical_type"], r["type_symbol"], r["type_kind"]) for r in own.types.values()}
    assert got["cb"] == ("int (*)(struct s *, ...)", "int (*)(struct s *, ...)", "", -1) and got["a"] == ("u[2][3]", "unsigned int[2][3]", "u", 6)
    assert got["f"][0] == "const u *(cb, unsigned long *, char *const *, int (*)(void), ...)" and got["f"][1].startswith("const unsigned int *(int (*)(struct s *, ...), unsigned long *")
    assert got["one"][:2] == ("struct :one", "struct :one") and got["en"] == ("enum e", "enum e", "e", 4) and got["z"][0] == "void (void)"
    assert [got[x][0] for x in ("r", "ll", "d", "sh", "k")] == ["volatile unsigned char", "long long", "long double", "unsigned short", "int"]
    rows_ = [(r["position"], r["name"], r["declared_type"], r["variadic"]) for r in own.signatures if r["symbol"] == "f"]
    assert rows_ == [(-1, "", "const u *", 1), (0, "c", "cb", 0), (1, "x", "unsigned long[3]", 0), (2, "n", "char *const *", 0), (3, "g", "int (*)(void)", 0)]


POINTERS = """typedef int (*op)(int);
struct ops { int id; op go; struct { op deep; } in; };
static int up(int x) { return x + 1; }
int down(int x) { return x - 1; }
op first = up;
struct ops table[] = { { 1, down, { up } }, { .go = &up } };
void use(int n, struct ops *o) {
    op a = n ? up : (op)down, b = a;
    b = first;
    o->go = *b;
    a = 0;
    a = pick(n);
    a(1); (*o->go)(2); table[0].in.deep(3); up(4); pick(5)(6);
}
"""


def test_pointer_constraints():
    own = one(POINTERS, "p.c")
    fn = {"up": "c:p.c@F@up", "down": "c:@F@down"}
    direct = sorted((p.rsplit("@", 1)[-1], {v: k for k, v in fn.items()}[t]) for how, p, t in own.points if how == "direct")
    assert direct == [("a", "down"), ("a", "up"), ("deep", "up"), ("first", "up"), ("go", "down"), ("go", "up")]
    copies = sorted((p.rsplit("@", 1)[-1], t.rsplit("@", 1)[-1]) for how, p, t in own.points if how == "copy")
    assert copies == [("b", "a"), ("b", "first"), ("go", "b")]
    assert own.counts == {"direct": 6, "copy": 3, "unsupported": 1, "indirect": 4, "identified": 3}


def _many_units(n):
    """Batches of n units with a header that all share and one of their own."""
    edge = pa.list_(pa.struct([("target", pa.string()), ("angled", pa.bool_()), ("found", pa.string())]))
    kinds = [("variant", pa.string()), ("unit", pa.string()), ("path", pa.string()), ("content", pa.string()), ("includes", edge), ("defines", pa.list_(pa.string()))]
    rows = []
    for k in range(n):
        unit, own = f"src/u{k:05}.c", f"inc/o{k:05}.h"
        includes = [dict(target=t, angled=False, found=f"inc/{t}") for t in ("all.h", f"o{k:05}.h")]
        texts = {"inc/all.h": "#define A 1\nint g(int);\n", own: f"int v{k};\n" * 20, unit: f'#include "all.h"\n#include "o{k:05}.h"\n' + f"int f{k}(void) {{ return g(A); }}\n" * 3}
        rows += [("general", unit, path, text, includes if path == unit else None, []) for path, text in texts.items()]
    for a in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows[a : a + 64]), kinds)], names=[c for c, _ in kinds])


def test_what_a_task_holds_does_not_grow_with_units(monkeypatch):
    monkeypatch.setattr(extract, "KEPT_TOKENS", 2_000)
    monkeypatch.setattr(extract, "KEPT_NAMES", 50)
    held, names, sizes, real = [], [], [], extract._unit_rows

    def rows(variant, unit, files, found, define, scope, partial, done, out):
        real(variant, unit, files, found, define, scope, partial, done, out)
        held.append(sum(sum(map(len, x[1])) for x in files.kept.values()))
        names.append(len(done))
        assert unit not in files.kept and ("general", unit) not in done

    monkeypatch.setattr(extract, "_unit_rows", rows)
    first = {}
    for batch in extract.read_batches(_many_units(300), "project", True):
        sizes.append(len(batch))
        for what, unit, path in zip(*(batch.column(c).to_pylist() for c in ("what", "unit", "path"))):
            if what == "files":
                first.setdefault(path, unit)
    assert max(held) <= 2_000 and max(names) <= 52 and min(sizes[:-1]) >= extract.GIVEN_ROWS
    assert first["inc/all.h"] == "src/u00000.c" and len(first) == 601
    assert all(first[f"inc/o{k:05}.h"] == first[f"src/u{k:05}.c"] == f"src/u{k:05}.c" for k in range(300))


def test_units_over_files(spark):
    text = {
        "src/a.c": '#include "h.h"\n#include <lib.h>\n#include "no.h"\nint a(void) { return M(h()); }\n',
        "src/b.c": '#include "../inc/h.h"\nint b(void) { return M(N) + a(); }\n',
        "src/empty.c": None,
        "src/c.S": "#include \"../inc/n.h\"\n.type f, @function\nf:\n call a\n",
        "inc/h.h": '#include "n.h"\n#ifdef EXTRA\nint extra;\n#endif\nint h(void);\n#define M(x) (x)\n',
        "inc/n.h": '#pragma once\n#include "h.h"\n#define N 1\n',
        "inc/lib.h": "int lib;\n",
    }
    sources = spark.createDataFrame([("v", p, t) for p, t in text.items()] + [("v", "src/empty.c", None), ("w", "src/b.c", "int other;")], "variant string, path string, content string").withColumn("unit", F.lit(7)).withColumn("candidate", F.lit("x"))
    units = sources.where("path LIKE 'src/%'").select("variant", "path")
    commands = spark.createDataFrame([("v", "src/a.c", ["cc", "-I", "inc/./x/..", "-DEXTRA", "-c", "src/a.c"], 1), ("v", "src/a.c", ["cc"], 2)], "variant string, file string, arguments array<string>, seq int")
    t = {k: v.cache() for k, v in extract.index(sources, units, commands).items()}
    status = {(r.variant, r.unit): r.status for r in t["status"].collect()}
    assert status == {("v", "src/a.c"): "partial", ("v", "src/b.c"): "clean", ("v", "src/empty.c"): "failed", ("v", "src/c.S"): "clean", ("w", "src/b.c"): "clean"}
    assert [(r.unit, r.line, r.col, r.message) for r in t["diagnostics"].collect()] == [("src/a.c", 3, 10, "'no.h' file not found")]
    found = {(r.path, r.symbol, r.record, r.action, r.kind, r.line) for r in t["records"].where("variant = 'v'").collect()}
    # headers come from the first unit, which defines EXTRA and finds lib.h
    assert {("inc/h.h", "extra", 0, 1, 0, 3), ("inc/lib.h", "lib", 0, 1, 0, 1), ("src/a.c", "inc/h.h", 1, 0, 9, 1), ("src/a.c", "<lib.h>", 1, 0, 9, 2), ("src/a.c", "no.h", 1, 0, 9, 3), ("src/b.c", "N", 1, 0, 8, 2), ("src/c.S", "f", 0, 1, 7, 3), ("src/c.S", "a", 1, 3, 7, 4)} <= found
    assert len([x for x in found if x[:2] == ("inc/h.h", "M")]) == 1 and not [x for x in found if x[0] == "src/empty.c"]
    edges = calls.call_edges(t["records"])
    callers = calls.callers(edges, "a", extract.usr_number("c:@F@a"), "v").collect()
    assert [(r.caller, r.caller_id, r.path) for r in callers] == [("b", extract.usr_number("c:@F@b"), "src/b.c")]
    bare = extract.index(sources, units, commands, scope="file", details=False)
    assert {r.path for r in bare["records"].select("path").collect()} == {"src/a.c", "src/b.c", "src/c.S"}
    assert all(r.usr_id is None for r in bare["records"].where("record = 1 AND action <> 3").collect()) and bare["records"].where("record = 1 AND action = 3 AND usr_id IS NOT NULL").count() > 0
    none = extract.index(sources.where("false"), units)
    assert none["records"].count() == 0 and none["status"].count() == 0
    assert extract.index(sources, units.where("false"))["records"].count() == 0


def test_update_from_sources_to_a_version(spark, tmp_path):
    def frame(**text):
        return spark.createDataFrame([("v", p.replace("_c", ".c").replace("_h", ".h"), t, 1) for p, t in text.items()], "variant string, path string, content string, mtime_ns long")

    sources = frame(a_c='#include "h.h"\nint a(void) { return 1; }\n', b_c='#include "h.h"\n#include "gone.h"\nint b(void) { return a(); }\n#ifdef D\nint d;\n#endif\n', h_h="int a(void);\nint shared;\n", e_c="\n")
    units = spark.createDataFrame([("v", "a.c"), ("v", "b.c"), ("v", "e.c"), ("v", "no.c")], "variant string, path string")
    commands = spark.createDataFrame([("v", "b.c", "/d", ["cc", "-DD"], 0), ("v", "b.c", "/d", ["cc"], 1)], "variant string, file string, directory string, arguments array<string>, seq int")
    variants = spark.createDataFrame([("v", None, "/root")], S.VARIANTS)
    store = IndexStore(spark, str(tmp_path / "index"))
    state = lambda u: {(r.unit, r.status, r.stage, r.stored) for r in u.units.collect()}
    failed = {("e.c", "failed", "frontend", False), ("no.c", "failed", "frontend", False)}
    # partial units come back, and leave the index alone
    first = update.update(store, sources, units, commands, update.RETURN, variants)
    assert state(first) == {("a.c", "clean", None, True), ("b.c", "partial", None, False)} | failed
    assert {r.path for r in store.table("files").collect()} == {"a.c", "h.h"} and store.table("commands").count() == 0
    assert {r.symbol for r in first.partial["records"].where("path = 'b.c' AND record = 0").collect()} == {"b", "d"}
    assert first.counters["records"] == store.table("records").count() and first.counters["records_in"] == first.counters["records"]
    # partial units are stored, the shared header keeps its rows, and nothing comes twice
    n = store.version()
    second = update.update(store, sources, units, commands)
    assert state(second) == {("a.c", "clean", None, True), ("b.c", "partial", None, True)} | failed and second.version == n + 1
    files = {r.path: (r.mtime_ns, r["size"]) for r in store.table("files").collect()}
    assert files["h.h"] == (1, 25) and set(files) == {"a.c", "b.c", "h.h"} and store.table("commands").first().arguments == ["cc", "-DD"]
    assert store.table("records").where("symbol = 'shared'").count() == 1 and store.table("variants").first().repository_root == "/root"
    id_ = extract.usr_number("c:@F@a")
    assert [r.caller for r in calls.callers(calls.call_edges(store.tables()["records"]), "a", id_).collect()] == ["b"]
    assert store.table("file_fingerprints").count() >= 3 and store.table("function_types").where("symbol = 'a'").count() >= 1
    # a changed file again, by its saved command
    sources = frame(b_c='#ifdef D\nint dd;\n#endif\n', h_h="")
    third = update.reindex(store, sources, "v", "b.c")
    assert state(third) == {("b.c", "clean", None, True)} and [r.symbol for r in store.table("records").where("path = 'b.c' AND kind = 0").collect()] == ["dd"]
    assert store.table("records").where("path = 'a.c'").count() > 0
    # only output, and nothing that could be kept
    n = store.version()
    assert update.update(store, sources, units, output_only=True).version is None and update.update(store, sources.where("false"), units).version is None and store.version() == n
    # a writer that always loses
    class Loser(IndexStore):
        def _commit(self, *_):
            raise OSError("another writer")

    lost = update.update(Loser(spark, str(tmp_path / "index")), sources, units.where("path = 'b.c'"))
    assert state(lost) == {("b.c", "clean", "symbol_database", False)}
    with pytest.raises(ValueError):
        update.update(store, sources, units, policy="else")
    local = update.update(IndexStore(spark, str(tmp_path / "other")), frame(a_c="int f(int x) { return x; }"), units.where("path = 'a.c'"), include_local=False)
    assert local.counters["records"] == 1


def test_normal_paths(spark):
    cases = {"a/./b//c": "a/b/c", "../x": "../x", "a/../../b": "../b", "/a/../b": "/b", "a/b/..": "a", "": "", "./a": "a"}
    df = spark.createDataFrame(list(cases.items()), "path string, want string")
    assert all(r.got == r.want for r in df.select("want", includes.normal(F.col("path")).alias("got")).collect())


@pytest.mark.parametrize("name", sorted(unit_queries.QUERIES))
def test_unit_query_equals_oracle(spark, duck, name):  # noqa: F811
    df = unit_queries.QUERIES[name](spark, DATA)
    want = duck.execute(unit_queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())
