"""Driver queries of the code-index operators, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.functions import scalars as fn
from codequarry.operators import calls, merge, search
from codequarry.plans.views import frame, with_views
from codequarry.sources import documents
from codequarry.sources import text as source
from codequarry.sources import trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SYM = "Brand_8.red_plate"
COLS = ", ".join(S.RECORD_COLUMNS)
ORDER = ", ".join(S.RECORD_ORDER)
SQL_MODE = (
    "concat("
    + ", ".join(f"CASE WHEN mode & {r} <> 0 AND mode & {w} <> 0 THEN 'm' WHEN mode & {r} <> 0 THEN 'r' WHEN mode & {w} <> 0 THEN 'w' ELSE '-' END" for r, w in ((1, 2), (4, 8), (16, 32)))
    + ")"
)
LEAF = "list_last(string_split(symbol, '.'))"
CALL = "record = 1 AND action = 3 AND kind = 7"


def add(name: str, views: str, oracle: str | None, plan: Callable[..., DataFrame]) -> None:
    """``plan`` gets the named views as DataFrames."""
    names = views.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(*(frame(spark, sf_dir, n) for n in names))

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = with_views(names, oracle)


def _walked(edges: DataFrame, direction: str) -> DataFrame:
    """The first 200 edges within two calls of a function, one job a level."""
    found = calls.walk_levels(calls.frontier_fetch(edges, direction, 201), ("general", "fn_0", 1), 2, 200, 200).edges
    kind = "variant string, caller string, callee string, path string, line long, col long, depth int"
    return edges.sparkSession.createDataFrame([tuple(e[c.split()[0]] for c in kind.split(", ")) for e in found], kind)


def records(name: str, where: str, tail: str = "", **options) -> None:
    add(name, "v_rec", f"SELECT {COLS} FROM v_rec WHERE {where} {tail}", lambda r: search.query(r, **options))


# -- record queries --------------------------------------------------------------------------
CURSOR = {"variant": "general", "path": "src/d20/f3", "line": 5, "col": 3, "symbol": "Brand_2", "record": 0, "action": 1, "kind": 2, "mode": 0}
CURSOR_SQL = "('general', 'src/d20/f3', 5, 3, 'Brand_2', 0, 1, 2, 0)"
records("search_exact", f"symbol = '{SYM}'", symbol=SYM)
records("search_all", "true", symbol="*", ordered=True)
records("search_glob_symbol", "regexp_full_match(symbol, 'Brand_[1-3]\\..*e.*')", symbol="Brand_[1-3].*e*")
records("search_glob_path", "path GLOB 'src/d1?/*'", path="src/d1?/*")
records("search_glob_variant", "variant GLOB 'arm*'", variant="arm*")
records("filter_context", "context = 'fn_7'", context="fn_7")
records("filter_definitions", "record = 0 AND action <> 0", record="definition")
records("filter_declarations", "record = 0 AND action = 0", record="declaration")
records("filter_references", "record = 1", record="reference")
records("filter_mode_any", "record = 1 AND mode & 9 <> 0", mode=9)
add("filter_mode_none", "v_rec", f"SELECT {COLS} FROM (SELECT * REPLACE (mode & 3 AS mode) FROM v_rec) WHERE record = 1 AND mode = 0", lambda r: search.query(r.withColumn("mode", F.col("mode").bitwiseAND(F.lit(3))), mode=0))
records("filter_kind", "kind = 3", kind=3)
records("filter_usr", "usr_id = 42", usr_id=42)
records("filter_local", "local = 1", local=1)
records("page_after_cursor", f"({ORDER}) > {CURSOR_SQL}", f"ORDER BY {ORDER} LIMIT 50", cursor=CURSOR, limit=50)
records("topk_records", "kind = 7", f"ORDER BY {ORDER} LIMIT 20", kind=7, limit=20)
add(
    "page_lookahead",
    "v_rec",
    f"SELECT {COLS}, CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS rank, CASE WHEN row_number() OVER (ORDER BY {ORDER}) > 10 THEN 1 ELSE 0 END AS look_ahead FROM (SELECT * FROM v_rec WHERE kind = 7 ORDER BY {ORDER} LIMIT 11)",
    lambda r: search.page(r, 10, kind=7),
)
IDENTITY = "variant = 'general' AND symbol = (SELECT min(symbol) FROM v_rec WHERE usr_id = 42) AND usr_id = 42"


def _identity(record: str) -> Callable[[DataFrame], DataFrame]:
    def plan(r: DataFrame) -> DataFrame:
        name = r.where("usr_id = 42").agg(F.min("symbol")).first()[0]
        return search.identity(r, "general", name, 42, record=record) if name else r.limit(0).select(*S.RECORD_COLUMNS)

    return plan


add("identity_definitions", "v_rec", f"SELECT {COLS} FROM v_rec WHERE {IDENTITY} AND record = 0 AND action <> 0", _identity("definition"))
add("identity_references", "v_rec", f"SELECT {COLS} FROM v_rec WHERE {IDENTITY} AND record = 1", _identity("reference"))
add(
    "position_lookup",
    "v_rec",
    f"SELECT {COLS} FROM v_rec WHERE line = 100 AND col <= 30 AND 30 BETWEEN col AND col + strlen({LEAF}) - 1",
    lambda r: search.at_position(r, None, 100, 30).select(*S.RECORD_COLUMNS),
)
add(
    "position_lookup_batch",
    "v_rec",
    "SELECT v.variant, v.path, v.line, p.at, v.symbol, v.record, v.action, v.kind, v.mode, v.col FROM v_rec v JOIN (SELECT DISTINCT variant, path, line, col + 2 AS at FROM v_rec) p ON v.variant = p.variant AND v.path = p.path AND v.line = p.line WHERE p.at BETWEEN v.col AND v.col + strlen(list_last(string_split(v.symbol, '.'))) - 1",
    lambda r: search.at_positions(r, r.select("variant", "path", "line", (F.col("col") + 2).alias("at")).repartition("variant", "path", "line").distinct()).select("variant", "path", "line", "at", "symbol", "record", "action", "kind", "mode", "col"),
)
add(
    "position_dedup_identity",
    "v_rec",
    f"""SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY variant, symbol, kind, coalesce(usr_id, 0),
        CASE WHEN coalesce(usr_id, 0) = 0 THEN path END, CASE WHEN coalesce(usr_id, 0) = 0 THEN context END, CASE WHEN coalesce(usr_id, 0) = 0 THEN local END
        ORDER BY col DESC, record, {ORDER}) AS n FROM v_rec) WHERE n = 1""",
    lambda r: search.first_by(r, search.identity_key(), [F.desc("col"), F.col("record"), *(F.col(c) for c in S.RECORD_ORDER)]).select(*S.RECORD_COLUMNS),
)
add(
    "lsp_references",
    "v_rec",
    f"SELECT {COLS} FROM (SELECT {COLS} FROM v_rec WHERE path NOT IN (SELECT path FROM v_rec WHERE path LIKE 'src/d3/%' AND line < 200) UNION ALL SELECT variant, path, line + 1, col, record, action, kind, symbol, context, mode, usr_id, context_usr_id, local FROM v_rec WHERE path LIKE 'src/d3/%' AND line < 200) WHERE symbol LIKE 'Brand_1.%' AND kind = 5 AND local = 0 AND record = 1",
    lambda r: _overlaid(r).where("symbol LIKE 'Brand_1.%' AND kind = 5 AND local = 0").where(search.record_filter("reference")),
)


def _overlaid(r: DataFrame) -> DataFrame:
    """Files of one folder are open in an editor: the first half of each, moved by a line."""
    shown = r.where("path LIKE 'src/d3/%' AND line < 200").withColumn("line", F.col("line") + 1)
    return search.overlaid(r, shown)


SERVED = "path LIKE 'src/d2%' AND line = 100 AND 30 BETWEEN col AND col + strlen(list_last(string_split(symbol, '.'))) - 1"
add(
    "position_service",
    "v_rec",
    f"""SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY variant, symbol, kind, coalesce(usr_id, 0),
        CASE WHEN coalesce(usr_id, 0) = 0 THEN path END, CASE WHEN coalesce(usr_id, 0) = 0 THEN context END, CASE WHEN coalesce(usr_id, 0) = 0 THEN local END
        ORDER BY col DESC, record, {ORDER}) AS n FROM v_rec WHERE {SERVED} AND strlen(path) = (SELECT min(strlen(path)) FROM v_rec WHERE {SERVED})) WHERE n = 1""",
    lambda r: search.position_service(r, r.where("path LIKE 'src/d2%'").select("path", F.length("path").alias("prio")).distinct(), 100, 30).select(*S.RECORD_COLUMNS),
)
RELATED = "(SELECT symbol, kind FROM v_rec WHERE local = 0 AND record = 1 GROUP BY symbol, kind ORDER BY count(*) DESC, symbol, kind LIMIT 1)"
add("related_references", "v_rec", f"SELECT {COLS} FROM v_rec WHERE (symbol, kind) IN {RELATED} AND local = 0 AND record = 1", lambda r: _related(r))


def _related(r: DataFrame) -> DataFrame:
    """References of the thing with most of them."""
    most = r.where("local = 0 AND record = 1").groupBy("symbol", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol", "kind").first()
    return search.related(r, most.symbol, most.kind, 0, record="reference").select(*S.RECORD_COLUMNS) if most else r.limit(0).select(*S.RECORD_COLUMNS)


add(
    "definition_or_declaration",
    "v_rec",
    f"SELECT {COLS} FROM (SELECT *, CASE WHEN action = 0 THEN 1 ELSE 0 END AS tier, min(CASE WHEN action = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY variant, symbol, kind) AS best FROM v_rec WHERE record = 0) WHERE tier = best",
    lambda r: search.definition_or_declaration(r, ["variant", "symbol", "kind"]).select(*S.RECORD_COLUMNS),
)
add("distinct_locations", "v_rec", "SELECT DISTINCT path, line, col FROM v_rec", lambda r: search.distinct_locations(r).select("path", "line", "col"))
add(
    "document_highlights",
    "v_rec",
    "SELECT path, line, col, CAST(max(CASE WHEN record = 1 AND mode & 42 <> 0 THEN 3 WHEN record = 1 AND mode & 21 <> 0 THEN 2 ELSE 1 END) AS INTEGER) AS highlight FROM v_rec GROUP BY path, line, col",
    search.highlights,
)
add("list_variants", "v_variants", "SELECT name, git_commit, repository_root FROM v_variants", search.list_variants)
add("find_file", "v_files", "SELECT variant, path, mtime_ns, size FROM v_files WHERE variant = 'general' AND path LIKE 'src/d7/f1%'", lambda f: search.find_files(f, "src/d7/f1*", "general").select("variant", "path", "mtime_ns", "size"))
add(
    "symbol_types_page",
    "v_symbol_types",
    "SELECT * FROM v_symbol_types WHERE variant = 'general' AND usr_id BETWEEN 10 AND 60 AND (path, declared_type) > ('src/d2', 'struct E') ORDER BY path, declared_type, canonical_type, type_symbol, type_kind, type_usr_id, symbol, kind, usr_id LIMIT 40",
    lambda t: search.symbol_types(t.where("usr_id BETWEEN 10 AND 60"), "general", cursor={"path": "src/d2", "declared_type": "struct E"}, limit=40),
)
add(
    "function_signature",
    "v_function_types",
    "SELECT * FROM v_function_types WHERE symbol LIKE 'fn_77%' AND variant = 'general'",
    lambda t: search.function_types(t.where("symbol LIKE 'fn_77%'"), "general"),
)
SIGNATURE = "variant, path, symbol, usr_id"
add(
    "signature_flatten",
    "v_function_types",
    f"""SELECT {SIGNATURE}, CAST(CASE WHEN position = -1 THEN -1 ELSE row_number() OVER (PARTITION BY {SIGNATURE}, position = -1 ORDER BY position) - 1 END AS INTEGER) AS position, name, declared_type, "variadic"
        FROM (SELECT *, row_number() OVER (PARTITION BY {SIGNATURE}, position ORDER BY name, declared_type) AS n FROM v_function_types) WHERE n = 1""",
    lambda t: merge.flatten_signatures(_signatures(t)),
)


def _signatures(t: DataFrame) -> DataFrame:
    """Signatures with parameters as arrays."""
    key = SIGNATURE.split(", ")
    one = merge.keep_first(t, [*key, "position"], ["name", "declared_type"])
    own = lambda c: F.max(F.when(F.col("position") == -1, F.col(c))).alias("returns" if c == "declared_type" else c)
    each = F.sort_array(F.collect_list(F.when(F.col("position") >= 0, F.struct("position", "name", "declared_type"))))
    return one.groupBy(*key).agg(own("declared_type"), own("variadic"), F.transform(each, lambda p: F.struct(p["name"].alias("name"), p["declared_type"].alias("declared_type"))).alias("parameters"))


# -- calls -----------------------------------------------------------------------------------
EDGE = "variant, caller, caller_id, callee, callee_id, path, line, col"
add("callers", "v_calls", f"SELECT {EDGE} FROM v_calls WHERE callee = 'fn_33' AND callee_id = 34", lambda e: calls.callers(e, "fn_33", 34))
add("callees", "v_calls", f"SELECT {EDGE} FROM v_calls WHERE caller = 'fn_33' AND caller_id = 34 AND variant = 'general'", lambda e: calls.callees(e, "fn_33", 34, "general"))
SQL_EDGES = f"SELECT variant, context AS caller, context_usr_id AS caller_id, symbol AS callee, usr_id AS callee_id, path, line, col FROM v_rec WHERE {CALL}"
add("call_edges", "v_rec", SQL_EDGES, calls.call_edges)
LINE = "concat(caller, ' -> ', callee, chr(9), variant, ':', path, ':', CAST(line AS VARCHAR), ':', CAST(col AS VARCHAR)) AS text, lower(lpad(printf('%x', coalesce(callee_id, 0)), 16, '0')) AS id"


def _cli(direction: str, name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda r: calls.by_name(calls.call_edges(r), name, direction).select(calls.edge_line().alias("text"), fn.id_hex(F.col("callee_id")).alias("id"))


add("callgraph_cli_callees", "v_rec", f"SELECT {LINE} FROM ({SQL_EDGES}) WHERE caller = 'fn_7'", _cli("callees", "fn_7"))
add("callgraph_cli_callers", "v_rec", f"SELECT {LINE} FROM ({SQL_EDGES}) WHERE callee LIKE 'Brand_1%'", _cli("callers", "Brand_1*"))
add(
    "resolve_functions",
    "v_rec",
    f"SELECT {COLS} FROM v_rec JOIN (SELECT DISTINCT variant, symbol, usr_id FROM v_rec WHERE kind = 7) USING (variant, symbol, usr_id) WHERE record = 0 AND kind = 7",
    lambda r: calls.resolve_functions(r, r.where("kind = 7").select("variant", "symbol", "usr_id").distinct()).select(*S.RECORD_COLUMNS),
)
add(
    "prefer_definition",
    "v_rec",
    f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY variant, symbol, coalesce(usr_id, 0) ORDER BY action DESC, path, line, col, mode) AS n FROM v_rec WHERE record = 0 AND kind = 7) WHERE n = 1",
    lambda r: calls.prefer_definition(r).select(*S.RECORD_COLUMNS),
)
for way, end in (("incoming", "caller"), ("outgoing", "callee")):
    add(
        f"call_hierarchy_{way}",
        "v_calls",
        f"SELECT variant, {end} AS name, {end}_id AS id, count(*) AS n, string_agg(concat(path, ':', CAST(line AS VARCHAR), ':', CAST(col AS VARCHAR)), ',' ORDER BY path, line, col) AS ranges FROM v_calls GROUP BY ALL",
        lambda e, way=way: calls.hierarchy(e, way).withColumn("ranges", F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["path"], r["line"].cast("string"), r["col"].cast("string"))), ",")),
    )
for way, near, far in (("callees", "caller", "callee"), ("callers", "callee", "caller")):
    add(
        f"bfs_{way}",
        "v_calls",
        f"SELECT variant, name, id, CAST(min(depth) AS INTEGER) AS depth FROM (WITH RECURSIVE b(variant, name, id, depth) AS (SELECT 'general', 'fn_0', CAST(1 AS BIGINT), 0 UNION SELECT c.variant, c.{far}, c.{far}_id, depth + 1 FROM b JOIN v_calls c ON c.variant = b.variant AND c.{near} = b.name AND c.{near}_id = b.id WHERE depth < 3) SELECT * FROM b) GROUP BY variant, name, id",
        lambda e, way=way: calls.reachable(e, e.sparkSession.createDataFrame([("general", "fn_0", 1)], "variant string, name string, id long"), 3, way),
    )
for way, near, far in (("callees", "caller", "callee"), ("callers", "callee", "caller")):
    add(
        f"walk_{way}",
        "v_calls",
        f"""SELECT variant, caller, callee, path, line, col, depth FROM (
            SELECT e.*, t.depth + 1 AS depth, row_number() OVER (ORDER BY t.depth, t.turn, e.{far}, e.path, e.line, e.col) AS n FROM (
              SELECT 'general' AS variant, 'fn_0' AS name, CAST(1 AS BIGINT) AS id, 0 AS depth, 0 AS turn
              UNION ALL SELECT variant, {far}, {far}_id, 1, CAST(min(n) AS INTEGER) FROM (SELECT *, row_number() OVER (ORDER BY {far}, path, line, col) AS n FROM v_calls WHERE variant = 'general' AND {near} = 'fn_0' AND {near}_id = 1) WHERE {far} <> 'fn_0' GROUP BY ALL) t
            JOIN v_calls e ON e.variant = t.variant AND e.{near} = t.name AND e.{near}_id = t.id) WHERE n <= 200""",
        lambda e, way=way: _walked(e, way),
    )
#: Every edge is a constraint, a twentieth of them direct ones and all others copies, so that copies run in cycles.
add(
    "points_to_closure",
    "v_calls",
    "SELECT DISTINCT pointer, target FROM (WITH RECURSIVE c AS (SELECT DISTINCT caller_id AS pointer, callee_id AS source FROM v_calls WHERE line % 20 <> 0), p(pointer, target) AS (SELECT DISTINCT caller_id, concat('f', CAST(callee_id AS VARCHAR)) FROM v_calls WHERE line % 20 = 0 UNION SELECT c.pointer, p.target FROM p JOIN c ON c.source = p.pointer) SELECT * FROM p)",
    lambda e: calls.points_to(e.where("line % 20 = 0").select(F.col("caller_id").alias("pointer"), F.concat(F.lit("f"), F.col("callee_id")).alias("target")).distinct(), e.where("line % 20 <> 0").select(F.col("caller_id").alias("pointer"), F.col("callee_id").alias("source")).distinct()),
)

# -- merging ---------------------------------------------------------------------------------
RAW_KEY = "symbol, record, action, kind, mode, file_id, line, col"
RAW_ORDER = "batch, context, coalesce(usr_id, 0), coalesce(context_usr_id, 0), local"
add(
    "dedup_insert_or_ignore",
    "v_dup",
    f"SELECT {RAW_KEY}, context, usr_id, context_usr_id, local FROM (SELECT *, row_number() OVER (PARTITION BY {RAW_KEY} ORDER BY {RAW_ORDER}) AS n FROM v_dup) WHERE n = 1",
    lambda d: merge.keep_first(d, RAW_KEY.split(", "), ["batch", "context", F.coalesce("usr_id", F.lit(0)), F.coalesce("context_usr_id", F.lit(0)), "local"]).drop("batch"),
)
SAME = "b.variant = s.variant AND b.path = s.path"
add("cache_hit_semi", "v_staged_files v_base_files", f"SELECT * FROM v_staged_files s WHERE is_main = 0 AND mtime_ns <> 0 AND EXISTS (SELECT 1 FROM v_base_files b WHERE {SAME} AND b.mtime_ns = s.mtime_ns AND b.size = s.size)", merge.cache_hits)
add("cache_stale_anti", "v_staged_files v_base_files", f"SELECT * FROM v_staged_files s WHERE is_main = 0 AND NOT EXISTS (SELECT 1 FROM v_base_files b WHERE {SAME} AND b.mtime_ns = s.mtime_ns AND b.size = s.size)", merge.stale)
add("merge_files_insert", "v_base_files v_staged_files", f"SELECT * FROM v_staged_files s WHERE NOT EXISTS (SELECT 1 FROM v_base_files b WHERE {SAME})", merge.inserted_files)
REPLACED = f"SELECT b.* FROM v_base_files b JOIN v_staged_files s ON {SAME} WHERE s.is_main = 1 OR s.mtime_ns <> b.mtime_ns OR s.size <> b.size"
add("replace_changed_files", "v_base_files v_staged_files", REPLACED, merge.replaced_files)
add("upsert_file_metadata", "v_base_files v_staged_files", "SELECT coalesce(b.variant, s.variant) AS variant, coalesce(b.path, s.path) AS path, coalesce(s.mtime_ns, b.mtime_ns) AS mtime_ns, coalesce(s.size, b.size) AS size FROM v_base_files b FULL JOIN v_staged_files s ON " + SAME, merge.upserted_files)
add(
    "merge_records",
    "v_base v_staged v_base_files v_staged_files",
    f""", gone AS MATERIALIZED (SELECT x.variant, x.path FROM ({REPLACED}) x),
    kept AS MATERIALIZED (SELECT {COLS} FROM v_base ANTI JOIN gone USING (variant, path))
    SELECT {COLS} FROM kept UNION ALL SELECT {COLS} FROM v_staged ANTI JOIN kept USING ({', '.join(S.KEYS["records"])})""",
    lambda b, s, bf, sf: merge.merged_rows(b.select(*S.RECORD_COLUMNS), s, merge.replaced_files(bf, sf), S.KEYS["records"], ["context", "usr_id", "context_usr_id", "local"]),
)
add("variant_upsert", "v_variants v_new_variants", "SELECT coalesce(o.name, n.name) AS name, coalesce(n.git_commit, o.git_commit) AS git_commit, coalesce(n.repository_root, o.repository_root) AS repository_root FROM v_variants o FULL JOIN v_new_variants n ON o.name = n.name", merge.upserted_variants)
add("variant_changes", "v_variants v_new_variants", "SELECT n.name FROM v_new_variants n LEFT JOIN v_variants o ON o.name = n.name WHERE (n.git_commit IS NOT NULL AND n.git_commit IS DISTINCT FROM o.git_commit) OR (n.repository_root IS NOT NULL AND n.repository_root IS DISTINCT FROM o.repository_root)", merge.variant_changes)
add(
    "command_resolution",
    "v_commands",
    """SELECT a.variant, a.file, CASE WHEN length(a.file) % 3 = 0 THEN a.arguments WHEN length(a.file) % 3 = 1 THEN 'cc|-O2|' || a.file ELSE concat('cc|--no-default-config|-I|', regexp_replace(a.file, '/[^/]*$', ''), '|', a.file) END AS arguments,
       CASE WHEN length(a.file) % 3 = 0 THEN 'saved' WHEN length(a.file) % 3 = 1 THEN 'compile_commands' ELSE 'fallback' END AS origin FROM v_commands a""",
    lambda c: merge.resolve_command(c.where("length(file) % 3 = 0"), c.where("length(file) % 3 = 1").select("file", F.lit(0).alias("seq"), F.concat(F.lit("cc|-O2|"), "file").alias("arguments")), c.select("variant", "file")),
)
add(
    "index_drift_status",
    "v_base_files v_staged_files",
    """SELECT a.variant, a.path, CASE WHEN b.path IS NULL THEN 'NotIndexed' WHEN s.path IS NULL THEN 'Missing' WHEN b.mtime_ns <> s.mtime_ns OR b.size <> s.size THEN 'Drifted' ELSE 'Current' END AS status
       FROM (SELECT variant, path FROM v_base_files UNION SELECT variant, path FROM v_staged_files) a LEFT JOIN v_base_files b USING (variant, path) LEFT JOIN v_staged_files s ON s.path = a.path""",
    lambda b, s: merge.drift(b, s, b.select("variant", "path").union(s.select("variant", "path")).distinct()),
)
FIELDS = [c for c in S.RECORD_COLUMNS if c not in ("variant", "path")]
TEXT = " || '|' || ".join(f"concat(CAST(strlen(coalesce(CAST({c} AS VARCHAR), '~')) AS VARCHAR), ':', coalesce(CAST({c} AS VARCHAR), '~'))" for c in FIELDS)
SEQ = f"row_number() OVER (PARTITION BY variant, path ORDER BY {ORDER})"
add(
    "file_fingerprint",
    "v_rec",
    f"SELECT variant, path, sha256(string_agg(d, ',' ORDER BY seq)) AS all_records, sha256(coalesce(string_agg(d, ',' ORDER BY seq) FILTER (WHERE local = 0), '')) AS non_local FROM (SELECT variant, path, local, {SEQ} AS seq, sha256({TEXT}) AS d FROM v_rec) GROUP BY variant, path",
    merge.file_fingerprints,
)

# -- traces ----------------------------------------------------------------------------------
add("trace_phase_stats", "v_trace", "SELECT phase, count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS total_ns, max(duration_ns) AS max_ns, count(items_in) AS counted, CAST(coalesce(sum(items_in), 0) AS BIGINT) AS items_in, CAST(coalesce(sum(items_out), 0) AS BIGINT) AS items_out FROM v_trace GROUP BY phase", trace.phase_stats)
add("trace_distincts", "v_trace", "SELECT count(DISTINCT pid) AS processes, count(DISTINCT (command, source)) AS units FROM v_trace", trace.distincts)
add("trace_span", "v_trace", "SELECT min(start_ns) AS start_ns, max(start_ns + duration_ns) AS end_ns FROM v_trace", trace.span)
add("trace_share", "v_trace", "SELECT phase, CAST(sum(duration_ns) AS BIGINT) AS total_ns, CAST(coalesce(CAST(sum(duration_ns) AS BIGINT) * 100000 // nullif((SELECT CAST(sum(duration_ns) AS BIGINT) FROM v_trace WHERE phase = 'total'), 0), 0) AS BIGINT) AS share FROM v_trace GROUP BY phase", trace.shares)
add(
    "trace_by_total",
    "v_trace",
    "SELECT phase, count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS total_ns, max(duration_ns) AS max_ns, count(items_in) AS counted, CAST(coalesce(sum(items_in), 0) AS BIGINT) AS items_in, CAST(coalesce(sum(items_out), 0) AS BIGINT) AS items_out FROM v_trace GROUP BY phase ORDER BY total_ns DESC",
    trace.phases_by_total,
)
FLOW = "CAST(coalesce(sum({c}) FILTER (WHERE phase = '{p}'), 0) AS BIGINT)".format
STAGE, INSERT = "db.stage_records", "db.merge.records_insert"
add(
    "trace_record_flow",
    "v_trace",
    f"SELECT staged_in, staged, inserted, lock_ns, greatest(0, staged_in - staged - inserted) AS late_matches FROM (SELECT {FLOW(c='items_in', p=STAGE)} AS staged_in, {FLOW(c='items_out', p=STAGE)} AS staged, {FLOW(c='items_out', p=INSERT)} AS inserted, {FLOW(c='duration_ns', p='db.merge.begin')} AS lock_ns FROM v_trace)",
    trace.record_flow,
)
add("trace_slowest_topk", "v_trace", "SELECT duration_ns, pid, command, source, start_ns FROM v_trace WHERE phase = 'total' ORDER BY duration_ns DESC, pid DESC, command DESC, source DESC, start_ns DESC LIMIT 20", trace.slowest)
add("benchmark_median", "v_trace", "SELECT phase, count(*) AS n, CAST(quantile_cont(CAST(duration_ns AS DOUBLE), 0.5) AS DOUBLE) AS median_ns FROM v_trace GROUP BY phase", trace.medians)

# -- sources and output ----------------------------------------------------------------------
LINES = "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS raw FROM v_lines WHERE text IS NOT NULL"
CLEAN = f"SELECT doc_id, line, regexp_replace(raw, '\\r$', '') AS text FROM ({LINES})"
add("source_lines", "v_lines", CLEAN, lambda d: source.lines(d))
add(
    "source_range_budget",
    "v_lines",
    f"SELECT doc_id, line, text FROM (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS used FROM ({CLEAN}) WHERE line BETWEEN 2 AND 21) WHERE used <= 200",
    lambda d: source.line_range(source.lines(d), 2, 21, 200),
)
add(
    "search_format",
    "v_rec",
    f"SELECT concat('(', CASE WHEN record = 1 THEN {SQL_MODE} WHEN action = 1 THEN 'def' ELSE 'decl' END, ') ', variant, ':', path, chr(9), CAST(line AS VARCHAR), chr(9), CAST(col AS VARCHAR), chr(9), context, chr(9), symbol) AS text FROM v_rec WHERE symbol = '{SYM}'",
    lambda r: search.query(r, symbol=SYM).select(fn.format_search(r"(%m) %F\t%l\t%c\t%C\t%n").alias("text")),
)
add(
    "dissect_lag_dedup",
    "v_rec",
    f"""SELECT variant, path, seq, CASE WHEN prev_path IS NULL OR prev_path <> path THEN 1 ELSE 0 END AS header, symbol, record, line, col FROM (SELECT *, lag(path) OVER (PARTITION BY variant ORDER BY seq) AS prev_path, lag(concat(path, ':', CAST(line AS VARCHAR), ':', CAST(col AS VARCHAR), ':', symbol, ':', CAST(record AS VARCHAR))) OVER (PARTITION BY variant ORDER BY seq) AS prev,
        concat(path, ':', CAST(line AS VARCHAR), ':', CAST(col AS VARCHAR), ':', symbol, ':', CAST(record AS VARCHAR)) AS own FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY {ORDER}) AS seq FROM v_rec)) WHERE record = 0 OR prev IS NULL OR prev <> own""",
    lambda r: source.dissect(r).select("variant", "path", "seq", "header", "symbol", "record", "line", "col"),
)
add(
    "dissect_text",
    "v_rec",
    f"""SELECT variant, path, line, col, concat(CASE WHEN prev_path IS NULL OR prev_path <> path THEN concat(chr(10), 'FILE: ', path, chr(10), chr(10)) ELSE '' END,
        lpad(CAST(line AS VARCHAR), CAST(greatest(4, length(CAST(line AS VARCHAR))) AS INTEGER), ' '), ':', rpad(CAST(col AS VARCHAR), CAST(greatest(3, length(CAST(col AS VARCHAR))) AS INTEGER), ' '), ' ', rpad(context, CAST(greatest(16, length(context)) AS INTEGER), ' '), ' ',
        CASE WHEN record = 1 THEN {SQL_MODE} WHEN action = 1 THEN 'def' ELSE 'decl' END, ' ', CASE WHEN local = 1 THEN '.' ELSE ' ' END, ' ', (['v', 'm', 's', 's', 'E', 'e', 't', 'f', 'd', 'i'])[kind + 1], ' ', symbol) AS text
        FROM (SELECT *, lag(path) OVER o AS prev_path, lag(concat(path, ':', CAST(line AS VARCHAR), ':', CAST(col AS VARCHAR), ':', symbol, ':', CAST(record AS VARCHAR))) OVER o AS prev,
        concat(path, ':', CAST(line AS VARCHAR), ':', CAST(col AS VARCHAR), ':', symbol, ':', CAST(record AS VARCHAR)) AS own FROM v_rec WINDOW o AS (PARTITION BY variant ORDER BY {ORDER})) WHERE record = 0 OR prev IS NULL OR prev <> own""",
    lambda r: source.listing(source.dissect(r)).select("variant", "path", "line", "col", "text"),
)
add("mode_string", "v_rec", f"SELECT DISTINCT mode, {SQL_MODE} AS text FROM v_rec", lambda r: r.select("mode").distinct().select("mode", fn.mode_string(F.col("mode")).alias("text")))
NAMES = "CASE kind " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(S.KIND_NAMES)) + " END"
CHARS = "CASE kind " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(S.KIND_CHARS)) + " END"
add("qualified_name", "v_rec", "SELECT DISTINCT context, symbol, CASE WHEN context <> '' THEN concat(context, '.', symbol) ELSE symbol END AS text FROM v_rec", lambda r: r.select("context", "symbol").distinct().withColumn("text", fn.qualified_name(F.col("context"), F.col("symbol"))))
add("utf16_length", "v_lines", "SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS units FROM v_lines WHERE text IS NOT NULL", lambda d: d.where("text IS NOT NULL").select("doc_id", fn.utf16_length(F.col("text")).alias("units")))
add("action_name", "v_rec", "SELECT DISTINCT record, action, CASE WHEN record = 1 THEN CASE action WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'address' ELSE 'call' END WHEN action = 0 THEN 'declaration' ELSE 'definition' END AS name FROM v_rec", lambda r: r.select("record", "action").distinct().withColumn("name", fn.action_name(F.col("record"), F.col("action"))))
add("kind_names", "v_rec", f"SELECT DISTINCT kind, {NAMES} AS name, {CHARS} AS letter FROM v_rec", lambda r: r.select("kind").distinct().select("kind", fn.kind_name(F.col("kind")).alias("name"), fn.kind_char(F.col("kind")).alias("letter")))
add("record_type", "v_rec", "SELECT CASE WHEN record = 1 THEN 'reference' WHEN action = 0 THEN 'declaration' ELSE 'definition' END AS type, count(*) AS n FROM v_rec GROUP BY 1", lambda r: r.groupBy(fn.record_type(F.col("record"), F.col("action")).alias("type")).agg(F.count("*").alias("n")))
add("id_hex", "v_rec", "SELECT DISTINCT coalesce(usr_id, 0) AS usr_id, lpad(printf('%x', coalesce(usr_id, 0)), 16, '0') AS text FROM v_rec", lambda r: r.select(F.coalesce("usr_id", F.lit(0)).alias("usr_id")).distinct().select("usr_id", fn.id_hex(F.col("usr_id")).alias("text")))
add("leaf_name", "v_rec", f"SELECT DISTINCT symbol, {LEAF} AS leaf, strlen({LEAF}) AS bytes FROM v_rec", lambda r: r.select("symbol").distinct().select("symbol", fn.leaf_name(F.col("symbol")).alias("leaf"), F.octet_length(fn.leaf_name(F.col("symbol"))).cast("long").alias("bytes")))
add(
    "command_export",
    "v_commands",
    """SELECT file, concat('{"directory":"', directory, '","file":"', file, '","arguments":["', replace(arguments, '|', '","'), '"]}') AS json FROM v_commands WHERE variant = 'general'""",
    lambda c: documents.export_commands(c.withColumn("arguments", F.split("arguments", "[|]")), "general"),
)
