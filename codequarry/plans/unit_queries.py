"""Queries over C units read with what they include; the sources are made of the driver's tables: a
unit a customer, a header a nation and one a region. Their SQL lists the records that the texts give
by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.operators import calls
from codequarry.plans.catalog import IndexStore
from codequarry.plans.scratch import folder
from codequarry.plans.update import update
from codequarry.plans.views import frame, with_views
from codequarry.sources import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, oracle: str, plan: Callable[[dict[str, DataFrame]], DataFrame], first: str = "v_units") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = frame(spark, sf_dir, "v_sources")
        return plan(extract.index(sources, sources.where("path LIKE 'src/%'")))

    QUERIES[name] = run
    ORACLE_SQL[name] = with_views([first], oracle)


# u: a unit with its customer c, nation n and region r; h: the units from which a header's rows come
UNITS = """
u AS (SELECT c, n, r, unit AS path, concat('f', c) AS f, concat('node', n) AS node, 13 + length(concat('f', c)) AS par FROM v_units),
h AS (SELECT n, r, concat('include/n', n, '.h') AS path, min(path) AS unit FROM u GROUP BY n, r),
g AS (SELECT r, concat('include/r', r, '.h') AS path, min(path) AS unit FROM u GROUP BY r)
"""
# symbol, record, action, kind, mode, line, col, context, local of a unit's rows
IN_UNIT = [
    "concat('include/n', n, '.h'), 1, 0, 9, 4, 1, 10, '', 0",
    "concat('gone', c % 7, '.h'), 1, 0, 9, 4, 2, 10, '', 0",
    "'twice', 0, 1, 7, 0, 3, 12, '', 0",
    "'x', 0, 1, 0, 0, 3, 22, 'twice', 1",
    "'x', 1, 0, 0, 4, 3, 34, 'twice', 1",
    "'x', 1, 0, 0, 4, 3, 38, 'twice', 1",
    "f, 0, 1, 7, 0, 4, 12, '', 0",
    "node, 1, 0, 2, 4, 4, par + 7, f, 1",
    "'p', 0, 1, 0, 0, 4, par + 9 + length(node), f, 1",
    "'p', 1, 0, 0, 16, 5, 3, f, 1",
    "concat(node, '.key'), 1, 1, 1, 8, 5, 6, f, 0",
    "concat('LIMIT_', n), 1, 0, 8, 4, 5, 12, '', 0",
    "'p', 1, 0, 0, 16, 6, 3, f, 1",
    "concat(node, '.run'), 1, 1, 1, 8, 6, 6, f, 0",
    "'twice', 1, 0, 7, 16, 6, 12, f, 1",
    "'p', 1, 0, 0, 16, 7, 3, f, 1",
    "concat(node, '.run'), 1, 0, 1, 16, 7, 6, f, 0",
    "concat(node, '.run'), 1, 3, 1, 16, 7, 6, f, 0",
    "concat('CALL_', r), 1, 0, 8, 4, 8, 10, '', 0",
    "'twice', 1, 3, 7, 16, 8, 11 + length(concat('CALL_', r)), f, 0",
    "'p', 1, 0, 0, 16, 8, 17 + length(concat('CALL_', r)), f, 1",
    "concat(node, '.key'), 1, 0, 1, 4, 8, 20 + length(concat('CALL_', r)), f, 0",
]
IN_NATION = [
    "concat('N', n, '_H'), 1, 0, 8, 4, 1, 9, '', 0",
    "concat('N', n, '_H'), 0, 1, 8, 0, 2, 9, '', 0",
    "concat('include/r', r, '.h'), 1, 0, 9, 4, 3, 10, '', 0",
    "concat('LIMIT_', n), 0, 1, 8, 0, 4, 9, '', 0",
    "concat('BASE_', r), 1, 0, 8, 4, 4, 11 + length(concat('LIMIT_', n)), '', 0",
    "concat('node', n), 0, 1, 2, 0, 5, 8, '', 0",
    "concat('node', n, '.key'), 0, 1, 1, 0, 5, 15 + length(concat('node', n)), '', 0",
    "concat('node', n, '.run'), 0, 1, 1, 0, 5, 26 + length(concat('node', n)), '', 0",
]
IN_REGION = [
    "concat('BASE_', r), 0, 1, 8, 0, 2, 9, '', 0",
    "concat('g', r), 0, 0, 7, 0, 3, 5, '', 0",
    "concat('CALL_', r), 0, 1, 8, 0, 4, 9, '', 0",
    "concat('g', r), 1, 3, 7, 16, 4, 13 + length(concat('CALL_', r)), (SELECT f FROM u WHERE u.path = g.unit), 0",
]
RECORDS = "\nUNION ALL ".join(f"SELECT path, {row} FROM {of}" for of, rows in (("u", IN_UNIT), ("h", IN_NATION), ("g", IN_REGION)) for row in rows)
COLUMNS = ["path", "symbol", "record", "action", "kind", "mode", "line", "col", "context", "local"]

add("c_unit_records", f", {UNITS}, t({', '.join(COLUMNS)}) AS ({RECORDS}) SELECT path, symbol, record, action, kind, mode, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, context, local FROM t", lambda t: t["records"].select(*COLUMNS))


def _resolved(t: dict[str, DataFrame]) -> DataFrame:
    """Calls with the place of what they call, found by id alone."""
    symbols = t["records"].where(f"record = {S.SYMBOL} AND kind = {S.FUNCTION}").select("variant", F.col("usr_id").alias("callee_id"), F.col("path").alias("at_path"), F.col("line").alias("at_line"))
    callers = t["records"].where(f"record = {S.SYMBOL} AND kind = {S.FUNCTION}").select("variant", F.col("usr_id").alias("caller_id"), F.col("path").alias("in_path"))
    return calls.call_edges(t["records"]).join(symbols, ["variant", "callee_id"]).join(callers, ["variant", "caller_id"]).select("caller", "callee", "path", "line", "col", "at_path", "at_line", "in_path")


add(
    "c_unit_calls",
    f""", {UNITS}
SELECT f AS caller, 'twice' AS callee, path, CAST(8 AS BIGINT) AS line, CAST(11 + length(concat('CALL_', r)) AS BIGINT) AS col, path AS at_path, CAST(3 AS BIGINT) AS at_line, path AS in_path FROM u
UNION ALL SELECT f, concat('g', g.r), g.path, 4, 13 + length(concat('CALL_', g.r)), g.path, 3, u.path FROM g JOIN u ON u.path = g.unit""",
    _resolved,
)


def _types(t: dict[str, DataFrame]) -> DataFrame:
    own = t["symbol_types"].select("path", "symbol", "kind", F.lit(-2).alias("position"), F.lit("").alias("name"), "declared_type", "canonical_type", "type_symbol", "type_kind")
    return own.unionByName(t["function_types"].select("path", "symbol", F.lit(S.FUNCTION).alias("kind"), "position", "name", "declared_type", "canonical_type", "type_symbol", "type_kind"))


# symbol, kind, position (-2: of the symbol), name, type, name and kind of the named type
UNIT_TYPES = [
    "'twice', 7, -2, '', 'int (int)', '', -1", "'x', 0, -2, '', 'int', '', -1", "'twice', 7, -1, '', 'int', '', -1", "'twice', 7, 0, 'x', 'int', '', -1",
    "f, 7, -2, '', concat('int (struct ', node, ' *)'), '', -1", "f, 7, -1, '', 'int', '', -1", "f, 7, 0, 'p', concat('struct ', node, ' *'), node, 2", "'p', 0, -2, '', concat('struct ', node, ' *'), node, 2",
]
NATION_TYPES = ["concat('node', n, '.key'), 1, -2, '', 'int', '', -1", "concat('node', n, '.run'), 1, -2, '', 'int (*)(int)', '', -1"]
REGION_TYPES = ["concat('g', r), 7, -2, '', 'int (int)', '', -1", "concat('g', r), 7, -1, '', 'int', '', -1", "concat('g', r), 7, 0, '', 'int', '', -1"]
TYPES = "\nUNION ALL ".join(f"SELECT path, {row} FROM {of}" for of, rows in (("u", UNIT_TYPES), ("h", NATION_TYPES), ("g", REGION_TYPES)) for row in rows)
add("c_unit_types", f", {UNITS}, t(path, symbol, kind, position, name, declared_type, type_symbol, type_kind) AS ({TYPES}) SELECT *, declared_type AS canonical_type FROM t", _types)

add(
    "c_unit_status",
    f", {UNITS} SELECT path AS unit, 'partial' AS status, CAST(2 AS BIGINT) AS line, CAST(10 AS BIGINT) AS col, concat('''gone', c % 7, '.h'' file not found') AS message FROM u",
    lambda t: t["status"].join(t["diagnostics"], ["variant", "unit"]).select("unit", "status", "line", "col", "message"),
)


def _targets(t: dict[str, DataFrame]) -> DataFrame:
    """How many functions each field may point to, by the constraints of all units."""
    direct = t["points"].where("constraint = 'direct'").select("pointer", F.col("source").alias("target"))
    found = calls.points_to(direct, t["points"].where("constraint = 'copy'").select("pointer", "source"))
    fields = t["records"].where(f"record = {S.SYMBOL} AND kind = 1").select("symbol", F.col("usr_id").alias("pointer"))
    return found.join(fields, "pointer").groupBy("symbol").agg(F.count("*").alias("targets"))


add("c_points_to", f", {UNITS} SELECT concat(node, '.run') AS symbol, count(*) AS targets FROM u GROUP BY node", _targets)


def c_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a new index by table and record kind, read back from the store."""
    sources = frame(spark, sf_dir, "v_sources")
    store = IndexStore(spark, folder(spark, "index"))
    update(store, sources, sources.where("path LIKE 'src/%'"))
    table = lambda name, kind: store.table(name).select(F.lit(name).alias("name"), kind.alias("kind"))
    rows = table("records", F.col("kind")).unionByName(table("symbol_types", F.col("kind"))).unionByName(table("function_types", F.col("position"))).unionByName(table("files", F.lit(0)))
    return rows.groupBy("name", "kind").agg(F.count("*").alias("n"))


QUERIES["c_update"] = c_update
ORACLE_SQL["c_update"] = with_views(
    ["v_units"],
    f""", {UNITS}, t({', '.join(COLUMNS)}) AS ({RECORDS}), y(path, symbol, kind, position, name, declared_type, type_symbol, type_kind) AS ({TYPES})
SELECT 'records' AS name, kind, count(*) AS n FROM t GROUP BY kind UNION ALL SELECT 'symbol_types', kind, count(*) FROM y WHERE position = -2 GROUP BY kind
UNION ALL SELECT 'function_types', position, count(*) FROM y WHERE position > -2 GROUP BY position UNION ALL SELECT 'files', 0, (SELECT count(*) FROM u) + (SELECT count(*) FROM h) + (SELECT count(*) FROM g)""",
)
