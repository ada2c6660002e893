"""Record-model views of the driver tables; the same SQL runs in Spark and in the oracle."""

from collections import Counter

VIEWS = {
    "v_files": """
SELECT o_orderkey AS file_id,
       CASE o_orderstatus WHEN 'O' THEN 'general' WHEN 'F' THEN 'debug' ELSE 'arm64-defconfig' END AS variant,
       concat('src/d', CAST(o_custkey % 50 AS STRING), '/f', CAST(o_orderkey AS STRING), '.c') AS path,
       CAST(o_orderkey AS BIGINT) * 1000003 + 1 AS mtime_ns,
       CAST(floor(o_totalprice) AS BIGINT) AS size
FROM orders
""",
    "v_raw": """
SELECT 0 AS batch, concat(replace(p_brand, '#', '_'), '.', replace(p_name, ' ', '_')) AS symbol,
       CASE WHEN l_linenumber <= 2 THEN 0 ELSE 1 END AS record,
       CASE WHEN l_linenumber <= 2 THEN l_linenumber - 1 ELSE CAST(l_partkey % 4 AS INT) END AS action,
       p_size % 10 AS kind,
       CASE WHEN l_linenumber <= 2 THEN 0 ELSE CAST(l_quantity AS INT) END AS mode,
       l_orderkey AS file_id,
       CAST(floor(l_extendedprice) AS BIGINT) % 400 + 1 AS line,
       l_suppkey % 80 + 1 AS col,
       CASE WHEN l_linenumber <= 2 THEN '' ELSE concat('fn_', CAST(l_suppkey % 40 AS STRING)) END AS context,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_partkey + 1 END AS usr_id,
       CASE WHEN l_linenumber > 2 AND l_partkey % 4 = 3 AND p_size % 10 = 7 THEN l_suppkey % 40 + 1 END AS context_usr_id,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS local
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
    "v_dup": """
SELECT * FROM v_raw
UNION ALL
SELECT 1 AS batch, symbol, record, action, kind, mode, file_id, line, col, 'dup' AS context,
       CAST(NULL AS BIGINT) AS usr_id, CAST(NULL AS BIGINT) AS context_usr_id, 1 - local AS local
FROM v_raw WHERE usr_id % 7 = 0
""",
    "v_records": """
SELECT symbol, record, action, kind, mode, file_id, line, col, context, usr_id, context_usr_id, local FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, record, action, kind, mode, file_id, line, col
           ORDER BY batch, context, coalesce(usr_id, 0), coalesce(context_usr_id, 0), local) AS rn FROM v_dup) t
WHERE rn = 1
""",
    "v_calls": """
SELECT DISTINCT f.variant, concat('fn_', CAST(l_partkey % 500 AS STRING)) AS caller, l_partkey % 500 + 1 AS caller_id,
       concat('fn_', CAST((l_partkey * 7 + l_suppkey) % 500 AS STRING)) AS callee,
       (l_partkey * 7 + l_suppkey) % 500 + 1 AS callee_id, f.path,
       CAST(floor(l_extendedprice) AS BIGINT) % 400 + 1 AS line, l_suppkey % 80 + 1 AS col
FROM lineitem JOIN v_files f ON f.file_id = l_orderkey WHERE l_linenumber = 7
""",
    "v_trace": """
SELECT user_id AS pid, CASE WHEN user_id % 2 = 0 THEN 'index' ELSE 'compiler' END AS command,
       concat('src/s', CAST(user_id % 20 AS STRING), '.c') AS source,
       CASE event_type WHEN 'click' THEN 'parse' WHEN 'view' THEN 'db.stage_records'
            WHEN 'purchase' THEN 'db.merge.records_insert' WHEN 'signup' THEN 'db.merge.begin' ELSE 'total' END AS phase,
       event_id * 1000000 AS start_ns, CAST(floor(value * 100) AS BIGINT) * 10000 AS duration_ns,
       CASE WHEN event_type IN ('view', 'purchase') THEN event_id % 100 END AS items_in,
       CASE WHEN event_type IN ('view', 'purchase') THEN event_id % 37 END AS items_out
FROM events
""",
    "v_units": """
SELECT CAST(c_custkey AS STRING) AS key, c_custkey AS c, c_nationkey AS n, n_regionkey AS r, concat('src/c', CAST(c_custkey AS STRING), '.c') AS unit
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    "v_sources": """
SELECT 'general' AS variant, unit AS path, concat(
  '#include "../include/n', CAST(n AS STRING), '.h"', chr(10), '#include "gone', CAST(c % 7 AS STRING), '.h"', chr(10),
  'static int twice(int x) ', chr(123), ' return x + x; ', chr(125), '', chr(10), '__init int f', key, '(struct node', CAST(n AS STRING), ' *p) ', chr(123), '', chr(10),
  '  p->key = LIMIT_', CAST(n AS STRING), ';', chr(10), '  p->run = twice;', chr(10), '  p->run(1);', chr(10),
  '  return CALL_', CAST(r AS STRING), '(twice(p->key));', chr(10), '', chr(125), '', chr(10)) AS content
FROM v_units
UNION ALL
SELECT 'general' AS variant, concat('include/n', CAST(n_nationkey AS STRING), '.h') AS path, concat(
  '#ifndef N', CAST(n_nationkey AS STRING), '_H', chr(10), '#define N', CAST(n_nationkey AS STRING), '_H', chr(10), '#include "r', CAST(n_regionkey AS STRING), '.h"', chr(10),
  '#define LIMIT_', CAST(n_nationkey AS STRING), ' (BASE_', CAST(n_regionkey AS STRING), ' + ', CAST(n_nationkey AS STRING), ')', chr(10),
  'struct node', CAST(n_nationkey AS STRING), ' ', chr(123), ' int key; int (*run)(int); ', chr(125), ';', chr(10), '#endif', chr(10)) AS content
FROM nation
UNION ALL
SELECT 'general' AS variant, concat('include/r', CAST(r_regionkey AS STRING), '.h') AS path, concat(
  '#pragma once', chr(10), '#define BASE_', CAST(r_regionkey AS STRING), ' ', CAST(r_regionkey AS STRING), chr(10), 'int g', CAST(r_regionkey AS STRING), '(int);', chr(10),
  '#define CALL_', CAST(r_regionkey AS STRING), '(x) g', CAST(r_regionkey AS STRING), '(x)', chr(10)) AS content
FROM region
""",
    "v_symbol_types": """
SELECT DISTINCT f.variant, f.path, r.symbol, r.kind, r.usr_id, concat('struct ', p_type) AS declared_type,
       lower(p_type) AS canonical_type, replace(p_brand, '#', '_') AS type_symbol, 2 AS type_kind,
       CAST(p_size AS BIGINT) AS type_usr_id
FROM v_raw r JOIN v_files f ON f.file_id = r.file_id JOIN part ON p_partkey = r.usr_id - 1 WHERE r.record = 0
""",
    "v_function_types": """
SELECT f.variant, f.path, concat('fn_', CAST(f.file_id AS STRING)) AS symbol, f.file_id + 1 AS usr_id, -1 AS position,
       '' AS name, 'int' AS declared_type, 'int' AS canonical_type, CAST(f.size % 2 AS INT) AS variadic FROM v_files f
UNION ALL
SELECT DISTINCT f.variant, f.path, concat('fn_', CAST(f.file_id AS STRING)), f.file_id + 1, l_linenumber - 1,
       concat('arg', CAST(l_linenumber AS STRING)), concat('t_', l_returnflag), lower(l_returnflag), 0
FROM lineitem JOIN v_files f ON f.file_id = l_orderkey
""",
    "v_variants": """
SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('/src/', r_name) END AS repository_root,
       CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE concat('c', CAST(n_nationkey AS STRING)) END AS git_commit
FROM nation JOIN region ON n_regionkey = r_regionkey
""",
    "v_commands": """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'general' ELSE 'debug' END AS variant,
       concat('/src/d', CAST(s_nationkey AS STRING), '/f', CAST(s_suppkey AS STRING), '.c') AS file,
       concat('/src/d', CAST(s_nationkey AS STRING)) AS directory, concat('cc|-c|', s_name) AS arguments
FROM supplier
""",
}

#: Further views: the canonical record table, the delta of the merge queries, direct calls.
VIEWS |= {
    "v_rec": """
SELECT f.variant, f.path, r.line, r.col, r.record, r.action, r.kind, r.symbol, r.context, r.mode, r.usr_id, r.context_usr_id, r.local
FROM v_records r JOIN v_files f ON f.file_id = r.file_id
""",
    "v_base_files": "SELECT variant, path, mtime_ns, size FROM v_files WHERE file_id % 10 <> 0",
    "v_base": """
SELECT f.variant, f.path, r.line, r.col, r.record, r.action, r.kind, r.symbol, r.context, r.mode, r.usr_id, r.context_usr_id, r.local
FROM v_records r JOIN v_files f ON f.file_id = r.file_id WHERE f.file_id % 10 <> 0
""",
    "v_staged_files": """
SELECT variant, path, mtime_ns, size + CASE WHEN file_id % 4 = 1 THEN 1 ELSE 0 END AS size,
       CASE WHEN file_id % 15 = 0 THEN 1 ELSE 0 END AS is_main FROM v_files WHERE file_id % 5 IN (0, 1)
""",
    "v_staged": """
SELECT f.variant, f.path, r.line + CASE WHEN f.file_id % 3 = 0 THEN 1 ELSE 0 END AS line, r.col, r.record, r.action, r.kind, r.symbol,
       'staged' AS context, r.mode, r.usr_id, r.context_usr_id, r.local
FROM v_records r JOIN v_files f ON f.file_id = r.file_id WHERE f.file_id % 5 IN (0, 1)
""",
    "v_new_variants": """
SELECT name, CASE WHEN length(name) % 2 = 0 THEN NULL ELSE concat('new-', name) END AS git_commit,
       CASE WHEN length(name) % 3 = 0 THEN '/new' ELSE NULL END AS repository_root FROM v_variants WHERE length(name) > 5
""",
    "v_lines": "SELECT doc_id, text FROM documents",
}

#: What each view reads.
NEEDS = {
    "v_files": ["orders"],
    "v_raw": ["lineitem", "part"],
    "v_dup": ["v_raw"],
    "v_records": ["v_dup"],
    "v_calls": ["lineitem", "v_files"],
    "v_trace": ["events"],
    "v_units": ["customer", "nation"],
    "v_sources": ["v_units", "nation", "region"],
    "v_symbol_types": ["v_raw", "v_files", "part"],
    "v_function_types": ["v_files", "lineitem"],
    "v_variants": ["nation", "region"],
    "v_commands": ["supplier"],
    "v_rec": ["v_records", "v_files"],
    "v_base_files": ["v_files"],
    "v_base": ["v_records", "v_files"],
    "v_staged_files": ["v_files"],
    "v_staged": ["v_records", "v_files"],
    "v_new_variants": ["v_variants"],
    "v_lines": ["documents"],
}


def closure(names: list[str]) -> list[str]:
    """The views below the named ones and themselves, in an order in which they can be made."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for n in NEEDS[name]:
                add(n)
            out.append(name)

    for name in names:
        add(name)
    return out


def with_views(names: list[str], sql: str) -> str:
    """The SQL behind a WITH clause of the views it needs; those that several read are made once."""
    needed = closure(names)
    readers = Counter(n for v in needed for n in NEEDS[v])
    parts = [f"{n} AS {'MATERIALIZED ' if readers[n] > 1 else ''}({VIEWS[n]})" for n in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def frame(spark, sf_dir: str, name: str):
    """A view, or a driver table, as a DataFrame. Tables are passed to the SQL by argument."""
    import re

    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "v_dup":
        return _dup(frame(spark, sf_dir, "v_raw"))
    tables: dict = {}

    def bind(sql: str) -> str:
        def one(m):
            t = m.group(2)
            tables.setdefault(t, None)
            return f"{m.group(1)}{{{t}}}"

        return re.sub(r"\b((?:FROM|JOIN)\s+)(" + "|".join(map(re.escape, NEEDS[name])) + r")\b", one, sql)

    sql = bind(VIEWS[name])
    # an alias keeps column references by the table's own name possible
    return spark.sql(sql, **{t: frame(spark, sf_dir, t) for t in tables})


def _dup(raw):
    """The rows of v_dup. Both batches of a record are made where it is, so that parts are joined
    once, and records are dealt by file: first ones by key and joins with files need no other shuffle."""
    from pyspark.sql import functions as F

    again = F.coalesce(F.col("usr_id") % 7 == 0, F.lit(False))
    batch = F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    first = F.col("batch") == 0
    rows = raw.drop("batch").repartition("file_id").select(batch.alias("batch"), "*")
    context = F.when(first, F.col("context")).otherwise("dup")
    ids = {c: F.when(first, F.col(c)) for c in ("usr_id", "context_usr_id")}
    return rows.withColumns({"context": context, **ids, "local": F.when(first, F.col("local")).otherwise(1 - F.col("local"))}).select(*raw.columns)
