"""Record queries. ``records`` holds the 13 record columns with variant and path inlined."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.functions.scalars import leaf_name, matches


def denormalise(records: DataFrame, files: DataFrame) -> DataFrame:
    """records with a file id, and files, as one table of the record columns."""
    return records.join(files.select("file_id", "variant", "path"), "file_id").select(*S.RECORD_COLUMNS)


def record_filter(kind: str) -> Column:
    record, action = F.col("record"), F.col("action")
    return {
        "all": F.lit(True),
        "symbol": record == S.SYMBOL,
        "declaration": (record == S.SYMBOL) & (action == S.DECLARATION),
        "definition": (record == S.SYMBOL) & (action != S.DECLARATION),
        "reference": record == S.USE,
    }[kind]


def mode_filter(mode: int) -> Column:
    """Uses that have any of the bits; with no bits, uses that have none."""
    test = F.col("mode") == 0 if mode == 0 else F.col("mode").bitwiseAND(F.lit(mode)) != 0
    return (F.col("record") == S.USE) & test


def after(df: DataFrame, order: list[str], cursor: dict[str, Any]) -> Column:
    """Rows behind the cursor in ``order``. The first column's range is repeated alone, because
    scans can use that."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    at = [F.lit(cursor[c]).cast(kinds[c]) for c in order]
    return (F.col(order[0]) >= at[0]) & (F.struct(*order) > F.struct(*(v.alias(c) for v, c in zip(at, order, strict=True))))


def query(
    records: DataFrame,
    symbol: str | None = None,
    path: str | None = None,
    variant: str | None = None,
    context: str | None = None,
    record: str = "all",
    mode: int | None = None,
    kind: int | None = None,
    usr_id: int | None = None,
    local: int | None = None,
    cursor: dict[str, Any] | None = None,
    limit: int = 0,
    ordered: bool = True,
) -> DataFrame:
    """The general query: only the asked-for predicates, in the total record order."""
    out = records
    for column, pattern in (("symbol", symbol), ("path", path), ("variant", variant)):
        if pattern is not None:
            out = out.where(matches(F.col(column), pattern))
    if context is not None:
        out = out.where(F.col("context") == context)
    if record != "all":
        out = out.where(record_filter(record))
    if mode is not None:
        out = out.where(mode_filter(mode))
    for column, value in (("kind", kind), ("usr_id", usr_id), ("local", local)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if cursor is not None:
        out = out.where(after(out, S.RECORD_ORDER, cursor))
    if limit < 0:
        raise ValueError("limit must not be negative")
    if ordered:
        out = out.orderBy(*S.RECORD_ORDER)
    return (out.limit(limit) if limit else out).select(*S.RECORD_COLUMNS)


def identity(records: DataFrame, variant: str, symbol: str, usr_id: int, kind: int | None = None, record: str = "all", **page: Any) -> DataFrame:
    if not (variant and symbol and usr_id):
        raise ValueError("variant, symbol and id are needed")
    exact = records.where((F.col("variant") == variant) & (F.col("symbol") == symbol))
    return query(exact, usr_id=usr_id, kind=kind, record=record, **page)


def page(records: DataFrame, limit: int, **options: Any) -> DataFrame:
    """A page with one row more than asked for, which is marked: rank > limit means there is more."""
    rows = query(records, limit=limit + 1, **options)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*S.RECORD_ORDER))).withColumn("look_ahead", (F.col("rank") > limit).cast("int"))


def covers(column: Column) -> Column:
    return column.between(F.col("col"), F.col("col") + F.octet_length(leaf_name(F.col("symbol"))) - 1)


def at_position(records: DataFrame, path: str | None, line: int, column: int, variant: str | None = None) -> DataFrame:
    """Records whose leaf name covers the position, in one file or in any; later starts first."""
    out = records.where((F.col("line") == line) & (F.col("col") <= column))
    out = out.where(F.col("path") == path) if path is not None else out
    out = out.where(F.col("variant") == variant) if variant is not None else out
    return out.where(covers(F.lit(column))).orderBy(F.desc("col"), "record", *S.RECORD_ORDER)


def at_positions(records: DataFrame, positions: DataFrame) -> DataFrame:
    """Many positions (variant, path, line, at) by one equi-join and the range as its condition."""
    joined = records.join(positions, ["variant", "path", "line"])
    return joined.where(covers(F.col("at")))


def identity_key() -> list[Column]:
    """What makes records of one thing alike; without an id also where they stand."""
    no_id = F.coalesce(F.col("usr_id"), F.lit(0)) == 0
    rest = F.when(no_id, F.struct("path", "context", "local"))
    return [F.col("variant"), F.col("symbol"), F.col("kind"), F.coalesce("usr_id", F.lit(0)), rest]


def first_by(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    own = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def position_service(records: DataFrame, candidates: DataFrame, line: int, column: int) -> DataFrame:
    """Of the first candidate path (path, prio) that has any, the records at a position, one an identity."""
    found = records.where((F.col("line") == line) & covers(F.lit(column))).join(F.broadcast(candidates), "path")
    best = found.withColumn("_best", F.min("prio").over(Window.partitionBy())).where("prio = _best").drop("_best")
    return first_by(best, identity_key(), [F.desc("col"), F.col("record"), *(F.col(c) for c in S.RECORD_ORDER)])


def overlaid(records: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay rows hide what is stored for their paths."""
    return records.join(overlay.select("path").distinct(), "path", "left_anti").select(*S.RECORD_COLUMNS).unionByName(overlay.select(*S.RECORD_COLUMNS))


def overlay_query(rows: DataFrame, symbol: str, kind: int | None = None, local: int | None = None, record: str = "all", mode: int | None = None) -> DataFrame:
    """Rows of an open editor: names are compared as they are, modes as a whole."""
    out = rows.where((F.col("symbol") == symbol) & record_filter(record))
    for column, value in (("kind", kind), ("local", local), ("mode", mode)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def functions_at(found: DataFrame) -> DataFrame:
    """The distinct functions among the records at a position."""
    own = found.where((F.col("kind") == S.FUNCTION) & (F.coalesce("usr_id", F.lit(0)) != 0))
    return own.select("variant", F.col("symbol").alias("name"), F.col("usr_id").alias("id")).distinct()


def with_source(records: DataFrame, lines: DataFrame, variants: DataFrame) -> DataFrame:
    """Records with ``source``, the text of their line without leading blanks: lines (path, line,
    text) are named by whole paths, records by paths below their variant's root. Empty if unknown.
    Variants are few and are broadcast up to the engine's own threshold."""
    root = variants.select(F.col("name").alias("variant"), F.col("repository_root").alias("root"))
    whole = F.when(F.col("root").isNull() | F.col("path").startswith("/"), F.col("path")).otherwise(F.concat_ws("/", "root", "path"))
    own = records.join(root, "variant", "left").withColumn("whole", whole)
    text = lines.select(F.col("path").alias("whole"), "line", F.regexp_replace("text", r"^\s+", "").alias("source"))
    return own.join(text, ["whole", "line"], "left").withColumn("source", F.coalesce("source", F.lit(""))).select(*records.columns, "source")


def related(records: DataFrame, symbol: str, kind: int, local: int, context: str | None = None, record: str = "all", paths: list[str] | None = None) -> DataFrame:
    """By name, kind and locality, not by id; locals within their context and paths."""
    out = records.where((F.col("symbol") == symbol) & (F.col("kind") == kind) & (F.col("local") == local))
    if local:
        out = out.where(F.col("context") == (context or "")).where(F.col("path").isin(paths or []))
    return out.where(record_filter(record))


def definition_or_declaration(records: DataFrame, key: list[str]) -> DataFrame:
    """Definitions of each key, or its declarations where there is no definition."""
    symbols = records.where(record_filter("symbol")).withColumn("_tier", F.when(F.col("action") == S.DECLARATION, 1).otherwise(0))
    return symbols.withColumn("_best", F.min("_tier").over(Window.partitionBy(*key))).where("_tier = _best").drop("_tier", "_best")


def distinct_locations(records: DataFrame) -> DataFrame:
    return first_by(records, [F.col("path"), F.col("line"), F.col("col")], [F.col(c) for c in S.RECORD_ORDER])


def highlights(records: DataFrame) -> DataFrame:
    """The greatest kind of each location: 1 text, 2 read, 3 write."""
    writes = (F.col("record") == S.USE) & (F.col("mode").bitwiseAND(F.lit(S.W_AOF | S.W_VAL | S.W_PTR)) != 0)
    reads = (F.col("record") == S.USE) & (F.col("mode").bitwiseAND(F.lit(S.R_AOF | S.R_VAL | S.R_PTR)) != 0)
    kind = F.when(writes, 3).when(reads, 2).otherwise(1)
    return records.groupBy("path", "line", "col").agg(F.max(kind).alias("highlight"))


def list_variants(variants: DataFrame) -> DataFrame:
    return variants.select("name", "git_commit", "repository_root").orderBy("name")


def find_files(files: DataFrame, path: str, variant: str | None = None) -> DataFrame:
    """Stored files by path or pattern."""
    out = files.where(matches(F.col("path"), path))
    return (out.where(F.col("variant") == variant) if variant is not None else out).orderBy("variant", "path")


def _types(types: DataFrame, order: list[str], rest: list[str], equal: dict[str, Any], cursor: dict | None, limit: int) -> DataFrame:
    out = types
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    out = out.where(after(out, [c for c in order if c in cursor], cursor)) if cursor else out
    out = out.orderBy(*order, *rest)
    return out.limit(limit) if limit else out


def symbol_types(types: DataFrame, variant: str, symbol: str | None = None, kind: int | None = None, usr_id: int | None = None, cursor: dict | None = None, limit: int = 0) -> DataFrame:
    """Declared types in their order, behind a cursor of the order's first columns."""
    order = ["path", "declared_type", "canonical_type", "type_symbol", "type_kind", "type_usr_id"]
    return _types(types, order, ["symbol", "kind", "usr_id"], {"variant": variant, "symbol": symbol, "kind": kind, "usr_id": usr_id}, cursor, limit)


def function_types(types: DataFrame, variant: str, symbol: str | None = None, usr_id: int | None = None, cursor: dict | None = None, limit: int = 0) -> DataFrame:
    order = ["position", "path", "name", "declared_type", "canonical_type", "variadic"]
    return _types(types, order, ["symbol", "usr_id"], {"variant": variant, "symbol": symbol, "usr_id": usr_id}, cursor, limit)
