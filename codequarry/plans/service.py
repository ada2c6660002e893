"""A facade over the index: bounded pages with cursors, a pinned variant, confined paths, and
jobs that can be interrupted by a request's tag."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.functions import scalars as fn
from codequarry.operators import calls, merge, search

LIMIT, MOST, DEPTH = 50, 200, 16


class IndexService:
    def __init__(self, spark: SparkSession, records: DataFrame, workspace: str = "/", variant: str | None = None, tables: dict[str, DataFrame] | None = None) -> None:
        """tables: the other tables of the index, for the requests that read them."""
        self.spark, self.records, self.workspace, self.variant, self.tables = spark, records, workspace, variant, tables or {}
        self.edges = calls.call_edges(records)

    @contextmanager
    def tagged(self, request: str, seconds: float | None = None):
        """Jobs inside can be cancelled by the request's name, and are after so many seconds."""
        self.spark.addTag(request)
        timer = threading.Timer(seconds, self.cancel, (request,)) if seconds else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            yield
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(request)

    def cancel(self, request: str) -> None:
        self.spark.interruptTag(request)

    def chosen(self, variant: str | None) -> str | None:
        if self.variant and variant not in (None, self.variant):
            raise ValueError(f"this service serves variant {self.variant}")
        return variant or self.variant

    def confined(self, path: str) -> str:
        whole = fn.candidate_paths(path, self.workspace, self.workspace)[0]
        if not fn.within(whole, self.workspace):
            raise ValueError("path is outside the workspace")
        return fn.stored_path(whole, self.workspace)

    @staticmethod
    def bounded(limit: int) -> int:
        if not 1 <= limit <= MOST:
            raise ValueError(f"limit must be from 1 to {MOST}")
        return limit

    def search_symbols(self, symbol: str, variant: str | None = None, limit: int = LIMIT, cursor: str | None = None, **options: Any) -> dict[str, Any]:
        """records, truncated and, if there is more, next_cursor."""
        at = fn.decode_cursor(cursor, S.RECORD_ORDER) if cursor else None
        rows = search.query(self.records, symbol=symbol, variant=self.chosen(variant), cursor=at, limit=self.bounded(limit) + 1, **options)
        return self._page(rows, S.RECORD_ORDER, limit)

    def _page(self, rows: DataFrame, order: list[str], limit: int, name: str = "records") -> dict[str, Any]:
        found = rows.limit(limit + 1).collect()
        out: dict[str, Any] = {name: [r.asDict() for r in found[:limit]], "truncated": len(found) > limit}
        if out["truncated"]:
            out["next_cursor"] = fn.encode_cursor({c: found[limit - 1][c] for c in order})
        return out

    def related_records(self, variant: str, symbol: str, usr_id: int, kind: int | None = None, record: str = "all", limit: int = LIMIT, cursor: str | None = None) -> dict[str, Any]:
        """Records of one thing by its identity."""
        at = fn.decode_cursor(cursor, S.RECORD_ORDER) if cursor else None
        rows = search.identity(self.records, self.chosen(variant), symbol, usr_id, kind, record, cursor=at, limit=self.bounded(limit) + 1)
        return self._page(rows, S.RECORD_ORDER, limit)

    def declared_types(self, variant: str, symbol: str, kind: int, usr_id: int, limit: int = LIMIT, cursor: str | None = None) -> dict[str, Any]:
        order = ["path", "declared_type", "canonical_type", "type_symbol", "type_kind", "type_usr_id"]
        at = fn.decode_cursor(cursor, order) if cursor else None
        return self._page(search.symbol_types(self.tables["symbol_types"], self.chosen(variant), symbol, kind, usr_id, at), order, self.bounded(limit), "types")

    def function_signature(self, variant: str, symbol: str, usr_id: int) -> list[dict[str, Any]]:
        """What the function returns (position -1) and its parameters, MOST rows at most."""
        return [r.asDict() for r in search.function_types(self.tables["function_types"], self.chosen(variant), symbol, usr_id, limit=MOST).collect()]

    def list_variants(self, limit: int = LIMIT, cursor: str | None = None) -> dict[str, Any]:
        """Variants by name; a pinned service shows its own only."""
        rows = search.list_variants(self.tables["variants"])
        rows = rows.where(F.col("name") == self.variant) if self.variant else rows
        rows = rows.where(F.col("name") > fn.decode_cursor(cursor, ["name"])["name"]) if cursor else rows
        return self._page(rows, ["name"], self.bounded(limit), "variants")

    def index_status(self, present: DataFrame, paths: list[str], variant: str) -> list[dict[str, Any]]:
        """Current, Drifted, Missing or NotIndexed for each path, and whether its command is known.
        present: path, mtime_ns and size of the files as they are."""
        asked = self.spark.createDataFrame([(self.chosen(variant), self.confined(p)) for p in paths[:MOST]], "variant string, path string")
        known = self.tables["commands"].select("variant", F.col("file").alias("path"), F.lit(True).alias("command_available")).distinct()
        found = merge.drift(self.tables["files"], present, asked).join(known, ["variant", "path"], "left")
        return [r.asDict() for r in found.withColumn("command_available", F.coalesce("command_available", F.lit(False))).orderBy("path").collect()]

    def calls_page(self, direction: str, variant: str, name: str, usr_id: int, limit: int = LIMIT, cursor: str | None = None) -> dict[str, Any]:
        """Direct calls in their order, behind a cursor, which has to be one of the rows."""
        query, end = (calls.callees, "callee") if direction == "callees" else (calls.callers, "caller")
        order = ["variant", end, "path", "line", "col"]
        rows = query(self.edges, name, usr_id, self.chosen(variant))
        if cursor:
            at = fn.decode_cursor(cursor, order)
            if rows.where(reduce(lambda a, b: a & b, (F.col(c) == at[c] for c in order))).isEmpty():
                raise ValueError("cursor does not match")
            rows = rows.where(search.after(rows, order, at))
        return self._page(rows, order, self.bounded(limit), "edges")

    def symbol_at(self, path: str, line: int, column: int, variant: str | None = None) -> DataFrame:
        self.confined(path)
        paths = fn.candidate_paths(path, self.workspace, self.workspace)
        candidates = self.spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, prio int")
        own = self.records if self.chosen(variant) is None else self.records.where(F.col("variant") == self.chosen(variant))
        return search.position_service(own, candidates, line, column)

    def find_calls(self, direction: str, variant: str, name: str, usr_id: int, depth: int = 1, limit: int = LIMIT, nodes: int = LIMIT) -> calls.Walk:
        fetch = calls.frontier_fetch(self.edges, direction, self.bounded(limit) + 1)
        return calls.walk_levels(fetch, (self.chosen(variant), name, usr_id), depth, limit, nodes)
