"""Call edges and traversals. Edges: variant, caller, caller_id, callee, callee_id, path, line, col."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.functions.scalars import matches
from codequarry.operators.search import first_by
from codequarry.plans.scratch import cut

NODE = ["variant", "name", "id"]


def call_edges(records: DataFrame) -> DataFrame:
    """Direct calls of functions as a narrow table of edges."""
    call = (F.col("record") == S.USE) & (F.col("action") == S.CALL) & (F.col("kind") == S.FUNCTION)
    return records.where(call).select(
        "variant", F.col("context").alias("caller"), F.col("context_usr_id").alias("caller_id"), F.col("symbol").alias("callee"), F.col("usr_id").alias("callee_id"), "path", "line", "col"
    )


def callers(edges: DataFrame, name: str, usr_id: int, variant: str | None = None) -> DataFrame:
    """Edges into a function; an id always has to match, so that rows without one never do."""
    out = edges.where((F.col("callee") == name) & (F.col("callee_id") == usr_id))
    out = out.where(F.col("variant") == variant) if variant is not None else out
    return out.orderBy("variant", "caller", "path", "line", "col")


def callees(edges: DataFrame, name: str, usr_id: int, variant: str | None = None) -> DataFrame:
    out = edges.where((F.col("caller") == name) & (F.col("caller_id") == usr_id))
    out = out.where(F.col("variant") == variant) if variant is not None else out
    return out.orderBy("variant", "callee", "path", "line", "col")


def by_name(edges: DataFrame, name: str, direction: str, usr_id: int | None = None) -> DataFrame:
    """The command line's call graph: by name or pattern, rows without ids included and shown as 0."""
    end = "callee" if direction == "callers" else "caller"
    out = edges.where(matches(F.col(end), name))
    out = out.where(F.col(f"{end}_id") == usr_id) if usr_id is not None else out
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("caller_id", "callee_id")}
    return out.withColumns(zero).orderBy("variant", "caller", "callee", "path", "line", "col")


def edge_line() -> Column:
    where = F.concat_ws(":", "variant", "path", F.col("line").cast("string"), F.col("col").cast("string"))
    return F.concat("caller", F.lit(" -> "), "callee", F.lit("\t"), where)


def resolve_functions(records: DataFrame, requested: DataFrame) -> DataFrame:
    """Records of many functions (variant, symbol, usr_id) at once, definitions first."""
    found = records.where((F.col("record") == S.SYMBOL) & (F.col("kind") == S.FUNCTION)).join(requested, ["variant", "symbol", "usr_id"])
    return found.orderBy("variant", "symbol", F.desc("action"), "path", "line", "col")


def prefer_definition(records: DataFrame) -> DataFrame:
    """One record of each function, a definition if there is one."""
    symbols = records.where((F.col("record") == S.SYMBOL) & (F.col("kind") == S.FUNCTION))
    order = [F.desc("action"), *(F.col(c) for c in ("path", "line", "col", "mode"))]
    return first_by(symbols, [F.col("variant"), F.col("symbol"), F.coalesce("usr_id", F.lit(0))], order)


def hierarchy(edges: DataFrame, direction: str) -> DataFrame:
    """Edges grouped by the function at their other end, with sorted ranges."""
    end = "caller" if direction == "incoming" else "callee"
    own = edges.where((F.col(end) != "") & (F.coalesce(f"{end}_id", F.lit(0)) != 0))
    ranges = F.sort_array(F.collect_list(F.struct("path", "line", "col")))
    return own.groupBy("variant", F.col(end).alias("name"), F.col(f"{end}_id").alias("id")).agg(F.count("*").alias("n"), ranges.alias("ranges"))


def reachable(edges: DataFrame, start: DataFrame, depth: int, direction: str = "callees") -> DataFrame:
    """Nodes within ``depth`` calls with their least depth: one join a level, on the frontier
    only, against what was not seen. start: variant, name, id."""
    near, far = ("caller", "callee") if direction == "callees" else ("callee", "caller")
    step = edges.where((F.coalesce("caller_id", F.lit(0)) != 0) & (F.coalesce("callee_id", F.lit(0)) != 0)).select("variant", F.col(near).alias("name"), F.col(f"{near}_id").alias("id"), F.col(far).alias("to_name"), F.col(f"{far}_id").alias("to_id")).distinct()
    seen = frontier = start.select(*NODE).distinct().withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        reached = step.join(frontier.select(*NODE), NODE).select("variant", F.col("to_name").alias("name"), F.col("to_id").alias("id")).distinct()
        frontier = reached.join(seen.select(*NODE), NODE, "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
        if level % 4 == 0:
            frontier, seen = cut(frontier, "frontier"), cut(seen, "seen")
    return seen


@dataclass
class Walk:
    edges: list[dict] = field(default_factory=list)
    truncated: bool = False
    node_limit_hit: bool = False
    cycles: bool = False


def walk(fetch: Callable[[tuple], Iterable[dict]], start: tuple, depth: int, limit: int = 50, nodes: int = 50) -> Walk:
    """``walk_levels`` with a query for each node."""
    return walk_levels(lambda wanted: {n: fetch(n) for n in wanted}, start, depth, limit, nodes)


def walk_levels(fetch: Callable[[list[tuple]], dict[tuple, Iterable[dict]]], start: tuple, depth: int, limit: int = 50, nodes: int = 50) -> Walk:
    """Breadth-first, first in first out, with edge and node limits. ``fetch(nodes)`` is asked once
    a level and gives each node's edges in query order, each with its ``to`` node. An edge to an
    ancestor is a cycle and kept; an edge to a node beyond the node limit is left out."""
    if not (1 <= depth <= 16 and 1 <= limit <= 200 and 1 <= nodes <= 200):
        raise ValueError("depth, limit or nodes out of range")
    out, visited = Walk(), {start}
    frontier = [(start, frozenset([start]))]
    for level in range(1, depth + 1):
        if not frontier or len(out.edges) > limit:
            break
        found, after = fetch([node for node, _ in frontier]), []
        for node, above in frontier:
            for edge in found.get(node, ()):
                to = edge["to"]
                cycle = to in above
                out.cycles |= cycle
                if not cycle and to not in visited:
                    if len(visited) >= nodes:
                        out.node_limit_hit = True
                        continue
                    visited.add(to)
                    after.append((to, above | {to}))
                out.edges.append({**edge, "depth": level})
                if len(out.edges) > limit:
                    break
            if len(out.edges) > limit:
                break
        frontier = after
    out.truncated = len(out.edges) > limit
    out.edges = out.edges[:limit]
    return out


def spark_fetch(edges: DataFrame, direction: str, most: int) -> Callable[[tuple], list[dict]]:
    """A ``fetch`` for ``walk``: one bounded query a node."""
    query, end = (callees, "callee") if direction == "callees" else (callers, "caller")

    def fetch(node: tuple) -> list[dict]:
        rows = query(edges, node[1], node[2], node[0]).limit(most).collect()
        return [{**r.asDict(), "to": (r["variant"], r[end], r[f"{end}_id"])} for r in rows if r[end] and r[f"{end}_id"]]

    return fetch


def frontier_fetch(edges: DataFrame, direction: str, most: int) -> Callable[[list[tuple]], dict[tuple, list[dict]]]:
    """A ``fetch`` for ``walk_levels``: one job a level joins its nodes (their number is limited)
    with the edges and keeps the first ``most`` of each in query order."""
    near, far = ("caller", "callee") if direction == "callees" else ("callee", "caller")
    columns, spark = edges.columns, edges.sparkSession

    def fetch(nodes: list[tuple]) -> dict[tuple, list[dict]]:
        asked = spark.createDataFrame([(i, *n) for i, n in enumerate(nodes)], f"turn int, variant string, {near} string, {near}_id long")
        own = edges.join(F.broadcast(asked), ["variant", near, f"{near}_id"])
        rank = F.row_number().over(Window.partitionBy("turn").orderBy(far, "path", "line", "col"))
        rows = own.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("turn", "rank").collect()
        out: dict[tuple, list[dict]] = {}
        for r in rows:
            if r[far] and r[f"{far}_id"]:
                out.setdefault(nodes[r["turn"]], []).append({**{c: r[c] for c in columns}, "to": (r["variant"], r[far], r[f"{far}_id"])})
        return out

    return fetch


def points_to(direct: DataFrame, copies: DataFrame) -> DataFrame:
    """Closure of pointer constraints: direct (pointer, target), copies (pointer, source). Only
    what the last round found is joined; it ends when a round finds nothing."""
    fresh = cut(direct.select("pointer", "target").distinct(), "points-to")
    found = fresh
    while not fresh.isEmpty():
        step = copies.join(fresh.withColumnRenamed("pointer", "source"), "source").select("pointer", "target").distinct()
        fresh = cut(step.join(found, ["pointer", "target"], "left_anti"), "points-to")
        found = found.unionByName(fresh)  # each round's table is read again, and written once
    return found
