"""Which file an include names, and what each unit reads: joins over the table of sources.

The include graph is built from the frontier: files that are reached are joined with their
directives, candidates of these with the files that exist, level by level, until nothing new is
reached. Directives are taken from every branch; which of them count is decided when a unit is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.search import first_by
from codequarry.plans.scratch import cut

DIRECTIVE = r'(?m)^[ \t]*#[ \t]*(?:include|include_next|import)[ \t]*(<[^>\n]+>|"[^"\n]+")'
FILE_KEY = ["variant", "path"]


def normal(path: Column) -> Column:
    """``path`` without ``.``, ``..`` and doubled slashes; leading ``..`` stay."""
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != "..")
    last = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc).when((x == "..") & up(acc), last(acc)).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def directives(sources: DataFrame) -> DataFrame:
    """variant, path, target and whether it is angled, of every include in any branch."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(DIRECTIVE), 1)))
    rows = sources.where(F.col("content").contains("#")).select(*FILE_KEY, found.alias("spelled"))
    return rows.select(*FILE_KEY, F.substr("spelled", F.lit(2), F.length("spelled") - 2).alias("target"), F.col("spelled").startswith("<").alias("angled"))


def candidates(wanted: DataFrame) -> DataFrame:
    """``wanted`` (path, target, angled, dirs) with each ``candidate`` and its ``turn``: beside the
    including file unless it is angled, then the folders in order."""
    beside = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    places = F.when(F.col("target").startswith("/"), F.array(F.lit(""))).otherwise(F.concat(F.when(F.col("angled"), F.array().cast("array<string>")).otherwise(F.array(beside)), F.col("dirs")))
    out = wanted.select("*", F.posexplode(places).alias("turn", "place"))
    whole = F.when(F.col("place") == "", F.col("target")).otherwise(F.concat("place", F.lit("/"), "target"))
    return out.withColumn("candidate", normal(whole)).drop("place")


def graph(sources: DataFrame, units: DataFrame) -> DataFrame:
    """variant, dirs, path, target, angled, found (null: missing) of every include that a unit with
    these folders can reach. units: variant, path, dirs (array of string)."""
    own = cut(directives(sources), "directives")
    exists = sources.select("variant", F.col("path").alias("candidate")).distinct()
    key = ["variant", "dirs", "path"]
    frontier = units.select(*key).distinct()
    seen, edges, level = frontier, None, 0
    while True:
        wanted = frontier.join(own, FILE_KEY).select(*key, "target", "angled")
        hits = candidates(wanted).join(exists, ["variant", "candidate"])
        first = first_by(hits, [F.col(c) for c in (*key, "target", "angled")], [F.col("turn")])
        found = wanted.join(first.select(*key, "target", "angled", F.col("candidate").alias("found")), [*key, "target", "angled"], "left")
        found = cut(found, "includes")
        edges = found if edges is None else edges.unionByName(found)
        fresh = found.where("found IS NOT NULL").select("variant", "dirs", F.col("found").alias("path")).distinct().join(seen, key, "left_anti")
        frontier = cut(fresh, "frontier")
        if frontier.isEmpty():
            return edges
        level += 1
        seen = seen.unionByName(frontier)
        if level % 4 == 0:
            seen, edges = cut(seen, "seen"), cut(edges, "edges")


def reads(units: DataFrame, edges: DataFrame) -> DataFrame:
    """variant, unit, dirs, path: the files that each unit can come to read, itself included."""
    step = edges.where("found IS NOT NULL").select("variant", "dirs", "path", F.col("found").alias("next")).distinct()
    frontier = units.select("variant", F.col("path").alias("unit"), "dirs", "path").distinct()
    seen, level = frontier, 0
    while True:
        reached = frontier.join(step, ["variant", "dirs", "path"]).select("variant", "unit", "dirs", F.col("next").alias("path")).distinct()
        frontier = cut(reached.join(seen, ["variant", "unit", "dirs", "path"], "left_anti"), "reads")
        if frontier.isEmpty():
            return seen
        level += 1
        seen = seen.unionByName(frontier)
        if level % 4 == 0:
            seen = cut(seen, "seen")


def with_texts(units: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for every file of every unit: variant, unit, path, content, and its includes as found."""
    edges = cut(graph(sources, units), "graph")
    each = edges.groupBy("variant", "dirs", "path").agg(F.collect_list(F.struct("target", "angled", "found")).alias("includes"))
    rows = reads(units, edges).join(each, ["variant", "dirs", "path"], "left")
    return rows.join(sources.select(*FILE_KEY, "content"), FILE_KEY).drop("dirs")
