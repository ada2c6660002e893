"""Staging and merging of indexed files as set operations.

First writer wins: rows carry an explicit sequence, and of rows with one key the first stays.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.operators.search import first_by

FILE_KEY = ["variant", "path"]


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return first_by(rows, [F.col(c) for c in key], [F.col(c) if isinstance(c, str) else c for c in order])


def flatten_signatures(signatures: DataFrame) -> DataFrame:
    """One row of position -1 for what a function returns, one a parameter.
    signatures: variant, path, symbol, usr_id, returns, variadic, parameters (array of name, declared_type)."""
    base = ["variant", "path", "symbol", "usr_id"]
    own = signatures.where((F.col("symbol") != "") & (F.coalesce("usr_id", F.lit(0)) != 0))
    returned = own.select(*base, F.lit(-1).alias("position"), F.lit("").alias("name"), F.col("returns").alias("declared_type"), "variadic")
    each = own.select(*base, F.posexplode("parameters").alias("position", "p"))
    return returned.unionByName(each.select(*base, "position", "p.name", "p.declared_type", F.lit(0).alias("variadic")))


def mark_cached(staged: DataFrame, files: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Staged files with ``cached``: headers whose stored file has the same time, size and fingerprint."""
    stored = files.join(fingerprints, FILE_KEY).select(*FILE_KEY, "mtime_ns", "size", "fingerprint").distinct().withColumn("cached", F.lit(1))
    found = staged.join(stored, [*FILE_KEY, "mtime_ns", "size", "fingerprint"], "left")
    return found.withColumn("cached", F.when((F.col("is_main") == 0) & (F.col("mtime_ns") != 0), F.coalesce("cached", F.lit(0))).otherwise(F.lit(0)))


def cache_hits(staged: DataFrame, files: DataFrame) -> DataFrame:
    return staged.where((F.col("is_main") == 0) & (F.col("mtime_ns") != 0)).join(files, [*FILE_KEY, "mtime_ns", "size"], "left_semi")


def stale(staged: DataFrame, files: DataFrame) -> DataFrame:
    """Headers that are not as stored: what was taken for cached must be staged again."""
    return staged.where(F.col("is_main") == 0).join(files, [*FILE_KEY, "mtime_ns", "size"], "left_anti")


def inserted_files(files: DataFrame, staged: DataFrame) -> DataFrame:
    return staged.join(files, FILE_KEY, "left_anti")


def replaced_files(files: DataFrame, staged: DataFrame) -> DataFrame:
    """Stored files whose rows go: main ones, and those of another time or size."""
    new = staged.select(*FILE_KEY, "is_main", F.col("mtime_ns").alias("m2"), F.col("size").alias("s2"))
    changed = (F.col("is_main") == 1) | (F.col("mtime_ns") != F.col("m2")) | (F.col("size") != F.col("s2"))
    return files.join(new, FILE_KEY).where(changed).select(*files.columns)


def upserted_files(files: DataFrame, staged: DataFrame) -> DataFrame:
    new = staged.select(*FILE_KEY, F.col("mtime_ns").alias("m2"), F.col("size").alias("s2"))
    return files.join(new, FILE_KEY, "full").select(*FILE_KEY, F.coalesce("m2", "mtime_ns").alias("mtime_ns"), F.coalesce("s2", "size").alias("size"))


def fresh_rows(base: DataFrame, staged: DataFrame, replaced: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Staged rows whose key no row that stays has. Of staged rows with one key the first by
    ``order`` stays, which without one is that of all other columns."""
    fresh = keep_first(staged, key, order or sorted(c for c in staged.columns if c not in key) or list(key)).select(*base.columns)
    kept = base.join(replaced.select(*FILE_KEY), FILE_KEY, "left_anti")
    return fresh.join(kept.select(*key), list(key), "left_anti").select(*base.columns)


def merged_rows(base: DataFrame, staged: DataFrame, replaced: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Base rows but those of replaced files, and the fresh ones. Both sides are dealt by file once:
    before a staged row of a key stand the base rows that have it. Keys with a null equal no other."""
    order = order or sorted(c for c in staged.columns if c not in key) or list(key)
    both = base.withColumn("_staged", F.lit(0)).unionByName(staged.withColumn("_staged", F.lit(1)), allowMissingColumns=True)
    gone = replaced.select(*FILE_KEY).distinct().withColumn("_gone", F.lit(1))
    rows = both.repartition(*FILE_KEY).join(gone, FILE_KEY, "left").where((F.col("_staged") == 1) | F.col("_gone").isNull())
    holes = F.when(reduce(or_, (F.col(c).isNull() for c in key)), F.col("_staged")).otherwise(-1)
    own = Window.partitionBy(*key, holes).orderBy("_staged", *order)
    return rows.withColumn("_n", F.row_number().over(own)).where((F.col("_staged") == 0) | (F.col("_n") == 1)).select(*base.columns)


def upserted_variants(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values that are not null win."""
    fresh = new.select("name", F.col("git_commit").alias("c2"), F.col("repository_root").alias("r2"))
    return old.join(fresh, "name", "full").select("name", F.coalesce("c2", "git_commit").alias("git_commit"), F.coalesce("r2", "repository_root").alias("repository_root"))


def variant_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Variants of which a value that is not null differs."""
    fresh = new.select("name", F.col("git_commit").alias("c2"), F.col("repository_root").alias("r2"))
    differs = (F.col("c2").isNotNull() & ~F.col("c2").eqNullSafe(F.col("git_commit"))) | (F.col("r2").isNotNull() & ~F.col("r2").eqNullSafe(F.col("repository_root")))
    return fresh.join(old, "name", "left").where(differs).select("name")


def merge(base: dict[str, DataFrame], staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The new state of every table from the stored and the staged one. staged["files"] also has is_main."""
    replaced = replaced_files(base["files"], staged["files"])
    out = {"files": upserted_files(base["files"], staged["files"])}
    for name in ("records", "symbol_types", "function_types", "file_fingerprints"):
        if name in staged:
            out[name] = merged_rows(base[name], staged[name], replaced, S.KEYS[name], ["seq"] if "seq" in staged[name].columns else ())
        elif name in base:
            out[name] = base[name].join(replaced.select(*FILE_KEY), FILE_KEY, "left_anti")
    if "variants" in base:
        out["variants"] = upserted_variants(base["variants"], staged["variants"]) if "variants" in staged else base["variants"]
    return out


def file_fingerprints(records: DataFrame) -> DataFrame:
    """SHA-256 of each file's records in the record order, of all and of the non-local ones. Records
    are hashed where their file's rows meet, so that its group holds digests and places only."""
    fields = [c for c in S.RECORD_COLUMNS if c not in FILE_KEY]
    order = [c for c in S.RECORD_ORDER if c not in FILE_KEY]
    text = F.concat_ws("|", *(F.concat(F.octet_length(v), F.lit(":"), v) for v in (F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in fields)))
    # the rows are smaller to move than their digests, which don't compress
    own = records.repartition(*FILE_KEY).select(*FILE_KEY, "local", F.struct(*order, F.sha2(text, 256).alias("d")).alias("r"))
    join = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["d"]), ","), 256)
    return own.groupBy(*FILE_KEY).agg(join(F.col("r")).alias("all_records"), join(F.when(F.col("local") == 0, F.col("r"))).alias("non_local"))


def resolve_command(saved: DataFrame, compile_commands: DataFrame, files: DataFrame) -> DataFrame:
    """For each (variant, file): the saved command, else the first of compile_commands, else a fallback."""
    first = keep_first(compile_commands, ["file"], ["seq"]).select("file", F.col("arguments").alias("listed"))
    out = files.join(saved.select("variant", "file", F.col("arguments").alias("saved")), ["variant", "file"], "left").join(first, "file", "left")
    fallback = F.concat(F.lit("cc|--no-default-config|-I|"), F.regexp_replace("file", "/[^/]*$", ""), F.lit("|"), "file")
    origin = F.when(F.col("saved").isNotNull(), "saved").when(F.col("listed").isNotNull(), "compile_commands").otherwise("fallback")
    return out.select("variant", "file", F.coalesce("saved", "listed", fallback).alias("arguments"), origin.alias("origin"))


def drift(indexed: DataFrame, present: DataFrame, asked: DataFrame) -> DataFrame:
    """NotIndexed, Missing, Drifted or Current for each asked (variant, path)."""
    now = present.select("path", F.col("mtime_ns").alias("m2"), F.col("size").alias("s2"))
    out = asked.join(indexed, FILE_KEY, "left").join(now, "path", "left")
    status = F.when(F.col("mtime_ns").isNull(), "NotIndexed").when(F.col("m2").isNull(), "Missing").when((F.col("mtime_ns") != F.col("m2")) | (F.col("size") != F.col("s2")), "Drifted").otherwise("Current")
    return out.select(*FILE_KEY, status.alias("status"))
