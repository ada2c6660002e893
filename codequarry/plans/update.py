"""From sources to a new version of the index: units are read, those that may be kept are merged.

Failures are rows, not exceptions: each unit has a status (clean, partial with diagnostics, failed)
and the stage that failed. The policy says what becomes of partial units: "store" merges them,
"return" leaves the index as it is for them and gives their tables back, for an overlay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.operators import merge
from codequarry.plans.catalog import IndexStore
from codequarry.sources import extract

STORE, RETURN = "store", "return"


@dataclass
class Update:
    #: The version that holds the units, or None if nothing was stored.
    version: int | None
    #: variant, unit, status, stage (of the failure, or null), stored.
    units: DataFrame
    diagnostics: DataFrame
    #: Rows that came in and rows that were added, by table.
    counters: dict[str, int]
    #: With the policy "return": the tables of the partial units.
    partial: dict[str, DataFrame] | None = None


def update(
    store: IndexStore,
    sources: DataFrame,
    units: DataFrame,
    commands: DataFrame | None = None,
    policy: str = STORE,
    variants: DataFrame | None = None,
    scope: str = "project",
    details: bool = True,
    include_local: bool = True,
    output_only: bool = False,
    tries: int = 3,
) -> Update:
    """Index ``units`` (variant, path) of ``sources`` (variant, path, content; mtime_ns and size if
    known) by the first of their ``commands`` (variant, file, directory, arguments, seq), which are
    stored along with ``variants`` (their provenance). A writer that finds another version than the
    one it merged with merges again, up to ``tries`` times; units aren't read again for that.

    Units that aren't in ``sources`` fail; without any unit that may be kept no version is made.
    """
    if policy not in (STORE, RETURN):
        raise ValueError("policy is store or return")
    asked = units.select("variant", F.col("path").alias("unit")).distinct()
    wide = extract.read_units(sources, units, commands, scope, partial=policy == STORE)
    found = asked.join(wide.where("what = 'status'").select("variant", "unit", F.col("name").alias("status")), ["variant", "unit"], "left")
    failed = F.coalesce("status", F.lit("failed"))
    keeps = failed == "clean" if policy == RETURN else failed != "failed"
    state = found.select("variant", "unit", failed.alias("status"), F.when(failed == "failed", "frontend").alias("stage"), (keeps & F.lit(not output_only)).alias("stored"))
    every = extract.tables(wide, details)
    out = Update(None, state, every["diagnostics"], {})
    if policy == RETURN:
        out.partial = extract.tables(wide.join(state.where("status = 'partial'"), ["variant", "unit"], "left_semi"), details)
    if output_only or state.where("stored").isEmpty():
        return out
    staged = _staged(wide, state, sources, commands, details, include_local)
    if variants is not None:
        staged["variants"] = variants.select(*S.VARIANTS.names)
    for turn in range(tries):
        try:
            out.version = store.store(staged)
            break
        except OSError:
            if turn + 1 == tries:
                out.units = state.withColumn("stage", F.when(F.col("stored"), "symbol_database").otherwise(F.col("stage"))).withColumn("stored", F.lit(False))
                return out
    out.counters = {f"{name}_in": staged[name].count() for name in ("records", "symbol_types", "function_types")} | store.added(out.version)
    return out


def _staged(wide: DataFrame, state: DataFrame, sources: DataFrame, commands: DataFrame | None, details: bool, include_local: bool) -> dict[str, DataFrame]:
    """The tables of the units that are kept."""
    kept = state.where("stored").select("variant", "unit")
    own = extract.tables(wide.join(kept, ["variant", "unit"], "left_semi"), details)
    records = own["records"] if include_local else own["records"].where("local = 0")
    size = F.col("size") if "size" in sources.columns else F.octet_length(F.coalesce("content", F.lit("")))
    time = F.col("mtime_ns") if "mtime_ns" in sources.columns else F.lit(0)
    stats = sources.groupBy("variant", "path").agg(F.max(time.cast("long")).alias("mtime_ns"), F.max(size.cast("long")).alias("size"))
    mains = kept.select("variant", F.col("unit").alias("path"), F.lit(1).alias("is_main"))
    files = own["files"].select("variant", "path").unionByName(mains.select("variant", "path")).distinct()
    files = files.join(stats, merge.FILE_KEY).join(mains, merge.FILE_KEY, "left").withColumn("is_main", F.coalesce("is_main", F.lit(0)))
    prints = merge.file_fingerprints(records.select(*S.RECORDS.names))
    both = prints.select(*merge.FILE_KEY, F.explode(F.array_distinct(F.array("all_records", "non_local"))).alias("fingerprint"))
    out = {"files": files, "records": records, "symbol_types": own["symbol_types"], "function_types": own["function_types"], "file_fingerprints": both}
    if commands is not None:
        first = merge.keep_first(commands, ["variant", "file"], ["seq"]).join(mains.select("variant", F.col("path").alias("file")), ["variant", "file"], "left_semi")
        out["commands"] = first.select(*S.COMMANDS.names)
    return out


def reindex(store: IndexStore, sources: DataFrame, variant: str, path: str, policy: str = STORE) -> Update:
    """One unit again, by the command that the index has of it."""
    units = sources.where((F.col("variant") == variant) & (F.col("path") == path)).select("variant", "path").distinct()
    saved = store.table("commands").where((F.col("variant") == variant) & (F.col("file") == path)).withColumn("seq", F.lit(0))
    return update(store, sources.where(F.col("variant") == variant), units, None if saved.isEmpty() else saved, policy)
