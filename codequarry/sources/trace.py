"""Indexing traces: a strict JSON-lines reader, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.schema import TRACE
from codequarry.sources.text import numbered

NEEDED, COUNTERS = TRACE.names[:6], TRACE.names[6:]


def checked(text: DataFrame) -> DataFrame:
    """The trace columns, with ``valid`` for lines of exactly the known keys, once each, with
    non-negative whole numbers and non-empty strings."""
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    row = F.from_json("value", TRACE)
    raw = F.from_json("value", "map<string,string>")
    plain = F.array_sort(keys) == F.array(*map(F.lit, sorted(NEEDED)))
    counted = F.array_sort(keys) == F.array(*map(F.lit, sorted([*NEEDED, *COUNTERS])))
    whole = [F.coalesce(raw[c].rlike("^[0-9]+$") & ~F.col("value").rlike(f'"{c}"\\s*:\\s*"'), F.lit(False)) for c in ("pid", "start_ns", "duration_ns")]
    counts = [plain | F.coalesce(raw[c].rlike("^[0-9]+$"), F.lit(False)) for c in COUNTERS]
    words = [F.coalesce(F.length(raw[c]) > 0, F.lit(False)) & F.col("value").rlike(f'"{c}"\\s*:\\s*"') for c in ("command", "source", "phase")]
    valid = plain | counted
    for test in (*whole, *counts, *words):
        valid = valid & test
    return text.select("file", "line", F.coalesce(valid, F.lit(False)).alias("valid"), row.alias("r")).select("file", "line", "valid", "r.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a trace; a bad line fails with its number."""
    found = checked(numbered(spark, path))
    bad = found.where(~F.col("valid")).agg(F.min(F.struct("file", "line"))).first()[0]
    if bad is not None:
        raise ValueError(f"{bad['file']}: line {bad['line']} is malformed")
    # once all lines are good their numbers aren't needed
    return checked(spark.read.text(path, lineSep="\n").select(F.lit("").alias("file"), F.lit(0).alias("line"), "value")).select(*TRACE.names)


def phase_stats(trace: DataFrame) -> DataFrame:
    return trace.groupBy("phase").agg(
        F.count("*").alias("n"), F.sum("duration_ns").alias("total_ns"), F.max("duration_ns").alias("max_ns"), F.count("items_in").alias("counted"), F.coalesce(F.sum("items_in"), F.lit(0)).alias("items_in"), F.coalesce(F.sum("items_out"), F.lit(0)).alias("items_out")
    )


def distincts(trace: DataFrame) -> DataFrame:
    return trace.agg(F.countDistinct("pid").alias("processes"), F.countDistinct("command", "source").alias("units"))


def span(trace: DataFrame) -> DataFrame:
    return trace.agg(F.min("start_ns").alias("start_ns"), F.max(F.col("start_ns") + F.col("duration_ns")).alias("end_ns"))


def shares(trace: DataFrame) -> DataFrame:
    """Each phase's share of the whole in thousandths of a percent, 0 if there is no whole."""
    every = Window.partitionBy()  # over the phases, a handful
    whole = F.coalesce(F.sum(F.when(F.col("phase") == "total", F.col("total_ns"))).over(every), F.lit(0))
    out = phase_stats(trace).select("phase", "total_ns", whole.alias("whole"))
    return out.select("phase", "total_ns", F.coalesce(F.expr("total_ns * 100000 div nullif(whole, 0)"), F.lit(0)).alias("share"))


def record_flow(trace: DataFrame) -> DataFrame:
    def of(phase: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col(column))), F.lit(0))

    staged_in, staged = of("db.stage_records", "items_in"), of("db.stage_records", "items_out")
    inserted = of("db.merge.records_insert", "items_out")
    return trace.agg(staged_in.alias("staged_in"), staged.alias("staged"), inserted.alias("inserted"), of("db.merge.begin", "duration_ns").alias("lock_ns"), F.greatest(F.lit(0), staged_in - staged - inserted).alias("late_matches"))


def slowest(trace: DataFrame, k: int = 20) -> DataFrame:
    order = ["duration_ns", "pid", "command", "source"]
    return trace.where("phase = 'total'").select(*order, "start_ns").orderBy(*(F.desc(c) for c in [*order, "start_ns"])).limit(k)


def medians(trace: DataFrame) -> DataFrame:
    return trace.groupBy("phase").agg(F.count("*").alias("n"), F.expr("percentile(duration_ns, 0.5)").alias("median_ns"))


def phases_by_total(trace: DataFrame) -> DataFrame:
    """Phase statistics, the dearest first; of equal ones that seen first."""
    first = trace.groupBy("phase").agg(F.min("start_ns").alias("first_ns"))
    return phase_stats(trace).join(first, "phase").orderBy(F.desc("total_ns"), "first_ns", "phase").drop("first_ns")


def fingerprint_cache(trace: DataFrame) -> DataFrame:
    """Files whose fingerprints were looked at and those taken from the cache."""
    own = F.col("phase") == "fingerprint"
    total = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0))
    return trace.agg(total("items_in").alias("examined"), total("items_out").alias("reused"))


def points_to_summary(constraints: DataFrame) -> DataFrame:
    """Counts of function-pointer constraints: rows of kind (callsite, identified, direct or copy),
    pointer and target."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    named = F.when(F.col("kind").isin("direct", "copy"), F.col("pointer"))
    return constraints.agg(
        of("callsite").alias("callsites"), of("identified").alias("identified"), of("direct").alias("direct"), of("copy").alias("copies"),
        F.countDistinct(named).alias("pointers"), F.countDistinct(F.when(F.col("kind") == "direct", F.col("target"))).alias("functions"),
    )


def to_lines(trace: DataFrame) -> DataFrame:
    """``value``: a JSON line for each row, without counters that it hasn't, to be appended as text."""
    return trace.select(F.to_json(F.struct(*TRACE.names), {"ignoreNullFields": "true"}).alias("value"))
