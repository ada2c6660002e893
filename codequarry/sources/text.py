"""Source text: lines, ranges within a byte budget, and listings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from codequarry import schema as S
from codequarry.functions import scalars
from codequarry.plans.scratch import cut


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line from 1, value of text files that are read in as many tasks as they have splits.
    Rows of a split are numbered one after another by the engine; what the splits before it hold is
    a running sum over splits."""
    rows = spark.read.text(path, lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    split = ["file_path", "file_block_start"]
    counts = rows.groupBy(*split).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("file_block_start")) - F.col("n")
    found = rows.join(counts.select(*split, "first", before.alias("before")), split)
    return found.select(F.col("file_path").alias("file"), (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def ranged(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` in ranges of group and order, written, with ``part`` (the range) and ``id``, which
    follows the order within a range; ``same_file`` and ``same`` tell whether the row just before it
    in the range and group has its path, and its place, symbol and record (null: there is none)."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    names = ["path", "line", "col", "symbol", "record"]
    columns = dealt.columns
    held = [columns.index(c) for c in (group, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            equal = []
            for k, at in enumerate(held):
                own = batch.column(at)
                before = pa.concat_arrays([pa.nulls(1, own.type) if last is None else last[k], own.slice(0, len(own) - 1)])
                null = pc.and_(pc.is_null(own), pc.is_null(before))
                equal.append(pc.or_(pc.fill_null(pc.equal(own, before), False), null))
            none = pc.invert(equal[0])
            if last is None:
                none = pa.concat_arrays([pa.array([True]), none.slice(1)])
            last = [batch.column(at).slice(len(batch) - 1) for at in held]
            same = reduce(pc.and_, equal[1:])
            both = [pc.if_else(none, pa.scalar(None, pa.bool_()), x) for x in (equal[1], same)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], [*columns, "same_file", "same"])

    schema = StructType([*dealt.schema.fields, StructField("same_file", BooleanType()), StructField("same", BooleanType())])
    out = dealt.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id())
    return cut(out.withColumn("part", F.shiftrightunsigned("id", 33).cast("int")), "ranges")


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``seq`` (from 1, by ``order`` within the group) and ``part``: ranges of group
    and order are numbered where they are, and what the ranges before hold is added, so that no task
    has a whole group."""
    return _numbered(ranged(rows, group, order), group).drop("id", "same_file", "same")


def _numbered(dealt: DataFrame, group: str) -> DataFrame:
    """``seq`` of ranges: a row of each group and range is all that is joined."""
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part")) - F.col("n")
    counts = counts.select(group, "part", (before - F.col("first") + 1).alias("shift"))
    return dealt.join(F.broadcast(counts), [group, "part"]).withColumn("seq", (F.col("id") + F.col("shift")).cast("long")).drop("shift")


def lines(files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line from 1, text without its end."""
    each = files.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("i", "raw"))
    return each.select(id_col, (F.col("i") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("text"))


def line_range(rows: DataFrame, first: int, last: int, budget: int, id_col: str = "doc_id") -> DataFrame:
    """The lines of a range before the one that would exceed the byte budget."""
    own = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.octet_length("text") + 1).over(own)
    return rows.where(F.col("line").between(first, last)).withColumn("used", used).where(F.col("used") <= budget).drop("used")


def dissect(records: DataFrame, order: Sequence[str] = S.RECORD_ORDER[1:]) -> DataFrame:
    """Records of each variant in order, with ``seq``, with ``header`` where the file changes, and
    without uses that repeat the record just before them. A range's first record is held against the
    last one of the range before, which is carried along."""
    rows = ranged(records, "variant", order)
    at = F.struct("path", "line", "col", "symbol", "record")
    last = rows.groupBy("variant", "part").agg(F.max_by(at, "id").alias("last"))
    carried = last.select("variant", "part", F.lag("last").over(Window.partitionBy("variant").orderBy("part")).alias("carried"))
    out = _numbered(rows, "variant").join(F.broadcast(carried), ["variant", "part"])
    before = lambda *names: reduce(and_, (F.col(f"carried.{c}").eqNullSafe(F.col(c)) for c in names)) & F.col("carried").isNotNull()
    same_file = F.coalesce("same_file", before("path"))
    repeats = F.coalesce("same", before("path", "line", "col", "symbol", "record"))
    out = out.withColumn("header", F.when(same_file, 0).otherwise(1))
    return out.where((F.col("record") == S.SYMBOL) | ~repeats).drop("id", "same", "same_file", "carried", "part")


def listing(dissected: DataFrame) -> DataFrame:
    """``text`` of each listed record, behind its file's heading where the file changes; ``type``
    may give what is declared."""
    action = F.when(F.col("record") == S.USE, scalars.mode_string(F.col("mode"))).when(F.col("action") == S.DEFINITION, "def").otherwise("decl")
    own = F.when(F.col("local") == 1, ".").otherwise(" ")
    kind = scalars.kind_char(F.col("kind"))
    line = F.format_string("%4d:%-3d %-16s %s %s %s ", "line", "col", "context", action, own, kind)
    name = F.col("symbol")
    if "type" in dissected.columns:
        wide = F.when(F.length("symbol") < 32, F.rpad("symbol", 32, " ")).otherwise(name)
        name = F.when(F.coalesce(F.col("type"), F.lit("")) == "", name).otherwise(F.concat(wide, F.lit(" "), F.col("type")))
    heading = F.when(F.col("header") == 1, F.concat(F.lit("\nFILE: "), "path", F.lit("\n\n"))).otherwise("")
    return dissected.withColumn("text", F.concat(heading, line, name))
