"""Index documents (version 1) and compile commands as tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry import schema as S
from codequarry.functions.scalars import id_from_hex, id_hex, kind_name, leaf_name, mode_string, qualified_name

_SYMBOL = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "owner", "type", "usr", "usr_id", "context", "file")] + [T.StructField(n, T.LongType()) for n in ("line", "column")] + [T.StructField(n, T.BooleanType()) for n in ("local", "definition")])
_USE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "symbol_kind", "mode", "name", "owner", "type", "usr", "usr_id", "context", "context_usr", "context_usr_id", "file")]
    + [T.StructField(n, T.LongType()) for n in ("mode_bits", "line", "column")]
    + [T.StructField("local", T.BooleanType())]
)
DOCUMENT = T.StructType([T.StructField("version", T.LongType()), T.StructField("symbols", T.ArrayType(_SYMBOL)), T.StructField("uses", T.ArrayType(_USE))])
_ACTIONS = ["read", "write", "address", "call"]


def _code(name, names: list[str]):
    return (F.array_position(F.array(*map(F.lit, names)), name) - 1).cast("int")


def records(documents: DataFrame, variant: str) -> DataFrame:
    """Record rows with ``seq``, symbols before uses, from rows of DOCUMENT."""
    kinds = F.when(F.col("s.kind") == "var", "variable").otherwise(F.col("s.kind"))
    common = [F.col("s.file").alias("path"), F.col("s.line").alias("line"), F.col("s.column").alias("col"), F.coalesce("s.context", F.lit("")).alias("context"), F.col("s.local").cast("int").alias("local")]
    name = qualified_name(F.col("s.owner"), F.col("s.name")).alias("symbol")
    symbols = documents.select(F.posexplode("symbols").alias("seq", "s")).select("seq", name, F.lit(S.SYMBOL).alias("record"), F.col("s.definition").cast("int").alias("action"), _code(kinds, S.KIND_NAMES).alias("kind"), F.lit(0).alias("mode"), *common, id_from_hex(F.col("s.usr_id")).alias("usr_id"), F.lit(None).cast("long").alias("context_usr_id"))
    kinds = F.when(F.col("s.symbol_kind") == "var", "variable").otherwise(F.col("s.symbol_kind"))
    uses = documents.select(F.posexplode("uses").alias("seq", "s")).select((F.col("seq") + (1 << 40)).alias("seq"), name, F.lit(S.USE).alias("record"), _code(F.col("s.kind"), _ACTIONS).alias("action"), _code(kinds, S.KIND_NAMES).alias("kind"), F.col("s.mode_bits").cast("int").alias("mode"), *common, id_from_hex(F.col("s.usr_id")).alias("usr_id"), id_from_hex(F.col("s.context_usr_id")).alias("context_usr_id"))
    return symbols.withColumn("seq", F.col("seq").cast("long")).unionByName(uses).withColumn("variant", F.lit(variant))


def read(spark: SparkSession, path: str, variant: str) -> DataFrame:
    documents = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    if not documents.where(~F.col("version").eqNullSafe(F.lit(1))).isEmpty():
        raise ValueError("index document version is not 1")
    return records(documents, variant)


COMPILE_COMMAND = T.StructType([T.StructField("directory", T.StringType()), T.StructField("file", T.StringType()), T.StructField("arguments", T.ArrayType(T.StringType()))])


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """Commands with their place in the file, for the first of a file to win."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", T.ArrayType(COMPILE_COMMAND))).alias("seq", "c")).select("seq", "c.*")


def export_commands(commands: DataFrame, variant: str) -> DataFrame:
    """One JSON object a row, by file."""
    own = commands.where(F.col("variant") == variant)
    return own.select("file", F.to_json(F.struct("directory", "file", "arguments")).alias("json")).orderBy("file")


def export_lines(commands: DataFrame, variant: str) -> DataFrame:
    """``value``: the lines of a whole compile_commands.json, in their order. There is one command a
    translation unit, so that one task can number them."""
    every = Window.orderBy("file")
    rows = export_commands(commands, variant).withColumns({"n": F.row_number().over(every), "after": F.lead("file").over(every)})
    lines = rows.select("n", F.concat("json", F.when(F.col("after").isNull(), "").otherwise(",")).alias("value"))
    ends = commands.sparkSession.createDataFrame([(0, "["), ((1 << 31) - 1, "]")], "n int, value string")
    return lines.unionByName(ends).orderBy("n").select("value")


def to_documents(records: DataFrame) -> DataFrame:
    """path and json: an index document for each file of record rows."""
    named = lambda x: F.when(x == "variable", "var").otherwise(x)
    leaf, owner = leaf_name(F.col("symbol")), F.regexp_extract("symbol", r"^(.*)\.[^.]*$", 1)
    owned = F.when(owner != "", owner)
    common = [leaf.alias("name"), owned.alias("owner"), F.when(F.col("usr_id").isNotNull(), id_hex(F.col("usr_id"))).alias("usr_id"), F.col("context"), F.col("path").alias("file"), "line", F.col("col").alias("column"), (F.col("local") == 1).alias("local")]
    symbol = F.struct(named(kind_name(F.col("kind"))).alias("kind"), *common, (F.col("action") == S.DEFINITION).alias("definition"))
    use = F.struct(_lookup_action().alias("kind"), named(kind_name(F.col("kind"))).alias("symbol_kind"), mode_string(F.col("mode")).alias("mode"), F.col("mode").alias("mode_bits"), *common, F.when(F.col("context_usr_id").isNotNull(), id_hex(F.col("context_usr_id"))).alias("context_usr_id"))
    place = [F.col(c) for c in ("line", "col", "symbol", "kind", "mode")]
    of = lambda record, row: F.transform(F.array_sort(F.collect_list(F.when(F.col("record") == record, F.struct(*place, row.alias("row"))))), lambda x: x["row"])
    own = records.groupBy("path").agg(of(S.SYMBOL, symbol).alias("symbols"), of(S.USE, use).alias("uses"))
    return own.select("path", F.to_json(F.struct(F.lit(1).alias("version"), "symbols", "uses")).alias("json"))


def _lookup_action():
    return F.element_at(F.array(*map(F.lit, _ACTIONS)), F.col("action") + 1)
