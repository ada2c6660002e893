"""Benchmark decontamination with built-in functions only.

Words are runs of digits, a-z and code points from U+0080, after A-Z are lower-cased. Windows
are 10 consecutive item words (the whole item if it is shorter). Hashes of all windows of a
document are looked up in a broadcast hash table of benchmark windows, every hit is verified
against the words, and the words inside hits are counted, or removed together with the text
between them, or the document is dropped.

Benchmark windows of more than BROADCAST_BYTES are dealt by hash into slices of about that size,
each broadcast in its own pass. A document's hits meet in one group, bounded by its length.
Defined results: null texts have no words; items without words have no window; rows repeated with
the same id and text give the same result each; a null item_id is not listed; empty tables give no
rows, an empty benchmark no hits; very long texts are read whole; other columns are left out by
``report`` and kept by ``remove_spans`` and ``drop_documents``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, once

WINDOW = 10
#: Bytes of the benchmark's windows that are broadcast at once.
BROADCAST_BYTES = 48_000_000
BROADCAST_NUMBERS = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, size, hash, window (array of words) of every distinct benchmark window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.explode(F.array(words(F.col(text_col)))).alias("w")).where(F.size("w") > 0)
    cut = items.withColumn("size", F.least(F.size("w"), F.lit(WINDOW))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    return cut.select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("window")).distinct().withColumn("hash", F.xxhash64("window"))


def hits(documents: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (id, text): id, text_hash, n_rows, n_words, spans (array of
    start, size in words, distinct) and items (sorted item ids as strings)."""
    sizes = [r[0] for r in windows.select("size").distinct().orderBy("size").collect()]  # WINDOW values at most
    size = windows.agg(F.coalesce(F.sum(F.octet_length(F.array_join("window", "")) + 24 * F.col("size") + 64), F.lit(0))).first()[0]
    slices = max(1, -(-size // BROADCAST_BYTES))
    lookup = windows.select("item_id", F.col("size").alias("w_size"), "window", "hash")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.explode(F.array(words(F.col(text_col)))).alias("w"))

    def of_size(w: Column, s: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - s + 1, F.lit(1)))
        return F.when(F.size(w) >= s, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, s)))).otherwise(F.array().cast("array<bigint>"))

    def hashes(w: Column) -> Column:
        return F.concat(F.array(F.lit(0).cast("bigint")), *(of_size(w, s) for s in sizes))

    scan = docs.select("doc_id", "text_hash", "w", F.posexplode(once(F.col("w"), hashes)).alias("k", "hash"))
    # where window k starts and how long it is: windows are listed by size
    start, size, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for s in sizes:
        count = F.greatest(F.size("w") - s + 1, F.lit(0))
        here = (F.col("k") > before) & (F.col("k") <= before + count)
        start, size, before = F.when(here, F.col("k") - before).otherwise(start), F.when(here, F.lit(s)).otherwise(size), before + count
    mark = F.col("k") == 0
    parts = []
    for part in range(slices):
        own = lookup.where(F.pmod(F.col("hash"), F.lit(slices)) == part) if slices > 1 else lookup
        nothing = own.sparkSession.range(1).select(F.lit(None).cast("string").alias("item_id"), F.lit(0).alias("w_size"), F.array().cast("array<string>").alias("window"), F.lit(0).cast("bigint").alias("hash"))
        found = scan.join(F.broadcast(own.unionByName(nothing)), "hash")
        real = ~mark & (F.col("w_size") == size) & (F.slice("w", F.greatest(start, F.lit(1)), F.greatest(F.col("w_size"), F.lit(1))) == F.col("window"))
        parts.append(
            found.where((mark & (F.col("w_size") == 0)) | real).select(
                "doc_id", "text_hash", F.when(mark, F.size("w")).alias("n_words"), F.when(~mark, start).alias("start"), F.when(~mark, F.col("w_size")).alias("size"), "item_id", (mark & F.lit(part == 0)).cast("long").alias("row")
            )
        )
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_hash").agg(
        F.sum("row").alias("n_rows"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "size"))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )


def hit_positions(spans: Column) -> Column:
    """The distinct word positions inside the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of every document row."""
    found = hits(documents, benchmark_windows(benchmark))
    return found.select(
        "doc_id",
        "n_words",
        F.size(hit_positions(F.col("spans"))).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("copy"),
    ).drop("copy")


def remove_spans(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents without the contaminated passages, all columns kept: from the first to the
    last character of each run of hit words. Texts without a hit stay as they are."""
    own_id, own_hash, key, new, first, last = (fresh(documents, x) for x in ("hit_id", "hit_hash", "text_hash", "new_text", "run_first", "run_last"))
    found = hits(documents, benchmark_windows(benchmark), id_col, text_col).where(F.size("spans") > 0)
    found = found.select("doc_id", "text_hash", F.sort_array(hit_positions(F.col("spans"))).alias("hit"))
    # a run begins where the word before is not hit, and ends where the next one is not
    begins = F.filter("hit", lambda x, i: F.coalesce(F.get("hit", i - 1) != x - 1, F.lit(True)))
    ends = F.filter("hit", lambda x, i: F.coalesce(F.get("hit", i + 1) != x + 1, F.lit(True)))
    runs = materialize(found.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), begins.alias(first), ends.alias(last)), "hits")
    # 4 bytes a number, broadcast up to BROADCAST_NUMBERS
    few = runs.agg(F.coalesce(F.sum(2 * F.size(first) + 16), F.lit(0))).first()[0] <= BROADCAST_NUMBERS
    runs = F.broadcast(runs) if few else runs
    joined = documents.withColumn(key, F.xxhash64(text_col)).join(runs, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_hash)), "left")

    def cut(text: Column) -> Column:
        # words and what is between them, in turns
        parts = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)

        def keep(p: Column) -> Column:
            lead = F.when(F.element_at(p, 1).rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
            piece = lambda word: lead + 2 * word - 1  # noqa: E731  where a word stands, both from 1

            def gap(k: Column) -> Column:  # what stays before run k, or behind the last one
                start = F.coalesce(piece(F.get(last, k - 1)) + 1, F.lit(1))
                return F.slice(p, start, F.coalesce(piece(F.get(first, k)), F.size(p) + 1) - start)

            return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(first)), gap)), "")

        return once(parts, keep)

    hit = F.col(own_hash).isNotNull()
    out = joined.withColumn(new, F.when(hit, cut(F.col(text_col))).otherwise(F.col(text_col)))
    if length_col in documents.columns:
        out = out.withColumn(length_col, F.when(hit, F.length(new).cast(documents.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.withColumn(text_col, F.col(new)).select(*documents.columns)


def drop_documents(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.0) -> DataFrame:
    """The documents of which no more than ``least_share`` of the words is hit."""
    own_id, own_hash, key = (fresh(documents, x) for x in ("hit_id", "hit_hash", "text_hash"))
    found = hits(documents, benchmark_windows(benchmark), id_col, text_col).where(F.size(hit_positions(F.col("spans"))) > F.lit(least_share) * F.col("n_words"))
    bad = found.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    keyed = documents.withColumn(key, F.xxhash64(text_col))
    return keyed.join(bad, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_hash)), "left_anti").drop(key)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 10) AS size, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p0, w FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, size, array_to_string(w[p0 : p0 + size - 1], ' ') AS win FROM i),
p AS (SELECT rid, size, unnest(generate_series(1, len(w) - size + 1)) AS p0, w FROM d, (SELECT DISTINCT size FROM t) WHERE len(w) >= size),
q AS (SELECT rid, size, p0, array_to_string(w[p0 : p0 + size - 1], ' ') AS win FROM p),
h AS (SELECT rid, item_id, q.size, p0 FROM q JOIN t ON q.win = t.win AND q.size = t.size),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(generate_series(p0, p0 + size - 1)) AS pos FROM h) GROUP BY rid),
g AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN g USING (rid)
"""
