"""Audit of how filters interact, over Walsh-Hadamard sums.

Every document has a mask of the filters that it fails. Per part and label only signed sums are
gathered: for each of the 32 sets of filters, documents count +1 or -1 by the parity of what they
fail of the set. The transform is its own inverse up to the factor 32, so that the numbers of
documents by mask come back exactly, and every order of the filters is evaluated from these 32
numbers. A document that fails k filters is removed by each of them in 120 / k of the 120 orders,
which gives the Shapley value in closed form.

The fifth filter asks whether a smaller id has the same text. Rows are gathered by id first and by
digest then (SHA-256), counts only, so that a large group of copies is a few rows after the
partial aggregation.

Defined results: null text is the empty text, null lang the empty string; a row with a null id has
no label, is no copy and makes none; labels of one id given repeatedly hold if any of them does;
rows repeated with one id count each, and the smallest id's rows are not copies of one another;
very long texts are read whole; empty tables give no rows; other columns are left out, whatever
their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 3
SIGNS = "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
MASKS = 1 << len(FILTERS)


def own_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITAL_PERCENT * F.length(text).cast("long"),
        text.rlike(SIGNS),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, good, toxic, own (mask of A to D), first (rows that are no copies), n (all rows): a row
    for every digest, part and label."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), own_failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("id", "part", "own", "digest").agg(F.count("*").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    # null ids find no label; the second key deals them out
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))
    marks = marks.withColumn("spread", F.lit(0).cast("long"))
    rows = rows.join(marks, ["id", "spread"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    named = F.col("id").isNotNull()
    rows = rows.groupBy("digest", "own", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(~named, F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(named, F.struct("id", "n"))).alias("least")
    )
    lowest = F.min("least.id").over(Window.partitionBy("digest"))
    first = F.col("nameless") + F.when(F.col("least.id") == lowest, F.col("least.n")).otherwise(0)
    return rows.select("part", "good", "toxic", "own", first.alias("first"), "n")


def parity_sums(counted: DataFrame) -> DataFrame:
    """part, and the MASKS signed sums of all, good and toxic documents, as arrays."""
    sums = []
    for s in range(MASKS):
        # documents that fail the last filter have the other sign in sets that hold it
        n = 2 * F.col("first") - F.col("n") if s & COPY else F.col("n")
        sums.append(F.sum(F.when(F.bit_count(F.col("own").bitwiseAND(s)) % 2 == 0, n).otherwise(-n)))
    by = counted.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("w"))
    labels = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    out = by.groupBy("part").agg(*(F.sum(F.when(on, F.col("w")[s]).otherwise(0)).alias(f"{name}{s}") for name, on in labels.items() for s in range(MASKS)))
    return out.select("part", *(F.array(*(f"{name}{s}" for s in range(MASKS))).alias(name) for name in labels))


def _selections() -> tuple[list[str], dict[str, np.ndarray]]:
    """The filter orders, and for each (order, step) the masks that count in each column."""
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    bit = {c: 1 << i for i, c in enumerate(FILTERS)}
    cells = np.arange(MASKS)
    before = np.array([sum(bit[c] for c in o[:k]) for o in orders for k in range(len(FILTERS))])[:, None]
    own = np.array([bit[c] for o in orders for c in o])[:, None]
    fails, gone = (cells & own) > 0, (cells & before) > 0
    k = np.array([max(1, int(c).bit_count()) for c in cells])
    return orders, {
        "kept": ~fails & ~gone,
        "removed": fails & ~gone,
        "redundant": fails & gone,
        "unique_fails": cells == own,
        "shapley": fails * (len(orders) // k),
    }


def interactions(sums: DataFrame) -> DataFrame:
    """The rows of every order and step of each part, from its parity sums."""
    orders, select = _selections()
    sign = np.array([[1 - 2 * ((a & b).bit_count() % 2) for a in range(MASKS)] for b in range(MASKS)], np.int64)

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for part, *by in zip(*(batch.column(c).to_pylist() for c in ("part", "every", "good", "toxic")), strict=True):
            every, good, toxic = (sign @ np.array(w, np.int64) // MASKS for w in by)
            own = {name: which @ every for name, which in select.items()}
            own |= {"good_lost": select["removed"] @ good, "toxic_lost": select["removed"] @ toxic}
            n = len(orders) * len(FILTERS)
            first = {"part": [part] * n, "filter_order": np.repeat(orders, len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders))}
            out.append(pa.table(first | {c: own[c] for c in COUNTS}))
        return pa.concat_tables(out) if out else None

    return map_batches(sums, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS), rows=100)


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step and COUNTS."""
    return interactions(parity_sums(masks(docs, labels, id_col, text_col, part_col)))


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lowest,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(lowest < d.doc_id, false)} AS fails
  FROM d LEFT JOIN l USING (doc_id)),
m AS MATERIALIZED (
  SELECT part, (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END) || (CASE WHEN fails.C THEN 'C' ELSE '' END)
         || (CASE WHEN fails.D THEN 'D' ELSE '' END) || (CASE WHEN fails.E THEN 'E' ELSE '' END) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || e.x || g.x || h.x AS filter_order FROM c a, c b, c e, c g, c h WHERE len(list_distinct([a.x, b.x, e.x, g.x, h.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT m.part, s.filter_order, s.step, s.own, m.fails, m.n, m.good, m.toxic, contains(m.fails, s.own) AS bad,
             len(list_filter(string_split(m.fails, ''), lambda x: x <> '' AND contains(s.before, x))) > 0 AS gone FROM m, s),
t AS (SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
"""
