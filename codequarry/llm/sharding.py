"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (an offset and a step
from its name's digest); the shards take turns, each claiming the next free slot it prefers, one
claim a turn for each unit of weight. A document's key hashes to a slot, and the broadcast table
(``size`` rows, a parameter) gives its shard without a shuffle. When shards come or go, few keys move.

Defined results: the key is the id's text, or the text where the id is null (so that many null
ids do not meet in one shard), or empty where both are; repeated rows go to the same shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 65_537


def lookup_table(shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, and as many as slots at most")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digest]
    step = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digest]
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 0 or not any(turns):
        raise ValueError("weights must not be negative, nor all 0")
    table, free = [-1] * size, size
    while free:
        for shard, n in enumerate(turns):
            for _ in range(min(n, free)):
                while table[at[shard]] >= 0:
                    at[shard] = (at[shard] + step[shard]) % size
                table[at[shard]] = shard
                free -= 1
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") % F.lit(size)).cast("int")


def place(df: DataFrame, shards: list[str], id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard`` added (columns of these names are replaced)."""
    table = lookup_table(shards, size, weights)
    spark = df.sparkSession
    lookup = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "slot int, shard string")
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return df.drop("slot", "shard").withColumn("slot", slot_of(key, size)).join(F.broadcast(lookup), "slot")
