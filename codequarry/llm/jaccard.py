"""N-gram Jaccard join by token-combination prefixes.

A text's set holds the 64-bit hashes of its distinct shingles of SHINGLE words (one for the whole
sequence of fewer words). Texts with equal sets form one node, named by 128 bits of the set's
digest. Two nodes link when 100 * |intersection| >= LEAST_PERCENT * |union|. Both numbers are
op6's contract; ``join`` and ``keep_one`` take others as ``size`` and ``percent``.

Shingles fall into two classes by their corpus-wide counts, and the same total order holds for
all texts: rare ones first, frequent ones last, each by hash. A rare shingle is a key by itself.
Frequent ones are keys in pairs: they fall into sub-classes (ranges of their hashes, about two to
four to a set; sets of sizes near a power of two use the ranges of both sides), and each two of a
sub-class make one key. The prefix is extended until losing all its keys takes more shingles than
a linked partner may lack: a rare shingle counts one, a sub-class one less than its members. So
linked sets of any size share a key.

Nodes under one key are not paired all with all: each is tested against the key's smallest node,
then against the one that shares most keys; components are labelled, and only nodes under one key
that are still in different components meet, in blocks of at most BLOCK nodes, where parity
bitmaps of the sets (an exact bound of their difference) are compared and few pairs come out.
Every pair that the bitmaps leave is verified on whole sets, unless it is in one component by
then. No partner is capped or dropped.

Defined results: texts without words have no set, are their own component and are linked with
nothing; equal texts are one component; rows repeated with one id give that row repeatedly; rows
without an id link like any other, and ``component_id`` is the smallest id that the component has
(null if none); extra columns are left out by ``join`` and kept by ``keep_one``, whatever their
names; very long texts are read whole; empty tables give no rows. Word hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import column_pieces, drop_scratch, fresh, map_arrow, map_batches, materialize

SHINGLE = 4
#: Percent of the union.
LEAST_PERCENT = 85
#: A shingle is frequent when so many texts hold it: at least FREQUENT_TEXTS, or this share.
FREQUENT_TEXTS, FREQUENT_SHARE = 64, 0.0005
#: The table of frequent shingles and their texts is broadcast, 16 bytes each; beyond it the most
#: frequent ones are taken. This decides the order of shingles only, never which pairs are found.
MOST_FREQUENT = 2_000_000
#: A task reports shingles that so many texts of COUNTED_SHINGLES shingles hold.
BATCH_TEXTS = 4
COUNTED_SHINGLES = 2_000_000
#: Nodes of two that are compared at once under one key, by their bitmaps.
BLOCK = 1_024
#: Of the keys that two nodes share, they are compared under the first if it is among so many of each.
FIRST_KEYS = 8
#: A key of shingles that more texts hold is dealt over tasks.
HOT_TEXTS = 1_000_000
#: Rows broadcast to choose or drop others, 8 bytes each; beyond it they are joined.
BROADCAST_IDS = 2_000_000
#: Bits of a set's bitmap: a power of two of at least BITS times its size, up to MOST_BITS.
BITS, MOST_BITS = 1, 1 << 17
#: Sets remembered by a task, so that copies are written once.
SEEN_SETS = 100_000
PIECE = 1_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xC2B2AE3D27D4EB4F)

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Tables:
    """Powers of an odd number and of its inverse, and a random value of each byte."""

    def __init__(self) -> None:
        self.values = _mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
        upper = np.arange(0x41, 0x5B)
        self.values[upper] = self.values[upper + 32]
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.base = np.uint64(0xA0761D6478BD642F)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.back = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = 1 << n.bit_length()
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.base)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.inverse)]), dtype=np.uint64)


_tables: list[_Tables] = []


def word_hashes(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, A-Z lower-cased; the number of words of each."""
    if not _tables:
        _tables.append(_Tables())
    t = _tables[0]
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    lens = np.fromiter(map(len, data), np.int64, len(data))
    arr = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
    solid = ~t.space[arr]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    t.grow(len(arr))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(t.values[arr] * t.powers[: len(arr)], dtype=np.uint64)])
    words = _mix((sums[end] - sums[start]) * t.back[start] + (end - start).astype(np.uint64) * _MUL)
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(lens + 1)])))
    return words, counts


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text, as signed 64-bit integers."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= PIECE):
            chars += len(texts[stop] or "")
            stop += 1
        words, counts = word_hashes([x or "" for x in texts[at:stop]], size)
        n = max(0, len(words) - size + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(size):
            grams = grams * _C + words[k : k + n]
        grams = _mix(grams).view(np.int64)
        first = 0
        for m in counts.tolist():
            if m >= size:
                out.append(np.unique(grams[first : first + m - size + 1]))
            elif m:
                out.append(np.array([xxhash.xxh64_intdigest(words[first : first + m].tobytes()) - (1 << 63)], np.int64))
            else:
                out.append(np.zeros(0, np.int64))
            first += m
        at = stop
    return out


def set_id(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of the set's digest as two signed numbers: its node and its twin."""
    h = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)


def least_overlap(n: int, percent: int = LEAST_PERCENT) -> int:
    return -(-percent * n // 100)


def bitmap(grams: np.ndarray) -> bytes:
    """Bit k is the parity of the number of shingles that fall on it, so that two sets' bitmaps
    differ in no more bits than the sets in shingles."""
    size = 256
    while size < min(MOST_BITS, BITS * len(grams)):
        size *= 2
    odd = np.bincount(grams & (size - 1), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


class Bitmaps:
    """The bitmaps of a column, those of one length as the rows of one array of 64-bit words."""

    def __init__(self, column: pa.BinaryArray) -> None:
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        self.length = np.diff(ends) // 8
        self.at = np.zeros(len(column), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for size in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == size)
            self.at[own] = np.arange(len(own))
            if ends[own[-1] + 1] - ends[own[0]] == 8 * size * len(own):  # side by side
                flat = data[ends[own[0]] : ends[own[-1] + 1]]
            else:
                flat = data[(ends[own][:, None] + np.arange(8 * size)).ravel()]
            self.rows[size] = np.frombuffer(flat.tobytes(), np.uint64).reshape(len(own), size)

    def apart(self, i: np.ndarray, other: Bitmaps, j: np.ndarray) -> np.ndarray:
        """In how many bits rows i differ from the other's rows j; the longer are folded."""
        out = np.zeros(len(i), np.int64)
        kind = self.length[i] * 4096 + other.length[j]
        for code in np.unique(kind).tolist():
            u, v = divmod(code, 4096)
            pick = np.flatnonzero(kind == code)
            step = max(1, 262_144 // max(u, v))
            for k in range(0, len(pick), step):
                part = pick[k : k + step]
                x, y = self.rows[u][self.at[i[part]]], other.rows[v][other.at[j[part]]]
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out


def most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in one of two linked sets only, at most."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def keys_of(grams: np.ndarray, texts: np.ndarray, percent: int = LEAST_PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set is found, and over how many tasks each is dealt. ``texts``: how
    many texts hold each shingle if it is frequent, else 0."""
    n = len(grams)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = n - least_overlap(n, percent) + 1
    often = texts > 0
    keys = [grams[~often][:need]]
    deal = [np.ones(len(keys[0]), np.int64)]
    left = need - len(keys[0])
    if left > 0:
        tail, held = grams[often], texts[often]
        level = max(0, n.bit_length() - 2)
        for k in range(level, level + 1 + ((100 * n // percent).bit_length() > n.bit_length())):
            own = (tail.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - k) if k else np.zeros(len(tail), np.uint64)
            further = np.concatenate([[False], own[1:] == own[:-1]])
            length = int(np.searchsorted(np.cumsum(further), left)) + 1
            if length > len(tail):
                raise AssertionError("too few shingles for the prefix")
            salt, gap = np.uint64((k + 1) * int(_MUL) & (2**64 - 1)), 1
            while gap < length:
                i = np.flatnonzero(own[gap:length] == own[: length - gap])
                if not len(i):
                    break
                keys.append(_mix(tail[i].view(np.uint64) * _C + tail[i + gap].view(np.uint64) + salt).view(np.int64))
                deal.append(1 + np.minimum(held[i], held[i + gap]) // HOT_TEXTS)
                gap += 1
    return np.concatenate(keys), np.concatenate(deal)


def _base(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows of two kinds. Of every document: doc_id, n, node, twin, and once a task for each set
    its bits. Of shingles often seen: shingle, texts."""
    kind = documents.schema[id_col].dataType.simpleString()
    types = {"n": pa.int64(), "node": pa.int64(), "twin": pa.int64(), "bits": pa.binary(), "shingle": pa.int64(), "texts": pa.int64()}
    columns = ["doc_id", *types]

    def often(sets: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        found, count = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_counts=True)
        pick = count >= BATCH_TEXTS
        m = int(pick.sum())
        none = [pa.nulls(m, t) for t in (id_type, *list(types.values())[:4])]
        return pa.RecordBatch.from_arrays([*none, pa.array(found[pick]), pa.array(count[pick])], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        waiting: list[np.ndarray] = []
        held, id_type = 0, None
        for batch in batches:
            id_type = batch.column(0).type
            texts = batch.column(1)
            for a, b in column_pieces(texts, PIECE):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist(), size)
                names = [set_id(s) if len(s) else (None, None) for s in sets]
                bits = []
                for name, s in zip(names, sets, strict=True):
                    new = len(s) > 0 and name not in seen
                    bits.append(bitmap(s) if new else None)
                    if new:
                        if len(seen) >= SEEN_SETS:
                            seen.clear()
                        seen.add(name)
                        waiting.append(s)
                        held += len(s)
                m = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, m), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()),
                        pa.array(bits, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                    ],
                    columns,
                )
                if held >= COUNTED_SHINGLES:
                    yield often(waiting, id_type)
                    waiting, held = [], 0
        if waiting:
            yield often(waiting, id_type)

    schema = f"doc_id {kind}, n long, node long, twin long, bits binary, shingle long, texts long"
    return map_arrow(documents.select(id_col, text_col), run, schema)


def _index(documents: DataFrame, frequent, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """key, salt, node, twin, n: each set under its keys, once a task. Keys of very frequent
    shingles have several salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, texts = frequent.value
        seen: set[tuple[int, int]] = set()
        none = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            for a, b in column_pieces(column, PIECE):
                sets, names = [], []
                for s in shingle_sets(column.slice(a, b - a).to_pylist(), size):
                    if len(s) > 1 and (name := set_id(s)) not in seen:
                        if len(seen) >= SEEN_SETS:
                            seen.clear()
                        seen.add(name)
                        sets.append(s)
                        names.append(name)
                grams = np.concatenate([*sets, none])
                held = np.zeros(len(grams), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                    held = np.where(often[at] == grams, texts[at], 0)
                ends = np.cumsum([0, *map(len, sets)]).tolist()
                found = [keys_of(s, held[x:y], percent) for s, x, y in zip(sets, ends[:-1], ends[1:], strict=True)]
                each = np.array([len(k) for k, _ in found], np.int64)
                node, twin = (np.repeat(np.array([x[k] for x in names], np.int64), each) for k in (0, 1))
                deal = np.concatenate([*(d for _, d in found), none])
                salt = np.where(deal > 1, node.view(np.uint64) % np.maximum(deal, 1).astype(np.uint64) + 1, 0).astype(np.int32)
                n = np.repeat([len(s) for s in sets], each).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*(k for k, _ in found), none])), pa.array(salt), pa.array(node), pa.array(twin), pa.array(n)], ["key", "salt", "node", "twin", "n"])

    return map_arrow(documents.select(text_col), run, "key long, salt int, node long, twin long, n int")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """node, twin, n, grams of every text that has words."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        sets = [s for s in shingle_sets(batch.column(0).to_pylist(), size) if len(s)]
        names = [set_id(s) for s in sets]
        return pa.table({"node": pa.array([x for x, _ in names], pa.int64()), "twin": pa.array([x for _, x in names], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "grams": pa.array(sets, pa.list_(pa.int64()))})

    return map_batches(texts, run, "node long, twin long, n long, grams array<bigint>", 500)


def _sided(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col(value).alias("x_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col(value).alias("x_b"))
    return pairs.join(left, "a").join(right, "b")


def near(pairs: DataFrame, sets: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """a, b, gap of the pairs whose bitmaps don't rule a link out. gap: by how many bits."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        a, b, n, m = (np.asarray(batch.column(k), np.int64) for k in range(4))
        every = np.arange(len(a))
        gap = most_apart(n, m, percent) - Bitmaps(batch.column(4)).apart(every, Bitmaps(batch.column(5)), every)
        kept = gap >= 0
        return pa.table({"a": pa.array(a[kept]), "b": pa.array(b[kept]), "gap": pa.array(gap[kept])})

    both = _sided(pairs, sets, "bits").select("a", "b", "n_a", "n_b", "x_a", "x_b")
    return map_batches(both, run, "a long, b long, gap long", 1_000).distinct()


def linked(pairs: DataFrame, sets: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    both = F.size(F.array_intersect("x_a", "x_b"))
    return _sided(pairs.select("a", "b"), sets, "grams").where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node with an edge: labels spread
    along edges and are replaced by their own labels until nothing changes. Labels only fall, so
    that their sum tells whether any changed."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    last, old = None, None
    while True:
        for _ in range(2):
            seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
            step = labels.join(seen, "node").select("node", F.least("label", "seen").alias("label"))
            jump = step.where(F.col("node") != F.col("label")).select(F.col("node").alias("via"), F.col("label").alias("further"))
            labels = step.join(jump, step["label"] == jump["via"], "left").select("node", F.coalesce("further", "label").alias("label"))
        labels = materialize(labels, "labels")
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if old is not None:
            drop_scratch(old)
        if total == last:
            drop_scratch(both)
            return labels
        last, old = total, labels


def few(rows: DataFrame) -> DataFrame:
    """For a join: broadcast up to BROADCAST_IDS rows, beyond it not. ``rows`` are read from a table."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _fits(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _pair(node: str, to: str) -> list[Column]:
    return [F.least(node, to).alias("a"), F.greatest(node, to).alias("b")]


def _stars(shared: DataFrame, percent: int) -> DataFrame:
    """Each key's nodes with its smallest one, and where a key is dealt over tasks, the smallest
    ones of its salts with the smallest of all."""
    star = shared.where((F.col("node") != F.col("leader.node")) & _fits("n", "leader.n", percent)).select(*_pair("node", "leader.node"))
    heads = shared.where((F.col("salt") > 0) & (F.col("node") == F.col("leader.node")))
    heads = heads.withColumn("head", F.min("node").over(Window.partitionBy("key"))).where(F.col("node") != F.col("head"))
    return star.union(heads.select(*_pair("node", "head"))).distinct()


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of keys that more than one component has."""
    named = _named(shared.select("key", "salt", "node", "n"), labels)
    ends = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).where(F.col("low") != F.col("high"))
    return named.join(ends.select("key", "rows"), "key")


def _hubs(open_: DataFrame, percent: int) -> DataFrame:
    """Copies with changes of their own may link through their original only: it holds most open keys."""
    held = open_.groupBy("node").agg(F.count("*").alias("held"))
    hub = F.max(F.struct("held", "node", "n", "label")).over(Window.partitionBy("key", "salt"))
    star = open_.join(held, "node").withColumn("hub", hub).where(F.col("label") != F.col("hub.label"))
    return star.where(_fits("n", "hub.n", percent)).select(*_pair("node", "hub.node")).distinct()


def _met(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, gap of nodes of different components that share a key and whose bitmaps don't rule a
    link out. A key of more than BLOCK nodes is cut into blocks by node, and each two blocks are
    one group; a group is held by one task, rows of both blocks at a time."""
    blocks = F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    rows = open_.withColumn("mine", mine).withColumn("other", other).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    # the smallest open keys of each node tell under which key two of them are compared
    first = open_.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST_KEYS).alias("first"))
    rows = rows.join(sets.select("node", "bits").join(first, "node"), "node").select("key", "i", "j", "mine", "node", "n", "label", "bits", "first")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "mine", "node")

    def compare(part: pa.RecordBatch, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, mine, node, n, label = (np.asarray(part.column(c), np.int64) for c in ("i", "j", "mine", "node", "n", "label"))
        key, bits, own = np.asarray(part.column("key"), np.int64), Bitmaps(part.column("bits")), part.column("first")
        ends = np.asarray(own.offsets, np.int64)
        first, real = np.zeros((len(part), FIRST_KEYS), np.int64), np.zeros((len(part), FIRST_KEYS), bool)
        for k in range(FIRST_KEYS):
            has = np.diff(ends) > k
            first[has, k], real[has, k] = np.asarray(own.values, np.int64)[ends[:-1][has] + k], True
        a, b, gap = [], [], []
        left, step = np.arange(len(group)), 1
        while True:
            left = left[left + step < len(group)]
            left = left[group[left] == group[left + step]]
            if not len(left):
                break
            right = left + step
            step += 1
            open_pair = (label[left] != label[right]) & ((mine[left] != mine[right]) | (i[left] == j[left]))
            open_pair &= 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
            x, y = left[open_pair], right[open_pair]
            slack = most_apart(n[x], n[y], percent) - bits.apart(x, bits, y)
            hit = np.flatnonzero(slack >= 0)
            if len(hit):
                # a pair comes out under the first of these keys that it shares, or if none, everywhere
                shared = (first[x[hit]][:, :, None] == first[y[hit]][:, None, :]) & real[x[hit]][:, :, None] & real[y[hit]][:, None, :]
                shared = shared.any(axis=2)
                least = np.where(shared.any(axis=1), np.take_along_axis(first[x[hit]], shared.argmax(axis=1)[:, None], 1)[:, 0], key[x[hit]])
                hit = hit[least == key[x[hit]]]
            a.append(np.minimum(node[x[hit]], node[y[hit]]))
            b.append(np.maximum(node[x[hit]], node[y[hit]]))
            gap.append(slack[hit])
        if a:
            rows = np.unique(np.stack([np.concatenate(a), np.concatenate(b), np.concatenate(gap)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["a", "b", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def together(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            names = np.stack([np.asarray(whole.column(c), np.int64) for c in ("key", "i", "j")])
            return whole, np.concatenate([[0], np.cumsum((names[:, 1:] != names[:, :-1]).any(axis=0))])

        for batch in batches:
            if not len(batch):
                continue
            whole, group = together([*rest, batch])
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            yield from compare(whole.slice(0, cut), group[:cut])
            rest = [whole.slice(cut)]
        if rest:
            yield from compare(*together(rest))

    return map_arrow(dealt, run, "a long, b long, gap long").distinct()


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose nodes are in different components."""
    if labels is None:
        return pairs
    left, right = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).drop("label_a", "label_b")


class _Links:
    """The components known so far."""

    def __init__(self, spark: SparkSession, sets: Callable[[DataFrame], DataFrame], percent: int) -> None:
        self.spark, self.sets, self.percent = spark, sets, percent
        self.edges: DataFrame | None = None
        self.labels: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> None:
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            drop_scratch(pairs)
            return
        ends = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
        sets = self.sets(few(ends))
        found = linked(pairs, sets, self.percent)
        edges = materialize(found if self.edges is None else found.union(self.edges), "links")
        for frame in (ends, sets, pairs):
            drop_scratch(frame)
        if self.edges is not None:
            drop_scratch(self.edges)
        self.edges = edges
        if self.labels is not None:
            drop_scratch(self.labels)
        self.labels = None if edges.isEmpty() else components(self.spark, edges)

    def try_pairs(self, found: DataFrame, name: str) -> None:
        """If most nodes have several pairs, each one's closest first, then those still apart."""
        found = materialize(found, name)
        first = materialize(_apart(found.groupBy("b").agg(F.max_by("a", "gap").alias("a")).select("a", "b"), self.labels), "closest")
        if 2 * first.count() < found.count():
            self.verify(first)
            self.verify(_apart(found.select("a", "b"), self.labels).join(first, ["a", "b"], "left_anti"))
        else:
            self.verify(_apart(found.select("a", "b"), self.labels))
        drop_scratch(first)
        drop_scratch(found)


def _classes(bits: DataFrame, shared: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame | None:
    """node, label of the nodes that link. sets(nodes): the sets of nodes."""
    nodes = few(materialize(shared.select("node").distinct(), "shared-nodes"))
    bits = materialize(bits.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "bits")
    links = _Links(bits.sparkSession, sets, percent)
    links.try_pairs(near(_stars(shared, percent), bits, percent), "stars")
    open_ = materialize(_open(shared, links.labels), "open")
    links.try_pairs(near(_hubs(open_, percent), bits, percent), "hubs")
    drop_scratch(open_)
    open_ = materialize(_open(shared, links.labels), "open")
    links.try_pairs(_met(open_, bits, percent), "met")
    for frame in (open_, bits, nodes):
        drop_scratch(frame)
    if links.edges is not None:
        drop_scratch(links.edges)
    return links.labels


def _shared(index: DataFrame, percent: int) -> DataFrame:
    """The rows of keys that several sets have, with the key's smallest node (of its salt). Sets
    that none under the key comes near in size are left out: next to each set in the order of
    sizes stands the nearest."""
    key = Window.partitionBy("key", "salt")
    by_size = key.orderBy("n")
    above, below = F.lead("n").over(by_size), F.lag("n").over(by_size)
    index = index.withColumns({"above": above, "below": below})
    fits = (percent * F.col("above") <= 100 * F.col("n")) | (percent * F.col("n") <= 100 * F.col("below"))
    index = index.where(F.coalesce(fits, F.lit(False)) | (F.col("salt") > 0)).drop("above", "below")
    index = index.withColumns({"leader": F.min(F.struct("node", "n")).over(key), "other": F.max("node").over(key)})
    return index.where((F.col("salt") > 0) | (F.col("leader.node") != F.col("other"))).drop("other").dropDuplicates(["key", "salt", "node"])


class _Labelled:
    """``docs``: doc_id, n, node and label of every document row (node and label are null for
    texts without words); ``first``: label, and the smallest row of its component as a struct
    none (id is null), doc_id, node, and its number of rows. ``clash``: see _clashes."""

    def __init__(self, documents: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> None:
        if not 70 <= percent <= 100:
            raise ValueError("percent out of range")
        spark = documents.sparkSession
        base = materialize(_base(documents, id_col, text_col, size), "nodes")
        self.clash = _clashes(base)
        rows = renamed(base.where(F.col("shingle").isNull()), self.clash)
        docs = rows.select("doc_id", "n", "node")
        bits = rows.where(F.col("bits").isNotNull()).select("node", "n", "bits")
        least = max(FREQUENT_TEXTS, int(docs.count() * FREQUENT_SHARE))
        often = base.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= least)
        found = often.orderBy(F.desc("texts"), "shingle").limit(MOST_FREQUENT).toArrow()
        by = np.argsort(np.asarray(found["shingle"], np.int64))
        frequent = spark.sparkContext.broadcast((np.asarray(found["shingle"], np.int64)[by], np.asarray(found["texts"], np.int64)[by]))

        def sets(nodes: DataFrame) -> DataFrame:
            """Of one document of each node, and where there is none with an id, of all without."""
            ids = docs.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias(own))
            ids = materialize(ids, "wanted")
            texts = documents.join(few(ids.select(own).distinct()), F.col(id_col) == F.col(own), "left_semi").select(text_col)
            if not ids.where(F.col(own).isNull()).isEmpty():
                texts = texts.union(documents.where(F.col(id_col).isNull()).select(text_col))
            found = materialize(renamed(_sets(texts, size), self.clash).join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "grams"), "sets")
            drop_scratch(ids)
            return found

        own = fresh(documents, "own_id")
        index = renamed(_index(documents, frequent, id_col, text_col, size, percent), self.clash).drop("twin")
        shared = materialize(_shared(index, percent), "shared")
        labels = _classes(bits, shared, sets, percent)
        drop_scratch(shared)
        named = _named(docs, labels)
        # a null id comes after all others; a first step by node keeps large components in many tasks
        row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
        by_node = docs.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(row).alias("first"), F.count("*").alias("rows"))
        by_label = _named(by_node, labels).groupBy("label").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))
        self.first = materialize(by_label.where(F.col("rows") > 1), "first")
        self.docs = materialize(named, "labelled")
        if labels is not None:
            drop_scratch(labels)
        drop_scratch(base)


def _clashes(base: DataFrame) -> DataFrame | None:
    """node, twin, other: sets whose 64-bit node another set has too, and the node they get
    instead. Of n sets n * n / 2**65 are expected here: some tens of 5e10."""
    named = base.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).where(F.col("low") != F.col("high"))
    rows = base.where(F.col("node").isNotNull()).select("node", "twin").join(F.broadcast(named), "node").where(F.col("twin") != F.col("low"))
    found = rows.select("node", "twin", F.col("twin").alias("other")).distinct().collect() if not named.isEmpty() else []
    return base.sparkSession.createDataFrame(found, "node long, twin long, other long") if found else None


def renamed(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    if clash is None:
        return rows
    return rows.join(F.broadcast(clash), ["node", "twin"], "left").withColumn("node", F.coalesce("other", "node")).drop("other")


def join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = LEAST_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row. Shingles have ``size`` words, and
    linked sets share ``percent`` of their union, 70 at least."""
    found = _Labelled(documents, id_col, text_col, size, percent)
    named = found.docs.join(found.first.select("label", F.col("first.doc_id").alias("least")), "label", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = LEAST_PERCENT) -> DataFrame:
    """One document of each component stays: that of the smallest id, and of texts with that id,
    of the smallest node; rows without an id stay for components that have no other. Texts without
    words stay. Rows are repeats of each other, so that one stays, if id and set are equal, or for
    texts without words, a given id and the text. All columns are kept."""
    found = _Labelled(documents, id_col, text_col, size, percent)
    stays = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node")))
    decided = materialize(found.docs.join(found.first.select("label", "first"), "label", "left").select("doc_id", "node", stays.alias("stays")), "decided")
    drop_scratch(found.docs)
    drop_scratch(found.first)
    each = decided.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_and("stays").alias("stays"))
    alone = F.col("doc_id").isNotNull() & (F.col("rows") == 1)
    columns, own = documents.columns, fresh(documents, "own_id")
    lost = few(materialize(each.where(alone & ~F.col("stays")).select(F.col("doc_id").alias(own)), "copies"))
    kept = documents.join(lost, F.col(id_col) == F.col(own), "left_anti")
    shared = each.where(~alone).select(F.col("doc_id").alias(own))
    if shared.isEmpty():
        return kept
    # ids that don't name one row: their rows are decided one by one, by id and set
    shared = few(materialize(shared, "shared-ids"))
    same_id = F.col(id_col).eqNullSafe(F.col(own))
    node = fresh(documents, "node")
    rows = materialize(_with_node(documents.join(shared, same_id, "left_semi"), text_col, size, found.clash, node), "shared-rows")
    its = fresh(rows, "own_node")
    sets = decided.where(F.col("stays") & F.col("node").isNotNull()).select(F.col("doc_id").alias(own), F.col("node").alias(its))
    sets = few(materialize(sets.join(shared.withColumnRenamed(own, "wanted"), F.col(own).eqNullSafe(F.col("wanted")), "left_semi").distinct(), "shared-sets"))
    worded = rows.join(sets, same_id & (F.col(node) == F.col(its)), "left_semi").dropDuplicates([id_col, node])
    blank = rows.where(F.col(node).isNull())
    blank = blank.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(blank.where(F.col(id_col).isNull()))
    return kept.join(shared, same_id, "left_anti").unionByName(worded.unionByName(blank).select(*columns))


def _with_node(documents: DataFrame, text_col: str, size: int, clash: DataFrame | None, name: str) -> DataFrame:
    """All columns, and the text's node."""
    at = documents.columns.index(text_col)
    twin, other = fresh(documents, "twin"), fresh(documents, "other")

    def run(batch: pa.RecordBatch) -> pa.Table:
        names = [set_id(s) if len(s) else (None, None) for s in shingle_sets(batch.column(at).to_pylist(), size)]
        whole = pa.Table.from_batches([batch])
        return whole.append_column(name, pa.array([x for x, _ in names], pa.int64())).append_column(twin, pa.array([x for _, x in names], pa.int64()))

    schema = StructType([*documents.schema.fields, StructField(name, LongType()), StructField(twin, LongType())])
    rows = map_batches(documents, run, schema, 500)
    if clash is not None:
        clash = clash.select(F.col("node").alias(name), F.col("twin").alias(twin), F.col("other").alias(other))
        rows = rows.join(F.broadcast(clash), [name, twin], "left").withColumn(name, F.coalesce(other, name)).drop(other)
    return rows.select(*documents.columns, name)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS k FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[k : k + 3], ' ')) AS g FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * shared >= 85 * (u.n + v.n - shared)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
