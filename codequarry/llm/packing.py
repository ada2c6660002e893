"""Packing of tokenised documents into sequences by shortest-pack-first over the length histogram.

Documents are encoded once; every full ``size`` of tokens is a sequence by itself, the rest of a
document is a tail. The histogram of tails (``size`` counts at most, whatever the corpus holds) is
packed on the driver: lengths go longest first, each into the shortest packs, and only counts of
packing patterns change, not documents. A pattern that stands for ``count`` packs holds, for each of
its places, the ranks of the tails that lie there, so that documents find their pack from their
rank among tails of their length: a rank is a task's own count plus what the tasks before counted.

Patterns leave some room. The emptiest packs, as many as the room of all others takes, are taken
apart: their tails form one stream that is cut to the room left, then into full sequences; what
is over at the end becomes sequences of powers of two, which need no padding. Room below
``least_room`` stays as padding.

Defined results: null text is the empty text; every row has at least the end token; an empty
table gives no pieces; repeated rows are packed each by itself; rows of equal length are ranked by
their place in the input; very long texts are read whole; other columns are left out, whatever
their names.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _shared, load
from .common import column_pieces, map_arrow, map_batches, materialize

SIZE = 2048
#: The token that ends every document.
END = 1
#: Room of fewer tokens than this is padded and not filled with cut documents.
LEAST_ROOM = 16


@dataclass
class Packs:
    """``count`` packs of one pattern, numbered from ``first``; ``places`` are (length, rank of the
    tail in the first of these packs, offset)."""

    first: int
    count: int
    used: int
    places: list[tuple[int, int, int]]

    def split(self, n: int) -> Packs:
        """Keep the first ``n`` packs; the others are returned."""
        rest = Packs(self.first + n, self.count - n, self.used, [(x, rank + n, at) for x, rank, at in self.places])
        self.count = n
        return rest


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[Packs]:
    """Patterns and their counts for ``histogram`` (length to number of tails)."""
    packs: list[Packs] = []
    shortest: list[tuple[int, int, int]] = []  # used, first pack, index of the pattern
    opened = 0

    def offer(index: int) -> None:
        heapq.heappush(shortest, (packs[index].used, packs[index].first, index))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and shortest and shortest[0][0] + length <= size:
            index = heapq.heappop(shortest)[2]
            p = packs[index]
            if left < p.count:
                packs.append(p.split(left))
                offer(len(packs) - 1)
            p.places.append((length, rank, p.used))
            p.used += length
            offer(index)
            rank += p.count
            left -= p.count
        # no pack has room: tails share new ones as long as they fit
        each = size // length
        for copies, n in ((each, left // each), (left % each, 1)):
            if copies and n:
                packs.append(Packs(opened, n, copies * length, [(length, rank + i * n, i * length) for i in range(copies)]))
                offer(len(packs) - 1)
                rank += copies * n
                opened += n
    return packs


@dataclass
class Plan:
    """Where tails lie. ``places``: by length, the first ranks of runs, and for each run (pack of the
    first, offset, None) or (None, None, place in the stream of the first). ``rooms``: first place in
    the stream, room, first pack, offset; each stands for as many packs as reach the next."""

    places: dict[int, tuple[list[int], list[tuple[int | None, int | None, int | None]]]]
    rooms: list[tuple[int, int, int, int]]
    sequences: int

    def place(self, length: int, rank: int) -> tuple[int | None, int | None, int | None]:
        """sequence, offset, None; or None, None, place in the stream."""
        ranks, runs = self.places[length]
        i = bisect_right(ranks, rank) - 1
        first, offset, at = runs[i]
        if at is None:
            return first + rank - ranks[i], offset, None
        return None, None, at + (rank - ranks[i]) * length

    def cut(self, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """start, length, sequence, offset of the pieces of a tail at a place in the stream."""
        done = 0
        i = bisect_right(self.rooms, (at, 1 << 62)) - 1
        while done < length:
            while i + 1 < len(self.rooms) and self.rooms[i + 1][0] <= at + done:
                i += 1
            begin, room, first, offset = self.rooms[i]
            pack, inside = divmod(at + done - begin, room)
            n = min(length - done, room - inside)
            yield done, n, first + pack, offset + inside
            done += n


def plan(histogram: dict[int, int], size: int = SIZE, least_room: int = LEAST_ROOM) -> Plan:
    """Packs of shortest_pack_first; the emptiest are taken apart to fill the room of the others."""
    packs = sorted(shortest_pack_first(histogram, size), key=lambda p: (p.used, p.first))

    def room(p: Packs) -> int:
        return size - p.used if size - p.used >= least_room else 0

    free, given, apart = sum(p.count * room(p) for p in packs), 0, []
    for at, p in enumerate(packs):
        if given >= free:
            packs = packs[at:]
            break
        # each pack taken apart gives its tokens and takes its room away
        n = min(p.count, -(-(free - given) // (p.used + room(p))))
        rest = p.split(n) if n < p.count else None
        apart.append(p)
        free, given = free - n * room(p), given + n * p.used
        if rest:
            packs = [rest, *packs[at + 1 :]]
            break
    else:
        packs = []
    runs: dict[int, list[tuple[int, tuple[int | None, int | None, int | None]]]] = {}
    rooms, sequences, stream = [], 0, 0
    for p in packs:
        for length, rank, offset in p.places:
            runs.setdefault(length, []).append((rank, (sequences, offset, None)))
        if room(p):
            rooms.append((stream, room(p), sequences, p.used))
            stream += p.count * room(p)
        sequences += p.count
    at = 0
    for p in apart:
        for length, rank, _ in p.places:
            runs.setdefault(length, []).append((rank, (None, None, at)))
            at += p.count * length
    # past the room: full sequences, then powers of two
    over = max(0, at - stream)
    for n in [size, *(1 << k for k in reversed(range(size.bit_length())) if 1 << k < size)]:
        if over >= n:
            rooms.append((stream, n, sequences, 0))
            stream, sequences, over = stream + over // n * n, sequences + over // n, over % n
    return Plan({x: tuple(map(list, zip(*sorted(r, key=lambda y: y[0]), strict=True))) for x, r in runs.items()}, rooms, sequences)


def _units(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, size: int, end: int) -> tuple[DataFrame, str]:
    """One row for every full sequence and every tail: part, rank in the part among those of this
    length, start, length, crc, doc_tokens, and the ids of tails; and the kind of integers that hold those."""
    spec = _shared(docs, tokenizer_path)
    conf = json.loads(spec.value)
    top = max([end, *conf["model"]["vocab"].values(), *(t["id"] for t in conf["added_tokens"])])
    narrow = "<u2" if top < 1 << 16 else "<u4"
    kind = docs.schema[id_col].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()
    del conf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = load(spec.value), TaskContext.get().partitionId(), {}
        for batch in batches:
            texts = batch.column(1)
            for a, b in column_pieces(texts):
                of, rank, start, length, crc, tokens, tails = [], [], [], [], [], [], []
                for i, raw in enumerate(bpe.encode_batch(texts.slice(a, b - a).to_pylist())):
                    raw += last
                    n = len(raw) // 4
                    for at in range(0, n, size):
                        ids = raw[4 * at : 4 * (at + size)]
                        x = len(ids) // 4
                        of.append(a + i)
                        rank.append(seen.get(x, 0))
                        seen[x] = rank[-1] + 1
                        start.append(at)
                        length.append(x)
                        crc.append(zlib.crc32(ids))
                        tokens.append(n)
                        tails.append(np.frombuffer(ids, "<u4").astype(narrow).tobytes() if x < size else None)
                own = pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(of), pa.int32()), id_col: batch.column(0).take(pa.array(of, pa.int64())), "rank": pa.array(rank, pa.int64()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int32()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(tokens, pa.int64()), "tail": pa.array(tails, pa.binary()),
                })
                yield own

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"part int, `{id_col}` {kind}, rank long, start long, length int, ids_crc32 long, doc_tokens long, tail binary"), narrow


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, least_room: int = LEAST_ROOM) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    rows, narrow = _units(docs, tokenizer_path, id_col, text_col, size, end)
    units = materialize(rows, "units")
    counts = materialize(units.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # at most ``size`` lengths
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(size, 0)
    whole = plan(histogram, size, least_room)
    shared = docs.sparkSession.sparkContext.broadcast(whole)
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    out = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    ranked = units.drop("tail").join(before, ["part", "length"]).select("part", "rank", (F.col("rank") + F.col("before")).alias("overall"), *out)

    def place(batch: pa.RecordBatch) -> pa.Table:
        found = []
        for length, rank in zip(batch.column("length").to_pylist(), batch.column("overall").to_pylist(), strict=True):
            found.append((shared.value.sequences + rank, 0, None) if length == size else shared.value.place(length, rank))
        sequence, offset, at = zip(*found, strict=True) if found else ((), (), ())
        own = [batch.column(c) for c in ("part", "rank", *out)]
        return pa.table([*own, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(at, pa.int64())], names=["part", "rank", *out, "sequence_id", "offset", "at"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select("part", "rank", *out).schema)
    placed = materialize(map_batches(ranked, place, f"{kinds}, sequence_id long, offset long, at long"), "placed")

    def cut(batch: pa.RecordBatch) -> pa.Table:
        of, start, length, crc, sequence, offset = [], [], [], [], [], []
        cols = [batch.column(c).to_pylist() for c in ("start", "length", "at", "tail")]
        for i, (first, n, at, tail) in enumerate(zip(*cols, strict=True)):
            ids = np.frombuffer(tail, narrow).astype("<u4")
            for a, m, s, o in shared.value.cut(at, n):
                of.append(i)
                start.append(first + a)
                length.append(m)
                crc.append(zlib.crc32(ids[a : a + m].tobytes()))
                sequence.append(s)
                offset.append(o)
        rows = pa.array(of, pa.int64())
        return pa.table({
            id_col: batch.column(id_col).take(rows), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": batch.column("doc_tokens").take(rows), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
        })

    key = ["part", "length", "rank"]
    streamed = placed.where(F.col("at").isNotNull()).drop("sequence_id", "offset").join(units.select(*key, "tail"), key)
    pieces = map_batches(streamed, cut, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    kept = placed.where(F.col("at").isNull()).select(id_col, "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return kept.unionByName(pieces)
