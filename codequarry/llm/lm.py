"""Language-model scoring by a hierarchical Pitman-Yor model of words.

A word's context is the two words before it. Its restaurant's parent is that of the word just
before, whose parent is the restaurant of all words, whose parent is uniform over the V training
types and one unknown type. Tables of a restaurant of two words are customers of its parent. The
restaurant of all words seats every training token (as if each customer below had its own table
there): its counts are those of the base score.

Seatings are sampled by Gibbs sweeps: the tables of each word in each restaurant are drawn again
from their distribution given its customers, the tables of the other words and the parent's
probabilities (generalised Stirling numbers); then the parent's customers are counted anew and
its tables drawn. Restaurants that share a parent are swept together, totals of a restaurant
being those before the sweep. Beyond EXACT customers of one word in one restaurant, the later ones
are seated one table after another by the limit of these numbers. The probability of a word is the
average over SAMPLES sweeps after BURN_IN ones, and the score is the sum of its logarithms.

How it is dealt: texts are cut into pieces, and the tokens of each piece go as packed arrays to
the bucket of the word before them, which holds all restaurants below it; buckets grow in number,
not in size. The restaurants below a word that more than SPLIT_TOKENS tokens follow (a wide word) are
dealt to several buckets by the word before it. These buckets and the wide words take turns, a sweep
at a time: buckets draw tables and send their numbers, wide words draw theirs and send both back, so
that scores don't depend on SPLIT_TOKENS. Kinds of tokens that occur once always have one table and
take no part in that. The words most frequent, up to
HOT_WORDS, are broadcast with their counts; the counts of other words are joined with the buckets
that hold them and come there beside the tokens. Probabilities of both are made by one rule, so that
scores don't depend on HOT_WORDS.

Uniform numbers come from the words' hashes and the sweep, so that a task run again gives the
same seating. Words are named by 64-bit hashes.

Defined results: null is the empty text, one end token; rows with null id teach and are not held
out; a row repeated is scored each time; without training documents N and V are 0 and all words
are unknown; the end token is known as soon as one document teaches; very long texts are read
whole (a text is one piece at least); columns other than id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_pieces, drop_scratch, map_arrow, materialize, pieces
from .jaccard import word_hashes

#: Discount and strength of restaurants of no, one and two words.
DISCOUNTS = (0.5, 0.75, 0.85)
STRENGTHS = (1.0, 1.0, 1.0)
BURN_IN, SAMPLES = 2, 2
#: Words broadcast, 36 bytes each.
HOT_WORDS = 1 << 20
#: Tokens of a bucket, on average, and those that may follow a word that has one bucket.
BUCKET_TOKENS = 500_000
SPLIT_TOKENS = 500_000
EXACT = 512
#: Characters of the texts that are dealt together, and hashed at once.
PIECE, HASHED = 4_000_000, 500_000
END, START = np.uint64(0x8F14E45FCEEA167A), np.uint64(0x45C48CCE2E2D7FBD)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def uniform(seed: np.ndarray, draw: int) -> np.ndarray:
    return ((mix(seed + np.uint64((draw + 1) * int(_A) & (2**64 - 1))) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


# -- seating ---------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: row c, column t."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(most):
            t = np.arange(1, c + 2)
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], out[c, 1 : c + 2] + np.log(np.maximum(c - d * t, 0)))
    return out


def seat(count: np.ndarray, low: np.ndarray, others: np.ndarray, d: float, theta: float, seed: np.ndarray, draw: int) -> np.ndarray:
    """Tables of each word in its restaurant. low: the parent's probability; others: tables of the
    restaurant's other words."""
    tables = np.minimum(count, 1)
    several = np.flatnonzero(count > 1)
    if not len(several):
        return tables
    u = uniform(seed[several], draw)
    size = np.minimum(count[several], EXACT)
    by = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[by])) + 1
    log_s = stirling(d)
    for group in np.split(by, edges):
        c = int(size[group[0]])
        for k in range(0, len(group), max(1, 400_000 // c)):
            part = group[k : k + max(1, 400_000 // c)]
            at = several[part]
            # of more than EXACT customers, these are the first: what later ones tell is (c / count) ** (d * t)
            tilt = d * np.log(c / count[at])[:, None] * np.arange(1, c + 1)
            weight = tilt + np.cumsum(np.log(theta + d * (others[at][:, None] + np.arange(c))) + np.log(low[at])[:, None], axis=1) + log_s[c, 1 : c + 1]
            p = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + np.minimum((p < (u[part] * p[:, -1])[:, None]).sum(axis=1), c - 1)
    live = several[count[several] > EXACT]
    i, step = np.full(len(live), float(EXACT)), 0
    while len(live):  # customer x opens a table with odds a / x, times (x / count) ** d for what later ones tell
        step += 1
        a = (theta + d * (others[live] + tables[live])) * low[live]
        with np.errstate(over="ignore"):
            i = (i**d - np.log(uniform(seed[live], draw * 1_000_003 + step)) * d * count[live] ** d / a) ** (1 / d)
        some = i < count[live]
        live, i = live[some], np.ceil(i[some])
        tables[live] += 1
    return tables


class Bucket:
    """Restaurants of two words and their parents, by sorted tokens: v, u, w of each (numbers),
    whether it teaches, and the hashes that the numbers stand for. ``low``: the parents' parent's
    probability by w."""

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, taught: np.ndarray, v_hash: np.ndarray, word_hash: np.ndarray, low: np.ndarray) -> None:
        order = order_of(v, u, w)
        v, u, w = v[order], u[order], w[order]
        new = np.ones(len(v), bool)
        context = new.copy()
        context[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
        new[1:] = context[1:] | (w[1:] != w[:-1])
        kind = np.cumsum(new) - 1
        self.kind = np.empty(len(v), np.int64)  # of each token as given
        self.kind[order] = kind
        first = np.flatnonzero(new)
        self.count = np.bincount(kind, taught[order], len(first)).astype(np.int64)
        self.context = np.cumsum(context)[first] - 1
        v, u, w = v[first], u[first], w[first]
        order = order_of(v, w)
        new = np.ones(len(v), bool)
        new[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
        self.parent = np.empty(len(v), np.int64)
        self.parent[order] = np.cumsum(new) - 1
        own = order[new]
        self.v, self.w, self.low, self.word = v[own], w[own], low[w[own]], word_hash[w[own]]
        own = np.concatenate([[0], np.flatnonzero(np.diff(self.context)) + 1])
        self.context_v, self.context_u = v[own], u[own]
        self.context_hash = mix(v_hash[self.context_v] + word_hash[self.context_u])
        self.seed = (mix(self.context_hash[self.context] + word_hash[w]), mix(v_hash[self.v] ^ self.word))

    def probabilities(self, samples: int = SAMPLES, burn_in: int = BURN_IN) -> tuple[np.ndarray, np.ndarray]:
        """a and b of every kind of token: its probability is a + b * low."""
        (d2, d3), (s2, s3) = DISCOUNTS[1:], STRENGTHS[1:]
        c3, context, parent, v = self.count, self.context, self.parent, self.v
        n_context, n_v = int(context.max()) + 1, int(v.max()) + 1
        total3 = np.bincount(context, c3, n_context)
        t3 = np.minimum(c3, 1)
        c2 = np.bincount(parent, t3, len(v)).astype(np.int64)
        t2 = np.minimum(c2, 1)
        a, b = np.zeros(len(c3)), np.zeros(len(c3))
        for sweep in range(burn_in + samples):
            all2, total2 = np.bincount(v, t2, n_v), np.bincount(v, c2, n_v)
            p2 = (c2 - d2 * t2 + (s2 + d2 * all2[v]) * self.low) / (s2 + total2[v])
            all3 = np.bincount(context, t3, n_context)
            t3 = seat(c3, p2[parent], all3[context] - t3, d3, s3, self.seed[0], 2 * sweep)
            c2 = np.bincount(parent, t3, len(v)).astype(np.int64)
            t2 = np.minimum(t2, c2)
            all2 = np.bincount(v, t2, n_v)
            t2 = seat(c2, self.low, all2[v] - t2, d2, s2, self.seed[1], 2 * sweep + 1)
            if sweep >= burn_in:
                all3, all2, total2 = np.bincount(context, t3, n_context), np.bincount(v, t2, n_v), np.bincount(v, c2, n_v)
                rest3 = ((s3 + d3 * all3) / (s3 + total3))[context]
                a2, b2 = (c2 - d2 * t2) / (s2 + total2[v]), ((s2 + d2 * all2) / (s2 + total2))[v]
                a += ((c3 - d3 * t3) / (s3 + total3)[context] + rest3 * a2[parent]) / samples
                b += rest3 * b2[parent] / samples
        return a, b


def order_of(*columns: np.ndarray) -> np.ndarray:
    """The order by the columns, the first one first."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 64:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.uint64)
    for c, n in zip(columns, bits, strict=True):
        key = (key << np.uint64(n)) | c.astype(np.uint64)
    return np.argsort(key, kind="stable")


# -- counts ----------------------------------------------------------------------------------


def held_out(doc_id: object, m: int = 5) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % m == 1


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end; the number of tokens of each."""
    parts = [word_hashes([t or "" for t in texts[a:b]]) for a, b in pieces(texts, HASHED)]
    words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in parts)])
    n = np.concatenate([np.zeros(0, np.int64), *(k for _, k in parts)]) + 1
    out = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words, END
    return out, n


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """hash, c: training counts of all words of the corpus, 0 for those of held-out rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1):
            words, n = tokens(batch.column(1).to_pylist())
            taught = np.repeat([not held_out(i) for i in batch.column(0).to_pylist()], n)
            names, where = np.unique(words, return_inverse=True)
            c = np.bincount(where, taught, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(c)], ["hash", "n"])

    counts = map_arrow(documents.select(id_col, text_col), run, "hash long, n long")
    return counts.groupBy("hash").agg(F.sum("n").alias("c"))


def root_tables(words: np.ndarray, c: np.ndarray, v: int) -> np.ndarray:
    """Tables of words in the restaurant of all words, by their counts: the mean of SAMPLES draws."""
    types = max(float(v), 1.0)  # tables of the others: about one each
    low, others = np.full(len(c), 1 / (v + 1)), np.full(len(c), types)
    return sum(seat(c, low, others, DISCOUNTS[0], STRENGTHS[0], words, 10_000 + sample) for sample in range(SAMPLES)) / SAMPLES


class Words:
    """N, V, the tables of the restaurant of all words and what follows from them for a word's
    count. What is broadcast of the ``most`` most frequent words (None: of all that teach): hash,
    base (log10), low (probability), families (shares of the tokens that follow) and number (by count)
    in the order of hashes."""

    def __init__(self, counts: DataFrame, most: int | None = None) -> None:
        self.n, self.v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
        v = self.v

        def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, c = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([float(root_tables(words, c, v).sum())])], ["tables"])

        self.tables = map_arrow(counts.where("c > 0").select("hash", "c"), seated, "tables double").agg(F.coalesce(F.sum("tables"), F.lit(0.0))).first()[0]
        self.rate = (STRENGTHS[0] + DISCOUNTS[0] * self.tables) / (self.v + 1)
        self.least = 1 if most is None else self.least_of(counts, most)
        found = counts.where(F.col("c") >= self.least).toArrow()
        hashes, c = np.asarray(found["hash"], np.int64).view(np.uint64), np.asarray(found["c"], np.int64)
        order = np.argsort(hashes)
        self.hash, c = hashes[order], c[order]
        self.base, self.low = self.base_of(c), self.low_of(self.hash, c)
        self.low_rare = self.rate / (STRENGTHS[0] + self.n)  # of a word that doesn't teach
        self.families = -(-c // SPLIT_TOKENS)
        self.wide, self.wide_tokens = self.hash[self.families > 1], int(c[self.families > 1].sum())
        self.place = np.argsort(-c, kind="stable")  # of each number
        self.number = np.empty(len(c), np.uint32)
        self.number[self.place] = np.arange(len(c), dtype=np.uint32)

    @staticmethod
    def least_of(counts: DataFrame, most: int) -> int:
        """The least count so that at most ``most`` words have it or more."""
        # the number of words by count, counts rounded down to eighths of powers of two: some hundreds of rows
        step = F.floor(F.log2("c") * 8)
        by = counts.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()
        least, room = 1 << 62, most
        for r in by:
            room -= r.words
            if room < 0:
                break
            least = r.c
        return least

    def base_of(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def low_of(self, words: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The words' probabilities in the restaurant of all words."""
        return (c - DISCOUNTS[0] * root_tables(words, c, self.v) + self.rate) / (STRENGTHS[0] + self.n)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of words among the hot ones; -1 for others."""
        if not len(self.hash):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, words), len(self.hash) - 1)
        return np.where(self.hash[at] == words, at, -1)


# -- packed tokens ---------------------------------------------------------------------------


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of 32- or 64-bit numbers, each byte's plane by itself, compressed."""
    head = np.array([len(columns), *(x for c in columns for x in (len(c), c.dtype.itemsize))], np.uint32)
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.dtype.itemsize).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(1).compress(b"".join([head.tobytes(), *planes]))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(data, np.uint32, 1)[0])
    head = np.frombuffer(data, np.uint32, 2 * k, 4).tolist()
    out, at = [], 4 + 8 * k
    for n, size in zip(head[::2], head[1::2], strict=True):
        plane = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(np.uint32 if size == 4 else np.uint64))
        at += n * size
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32)


def wide(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def delta(x: np.ndarray) -> np.ndarray:
    """What each number is above the one before it, modulo 2^32: mostly zeros in the upper bytes."""
    return np.diff(narrow(x), prepend=np.uint32(0))


def from_delta(x: np.ndarray) -> np.ndarray:
    return wide(np.cumsum(x, dtype=np.uint32))


ESCAPE = np.uint32(1 << 31)


def escaped(place: np.ndarray, words: np.ndarray, names: np.ndarray, known: Words) -> np.ndarray:
    """Numbers of words: that of hot ones, and ESCAPE + the place in ``names`` of others."""
    out = np.empty(len(words), np.uint32)
    other = place < 0
    out[~other] = known.number[place[~other]]
    out[other] = np.searchsorted(names, words[other]).astype(np.uint32) | ESCAPE
    return out


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to PIECE characters or more, and cut to pieces below twice that."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(x.column(column).nbytes for x in waiting) >= PIECE:
            whole, waiting = pa.concat_batches(waiting), []
            yield from (whole.slice(a, b - a) for a, b in column_pieces(whole.column(column), 2 * PIECE))
    if waiting:
        whole = pa.concat_batches(waiting)
        yield from (whole.slice(a, b - a) for a, b in column_pieces(whole.column(column), 2 * PIECE))


class Piece:
    """Tokens of a piece: w, the word before (v) and the one before that (u), the text of each (doc)
    and the bucket it is dealt to: one of buckets[0], or of buckets[1] more for what follows wide words."""

    def __init__(self, texts: list[str | None], known: Words, buckets: tuple[int, int]) -> None:
        w, self.n = tokens(texts)
        self.first = first = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.place = place = known.find(w)
        v, u = np.concatenate([[START], w[:-1]]), np.concatenate([[START, START], w[:-2]])[: len(w)]
        v[first] = START
        u[first] = START
        self.second = first[self.n > 1] + 1
        u[self.second] = START
        at_v = np.concatenate([[-1], place[:-1]])
        at_v[first] = -1
        families = np.where(at_v >= 0, known.families[at_v] if len(known.families) else 1, 1)
        many = np.flatnonzero(families > 1)
        v_key = v.copy()
        v_key[many] += mix(u[many]) % families[many].astype(np.uint64) * _A
        dealt = mix(v_key) >> np.uint64(32)
        self.w, self.v, self.u, self.at_v = w, v, u, at_v
        self.bucket = ((dealt * np.uint64(buckets[0])) >> np.uint64(32)).astype(np.int64)
        self.bucket[many] = buckets[0] + ((dealt[many] * np.uint64(buckets[1])) >> np.uint64(32)).astype(np.int64)


def cut(texts: list[str | None], taught: np.ndarray, known: Words, buckets: tuple[int, int]) -> tuple[list[tuple[int, bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, packed tokens) of a piece, and of each text the number of tokens, of those of hot
    words, and the sum of their base scores."""
    piece = Piece(texts, known, buckets)
    w, u, n, first, doc, place, bucket = piece.w, piece.u, piece.n, piece.first, piece.doc, piece.place, piece.bucket
    hot = place >= 0
    sums = lambda x: np.add.reduceat(x, first)
    base = sums(np.where(hot, known.base[place] if len(known.base) else 0.0, 0.0))
    n_known = sums(hot.astype(np.int64))
    order = np.argsort(bucket.astype(np.uint16) if sum(buckets) <= 1 << 16 else bucket, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    names = np.unique(np.concatenate([w[~hot], [START]]))
    place_u = np.concatenate([[-1, -1], place[:-2]])[: len(w)]
    place_u[first] = -1
    place_u[piece.second] = -1
    number_w, number_u, number_v = escaped(place, w, names, known), escaped(place_u, u, names, known), escaped(piece.at_v, piece.v, names, known)
    mark = (doc * 2 + taught[doc]).astype(np.uint32)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = order[a:b]
        own = own[np.argsort(number_v[own], kind="stable")]
        start = np.flatnonzero(np.concatenate([[True], number_v[own][1:] != number_v[own][:-1]]))
        columns = [number_v[own[start]], number_w[own], number_u[own]]
        used = np.unique(np.concatenate([x[x >= ESCAPE] for x in columns]))
        for x in columns:
            far = x >= ESCAPE
            x[far] = np.searchsorted(used, x[far]).astype(np.uint32) | ESCAPE
        run = np.diff(np.append(start, len(own))).astype(np.uint32)
        out.append((int(bucket[own[0]]), pack([delta(columns[0]), run, *columns[1:], mark[own], names[(used ^ ESCAPE).astype(np.int64)]])))
    return out, n, n_known, base


class Dealt:
    """Packed tokens of one bucket with the hashes and counts of its words that are not hot: v, w, u
    (numbers), mark and blob of each token, hash and probability of each number."""

    def __init__(self, blobs: list[bytes], rare: tuple[np.ndarray, np.ndarray], known: Words) -> None:
        parts = [unpack(x) for x in blobs]
        names = np.unique(np.concatenate([p[5] for p in parts]))
        hot = len(known.hash)

        def numbers(z: np.ndarray, own: np.ndarray) -> np.ndarray:
            out = z.astype(np.int64)
            far = z >= ESCAPE
            out[far] = hot + np.searchsorted(names, own)[(z[far] ^ ESCAPE).astype(np.int64)]
            return out

        before, v = np.unique(np.concatenate([numbers(np.cumsum(p[0], dtype=np.uint32), p[5]) for p in parts]), return_inverse=True)
        self.v = np.repeat(v, np.concatenate([p[1] for p in parts]).astype(np.int64))
        self.w = np.concatenate([numbers(p[2], p[5]) for p in parts])
        self.u = np.concatenate([numbers(p[3], p[5]) for p in parts])
        mark = np.concatenate([p[4] for p in parts])
        self.taught, self.doc = (mark & 1).astype(bool), (mark >> np.uint32(1)).astype(np.int64)
        self.blob = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
        c = counts_of(names, *rare)
        self.hash = np.concatenate([known.hash[known.place], names])
        self.keys = self.hash[before]
        self.low = np.concatenate([known.low[known.place], known.low_of(names, c)])
        self.far = self.w >= hot
        at = self.w[self.far] - hot
        self.base, self.known = np.zeros(len(self.w)), self.far.copy()
        self.base[self.far], self.known[self.far] = known.base_of(c)[at], c[at] > 0


def scored(blobs: list[bytes], rare: tuple[np.ndarray, np.ndarray], known: Words) -> list[bytes]:
    """Of the packed tokens of one bucket: for each blob packed sums by document (see ``summed``)."""
    t = Dealt(blobs, rare, known)
    restaurants = Bucket(t.v, t.u, t.w, t.taught, t.keys, t.hash, t.low)
    a, b = restaurants.probabilities()
    lp = np.log10(np.maximum(a[restaurants.kind] + b[restaurants.kind] * t.low[t.w], 1e-300))
    return summed(len(blobs), t.blob, t.doc, lp, t.far, t.base, t.known)


def counts_of(names: np.ndarray, words: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Counts of the names among words (which may repeat); 0 of others."""
    if not len(words):
        return np.zeros(len(names), np.int64)
    order = np.argsort(words, kind="stable")
    at = order[np.minimum(np.searchsorted(words[order], names), len(words) - 1)]
    return np.where(words[at] == names, c[at], 0).astype(np.int64)


def summed(blobs: int, blob: np.ndarray, doc: np.ndarray, lp: np.ndarray, far: np.ndarray, base: np.ndarray, is_known: np.ndarray) -> list[bytes]:
    """For each blob, packed: its documents and their sums of lp; those with words that are not hot,
    the sums of these words' base scores and the number of known ones. Documents go as deltas."""
    key, at = np.unique((blob << 32) | doc, return_inverse=True)
    lp, base, seen, rare = (np.bincount(at, x, len(key)) for x in (lp, base, is_known, far))
    doc, some = key & 0xFFFFFFFF, rare > 0
    out = []
    edges = np.searchsorted(key, np.arange(blobs + 1) << 32)
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = np.flatnonzero(some[x:y]) + x
        out.append(pack([delta(doc[x:y]), lp[x:y].view(np.uint64), delta(doc[own]), base[own].view(np.uint64), seen[own].astype(np.uint32)]))
    return out


# -- wide words --------------------------------------------------------------------------------

#: What the packed rows of buckets (key: bucket) and wide words (key: word) hold.
ALL, LIVE, TABLES, DOWN, FIRST, UP, STATE = range(7)
PACKED = "key long, other long, tag int, blob binary"
Row = tuple[int, int, int, bytes]


def runs(v: np.ndarray) -> list[tuple[int, slice]]:
    """The slice of each number of sorted ones."""
    numbers, start = np.unique(v, return_index=True)
    return [(int(k), slice(a, b)) for k, a, b in zip(numbers, start.tolist(), [*start[1:].tolist(), len(v)], strict=True)]


def filled(number: np.ndarray, others: np.ndarray, values: np.ndarray, known: Words) -> np.ndarray:
    """The values of words: of hot ones by their numbers, of others as given in their order."""
    out, far = np.empty(len(number), values.dtype), number >= len(values)
    out[~far] = values[known.place[number[~far]]]
    out[far] = others
    return out


def share(bucket: int, blobs: list[bytes], pieces: list[int], rare: tuple[np.ndarray, np.ndarray], known: Words) -> tuple[list[bytes], list[Row]]:
    """Sums of base scores of a bucket of wide words' shares by blob, and its rows: ALL kinds of
    tokens, LIVE ones (that occur more than once), FIRST numbers of tables for the wide words. Hot words
    go by number, hashes and probabilities (low) of the others beside them."""
    t = Dealt(blobs, rare, known)
    r = Bucket(np.searchsorted(known.wide, t.keys)[t.v], t.u, t.w, t.taught, known.wide, t.hash, t.low)
    far, hot = t.far, len(known.hash)
    sums = summed(len(blobs), t.blob[far], t.doc[far], np.zeros(int(far.sum())), far[far], t.base[far], t.known[far])
    size = np.bincount(t.blob, minlength=len(blobs))
    order = order_of(t.blob, r.kind, t.doc)
    # a blob's kinds rise, so do a context's parents and a wide word's words
    every = [delta(r.kind[order]), narrow(t.doc[order]), narrow(size), np.array(pieces, np.int64).view(np.uint64), narrow(r.count), delta(r.context), delta(r.parent), delta(r.v), delta(np.minimum(r.w, hot)), r.low[r.w >= hot].view(np.uint64)]
    out = [(bucket, 0, ALL, pack(every))]
    once, often = r.count == 1, np.flatnonzero(r.count > 1)
    single, live = (np.bincount(r.parent, x, len(r.v)) for x in (once, r.count > 1))
    if len(often):
        context, at_context = np.unique(r.context[often], return_inverse=True)
        parent, at_parent = np.unique(r.parent[often], return_inverse=True)
        alone = np.bincount(r.context, once)[context]
        u, w = r.context_u[context], r.w[parent]
        columns = [delta(at_context), delta(at_parent), narrow(r.count[often]), narrow(alone), delta(r.context_v[context]), delta(np.minimum(u, hot)), t.hash[u[u >= hot]]]
        columns += [delta(r.v[parent]), delta(np.minimum(w, hot)), t.hash[w[w >= hot]], t.low[w[w >= hot]].view(np.uint64)]
        out.append((bucket, 0, LIVE, pack(columns)))
    for v, own in runs(r.v):
        w = r.w[own]
        out.append((v, bucket, FIRST, pack([delta(w[w < hot]), t.hash[w[w >= hot]], narrow(single[own]), narrow(live[own]), t.low[w[w >= hot]].view(np.uint64)])))
    return sums, out


def drawn_below(sweep: int, known: Words, bucket: int, rows: list[Row]) -> list[Row]:
    """A sweep of a bucket's live kinds: their TABLES, and UP, what they send to the wide words."""
    static = next((x for _, _, tag, x in rows if tag == LIVE), None)
    if static is None:
        return []
    (d2, d3), (s2, s3), hot = DISCOUNTS[1:], STRENGTHS[1:], len(known.hash)
    context, parent, count, alone, context_v, u, u_hash, v, w, w_hash, w_low = unpack(static)
    context, parent, count, context_v, u, v, w = from_delta(context), from_delta(parent), wide(count), from_delta(context_v), from_delta(u), from_delta(v), from_delta(w)
    context_hash = mix(known.wide[context_v] + filled(u, u_hash, known.hash, known))
    word, low = filled(w, w_hash, known.hash, known), filled(w, w_low.view(np.float64), known.low, known)
    t3 = next((wide(unpack(x)[0]) for _, _, tag, x in rows if tag == TABLES), np.ones(len(count), np.int64))
    above = {v: unpack(x) for _, v, tag, x in rows if tag == DOWN}
    p2 = np.empty(len(low))
    for k, own in runs(v):
        c2, t2, (total2, all2) = above[k]
        p2[own] = (c2 - d2 * t2 + (s2 + d2 * float(all2)) * low[own]) / (s2 + float(total2))
    all3 = np.bincount(context, t3, len(alone)) + alone
    t3 = seat(count, p2[parent], all3[context] - t3, d3, s3, mix(context_hash[context] + word[parent]), 2 * sweep)
    up, out, others = narrow(np.bincount(parent, t3, len(low))), [(bucket, 0, TABLES, pack([narrow(t3)]))], np.cumsum(w >= hot)
    for k, own in runs(v):
        x, (a, b) = w[own], (others[[own.start, own.stop - 1]] - [w[own.start] >= hot, 0]).tolist()
        out.append((k, bucket, UP, pack([delta(x[x < hot]), w_hash[a:b], up[own]])))
    return out


class Followers:
    """The words that follow a wide word: hot ones by number, then others by hash."""

    def __init__(self, number: np.ndarray, other: np.ndarray) -> None:
        self.number, self.other = number, other

    def find(self, number: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Places of words; the numbers are deltas."""
        return np.concatenate([np.searchsorted(self.number, from_delta(number)), len(self.number) + np.searchsorted(self.other, other)])


def drawn_above(sweep: int, known: Words, v: int, rows: list[Row]) -> list[Row]:
    """A sweep of a wide word's restaurant (-1: its first state): its STATE, and DOWN, what it
    sends to the buckets of its shares, in the order of what they sent."""
    d2, s2 = DISCOUNTS[1], STRENGTHS[1]
    sent = {bucket: unpack(x) for _, bucket, tag, x in rows if tag in (FIRST, UP)}
    if sweep < 0:
        other, first = np.unique(np.concatenate([x[1] for x in sent.values()]), return_index=True)
        words = Followers(np.unique(np.concatenate([from_delta(x[0]) for x in sent.values()])), other)
        other_low = np.concatenate([x[4] for x in sent.values()])[first]
        at = {bucket: words.find(*x[:2]) for bucket, x in sent.items()}
        size = len(words.number) + len(other)
        single, live = (np.bincount(np.concatenate(list(at.values())), np.concatenate([x[i] for x in sent.values()]), size).astype(np.int64) for i in (2, 3))
        c2 = single + live
        t2 = np.minimum(c2, 1)
        at = {bucket: at[bucket][x[3] > 0] for bucket, x in sent.items()}
    else:
        number, other, other_low, single, _, t2 = unpack(next(x for _, _, tag, x in rows if tag == STATE))
        words, single, t2 = Followers(from_delta(number), other), wide(single), wide(t2)
        at = {bucket: words.find(*x[:2]) for bucket, x in sent.items()}
        c2 = single.copy()
        for bucket, x in sent.items():
            c2[at[bucket]] += x[2]
        t2 = np.minimum(t2, c2)
        place = known.place[words.number]
        low, hashes = np.concatenate([known.low[place], other_low.view(np.float64)]), np.concatenate([known.hash[place], other])
        t2 = seat(c2, low, float(t2.sum()) - t2, d2, s2, mix(known.wide[v] ^ hashes), 2 * sweep + 1)
    totals = np.array([c2.sum(), t2.sum()], np.uint64)
    out = [(v, 0, STATE, pack([delta(words.number), other, other_low, narrow(single), narrow(c2), narrow(t2)]))]
    return out + [(bucket, v, DOWN, pack([narrow(c2[x]), narrow(t2[x]), totals])) for bucket, x in at.items()]


def last_above(v: int, rows: list[Row]) -> list[Row]:
    """The wide word's customers and tables in every sample, for all that follows it in each bucket."""
    states = [unpack(x) for _, _, _, x in sorted((r for r in rows if r[2] == STATE), key=lambda r: r[1])]
    totals = [np.array([wide(x[4]).sum(), wide(x[5]).sum()], np.uint64) for x in states]
    words = Followers(from_delta(states[0][0]), states[0][1])
    out = []
    for _, bucket, tag, x in rows:
        if tag == FIRST:
            at = words.find(*unpack(x)[:2])
            out.append((bucket, v, DOWN, pack([y for s, total in zip(states, totals, strict=True) for y in (s[4][at], s[5][at], total)])))
    return out


def last_below(known: Words, rows: list[Row]) -> list[tuple[int, bytes]]:
    """(piece, packed sums by document) of a bucket's tokens."""
    (d2, d3), (s2, s3) = DISCOUNTS[1:], STRENGTHS[1:]
    kind, doc, size, pieces, count, context, parent, v, w, w_low = unpack(next(x for _, _, tag, x in rows if tag == ALL))
    kind, count, context, parent, v = from_delta(kind), wide(count), from_delta(context), from_delta(parent), from_delta(v)
    low = filled(from_delta(w), w_low.view(np.float64), known.low, known)
    tables = {s: unpack(x)[0] for _, s, tag, x in rows if tag == TABLES}
    above = {v: unpack(x) for _, v, tag, x in rows if tag == DOWN}
    total3 = np.bincount(context, count)
    a, b = np.zeros(len(count)), np.zeros(len(count))
    for s in range(SAMPLES):
        t3 = np.minimum(count, 1)
        if s in tables:
            t3[count > 1] = tables[s]
        rest3 = ((s3 + d3 * np.bincount(context, t3)) / (s3 + total3))[context]
        a2, b2 = np.empty(len(v)), np.empty(len(v))
        for k, own in runs(v):
            c2, t2, (total2, all2) = above[k][3 * s : 3 * s + 3]
            a2[own] = (c2 - d2 * t2) / (s2 + float(total2))
            b2[own] = (s2 + d2 * float(all2)) / (s2 + float(total2))
        a += ((count - d3 * t3) / (s3 + total3)[context] + rest3 * a2[parent]) / SAMPLES
        b += rest3 * b2[parent] / SAMPLES
    lp = np.log10(np.maximum(a + b * low[parent], 1e-300))[kind]
    none = np.zeros(len(lp), bool)
    blob = np.repeat(np.arange(len(size)), size)
    return list(zip(pieces.view(np.int64).tolist(), summed(len(size), blob, wide(doc), lp, none, none, none), strict=True))


def by_key(rows: DataFrame, parts: int, fn: Callable[[int, list[Row]], list[Row]]) -> DataFrame:
    """The rows that fn makes of those of each key."""

    def batch_of(found: list[Row]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], ["key", "other", "tag", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Row] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and row[0] != waiting[0][0]:
                    yield batch_of(fn(waiting[0][0], waiting))
                    waiting = []
                waiting.append(row)
        if waiting:
            yield batch_of(fn(waiting[0][0], waiting))

    return map_arrow(rows.select("key", "other", "tag", "blob").repartition(parts, "key").sortWithinPartitions("key"), run, PACKED)


def swept(shares: DataFrame, shared: Broadcast[Words], buckets: int) -> DataFrame:
    """piece, blob: the sums of all tokens that follow wide words, from the rows of their shares."""
    tagged = lambda rows, *tags: rows.where(F.col("tag").isin(*tags))
    parts, words = max(buckets, 2), max(len(shared.value.wide), 2)
    above = lambda sweep, rows: materialize(by_key(rows, words, lambda v, x: drawn_above(sweep, shared.value, v, x)), "lm", keep_shuffles=False)
    firsts, state, samples = tagged(shares, FIRST), above(-1, tagged(shares, FIRST)), []
    tables = None
    for sweep in range(BURN_IN + SAMPLES):
        last = [x for x in (state, tables) if x is not None]
        live = tagged(shares, LIVE).unionByName(tagged(state, DOWN))
        if tables is not None:
            live = live.unionByName(tagged(tables, TABLES))
        tables = materialize(by_key(live, parts, lambda bucket, x, sweep=sweep: drawn_below(sweep, shared.value, bucket, x)), "lm", keep_shuffles=False)
        state = above(sweep, tagged(state, STATE).unionByName(tagged(tables, UP)))
        if sweep <= BURN_IN:  # what samples come from stays
            for x in last:
                drop_scratch(x)
        if sweep >= BURN_IN:
            number = F.lit(sweep - BURN_IN).cast("long")
            samples.append((tagged(state, STATE).withColumn("other", number), tagged(tables, TABLES).withColumn("other", number)))
    for x, _ in samples:
        firsts = firsts.unionByName(x)
    rows = tagged(shares, ALL).unionByName(by_key(firsts, words, last_above))
    for _, x in samples:
        rows = rows.unionByName(x)
    sums = by_key(rows, parts, lambda bucket, x: [(piece, 0, 0, blob) for piece, blob in last_below(shared.value, x)])
    return sums.select(F.col("key").alias("piece"), "blob")


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token and
    perplexity of every row."""
    spark = documents.sparkSession
    counts = materialize(word_counts(documents, id_col, text_col), "words", keep_shuffles=False)
    words = Words(counts, HOT_WORDS)
    shared = spark.sparkContext.broadcast(words)
    buckets = max(1, -(-(int(words.n) - words.wide_tokens) // BUCKET_TOKENS)), -(-words.wide_tokens // BUCKET_TOKENS)
    kind = documents.schema[id_col].dataType.simpleString()
    fields = {"bucket": pa.int32(), "piece": pa.int64(), "blob": pa.binary(), "row": pa.int64()}
    facts = {"held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64()}

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 0):
            piece = Piece(batch.column(0).to_pylist(), shared.value, buckets)
            other = piece.place < 0
            w, bucket = piece.w[other], piece.bucket[other]
            order = np.lexsort((w, bucket))
            w, bucket = w[order], bucket[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[new].astype(np.int32)), pa.array(w[new].view(np.int64))], ["bucket", "hash"])

    def packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            bucket, words, c = (np.concatenate([np.asarray(x.column(i)) for x in waiting]) for i in range(3))
            order = np.argsort(bucket, kind="stable")
            found = [(k, pack([words[own].view(np.uint64), c[own].astype(np.uint64)])) for k, part in runs(bucket[order]) for own in (order[part],)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            waiting.append(batch)
            if sum(len(x) for x in waiting) >= PIECE:
                yield done()
                waiting.clear()
        if waiting:
            yield done()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in gathered(batches, 1):
            ids = batch.column(0)
            held = np.array([held_out(i) for i in ids.to_pylist()], bool)
            blobs, n, n_known, base = cut(batch.column(1).to_pylist(), ~held, known, buckets)
            m, k = len(batch), len(blobs)
            none = [pa.nulls(k, t) for t in (pa.int64(), ids.type, *facts.values())]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in blobs], pa.int32()), pa.array(np.full(k, row)), pa.array([x for _, x in blobs], pa.binary()), *none], [*fields, "doc_id", *facts])
            rows = row + np.arange(m)
            own = [pa.array((rows % buckets[0]).astype(np.int32)), pa.array(np.full(m, row)), pa.nulls(m, pa.binary()), pa.array(rows)]
            yield pa.RecordBatch.from_arrays([*own, ids, pa.array(held), pa.array(n), pa.array(n_known), pa.array(base)], [*fields, "doc_id", *facts])
            row += m

    dealt = map_arrow(documents.select(id_col, text_col), deal, f"bucket int, piece long, blob binary, row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double")
    if words.v > len(words.hash):  # others are unknown
        held = map_arrow(documents.select(text_col), rare, "bucket int, hash long").join(counts.where((F.col("c") > 0) & (F.col("c") < words.least)), "hash")
        dealt = dealt.unionByName(map_arrow(held.select("bucket", "hash", "c"), packed_counts, "bucket int, blob binary"), allowMissingColumns=True)
    dealt = dealt.repartition(max(sum(buckets), 2), "bucket").sortWithinPartitions("bucket")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = ["piece", "blob", "row", "doc_id", *facts, "key", "other", "tag"]
        links = pa.int64(), pa.int64(), pa.int32()
        waiting: list[pa.RecordBatch] = []
        bucket, id_type = -1, None

        def done() -> Iterator[pa.RecordBatch]:
            found = [(p, x) for batch in waiting for p, x in zip(batch.column("piece").to_pylist(), batch.column("blob").to_pylist(), strict=True)]
            blobs, pieces = [x for p, x in found if p is not None], [p for p, _ in found if p is not None]
            if not blobs:
                return
            counted = [unpack(x) for p, x in found if p is None]
            rare, rows = tuple(np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in counted)]) for i in (0, 1)), []
            if bucket < buckets[0]:
                sums = scored(blobs, rare, known)
            else:
                sums, rows = share(int(bucket), blobs, pieces, rare, known)
            gaps = lambda n: [pa.nulls(n, t) for t in (pa.int64(), id_type, *facts.values())]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array(sums, pa.binary()), *gaps(len(pieces)), *(pa.nulls(len(pieces), t) for t in links)], names)
            if rows:
                key, other, tag, blob = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.array(blob, pa.binary()), *gaps(len(rows)), *(pa.array(x, t) for x, t in zip((key, other, tag), links, strict=True))], names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            own = batch.filter(batch.column("row").is_valid())
            if len(own):
                yield pa.RecordBatch.from_arrays([own.column("piece"), pa.nulls(len(own), pa.binary()), own.column("row"), own.column("doc_id"), *(own.column(f) for f in facts), *(pa.nulls(len(own), t) for t in links)], names)
            rest = batch.filter(batch.column("row").is_null())
            at = np.asarray(rest.column("bucket"))
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if y == x:
                    continue
                if at[x] != bucket and waiting:
                    yield from done()
                    waiting.clear()
                bucket = at[x]
                waiting.append(rest.slice(x, y - x).select(["piece", "blob"]))
        if waiting:
            yield from done()

    schema = f"piece long, blob binary, row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, key long, other long, tag int"
    out = materialize(map_arrow(dealt, sweep, schema), "lm", keep_shuffles=False)
    drop_scratch(counts)
    docs = out.where(F.col("n_tokens").isNotNull()).select("row", "doc_id", *facts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, np.zeros((3, 0))

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(piece + np.arange(total.shape[1])), *(pa.array(x) for x in total)], ["row", "lp", "lb", "known"])

        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != piece:
                    if piece is not None:
                        yield rows()
                    piece, total = at, np.zeros((3, 0))
                doc, lp, few, lb, seen = unpack(blob)
                doc, few = from_delta(doc), from_delta(few)
                if len(doc) and doc[-1] >= total.shape[1]:
                    total = np.concatenate([total, np.zeros((3, int(doc[-1]) + 1 - total.shape[1]))], axis=1)
                total[0, doc] += lp.view(np.float64)
                total[1, few] += lb.view(np.float64)
                total[2, few] += seen
        if piece is not None:
            yield rows()

    packed = out.where(F.col("piece").isNotNull() & F.col("blob").isNotNull()).select("piece", "blob")
    if buckets[1]:
        shares = out.where(F.col("tag").isNotNull()).select("key", "other", "tag", "blob")
        packed = packed.unionByName(swept(shares, shared, buckets[1]))
    sums = map_arrow(packed.repartition("piece").sortWithinPartitions("piece"), add, "row long, lp double, lb double, known double")
    total = F.col("lp")
    return docs.join(sums, "row").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("known")).cast("long").alias("n_known"),
        F.lit(int(words.n)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("lb")).alias("base_score"),
        total.alias("score"),
        (total / F.col("n_tokens")).alias("score_per_token"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
