"""Packing, the audit of filters and centroid clustering against plain versions, on odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import audit, centroids, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


# -- 11 --------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_tail_once(seed):
    r = random.Random(seed)
    size = r.choice([16, 64, 2048])
    least = r.choice([1, 1, 4])
    shapes = (lambda: r.randint(1, size - 1), lambda: r.choice([size // 2 + 1, size - 1]), lambda: min(size - 1, int(r.expovariate(4 / size)) + 1))
    histogram = Counter(r.choice(shapes)() for _ in range(r.randint(0, 600)))
    whole = packing.plan(dict(histogram), size, least)
    taken = defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            sequence, offset, at = whole.place(length, rank)
            pieces = [(0, length, sequence, offset)] if at is None else list(whole.cut(at, length))
            assert [a for a, *_ in pieces] == list(itertools.accumulate([0, *(x for _, x, *_ in pieces[:-1])])) and sum(x for _, x, *_ in pieces) == length
            for _, x, s, o in pieces:
                taken[s].append((o, x))
    padding = 0
    for parts in taken.values():
        at = 0
        for o, x in sorted(parts):
            assert o == at
            at += x
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding <= (least - 1) * len(taken) and set(taken) == set(range(whole.sequences))


def test_patterns_follow_item_by_item():
    """Counts of patterns are those of documents dealt one by one, each into the shortest pack."""
    for seed in range(30):
        r = random.Random(seed)
        lengths = sorted((r.randint(1, 63) for _ in range(r.randint(1, 300))), reverse=True)
        packs = []
        for x in lengths:
            k = min(range(len(packs)), key=lambda i: (sum(packs[i]), i), default=None)
            if k is None or sum(packs[k]) + x > 64:
                packs.append([x])
            else:
                packs[k].append(x)
        got = Counter()
        for p in packing.shortest_pack_first(dict(Counter(lengths)), 64):
            got[p.used] += p.count
        assert got == Counter(map(sum, packs))


def test_packing(spark):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    r = random.Random(4)
    texts = [None, "", "a", "the same text", "the same text", "word other, " * 900, "x " * 131, "y" * 700] + [" ".join(r.choices(["ab", "Cde", "fgh!", "ij"], k=r.randint(1, 300))) for _ in range(150)]
    rows = [(None if i == 3 else i % 140, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("part", "rank", "length", "start", "tail", "at", "n", "before", "sequence_id")}).repartition(3)
    for size, least in ((2048, 1), (128, 1), (128, 16)):
        got = packing.pack(df, path(), size=size, least_room=least).collect()
        docs, sequences = defaultdict(list), defaultdict(list)
        for p in got:
            docs[p.doc_id].append(p)
            sequences[p.sequence_id].append(p)
        padding = 0
        for parts in sequences.values():
            at = 0
            for p in sorted(parts, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= size
            padding += 0 if at & (at - 1) == 0 else size - at
        assert padding <= (least - 1) * len(sequences)
        by = defaultdict(list)
        for i, t, *_ in rows:
            by[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
        assert set(by) == set(docs)
        for i, own in by.items():
            want = Counter()
            # pieces of rows repeated under one id: cut points are those of some row
            for ids in own:
                for p in docs[i]:
                    if p.doc_tokens == len(ids) and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32:
                        want[p.start, p.length] += 1
            assert all(want[p.start, p.length] for p in docs[i])
            assert sum(p.length for p in docs[i]) == sum(map(len, own))
    assert packing.pack(df.where("false"), path()).count() == 0


# -- 12 --------------------------------------------------------------------------------------
def plain_audit(rows, labels):
    import re

    lowest = {}
    for i, t, _ in rows:
        if i is not None:
            lowest[t or ""] = min(lowest.get(t or "", i), i)
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    masks = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and lowest[t] < i}
        masks[lang or ""].append(({c for c in fails if fails[c]}, i in good, i in toxic))
    out = {}
    for part, docs in masks.items():
        by_order = defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, c in enumerate(order):
                removed = [d for d in left if c in d[0]]
                before = len(docs) - len(left)
                gone = [d for d in docs if d[0] & set(order[:step])]
                assert len(gone) == before
                left = [d for d in left if c not in d[0]]
                by_order[c] += len(removed)
                out[part, order, step + 1] = [len(left), len(removed), sum(c in d[0] for d in gone), sum(d[0] == {c} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed), c]
        for key in out:
            if key[0] == part:
                out[key][6] = by_order[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    r = random.Random(5)
    long = " ".join(f"w{k}" for k in range(230))
    texts = [None, "", " \t\n", "ABC def", long, long.upper(), long + " $", "same " * 400, "same " * 400 + "#", "é\x0bÀ|x", long + " b" * 150_000, "  a"]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(200)]
    rows += [(None, r.choice(texts), "en") for _ in range(30)] + [(7, texts[4], "en")] * 3 + [(0, "a", "de"), (0, "a", "en"), (1, "a", "de")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, 7])) for i in range(0, 200, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1), (999, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in ("part", "own", "digest", "n", "id", "good", "toxic", "spread", "least", "w")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(True) for c in ("good", "id", "spread")})
    got = {tuple(x[:3]): tuple(x[3:]) for x in audit.audit(df, marks).collect()}
    assert got == plain_audit(rows, labels)
    assert len(audit.audit(df, marks.where("false")).collect()) == 600 * 3
    assert audit.audit(df.where("false"), marks).count() == 0


# -- 13 --------------------------------------------------------------------------------------
def plain_clusters(rows, k, rounds, width):
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in named[:k]]
    if not at:
        return []
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in at] for _, v in kept]
        own = [x.index(min(x)) for x in d]
        if r < rounds:
            for c in range(len(at)):
                group = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                if group:
                    at[c] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    each = [x[o] for x, o in zip(d, own, strict=True)]
    return [(i, o, x, sum(y for y, q in zip(each, own, strict=True) if q == o), sum(each), hashlib.sha256(",".join(map(str, at[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, own, each, strict=True)]


@pytest.mark.parametrize("seed,scale", [(1, 0.01), (2, 1.0), (3, 50_000.0), (4, 0.002)])
def test_clusters(spark, seed, scale):
    r = random.Random(seed)
    width = 4 if seed < 4 else 2
    rows = [(i, [r.gauss(r.choice([-3, 0, 3]), 1) * scale for _ in range(width)]) for i in range(250)]
    rows += [(i, [0.5 * scale] * width) for i in range(250, 330)] + [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, [1.0]), (902, [None] * width), (903, [float("nan")] * width), (904, [float("inf")] * width), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("v", "own", "upper", "lower", "cluster")})
    got = centroids.cluster(df, 8, 6, width).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain_clusters(rows, 8, 6, width), key=key)


def test_clusters_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, None)], "vec_id long, embedding array<float>")
    assert {(x.vec_id, x.cluster, x.distance, x.inertia) for x in centroids.cluster(df, width=2).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}
    assert centroids.cluster(df.where("vec_id = 3"), width=2).count() == 0 and centroids.cluster(df.where("false"), width=2).count() == 0
    far = [(i, [float(x), 1e15 * x]) for i, x in enumerate([1, 2, -3, 9000, 9100])]
    got = centroids.cluster(spark.createDataFrame(far, "vec_id long, embedding array<double>"), 2, 3, 2).collect()
    limit = (1 << 63) - 1
    want = plain_clusters([(i, v) for i, v in far], 2, 3, 2)
    assert len(got) == 5 and {(x.vec_id, x.distance <= limit) for x in got} == {(i, True) for i in range(5)} and len(want) == 5


def test_bounds_spare_scans():
    r = np.random.default_rng(1)
    at = r.integers(-1000, 1000, (8, 16))
    v = np.repeat(at, 200, axis=0) + r.integers(-60, 60, (1600, 16))
    first = centroids.Bounds(at, None)
    own, upper, lower, scans = first.assign(v, np.full(1600, -1, np.int32), np.zeros(1600), np.zeros(1600))
    assert scans == 1600
    moved = at + r.integers(-3, 4, at.shape)
    own2, *_, scans = centroids.Bounds(moved, at).assign(v, own, upper, lower)
    assert scans < 100 and (own2 == centroids.squares(v, moved).argmin(axis=1)).all()
