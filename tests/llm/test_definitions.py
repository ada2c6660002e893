"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns; and plain
versions of what the operators compute."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import bpe, decontaminate, pii, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"b{k}" for k in range(14))
LONG = "word other, " * 30_000 + "mail a@b.org " + ITEM + " moron" * 400
TEXTS = [(1, None), (None, "a b"), (None, "a b"), (2, ""), (3, LONG), (4, f"x {ITEM} y"), (4, f"x {ITEM} y"), (5, "the same"), (5, "not the same"), (None, None)]
CLASHING = ("hit_id", "hit_hash", "text_hash", "new_text", "run_first", "run_last", "own_id", "node", "y", "t", "slot", "shard", "ids", "n_tokens", "spans", "score")


@pytest.fixture(scope="module")
def odd(spark):
    out = spark.createDataFrame([(i, t, None, "s", len(t) if t else None) for i, t in TEXTS], DOCS)
    return out.withColumns({c: F.lit(7) for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100, 180)] + [(None, None, None), (5, None, 7)], "doc_id long, quality int, toxic int")
    train = spark.createDataFrame([(i, ("moron idiot " if i % 2 else "") + " ".join(f"v{(i * 7 + k) % 900}" for k in range(30)), "en", "s", 1) for i in range(100, 180)], DOCS)
    return items, labels, train


def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_odd_rows(odd, tables):
    items, labels, train = tables
    n, none = len(TEXTS), odd.where("false")
    hit = decontaminate.report(odd, items).collect()
    assert len(hit) == n and sorted((r.doc_id, r.n_hit) for r in hit if r.contaminated) == [(3, 14), (4, 14), (4, 14)]
    assert all(r.n_items == 1 for r in hit if r.contaminated)  # a null item_id is not listed
    cut = decontaminate.remove_spans(odd, items)
    assert cut.columns == odd.columns and cut.count() == n
    by = {r.doc_id: r for r in cut.where("doc_id is not null").collect()}
    assert by[4].text == "x  y" and by[4].n_chars == 4 and by[4].new_text == 7 and by[3].text == LONG.replace(ITEM, "") and by[1].text is None
    assert decontaminate.drop_documents(odd, items).count() == n - 3 and decontaminate.remove_spans(none, items).count() == 0
    assert not decontaminate.report(odd, items.where("false")).where("contaminated").count()
    placed = sharding.place(odd, ["a", "b"], size=13)
    assert placed.count() == n and sharding.place(none, ["a"], size=13).count() == 0
    spans = pii.report(odd).collect()
    assert len(spans) == n and {r.doc_id for r in spans if r.n_email} == {3} and pii.report(none).count() == 0
    assert pii.redact(odd).columns == odd.columns and pii.redact(none).count() == 0
    assert {r.text for r in pii.redact(odd).where("doc_id = 3").collect()} == {LONG.replace("a@b.org", "<EMAIL>")}
    lexicon = toxicity.train(train.unionByName(odd.select(train.columns)), labels)
    assert toxicity.keep_clean(odd, lexicon).count() == n - 1 and toxicity.keep_clean(none, lexicon).count() == 0
    assert toxicity.report(none, labels).count() == 0 and len(toxicity.report(odd, labels.where("false")).collect()) == n
    ids = bpe.digests(odd, path()).collect()
    assert len(ids) == n and sum(r.n_tokens == 0 for r in ids) == 3


def test_pipeline_of_odd_and_empty_tables(spark, odd, tables, tmp_path):
    items, labels, train = tables
    for name, docs, more in (("odd", odd, train), ("none", odd.where("false"), None)):
        at = f"{tmp_path}/{name}"
        rows = docs if more is None else docs.unionByName(more, allowMissingColumns=True)
        for table, df in (("documents", rows), ("benchmark", items), ("labels", labels)):
            df.write.parquet(f"{at}/{table}.parquet")
        out = corpus_pipeline.run(spark, at)
        got = out.collect()
        assert out.columns[:2] == ["doc_id", "n_tokens"] and bool(got) == (more is not None)
    # null texts stay, toxic texts go, and of equal texts one stays
    assert sum(r.doc_id is None for r in got) == 0
    kept = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()]
    assert kept.count(None) == 2 and kept.count(4) == 1 and kept.count(5) == 2 and 3 not in kept and 1 in kept and not any(i is not None and i >= 100 and i % 2 for i in kept)


def test_segmentations_by_enumeration():
    w = pii.weights()
    r = random.Random(2)
    signs = ["4111", "1111", "tel", "030", "1234567", "at", "@", ".", "x", "dot", "(", ")", "+49", "10"]
    for _ in range(60):
        text = " ".join(r.choices(signs, k=r.randint(1, 7)))
        tokens = [m.span() for m in re.finditer(r"[^\W_]+|[^\w\s]|_", text)]
        stretch = pii.Stretch(text, tokens)
        value = {(i, j): float((w @ f).max()) - pii.MARGIN for j in range(len(tokens)) for i, f in stretch.ending(j)}
        best = 0.0
        for k in range(min(4, len(value)) + 1):
            for some in itertools.combinations(sorted(value), k):
                if all(a[1] < b[0] for a, b in itertools.pairwise(some)):
                    best = max(best, sum(value[s] for s in some))
        found = stretch.best(w)
        assert all(a[1] < b[0] for a, b in itertools.pairwise(found))
        assert sum(value[i, j] for i, j, _ in found) >= best - 1e-9


def test_lexicon_by_plain_search():
    lex = toxicity.Lexicon({"moron": 3.0, "idiot": 2.5, "and": 2.1}, {"moro": 1.0, "idiot": 0.5}, {("moron", "tree"), ("no", "idiot")}, (-3.0, 0.5, 1.0))
    found = lex.automaton()
    r = random.Random(3)
    for _ in range(300):
        words = r.choices(["moron", "idiot", "idiotic", "moronic", "tree", "no", "and", "sand", "M0R0N", "x"], k=r.randint(0, 8))
        folded = [toxicity.fold_word(toxicity.fold(x)) for x in words]
        total, distinct = 0.0, {}
        for k, x in enumerate(folded):
            before, after = folded[k - 1] if k else "", folded[k + 1] if k + 1 < len(folded) else ""
            if x in lex.words and (x, after) not in lex.exceptions and (before, x) not in lex.exceptions:
                total += lex.words[x]
                distinct[x, True] = lex.words[x]
            for stem, weight in lex.stems.items():
                if x.startswith(stem):
                    total += weight
                    distinct[stem, False] = weight
        want = (sum(distinct.values()), total / math.sqrt(len(words) + 10)) if words else (0.0, 0.0)
        assert lex.features(" ".join(words), found) == pytest.approx(want)
