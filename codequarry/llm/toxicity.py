"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits and signs standing for letters), an
Aho-Corasick automaton finds lexicon entries at word starts, matches inside exception phrases
do not count, and the weighted sum, normalised by length, goes through a logistic curve.

The lexicon and the curve are learned from labelled texts: about SAMPLE_ROWS of them at most, taken
by the hash of the id, distinct texts only, counted on the executors. Entries are whole folded words and word beginnings
that occur in toxic texts far more often than in others; their weights are log-odds from one
half of the sample, the curve is fitted on the other half; the MOST_ENTRIES strongest entries are
kept, and sums above MOST_WEIGHT count as that. Exception phrases (an entry with its
next or previous word) are those seen in clean texts only.

Defined results: null is the empty text; an empty text scores the curve at no match; rows
without label, or with a label other than 0 and 1, teach nothing; without any usable labels the
score is DEFAULT_SCORE; repeated rows score alike; a label of 1 wins over one of 0 for the same id
or text; empty tables give no rows; very long texts are read whole; other columns are left out by
``score`` and kept by ``keep_clean``, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, drop_scratch, map_arrow, map_batches, materialize

#: Labelled texts that teach the lexicon and the curve, at most.
SAMPLE_ROWS = 20_000
LEAST_TOXIC_TEXTS = 5
LEAST_LOG_ODDS = 2.0
MOST_ENTRIES = 2_000
STEM_LENGTHS = (5, 6)
DEFAULT_SCORE = 0.0
#: Sums of weights count up to this much.
MOST_WEIGHT = 40.0
CUT = 0.7

# Letters that look like a Latin one, and digits and signs used in place of letters.
HOMOGLYPHS = str.maketrans(
    "авеікморстухјѕԁһԛԝɡɑαειικνορτυχο",
    "abeikmopctyxjsdhqwgaaeiiknoptuxo",
)
DIGITS = str.maketrans("013457@$!|", "oieastasil")

_spelled = re.compile(r"(?<=[^\W\d_])[0-9@$!|]|[0-9@$!|](?=[^\W\d_])")


def fold(text: str) -> str:
    """Lower case, without accents, homoglyphs as Latin letters; digits and signs next to a
    letter as the letter they stand for."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c) and c not in "​‌‍﻿\xad").translate(HOMOGLYPHS)
    return text


def fold_word(word: str) -> str:
    """A folded word with digits and signs inside it spelled out; pure numbers stay."""
    if word.isalpha() or not any(c.isalpha() for c in word):
        return word
    return _spelled.sub(lambda m: m.group().translate(DIGITS), word.rstrip("!|"))


def folded_words(text: str) -> list[str]:
    return [fold_word(w).strip(_EDGES) for w in fold(text).split()]


_EDGES = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()) + "¡¿«»“”‘’…–—"


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.words.items():
            found.add_word(f" {entry} ", (f" {entry} ", weight, True))
        for entry, weight in self.stems.items():
            if f" {entry}" not in found:
                found.add_word(f" {entry}", (f" {entry}", weight, False))
        if len(found):
            found.make_automaton()
        return found

    def features(self, text: str, found: ahocorasick.Automaton) -> tuple[float, float]:
        """The weighted sum of the distinct matched entries, and the weights per root of the length."""
        words = folded_words(text)
        if not len(found) or not words:
            return 0.0, 0.0
        line = f" {' '.join(words)} "
        best: dict[str, float] = {}
        total, whole = 0.0, set()
        for end, (entry, weight, is_word) in found.iter(line):
            start = end - len(entry) + 1
            if is_word:
                whole.add(start)
                if self.exceptions and self.excepted(line, start, end):
                    continue
            elif start in whole:
                continue
            total += weight
            best[entry] = weight
        return sum(best.values()), total / math.sqrt(len(words) + 10)

    def excepted(self, line: str, start: int, end: int) -> bool:
        word = line[start + 1 : end]
        before = line[line.rfind(" ", 0, start) + 1 : start] if start > 0 else ""
        after = line[end + 1 : line.find(" ", end + 1)] if end + 1 < len(line) else ""
        return (word, after) in self.exceptions or (before, word) in self.exceptions

    def score(self, text: str | None, found: ahocorasick.Automaton) -> float:
        a, b = self.features(text or "", found)
        z = self.curve[0] + self.curve[1] * min(a, MOST_WEIGHT) + self.curve[2] * min(b, MOST_WEIGHT)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def units(words: list[str]) -> set[tuple[str, bool]]:
    """What can become an entry: whole words and beginnings of longer ones."""
    out: set[tuple[str, bool]] = set()
    for w in set(words):
        if len(w) >= 3 and w.isalpha():
            out.add((w, True))
            for n in STEM_LENGTHS:
                if len(w) > n:
                    out.add((w[:n], False))
    return out


def learn(rows: DataFrame) -> Lexicon:
    """From distinct texts ``t`` with labels ``y`` of 0 and 1 and a side: 0 gives entries, weights
    and exceptions, 1 the curve. Texts are counted where they are; what comes back are
    MOST_ENTRIES entries, the exceptions next to them, and three numbers a text of side 1."""
    lex = Lexicon()
    n = {r["y"]: r["n"] for r in rows.where("side = 0").groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_bad, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_bad or not n_clean:
        return Lexicon(curve=(-40.0, 0.0, 0.0))

    def counted(batch: pa.RecordBatch) -> pa.Table:
        seen: dict[tuple[str, bool], list[int]] = {}
        for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for u in units(folded_words(t.as_py())):
                seen.setdefault(u, [0, 0])[y] += 1
        return pa.table({"entry": pa.array([e for e, _ in seen], pa.string()), "is_word": pa.array([w for _, w in seen], pa.bool_()), "clean": pa.array([c for c, _ in seen.values()], pa.int64()), "bad": pa.array([b for _, b in seen.values()], pa.int64())})

    each = map_batches(rows.where("side = 0").select("t", "y"), counted, "entry string, is_word boolean, clean long, bad long", 500)
    total = each.groupBy("entry", "is_word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where(F.col("bad") >= LEAST_TOXIC_TEXTS)
    odds = F.log((F.col("bad") + 0.5) / F.lit(n_bad + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    kept = total.withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS).orderBy(F.desc(F.col("odds") * F.col("bad")), "entry", "is_word").limit(MOST_ENTRIES).collect()
    seen = {(r["entry"], r["is_word"]): r["bad"] for r in kept}
    for r in kept:
        if r["is_word"]:
            lex.words[r["entry"]] = r["odds"]
        elif not any(w.startswith(r["entry"]) and 2 * seen[w, True] > r["bad"] for w in lex.words):
            lex.stems[r["entry"]] = r["odds"]
    shared = rows.sparkSession.sparkContext.broadcast(lex)

    def beside(batch: pa.RecordBatch) -> pa.Table:
        entries, found = shared.value.words, {}
        for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = folded_words(t.as_py())
            for p in zip(words, words[1:], strict=False):
                if p[0] in entries or p[1] in entries:
                    found.setdefault(p, [0, 0])[y] += 1
        return pa.table({"a": pa.array([a for a, _ in found], pa.string()), "b": pa.array([b for _, b in found], pa.string()), "clean": pa.array([c for c, _ in found.values()], pa.int64()), "bad": pa.array([b for _, b in found.values()], pa.int64())})

    pairs = map_batches(rows.where("side = 0").select("t", "y"), beside, "a string, b string, clean long, bad long", 500).groupBy("a", "b").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    lex.exceptions = {(r["a"], r["b"]) for r in pairs.where((F.col("clean") >= 3) & (F.col("bad") == 0)).collect()}
    complete = rows.sparkSession.sparkContext.broadcast(lex)

    def described(batch: pa.RecordBatch) -> pa.Table:
        own = complete.value
        found = own.automaton()
        x = [own.features(t.as_py(), found) for t in batch.column(0)]
        return pa.table({"y": batch.column(1), "a": pa.array([a for a, _ in x], pa.float64()), "b": pa.array([b for _, b in x], pa.float64())})

    x = map_batches(rows.where("side = 1").select("t", "y"), described, "y int, a double, b double", 2_000).toArrow()
    x = np.stack([np.asarray(x[k], float) for k in "yab"])
    y, a, b = x[:, np.lexsort(x[::-1])]  # in an order of their own, whatever tasks ended first
    if len(y) and 0 < y.sum() < len(y):
        lex.curve = fit_curve(np.stack([np.ones(len(y)), np.minimum(a, MOST_WEIGHT), np.minimum(b, MOST_WEIGHT)], axis=1), y)
    return lex


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps along which the loss falls: where the
    classes are apart, whole steps overshoot and don't come back."""
    ridge = np.array([1e-6, 1e-3, 1e-3])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + w @ (ridge * w) / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        share = 1.0
        while share > 1e-9 and loss(w + share * step) > now - 1e-4 * share * (slope @ step):
            share /= 2
        if share <= 1e-9:
            break
        w = w + share * step
        last, now = now, loss(w)
        if last - now < 1e-10 * (1 + last):
            break
    return tuple(float(v) for v in w)


def train(documents: DataFrame, labels: DataFrame, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """``keep``: a condition on the id column that training rows fulfil."""
    own = labels.where(F.col(label_col).isin(0, 1))
    own = (own.where(keep) if keep is not None else own).groupBy(F.col(id_col).alias("own_id")).agg(F.max(label_col).cast("int").alias("y"))
    # the ids are drawn by hash before any text is moved; SAMPLE_ROWS of them, about, are broadcast
    share = min(1.0, SAMPLE_ROWS / max(1, own.count()))
    ids = own.where(F.pmod(F.xxhash64("own_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    texts = documents.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(ids), F.col("doc") == F.col("own_id"))
    sample = materialize(texts.select("doc", "t", "y", F.sha2("t", 256).alias("digest")), "labelled")
    # a text counts once, and as toxic if it is so anywhere
    once = sample.groupBy("digest").agg(F.max("y").alias("y"), F.min("doc").alias("doc"))
    side = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % 2
    rows = sample.drop("y").join(F.broadcast(once), ["digest", "doc"]).dropDuplicates(["digest"]).select("t", "y", side.alias("side"))
    rows = materialize(rows, "sample")
    out = learn(rows)
    drop_scratch(sample)
    drop_scratch(rows)
    return out


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # MOST_ENTRIES entries at most
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.Table:
        lex = shared.value
        if getattr(lex, "_found", None) is None:
            lex._found = lex.automaton()
        scores = [lex.score(t.as_py(), lex._found) for t in batch.column(1)]
        return pa.table({id_col: batch.column(0), "score": pa.array(scores, pa.float64())})

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    lexicon = train(documents, labels, crc_mod(F.col("doc_id"), 3) != 1)
    return score(documents, lexicon).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def keep_clean(documents: DataFrame, lexicon: Lexicon, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows scored below ``cut``, all columns kept."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> pa.Table:
        lex = shared.value
        if getattr(lex, "_found", None) is None:
            lex._found = lex.automaton()
        keep = [lex.score(t.as_py(), lex._found) < cut for t in batch.column(text_col)]
        return pa.Table.from_batches([batch]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(documents, lambda batches: (b for batch in batches for b in run(batch).to_batches()), documents.schema)
