"""Personal data: fixed patterns, and a semi-Markov conditional random field for other forms.

The base spans are those of the four patterns, leftmost and non-overlapping per kind. The field
adds spans of the same kinds written otherwise (local phone numbers, spelled-out addresses,
grouped card numbers and the like): a segmentation of the tokens is scored by features of whole
segments, entities are MAX_TOKENS tokens at most, and dynamic programming picks boundaries and
kinds together. Added spans do not overlap base spans. Tokens far from any digit, ``@`` or
spelled-out ``at`` can't be part of an entity, so the program runs over the other stretches only.

The field is fitted by gradient steps on the exact log-likelihood of SENTENCES sentences made by
rule from a seed, so it needs no data of the corpus.

Defined results: null is the empty text and has no spans; rows repeated give repeated results;
empty tables give no rows; very long texts are read whole; of equally good segmentations the one
found first, with fewer entities, is taken; other columns are left out by ``report`` and kept by
``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, map_batches

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 18
SENTENCES = 240
#: What each added span costs the score of a segmentation.
MARGIN = 1.0

_email_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match can begin inside a run of digits where it doesn't begin at the run's first digit.
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_local_chars = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _local_chars:
            start -= 1
        m = _email_domain.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


# -- the field -------------------------------------------------------------------------------

_token = re.compile(r"[^\W_]+|[^\w\s]|_")
_trigger = re.compile(r"[0-9]|@|[\[({<]\s*(?:at|AT|At)\s*[\])}>]")
_spelled = re.compile(r"[\w.+-]+\s*(?:@|[\[({<]\s*(?:at)\s*[\])}>])\s*[\w-]+(?:\s*(?:\.|[\[({<]\s*(?:dot)\s*[\])}>])\s*[\w-]+)+", re.I)
_dotted = re.compile(r"\d{1,3}(?:\s*(?:\.|[\[({<]\s*(?:\.|dot)\s*[\])}>])\s*\d{1,3}){3}", re.I)
_local_phone = re.compile(r"(?:\+?\d{1,3}[ .-])?\(?\d{2,4}\)?[ .-]\d{3}[ .-]\d{4}")
_groups = re.compile(r"\d{4}(?:[ ./-]+\d{4}){3}")

# Words that announce a kind.
CUES = {
    "email": {"mail", "email", "e", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "addr", "ping"},
    "card": {"card", "visa", "mastercard", "amex", "credit"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "cell"},
}
N_FEATURES = 19


def span_features(text: str, start: int, end: int, before: str, n_tokens: int) -> np.ndarray | None:
    """What a whole segment looks like; None if it can't be an entity at all."""
    s = text[start:end]
    digits = re.sub(r"[^0-9]", "", s)
    mail = ("@" in s) or bool(_trigger.search(s) and not digits)
    if not mail and len(digits) < 4:
        return None
    if not s[0].isalnum() and s[0] not in "+(" or not s[-1].isalnum():
        return None
    letters = sum(c.isalpha() for c in s)
    f = np.zeros(N_FEATURES)
    f[0] = 1
    f[1] = mail
    f[2] = bool(_spelled.fullmatch(s))
    f[3] = bool(_dotted.fullmatch(s)) and all(int(p) < 256 for p in re.findall(r"\d+", s))
    f[4] = bool(_local_phone.fullmatch(s))
    f[5] = bool(_groups.fullmatch(s))
    f[6] = 16 <= len(digits) <= 19 and luhn(digits)
    f[7] = 7 <= len(digits) <= 15
    f[8] = letters > 0 and not mail
    f[9] = s[0] == "+"
    f[10] = "(" in s and ")" in s
    f[11] = math.log1p(len(digits))
    f[12] = n_tokens / 8
    for k, kind in enumerate(KINDS):
        f[13 + k] = before in CUES[kind]
    f[17] = start > 0 and not text[start - 1].isspace() and text[start - 1] not in ":=(\"'<["
    f[18] = end < len(text) and (text[end] in "@/-_" or (text[end] in ".:" and end + 1 < len(text) and text[end + 1].isalnum()))
    return f


class Stretch:
    """Tokens of one stretch; the features of the segments that can be entities are made as they
    are needed, so that a stretch of any length takes little memory."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], before: str = "") -> None:
        self.text, self.tokens = text, tokens
        self.cue = [""]
        for w in (before, *(text[a:b].lower() for a, b in tokens)):
            self.cue.append(w if w.isalpha() else self.cue[-1])

    def ending(self, j: int) -> list[tuple[int, np.ndarray]]:
        """First token and features of the segments that end with token j."""
        out = []
        for i in range(max(0, j + 1 - MAX_TOKENS), j + 1):
            f = span_features(self.text, self.tokens[i][0], self.tokens[j][1], self.cue[i + 1], j + 1 - i)
            if f is not None:
                out.append((i, f))
        return out

    @cached_property
    def segments(self) -> list[list[tuple[int, np.ndarray]]]:
        return [self.ending(j) for j in range(len(self.tokens))]

    def best(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """(first token, last token, kind) of the entities of the best segmentation; of equal ones
        the one with fewer, later entities."""
        n = len(self.tokens)
        score, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(n):
            score[j + 1] = score[j]
            for i, f in self.ending(j):
                s = w @ f - MARGIN
                k = int(np.argmax(s))
                if score[i] + s[k] > score[j + 1]:
                    score[j + 1], back[j + 1] = score[i] + s[k], (i, k)
        out, j = [], n
        while j:
            if back[j]:
                out.append((back[j][0], j - 1, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def gradient(self, w: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """Of the log-likelihood: features seen minus features expected."""
        n = len(self.tokens)
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        scores = [[(i, f, w @ f) for i, f in found] for found in self.segments]
        for j in range(n):
            ahead[j + 1] = np.logaddexp.reduce([ahead[j], *(ahead[i] + np.logaddexp.reduce(s) for i, _, s in scores[j])])
        at: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
        for j in range(n):
            for i, _, s in scores[j]:
                at[i].append((j, s))
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j + 1] + np.logaddexp.reduce(s) for j, s in at[i])])
        out = np.zeros_like(w)
        for j in range(n):
            for i, f, s in scores[j]:
                out -= np.outer(np.exp(ahead[i] + s + behind[j + 1] - ahead[n]), f)
                if (i, j) in gold:
                    out[gold[i, j]] += f
        return out


def training_sentences(n: int = SENTENCES, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences made by rule, with the spans of their entities."""
    r = random.Random(seed)
    filler = "the and of report order version line from with item build page total about was see".split()
    name = lambda: "".join(r.choices("abdeghilmnorstu", k=r.randint(2, 7)))
    num = lambda k: "".join(r.choices("0123456789", k=k))

    def card() -> str:
        d = num(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def entity() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            at, dot = r.choice([("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", ".")])
            return kind, f"{name()}{r.choice(['', '.' + name(), num(2)])}{at}{name()}{dot}{r.choice(['com', 'org', 'net'])}"
        if kind == "ip":
            dot = r.choice([".", "[.]", " [dot] "])
            return kind, dot.join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            d, sep = card(), r.choice(["", " ", "-", ".", "/", " - "])
            return kind, sep.join(d[i : i + 4] for i in range(0, 16, 4))
        return kind, r.choice(["({0}) {1}-{2}", "{0}-{1}-{2}", "{0} {1} {2}", "+1 {0} {1} {2}", "{0}.{1}.{2}"]).format(num(3), num(3), num(4))

    def other() -> str:
        return r.choice(
            [num(r.randint(1, 7)), f"{num(4)}-{num(2)}-{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(3)}.{num(2)}", "".join(r.choices("0123456789abcdef", k=r.choice([8, 18, 32, 40]))), f"{num(2)}:{num(2)}:{num(2)}", f"#{num(6)}", f"{num(1)},{num(3)},{num(3)}", num(r.choice([9, 10, 12, 16])), f"{num(4)} {num(4)}", f"AKIA{num(6)}"]
        )

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 5)):
            text += r.choice(filler) + " "
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                kind, s = entity()
                if r.random() < 0.5:
                    text += r.choice(sorted(CUES[kind])) + r.choice([": ", " "])
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = other()
            text += s + r.choice([" ", ", ", ". "])
            for _ in range(r.randint(1, 3)):
                text += r.choice(filler) + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """Fitted once, on the driver."""
    data = []
    for text, spans in training_sentences():
        tokens = [m.span() for m in _token.finditer(text)]
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}
        gold = {(first[a], last[b]): KINDS.index(kind) for kind, a, b in spans}
        data.append((Stretch(text, tokens), gold))
    w = np.zeros((len(KINDS), N_FEATURES))
    w[:, 0] = -2
    square = np.zeros_like(w)
    for _ in range(12):
        for stretch, gold in data:
            g = stretch.gradient(w, gold) - 0.002 * w
            square += g * g
            w += 0.5 * g / np.sqrt(square + 1e-8)
    return w


def stretches(text: str) -> list[tuple[list[tuple[int, int]], str]]:
    """The tokens near a trigger, in stretches, with the word before each."""
    reach, regions = 60, []
    for m in _trigger.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        while a > 0 and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
        if tokens := [m.span() for m in _token.finditer(text, a, b)]:
            out.append((tokens, ""))
    return out


def all_spans(text: str | None, w: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and these with the added ones, both by kind and start."""
    text = text or ""
    base = base_spans(text)
    if not _digit.search(text) and "@" not in text and not _trigger.search(text):
        return base, base
    starts, ends = [], []  # what base spans cover
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for tokens, before in stretches(text):
        for i, j, k in Stretch(text, tokens, before).best(w):
            a, b = tokens[i][0], tokens[j][1]
            at = bisect_left(starts, b)
            if not at or ends[at - 1] <= a:
                added.append((KINDS[k], a, b))
    if not added:
        return base, base
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, all spans and their number, of every row."""
    kind = documents.schema[id_col].dataType.simpleString()
    fitted = documents.sparkSession.sparkContext.broadcast(weights())

    def run(batch: pa.RecordBatch) -> pa.Table:
        w = fitted.value
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digest, line, n = [], [], []
        for text in batch.column(1):
            base, every = all_spans(text.as_py(), w)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in base))
            digest.append(hashlib.sha256(_line(base).encode()).hexdigest())
            line.append(_line(every))
            n.append(len(every))
        return pa.table({id_col: batch.column(0), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}, "base_sha256": digest, "spans": pa.array(line, pa.string()), "n_spans": pa.array(n, pa.int64())})

    return map_batches(documents.select(id_col, text_col), run, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by their kind in angle brackets; overlapping ones become one."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    out, last = [], 0
    for kind, a, b in merged:
        out += [text[last:a], f"<{kind.upper()}>"]
        last = b
    return "".join([*out, text[last:]])


def redact(documents: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All columns, with the spans of the text replaced; the length column of changed texts, if
    there is one, is set anew."""
    at = documents.columns.index(text_col)
    size = documents.columns.index(length_col) if length_col in documents.columns else None
    fitted = documents.sparkSession.sparkContext.broadcast(weights())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = fitted.value
        texts = batch.column(at).to_pylist()
        lengths = batch.column(size).to_pylist() if size is not None else None
        for i, text in enumerate(texts):
            if text and (spans := all_spans(text, w)[1]):
                texts[i] = redact_text(text, spans)
                if lengths is not None:
                    lengths[i] = len(texts[i])
        columns = batch.columns
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if size is not None:
            columns[size] = pa.array(lengths, batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(documents, lambda batches: map(run, batches), documents.schema)
