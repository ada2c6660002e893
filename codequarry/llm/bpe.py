"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

Every leaf holds ``rank * size + position`` of the pair that starts there, so the root is the
leftmost pair of the lowest rank. A merge changes three leaves and their paths to the root;
encoding ends when the root holds no pair. ``merge_scalar`` does one long word,
``merge_batch`` many words of one tree size at once with array operations.

Defined results: null text is the empty text; an empty text gives no ids and the empty string;
empty tables give no rows; repeated rows give repeated results; of equal ranks the leftmost pair
is merged; very long texts and words are read whole; other columns are left out, whatever their
names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import column_pieces, map_batches

NONE = np.int64(1) << 62
#: Words kept with their ids in each worker; a full memo is set aside and words seen again come back from it.
MEMO_WORDS = 120_000
#: Texts of about so many characters are encoded at once: words repeat among them, arrays stay small.
TEXT_CHARS = 1_000_000
#: Words of up to so many symbols are merged in batches.
BATCH_SYMBOLS = 64
#: Code points that the tokenizer's engine counts as white space.
SPACE = r"[\t-\r \x85\xa0  -     　]"

# What the tokenizer's engine has otherwise than Unicode 15.1. Letters and numbers
# that its word pattern knows, pairs that its lower-casing knows (first, last, distance), and marks
# that its composition takes for base characters.
NEW_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
NEW_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
BASE_MARKS = "07fd 0898-089f 08ca-08d3 09fe 0c3c 0d3b-0d3c 0eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"


def code_points(ranges: str) -> str:
    """The inside of a character class of ranges in hexadecimal."""
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in ranges.split())


_lower = {c: c + step for first, last, step in NEW_CAPITALS for c in range(first, last + 1)}
_capital = re.compile("[" + "".join(map(chr, _lower)) + "]")
_base_mark = re.compile(f"([{code_points(BASE_MARKS)}])")
_new_letter, _new_number = re.compile(f"[{code_points(NEW_LETTERS)}]"), re.compile(f"[{code_points(NEW_NUMBERS)}]")


def composed(text: str) -> str:
    """The engine's NFC."""
    if _base_mark.search(text):
        return "".join(unicodedata.normalize("NFC", x) for x in _base_mark.split(text))
    return unicodedata.normalize("NFC", text)


def latin(text: str) -> bool:
    """Whether no character lies beyond U+00FF: such text is composed, and its capitals are Unicode's."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: White space of str.split() that Arrow's splitting at ASCII white space doesn't know.
_odd_space = re.compile("[\x1c-\x1f\x85\xa0]")
#: Characters whose class may be otherwise than Unicode's.
_late = re.compile("[^\x00-\u024f]")


def kind_of(ch: str) -> str:
    """A character of the class (letter, number, other) that the engine has ``ch`` in."""
    if ch > "\u024f" and unicodedata.category(ch) == "Cn":
        return "\u01bb" if _new_letter.match(ch) else "\u00b2" if _new_number.match(ch) else "\ufffe"
    return ch


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    keep = set(shown)
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


class PairRanks:
    """Open-addressing table from a pair of ids to its rank, probed with array operations."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        size = 1 << self.BITS
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int64)
        self.probes = 1
        keys = (left.astype(np.int64) << 32) | right
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            n = 1
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (size - 1)
                n += 1
            self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is no merge. Negative ids make no pair."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        for step in range(1, self.probes):
            if not len(todo):
                break
            at = (slot[todo] + step) & ((1 << self.BITS) - 1)
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (self.keys[at] >= 0)]
        return out


class WordBpe:
    """The tokenizer of a ``tokenizers`` JSON file with word ends (normalised, lower-cased words)."""

    def __init__(self, spec: str) -> None:
        conf = json.loads(spec)
        model = conf["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pairs = PairRanks(left, right)
        self.rank_of = {(a, b): r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.word = regex.compile(conf["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(f"{SPACE}+")
        self.separators = re.compile("[\x1c-\x1f]")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.memo: dict[str, bytes] = {}  # by word
        self.seen: dict[str, bytes] = {}  # by run of words without white space
        self.old_memo: dict[str, bytes] = {}
        self.old_seen: dict[str, bytes] = {}

    # -- words -------------------------------------------------------------------------------
    def chunks(self, text: str) -> list[str]:
        """NFC, lower case of each code point by itself, cut at white space: no word holds any,
        so that the tokenizer's replacement of white space by blanks changes nothing here."""
        if text.isascii():
            text = text.lower()
        else:
            text = composed(text).replace("Σ", "σ")
            text = text.translate(_lower).lower() if _capital.search(text) else text.lower()
        # str.split() would cut at these four too
        return self.space.split(text) if self.separators.search(text) else text.split()

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at added tokens, which are matched before it is normalised."""
        if self.special is None or not any(t in text for t in self.added):
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    # -- merging -----------------------------------------------------------------------------
    def symbols(self, word: str) -> list[int]:
        data = np.frombuffer(word.encode(), np.uint8)
        ids = self.inner[data]
        ids[-1] = self.final[data[-1]]
        return ids.tolist()

    def merge_scalar(self, sym: list[int]) -> list[int]:
        """One word, a tree in Python lists."""
        m = len(sym)
        if m < 2:
            return sym
        size = 1 << (m - 1).bit_length()
        none, rank_of, merged = int(NONE), self.rank_of, self.merged
        tree = [none] * (2 * size)
        for i in range(m - 1):
            rank = rank_of.get((sym[i], sym[i + 1]))
            if rank is not None:
                tree[size + i] = rank * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = [*range(1, m), -1], [-1, *range(m - 1)]

        def put(i: int) -> None:
            j = after[i]
            rank = rank_of.get((sym[i], sym[j])) if j >= 0 else None
            lift(i, none if rank is None else rank * size + i)

        def lift(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] != none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            sym[i] = int(merged[rank])
            sym[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            lift(j, none)
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [s for s in sym if s >= 0]

    def merge_batch(self, sym: np.ndarray, size: int) -> np.ndarray:
        """Words as rows of ids padded with -1 to ``size`` columns; merged away ids become -1."""
        n = len(sym)
        rows = np.arange(n)
        wide = np.concatenate([sym, np.full((n, 1), -1, np.int64)], axis=1)  # column ``size``: past the end
        rank = self.pairs.find(sym.ravel(), wide[:, 1:].ravel()).reshape(n, size)
        tree = np.full((n, 2 * size), NONE, np.int64)
        tree[:, size:] = np.where(rank < NONE, rank * size + np.arange(size), NONE)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after = np.tile(np.minimum(np.arange(1, size + 2), size), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))

        def lift(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            k = size + i
            tree[r, k] = value
            while k[0] > 1 if len(k) else False:
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        def put(r: np.ndarray, i: np.ndarray) -> None:
            found = self.pairs.find(wide[r, i], wide[r, after[r, i]])
            lift(r, i, np.where(found < NONE, found * size + i, NONE))

        rows = rows[tree[:, 1] < NONE]
        while len(rows):
            top = tree[rows, 1]
            i = top % size
            j = after[rows, i]
            nxt = after[rows, j]
            wide[rows, i] = self.merged[top // size]
            wide[rows, j] = -1
            after[rows, i] = nxt
            before[rows, nxt] = i
            lift(rows, j, np.full(len(rows), NONE))
            put(rows, i)
            p = before[rows, i]
            some = p >= 0
            put(rows[some], p[some])
            rows = rows[tree[rows, 1] < NONE]
        return wide[:, :size]

    def learn(self, words: list[str]) -> None:
        """Put the ids of distinct words into the memo."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            m = len(w) if w.isascii() else len(w.encode())
            if m > BATCH_SYMBOLS:
                self.memo[w] = np.array(self.merge_scalar(self.symbols(w)), "<u4").tobytes()
            else:
                by_size.setdefault(max(2, 1 << (m - 1).bit_length()), []).append(w)
        for size, group in by_size.items():
            step = max(1, 400_000 // size)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                data = [w.encode() for w in part]
                lens = np.fromiter(map(len, data), np.int64, len(data))
                flat = np.frombuffer(b"".join(data), np.uint8)
                row, ends = np.repeat(np.arange(len(data)), lens), np.cumsum(lens)
                ids = self.inner[flat]
                ids[ends - 1] = self.final[flat[ends - 1]]
                sym = np.full((len(data), size), -1, np.int64)
                sym[row, np.arange(len(flat)) - np.repeat(ends - lens, lens)] = ids
                out = self.merge_batch(sym, size)
                kept = out >= 0
                cut = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]) * 4
                raw, cut = out[kept].astype("<u4").tobytes(), cut.tolist()
                for k, w in enumerate(part):
                    self.memo[w] = raw[cut[k] : cut[k + 1]]

    # -- texts -------------------------------------------------------------------------------
    def words(self, chunk: str) -> list[str]:
        """The words of a chunk by the engine's classes of characters."""
        seen = "".join(map(kind_of, chunk))
        return [chunk[m.start() : m.end()] for m in self.word.finditer(seen)]

    def cut_chunk(self, chunk: str) -> list[str]:
        """The words of a chunk; letters, and letters before one sign, need no pattern."""
        if _late.search(chunk):
            return self.words(chunk)
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.word.findall(chunk)

    def learn_chunks(self, chunks: list[str]) -> None:
        """Put the ids of runs of words into the memo."""
        cut, memo = list(map(self.cut_chunk, chunks)), self.memo
        missing = {w for words in cut for w in words if w not in memo}
        known = missing & self.old_memo.keys()
        for w in known:
            memo[w] = self.old_memo[w]
        self.learn(list(missing - known))
        get = memo.__getitem__
        for chunk, words in zip(chunks, cut, strict=True):
            self.seen[chunk] = get(words[0]) if len(words) == 1 else b"".join(map(get, words))

    def recall(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, learned where neither memo has them."""
        out = list(map(self.seen.get, chunks))
        late = [i for i, ids in enumerate(out) if ids is None]
        missing = []
        for i in late:
            ids = self.old_seen.get(chunks[i])
            if ids is None:
                missing.append(chunks[i])
            else:
                self.seen[chunks[i]] = ids
        self.learn_chunks(list(dict.fromkeys(missing)))
        for i in late:
            out[i] = self.seen[chunks[i]]
        if len(self.seen) > MEMO_WORDS:
            self.seen, self.old_seen = {}, self.seen
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.old_memo = {}, self.memo
        return out

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Lower-case texts that ASCII white space alone cuts: each distinct chunk is looked up once,
        and ids are gathered by array operations."""
        if not texts:
            return []
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = cut.flatten().dictionary_encode()
        data = self.recall(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        ids, first = np.frombuffer(b"".join(data), "<u4"), np.cumsum(size) - size
        index = np.asarray(words.indices)
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = ids[np.repeat(first[index] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[np.asarray(cut.offsets) - cut.offsets[0].as_py()]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode_other(self, text: str) -> bytes:
        """A text of any characters, with added tokens."""
        parts = []
        for part, special in self.segments(text):
            parts += [np.array([self.added[part]], "<u4").tobytes()] if special else self.recall(self.chunks(part))
        return b"".join(parts)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        out, plain, lower = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            text = text or ""
            if (text.isascii() or latin(text)) and not _odd_space.search(text) and not any(t in text for t in self.added):
                plain.append(i)
                lower.append(text.lower())
            else:
                out[i] = self.encode_other(text)
        for i, raw in zip(plain, self.encode_plain(lower), strict=True):
            out[i] = raw
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, special ones kept, joined as a tokenizer without a decoder does."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[int, WordBpe] = {}


def load(spec: str) -> WordBpe:
    """One tokenizer a worker."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec)
    return _loaded[key]


def _shared(df: DataFrame, tokenizer_path: str):
    """The tokenizer's file, read on the driver and broadcast (a vocabulary: a few MB at most)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64_000_000:
        raise ValueError("the tokenizer's file is larger than 64 MB")
    return df.sparkSession.sparkContext.broadcast(spec)


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), decoded (string) of every row."""
    spec = _shared(df, tokenizer_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.Table:
        bpe = load(spec.value)
        texts = batch.column(1)
        ids, decoded = [], []
        for a, b in column_pieces(texts, TEXT_CHARS):
            for raw in bpe.encode_batch(texts.slice(a, b - a).to_pylist()):
                ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                decoded.append(bpe.decode(raw))
        return pa.table({id_col: batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())})

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and SHA-256 of ids and of the decoded text, without sending either back."""
    spec = _shared(df, tokenizer_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.Table:
        bpe = load(spec.value)
        texts = batch.column(1)
        n, of_ids, of_text = [], [], []
        for a, b in column_pieces(texts, TEXT_CHARS):
            for raw in bpe.encode_batch(texts.slice(a, b - a).to_pylist()):
                n.append(len(raw) // 4)
                of_ids.append(hashlib.sha256(raw).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(raw).encode()).hexdigest())
        return pa.table({id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())})

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
