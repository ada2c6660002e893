"""Scalar expressions: patterns, names, modes, ids and paths."""

from __future__ import annotations

import json
import posixpath
import re
from functools import reduce
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry import schema as S

# -- patterns --------------------------------------------------------------------------------


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[]")


def glob_to_regex(pattern: str) -> str:
    """Anchored Java regex: ``*``, ``?``, classes with ranges and ``^``; an open class matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c != "[":
            out.append(re.escape(c))
        else:
            end = i + (pattern[i : i + 1] == "^")
            end = pattern.find("]", end + 1)
            if end < 0:
                return r"(?!)"
            body = pattern[i:end]
            negate, body = body.startswith("^"), body.removeprefix("^")
            body = re.sub(r"([\\\[\]&^~|])", r"\\\1", body)
            out.append(f"[{'^' if negate else ''}{body}]")
            i = end + 1
    return r"(?s)\A" + "".join(out) + r"\z"


def glob_prefix(pattern: str) -> str:
    return re.split(r"[*?\[]", pattern, maxsplit=1)[0]


def matches(column: Column, pattern: str) -> Column:
    """Equality, or the pattern's regex with its literal prefix as a range that reaches the scan."""
    if not is_glob(pattern):
        return column == pattern
    test = column.rlike(glob_to_regex(pattern))
    prefix = glob_prefix(pattern)
    if prefix and ord(prefix[-1]) < 0x10FFFF and not 0xD7FF <= ord(prefix[-1]) < 0xE000:
        test = (column >= prefix) & (column < prefix[:-1] + chr(ord(prefix[-1]) + 1)) & test
    return test


# -- names -----------------------------------------------------------------------------------


def leaf_name(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", -1)


def qualified_name(owner: Column, name: Column) -> Column:
    return F.when(F.coalesce(owner, F.lit("")) != "", F.concat(owner, F.lit("."), name)).otherwise(name)


def _lookup(code: Column, names: list[str]) -> Column:
    return F.when(code.between(0, len(names) - 1), F.element_at(F.array(*map(F.lit, names)), code.cast("int") + 1)).otherwise(F.lit("?"))


def kind_name(kind: Column, cli: bool = False) -> Column:
    return _lookup(kind, ["var" if cli and n == "variable" else n for n in S.KIND_NAMES])


def kind_char(kind: Column) -> Column:
    return _lookup(kind, S.KIND_CHARS)


def kind_code(name: str) -> int:
    return S.KIND_NAMES.index("variable" if name == "var" else name)


def record_type(record: Column, action: Column) -> Column:
    return F.when(record == S.USE, "reference").when(action == S.DECLARATION, "declaration").otherwise("definition")


# Names of codes.
ACTION_NAMES = {S.SYMBOL: ["declaration", "definition"], S.USE: ["read", "write", "address", "call"]}
STATUS_NAMES = ["clean", "partial", "failed"]


def action_name(record: Column, action: Column) -> Column:
    return F.when(record == S.USE, _lookup(action, ACTION_NAMES[S.USE])).otherwise(_lookup(action, ACTION_NAMES[S.SYMBOL]))


def parse_status(returned: Column, errors: Column, has_data: Column) -> Column:
    """clean, partial or failed, by what a parse returned, its errors and whether it gave any rows."""
    return F.when((returned == 0) & (errors == 0) & has_data, STATUS_NAMES[0]).when(has_data, STATUS_NAMES[1]).otherwise(STATUS_NAMES[2])


def display_column(line: str, column: int, tab: int = 8) -> int:
    """The column from 1 as shown, tabs going to the next multiple of ``tab``."""
    at = 0
    for c in line[: column - 1]:
        at = (at // tab + 1) * tab if c == "\t" else at + 1
    return at + 1


def mode_string(mode: Column) -> Column:
    """A character each for address, value and pointer: ``-``, ``r``, ``w`` or ``m`` for both."""

    def one(r: int, w: int) -> Column:
        reads, writes = mode.bitwiseAND(F.lit(r)) != 0, mode.bitwiseAND(F.lit(w)) != 0
        return F.when(reads & writes, "m").when(reads, "r").when(writes, "w").otherwise("-")

    return F.concat(one(S.R_AOF, S.W_AOF), one(S.R_VAL, S.W_VAL), one(S.R_PTR, S.W_PTR))


def parse_mode(text: str) -> int | str:
    """``def``, or the bits of a three-character mode or of its one-character form."""
    if text == "def":
        return text
    text = {"r": "rrr", "w": "ww-", "m": "mmm", "-": "---"}.get(text, text)
    if len(text) != 3 or set(text) - set("rwm-"):
        raise ValueError(f"invalid mode: {text}")
    bits = [(S.R_AOF, S.W_AOF), (S.R_VAL, S.W_VAL), (S.R_PTR, S.W_PTR)]
    return sum((r if c in "rm" else 0) | (w if c in "wm" else 0) for c, (r, w) in zip(text, bits, strict=True))


# -- ids -------------------------------------------------------------------------------------


def id_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.coalesce(value, F.lit(0)).cast("long"))), 16, "0")


def parse_id(text: str) -> int:
    if not re.fullmatch(r"[0-9A-Fa-f]{1,16}", text):
        raise ValueError(f"invalid id: {text}")
    n = int(text, 16)
    return n - (1 << 64) if n >= 1 << 63 else n


def id_from_hex(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


@F.pandas_udf(T.LongType())
def usr_id(usr: pd.Series) -> pd.Series:
    """64-bit xxHash of seed 0 (the engine's own function has another seed); 0 for no text."""
    import xxhash

    def one(s: str | None) -> int:
        n = xxhash.xxh64_intdigest(s.encode()) if s else 0
        return n - (1 << 64) if n >= 1 << 63 else n

    return usr.map(one)


def encode_cursor(values: dict) -> str:
    return json.dumps(values, sort_keys=True, separators=(",", ":")).encode().hex()


def decode_cursor(text: str, names: list[str]) -> dict:
    try:
        out = json.loads(bytes.fromhex(text))
    except ValueError as error:
        raise ValueError("invalid cursor") from error
    if not isinstance(out, dict) or sorted(out) != sorted(names):
        raise ValueError("invalid cursor")
    if any(isinstance(v, bool) or not isinstance(v, int | str) or isinstance(v, int) and not -(1 << 63) <= v < 1 << 63 for v in out.values()):
        raise ValueError("invalid cursor")
    return out


def is_commit(text: str) -> bool:
    return text == "auto" or bool(re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", text))


# -- paths and positions ---------------------------------------------------------------------


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_to_byte(line: str, column: int) -> int:
    """The byte offset of a zero-based UTF-16 column; past the end it is the line's length."""
    units = 0
    for i, c in enumerate(line):
        if units >= column:
            return len(line[:i].encode())
        units += 2 if ord(c) > 0xFFFF else 1
    return len(line.encode())


def uri_to_path(uri: str) -> str | None:
    m = re.fullmatch(r"file://(localhost)?(/[^?#]*)", uri, re.I)
    return unquote(m[2]) if m else None


def path_to_uri(path: str) -> str:
    return "file://" + quote(path, safe="/-._~")


def candidate_paths(path: str, workspace: str, cwd: str) -> list[str]:
    """Absolute, relative to the workspace, relative to the working directory; distinct, in order."""
    whole = posixpath.normpath(posixpath.join(cwd, path))
    out = [whole]
    for base in (workspace, cwd):
        if within(whole, base):
            out.append(posixpath.relpath(whole, base))
    return list(dict.fromkeys(out))


def within(path: str, root: str) -> bool:
    path, root = posixpath.normpath(path), posixpath.normpath(root)
    return path == root or path.startswith(root.rstrip("/") + "/")


def stored_path(path: str, root: str | None) -> str:
    path = posixpath.normpath(path)
    return posixpath.relpath(path, root) if root and within(path, root) else path


def pack_arguments(arguments: list[str]) -> bytes:
    return b"".join(a.encode() + b"\x00" for a in arguments)


def unpack_arguments(data: bytes) -> list[str]:
    if data and not data.endswith(b"\x00"):
        raise ValueError("arguments must end with NUL")
    return [a.decode() for a in data.split(b"\x00")[:-1]]


_WITH_VALUE = {"-o", "-MF", "-MT", "-MQ", "-I", "-D", "-U", "-include", "-x", "-isystem"}


def source_argument(arguments: list[str]) -> str | None:
    """The C or assembly source among compiler arguments, if there is exactly one."""
    found, skip = [], False
    for a in arguments[1:]:
        if skip:
            skip = False
        elif a in _WITH_VALUE:
            skip = True
        elif not a.startswith("-") and re.search(r"\.[cSs]$", a):
            found.append(a)
    return found[0] if len(found) == 1 else None


_DROPPED = r"^(-M[DMPFTQ]*|-M[FTQ].+|-W[pa],.*|-Werror.*|-o.*|-c|-save-temps.*)$"
_WITH_NEXT = ("-o", "-MF", "-MT", "-MQ")


def sanitise_arguments(arguments: Column) -> Column:
    """Without dependency output, warnings as errors and outputs, and what belongs to them as the
    next argument."""
    before = lambda i: F.coalesce(F.get(arguments, i - 1), F.lit(""))
    return F.filter(arguments, lambda a, i: ~a.rlike(_DROPPED) & ~before(i).isin(*_WITH_NEXT))


# -- output formats --------------------------------------------------------------------------

DEFAULT_FORMAT = r"(%m) %F\t%l\t%c\t%C\t%s"


def format_search(pattern: str) -> Column:
    """A line by format letters, from record columns and ``source``, the text of the line."""
    letters = {
        "f": F.col("path"),
        "F": F.concat("variant", F.lit(":"), "path"),
        "v": F.col("variant"),
        "l": F.col("line").cast("string"),
        "c": F.col("col").cast("string"),
        "C": F.col("context"),
        "n": F.col("symbol"),
        "m": F.when(F.col("record") == S.USE, mode_string(F.col("mode"))).when(F.col("action") == S.DEFINITION, "def").otherwise("decl"),
        "k": kind_char(F.col("kind")),
        "s": F.col("source") if "%s" in pattern else F.lit(""),
    }
    escapes = {"t": "\t", "n": "\n", "r": "\r", "\\": "\\"}
    parts: list[Column] = []
    it = iter(pattern)
    for c in it:
        if c == "%":
            letter = next(it, None)
            if letter not in letters:
                raise ValueError(f"invalid format: %{letter or ''}")
            parts.append(F.coalesce(letters[letter], F.lit("")))
        elif c == "\\":
            letter = next(it, "\\")
            parts.append(F.lit(escapes.get(letter, letter)))
        else:
            parts.append(F.lit(c))
    return reduce(lambda a, b: F.concat(a, b), parts, F.lit(""))
