"""Preprocessing of C text: directives, conditions and macros, with the place of every token.

A place is a number: the offset in a file plus the base that the file got when it was entered, so
that tokens of headers, macro bodies and macro arguments keep the place where they are spelled.
Tokens that are made by pasting have the place NOWHERE. Branches that a condition leaves out are not read.

Which file an include names is decided beforehand (``includes.py``); what can't be found, and what
can't be read, becomes a diagnostic and reading goes on.
"""

from __future__ import annotations

import operator
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

NOWHERE = -1
#: Macros that a compiler knows by itself, as far as conditions ask for them.
BUILT_IN = {"__STDC__": "1", "__STDC_VERSION__": "201710L", "__STDC_HOSTED__": "1", "__GNUC__": "4", "__GNUC_MINOR__": "2", "__CHAR_BIT__": "8"}
#: Depth of includes and number of tokens beyond which a unit is given up.
MOST_DEPTH = 200
MOST_TOKENS = 20_000_000

# Operators of C that have more than one character, and the order of binary ones in conditions.
OPERATORS = "... <<= >>= -> ++ -- << >> <= >= == != && || += -= *= /= %= &= ^= |= ##"
PRECEDENCE = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]

_token = re.compile(
    r"(?P<space>[ \t\r\f\v]+|//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|\\\r?\n)|(?P<line>\n)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)"
    r"|(?P<text>(?:L|u8?|U)?(?:\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))|(?P<sign>" + "|".join(map(re.escape, OPERATORS.split())) + r"|.)",
    re.S,
)
_apply: dict[str, Callable[[int, int], int]] = {
    "||": lambda a, b: bool(a or b), "&&": lambda a, b: bool(a and b), "|": operator.or_, "^": operator.xor, "&": operator.and_, "==": operator.eq, "!=": operator.ne,
    "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "+": operator.add, "-": operator.sub, "*": operator.mul,
}
_level = {sign: level for level, signs in enumerate(PRECEDENCE) for sign in signs}


class Token(NamedTuple):
    kind: str  # name, number, text or sign
    text: str
    place: int
    spaced: bool = False
    hidden: frozenset[str] = frozenset()  # macros that may not expand here again


@dataclass
class Macro:
    parameters: list[str] | None  # None: without parentheses
    variadic: bool
    body: list[Token]


class Condition(Exception):
    """A condition that can't be evaluated."""


def lines(text: str) -> list[list[Token]]:
    """Tokens by line, with offsets as places; continued lines are one."""
    out, line, spaced = [], [], False
    for m in _token.finditer(text):
        kind = m.lastgroup
        if kind == "space":
            spaced = True
        elif kind == "line":
            if line:
                out.append(line)
            line, spaced = [], False
        else:
            line.append(Token(kind, m.group(), m.start(), spaced))
            spaced = False
    return [*out, line] if line else out


class Unit:
    """One main file with what it includes."""

    def __init__(self, text_of: Callable[[str], list[list[Token]] | None], size_of: Callable[[str], int], target: Callable[[str, str, bool], str | None], define: dict[str, str] | None = None) -> None:
        """text_of: the lines of a file, or None; target: which file an include in a file names."""
        self.text_of, self.size_of, self.target = text_of, size_of, target
        self.macros: dict[str, Macro] = {}
        self.once: set[str] = set()
        self.bases: list[int] = []
        self.files: list[str] = []  # entered files in the order of their bases; one base a file
        self.base_of: dict[str, int] = {}
        self.free = 0
        self.tokens: list[Token] = []
        self.uses: list[tuple[int, str, str]] = []  # place, name, what: define, macro, or file
        self.problems: list[tuple[int, str]] = []
        self.counter = 0
        for name, value in {**BUILT_IN, **(define or {})}.items():
            body = [t._replace(place=NOWHERE) for line in lines(value) for t in line]
            self.macros[name] = Macro(None, False, body)

    # -- places ----------------------------------------------------------------------------
    def where(self, place: int) -> tuple[str, int]:
        """The file and the offset in it."""
        k = bisect_right(self.bases, place) - 1
        return self.files[k], place - self.bases[k]

    # -- files -----------------------------------------------------------------------------
    def enter(self, path: str, depth: int = 0) -> None:
        if path in self.once:
            return
        own = self.text_of(path)
        if own is None:
            return
        if path not in self.base_of:
            self.base_of[path] = self.free
            self.bases.append(self.free)
            self.files.append(path)
            self.free += self.size_of(path) + 1
        base = self.base_of[path]
        run: list[Token] = []
        open_: list[list[bool]] = []  # of each condition: outer is active, a branch was taken, this one is active
        active = True
        for line in own:
            if line[0].text != "#" or line[0].kind != "sign":
                if active:
                    run += [t._replace(place=t.place + base) for t in line]
                continue
            rest = [t._replace(place=t.place + base) for t in line[1:]]
            word = rest[0].text if rest else ""
            if word in ("if", "ifdef", "ifndef"):
                taken = active and self.holds(rest, path)
                open_.append([active, taken])
                active = taken
            elif word in ("elif", "elifdef", "elifndef") and open_:
                outer, taken = open_[-1]
                active = outer and not taken and self.holds(rest, path)
                open_[-1][1] = taken or active
            elif word == "else" and open_:
                active = open_[-1][0] and not open_[-1][1]
                open_[-1][1] = True
            elif word == "endif" and open_:
                active = open_.pop()[0]
            elif not active or not word:
                continue
            elif word in ("elif", "elifdef", "elifndef", "else", "endif"):
                self.problems.append((rest[0].place, f"#{word} without #if"))
            elif word in ("include", "include_next", "import"):
                self.flush(run)
                self.include(rest, path, base, depth)
                run = []
            elif word == "pragma" and [t.text for t in rest[1:2]] == ["once"]:
                self.once.add(path)
            elif word == "error":
                self.problems.append((rest[0].place, "#error " + " ".join(t.text for t in rest[1:])))
            elif word in ("define", "undef") and len(rest) > 1 and rest[1].kind == "name":
                self.flush(run)
                run = []
                if word == "undef":
                    self.macros.pop(rest[1].text, None)
                else:
                    self.define(rest[1:])
        self.flush(run)
        if open_:
            self.problems.append((base + max(0, self.size_of(path) - 1), "unterminated conditional directive"))

    def flush(self, run: list[Token]) -> None:
        """The text between two directives, expanded. Macros change only at directives."""
        self.tokens += self.expand(run, path=None)
        if len(self.tokens) > MOST_TOKENS:
            raise Condition("too many tokens")

    def include(self, rest: list[Token], path: str, base: int, depth: int) -> None:
        parts = rest[1:]
        if parts and parts[0].kind == "name":
            parts = self.expand(parts, path)
        if not parts:
            return
        at, angled = parts[0].place, parts[0].text == "<"
        if angled:
            inner = parts[1 : next((i for i, t in enumerate(parts) if t.text == ">"), len(parts))]
            name = "".join(" " * (t.spaced and i > 0) + t.text for i, t in enumerate(inner))
        elif parts[0].kind == "text" and parts[0].text[:1] == '"':
            name = parts[0].text[1:].removesuffix('"')
        else:
            self.problems.append((at, "expected a file name"))
            return
        found = self.target(path, name, angled)
        if found is None:
            self.problems.append((at, f"'{name}' file not found"))
        self.uses.append((at, f"<{name}>" if angled else found or name, "file"))
        if found is not None:
            if depth >= MOST_DEPTH:
                self.problems.append((at, "#include nested too deeply"))
            else:
                self.enter(found, depth + 1)

    def define(self, rest: list[Token]) -> None:
        name, body = rest[0], rest[1:]
        self.uses.append((name.place, name.text, "define"))
        if not body or body[0].text != "(" or body[0].spaced:
            self.macros[name.text] = Macro(None, False, body)
            return
        stop = next((i for i, t in enumerate(body) if t.text == ")"), None)
        if stop is None:
            self.problems.append((name.place, "missing ')' in macro parameter list"))
            return
        inner = [t.text for t in body[1:stop] if t.text != ","]
        variadic = bool(inner) and inner[-1] == "..."
        if variadic:
            # a name before the dots stands for the rest
            named = len(inner) > 1 and body[stop - 2].kind == "name"
            inner = inner[:-1] if named else [*inner[:-1], "__VA_ARGS__"]
        self.macros[name.text] = Macro(inner, variadic, body[stop + 1 :])

    # -- macros ----------------------------------------------------------------------------
    def expand(self, tokens: list[Token], path: str | None, condition: bool = False) -> list[Token]:
        work, out, macros = tokens[::-1], [], self.macros
        made = 0
        while work:
            t = work.pop()
            m = macros.get(t.text) if t.kind == "name" else None
            if m is None or t.text in t.hidden:
                if t.kind == "name" and t.text in ("__LINE__", "__COUNTER__", "__FILE__"):
                    t = self.special(t)
                out.append(t)
                continue
            if m.parameters is None:
                self.use(t)
                body = self.substitute(m, [], t.hidden | {t.text})
            else:
                if not work or work[-1].text != "(" or work[-1].kind == "text":
                    out.append(t)
                    continue
                found = self.arguments(work, m)
                if found is None:
                    out.append(t)
                    continue
                self.use(t)
                given, hidden = found
                body = self.substitute(m, given, (t.hidden & hidden) | {t.text})
            made += len(body)
            if made > MOST_TOKENS:
                raise Condition("too many tokens")
            work.extend(reversed(body))
        return out

    def use(self, t: Token) -> None:
        if t.place != NOWHERE:
            self.uses.append((t.place, t.text, "macro"))

    def special(self, t: Token) -> Token:
        if t.text == "__COUNTER__":
            self.counter += 1
            return t._replace(kind="number", text=str(self.counter - 1))
        return t._replace(kind="number", text="1") if t.text == "__LINE__" else t._replace(kind="text", text='""')

    def arguments(self, work: list[Token], m: Macro) -> tuple[list[list[Token]], frozenset[str]] | None:
        """The arguments behind a macro's name, taken off ``work``; None if they don't end."""
        depth, i, given, own = 0, len(work), [], []
        while i:
            i -= 1
            t = work[i]
            if t.kind != "text" and t.text in ("(", "[", "{"):
                depth += 1
                if depth == 1:
                    continue
            elif t.kind != "text" and t.text in (")", "]", "}"):
                depth -= 1
                if depth == 0:
                    break
            elif t.text == "," and depth == 1 and t.kind == "sign" and not (m.variadic and len(given) == len(m.parameters) - 1):
                given.append(own)
                own = []
                continue
            own.append(t)
        else:
            return None
        given.append(own)
        hidden = work[i].hidden
        del work[i:]
        if m.parameters == [] and given == [[]]:
            given = []
        if len(given) < len(m.parameters):
            given += [[] for _ in range(len(m.parameters) - len(given))]
        return given, hidden

    def substitute(self, m: Macro, given: list[list[Token]], hidden: frozenset[str]) -> list[Token]:
        which = {p: i for i, p in enumerate(m.parameters or [])}
        body, out, whole, i = m.body, [], {}, 0
        while i < len(body):
            t = body[i]
            nxt = body[i + 1] if i + 1 < len(body) else None
            if t.text == "#" and m.parameters is not None and nxt is not None and nxt.text in which:
                text = "".join(" " * (x.spaced and k > 0) + x.text for k, x in enumerate(given[which[nxt.text]]))
                out.append(Token("text", '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"', t.place, t.spaced))
                i += 2
                continue
            if t.text == "##" and out and nxt is not None:
                right = given[which[nxt.text]] if nxt.text in which else [nxt]
                if out[-1].text == "," and m.variadic and nxt.text == m.parameters[-1]:
                    out = out[:-1] if not right else out
                    out += right
                elif out[-1].kind == "gap":
                    out[-1:] = right or [out[-1]]
                elif right:
                    out[-1:] = [*self.paste(out[-1], right[0]), *right[1:]]
                i += 2
                continue
            if t.text in which and t.kind == "name":
                k = which[t.text]
                if nxt is not None and nxt.text == "##":
                    out += given[k] or [Token("gap", "", NOWHERE)]
                else:
                    if k not in whole:
                        whole[k] = self.expand(given[k], None)
                    out += whole[k]
            else:
                out.append(t)
            i += 1
        return [t._replace(hidden=t.hidden | hidden) for t in out if t.kind != "gap"]

    def paste(self, a: Token, b: Token) -> list[Token]:
        made = [t for line in lines(a.text + b.text) for t in line]
        return [t._replace(place=NOWHERE, hidden=a.hidden & b.hidden) for t in made]

    # -- conditions ------------------------------------------------------------------------
    def holds(self, rest: list[Token], path: str) -> bool:
        word, parts = rest[0].text, rest[1:]
        if word in ("ifdef", "ifndef", "elifdef", "elifndef"):
            if not parts or parts[0].kind != "name":
                self.problems.append((rest[0].place, "macro name missing"))
                return False
            self.use(parts[0])
            return (parts[0].text in self.macros) == (not word.endswith("ndef"))
        try:
            return bool(Evaluation(self.expand(self.answered(parts, path), path, True)).value())
        except (Condition, RecursionError, ZeroDivisionError, OverflowError, MemoryError) as error:
            self.problems.append((rest[0].place, f"unreadable condition: {error}"))
            return False

    def answered(self, parts: list[Token], path: str) -> list[Token]:
        """``defined`` and ``__has_...`` replaced by numbers."""
        out, i = [], 0
        while i < len(parts):
            t = parts[i]
            if t.text == "defined" and t.kind == "name":
                k = i + 2 if i + 1 < len(parts) and parts[i + 1].text == "(" else i + 1
                if k < len(parts) and parts[k].kind == "name":
                    self.use(parts[k])
                    out.append(Token("number", str(int(parts[k].text in self.macros)), t.place))
                    i = k + 1 + (k == i + 2)
                    continue
            if t.text.startswith("__has_") and i + 1 < len(parts) and parts[i + 1].text == "(":
                stop = next((k for k in range(i, len(parts)) if parts[k].text == ")"), len(parts) - 1)
                inner = "".join(x.text for x in parts[i + 2 : stop])
                has = t.text.startswith("__has_include") and self.target(path, inner[1:-1], inner[:1] == "<") is not None
                out.append(Token("number", str(int(has)), t.place))
                i = stop + 1
                continue
            out.append(t)
            i += 1
        return out


class Evaluation:
    """The value of a condition; names that no macro has are 0."""

    def __init__(self, tokens: list[Token]) -> None:
        self.t, self.i = tokens, 0

    def peek(self) -> str:
        return self.t[self.i].text if self.i < len(self.t) else ""

    def value(self) -> int:
        out = self.choice()
        if self.i < len(self.t):
            raise Condition(self.peek())
        return out

    def choice(self) -> int:
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.i += 1
        yes = self.choice()
        if self.peek() != ":":
            raise Condition("?")
        self.i += 1
        no = self.choice()
        return yes if test else no

    def binary(self, level: int) -> int:
        if level == len(PRECEDENCE):
            return self.unary()
        left = self.binary(level + 1)
        while _level.get(self.peek()) == level:
            sign = self.peek()
            self.i += 1
            right = self.binary(level + 1)
            left = self.apply(sign, left, right)
        return left

    def apply(self, sign: str, a: int, b: int) -> int:
        if sign in ("/", "%"):
            if b == 0:
                return 0  # a side that && or || leaves out may divide by 0
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return q if sign == "/" else a - q * b
        if sign in ("<<", ">>"):
            return a << min(b, 64) if sign == "<<" and b >= 0 else a >> max(0, min(b, 64))
        return int(_apply[sign](a, b))

    def unary(self) -> int:
        if self.i >= len(self.t):
            raise Condition("value missing")
        t = self.t[self.i]
        self.i += 1
        if t.text in ("!", "-", "+", "~"):
            x = self.unary()
            return {"!": int(not x), "-": -x, "+": x, "~": ~x}[t.text]
        if t.text == "(":
            x = self.choice()
            if self.peek() != ")":
                raise Condition("(")
            self.i += 1
            return x
        if t.kind == "name":
            if self.peek() == "(":  # an unknown macro with arguments
                raise Condition(t.text)
            return 1 if t.text == "true" else 0
        if t.kind == "number":
            text = re.sub(r"[uUlLzZ]+$", "", t.text.replace("'", ""))
            try:
                return int(text, 8) if re.fullmatch(r"0[0-7]+", text) else int(text, 0)
            except ValueError as error:
                raise Condition(t.text) from error
        if t.kind == "text" and t.text[:1] == "'" and len(t.text) > 2:
            return ord(t.text[-2])
        raise Condition(t.text)
