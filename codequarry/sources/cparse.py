"""Symbols, uses, types and pointer constraints of a preprocessed C unit, by a recursive-descent
parser of one pass.

Tokens come from ``cpp.py``, macros expanded, each with the place where it is spelled; records get
these places. Statements that can't be read are skipped up to their end, so that the rest still
gives records. Words that nothing declares, before a declaration, count as macros of files that
aren't there. Time grows with the length of the text.

Ids are made from names: external ones from the name alone, so that all units have the same; static
ones and typedefs from the file besides; locals from the place and function of their declaration.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from codequarry import schema as S
from codequarry.sources.cpp import NOWHERE, Token

VARIABLE, FIELD, STRUCT, UNION, ENUM, ENUMERATOR, TYPEDEF = range(7)

# The words of C, by what they do in a declaration.
STORAGE = "typedef extern static auto register inline __inline __inline__ _Noreturn _Thread_local __thread constexpr thread_local"
QUALIFIERS = "const volatile restrict __restrict __restrict__ __const __volatile__ _Atomic __extension__"
PLAIN_TYPES = "void char short int long float double signed unsigned _Bool bool _Complex __int128 __builtin_va_list _Float128 __signed__"
WITH_PARENTHESES = "__attribute__ __attribute __declspec _Alignas alignas"
TYPE_OF = "typeof __typeof__ __typeof typeof_unqual"
STATEMENTS = "if else while do for switch case default return goto break continue asm __asm__ __asm _Static_assert static_assert"
ASSIGNMENTS = "= += -= *= /= %= <<= >>= &= ^= |="
BINARY = "+ - * / % << >> < > <= >= == != & ^ | && ||"

_storage, _qualifiers, _plain = (frozenset(x.split()) for x in (STORAGE, QUALIFIERS, PLAIN_TYPES))
_parenthesised, _type_of, _statements = (frozenset(x.split()) for x in (WITH_PARENTHESES, TYPE_OF, STATEMENTS))
_assignments, _binary = frozenset(ASSIGNMENTS.split()), frozenset(BINARY.split())
_lead = _storage | _qualifiers | _plain | _parenthesised | _type_of | {"struct", "union", "enum"}
#: How arithmetic types are printed, by what they are made of.
_plain_names = {
    "char": "char", "char signed": "signed char", "char unsigned": "unsigned char", "short": "short", "short unsigned": "unsigned short", "int": "int", "int unsigned": "unsigned int",
    "long": "long", "long unsigned": "unsigned long", "long long": "long long", "long long unsigned": "unsigned long long", "double long": "long double",
}


class Type(NamedTuple):
    """``record`` and ``around`` (pointers, arrays, functions, the outermost first) say what an
    expression of the type may do; the rest how it is printed: the words of the base and what
    stands around it, as declared and with typedefs resolved, and the name it was declared by."""

    record: Record | None = None
    around: tuple[str, ...] = ()
    words: str = ""
    canonical: str = ""
    shown: tuple[str, ...] = ()
    named: tuple[int, str, str] | None = None  # kind, symbol, usr

    def wrap(self, real: str, shown: str | None = None) -> Type:
        return self._replace(around=(real, *self.around), shown=(real if shown is None else shown, *self.shown))

    def peel(self) -> Type:
        return Type(self.record, self.around[1:], canonical=self.canonical)

    def is_a(self, sign: str, at: int = 0) -> bool:
        return len(self.around) > at and self.around[at][0] == sign

    def declared(self) -> str:
        return printed(self.words, self.shown)

    def resolved(self) -> str:
        return printed(self.canonical, self.around)


def printed(words: str, around: Sequence[str]) -> str:
    """A type as it is declared without a name."""
    out = ""
    for x in around:
        if x[0] == "*":
            out = x + (" " if len(x) > 1 and out and out[0] not in ")[" else "") + out
        else:
            out = f"({out}){x}" if out.startswith("*") else out + x
    return words + (" " if out and not out.startswith("[") else "") + out


def plain_name(words: list[str]) -> str:
    """The usual name of an arithmetic type spelled in any order."""
    own = [x for x in words if x not in ("__signed__",)]
    key = sorted(x for x in own if not (x == "int" and len(own) > 1 and set(own) & {"short", "long", "unsigned", "signed"}) and not (x == "signed" and "char" not in own))
    if key in ([], ["unsigned"]):
        key = ["int", *key]
    key = " ".join(key)
    return _plain_names.get(key, " ".join(own) if len(own) > 1 else "_Bool" if key == "bool" else key)


NOTHING = Type()


class Unreadable(Exception):
    pass


class Record:
    """A struct or union; ``rows`` are fields that wait until it is known whose they are."""

    def __init__(self, name: str | None, kind: int = STRUCT) -> None:
        self.name, self.kind, self.fields, self.rows = name, kind, {}, []
        self.usr = f"c:@{'U' if kind == UNION else 'S'}@{name}" if name else ""
        self.made = name is None  # its name is made from what it is declared with
        self.begin = self.brace = NOWHERE
        self.promoted: set[str] = set()  # fields of unnamed members

    def words(self) -> str:
        return f"{'union' if self.kind == UNION else 'struct'} {self.name or '(unnamed)'}"

    def field_usr(self, name: str) -> str:
        return f"{self.usr}@{name}" if name in self.promoted and not self.made else f"{self.usr}@FI@{name}"

    def find(self, name: str) -> Type | None:
        return self.fields.get(name)


class Parser:
    def __init__(self, tokens: Sequence[Token], add: Callable[..., None], where: Callable[[int], tuple[str, int]]) -> None:
        """add: as the records' collector has it; where: the file's name and the byte at a place."""
        self.t, self.add, self.where = tokens, add, where
        self.end = len(self.t)
        self.match = self._pairs()
        self.i = 0
        self.records: dict[str, Record] = {}
        self.enums: set[str] = set()
        self.typedefs: dict[str, Type] = {}
        self.scopes: list[dict[str, tuple[str, Type, bool, str]]] = [{}]  # name: kind, type, no linkage, usr
        self.functions: dict[str, tuple[int, bool, Type, list, str]] = {}  # place, whether defined, type, parameters, usr
        self.context = self.context_usr = ""
        self.begin = NOWHERE  # where the declaration at hand begins
        self.types_seen: set[tuple] = set()
        self.held: list[tuple] | None = None  # type uses of a declaration whose name isn't known yet
        self.signatures: list[tuple[str, str, int, Type, list]] = []
        self.points: list[tuple[str, str, str]] = []  # direct or copy, pointer, target or source
        self.counts = dict.fromkeys(("direct", "copy", "unsupported", "indirect", "identified"), 0)
        self.called: set[str] = set()

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.t):
            kind, x = t[0], t[1]
            if kind == "sign":
                if x in "([{":
                    stack.append(i)
                elif x in ")]}" and stack:
                    # a closing brace ends what was left open inside it
                    while x == "}" and len(stack) > 1 and self.t[stack[-1]][1] != "{":
                        out[stack.pop()] = i
                    out[stack.pop()] = i
        for i in stack:
            out[i] = self.end
        return out

    # -- reading ---------------------------------------------------------------------------
    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < self.end else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if self.i + k < self.end else ""

    def take(self, x: str) -> bool:
        if self.peek() == x and self.kind() != "text":
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not self.take(x):
            raise Unreadable(x)

    def lookup(self, name: str) -> tuple[str, Type, bool, str] | None:
        return next((s[name] for s in reversed(self.scopes) if name in s), None)

    def file_of(self, at: int) -> str:
        return self.where(at)[0].rsplit("/", 1)[-1] if at != NOWHERE else ""

    def starts_type(self, k: int = 0) -> bool:
        x = self.peek(k)
        return self.kind(k) == "name" and (x in _lead or (x in self.typedefs and self.lookup(x) is None))

    # -- records ---------------------------------------------------------------------------
    def symbol(self, at: int, name: str, kind: int, action: int = S.DEFINITION, context: str = "", local: int = 0, usr: str = "", of: Type | None = None, tabs: bool = False) -> None:
        self.add(at, name, S.SYMBOL, action, kind, 0, context, local, usr, "", of, tabs)

    def use(self, at: int, name: str, kind: int, action: int, mode: int, local: int = 0, usr: str = "") -> None:
        # only calls of functions name their context's id
        own = self.context_usr if action == S.CALL and kind == S.FUNCTION else ""
        self.add(at, name, S.USE, action, kind, mode, self.context, local, usr, own, None, False)

    def type_use(self, at: int, name: str, kind: int, usr: str) -> None:
        if self.held is not None:
            self.held.append((at, name, kind, usr))
            return
        if (at, name, kind, self.context) not in self.types_seen:
            self.types_seen.add((at, name, kind, self.context))
            self.use(at, name, kind, S.READ, S.R_VAL, int(self.context != ""), usr)

    def release(self, context: str) -> None:
        """The type uses of a declaration outside of functions; those of a function's are in it."""
        held, self.held = self.held, None
        self.context = context
        for use in held or ():
            self.type_use(*use)
        self.context = ""

    # -- declarations ----------------------------------------------------------------------
    def unknown_macro(self) -> bool:
        """A word that nothing declares before what begins a declaration: a macro of a missing file."""
        x = self.peek()
        if self.kind() != "name" or x in _statements or self.lookup(x) is not None or self.peek(1) in _statements:
            return False
        return self.starts_type(1) or self.kind(1) == "name" and self.kind(2) == "name" and self.peek(2) not in _lead and self.lookup(self.peek(1)) is None

    def specifiers(self) -> tuple[Type, frozenset[str]]:
        """The type before the declarators, and the storage words; "" among these if it is no type."""
        of, storage, known, words, quality = NOTHING, set(), False, [], []
        self.begin = self.t[self.i][2] if self.i < self.end else NOWHERE
        while self.kind() == "name":
            x, at = self.peek(), self.t[self.i][2]
            if x in _storage:
                storage.add(x)
                self.i += 1
            elif x in _qualifiers:
                if x.strip("_") in ("const", "volatile") and x.strip("_") not in quality:
                    quality.append(x.strip("_"))
                self.i += 1
            elif x in _parenthesised:
                self.i += 1
                self.skip_parentheses()
            elif x in _plain:
                known = True
                words.append(x)
                self.i += 1
            elif x in _type_of:
                self.i += 1
                stop = self.match.get(self.i, self.end)
                self.need("(")
                begin, first = self.begin, self.i
                of, known = (self.type_name() if self.starts_type() else self.read(self.expression())), True
                self.i, self.begin = stop + 1, begin
                of = of._replace(words=f"typeof ({' '.join(t[1] for t in self.t[first:stop])})", shown=())
            elif x in ("struct", "union"):
                begin = self.begin
                record = self.record(STRUCT if x == "struct" else UNION)
                of, known, self.begin = Type(record), True, begin
            elif x == "enum":
                begin = self.begin
                name = self.enumeration()
                of, known, self.begin = Type(None, (), f"enum {name}", f"enum {name}", (), (ENUM, name, f"c:@E@{name}")), True, begin
            elif not known and x in self.typedefs and self.lookup(x) is None:
                under, usr = self.typedefs[x], self.typedef_usr(x)
                self.type_use(at, x, TYPEDEF, usr)
                of, known = Type(under.record, under.around, x, under.canonical, (), (TYPEDEF, x, usr)), True
                self.i += 1
            elif not known and self.unknown_macro():
                self.i += 1
            elif not known and self.lookup(x) is None and (self.kind(1) == "name" and self.peek(1) not in _statements or self.context == "" and self.peek(1) == "*"):
                of, known = Type(None, (), x, x), True  # a type of a missing file
                self.i += 1
            else:
                break
        if words:
            of = Type(None, (), plain_name(words), plain_name(words))
        elif of.record is not None and of.named is None:
            r = of.record
            of = of._replace(words=r.words(), canonical=r.words(), named=(r.kind, r.name, r.usr) if r.name else None)
        if not known and storage:
            of = Type(None, (), "int", "int")
        if quality:
            lead = " ".join(sorted(quality)) + " "
            of = of._replace(words=lead + of.words, canonical=lead + of.canonical if not of.around else of.canonical)
        return of, frozenset(storage if known or storage else [""])

    def typedef_usr(self, name: str) -> str:
        return self.scopes[0].get(f"typedef {name}", ("", NOTHING, False, ""))[3]

    def skip_parentheses(self) -> None:
        if self.peek() == "(":
            self.i = self.match[self.i] + 1

    def attributes(self) -> None:
        while self.peek() in _parenthesised or self.peek() in ("asm", "__asm__", "__asm"):
            self.i += 1
            self.skip_parentheses()

    def record(self, kind: int) -> Record:
        begin = self.t[self.i][2]
        self.i += 1
        self.attributes()
        name = at = None
        if self.kind() == "name":
            name, at = self.peek(), self.t[self.i][2]
            self.i += 1
            self.attributes()
        own = self.records.setdefault(name, Record(name, kind)) if name else Record(None, kind)
        if self.peek() != "{":
            if name:
                self.type_use(at, name, kind, own.usr)
            return own
        if name:
            self.symbol(at, name, kind, usr=own.usr)
        own.begin, own.brace = begin, self.t[self.i][2]
        stop = self.match[self.i]
        self.i += 1
        while self.i < stop:
            if not self.take(";"):
                self.guarded(lambda: self.members(own), stop)
        self.i = stop + 1
        self.attributes()
        return own

    def members(self, own: Record) -> None:
        of, _ = self.specifiers()
        inner = of[0] if of[0] is not None and of[0].name is None and not of[1] else None
        if self.peek() == ";":
            if inner is not None:  # the members of an unnamed one are the outer's
                own.fields.update(inner.fields)
                own.promoted |= set(inner.fields)
                self.owned(own, inner.rows)
            return
        while True:
            name, at, kind = None, None, of
            if self.peek() != ":":
                name, at, kind, _ = self.declarator(of)
            if self.take(":"):
                self.read(self.assignment())
            if name:
                if inner is not None and inner.rows:
                    rows, inner.rows, inner.name = inner.rows, [], f":{name}"
                    inner.usr = f"{own.usr or 'c:'}@S@{self.file_of(inner.begin)}@{self.where(inner.begin)[1] if inner.begin != NOWHERE else 0}"
                    self.owned(inner, rows)
                if inner is not None:
                    kind = kind._replace(words=inner.words(), canonical=inner.words())
                own.fields[name] = kind
                self.owned(own, [(at, name, kind)])
            self.attributes()
            if not self.take(","):
                return

    def owned(self, own: Record, rows: list[tuple[int, str, Type]]) -> None:
        """Field symbols of a record that has a name; else they wait."""
        if own.name is None:
            own.rows += rows
            return
        for at, name, of in rows:
            self.symbol(at, f"{own.name}.{name}", FIELD, usr=own.field_usr(name), of=of, tabs=False)

    def named(self, of: Type, name: str, usr: str = "") -> Type:
        """An unnamed record gets the name of what it is declared with, and its fields with it; their
        columns count tabs up to the next eighth place."""
        r = of.record
        if r is None or r.name is not None:
            return of
        rows, r.rows, r.name = r.rows, [], f":{name}"
        file = self.file_of(r.begin)
        r.usr = usr or f"c:{file}@S@{file}@{self.where(r.begin)[1] if r.begin != NOWHERE else 0}"
        self.symbol(r.brace, r.name, r.kind, usr=r.usr, tabs=True)
        r.brace = NOWHERE
        inner = r.promoted
        for at, own, kind in rows:
            self.symbol(at, f"{r.name}.{own}", FIELD, usr=f"{r.usr}@Ua@FI@{own}" if own in inner else f"{r.usr}@FI@{own}", of=kind, tabs=True)
        return of._replace(words=r.words(), canonical=r.words())

    def enumeration(self) -> str:
        """Its name, or a note that it has none."""
        self.i += 1
        self.attributes()
        name = at = None
        if self.kind() == "name":
            name, at = self.peek(), self.t[self.i][2]
            self.i += 1
        if self.peek() != "{":
            if name:
                self.type_use(at, name, ENUM, f"c:@E@{name}")
            return name or "(unnamed)"
        if name:
            self.symbol(at, name, ENUM, usr=f"c:@E@{name}")
        stop = self.match[self.i]
        self.i += 1
        own = f"c:@E@{name}" if name else f"c:@Ea@{self.peek()}"
        of = Type(None, (), "int", "int")
        while self.i < stop and self.kind() == "name":
            usr = f"{own}@{self.peek()}"
            self.symbol(self.t[self.i][2], self.peek(), ENUMERATOR, usr=usr, of=of)
            self.scopes[-1][self.peek()] = ("enumerator", of, True, usr)
            self.i += 1
            self.attributes()
            if self.take("="):
                self.read(self.assignment())
            if not self.take(","):
                break
        self.i = stop + 1
        self.attributes()
        return name or "(unnamed)"

    def declarator(self, of: Type) -> tuple[str | None, int | None, Type, list | None]:
        """name, its offset, type, and the parameters if it is a function."""
        self.attributes()
        while self.take("*"):
            quality = []
            while self.peek() in _qualifiers or self.peek() in _parenthesised:
                self.attributes()
                if self.peek() in _qualifiers:
                    quality.append(self.peek().strip("_"))
                    self.i += 1
            of = of.wrap("*" + " ".join(q for q in ("const", "volatile", "restrict") if q in quality))
        if self.peek() == "(" and (self.peek(1) in ("*", "(", "^") or self.kind(1) == "name" and not self.starts_type(1)):
            inside, stop = self.i + 1, self.match[self.i]
            self.i = stop + 1
            of, _ = self.suffixes(of)
            after, self.i = self.i, inside
            name, at, of, parameters = self.declarator(of)
            if self.i != stop:
                raise Unreadable("declarator")
            self.i = after
            return name, at, of, parameters
        name = at = None
        if self.kind() == "name" and self.peek() not in _lead:
            name, at = self.peek(), self.t[self.i][2]
            self.i += 1
        of, parameters = self.suffixes(of)
        return name, at, of, parameters

    def suffixes(self, of: Type) -> tuple[Type, list | None]:
        around, parameters = [], None
        while True:
            self.attributes()
            if self.peek() == "[":
                stop = self.match[self.i]
                self.i += 1
                while self.peek() in _qualifiers or self.peek() == "static":
                    self.i += 1
                first = self.i
                if self.i < stop and self.peek() != "*":
                    self.read(self.expression())
                size = "".join(t[1] for t in self.t[first:stop])
                self.i = stop + 1
                around.append((f"[{size}]", f"[{size}]"))
            elif self.peek() == "(":
                begin = self.begin
                found, dots, void = self.parameters()
                self.begin = begin
                parameters = found if not around and parameters is None else parameters
                lists = []
                for text in (lambda t: t.resolved(), lambda t: t.declared()):
                    own = [text(decayed(t)) for _, _, t, _ in found] + ["..."] * dots
                    lists.append("(" + (", ".join(own) or "void" * void) + ")")
                around.append(tuple(lists))
            else:
                for real, shown in reversed(around):
                    of = of.wrap(real, shown)
                return of, parameters

    def parameters(self) -> tuple[list[tuple[str | None, int | None, Type, int]], bool, bool]:
        """name, its offset, type, where it begins; whether more may follow; whether there are none."""
        stop = self.match[self.i]
        self.i += 1
        out, dots, void = [], False, False
        while self.i < stop:
            if self.take("..."):
                dots = True
            elif self.kind() == "name" and not self.starts_type() and self.peek(1) in (",", ")"):  # a list of names, or a type of a missing file
                out.append((self.peek(), self.t[self.i][2], NOTHING, self.t[self.i][2]))
                self.i += 1
            else:
                of, _ = self.specifiers()
                begin = self.begin
                name, at, kind, _ = self.declarator(of)
                void = name is None and kind.resolved() == "void" and not out
                if not void:
                    out.append((name, at, kind, begin))
            if not self.take(","):
                break
        self.i = stop + 1
        return out, dots, void

    def type_name(self) -> Type:
        of, _ = self.specifiers()
        return self.declarator(of)[2]

    def declaration(self) -> None:
        outer = self.context == "" and self.held is None
        self.held = [] if outer else self.held
        try:
            self.declared(outer)
        finally:
            if outer and self.held is not None:
                self.release("")

    def declared(self, outer: bool) -> None:
        of, storage = self.specifiers()
        begin = self.begin
        if self.take(";"):
            return
        while True:
            name, at, kind, parameters = self.declarator(of)
            if name is None:
                raise Unreadable("name")
            while parameters is not None and self.peek() not in ("{", ",", ";", "=") and self.starts_type():
                self.declaration()  # types of a list of names
            if "" in storage and not (parameters is not None and self.context == "" and self.peek() == "{"):
                raise Unreadable("type")  # a macro of a missing file declares nothing
            if "typedef" in storage:
                if outer and self.held is not None:
                    self.release("")
                unnamed = kind.record is not None and kind.record.name is None
                kind = self.named(kind, name, f"c:@{'U' if unnamed and kind.record.kind == UNION else 'S'}A@{name}")
                self.typedefs[name] = kind
                usr = f"c:@T@{name}" if unnamed else f"c:{self.file_of(at)}@T@{name}"
                self.scopes[0][f"typedef {name}"] = ("", NOTHING, False, usr)
                self.symbol(at, name, TYPEDEF, context=self.context, local=int(self.context != ""), usr=usr, of=kind._replace(named=None))
            elif kind.is_a("("):
                if outer and self.held is not None:
                    self.release(name)
                self.function(name, at, kind if kind.words else kind._replace(words="int", canonical="int"), storage, parameters or [])
                if self.context == "" and self.peek() == "{":
                    self.body(name, parameters or [])
                    return
            else:
                if outer and self.held is not None:
                    self.release("")
                kind = self.named(kind, name)
                inside = self.context != ""
                static, external = "static" in storage, "extern" in storage
                usr = self.local_usr(begin, name) if inside and not external else f"c:{self.file_of(at)}@{name}" if static else f"c:@{name}"
                known = self.scopes[0].get(name)
                if not inside and known is not None and known[0] == "variable":
                    usr, static = known[3], known[2]  # a later declaration has the linkage of the first
                self.scopes[-1][name] = ("variable", kind, static or inside and not external, usr)
                self.symbol(at, name, VARIABLE, context=self.context, local=int(inside), usr=usr, of=kind)
                self.attributes()
                if self.take("="):
                    self.use(at, name, VARIABLE, S.WRITE, S.W_VAL, int(inside), usr)
                    self.initialiser(kind, usr)
            self.attributes()
            if not self.take(","):
                self.need(";")
                return

    def local_usr(self, begin: int, name: str) -> str:
        if begin == NOWHERE:
            return f"c:@F@{self.context}@{name}"
        return f"c:{self.file_of(begin)}@{self.where(begin)[1]}@F@{self.context}@{name}"

    def function(self, name: str, at: int, kind: Type, storage: frozenset[str], parameters: list) -> None:
        defined = self.context == "" and self.peek() == "{"
        known, scope = self.functions.get(name), self.scopes[0].get(name)
        static = "static" in storage or scope is not None and scope[0] == "function" and scope[2]
        usr = known[4] if known else f"c:{self.file_of(at)}@F@{name}" if static else f"c:@F@{name}"
        self.scopes[0][name] = ("function", kind, static, usr)
        if self.context != "":
            self.scopes[-1][name] = self.scopes[0][name]
        if defined and not (known and known[1]):
            self.functions[name] = (at, True, kind, parameters, usr)
            self.symbol(at, name, S.FUNCTION, usr=usr, of=kind._replace(named=None))
            self.signatures.append((name, usr, at, kind, parameters))
        elif known is None and (self.t[self.i - 2][1] != "(" or self.t[self.i - 1][1] != ")"):  # f() says nothing
            self.functions[name] = (at, False, kind, parameters, usr)

    def body(self, name: str, parameters: list) -> None:
        stop = self.match[self.i]
        self.context, self.context_usr = name, self.functions[name][4]
        self.scopes.append({})
        for own, at, kind, begin in parameters:
            if own:
                usr, kind = self.local_usr(begin, own), kind if kind.words else Type(None, (), "int", "int")
                self.scopes[-1][own] = ("variable", decayed(kind), True, usr)
                self.symbol(at, own, VARIABLE, context=name, local=1, usr=usr, of=decayed(kind))
        self.block()
        self.scopes.pop()
        self.context = self.context_usr = ""
        self.i = stop + 1

    def initialiser(self, of: Type, usr: str = "") -> None:
        """usr: the pointer that gets the value, for its constraints."""
        if self.peek() != "{":
            x = self.assignment()
            self.read(x)
            if usr and function_pointer(of):
                self.constrain(usr, x)
            return
        stop = self.match[self.i]
        self.i += 1
        turn = 0
        record = of.record if not of.around else None
        while self.i < stop:
            part, own = (of.peel(), "") if of.is_a("[") else (NOTHING, "")
            if record is not None and self.peek() not in (".", "[") and turn < len(record.fields):
                name = list(record.fields)[turn]
                part, own = record.fields[name], record.field_usr(name)
            while self.peek() in ("[", "."):
                if self.take("["):
                    self.read(self.expression())
                    self.take("...") and self.read(self.expression())
                    self.need("]")
                    part = part.peel() if part.is_a("[") and part is not NOTHING and own else part
                else:
                    self.i += 1
                    inner = part if part.record is not None and not part.around else of
                    field = self.t[self.i]
                    part = self.field_use(inner, field, S.WRITE, S.W_VAL)
                    own = inner.record.field_usr(field[1]) if inner.record is not None else ""
                    if record is not None and inner is of and field[1] in record.fields:
                        turn = list(record.fields).index(field[1])
                    self.i += 1
            turn += 1
            self.take("=")
            self.initialiser(part, own)
            if not self.take(","):
                break
        self.i = stop + 1

    # -- pointers to functions -----------------------------------------------------------------
    def pointer(self, x: tuple) -> str | None:
        """The id of the pointer to functions that an expression names."""
        while x[0] in ("&", "*", "cast"):
            x = x[2] if x[0] == "cast" else x[1]
        if x[0] == "name":
            known = self.lookup(x[1][1])
            return known[3] if known is not None and known[0] == "variable" and function_pointer(known[1]) else None
        if x[0] == "member":
            of = self.quiet(x[2])
            of = of.peel() if x[3] else of
            found = of.record.find(x[1][1]) if of.record is not None else None
            return of.record.field_usr(x[1][1]) if found is not None and function_pointer(found) else None
        return None

    def quiet(self, x: tuple) -> Type:
        """The type of an expression, without its records."""
        add, self.add = self.add, lambda *_: None
        points, counts, called = self.points, self.counts, self.called
        self.points, self.counts, self.called = [], dict(counts), set()
        try:
            return self.read(x)
        finally:
            self.add, self.points, self.counts, self.called = add, points, counts, called

    def constrain(self, pointer: str, x: tuple) -> None:
        if not self.collect(pointer, x):
            self.counts["unsupported"] += 1

    def collect(self, pointer: str, x: tuple) -> bool:
        """The constraints that a value makes; both sides of a choice do."""
        while x[0] in ("&", "*", "cast"):
            x = x[2] if x[0] == "cast" else x[1]
        if x[0] == "?":
            sides = [self.collect(pointer, y) for y in x[2:]]
            return any(sides)
        if x == ("zero",):
            return True
        if x[0] == "name":
            known = self.lookup(x[1][1])
            if known is not None and known[0] == "function":
                self.counts["direct"] += 1
                self.points.append(("direct", pointer, known[3]))
                return True
        source = self.pointer(x)
        if source is not None:
            self.counts["copy"] += 1
            self.points.append(("copy", pointer, source))
            return True
        return False

    # -- statements ------------------------------------------------------------------------
    def guarded(self, part: Callable[[], None], stop: int) -> None:
        """What can't be read is skipped up to its semicolon or its block's end."""
        first = self.i
        try:
            part()
        except (Unreadable, KeyError, IndexError, RecursionError):
            self.i = max(self.i, first)
            while self.i < min(stop, self.end) and self.peek() not in (";", "}"):
                self.i = self.match[self.i] + 1 if self.peek() in ("(", "[", "{") and self.i in self.match else self.i + 1
                if self.i <= self.end and self.t[self.i - 1][1] == "}":
                    return
            self.i += 1
        if self.i == first:
            self.i += 1

    def block(self) -> None:
        stop = self.match[self.i]
        self.i += 1
        self.scopes.append({})
        while self.i < min(stop, self.end):
            self.guarded(self.statement, stop)
        self.scopes.pop()
        self.i = stop + 1

    def statement(self) -> None:
        x = self.peek()
        if x == "{":
            self.block()
        elif x == ";":
            self.i += 1
        elif x in ("if", "while", "switch"):
            self.i += 1
            self.need("(")
            self.read(self.expression())
            self.need(")")
            self.statement()
        elif x in ("else", "do"):
            self.i += 1
            self.statement()
        elif x == "for":
            self.i += 1
            self.need("(")
            self.scopes.append({})
            if self.starts_type():
                self.declaration()
            else:
                self.optional(";")
            self.optional(";")
            self.optional(")")
            self.statement()
            self.scopes.pop()
        elif x in ("case", "return"):
            self.i += 1
            if self.peek() not in (";", ":"):
                self.read(self.expression(colon=x == "case"))
                if x == "case" and self.take("..."):
                    self.read(self.expression(colon=True))
            self.need(":" if x == "case" else ";")
        elif x == "goto":
            self.i = self.i + 2 if self.kind(1) == "name" else self.i + 1
            self.optional(";")
        elif x in _statements or self.kind() == "name" and self.peek(1) == ":" and self.peek(2) != ":":
            self.i += 1
            while self.peek() in ("volatile", "__volatile__", "goto", "inline"):
                self.i += 1
            self.skip_parentheses()
            if not self.take(":"):
                self.take(";")
        elif self.starts_type() or self.unknown_type():
            self.declaration()
        else:
            self.read(self.expression())
            self.take(";") or self.peek() in ("}", "") or self.t[self.i - 1][1] in (")", "}") or self.need(";")

    def unknown_type(self) -> bool:
        """Two names, and what follows a declared one: the first is a type of a missing file."""
        two = self.kind() == self.kind(1) == "name" and self.peek(1) not in _statements and self.lookup(self.peek()) is None
        return two and self.peek(2) in ("=", ";", ",", "[") and self.kind(2) == "sign"

    def optional(self, stop: str) -> None:
        if self.peek() != stop:
            self.read(self.expression())
        self.need(stop)

    def unit(self) -> None:
        while self.i < self.end:
            if not self.take(";"):
                self.scopes, self.context, self.context_usr = self.scopes[:1], "", ""
                self.guarded(self.declaration, self.end)
        for name, (at, defined, kind, parameters, usr) in self.functions.items():
            if not defined:
                self.symbol(at, name, S.FUNCTION, S.DECLARATION, usr=usr, of=kind._replace(named=None))
                self.signatures.append((name, usr, at, kind, parameters))

    # -- expressions: ("name", token), ("member", token, base, arrow), ("&", x), ("*", x), ("++", x),
    # ("=", x, y, sign), ("call", f, arguments), ("[", x, y), ("cast", type, x), ("?", test, yes, no),
    # ("zero",), ("all", parts) --------------------------------------------------------------------
    def expression(self, colon: bool = False) -> tuple:
        parts = [self.assignment(colon)]
        while self.take(","):
            parts.append(self.assignment(colon))
        return parts[-1] if len(parts) == 1 else ("all", parts)

    def assignment(self, colon: bool = False) -> tuple:
        parts = [self.unary()]
        while self.kind() == "sign" and self.peek() in _binary:
            self.i += 1
            parts.append(self.unary())
        if self.kind() == "sign" and self.peek() == "?":
            self.i += 1
            test = parts[0] if len(parts) == 1 else ("all", parts)
            yes = self.expression() if self.peek() != ":" else test
            self.need(":")
            parts = [("?", test, yes, self.assignment(colon))]
        elif self.kind() == "sign" and self.peek() in _assignments:
            self.i += 1
            sign = self.t[self.i - 1][1]
            parts[-1] = ("=", parts[-1], self.assignment(colon), sign)
        return parts[0] if len(parts) == 1 else ("all", parts)

    def unary(self) -> tuple:
        x = self.peek()
        if self.kind() == "sign":
            if x in ("&", "*", "++", "--"):
                self.i += 1
                return ("++" if x == "--" else x, self.unary())
            if x in ("+", "-", "!", "~"):
                self.i += 1
                return ("all", [self.unary()])
            if x == "&&":  # the address of a label
                self.i += 2
                return ("all", [])
            if x == "(" and self.starts_type(1):
                stop = self.match[self.i]
                self.i += 1
                of = self.type_name()
                if self.i != stop:
                    raise Unreadable("type")
                self.i += 1
                if self.peek() == "{":
                    self.initialiser(of)
                    return self.postfix(("cast", of, ("all", [])))
                return ("cast", of, self.unary())
        elif x in ("sizeof", "_Alignof", "__alignof__", "alignof"):
            self.i += 1
            if self.peek() == "(" and self.starts_type(1):
                stop = self.match[self.i]
                self.i += 1
                self.type_name()
                self.i = stop + 1
                return ("all", [])
            return ("all", [self.unary()])
        begin = self.t[self.i][2] if self.i < self.end else NOWHERE
        return self.postfix(self.primary(), begin)

    def primary(self) -> tuple:
        token = self.t[self.i] if self.i < self.end else ("", "", 0)
        kind, x = token[0], token[1]
        if kind == "sign" and x == "(":
            stop = self.match[self.i]
            if self.peek(1) == "{":  # statements as an expression
                self.i += 1
                self.block()
                self.i = stop + 1
                return ("all", [])
            self.i += 1
            out = self.expression()
            self.need(")")
            return out
        if kind in ("number", "text"):
            self.i += 1
            while self.kind() == "text":
                self.i += 1
            return ("zero",) if x.rstrip("uUlL") in ("0", "0x0") else ("all", [])
        if kind != "name" or x in _statements:
            raise Unreadable(x)
        self.i += 1
        if x == "_Generic" and self.peek() == "(":
            return ("all", self.choices())
        return ("name", token)

    def choices(self) -> list[tuple]:
        """The parts of a choice by type: what is asked, and each result."""
        stop = self.match[self.i]
        self.i += 1
        out = [self.assignment()]
        while self.i < stop and self.take(","):
            if not self.take("default"):
                self.type_name()
            self.need(":")
            out.append(self.assignment())
        self.i = stop + 1
        return out

    def arguments(self) -> list[tuple]:
        stop = self.match[self.i]
        self.i += 1
        out = []
        while self.i < stop:
            if self.starts_type():
                self.type_name()
            else:
                out.append(self.assignment())
            if not self.take(","):
                break
        if self.i != stop:
            raise Unreadable("arguments")
        self.i = stop + 1
        return out

    def postfix(self, x: tuple, begin: int = NOWHERE) -> tuple:
        while self.kind() == "sign":
            sign = self.peek()
            if sign == "(":
                x = ("call", x, self.arguments(), begin)
            elif sign == "[":
                self.i += 1
                x = ("[", x, self.expression())
                self.need("]")
            elif sign in (".", "->") and self.kind(1) == "name":
                x = ("member", self.t[self.i + 1], x, sign == "->")
                self.i += 2
            elif sign in ("++", "--"):
                self.i += 1
                x = ("++", x)
            else:
                break
        return x

    def field_use(self, of: Type, token: tuple, action: int, mode: int) -> Type:
        found = of.record.find(token[1]) if of.record is not None else None
        if found is None:
            return NOTHING
        if of.record.name is not None:
            self.use(token[2], f"{of.record.name}.{token[1]}", FIELD, action, mode, 0, of.record.field_usr(token[1]))
        return found

    def read(self, x: tuple, how: str = "value") -> Type:
        """Emit the uses of an expression; its type. how: value, pointer, write, address or callee."""
        action, mode = {"value": (S.READ, S.R_VAL), "pointer": (S.READ, S.R_PTR), "callee": (S.READ, S.R_PTR), "write": (S.WRITE, S.W_VAL), "address": (S.ADDRESS, S.R_AOF | S.W_AOF)}[how]
        kind = x[0]
        if kind == "zero":
            return NOTHING
        if kind == "name":
            name, at = x[1][1], x[1][2]
            known = self.lookup(name)
            if known is None:
                if how == "callee" and not name.startswith("__builtin_"):
                    self.use(at, name, S.FUNCTION, S.CALL, S.R_PTR, 0, f"c:@F@{name}")
                return NOTHING
            what, of, own, usr = known
            local = int(own and self.context != "")
            if what == "function":
                if how == "callee":
                    self.use(at, name, S.FUNCTION, S.CALL, S.R_PTR, 0, usr)
                else:
                    self.use(at, name, S.FUNCTION, action, S.R_PTR if action == S.READ else mode, local, usr)
                return of
            self.use(at, name, ENUMERATOR if what == "enumerator" else VARIABLE, action, mode, local, usr)
            if how == "callee":
                self.use(at, name, VARIABLE, S.CALL, S.R_PTR, local, usr)
            return of
        if kind == "member":
            of = self.read(x[2], "pointer" if x[3] else "value")
            of = of.peel() if x[3] else of
            out = self.field_use(of, x[1], action, mode)
            if how == "callee":
                self.field_use(of, x[1], S.CALL, S.R_PTR)
            return out
        if kind == "&":
            return self.read(x[1], "address").wrap("*")
        if kind == "*":
            of = self.read(x[1], "callee" if how == "callee" else "pointer")
            return of if of.is_a("(") else of.peel()
        if kind == "++":
            return self.read(x[1], "write")
        if kind == "=":
            of = self.read(x[1], "write")
            self.read(x[2])
            pointer = self.pointer(x[1]) if x[3] == "=" else None
            if pointer:
                self.constrain(pointer, x[2])
            return of
        if kind == "[":
            of = self.read(x[1])
            self.read(x[2])
            return of.peel()
        if kind == "call":
            inner = x[1]
            while inner[0] in ("*", "&"):
                inner = inner[1]
            known = self.lookup(inner[1][1]) if inner is not x[1] and inner[0] == "name" else None
            if known is not None and known[0] == "function":
                # a function called by its address: at the begin of the call
                self.use(x[3], inner[1][1], S.FUNCTION, S.CALL, S.R_PTR, 0, known[3])
                of = known[1]
            else:
                of = self.read(x[1], "callee")
                self.called_through(x[1])
            for a in x[2]:
                self.read(a)
            of = of.peel() if of.is_a("*") and of.is_a("(", 1) else of
            return of.peel() if of.is_a("(") else of
        if kind == "cast":
            self.read(x[2])
            return x[1]
        types = [self.read(a) for a in (x[1] if kind == "all" else x[1:])]
        types = types[1:] if kind == "?" else types
        return next((t for t in types if t.record is not None), next((t for t in types if t.around), NOTHING))

    def called_through(self, x: tuple) -> None:
        """A call of what is no function's name: counted, with the pointer if it has one."""
        while x[0] in ("*", "&"):
            x = x[1]
        if x[0] == "name" and (self.lookup(x[1][1]) or ("function",))[0] == "function":
            return
        self.counts["indirect"] += 1
        pointer = self.pointer(x)
        if pointer:
            self.counts["identified"] += 1
            self.called.add(pointer)


def function_pointer(of: Type) -> bool:
    return of.is_a("*") and of.is_a("(", 1)


def decayed(of: Type) -> Type:
    """The type of a parameter: functions and arrays are pointers."""
    if of.is_a("["):
        return of._replace(around=("*", *of.around[1:]), shown=("*", *of.shown[1:]) if of.shown and of.shown[0][0] == "[" else of.shown)
    return of.wrap("*") if of.is_a("(") else of
