"""Records of C and assembly sources.

``index`` reads every unit with the files that it includes: joins decide which these are
(``includes.py``), a unit's files meet in one task in the order of units, and a helper preprocesses
and parses them (``cpp.py``, ``cparse.py``). Rows of a file that several units include come from
the first of them. ``extract`` reads each file by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.plans.scratch import cut
from codequarry.sources import includes
from codequarry.sources.cparse import ENUMERATOR, FIELD, TYPEDEF, VARIABLE, Parser
from codequarry.sources.cpp import NOWHERE, Condition, Token, Unit, lines

SCHEMA = "variant string, path string, seq long, symbol string, record int, action int, kind int, mode int, line long, col long, context string, local int"
#: All tables that a unit gives, in one; ``what`` names the table.
WIDE = (
    "what string, variant string, unit string, path string, seq long, symbol string, record int, action int, kind int, mode int, line long, col long, context string, usr_id long, context_usr_id long, local int, "
    "declared_type string, canonical_type string, type_symbol string, type_kind int, type_usr_id long, position int, name string, variadic int"
)
#: Tokens and lines of included files, and names of files given, that a task keeps for the units to come.
KEPT_TOKENS, KEPT_NAMES = 500_000, 50_000
#: Rows of an Arrow batch, those read from it at once, and those of a batch that goes back, about.
BATCH_ROWS, READ_ROWS, GIVEN_ROWS = 1_000, 100, 2_000

# The call mnemonics of several machines.
CALL_MNEMONICS = frozenset("call callq bl jbsr bsr jal brasl".split())


def usr_number(usr: str) -> int | None:
    """The id of a USR as a signed 64-bit number."""
    if not usr:
        return None
    n = xxhash.xxh64_intdigest(usr.encode())
    return n - (1 << 64) if n >= 1 << 63 else n


class _Places:
    """Lines and columns of offsets in a text."""

    def __init__(self, text: str) -> None:
        self.text, self.ascii = text, text.isascii()
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        first = self.starts[line - 1]
        return line, (at - first if self.ascii else len(self.text[first:at].encode())) + 1

    def tabbed(self, at: int) -> tuple[int, int]:
        """Line and column where tabs reach to the next eighth place."""
        line = bisect_right(self.starts, at)
        return line, len(self.text[self.starts[line - 1] : at].encode().decode("latin-1").expandtabs(8)) + 1

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.text[:at].encode())


class Files:
    """Texts of one unit and their tokens; those of included files are kept for the next units."""

    def __init__(self) -> None:
        self.main: str | None = None
        self.texts: dict[str, str] = {}
        self.own: dict[str, tuple[str, list[list[Token]], _Places]] = {}
        self.kept: dict[str, tuple[str, list[list[Token]], _Places]] = {}
        self.size = 0

    def start(self, main: str) -> None:
        """The next unit: nothing of the one before stays but what is kept."""
        self.main, self.texts, self.own = main, {}, {}

    def _get(self, path: str) -> tuple[str, list[list[Token]], _Places] | None:
        text = self.texts.get(path)
        if text is None:
            return None
        known = self.own.get(path)
        if known is None or known[0] != text:
            known = self.kept.get(path)
            if known is None or known[0] != text:
                known = (text, lines(text), _Places(text))
                self._keep(path, known)
            self.own[path] = known
        return known

    def _keep(self, path: str, known: tuple[str, list[list[Token]], _Places]) -> None:
        """A unit's own tokens serve no other one, and files above the limit go with their unit."""
        size = sum(map(len, known[1])) + len(known[2].starts)
        if path == self.main or size > KEPT_TOKENS:
            return
        if self.size + size > KEPT_TOKENS:
            self.kept, self.size = {}, 0
        self.kept[path] = known
        self.size += size

    def lines(self, path: str) -> list[list[Token]] | None:
        known = self._get(path)
        return known[1] if known else None

    def places(self, path: str) -> _Places:
        return self._get(path)[2]


class UnitRows:
    """What one unit gives."""

    def __init__(self, main: str, files: Files, found: dict[tuple[str, str, bool], str | None], define: dict[str, str] | None = None) -> None:
        self.main, self.files = main, files
        self.records: dict[tuple, dict] = {}
        self.types: dict[tuple, dict] = {}
        self.signatures: list[dict] = []
        self.problems: list[tuple[str, int, int, str]] = []
        self.points: list[tuple[str, str, str]] = []
        self.counts: dict[str, int] = {}
        self.unit = Unit(files.lines, lambda p: len(files.texts[p]), lambda path, target, angled: found.get((path, target, angled)), define)
        try:
            self.unit.enter(main)
        except (Condition, RecursionError) as error:
            self.unit.problems.append((0, str(error)))
        for at, name, what in self.unit.uses:
            if what == "define":
                self.add(at, name, S.SYMBOL, S.DEFINITION, S.MACRO, 0, "", 0, f"macro:{name}", "", None, False)
            else:
                kind = S.FILE if what == "file" else S.MACRO
                self.add(at, name, S.USE, S.READ, kind, S.R_VAL, "", 0, f"{what}:{name}", "", None, False)
        if not main.endswith((".S", ".s")):
            parser = Parser(self.unit.tokens, self.add, self.byte)
            parser.unit()
            for name, usr, at, of, parameters in parser.signatures:
                self.signature(name, usr, at, of, parameters)
            self.points, self.counts = parser.points, parser.counts
        for place, message in self.unit.problems:
            path, at = self.unit.where(place) if place != NOWHERE and self.unit.files else (main, 0)
            self.problems.append((path, *files.places(path).line(at), message))

    def byte(self, place: int) -> tuple[str, int]:
        path, at = self.unit.where(place)
        return path, self.files.places(path).byte(at)

    def add(self, place: int, symbol: str, record: int, action: int, kind: int, mode: int, context: str, local: int, usr: str, context_usr: str, of, tabs: bool) -> None:
        if place == NOWHERE:
            return
        path, at = self.unit.where(place)
        places = self.files.places(path)
        line, col = places.tabbed(at) if tabs else places.line(at)
        key = (path, symbol, record, action, kind, mode, line, col, context)
        self.records.setdefault(key, dict(path=path, symbol=symbol, record=record, action=action, kind=kind, mode=mode, line=line, col=col, context=context, local=local, usr_id=usr_number(usr), context_usr_id=usr_number(context_usr)))
        if of is not None and of.words and usr and kind in (VARIABLE, FIELD, TYPEDEF, ENUMERATOR, S.FUNCTION):
            self.types.setdefault((path, symbol, kind, usr), dict(path=path, symbol=symbol, kind=kind, usr_id=usr_number(usr), **_type_columns(of)))

    def signature(self, name: str, usr: str, place: int, of, parameters: list) -> None:
        if place == NOWHERE:
            return
        base = dict(path=self.unit.where(place)[0], symbol=name, usr_id=usr_number(usr))
        returns = of._replace(around=of.around[1:], shown=of.shown[1:])
        self.signatures.append(base | dict(position=-1, name="", variadic=int(of.around[0].endswith("...)"))) | _type_columns(returns._replace(named=None)))
        for i, (own, _, kind, _) in enumerate(parameters):
            self.signatures.append(base | dict(position=i, name=own or "", variadic=0) | _type_columns(kind if kind.words else kind._replace(words="int", canonical="int")))

    def status(self) -> str:
        return "clean" if self.records and not self.problems else "partial" if self.records else "failed"


def _type_columns(of) -> dict:
    kind, symbol, usr = of.named or (S.NO_TYPE, "", "")
    return dict(declared_type=of.declared(), canonical_type=of.resolved(), type_kind=kind, type_symbol=symbol, type_usr_id=usr_number(usr))


def c_records(text: str) -> list[tuple]:
    """(symbol, record, action, kind, mode, line, col, context, local): of preprocessor lines, then
    of the rest, each in the order in which it is read."""
    files = Files()
    files.texts = {"unit.c": text}
    return [tuple(r[c] for c in ("symbol", "record", "action", "kind", "mode", "line", "col", "context", "local")) for r in UnitRows("unit.c", files, {}).records.values()]


def assembly_records(text: str) -> list[tuple]:
    """Functions need a type mark and a label; calls of names, within the function above them."""
    rows, places = [], _Places(text)

    def add(at: int, symbol: str, record: int, action: int, mode: int = 0, context: str = "") -> None:
        rows.append((symbol, record, action, S.FUNCTION, mode, *places.line(at), context, 0))

    marked = {m[1] for m in re.finditer(r"^\s*\.type\s+([\w.$]+)\s*,\s*[@%#]?\"?(?:function|STT_FUNC)", text, re.M)} | {m[1] for m in re.finditer(r"^\s*\.ent\s+([\w.$]+)", text, re.M)}
    current, at = "", 0
    for line in text.split("\n"):
        if label := re.match(r"\s*([\w.$]+)\s*:", line):
            if label[1] in marked:
                current = label[1]
                add(at + label.start(1), current, S.SYMBOL, S.DEFINITION)
        if re.match(r"\s*\.end\s+[\w.$]+", line):
            current = ""
        for c in re.finditer(r"(?:^|[:;])\s*([a-z]+)\s+(?:%?r?\d+\s*,\s*|\$ra\s*,\s*)?([A-Za-z_.$][\w.$]*)(?:@\w+)?\s*(?=$|[;#/@])", line):
            if c[1] in CALL_MNEMONICS:
                add(at + c.start(2), c[2], S.USE, S.CALL, S.R_PTR, current)
        at += len(line) + 1
    return rows


def extract(sources: DataFrame) -> DataFrame:
    """Record rows of sources (variant, path, content), each file by itself."""

    def run(batches):
        for batch in batches:
            rows = []
            for variant, path, content in zip(batch["variant"], batch["path"], batch["content"], strict=True):
                found = assembly_records(content or "") if str(path).endswith((".S", ".s")) else c_records(content or "")
                rows += [(variant, path, i, *r) for i, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return sources.select("variant", "path", "content").mapInPandas(run, SCHEMA)


def flags(units: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """units (variant, path) with dirs and defines of the first of their commands (variant, file,
    arguments, seq)."""
    if commands is None:
        none = F.array().cast("array<string>")
        return units.select("variant", "path", none.alias("dirs"), none.alias("defines"))
    own = commands.groupBy("variant", F.col("file").alias("path")).agg(F.min_by("arguments", "seq").alias("a"))
    out = units.join(own, ["variant", "path"], "left").withColumn("a", F.coalesce("a", F.array().cast("array<string>")))
    # "-I dir" is "-Idir": a flag by itself takes the next argument
    after = lambda i: F.get(F.col("a"), i + 1)
    joined = F.transform("a", lambda x, i: F.when(x.isin("-I", "-D", "-U", "-isystem", "-iquote"), F.concat(F.when(x.isin("-isystem", "-iquote"), "-I").otherwise(x), F.coalesce(after(i), F.lit("")))).otherwise(x))
    starts = lambda *p: F.filter("j", lambda x: F.exists(F.array(*map(F.lit, p)), lambda q: x.startswith(q)) & (F.length(x) > 2))
    out = out.withColumn("j", joined)
    dirs = F.transform(starts("-I"), lambda x: includes.normal(F.substr(x, F.lit(3))))
    return out.select("variant", "path", dirs.alias("dirs"), starts("-D", "-U").alias("defines"))


def _defined(defines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in defines:
        name, _, value = x[2:].partition("=")
        if x.startswith("-U"):
            out.pop(name, None)
        else:
            out[name] = value if "=" in x else "1"
    return out


def read_units(sources: DataFrame, units: DataFrame, commands: DataFrame | None = None, scope: str = "project", partial: bool = True) -> DataFrame:
    """The rows of all tables of units (variant, path of sources) read with what they include, in
    one written table (WIDE). scope: "file" keeps rows of the units themselves, "project" those of
    every file. ``partial``: rows of included files may come from units with diagnostics.

    A unit's files come to one task one after another; what a task holds is one unit's texts and
    the tokens kept for the next. Files whose content is null are empty; a unit that isn't in
    ``sources`` gives no rows; of repeated sources of one path the smallest content counts.
    """
    if scope not in ("file", "project"):
        raise ValueError("scope is file or project")
    sources = sources.groupBy("variant", "path").agg(F.min("content").alias("content")).withColumn("content", F.coalesce("content", F.lit("")))
    units = flags(units.select("variant", "path").distinct(), commands)
    rows = includes.with_texts(units, sources).join(units.select("variant", F.col("path").alias("unit"), "defines"), ["variant", "unit"])
    spark, name = sources.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))  # changes no result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from read_batches(batches, scope, partial)

    dealt = rows.repartition("variant", "unit").sortWithinPartitions("variant", "unit", "path")
    return cut(dealt.select("variant", "unit", "path", "content", "includes", "defines").mapInArrow(run, WIDE), "units")


def read_batches(batches: Iterator[pa.RecordBatch], scope: str, partial: bool) -> Iterator[pa.RecordBatch]:
    """Rows (WIDE) of units from rows variant, unit, path, content, includes, defines, those of a unit
    one after another. What is held doesn't grow with the number of units."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    columns = [(name, kinds[kind]) for name, kind in (c.split() for c in WIDE.split(", "))]
    files, done, at, found, define, out = Files(), set(), None, {}, {}, []

    def finish() -> None:
        if at is not None and at[1] in files.texts:
            _unit_rows(*at, files, found, define, scope, partial, done, out)
        if len(done) > KEPT_NAMES:
            done.clear()

    def given() -> pa.RecordBatch:
        whole = pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(zip(*out, strict=True), columns, strict=True)], names=[c for c, _ in columns])
        out.clear()
        return whole

    for batch in batches:
        for k in range(0, len(batch), READ_ROWS):
            part = batch.slice(k, READ_ROWS)
            for variant, unit, path, content, own, defines in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if (variant, unit) != at:
                    finish()
                    if len(out) >= GIVEN_ROWS:
                        yield given()
                    files.start(unit)
                    at, found, define = (variant, unit), {}, _defined(defines)
                files.texts[path] = content
                for x in own or ():
                    found[path, x["target"], x["angled"]] = x["found"]
    finish()
    if out:
        yield given()


def index(sources: DataFrame, units: DataFrame, commands: DataFrame | None = None, scope: str = "project", details: bool = True) -> dict[str, DataFrame]:
    """``tables`` of the rows of ``read_units``."""
    return tables(read_units(sources, units, commands, scope), details)


def tables(wide: DataFrame, details: bool = True) -> dict[str, DataFrame]:
    """records, symbol_types, function_types, files (with the unit that gives their rows),
    diagnostics, points (constraints) and status. Without ``details``, uses other than calls have no
    id. Of the units that gave rows of a file, the first counts."""
    first = wide.where("what = 'files'").groupBy("variant", "path").agg(F.min("unit").alias("unit"))
    kept = wide.join(first, ["variant", "path", "unit"], "left_semi")
    table = lambda name, schema: kept.where(F.col("what") == name).select("seq", *schema.names)
    records = table("records", S.RECORDS)
    if not details:
        bare = (F.col("record") == S.USE) & (F.col("action") != S.CALL)
        records = records.withColumn("usr_id", F.when(~bare, F.col("usr_id")))
    return {
        "records": records,
        "symbol_types": table("symbol_types", S.SYMBOL_TYPES),
        "function_types": table("function_types", S.FUNCTION_TYPES),
        "files": first,
        "diagnostics": wide.where("what = 'diagnostics'").select("variant", "unit", "path", "line", "col", F.col("name").alias("message")).distinct(),
        "points": wide.where("what = 'points'").select("variant", "unit", F.col("name").alias("constraint"), F.col("usr_id").alias("pointer"), F.col("context_usr_id").alias("source")),
        "status": wide.where("what = 'status'").select("variant", "unit", F.col("name").alias("status")),
    }


def _unit_rows(variant: str, unit: str, files: Files, found: dict, define: dict, scope: str, partial: bool, done: set, out: list) -> None:
    """The rows of one unit; of other files those that no unit before it in this task has given."""
    own = UnitRows(unit, files, found, define)
    if unit.endswith((".S", ".s")):
        for symbol, record, action, kind, mode, line, col, context, local in assembly_records(files.texts[unit]):
            key = (unit, symbol, record, action, kind, mode, line, col, context)
            own.records.setdefault(key, dict(path=unit, symbol=symbol, record=record, action=action, kind=kind, mode=mode, line=line, col=col, context=context, local=local))
    given = {p for p in own.unit.files if p != unit and (scope == "file" or (variant, p) in done)}
    status = own.status()
    if status == "clean" or status == "partial" and partial:
        # units themselves are given once anyhow; the first one counts where others include them
        done.update((variant, p) for p in own.unit.files if p != unit)
    names = [c.split()[0] for c in WIDE.split(", ")]

    def put(what: str, i: int, row: dict) -> None:
        row = {"what": what, "variant": variant, "unit": unit, "seq": i} | row
        out.append(tuple(row.get(c) for c in names))

    for what, rows in (("records", own.records.values()), ("symbol_types", own.types.values()), ("function_types", own.signatures)):
        for i, row in enumerate(rows):
            if row["path"] not in given:
                put(what, i, row)
    for i, (path, line, col, message) in enumerate(own.problems):
        put("diagnostics", i, dict(path=path, line=line, col=col, name=message))
    for i, (how, pointer, source) in enumerate(own.points):
        put("points", i, dict(name=how, usr_id=usr_number(pointer), context_usr_id=usr_number(source)))
    for path in own.unit.files:
        if path not in given:
            put("files", 0, dict(path=path))
    put("status", 0, dict(name=status))
