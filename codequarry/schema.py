"""Tables, codes and version of the index.

The integer codes are fixed values: stored data depends on them.
"""

from pyspark.sql import types as T

SCHEMA_VERSION = 17

KIND_NAMES = ["variable", "field", "struct", "union", "enum", "enumerator", "typedef", "function", "macro", "file"]
KIND_CHARS = ["v", "m", "s", "s", "E", "e", "t", "f", "d", "i"]
SYMBOL, USE = 0, 1
DECLARATION, DEFINITION = 0, 1
READ, WRITE, ADDRESS, CALL = 0, 1, 2, 3
FUNCTION, FILE, MACRO = 7, 9, 8
R_AOF, W_AOF, R_VAL, W_VAL, R_PTR, W_PTR = 1, 2, 4, 8, 16, 32
NO_TYPE = -1


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    """Made without a session."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split() for c in spec.split(", "))])


FILES = _struct("variant string, path string, mtime_ns bigint, size bigint")
RECORDS = _struct(
    "symbol string, record int, action int, kind int, mode int, variant string, path string, line bigint, col bigint, "
    "context string, usr_id bigint, context_usr_id bigint, local int"
)
SYMBOL_TYPES = _struct(
    "symbol string, kind int, usr_id bigint, variant string, path string, declared_type string, canonical_type string, "
    "type_symbol string, type_kind int, type_usr_id bigint"
)
FUNCTION_TYPES = _struct(
    "symbol string, usr_id bigint, variant string, path string, position int, name string, declared_type string, "
    "canonical_type string, type_symbol string, type_kind int, type_usr_id bigint, variadic int"
)
VARIANTS = _struct("name string, git_commit string, repository_root string")
FINGERPRINTS = _struct("variant string, path string, fingerprint string")
COMMANDS = _struct("variant string, file string, directory string, arguments array<string>")
TRACE = _struct("pid bigint, command string, source string, phase string, start_ns bigint, duration_ns bigint, items_in bigint, items_out bigint")

TABLES = {
    "files": FILES,
    "records": RECORDS,
    "symbol_types": SYMBOL_TYPES,
    "function_types": FUNCTION_TYPES,
    "variants": VARIANTS,
    "file_fingerprints": FINGERPRINTS,
    "commands": COMMANDS,
}
#: First writer wins on these; every other column of a row comes along.
KEYS = {
    "files": ["variant", "path"],
    "records": ["symbol", "record", "action", "kind", "mode", "variant", "path", "line", "col"],
    "symbol_types": SYMBOL_TYPES.names,
    "function_types": [c for c in FUNCTION_TYPES.names if c not in ("name", "variadic")],
    "file_fingerprints": FINGERPRINTS.names,
    "variants": ["name"],
    "commands": ["variant", "file"],
}
RECORD_ORDER = ["variant", "path", "line", "col", "symbol", "record", "action", "kind", "mode"]
RECORD_COLUMNS = ["variant", "path", "line", "col", "record", "action", "kind", "symbol", "context", "mode", "usr_id", "context_usr_id", "local"]
