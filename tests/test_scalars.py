import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry import schema as S
from codequarry.functions import scalars as fn


@settings(max_examples=300, deadline=None)
@given(st.text("ab.*?[]^-\n", max_size=7), st.text("ab.^-]\n", max_size=5))
def test_glob_is_sqlite_glob(pattern, value):
    want = sqlite3.connect(":memory:").execute("SELECT ? GLOB ?", (value, pattern)).fetchone()[0]
    regex = fn.glob_to_regex(pattern).replace(r"\z", r"\Z")
    try:
        got = re.search(regex, value) is not None
    except re.error:  # a range turned round: no match either way
        got = False
    assert got == bool(want)


def test_modes_and_ids(spark):
    assert fn.parse_mode("r") == 21 and fn.parse_mode("m--") == 3 and fn.parse_mode("def") == "def"
    with pytest.raises(ValueError):
        fn.parse_mode("rx")
    row = spark.range(1).select(fn.mode_string(F.lit(3)), fn.id_hex(F.lit(-1).cast("long")), fn.id_from_hex(F.lit("ffffffffffffffff")), fn.leaf_name(F.lit("a.b.c")), fn.kind_name(F.lit(0), cli=True)).first()
    assert list(row) == ["m--", "f" * 16, -1, "c", "var"]
    assert fn.parse_id("ffffffffffffffff") == -1
    assert spark.createDataFrame([("c:@S@Inner",), ("",), (None,)], "u string").select(fn.usr_id("u")).collect()[1][0] == 0


def test_cursor_round_trip():
    values = {"variant": "v", "line": 3}
    assert fn.decode_cursor(fn.encode_cursor(values), ["variant", "line"]) == values
    for bad in ("zz", fn.encode_cursor({"line": True, "variant": "v"}), fn.encode_cursor({"x": 1})):
        with pytest.raises(ValueError):
            fn.decode_cursor(bad, ["variant", "line"])


def test_positions_paths_uris():
    assert fn.utf16_to_byte("a😀é", 3) == 5 and fn.utf16_to_byte("ab", 9) == 2
    assert fn.uri_to_path("file:///a%20b+c") == "/a b+c" and fn.uri_to_path("http://x/") is None
    assert fn.candidate_paths("f.c", "/w", "/w/d") == ["/w/d/f.c", "d/f.c", "f.c"]
    assert fn.unpack_arguments(fn.pack_arguments(["cc", "", "é"])) == ["cc", "", "é"]
    assert fn.source_argument(["cc", "-c", "-o", "x.c", "y.c"]) == "y.c"
    assert fn.is_commit("auto") and not fn.is_commit("abc")


def test_format_errors():
    with pytest.raises(ValueError):
        fn.format_search("%q")
    with pytest.raises(ValueError):
        fn.format_search("%")


def test_codes():
    assert len(S.KIND_NAMES) == len(S.KIND_CHARS) == 10
