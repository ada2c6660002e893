"""The stored index: fragments that are written once, and a pointer to those that count.

A store writes one fragment: the rows that it adds, laid out by symbol bucket and variant and
sorted by key, and the files whose older rows go. Nothing else is rewritten, so that it writes in
proportion to what changes. Readers take the rows of all fragments of the current version but those
of files that a later fragment has replaced. From MOST_FRAGMENTS fragments on a store writes the
whole state as one.

Layout: <root>/data/<table>/writer=<n>-<uuid>/..., <root>/gone/writer=<n>-<uuid>, and the pointer
<root>/current-<schema version>-<n>, one line that lists the fragments of version n. The pointer is
made last and only if there is none of this name: readers see either state, of two writers of one
version the later is refused, and what a crash leaves behind has a name that no pointer lists. It is
in nobody's way; ``vacuum`` removes it. (HDFS and local file systems create files exclusively; an
object store needs a file system layer that does.)
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry import schema as S
from codequarry.operators import merge

BUCKETS = 64
MOST_FRAGMENTS = 16
_BUCKET = "sym_bucket"
#: Tables whose rows belong to a file; those of ``commands`` belong to a main file.
OF_FILES = ("files", "records", "symbol_types", "function_types", "file_fingerprints", "commands")


def bucket(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(BUCKETS)).cast("int")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions --------------------------------------------------------------------------
    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [str(f.getPath().getName()) for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _pointers(self) -> list[int]:
        """Versions that have a pointer, whole or not; a store of another schema is refused and left alone."""
        names = self._names(self.root)
        found = [tuple(map(int, m.groups())) for x in names if (m := re.fullmatch(r"current-(\d+)-(\d+)", x))]
        if not found and any(x not in ("data", "gone") and not x.startswith(".") for x in names):
            raise ValueError(f"{self.root} is no index")
        if found and max(found, key=lambda x: x[1])[0] != S.SCHEMA_VERSION:
            raise ValueError(f"index schema {max(found, key=lambda x: x[1])[0]} is not {S.SCHEMA_VERSION}")
        return sorted(n for kind, n in found if kind == S.SCHEMA_VERSION)

    def _fragments(self, n: int) -> list[str] | None:
        """The fragments of a version, the oldest first; None if its writer crashed at the pointer."""
        stream = self._fs.open(self._path(self._pointer(n)))
        try:
            text = str(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return text.split() if text.endswith("\n") else None

    def _pointer(self, n: int) -> str:
        return f"{self.root}/current-{S.SCHEMA_VERSION}-{n}"

    def version(self) -> int | None:
        """The current version: the last with a whole pointer."""
        return next((n for n in reversed(self._pointers()) if self._fragments(n) is not None), None)

    def create(self) -> None:
        if self.version() is None:
            self._commit([], {name: self.spark.createDataFrame([], kind) for name, kind in S.TABLES.items()}, None)

    # -- reading ---------------------------------------------------------------------------
    def _read(self, name: str, fragments: list[str], symbol: str | None = None) -> DataFrame:
        base, schema = f"{self.root}/data/{name}", _stored(name)
        paths = [f"{base}/writer={x}" for x in fragments]
        if symbol is not None:
            own = self.spark.range(1).select(bucket(F.lit(symbol))).first()[0]
            paths = [f"{x}/{_BUCKET}={own}" for x in paths]
        paths = [x for x in paths if self._fs.exists(self._path(x))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def _gone(self, fragments: list[str]) -> DataFrame | None:
        """variant, path, table, and the number of the fragment from which on rows of the file count."""
        paths = [f"{self.root}/gone/writer={x}" for x in fragments if self._fs.exists(self._path(f"{self.root}/gone/writer={x}"))]
        if not paths:
            return None
        rows = self.spark.read.schema("of string, variant string, path string, from int").parquet(*paths)
        return rows.groupBy("of", "variant", "path").agg(F.max("from").alias("from"))

    def _live(self, name: str, fragments: list[str], symbol: str | None = None) -> DataFrame:
        rows = self._read(name, fragments, symbol)
        gone = self._gone(fragments) if name in OF_FILES else None
        if gone is None:
            return rows
        path = "file" if name == "commands" else "path"
        own = gone.where(F.col("of") == name).select(F.col("variant").alias("gone_variant"), F.col("path").alias("gone_path"), "from")
        number = F.split("writer", "-")[0].cast("int")
        return rows.join(own, (F.col("variant") == F.col("gone_variant")) & (F.col(path) == F.col("gone_path")) & (number < F.col("from")), "left_anti")

    def _current(self) -> list[str]:
        n = self.version()
        if n is None:
            raise ValueError(f"no index at {self.root}")
        return self._fragments(n)

    def table(self, name: str) -> DataFrame:
        """The rows of a table as they are now; of ``records`` with their bucket."""
        fragments = self._current()
        if name not in OF_FILES:  # kept whole by each fragment
            fragments = fragments[-1:]
        return self._live(name, fragments).drop("writer")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name).select(*kind.names) for name, kind in S.TABLES.items()}

    def added(self, n: int) -> dict[str, int]:
        """How many rows the fragment of a version holds, by table."""
        own = [x for x in self._fragments(n) if x.startswith(f"{n}-")]
        return {name: self._read(name, own).count() for name in OF_FILES}

    def symbol(self, name: str) -> DataFrame:
        """Records of one symbol: its bucket's folders only, and row groups by the sorted symbol."""
        return self._live("records", self._current(), name).where(F.col("symbol") == name).select(*S.RECORDS.names)

    # -- storing ---------------------------------------------------------------------------
    def store(self, staged: dict[str, DataFrame], restage: Callable[[DataFrame], dict[str, DataFrame]] | None = None, tries: int = 3) -> int:
        """Merge staged tables; returns the new version. Files that are marked as cached bring no
        rows of their own; if the index has changed under them, ``restage`` gets these files and
        gives the tables staged anew, up to ``tries`` times."""
        self.create()
        for _ in range(tries):
            base, files = self.tables(), staged["files"]
            if "cached" not in files.columns:
                break
            stale = merge.stale(files.where("cached = 1"), base["files"])
            if stale.isEmpty():
                cached = files.where("cached = 1").select(*merge.FILE_KEY)
                staged = {k: v.join(cached, merge.FILE_KEY, "left_anti").select(*v.columns) if k not in ("files", "variants", "commands") else v for k, v in staged.items()}
                break
            if restage is None:
                raise StaleCache(f"changed under {self.root}: {[r['path'] for r in stale.select('path').limit(10).collect()]}")
            staged = restage(stale)
        else:
            raise StaleCache(f"{self.root} changed {tries} times while files were staged")
        fragments = self._current()
        if len(fragments) >= MOST_FRAGMENTS:
            merged = base | merge.merge(base, staged)
            if "commands" in staged:
                old = base["commands"].join(staged["commands"].select("variant", "file"), ["variant", "file"], "left_anti")
                merged["commands"] = old.unionByName(staged["commands"].select(*old.columns))
            return self._commit([], merged, None)
        replaced = merge.replaced_files(base["files"], staged["files"])
        newer = merge.upserted_files(base["files"], staged["files"]).join(base["files"], S.FILES.names, "left_anti")
        rows = {"files": newer}
        gone = [self._of("files", newer)]
        for name in ("records", "symbol_types", "function_types", "file_fingerprints"):
            gone.append(self._of(name, replaced))
            if name in staged:
                rows[name] = merge.fresh_rows(base[name], staged[name], replaced, S.KEYS[name], ["seq"] if "seq" in staged[name].columns else ())
        if "commands" in staged:
            rows["commands"] = staged["commands"]
            gone.append(self._of("commands", staged["commands"].select("variant", F.col("file").alias("path"))))
        rows["variants"] = merge.upserted_variants(base["variants"], staged["variants"]) if "variants" in staged else base["variants"]
        dead = gone[0]
        for more in gone[1:]:
            dead = dead.unionByName(more)
        return self._commit(fragments, rows, dead)

    def _of(self, name: str, files: DataFrame) -> DataFrame:
        return files.select(F.lit(name).alias("of"), "variant", "path").distinct()

    def _commit(self, before: list[str], tables: dict[str, DataFrame], gone: DataFrame | None) -> int:
        """Write a fragment, then the pointer of the version that it makes with those before."""
        pointers = self._pointers()
        n = pointers[-1] + 1 if pointers else 0
        own = f"{n}-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                out, path = df.select(*S.TABLES[name].names), f"{self.root}/data/{name}/writer={own}"
                if name == "records":
                    out = out.withColumn(_BUCKET, bucket(F.col("symbol"))).repartition("variant", _BUCKET).sortWithinPartitions(_BUCKET, "variant", *S.KEYS["records"])
                    out.write.partitionBy(_BUCKET, "variant").parquet(path)
                else:
                    out.write.parquet(path)
            if gone is not None:
                gone.withColumn("from", F.lit(n)).write.parquet(f"{self.root}/gone/writer={own}")
            try:
                stream = self._fs.create(self._path(self._pointer(n)), False)
            except Exception as error:
                raise OSError(f"version {n} of {self.root} has another writer") from error
        except BaseException:
            self._remove([own])
            raise
        stream.write(("\n".join([*before, own]) + "\n").encode())
        stream.close()
        self._retire(n)
        return n

    def _retire(self, n: int) -> None:
        """Readers of the last version go on; what only older ones list is removed."""
        whole = [(v, f) for v in self._pointers() if (f := self._fragments(v)) is not None and v <= n]
        needed = {x for _, f in whole[-2:] for x in f}
        for v, fragments in whole[:-2]:
            self._fs.delete(self._path(self._pointer(v)), False)
            self._remove([x for x in fragments if x not in needed])

    def _remove(self, fragments: list[str]) -> None:
        for x in fragments:
            for folder in (*(f"data/{name}" for name in S.TABLES), "gone"):
                self._fs.delete(self._path(f"{self.root}/{folder}/writer={x}"), True)

    def vacuum(self, hours: float = 24) -> list[str]:
        """Remove fragments that no version lists and that nobody has written to for ``hours``;
        these are what crashed writers left."""
        listed = {x for v in self._pointers() for x in self._fragments(v) or ()}
        found: dict[str, int] = {}
        for folder in (*(f"data/{name}" for name in S.TABLES), "gone"):
            path = self._path(f"{self.root}/{folder}")
            for f in self._fs.listStatus(path) if self._fs.exists(path) else ():
                x = str(f.getPath().getName()).removeprefix("writer=")
                if x not in listed:
                    found[x] = max(found.get(x, 0), f.getModificationTime())
        old = [x for x, at in found.items() if at <= (time.time() - hours * 3600) * 1000]
        self._remove(old)
        return sorted(old)


class StaleCache(Exception):
    """Files taken for cached are not as stored any more."""


def _stored(name: str) -> T.StructType:
    """The columns of a table's files, then those of its folders."""
    fields, writer = S.TABLES[name].fields, T.StructField("writer", T.StringType())
    if name != "records":
        return T.StructType([*fields, writer])
    rest = [f for f in fields if f.name != "variant"]
    return T.StructType([*rest, writer, T.StructField(_BUCKET, T.IntegerType()), T.StructField("variant", T.StringType())])
