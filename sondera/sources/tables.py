"""Reading and writing tables: Parquet, JSON lines, CSV, file discovery, versioned publishing."""

from __future__ import annotations

import atexit
import contextlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Derived:
    """Tables that follow from a stored table, such as an index: built once in a session, then read by all queries.

    They lie in the folder of spark.checkpoint.dir, which the cluster shares (a folder of the warehouse where that is
    unset), until the driver's Python ends. The key holds the source's length and time of change, so a source
    that was written anew gets its tables anew.
    """

    _held: dict[tuple, str] = {}

    def __init__(self, spark: SparkSession, source: str, kind: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(source)
        fs = p.getFileSystem(conf)
        self.spark, self.key = spark, (spark.sparkContext.applicationId, source, kind, fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime())
        self.dir, self.known = self._held.get(self.key) or f"{base.rstrip('/')}/sondera-{kind}-{uuid.uuid4().hex}", self.key in self._held

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.dir}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}")

    def forget(self, *names: str) -> None:
        """Delete tables that only later ones were made from."""
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self) -> None:
        """The tables are complete: from now on they are read."""
        self._held[self.key] = self.dir
        atexit.register(self.drop)

    def drop(self) -> None:
        self._held.pop(self.key, None)
        with contextlib.suppress(Exception):  # the session may be gone
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.dir)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One record per line. strict: a malformed line fails the read; otherwise blank lines and a BOM are passed over and
    malformed lines come back in `_malformed`."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    fields = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    full = T.StructType([*fields.fields, T.StructField("_malformed", T.StringType())])
    return lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": "_malformed"}).alias("_r")).select("_r.*")


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with keys in sorted order and rows in the given order; part files follow each other."""
    df.select(*sorted(df.columns)).sort(*order).write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def discover(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a folder: path, length, modification time and SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


class Pointer:
    """What readers of a folder see, as JSON in numbered files; the highest number counts.

    A new state is written aside and renamed to the next number. Readers find the old state or the new one at any time,
    also after a crash, and of two writers at once the second fails, for its number is taken.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _last(self) -> str | None:
        found = self._fs.globStatus(self._path(f"{self.path}/pointer-*"))
        return max((f.getPath().getName() for f in found or []), default=None)

    def state(self) -> tuple[int, dict]:
        """The number of the state and the state; 0 and an empty one before the first."""
        last = self._last()
        if last is None:
            return 0, {"version": None, "history": []}
        return int(last.removeprefix("pointer-")), json.loads(self.spark.read.text(f"{self.path}/{last}").first()["value"])

    def move(self, after: int, state: dict) -> None:
        """Make `state` the one that follows number `after`."""
        tmp, to = self._path(f"{self.path}/.pointer-{uuid.uuid4().hex}"), self._path(f"{self.path}/pointer-{after + 1:012d}")
        out = self._fs.create(tmp)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(tmp, to):
            self._fs.delete(tmp, False)
            raise RuntimeError(f"another writer has followed state {after} of {self.path}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)


class VersionedTable:
    """Immutable versions of a table below a folder, and a pointer to the one that readers see.

    publish() writes a new version, checks it, and only then moves the pointer: a failed build leaves readers on the
    old version. rollback() points back.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._pointer = spark, path.rstrip("/"), Pointer(spark, path)

    @property
    def version(self) -> str | None:
        return self._pointer.state()[1]["version"]

    def publish(self, df: DataFrame, version: str, check=None) -> None:
        n, state = self._pointer.state()
        if version in state["history"]:
            raise ValueError(f"version {version} exists")
        df.write.mode("overwrite").parquet(f"{self.path}/{version}")
        if check and not check(self.spark.read.parquet(f"{self.path}/{version}")):
            self._pointer.delete(version)
            raise ValueError(f"version {version} failed its check")
        self._pointer.move(n, {"version": version, "history": [*state["history"], version]})

    def rollback(self, version: str) -> None:
        n, state = self._pointer.state()
        if version not in state["history"]:
            raise ValueError(f"no version {version}")
        self._pointer.move(n, state | {"version": version})

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version}")


class VersionedTables:
    """Several tables that change together: one pointer says which folders each of them is made of.

    A version lists the folders of every table, so it may replace a table, add rows to it as one more folder, or leave
    it as it was without writing it again. Readers see all tables of one version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._pointer = spark, path.rstrip("/"), Pointer(spark, path)

    @property
    def version(self) -> str | None:
        return self._pointer.state()[1]["version"]

    def tables(self) -> dict[str, list[str]]:
        """Folders of each table in the version that readers see."""
        state = self._pointer.state()[1]
        return state["of"][state["version"]] if state["version"] else {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{x}" for x in self.tables()[name]))

    @contextlib.contextmanager
    def change(self, version: str):
        """A Change; when the block ends its tables become the version that readers see, all at once. If it fails,
        nothing changes."""
        n, state = self._pointer.state()
        if version in state["history"]:
            raise ValueError(f"version {version} exists")
        c = Change(self.spark, self.path, version, {k: list(v) for k, v in (state["of"][state["version"]] if state["version"] else {}).items()})
        try:
            yield c
        except BaseException:
            self._pointer.delete(version)
            raise
        self._pointer.move(n, {"version": version, "history": [*state["history"], version], "of": state.get("of", {}) | {version: c.tables}})

    def rollback(self, version: str) -> None:
        n, state = self._pointer.state()
        if version not in state["history"]:
            raise ValueError(f"no version {version}")
        self._pointer.move(n, state | {"version": version})


class Change:
    """Tables of a version in the making."""

    def __init__(self, spark: SparkSession, path: str, version: str, tables: dict[str, list[str]]):
        self.spark, self.path, self.version, self.tables = spark, path, version, tables

    def has(self, name: str) -> bool:
        return name in self.tables

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{x}" for x in self.tables[name]))

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """The table is df from this version on; returns the rows as written."""
        self.tables[name] = []
        return self.add(name, df)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """The table has df's rows besides those it had; returns the new rows as written."""
        folder = f"{self.version}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        self.tables.setdefault(name, []).append(folder)
        return self.spark.read.parquet(f"{self.path}/{folder}")
