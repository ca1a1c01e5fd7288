"""Files as inputs: declared paths and globs are read once in a run, kept by their content, and joined to the items that name them.

A snapshot is a table (path, sha256, bytes); contents are blobs of the store, written only where the store hasn't them. What a step reads later
comes from the blobs, so a file that changes during a run is seen by the next run only.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

MANIFEST = "path string, sha256 string, bytes long"
#: The largest file that `read_text` and `read_bytes` bring to the driver.
MOST_BYTES = 64 << 20


class UndeclaredInputError(KeyError):
    """A step asked for a file that it hasn't declared."""


def scan(spark: SparkSession, root: str, patterns: Iterable[str]) -> DataFrame:
    """(path, content, length) of all files below root that match; paths are relative to root. A pattern that no file matches is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(at).toUri().getPath().rstrip("/")
    out = None
    for pattern in sorted(set(patterns)):
        if pattern.startswith("/") or ".." in pattern.split("/"):
            raise ValueError(f"a declared file is below the root: {pattern!r}")
        if not fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")):
            raise FileNotFoundError(f"no file matches {pattern!r}")
        found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{pattern}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "path string, content binary, length long")
    named = F.regexp_replace(F.col("path"), r"^[a-z]\w*:(//[^/]*)?", "")
    return out.select(F.substr(named, F.lit(len(base) + 2)).alias("path"), "content", "length").dropDuplicates(["path"])


def capture(store: Store, root: str, patterns: Iterable[str], run_id: str) -> DataFrame:
    """(path, sha256, bytes), kept as the run's `files`; a content that the store hasn't is written to its blobs."""
    refs = store.put_blobs(scan(store.spark, root, patterns).select("path", "content"), run_id)
    part = store.write("files", refs.select("path", "sha256", F.col("bytes").cast("long").alias("bytes")))
    store.commit(run_id, [("files", part)])
    return store.load("files", MANIFEST, [part]).drop("part")


def matches(pattern: str) -> Column:
    """Whether `path` matches a glob of *, ? and **-free segments: a star stays within its folder."""
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_- " else f"\\{c}" for c in pattern)
    return F.col("path").rlike(f"^{body}(/.*)?$")


def declared(snapshot: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """The snapshot's rows that a step has declared."""
    some = list(patterns)
    keep = F.lit(False)
    for p in some:
        keep = keep | matches(p)
    return snapshot.where(keep)


def with_files(items: DataFrame, item: str, paths: Column, snapshot: DataFrame) -> DataFrame:
    """items with `files`, the (path, sha256) of each one's paths in order of path. A path that no declared file has fails the query."""
    asked = items.select(F.col(item).alias("__id"), F.explode(F.array_distinct(paths)).alias("path"))
    met = asked.join(snapshot.select("path", "sha256"), "path", "left")
    missing = F.concat(F.lit("item "), F.col("__id").cast("string"), F.lit(" names an undeclared file: "), F.col("path"))
    met = met.withColumn("sha256", F.when(F.col("sha256").isNull(), F.raise_error(missing).cast("string")).otherwise(F.col("sha256")))
    listed = met.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("files"))
    empty = F.array().cast("array<struct<path:string,sha256:string>>")
    return items.join(listed, F.col(item) == F.col("__id"), "left").drop("__id").withColumn("files", F.coalesce("files", empty))


def contents(store: Store, items: DataFrame, item: str) -> DataFrame:
    """items with `files` as (path, sha256, content): the blobs are joined by digest, so equal files are read once."""
    asked = items.select(F.col(item).alias("__id"), F.inline("files"))
    met = asked.join(store.read_blobs(), "sha256")
    listed = met.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "content"))).alias("__files"))
    empty = F.array().cast("array<struct<path:string,sha256:string,content:binary>>")
    return items.join(listed, F.col(item) == F.col("__id"), "left").drop("__id", "files").withColumnRenamed("__files", "files").withColumn("files", F.coalesce("files", empty))


class Inputs(dict):
    """What a step's function gets: its dependencies' tables by name, its parameters, and the files that it declared."""

    def __init__(self, tables: Mapping[str, DataFrame], *, params: Mapping | None = None, store: Store | None = None, snapshot: DataFrame | None = None) -> None:
        super().__init__(tables)
        self.params, self._store, self._snapshot = dict(params or {}), store, snapshot

    def having(self, tables: Mapping[str, DataFrame]) -> Inputs:
        """The same with other tables."""
        return Inputs(tables, params=self.params, store=self._store, snapshot=self._snapshot)

    @property
    def files(self) -> DataFrame:
        """(path, sha256, bytes, content) of the declared files, as they were when the run began."""
        if self._snapshot is None or self._store is None:
            raise UndeclaredInputError("this step has declared no files")
        return self._snapshot.join(self._store.read_blobs(), "sha256").select("path", "sha256", "bytes", "content")

    def read_bytes(self, path: str) -> bytes:
        """One small declared file."""
        row = None if self._snapshot is None else self._snapshot.where(F.col("path") == path).first()
        if row is None:
            raise UndeclaredInputError(path)
        if row.bytes > MOST_BYTES:
            raise ValueError(f"{path} has {row.bytes} bytes; read it as a table")
        return bytes(self._store.read_blobs().where(F.col("sha256") == row.sha256).first().content)

    def read_text(self, path: str) -> str:
        return self.read_bytes(path).decode("utf-8")
