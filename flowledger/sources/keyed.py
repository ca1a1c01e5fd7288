"""Result rows by key: any number of rows for a key, each key's number of rows and row sums beside them, in buckets by the key's first digit.

A part of the rows and the part of the manifest that describes it have the same id and are committed together. A key that was
computed twice stands in two parts; the manifest row of the later one counts, so that no row is given twice. Buckets are
folders: a lookup of few keys reads only theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import SUMS, sums, sums_digest
from .store import Store

KEY, BUCKET = "__key", "__bucket"


def bucket() -> Column:
    return F.substring(KEY, 1, 1)


class Keyed:
    """rows-<name> and manifest-<name> in a store; columns are those of the results, in order, with their types."""

    def __init__(self, store: Store, name: str, columns: list[tuple[str, str]]) -> None:
        self.store, self.name, self.columns = store, name, columns
        self.ddl = ", ".join([f"`{KEY}` string", *(f"`{c}` {t}" for c, t in columns)])

    def manifest(self) -> DataFrame:
        """(key, bucket, n, s1, s2, part): one row for each stored key."""
        held = self.store.load(f"manifest-{self.name}", f"`{KEY}` string, {SUMS}", [p for p, _ in self.store.parts(f"manifest-{self.name}")], BUCKET)
        best = F.max_by(F.struct("n", "s1", "s2", "part"), "part")
        return held.groupBy(KEY, BUCKET).agg(best.alias("m")).select(KEY, BUCKET, "m.*")

    def put(self, rows: DataFrame, keys: DataFrame) -> str:
        """Write rows (key, columns) and the manifest of all keys, also of those without a row. What it writes counts once `tables(part)` are committed."""
        named = rows.select(KEY, *(F.col(f"`{c}`").cast(t).alias(c) for c, t in self.columns)).withColumn(BUCKET, bucket())
        part = self.store.write(f"rows-{self.name}", named, BUCKET)
        written = self.store.load(f"rows-{self.name}", self.ddl, [part], BUCKET)
        listed = keys.select(KEY).distinct().join(sums(written, [c for c, _ in self.columns], [KEY]), KEY, "left").na.fill(0, ["n"])
        zero = F.lit(0).cast("decimal(38,0)")
        listed = listed.select(KEY, F.col("n").cast("long"), *(F.coalesce(c, zero).alias(c) for c in ("s1", "s2")), bucket().alias(BUCKET))
        listed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.store.root}/manifest-{self.name}/part={part}")
        return part

    def tables(self, part: str) -> list[tuple[str, str]]:
        return [(f"rows-{self.name}", part), (f"manifest-{self.name}", part)]

    def rows(self, listed: DataFrame) -> DataFrame:
        """The rows of the keys of a (part of the) manifest, with key."""
        held = self.store.load(f"rows-{self.name}", self.ddl, [p for p, _ in self.store.parts(f"rows-{self.name}")], BUCKET)
        return listed.select(KEY, BUCKET, "part").join(held, [KEY, BUCKET, "part"]).select(KEY, *(F.col(f"`{c}`") for c, _ in self.columns))

    def digest(self, listed: DataFrame) -> str:
        """The digest of the rows of these keys, from the manifest alone."""
        got = listed.agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).first()
        return sums_digest(self.columns, got.n, got.s1, got.s2)

    def check(self, listed: DataFrame) -> None:
        """A ValueError if stored rows differ from their manifest."""
        names = [c for c, _ in self.columns]
        found = sums(self.rows(listed), names).first()
        if sums_digest(self.columns, found.n, found.s1, found.s2) == self.digest(listed):
            return
        each = listed.join(sums(self.rows(listed), names, [KEY]).select(KEY, F.struct("n", "s1", "s2").alias("f")), KEY, "left")
        bad = each.where((F.coalesce(F.col("f.n"), F.lit(0)) != F.col("n")) | (F.col("n") > 0) & ((F.col("f.s1") != F.col("s1")) | (F.col("f.s2") != F.col("s2")))).select(KEY).limit(5).collect()
        raise ValueError(f"stored rows of {self.name!r} don't match their digest: " + ", ".join(r[0] for r in bad))

    def sweep(self, live: DataFrame) -> tuple[list[tuple[str, str]], list[str], int]:
        """(parts to add, parts to remove, keys that go): parts without a live key go whole; the live rows of others with dead keys move to a new part."""
        listed = self.manifest()
        marked = listed.join(live.select(KEY).distinct().withColumn("__live", F.lit(True)), KEY, "left")
        dead = marked.where("__live IS NULL").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each part
        all_parts = [p for p, _ in self.store.parts(f"manifest-{self.name}")]
        used = {r.part for r in listed.select("part").distinct().collect()}
        parts = sorted({r.part for r in dead} | (set(all_parts) - used))
        if not parts:
            return [], [], 0
        stay = marked.where(F.col("__live").isNotNull() & F.col("part").isin(parts)).drop("__live")
        added = []
        if not stay.isEmpty():
            rows = self.rows(stay)
            added = self.tables(self.put(rows, stay))
        return added, [f"{t}/part={p}" for p in parts for t in (f"rows-{self.name}", f"manifest-{self.name}")], sum(r.n for r in dead)
