"""Tables cut into buckets by key, of which a reader opens only those that its keys fall into.

A table is a folder with a Parquet folder for each version, partitioned by bucket.  Which versions of a bucket count stands in
``entries``: ``{bucket: [[version, rows, digest], ...]}``; the owner keeps that in a manifest of its own, so a version that was written
but not entered does not exist.  ``append`` adds a version to the buckets of its rows; ``replace`` writes the buckets of the
replaced keys anew.  Bucket numbers and their entries are what the driver holds, whatever the number of rows; when buckets grow
beyond ``target`` rows on average, there are made four times as many, or as many times four as it takes.  A first ``append`` that says
how many rows it has gets buckets enough at once, so that they need not be written anew.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions of one bucket before they are written together.
VERSIONS = 8


def digest(columns: list[str]) -> Column:
    """An aggregate over rows that does not depend on their order."""
    return F.sum(F.xxhash64(*sorted(columns)).cast("decimal(38,0)")).cast("string")


class Buckets:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str, count: int = 8, target: int = 100_000, entries: dict[str, list[list]] | None = None):
        self.spark, self.folder, self.keys, self.schema, self.count, self.target = spark, folder, keys, schema, count, target
        self.entries: dict[str, list[list]] = entries or {}
        self.columns = spark.createDataFrame([], schema).columns
        self.rows_read = self.rows_written = 0

    def bucket(self, *names: str) -> Column:
        return F.pmod(F.xxhash64(*(names or self.keys)), F.lit(self.count)).cast("int")

    def rows(self) -> int:
        return sum(e[1] for versions in self.entries.values() for e in versions)

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = self.entries if buckets is None else [str(b) for b in buckets if str(b) in self.entries]
        self.rows_read += sum(e[1] for b in wanted for e in self.entries[b])
        paths = [f"{self.folder}/v{version}/bucket={b}" for b in wanted for version, *_ in self.entries[b]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """At most as many numbers as there are buckets."""
        return [r[0] for r in keys.select(self.bucket(*keys.columns[: len(self.keys)])).distinct().collect()]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with one of ``keys``, whose first columns are the key."""
        names = dict(zip(keys.columns, self.keys))
        wanted = keys.select([F.col(a).alias(b) for a, b in names.items()]).distinct()
        return self.read(self.buckets_of(keys)).join(wanted, self.keys, "left_semi")

    def _write(self, rows: DataFrame, version: int) -> dict[str, list]:
        path = f"{self.folder}/v{version}"
        out = rows.select(*self.columns, self.bucket().alias("bucket")).hint("rebalance", "bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(path)
        stored = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).groupBy("bucket").agg(F.count("*").alias("n"), digest(self.columns).alias("d")).collect()
        self.rows_written += sum(r["n"] for r in stored)
        return {str(r["bucket"]): [version, r["n"], r["d"]] for r in stored}

    def _enough(self, rows: int) -> int:
        count = self.count
        while rows > self.target * count:
            count *= 4
        return count

    def append(self, rows: DataFrame, version: int, n: int = 0) -> None:
        if not self.entries:
            self.count = self._enough(n)
        for bucket, entry in self._write(rows, version).items():
            self.entries.setdefault(bucket, []).append(entry)

    def replace(self, keys: DataFrame, rows: DataFrame, version: int, on: list[str] | None = None) -> None:
        """``rows`` instead of all rows that agree with one of ``keys`` on the key columns, or on ``on``, which begin with them."""
        on = on or self.keys
        names = dict(zip(keys.columns, on))
        wanted = keys.select([F.col(a).alias(b) for a, b in names.items()]).distinct()
        buckets = self.buckets_of(wanted.select(self.keys))
        kept = self.read(buckets).join(wanted, on, "left_anti")
        written = self._write(kept.unionByName(rows.select(*self.columns)), version)
        for b in map(str, buckets):
            self.entries.pop(b, None)
        self.entries.update({b: [entry] for b, entry in written.items()})

    def tidy(self, version: int) -> None:
        """Buckets of many versions are written together; if buckets have become large, there are more of them from now on."""
        enough = self._enough(self.rows())
        if enough > self.count:
            whole = self.read()
            self.count = enough
            self.entries = {b: [entry] for b, entry in self._write(whole, version).items()}
            return
        many = [b for b, versions in self.entries.items() if len(versions) > VERSIONS]
        if many:
            written = self._write(self.read(map(int, many)), version)
            self.entries.update({b: [entry] for b, entry in written.items()})

    def sound(self) -> bool:
        """Whether what is stored is what was entered."""
        try:
            found = {}
            for version in {e[0] for versions in self.entries.values() for e in versions}:
                rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/v{version}").groupBy("bucket").agg(F.count("*").alias("n"), digest(self.columns).alias("d"))
                found |= {(str(r["bucket"]), version): [version, r["n"], r["d"]] for r in rows.collect()}
        except Exception:  # files that are gone or cannot be read
            return False
        return all(found.get((b, e[0])) == e for b, versions in self.entries.items() for e in versions)
