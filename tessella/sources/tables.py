"""Tabular sources and sinks with accounting."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    pass


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The tables that exist, by name; absent columns are NULL. An error if there is none."""
    there = [spark.read.parquet(p) for p in paths if exists(spark, p)]
    if not there:
        raise SourceError(f"none of {paths} exists")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there)


def keyed_scan(spark: SparkSession, path: str, key: str, keys: list, columns: list[str] | None = None) -> DataFrame:
    """Only some keys (pushed to the scan), and an error if a key asked for is not there."""
    df = spark.read.parquet(path).filter(F.col(key).isin(keys))
    got = {r[0] for r in df.select(key).distinct().collect()}  # at most the keys asked for
    if gone := [k for k in keys if k not in got]:
        raise SourceError(f"keys not found: {gone[:5]}")
    return df.select(*columns) if columns else df


def accounted_shards(spark: SparkSession, path: str, index: str, expected: int | None = None) -> DataFrame:
    """Shards whose index must be a permutation of 0..n-1 (and n as expected)."""
    df = spark.read.parquet(path)
    r = df.agg(F.count("*").alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    if r["n"] and (r["d"] != r["n"] or r["lo"] != 0 or r["hi"] != r["n"] - 1) or expected is not None and r["n"] != expected:
        raise SourceError(f"shards hold {r.asDict()}, expected {expected} rows with a gapless index")
    return df


def csv_repaired(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A CSV whose header is wrong (merged or missing names): the first line is dropped, names are given; fields may be long and hold newlines."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=True, escape='"', maxCharsPerColumn=-1)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="errorifexists")


def json_pages(spark: SparkSession, path: str, schema: str, key: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(Gzipped) JSON lines or page arrays under a declared schema, optionally only some keys."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.join(keys, key, "left_semi") if keys is not None else df


def partial_json(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Only the declared fields of a JSON column are parsed."""
    return df.withColumn("_j", F.from_json(text, schema)).select(*[c for c in df.columns if c != text], "_j.*")


def publish(df: DataFrame, path: str, split: str | None = None) -> None:
    """A table that must not exist yet; by split directories if asked. Shards, retries and commit are Spark's."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(split) if split else w).parquet(path)


def canonical_json(columns: list[str]) -> Column:
    """JSON with sorted keys, as an identity."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def keys_digest(df: DataFrame, key: str) -> DataFrame:
    """One row: sha256 of the sorted keys (as text, by code points) joined by newlines, and their number.

    A hash of one stream has no parallel form: sorting is Spark's, and the driver
    takes the sorted keys partition by partition and holds none of them.
    """
    state, n = hashlib.sha256(), 0
    for r in df.select(F.col(key).cast("string").alias("k")).filter("k is not null").orderBy("k").toLocalIterator(prefetchPartitions=True):
        state.update(("\n" if n else "").encode() + r[0].encode())
        n += 1
    return df.sparkSession.createDataFrame([(state.hexdigest(), n)], "digest string, n long")


def yaml_rows(spark: SparkSession, text: str, columns: list[str]) -> DataFrame:
    """A small YAML mapping name -> fields as a table (all strings)."""
    import yaml

    rows = [(str(k), *[None if (v or {}).get(c) is None else str(v[c]) for c in columns]) for k, v in (yaml.safe_load(text) or {}).items()]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["name", *columns]))


def first_wins(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """The first record of each key by position."""
    names = df.columns
    return df.groupBy(*[F.col(k).alias("_" + k) for k in key]).agg(F.min_by(F.struct(*names), position).alias("_r")).select("_r.*")


def preferred_symmetric(df: DataFrame, a: str, b: str, rank: str) -> DataFrame:
    """The record of the lowest rank for each ordered pair, where (a, b) and (b, a) are the same."""
    swapped = df.withColumnsRenamed({a: "_t", b: a}).withColumnRenamed("_t", b)
    both = df.unionByName(swapped)
    names = df.columns
    return both.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.min_by(F.struct(*names), F.struct(rank, *[F.col(c).cast("string") for c in names])).alias("_r")).select("_r.*")


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's row with the largest order (which ends in a unique column)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


class AuditLog:
    """Append-only JSON lines with a quota; the number of lines is the count of uses."""

    def __init__(self, path: str, quota: int):
        self.path, self.quota = path, quota

    def used(self) -> int:
        try:
            with open(self.path) as f:
                return sum(1 for line in f if line.strip())
        except FileNotFoundError:
            return 0

    def record(self, **what) -> int:
        n = self.used()
        if n >= self.quota:
            raise SourceError(f"the quota of {self.quota} is used up")
        with open(self.path, "a") as f:
            f.write(json.dumps(what, sort_keys=True) + "\n")
        return n + 1


class UseLog:
    """A quota of uses in a shared folder: each use is a file of its own number, made only if it is not there.

    Two writers that take one number at a time can't both have it, on any file system
    on which a file is created exclusively.
    """

    def __init__(self, spark: SparkSession, path: str, quota: int):
        self.spark, self.path, self.quota = spark, path, quota

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def used(self) -> int:
        fs, at = self._fs(self.path)
        return sum(f.getPath().getName().startswith("use-") for f in fs.listStatus(at)) if fs.exists(at) else 0

    def record(self, **what) -> int:
        """The number of this use; refused once the quota is used up."""
        for n in range(self.used() + 1, self.quota + 1):
            fs, at = self._fs(f"{self.path}/use-{n:06d}")
            try:
                out = fs.create(at, False)
            except Exception:
                if not fs.exists(at):
                    raise
                continue  # another writer has this number
            out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
            out.close()
            return n
        raise SourceError(f"the quota of {self.quota} is used up")
