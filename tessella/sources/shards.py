"""Tables written shard by shard, taken up where a run stopped, merged and published without replacing anything.

A shard is whole or not there: it is written to a staging folder and renamed into
place, so the folder's listing is the manifest of what is finished. Everything goes
through the Hadoop file system of the path.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the shards that are there."""
    fs, at = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("shard=")) for n in names if n.startswith("shard="))


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Rename a finished folder into place; an existing target is refused and stays as it is."""
    fs, to = _fs(spark, target)
    if fs.exists(to):
        raise FileExistsError(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(_fs(spark, staged)[1], to):
        raise OSError(f"{staged} can't be renamed to {target}")


def write_missing(df: DataFrame, key: str, shards: int, path: str, build: Callable[[DataFrame], DataFrame] | None = None, at_once: int = 64) -> list[int]:
    """Write the shards (by hash of ``key``) that are not there yet; their numbers.

    ``build`` makes a shard's rows from the table's rows of the shard (it must keep the
    column ``shard``). ``at_once`` shards are one job; a run that stops loses those of
    its last job at most. Rows of finished shards are not read beyond the key.
    """
    spark = df.sparkSession
    missing = sorted(set(range(shards)) - set(finished(spark, path)))
    keyed = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    for a in range(0, len(missing), at_once):
        some = missing[a : a + at_once]
        ask = spark.createDataFrame([(k,) for k in some], "shard int")
        rows = keyed.join(F.broadcast(ask), "shard", "left_semi")
        rows = (build(rows) if build else rows).repartition(len(some), "shard")
        staged = f"{path}-staged-{uuid.uuid4().hex}"
        rows.write.partitionBy("shard").parquet(staged)
        there = set(finished(spark, staged))
        for k in some:
            if k not in there:  # a shard without rows is finished too
                fs, at = _fs(spark, f"{staged}/shard={k}")
                fs.mkdirs(at)
            publish(spark, f"{staged}/shard={k}", f"{path}/shard={k}")
        fs, at = _fs(spark, staged)
        fs.delete(at, True)
    return missing


def merge(spark: SparkSession, path: str, target: str, shards: int) -> DataFrame:
    """All shards as one table at ``target``, with the columns and types of the first shard that has rows.

    A column that a shard lacks is NULL there, a column that the first lacks is left
    out. Refused while a shard is missing or if the target exists.
    """
    have = finished(spark, path)
    if have != list(range(shards)):
        raise ValueError(f"{shards - len(have)} of {shards} shards are missing")
    fs, to = _fs(spark, target)
    if fs.exists(to):
        raise FileExistsError(target)
    full = [k for k in have if any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(_fs(spark, f"{path}/shard={k}")[1]))]
    if not full:
        raise ValueError("no shard has rows")
    schema = spark.read.parquet(f"{path}/shard={full[0]}").schema
    parts: dict[str, list[str]] = {}
    for k in full:  # shards of one schema are read together
        at = f"{path}/shard={k}"
        parts.setdefault(spark.read.parquet(at).schema.json(), []).append(at)
    out = None
    for paths in parts.values():
        one = spark.read.parquet(*paths)
        one = one.select(*[(F.col(f"`{f.name}`") if f.name in one.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        out = one if out is None else out.unionByName(one)
    staged = f"{target}-staged-{uuid.uuid4().hex}"
    out.write.parquet(staged)
    publish(spark, staged, target)
    return spark.read.schema(schema).parquet(target)
