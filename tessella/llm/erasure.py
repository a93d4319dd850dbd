"""Cascading erasure from sorted Parquet folders, with exact file boundaries.

Layout: a table is range-partitioned on its order with all columns (and a tie that
tells copies of a row apart), sorted within partitions and written once; the
partitions' counts give each row its exact place, so ``place // rows_a_file`` is
its file number. Rows are then dealt by file number alone, sorted within
partitions, written with ``partitionBy`` to a staging folder and renamed, so that a
table's folder is there whole or not at all. A file is one task's work, row by row.

Erasure: what is to go is a table of keys. The files' (file, key) counts met with it
say which rows go from which file; no key, however frequent, is in more rows of that
table than there are files. Files with victims are read again, without them, and
replaced by a dynamic partition overwrite; Parquet statistics come from the rows
left, as the files are written anew. Files that keep nothing are deleted
explicitly, all others are not touched. Erasing twice erases the same, so a run that
was lost half-way is repeated.

Defined cases: a null key is never erased and its row is placed as an empty string's;
null order keys come first; rows that repeat are all kept or all erased; an empty
table has no files; an input column of the name of the file number makes the
latter take underscores (``file_no_``); other columns are carried through. Columns
must be sortable (no maps).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessella.llm.shared import discard, fresh_path, materialize, unique_names


@dataclass
class Folder:
    """A table's sorted files: ``path/<part>=<number>/one file``."""

    spark: SparkSession
    name: str
    path: str
    schema: StructType  # of the files
    part: str
    rows_a_file: int
    n_rows: int
    listed: DataFrame | None = None

    def read(self) -> DataFrame:
        """All columns, the file number, and with ``_metadata`` what Spark says of the files, which are listed once a version."""
        if self.listed is None:
            schema = StructType([*self.schema.fields, StructField(self.part, LongType())])
            self.listed = self.spark.read.schema(schema).parquet(self.path) if self.n_rows else self.spark.createDataFrame([], schema)
        return self.listed

    def rows_of(self, number: int) -> int:
        return min(self.rows_a_file, self.n_rows - number * self.rows_a_file)


def id_crc(key: Column) -> Column:
    """crc32 of the decimal number, of the empty string for a null."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _names(schema: StructType) -> list[Column]:
    return [F.col(f"`{c}`") for c in schema.names]


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _tasks(spark: SparkSession, files: int) -> int:
    return max(1, min(files, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def lay_out(rows: DataFrame, columns: list[str], order: Column, tie: Column, root: str, name: str, per: int = 350) -> Folder:
    """Write ``columns`` of ``rows`` as files of 1 + floor(n / per) rows, by ``order`` and then all columns.

    ``tie`` is of one value for each row of the input and says nothing of the order;
    it lets equal rows be dealt to several tasks.
    """
    spark = rows.sparkSession
    data = rows.select(*[f"`{c}`" for c in columns])
    part, first, at, task, tied = unique_names(columns, ["file_no", "order_key", "place", "task", "tie"])
    cols = [c.asc_nulls_first() for c in _names(data.schema)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(*_names(data.schema), order.alias(first), tie.alias(tied))
    ranged = keyed.repartitionByRange(n, F.col(first).asc_nulls_first(), *cols, tied).drop(tied)
    ranged = ranged.sortWithinPartitions(F.col(first).asc_nulls_first(), *cols).drop(first)
    ranged = ranged.withColumns({task: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = materialize(ranged, f"erasure-{name}")
    starts, total = [], 0
    for r in ranged.groupBy(task).count().orderBy(task).collect():  # a row a partition
        starts.append((r[0], total))
        total += r[1]
    path, staged = f"{root}/{name}", f"{root}-staged/{name}"
    folder = Folder(spark, name, path, data.schema, part, 1 + total // per, total)
    if total:
        begins = F.broadcast(spark.createDataFrame(starts, f"`{task}` int, `{first}` long"))
        placed = ranged.join(begins, task).withColumn(at, F.col(at) + F.col(first))
        placed = placed.select(*_names(data.schema), F.floor(F.col(at) / folder.rows_a_file).alias(part), at)
        files = -(-total // folder.rows_a_file)
        placed = placed.repartitionById(_tasks(spark, files), F.col(part).cast("int")).sortWithinPartitions(part, at).drop(at)
        placed.write.option("maxRecordsPerFile", 0).partitionBy(part).parquet(staged)
        fs, to = _fs(spark, path)
        fs.mkdirs(to.getParent())
        if not fs.rename(_fs(spark, staged)[1], to):
            raise OSError(f"{staged} can't be renamed to {path}")
    discard(ranged)
    return folder


def holdings(folder: Folder, key: str, doomed: DataFrame) -> DataFrame:
    """(file number, key, n): the rows of each file whose ``key`` is one of ``doomed``'s (one column of distinct values)."""
    goes = doomed.select(F.col(doomed.columns[0]).alias("_key"))
    held = folder.read().groupBy(F.col(folder.part).alias("_file"), F.col(f"`{key}`").alias("_key")).agg(F.count("*").alias("_n"))
    return materialize(held.join(goes, "_key", "left_semi"), f"erasure-{folder.name}-victims")


def _met(folder: Folder, key: str, held: DataFrame, how: str, rows: DataFrame) -> DataFrame:
    """``rows`` of the folder with (or without) those held; a hot key meets file by file."""
    v = held.select("_file", "_key")
    return rows.join(v, (rows[folder.part] == v["_file"]) & (rows[f"`{key}`"] == v["_key"]), how)


def victims_of(folder: Folder, key: str, held: DataFrame, column: str) -> DataFrame:
    """Distinct ``column`` of the rows that go, for the next table."""
    return _met(folder, key, held, "left_semi", folder.read()).select(F.col(f"`{column}`").alias("_next")).filter("_next is not null").distinct()


def erase(folder: Folder, key: str, held: DataFrame) -> dict[int, int]:
    """Rewrite the files that hold victims, delete those left empty; file number -> rows erased."""
    spark, part = folder.spark, folder.part
    gone = {r[0]: r[1] for r in held.groupBy("_file").agg(F.sum("_n")).collect()}  # a row a file
    rewritten = sorted(f for f, n in gone.items() if n < folder.rows_of(f))
    if rewritten:
        rows = folder.read()
        rows = rows.select(*rows.columns, F.col("_metadata.row_index").alias("_at_row")).filter(F.col(part).isin(rewritten))
        left = _met(folder, key, held, "left_anti", rows)
        left = left.repartitionById(_tasks(spark, len(rewritten)), F.col(part).cast("int")).sortWithinPartitions(part, "_at_row").drop("_at_row")
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(part).parquet(folder.path)
    for f in sorted(set(gone) - set(rewritten)):
        fs, at = _fs(spark, f"{folder.path}/{part}={f}")
        fs.delete(at, True)
    folder.listed = None
    return gone


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file, streaming: its number, path, rows, cents and the digest of its ids; a task has whole files in order."""
    number, path, digest, n, cents = None, None, None, 0, 0

    def out():
        one = [pa.array([number], pa.int64()), pa.array([path]), pa.array([n], pa.int64()), pa.array([cents], pa.int64()), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(one, ["file_no", "path", "n_rows", "cents", "ids_sha256"])

    for batch in batches:
        files = batch.column(0).to_numpy()
        cut = [0, *((files[1:] != files[:-1]).nonzero()[0] + 1).tolist(), len(files)]
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            if int(files[a]) != number:
                if number is not None:
                    yield out()
                number, path, digest, n, cents = int(files[a]), batch.column(1)[a].as_py(), hashlib.sha256(), 0, 0
            ids = pc.fill_null(batch.column(2).slice(a, b - a), "").to_pylist()
            digest.update((("," if n else "") + ",".join(ids)).encode())
            n += b - a
            cents += pc.sum(batch.column(3).slice(a, b - a)).as_py() or 0
    if number is not None:
        yield out()


def report(folder: Folder, money: str, gone: dict[int, int]) -> DataFrame:
    """A row per file that is left, from the files as they are now."""
    spark = folder.spark
    rows = folder.read()
    if not folder.n_rows:
        rows = rows.withColumn("_metadata", F.struct(F.lit("").alias("file_path"), F.lit(0).alias("row_index")))
    cents = F.coalesce(F.floor(100 * F.col(f"`{money}`") + 0.5).cast("long"), F.lit(0))
    ids = F.col(f"`{folder.schema.names[0]}`").cast("string")
    rows = rows.select(F.col(folder.part).alias("_file"), F.col("_metadata.file_path").alias("path"), ids.alias("id"), cents.alias("cents"), F.col("_metadata.row_index").alias("at"))
    files = -(-folder.n_rows // folder.rows_a_file)
    rows = rows.repartitionById(_tasks(spark, files), F.col("_file").cast("int")).sortWithinPartitions("_file", "at").drop("at")
    found = rows.mapInArrow(_digests, "file_no long, path string, n_rows long, cents long, ids_sha256 string")
    erased = F.broadcast(spark.createDataFrame(sorted(gone.items()), "file_no long, n_erased long"))
    found = found.join(erased, "file_no", "left").withColumn("rewritten", F.col("n_erased").isNotNull())
    named = {"n_erased": F.coalesce("n_erased", F.lit(0)), "table_name": F.lit(folder.name), "columns": F.lit(",".join(folder.schema.names))}
    order = ["file_no", "n_rows", "n_erased", "cents", "rewritten", "table_name", "ids_sha256", "columns", "path"]
    return found.withColumns(named).select(*order)


def victim_masters(clients: DataFrame, clicks: DataFrame, every: int = 400) -> DataFrame:
    """master_id whose crc32 is divisible by ``every``, and the one whose clients have most clicks (then the smallest)."""
    own = clients.filter("master_id is not null").select("master_id", "client_id").distinct()
    counts = clicks.groupBy("client_id").agg(F.count("*").alias("n"))
    most = own.join(counts, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    most = most.orderBy(F.desc("n"), "master_id").limit(1).select("master_id")
    return own.select("master_id").distinct().filter(id_crc(F.col("master_id")) % every == 0).union(most).distinct()


#: Table, column of money, key by which it is erased.
TABLES = [("clients", "balance", "master_id"), ("clicks", "value", "client_id"), ("sales", "total", "client_id"), ("sale_lines", "amount", "sale_id")]


def op11_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "erasure")
    inputs = {}
    for name, _, _ in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        inputs[name] = rows.columns, rows.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_tie"))
    # A sale that repeats is its smallest client's.
    owners = inputs["sales"][1].filter("sale_id is not null").groupBy(F.col("sale_id").alias("_sale")).agg(F.min("client_id").alias("_owner"))
    lines = inputs["sale_lines"][1]
    inputs["sale_lines"] = inputs["sale_lines"][0], lines.join(owners, F.col("sale_id") == F.col("_sale"), "left")
    at = {}
    for name, _, _ in TABLES:
        columns, rows = inputs[name]
        order = id_crc(F.col("_owner" if name == "sale_lines" else "client_id"))
        at[name] = lay_out(rows, columns, order, F.col("_tie"), root, name)
    held = {"clients": holdings(at["clients"], "master_id", victim_masters(at["clients"].read(), at["clicks"].read()))}
    doomed = victims_of(at["clients"], "master_id", held["clients"], "client_id")
    held |= {t: holdings(at[t], "client_id", doomed) for t in ("clicks", "sales")}
    held["sale_lines"] = holdings(at["sale_lines"], "sale_id", victims_of(at["sales"], "client_id", held["sales"], "sale_id"))
    found = None
    for name, money, key in TABLES:
        one = report(at[name], money, erase(at[name], key, held[name]))
        found = one if found is None else found.unionByName(one)
    return found
