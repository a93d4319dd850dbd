"""Archives, blobs and text formats: each file or slice becomes rows on the executors."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def opened(uri: str):
    """A seekable file on the file system that its URI names, wherever the task runs."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.replace("file:", "file://", 1)
    system, at = fs.FileSystem.from_uri("s3" + uri[3:] if uri[:6] in ("s3a://", "s3n://") else uri)
    return system.open_input_file(at)


def archive_members(spark: SparkSession, path: str, pattern: str = ".*", skip: int = 0, take: int | None = None) -> DataFrame:
    """(path, member, data) of tar, tar.gz and zip files; per archive, members matching the pattern after ``skip``, at most ``take``.

    Spark lists the archives; a task opens its own and reads them member by member, so
    that one member is held at a time and reading ends with the last one asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = re.compile(pattern)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as f:
                    for n, (member, data) in enumerate(_members(f, want)):
                        if take is not None and n >= skip + take:
                            break
                        if n >= skip:
                            yield pa.record_batch([pa.array([name]), pa.array([member]), pa.array([data()], pa.binary())], ["path", "member", "data"])

    # Only names leave the listing: the content column is pruned.
    listed = spark.read.format("binaryFile").load(path).select("path")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(n).mapInArrow(run, "path string, member string, data binary")


def _members(f, want: re.Pattern) -> Iterator[tuple[str, Callable[[], bytes]]]:
    """(name, reader) of each member that matches; the reader must be used before the next."""
    head = f.read(4)
    f.seek(0)
    if head[:2] == b"PK":
        with zipfile.ZipFile(f) as z:
            for info in z.infolist():
                if not info.is_dir() and want.fullmatch(info.filename):
                    yield info.filename, partial(z.read, info)
        return
    with tarfile.open(fileobj=f, mode="r|*") as t:
        for m in t:
            if m.isfile() and want.fullmatch(m.name):
                yield m.name, t.extractfile(m).read


def blob_slices(index: DataFrame, path: str, identity: str, offset: str, length: str) -> DataFrame:
    """(identity, data): slices of one file named by offset and length, zlib unpacked where they are packed.

    The file is opened through the shared file system of the URI; slices are read in
    order of offset within a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as f:
            for batch in batches:
                out = []
                for a, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    f.seek(a)
                    raw = f.read(n)
                    try:
                        out.append(zlib.decompress(raw))
                    except zlib.error:
                        out.append(raw)
                yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], [identity, "data"])

    kind = index.schema[identity].dataType.simpleString()
    return index.select(identity, offset, length).sortWithinPartitions(offset).mapInArrow(run, f"{identity} {kind}, data binary")


class _FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ExtendedXyz(DataSource):
    """Frames of extended XYZ text: path, frame, atoms, comment, species array<string>, positions array<double>.

    Files are read line by line; a frame at a time is held. Options: ``path`` (files,
    comma-separated), ``elements`` (only frames of these elements), ``max_atoms``.
    """

    @classmethod
    def name(cls) -> str:
        return "extxyz"

    def schema(self) -> str:
        return "path string, frame long, atoms int, comment string, species array<string>, positions array<double>"

    def reader(self, schema):
        return _XyzReader(dict(self.options))


class _XyzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_FilePart(p.strip()) for p in self.options["path"].split(",") if p.strip()]

    def read(self, part):
        allowed = {x for x in self.options.get("elements", "").split(",") if x}
        most = int(self.options.get("max_atoms", 1 << 30))
        with opened(part.path) as raw:
            f = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else raw, encoding="utf-8")
            frame = 0
            while head := f.readline():
                if not head.strip():
                    continue
                n = int(head)
                comment = f.readline().rstrip("\n")
                rows = [f.readline().split() for _ in range(n)]
                species = [r[0] for r in rows]
                if n <= most and (not allowed or set(species) <= allowed):
                    yield part.path, frame, n, comment, species, [float(x) for r in rows for x in r[1:4]]
                frame += 1


def sqlite_copy(uri: str):
    """A connection to a database read whole from its URI, so that a task needs no file of its own machine."""
    import sqlite3

    with opened(uri) as f:
        raw = f.read()
    c = sqlite3.connect(":memory:")
    c.deserialize(raw)
    return c


def sqlite_lookup(keys: DataFrame, key: str, path: str, table: str, columns: dict[str, str], batch: int = 500) -> DataFrame:
    """(key, columns) of the rows of a SQLite table whose key is among those given, ``batch`` keys a statement.

    ``columns`` names the other columns with their Spark types. Keys are looked up once
    each; one without a row has none.
    """
    quoted = ", ".join(f'"{c}"' for c in [key, *columns])
    kind = keys.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = None
        for pdf in batches:
            c = c or sqlite_copy(path)
            for a in range(0, len(pdf), batch):
                some = [x.item() if hasattr(x, "item") else x for x in pdf[key].iloc[a : a + batch]]
                marks = ", ".join("?" * len(some))
                yield pd.DataFrame(c.execute(f'SELECT {quoted} FROM "{table}" WHERE "{key}" IN ({marks})', some).fetchall(), columns=[key, *columns])

    schema = ", ".join(f"`{n}` {t}" for n, t in {key: kind, **columns}.items())
    return keys.select(key).filter(F.col(key).isNotNull()).distinct().mapInPandas(run, schema)


class SqliteTable(DataSource):
    """A SQLite query in ranges of an integer key. Options: path, query, key, least, most, parts; the schema is given.

    The database is read from the file system of its path; it must fit a task's memory.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give the schema: spark.read.format('sqlite').schema(...)")

    def reader(self, schema):
        return _SqliteReader(dict(self.options), schema.names)


class _Range(InputPartition):
    def __init__(self, a: int, b: int):
        self.a, self.b = a, b


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def partitions(self):
        a, b, n = (int(self.options[k]) for k in ("least", "most", "parts"))
        edges = [a + (b + 1 - a) * i // n for i in range(n + 1)]
        return [_Range(x, y) for x, y in zip(edges, edges[1:]) if x < y]

    def read(self, part):
        key, c = self.options["key"], sqlite_copy(self.options["path"])
        names = ", ".join(f'"{n}"' for n in self.names)
        yield from c.execute(f'SELECT {names} FROM ({self.options["query"]}) WHERE "{key}" >= ? AND "{key}" < ?', (part.a, part.b))
        c.close()


def poscar(df: DataFrame, text: str) -> DataFrame:
    """Title, scale, volume, elements and counts of structure files held as text, by native expressions."""
    line = F.split(F.col(text), "\r?\n")
    numbers = lambda i: F.transform(F.split(F.trim(F.get(line, F.lit(i))), r"\s+"), lambda x: x.cast("double"))
    a, b, c = numbers(2), numbers(3), numbers(4)
    det = (
        a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    )
    scale = F.trim(F.get(line, F.lit(1))).cast("double")
    words = lambda i: F.split(F.trim(F.get(line, F.lit(i))), r"\s+")
    return df.withColumns(
        {
            "title": F.trim(F.get(line, F.lit(0))),
            "scale": scale,
            # A negative scale states the volume itself.
            "volume": F.when(scale < 0, -scale).otherwise(F.abs(det) * scale * scale * scale),
            "elements": words(5),
            "counts": F.transform(words(6), lambda x: x.cast("int")),
        }
    )


def key_equals_value(df: DataFrame, text: str) -> DataFrame:
    """(columns, key, value) of KEY = VALUE settings; comments after # or ! go, the last of a key wins."""
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, F.posexplode(F.split(F.col(text), "[\r\n;]+")).alias("_at", "_l"))
    bare = F.regexp_replace("_l", "[#!].*$", "")
    got = lines.select(*rest, "_at", F.upper(F.trim(F.regexp_extract(bare, r"^([^=]+)=(.*)$", 1))).alias("key"), F.trim(F.regexp_extract(bare, r"^([^=]+)=(.*)$", 2)).alias("value"))
    return got.filter("key <> ''").groupBy(*rest, "key").agg(F.max_by("value", "_at").alias("value"))


def run_log(df: DataFrame, text: str) -> DataFrame:
    """First and last energy, ionic steps, end mark and last largest force of a calculation's log text.

    Patterns are fixed phrases of that log format.
    """
    energy = F.regexp_extract_all(F.col(text), F.lit(r"energy\s+without entropy\s*=\s*(-?[0-9.]+)"), F.lit(1))
    force = F.regexp_extract_all(F.col(text), F.lit(r"FORCES: max atom, RMS\s+([0-9.]+)"), F.lit(1))
    last = lambda a: F.try_element_at(a, F.lit(-1)).cast("double")
    return df.withColumns(
        {
            "first_energy": F.get(energy, F.lit(0)).cast("double"),
            "last_energy": last(energy),
            "steps": F.size(energy),
            "max_force": last(force),
            "converged": F.contains(F.col(text), F.lit("reached required accuracy")),
            "finished": F.contains(F.col(text), F.lit("General timing and accounting")),
        }
    )
