"""The folder that all executors and the driver share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whatever their path or working folder, once an application."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    at = Path(tempfile.mkdtemp(prefix="tessella-ship-")) / f"tessella_{os.getpid()}.zip"
    at.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and one machine does all (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        at = _OWN.setdefault(key, "") or _OWN.update({key: tempfile.mkdtemp(prefix="tessella-")}) or _OWN[key]
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessella/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, what runs hands Python at most ``most`` rows at once: a batch is there on both sides, with its copies."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unique_names(taken: list[str], wanted: list[str]) -> list[str]:
    """``wanted``, each with as many underscores after it as keep it apart from ``taken``, whatever the case of letters."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def in_struct(docs: DataFrame):
    """All columns of ``docs`` as one, so that their names meet no others: a column ``row`` to select and ``row.*`` to return."""
    from pyspark.sql import functions as F

    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or path in the shared folder; works on executors."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.replace("file:", "file://", 1) if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri("s3" + uri[3:] if uri[:6] in ("s3a://", "s3n://") else uri)


def write_once(uri: str, parts: list[bytes]) -> None:
    """Write a file so that a repeated or lost task leaves either nothing or the whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        for x in parts:
            out.write(x)
    fs.move(own, path)


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()
