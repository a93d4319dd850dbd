"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, for functions that run there, whatever their working folder."""
    if spark.sparkContext.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    at = Path(tempfile.mkdtemp(prefix="tessella-library-")) / f"tessella_library_{os.getpid()}.zip"
    at.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(at))
    _SENT.add(spark.sparkContext.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and one machine does all (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            _OWN[key] = tempfile.mkdtemp(prefix="tessella-")
        at = _OWN[key]
    return at.rstrip("/")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once (with the writer's options) as a table in the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessella/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
