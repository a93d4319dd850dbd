"""A function of one record at a time over a table, with a time limit a record and a table of failures."""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tessella.sources.scratch import ship, written


class OutOfTime(Exception):
    """The record's limit is over."""


def limited(function: Callable, record: dict, seconds: float):
    """``function(record)``, interrupted after ``seconds``; code that holds the interpreter's lock is interrupted when it gives it up."""

    def stop(_signal, _frame):
        raise OutOfTime(f"over {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return function(record)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def fan_out(df: DataFrame, identity: str, function: Callable[[dict], list[dict]], schema: str, seconds: float = 60.0, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): what ``function`` makes of each record, and the records it does not finish.

    ``function`` takes a record as a dictionary (of ``columns``, else all) and returns
    a list of dictionaries of ``schema``; rows are those with the identity before them.
    A record that raises or is over its limit has no row; failures have the identity,
    the kind of error, its message and the seconds spent. Both come from one pass that
    is written once, so no record is tried twice. A record may fail, the job does not.
    """
    ship(df.sparkSession)
    asked = df.select(identity, *[c for c in columns or df.columns if c != identity])
    kind = df.schema[identity].dataType.simpleString()
    fields: StructType = _parse_datatype_string(schema)
    made = f"id {kind}, made array<{fields.simpleString()}>, error string, message string, seconds double"
    names = fields.fieldNames()
    target = to_arrow_schema(_parse_datatype_string(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in target.names}
            for record in batch.to_pylist():
                began, rows, error, message = time.perf_counter(), None, None, None
                try:
                    rows = [{n: r.get(n) for n in names} for r in limited(function, record, seconds)]
                except OutOfTime as e:
                    error, message = "OutOfTime", str(e)
                except Exception as e:  # what a record raises is its failure, not the job's
                    error, message = type(e).__name__, str(e)[:500]
                for n, v in zip(target.names, (record[identity], rows, error, message, time.perf_counter() - began)):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, target)

    table = written(asked.mapInArrow(run, made), "fan-out")
    rows = table.filter("error is null").select(F.col("id").alias(identity), F.explode("made").alias("_r")).select(identity, "_r.*")
    failures = table.filter("error is not null").select(F.col("id").alias(identity), "error", "message", "seconds")
    return rows, failures
