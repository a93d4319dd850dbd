"""Rules on streams: verdicts keep no state; the last row of a key keeps one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.rules import Rule, failed_names, set_verdict


def with_verdicts(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with set_verdict and failed; the same plan for a table and a stream."""
    return stream.withColumns({"set_verdict": set_verdict(rules), "failed": F.array_join(failed_names(rules), ",")})


def verdict_counts(stream: DataFrame, rules: list[Rule], time: str, window: str, lateness: str) -> DataFrame:
    """Verdicts per event-time window; late rows beyond ``lateness`` are left out and state is dropped."""
    v = with_verdicts(stream, rules)
    if stream.isStreaming:
        v = v.withWatermark(time, lateness)
    return v.groupBy(F.window(time, window), "set_verdict").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "set_verdict", "n")


def last_frames(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key so far (complete or update output mode)."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
