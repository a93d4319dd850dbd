"""Deterministic splits and folds from hashes of identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(identity: Column | str, seed: str) -> Column:
    """sha256("seed:id"), its first 8 bytes as a fraction of 2^64."""
    c = F.col(identity) if isinstance(identity, str) else identity
    h = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256), 1, 16)
    return F.conv(h, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def split3(identity: Column | str, seed: str, discovery: float = 0.60, calibration: float = 0.25) -> Column:
    """discovery / calibration / lockbox by shares of the hash space."""
    u = unit_hash(identity, seed)
    return F.when(u < discovery, "discovery").when(u < discovery + calibration, "calibration").otherwise("lockbox")


def nested(identity: Column | str, outer: str, inner: str, test: float = 0.2, validation: float = 0.25) -> Column:
    """test, and of the rest validation and train by a second salt."""
    return F.when(unit_hash(identity, outer) < test, "test").when(unit_hash(identity, inner) < validation, "validation").otherwise("train")


def crc_fold(identity: Column | str, folds: int) -> Column:
    c = F.col(identity) if isinstance(identity, str) else identity
    return (F.crc32(c.cast("string")).bitwiseAND(0x7FFFFFFF) % folds).cast("int")


def sha_fold(identity: Column | str, folds: int, seed: str = "") -> Column:
    c = F.col(identity) if isinstance(identity, str) else identity
    h = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256), 1, 15)
    return (F.conv(h, 16, 10).cast("bigint") % folds).cast("int")


def balanced_group_folds(sizes: dict, folds: int) -> dict:
    """Groups (the driver's small table of sizes) to folds: largest first, each to the lightest fold."""
    load, out = [0] * folds, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], str(x[0]))):
        k = min(range(folds), key=lambda i: (load[i], i))
        out[g] = k
        load[k] += n
    return out
