"""Neighbours within a radius, damaged structures, and per-group numeric fits."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import ship


def radius_join(points: DataFrame, group: str, identity: str, xyz: tuple[str, str, str], cutoff: float) -> DataFrame:
    """(group, i, j, distance) of i < j within the cutoff: an equi-join on grid cells of that size.

    Each point meets only the 27 cells about its own, so a dense group costs as many
    comparisons as it has near pairs.
    """
    # A little wider than the cutoff, as a quotient's rounding may move a point to the next cell.
    cell = [F.floor(F.col(c) / (cutoff * (1 + 1e-9))).cast("long") for c in xyz]
    names = ["_cx", "_cy", "_cz"]
    left = points.select(group, F.col(identity).alias("i"), *[F.col(c).alias(f"_l{k}") for k, c in enumerate(xyz)], *[c.alias(n) for c, n in zip(cell, names)])
    steps = F.array(*[F.struct(*[F.lit(s).alias(n) for s, n in zip(d, "xyz")]) for d in itertools.product((-1, 0, 1), repeat=3)])
    right = points.select(group, F.col(identity).alias("j"), *[F.col(c).alias(f"_r{k}") for k, c in enumerate(xyz)], *[c.alias(n) for c, n in zip(cell, names)], F.explode(steps).alias("_s"))
    right = right.select(group, "j", "_r0", "_r1", "_r2", *[(F.col(n) + F.col(f"_s.{a}")).alias(n) for n, a in zip(names, "xyz")])
    d2 = sum((F.col(f"_l{k}") - F.col(f"_r{k}")) * (F.col(f"_l{k}") - F.col(f"_r{k}")) for k in range(3))
    near = left.join(right, [group, *names]).filter(F.col("i") < F.col("j")).withColumn("distance", F.sqrt(d2))
    return near.filter(F.col("distance") < cutoff).select(group, "i", "j", "distance")


SPAN = 16_384  # points of a slab whose neighbours one task looks for
CHUNK = 1 << 17  # distances held at once


def _distances(cutoff: float):
    """(group, n, total, least) of the pairs within the cutoff of which one point is asked for and the other lies not before it.

    Points are ordered by columns of half the cutoff's width in x and y, in a column by
    z; a few points meet the stretches of the 13 columns at and after theirs that their z reaches.
    """
    wide = cutoff * (1 + 1e-9)
    limit = cutoff * cutoff  # the least square whose root is not under the cutoff
    while np.sqrt(limit) >= cutoff:
        limit = np.nextafter(limit, 0.0)
    while np.sqrt(limit) < cutoff:
        limit = np.nextafter(limit, np.inf)

    def run(table: pa.Table) -> pa.Table:
        cx, cy, i, x, y, z, own = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cx", "cy", "i", "x", "y", "z", "own"))
        order = np.lexsort((i, y, x, z, cy, cx))
        cx, cy, i, x, y, z, own = (v[order] for v in (cx, cy, i, x, y, z, own))
        new = np.flatnonzero(np.append(True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])))
        ends = np.append(new[1:], len(cx))
        columns = {(int(cx[a]), int(cy[a])): (int(a), int(b)) for a, b in zip(new, ends)}
        again = len(np.unique(i)) < len(i)
        n, totals, least = 0, [], np.inf
        for (c, d), (a, b) in columns.items():
            asked = a + np.flatnonzero(own[a:b])
            if not len(asked):
                continue
            near = [columns[k] for k in [(c, d + 1), (c, d + 2), *[(c + u, d + v) for u in (1, 2) for v in range(-2, 3)]] if k in columns]
            size = max(1, min(64, CHUNK // max(1, b - a)))
            for at in range(0, len(asked), size):
                left = asked[at : at + size]
                low, high = z[left[0]] - wide, z[left[-1]] + wide
                # In the own column only what comes later, so that a pair is met once.
                first = max(a, int(left[0]))
                stretches = [(first, first + int(np.searchsorted(z[first:b], high, "right")))]
                stretches += [(s + int(np.searchsorted(z[s:e], low)), s + int(np.searchsorted(z[s:e], high, "right"))) for s, e in near]
                right = np.concatenate([np.arange(s, e) for s, e in stretches])
                step = max(1, CHUNK // len(left))
                for r in range(0, len(right), step):
                    some = right[r : r + step]
                    d2, other = x[left][:, None] - x[some], y[left][:, None] - y[some]
                    d2 *= d2
                    other *= other
                    d2 += other
                    np.subtract(z[left][:, None], z[some], out=other)
                    other *= other
                    d2 += other
                    ok = d2 < limit
                    if some[0] < b and some[0] >= a:
                        ok &= some > left[:, None]
                    if again:
                        ok &= i[some] != i[left][:, None]
                    found = np.sqrt(d2[ok])
                    if len(found):
                        n += len(found)
                        totals.append(float(found.sum()))
                        least = min(least, float(found.min()))
        rows = 1 if n else 0
        return pa.table([table.column(0).slice(0, rows), pa.array([n] * rows, pa.int64()), pa.array([math.fsum(totals)] * rows, pa.float64()), pa.array([least] * rows, pa.float64())], [table.column_names[0], "n", "total", "least"])

    return run


def radius_totals(points: DataFrame, group: str, identity: str, xyz: tuple[str, str, str], cutoff: float) -> DataFrame:
    """(group, n, total, least): number, sum and least of the distances that ``radius_join`` would list; no pair is a row.

    Space is dealt in slabs as wide as the cutoff; a task has the points of a slab (some
    of them, where it holds more than ``SPAN``) and of the next. Near pairs are all
    looked at, in pieces of bounded size, so that time grows with them and memory does not.
    """
    ship(points.sparkSession)
    half = cutoff * (1 + 1e-9) / 2
    key = F.col(identity)
    if points.schema[identity].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        key = F.xxhash64(identity)
    d = points.dropna(subset=[group, identity, *xyz])
    d = d.select(group, key.cast("long").alias("i"), *[F.col(c).cast("double").alias(k) for c, k in zip(xyz, "xyz")])
    d = d.withColumns({f"c{k}": F.floor(F.col(k) / half).cast("long") for k in "xy"}).withColumn("slab", F.floor(F.col("cx") / 2))
    parts = d.groupBy(group, "slab").agg(F.ceil(F.count("*") / SPAN).cast("int").alias("parts"))
    met = d.withColumn("slab", F.explode(F.array("slab", F.col("slab") - 1))).join(parts, [group, "slab"])
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = (F.floor(F.col("cx") / 2) == F.col("slab")) & (F.pmod(F.xxhash64("i", "x", "y", "z"), F.col("parts")) == F.col("part"))
    met = met.select(group, "slab", "part", "cx", "cy", "i", "x", "y", "z", own.alias("own"))
    kind = points.schema[group].dataType.simpleString()
    found = met.groupBy(group, "slab", "part").applyInArrow(_distances(cutoff), f"`{group}` {kind}, n long, total double, least double")
    return found.groupBy(group).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"))


KINDS = ("S1", "S2", "S3", "S4", "S5")
#: Ranges of the damage, and the least difference of swapped cations' charges.
COMPRESSION, EXPANSION, DEVIATION, CHARGE_STEP = (0.15, 0.30), (0.20, 0.40), (0.3, 0.8), 1.0


def _swap(rng: np.random.Generator, species: np.ndarray, charges: np.ndarray, first: np.ndarray, second: np.ndarray, allowed: np.ndarray):
    """Species and charges with one allowed pair of sites exchanged; None if there is none."""
    i, j = np.nonzero(allowed)
    if not len(i):
        return None
    k = int(rng.integers(len(i)))
    order = np.arange(len(species))
    order[[first[i[k]], second[j[k]]]] = second[j[k]], first[i[k]]
    return species[order], charges[order]


def _damaged(kind: str, rng: np.random.Generator, species: np.ndarray, charges: np.ndarray, lattice: np.ndarray, at: np.ndarray):
    """(species, charges, lattice, fractional positions) of one version, None where it can't be made."""
    cations, anions = np.flatnonzero(charges > 0), np.flatnonzero(charges < 0)
    if kind == "S1":
        scale = np.ones((3, 1))
        scale[rng.integers(3)] -= rng.uniform(*COMPRESSION)
        return species, charges, lattice * scale, at
    if kind == "S4":
        return species, charges, lattice * (1 + rng.uniform(*EXPANSION)), at
    if kind == "S3":
        moved = rng.normal(0, rng.uniform(*DEVIATION), at.shape)
        return (species, charges, lattice, at + moved @ np.linalg.inv(lattice)) if abs(np.linalg.det(lattice)) > 1e-9 else None
    if kind == "S2":
        q = charges[cations]
        unlike = (species[cations][:, None] != species[cations][None, :]) & (np.abs(q[:, None] - q[None, :]) >= CHARGE_STEP)
        got = _swap(rng, species, charges, cations, cations, np.triu(unlike))
    else:
        got = _swap(rng, species, charges, cations, anions, np.ones((len(cations), len(anions)), bool))
    return None if got is None else (*got, lattice, at)


def damage(structures: DataFrame) -> DataFrame:
    """Up to five damaged versions of each structure (id, species array, charges array, lattice array of 9 in Angstrom,
    positions array of fractional coordinates), with the charges of the sites.

    S1 compression of one lattice vector, S2 exchange of two cations of unlike element
    and charge, S3 displacement of every site, S4 expansion of the whole lattice, S5
    exchange of a cation and an anion. Charges travel with their elements: without that
    an exchange would leave the electrostatics as they are. Randomness is seeded by
    crc32 of id and kind, so a row's versions are the same wherever they are made. A
    version that needs sites that are not there is left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                given = np.array(list(r.species), object), np.asarray(r.charges, float)
                shape = np.asarray(r.lattice, float).reshape(3, 3), np.asarray(r.positions, float).reshape(-1, 3)
                for kind in KINDS:
                    got = _damaged(kind, np.random.default_rng(zlib.crc32(f"{r.id}|{kind}".encode())), *given, *shape)
                    if got is not None:
                        out.append((f"{r.id}:{kind}", r.id, kind, list(got[0]), *[x.ravel().tolist() for x in got[1:]]))
            yield pd.DataFrame(out, columns=["sid", "parent", "kind", "species", "charges", "lattice", "positions"])

    schema = "sid string, parent string, kind string, species array<string>, charges array<double>, lattice array<double>, positions array<double>"
    return structures.select("id", "species", "charges", "lattice", "positions").mapInPandas(run, schema)


def equation_of_state(df: DataFrame, group: str, volume: str, energy: str) -> DataFrame:
    """(group, points, v0, e0, b0, b0_prime) of the third-order Birch-Murnaghan form, groups of four points or more.

    In x = V^(-2/3) that form is a cubic polynomial, so the fit is linear and its
    minimum gives all four numbers; a fit without a minimum in range has NULLs.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key, pdf = pdf[group].iloc[0], pdf.dropna(subset=[volume, energy])
        row = {group: key, "points": len(pdf), "v0": None, "e0": None, "b0": None, "b0_prime": None}
        if pdf[volume].nunique() >= 4:
            x, e = pdf[volume].to_numpy() ** (-2 / 3), pdf[energy].to_numpy()
            centre, scale = x.mean(), x.std()
            p = np.poly1d(np.polyfit((x - centre) / scale, e, 3))
            u = [r.real for r in p.deriv().roots if abs(r.imag) < 1e-9 and p.deriv(2)(r.real) > 0]
            u = [z for z in u if centre + scale * z > 0 and (x.min() - x.std()) <= centre + scale * z <= x.max() + x.std()]
            if u:
                z = u[0]
                x0 = centre + scale * z
                d2, d3 = p.deriv(2)(z) / scale**2, p.deriv(3)(z) / scale**3
                v0 = x0**-1.5
                b0 = 4 / 9 * x0**3.5 * d2
                row |= {"v0": v0, "e0": float(p(z)), "b0": b0, "b0_prime": 4 + 2 / 3 * x0 * d3 / d2}
        return pd.DataFrame([row])

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(fit, f"{group} {kind}, points int, v0 double, e0 double, b0 double, b0_prime double")


def _monotone_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the shape-preserving cubic through the points (weighted harmonic means inside)."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        return np.array([d[0], d[0]])
    same = d[:-1] * d[1:] > 0
    a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    m[1:-1][same] = ((a + b)[same]) / (a[same] / d[:-1][same] + b[same] / d[1:][same])
    for i, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        m[i] = 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s
    return m


def curve_crossings(df: DataFrame, group: str, x: str, y: str, level: float) -> DataFrame:
    """(group, points, crossing): the last abscissa at which the shape-preserving curve passes the level; NULL if none."""

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[group].iloc[0]
        pdf = pdf.dropna(subset=[x, y]).drop_duplicates(subset=[x]).sort_values(x)
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        found = None
        if len(a) >= 2:
            m = _monotone_slopes(a, b)
            for i in range(len(a) - 2, -1, -1):
                h = a[i + 1] - a[i]
                # Hermite form on t in 0..1, minus the level
                c = [2 * b[i] + h * m[i] - 2 * b[i + 1] + h * m[i + 1], -3 * b[i] - 2 * h * m[i] + 3 * b[i + 1] - h * m[i + 1], h * m[i], b[i] - level]
                t = [r.real for r in np.roots(np.trim_zeros(c, "f") or [1.0]) if abs(r.imag) < 1e-9 and -1e-12 <= r.real <= 1 + 1e-12] if any(c[:3]) else []
                if t:
                    found = a[i] + h * max(t)
                    break
        return pd.DataFrame([{group: key, "points": len(a), "crossing": found}])

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(last, f"{group} {kind}, points int, crossing double")


def network_strengths(edges: DataFrame, structure: str) -> DataFrame:
    """Bond strengths of each structure's network (structure, cation, anion, ox_cation, ox_anion), by least squares of minimum norm.

    At each site the strengths add up to its charge's size. Columns: strength per
    edge, and per structure the rank and the largest residual.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sites = {("c", k): abs(v) for k, v in zip(pdf["cation"], pdf["ox_cation"])} | {("a", k): abs(v) for k, v in zip(pdf["anion"], pdf["ox_anion"])}
        number = {k: i for i, k in enumerate(sites)}
        a = np.zeros((len(sites), len(pdf)))
        for e, (c, x) in enumerate(zip(pdf["cation"], pdf["anion"])):
            a[number[("c", c)], e] += 1
            a[number[("a", x)], e] += 1
        b = np.array(list(sites.values()), float)
        s, _, rank, _ = np.linalg.lstsq(a, b, rcond=None)
        return pd.DataFrame(
            {structure: pdf[structure], "cation": pdf["cation"], "anion": pdf["anion"], "strength": s, "rank": int(rank), "residual": float(np.abs(a @ s - b).max())}
        )

    f = edges.schema
    schema = f"{structure} {f[structure].dataType.simpleString()}, cation {f['cation'].dataType.simpleString()}, anion {f['anion'].dataType.simpleString()}, strength double, rank int, residual double"
    return edges.groupBy(structure).applyInPandas(solve, schema)


def charge_balance(compositions: DataFrame, identity: str, elements: str, counts: str, valences: dict[str, list[int]]) -> DataFrame:
    """(identity, balanced, assignment): the first choice of one valence an element that adds up to zero, in listed order.

    Element by element the charge totals that can be reached are kept, each with the
    first choice that reaches it, so that work grows with the totals and not with the
    number of choices. An element without valences is never balanced.
    """
    table = F.create_map(*[F.lit(x) for k, v in valences.items() for x in (k, F.array(*[F.lit(int(z)) for z in v]))]) if valences else None
    known = lambda e: F.coalesce(F.try_element_at(table, e), F.array().cast("array<int>")) if valences else F.array().cast("array<int>")
    kind = "array<struct<total:bigint,chosen:array<string>>>"
    named = lambda e, z: F.concat(e, F.when(z >= 0, F.lit("+")).otherwise(F.lit("")), z.cast("string"))

    def step(reached: Column, x: Column) -> Column:
        grown = F.flatten(
            F.transform(
                reached,
                lambda r: F.transform(
                    known(x["e"]),
                    lambda z: F.struct((r["total"] + z * x["n"]).alias("total"), F.concat(r["chosen"], F.array(named(x["e"], z))).alias("chosen")),
                ),
            )
        )
        totals = F.transform(grown, lambda g: g["total"])
        # In listed order, so the first of a total is its first choice.
        return F.filter(grown, lambda g, i: F.array_position(totals, g["total"]) == i + 1)

    pairs = F.zip_with(elements, counts, lambda e, n: F.struct(e.alias("e"), n.cast("long").alias("n")))
    start = F.array(F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("chosen"))).cast(kind)
    reached = F.aggregate(pairs, start, lambda r, x: step(r, x).cast(kind))
    hit = F.get(F.filter(reached, lambda r: r["total"] == 0), F.lit(0))["chosen"]
    hit = F.when(F.size(F.col(elements)) > 0, hit)
    return compositions.select(identity, F.coalesce(hit.isNotNull(), F.lit(False)).alias("balanced"), F.array_join(hit, ",").alias("assignment"))


def mean_valences(elements: Column, counts: Column, anions: dict[str, int], fixed: dict[str, int], most: float = 8.0) -> Column:
    """map of element to its mean valence where no whole-number choice is asked for, NULL where it isn't determined.

    Elements of ``anions`` and ``fixed`` take those charges; a lone kind of cation, or
    the one kind that is in neither, takes what is left by its count. With several such
    kinds, or a charge outside (0, most] for one beside fixed cations, there is none.
    """
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, float(v))])
    pairs = F.zip_with(elements, counts, lambda e, n: F.struct(e.alias("e"), n.cast("double").alias("n")))
    negative, common = (lambda e: F.try_element_at(table(anions), e)), (lambda e: F.try_element_at(table(fixed), e))
    cations = F.filter(pairs, lambda x: negative(x["e"]).isNull())
    variable = F.filter(cations, lambda x: common(x["e"]).isNull())
    total = lambda xs, charge: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(charge(x["e"]), F.lit(0.0)) * x["n"])
    left = -total(pairs, negative)
    alone = left / F.get(cations, F.lit(0))["n"]
    share = (left - total(cations, common)) / F.get(variable, F.lit(0))["n"]
    one = F.size(cations) == 1
    ok = (F.size(cations) > 0) & (F.size(pairs) > F.size(cations)) & (one | ((F.size(variable) == 1) & (share > 0) & (share <= most)))
    value = lambda x: F.coalesce(negative(x["e"]), F.when(one, alone), common(x["e"]), share)
    return F.when(ok, F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["e"], value(x)))))
