"""Neighbours in periodic lattices, what coordination polyhedra share, and electrostatic sums.

Structures are (id, lattice) with the lattice's vectors as rows; sites are (id, site,
x, y, z) with fractional coordinates, which are wrapped into the cell. A lattice's
heights say how many images a radius reaches, however skew it is. Everything is joins
and sums keyed by structure and cell; no structure is one task's work, but in
``ewald`` a small one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import ship, written


def _v(lattice: Column, i: int, j: int) -> Column:
    return F.get(F.get(lattice, F.lit(i)), F.lit(j))


def _cross(lattice: Column, i: int) -> list[Column]:
    """The cross product of the two other vectors, in order, so that its product with vector i is the volume."""
    a, b = (i + 1) % 3, (i + 2) % 3
    return [_v(lattice, a, (k + 1) % 3) * _v(lattice, b, (k + 2) % 3) - _v(lattice, a, (k + 2) % 3) * _v(lattice, b, (k + 1) % 3) for k in range(3)]


def volume(lattice: Column) -> Column:
    return F.abs(sum((_v(lattice, 0, k) * c for k, c in enumerate(_cross(lattice, 0))), F.lit(0.0)))


def heights(lattice: Column) -> list[Column]:
    """Distance of the cell's opposite faces, for each vector."""
    return [volume(lattice) / F.sqrt(sum((c * c for c in _cross(lattice, i)), F.lit(0.0))) for i in range(3)]


def neighbours(structures: DataFrame, sites: DataFrame, radius: float, most_cells: int = 16) -> DataFrame:
    """(id, i, j, tx, ty, tz, distance): site j moved by the lattice's t lies within ``radius`` of site i; both directions.

    Sites are dealt in cells of their structure at least about as wide as the radius;
    a site asks the cells around its own, those beyond the border with the translation
    that brings them there. A site is no neighbour of itself but of its images. A
    structure without volume, or a site without a coordinate, has no neighbours.
    """
    h = heights(F.col("lattice"))
    cells = [F.greatest(F.lit(1), F.least(F.lit(most_cells), F.floor(x / radius))).cast("int") for x in h]
    shaped = structures.filter(volume(F.col("lattice")) > 0).select("id", "lattice", *[c.alias(f"m{k}") for k, c in zip("xyz", cells)], *[x.alias(f"h{k}") for k, x in zip("xyz", h)])
    wrapped = [(F.col(k) - F.floor(F.col(k))).alias(k) for k in "xyz"]
    rows = sites.dropna(subset=["id", "site", "x", "y", "z"]).select("id", "site", *wrapped).join(shaped, "id")
    own = {k: F.least(F.floor(F.col(k) * F.col(f"m{k}")).cast("int"), F.col(f"m{k}") - 1) for k in "xyz"}
    placed = rows.withColumns({f"c{k}": v for k, v in own.items()})
    reach = lambda k: F.ceil(F.lit(radius) * F.col(f"m{k}") / F.col(f"h{k}")).cast("int")
    asking = placed
    for k in "xyz":
        asking = asking.withColumn("_o", F.explode(F.sequence(F.col(f"c{k}") - reach(k), F.col(f"c{k}") + reach(k))))
        asking = asking.withColumns({f"a{k}": F.pmod(F.col("_o"), F.col(f"m{k}")), f"t{k}": F.floor(F.col("_o") / F.col(f"m{k}")).cast("int")}).drop("_o")
    left = asking.select("id", F.col("site").alias("i"), *[F.col(k).alias(f"{k}i") for k in "xyz"], *[f"t{k}" for k in "xyz"], *[F.col(f"a{k}").alias(f"c{k}") for k in "xyz"], "lattice")
    right = placed.select("id", F.col("site").alias("j"), *[F.col(k).alias(f"{k}j") for k in "xyz"], *[f"c{k}" for k in "xyz"])
    met = left.join(right, ["id", "cx", "cy", "cz"])
    d = [F.col(f"{k}j") + F.col(f"t{k}") - F.col(f"{k}i") for k in "xyz"]
    xyz = [sum((d[r] * _v(F.col("lattice"), r, k) for r in range(3)), F.lit(0.0)) for k in range(3)]
    met = met.withColumn("distance", F.sqrt(sum((c * c for c in xyz), F.lit(0.0))))
    itself = (F.col("i") == F.col("j")) & (F.col("tx") == 0) & (F.col("ty") == 0) & (F.col("tz") == 0)
    return met.filter((F.col("distance") <= radius) & ~itself).select("id", "i", "j", "tx", "ty", "tz", "distance")


def shared_anions(bonds: DataFrame) -> DataFrame:
    """(id, i, j, tx, ty, tz, shared, kind): cations i and j (moved by t) bound to common anions: corner, edge (2) or face (3 or more).

    ``bonds`` (id, i, j, tx, ty, tz) go from cation i to anion j moved by t. Each pair
    of polyhedra is there once: the first cation is the smaller, of one cation's own
    images the translation that comes first is positive.
    """
    one = bonds.select("id", F.col("j").alias("anion"), F.col("i").alias("c"), *[F.col(f"t{k}").alias(f"s{k}") for k in "xyz"])
    two = bonds.select("id", F.col("j").alias("anion"), F.col("i").alias("d"), *[F.col(f"t{k}").alias(f"u{k}") for k in "xyz"])
    met = one.join(two, ["id", "anion"])
    # Anion j at s from c and at u from d: d lies at s - u from c.
    met = met.select("id", F.col("c").alias("i"), F.col("d").alias("j"), *[(F.col(f"s{k}") - F.col(f"u{k}")).alias(f"t{k}") for k in "xyz"], "anion", *[f"s{k}" for k in "xyz"])
    t = F.struct("tx", "ty", "tz")
    zero = F.struct(*[F.lit(0).alias(f"t{k}") for k in "xyz"])
    met = met.filter((F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (t > zero)))
    out = met.groupBy("id", "i", "j", "tx", "ty", "tz").agg(F.count_distinct("anion", "sx", "sy", "sz").alias("shared"))
    return out.withColumn("kind", F.when(F.col("shared") == 1, "corner").when(F.col("shared") == 2, "edge").otherwise("face"))


def polyhedra(bonds: DataFrame, charges: DataFrame) -> DataFrame:
    """A row a structure: the electrostatic valence rule, what polyhedra share, whether highly charged ones share, and kinds of environments.

    ``charges`` (id, site, charge, species). Each bond has the strength charge / number
    of the cation's bonds; ``worst_deviation`` and ``deviation`` are the largest and the
    mean |sum of strengths at an anion + its charge|. ``edges`` and ``faces`` are shares
    of the pairs of polyhedra that share anything; ``charged_shared`` the share of pairs
    between cations of the structure's highest charge; ``environments`` the most
    numbers of bonds that one cation species has.
    """
    q = charges.select("id", F.col("site"), "charge", "species")
    per = bonds.groupBy("id", "i").agg(F.count("*").alias("bonds"))
    cations = per.join(q.withColumnRenamed("site", "i"), ["id", "i"]).withColumn("strength", F.col("charge") / F.col("bonds"))
    received = bonds.join(cations.select("id", "i", "strength"), ["id", "i"]).groupBy("id", F.col("j").alias("site")).agg(F.sum("strength").alias("s"))
    anions = received.join(q, ["id", "site"]).withColumn("d", F.abs(F.col("s") + F.col("charge")))
    rule2 = anions.groupBy("id").agg(F.max("d").alias("worst_deviation"), F.avg("d").alias("deviation"))
    top = cations.groupBy("id").agg(F.max("charge").alias("top"))
    pairs = shared_anions(bonds)
    ends = [cations.select("id", F.col("i").alias(c), F.col("charge").alias(f"q{c}")) for c in "ij"]
    pairs = pairs.join(ends[0], ["id", "i"]).join(ends[1], ["id", "j"]).join(top, "id")
    share = lambda c: F.avg(c.cast("double"))
    rule34 = pairs.groupBy("id").agg(
        share(F.col("kind") == "edge").alias("edges"),
        share(F.col("kind") == "face").alias("faces"),
        share((F.col("qi") == F.col("top")) & (F.col("qj") == F.col("top"))).alias("charged_shared"),
    )
    kinds = cations.groupBy("id", "species").agg(F.count_distinct("bonds").alias("n")).groupBy("id").agg(F.max("n").alias("environments"))
    return rule2.join(rule34, "id", "left").join(kinds, "id")


def _erfc() -> Column:
    @F.pandas_udf("double")
    def erfc(x: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(math.erfc, x), float, len(x)))

    return erfc


def _ewald_joined(structures: DataFrame, sites: DataFrame, reach: float, split: float | None) -> DataFrame:
    """The sums of ``ewald`` as joins: of neighbours within the cut-off, and of sites with wave vectors, whose structure factors are grouped sums."""
    shaped = structures.filter(volume(F.col("lattice")) > 0)
    size = shaped.agg(F.avg(F.pow(volume(F.col("lattice")), F.lit(1 / 3)))).first()[0]
    alpha = split or math.sqrt(math.pi) / size
    q = sites.select("id", "site", "charge")
    near = neighbours(structures, sites, reach / alpha)
    near = near.join(q.select("id", F.col("site").alias("j"), "charge"), ["id", "j"])
    near = near.withColumn("v", F.col("charge") * _erfc()(F.col("distance") * alpha) / F.col("distance"))
    near = near.groupBy("id", F.col("i").alias("site")).agg(F.sum("v").alias("near"))
    # Wave vectors 2 pi times whole combinations of the reciprocal lattice, up to the cut-off.
    lattice, vol = F.col("lattice"), volume(F.col("lattice"))
    signed = sum((_v(lattice, 0, k) * c for k, c in enumerate(_cross(lattice, 0))), F.lit(0.0))
    most = 2 * alpha * reach
    length = lambda i: F.sqrt(sum((_v(lattice, i, k) * _v(lattice, i, k) for k in range(3)), F.lit(0.0)))
    waves = shaped.select("id", "lattice", vol.alias("vol"), signed.alias("signed"))
    for i, n in enumerate("hkl"):  # |n| is at most the wave vector's length times the vector's by 2 pi
        bound = F.ceil(F.lit(most / (2 * math.pi)) * length(i)).cast("int")
        waves = waves.withColumn(n, F.explode(F.sequence(-bound, bound)))
    parts = [sum((F.col(n) * _cross(lattice, i)[k] for i, n in enumerate("hkl")), F.lit(0.0)) * (2 * math.pi) / F.col("signed") for k in range(3)]
    waves = waves.withColumn("k2", sum((c * c for c in parts), F.lit(0.0))).filter((F.col("k2") > 0) & (F.col("k2") <= most * most))
    waves = waves.select("id", "h", "k", "l", (4 * math.pi / F.col("vol") * F.exp(-F.col("k2") / (4 * alpha * alpha)) / F.col("k2")).alias("w"))
    placed = sites.dropna(subset=["id", "site", "x", "y", "z", "charge"]).join(shaped.select("id"), "id", "left_semi")
    phase = 2 * math.pi * (F.col("h") * F.col("x") + F.col("k") * F.col("y") + F.col("l") * F.col("z"))
    both = placed.join(waves, "id").withColumns({"c": F.cos(phase), "s": F.sin(phase)})
    factors = both.groupBy("id", "h", "k", "l").agg(F.sum(F.col("charge") * F.col("c")).alias("fc"), F.sum(F.col("charge") * F.col("s")).alias("fs"))
    far = both.join(factors, ["id", "h", "k", "l"]).groupBy("id", "site").agg(F.sum(F.col("w") * (F.col("c") * F.col("fc") + F.col("s") * F.col("fs"))).alias("far"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = placed.select("id", "site", "charge").join(near, ["id", "site"], "left").join(far, ["id", "site"], "left")
    return out.select("id", "site", (none("near") + none("far") - 2 * alpha / math.sqrt(math.pi) * F.col("charge")).alias("potential"))


WORK = 1 << 20  # distances and phases of a structure that is summed as a whole
CHUNK = 1 << 15  # distances held at once, which a core keeps near


def _erfc_of(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, x.tolist()), float, len(x))


def _potentials(m: np.ndarray, f: np.ndarray, q: np.ndarray, alpha: np.ndarray, images: np.ndarray, waves: np.ndarray, reach: float) -> np.ndarray:
    """(structure, site) potentials of structures with as many sites, images and wave vectors (of which a half is given)."""
    b, n = q.shape
    inside = f - np.floor(f)
    apart = (inside[:, None, :, :] - inside[:, :, None, :]) @ m[:, None]
    moved = images @ m
    d2 = np.zeros((b, len(images), n, n))
    for k in range(3):
        step = moved[:, :, None, None, k] + apart[:, None, :, :, k]
        step *= step
        d2 += step
    own = np.flatnonzero(~images.any(1))[0]
    d2[:, own, np.arange(n), np.arange(n)] = np.inf
    s, _, i, j = at = np.nonzero(d2 <= ((reach / alpha) ** 2)[:, None, None, None])
    d = np.sqrt(d2[at])
    near = np.bincount(s * n + i, q[s, j] * _erfc_of(alpha[s] * d) / d, b * n).reshape(b, n)
    k2 = ((2 * math.pi * waves @ np.linalg.inv(m).transpose(0, 2, 1)) ** 2).sum(2)
    w = 8 * math.pi / np.abs(np.linalg.det(m))[:, None] * np.exp(-k2 / (4 * alpha * alpha)[:, None]) / k2
    w[k2 > ((2 * alpha * reach) ** 2)[:, None]] = 0.0
    phase = 2 * math.pi * f @ waves.T.astype(float)
    c, s = np.cos(phase), np.sin(phase)
    far = c @ (w * (q[:, None] @ c)[:, 0])[:, :, None] + s @ (w * (q[:, None] @ s)[:, 0])[:, :, None]
    return near + far[:, :, 0] - 2 * alpha[:, None] / math.sqrt(math.pi) * q


def _shapes(reach: float, split: float | None):
    """Rows of structures with a volume, with the split and the ranges of images and of wave vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column("lattice").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
            cross = np.stack([np.cross(m[:, (i + 1) % 3], m[:, (i + 2) % 3]) for i in range(3)], 1)
            vol = np.abs((m[:, 0] * cross[:, 0]).sum(1))
            some = vol > 0
            m, cross, vol = m[some], cross[some], vol[some]
            alpha = np.full(len(m), float(split)) if split else math.sqrt(math.pi) / np.cbrt(vol)
            # Coordinates in the cell differ by less than one; |n| of a wave vector is at most its length times the vector's by 2 pi.
            r = np.floor(reach / alpha[:, None] * np.sqrt((cross**2).sum(2)) / vol[:, None] + 1)
            w = np.ceil(alpha[:, None] * (reach / math.pi) * np.sqrt((m**2).sum(2)))
            whole = [pa.array(v.astype(np.int64)) for v in (*r.T, *w.T)]
            spans = [pa.array((2 * v + 1).prod(1)) for v in (r, w)]
            kept = batch.filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(alpha), *whole, *spans], ["id", "lattice", "alpha", *[f"{a}{k}" for a in "rw" for k in "xyz"], "images", "waves"])

    return run


def _whole(reach: float):
    """A row a structure with all its sites -> a row a site with its potential."""

    def grid(reaches: np.ndarray) -> np.ndarray:
        return np.stack(np.meshgrid(*[np.arange(-r, r + 1) for r in reaches], indexing="ij"), -1).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {k: batch.column(k) for k in batch.schema.names}
            m = col["lattice"].flatten().flatten().to_numpy().reshape(-1, 3, 3)
            atoms = col["atoms"].flatten()
            n = col["atoms"].value_lengths().to_numpy()
            first = np.cumsum(n) - n
            xyz = np.stack([atoms.field(k).to_numpy() for k in "xyz"], 1)
            charge, alpha = atoms.field("charge").to_numpy(), col["alpha"].to_numpy()
            shapes, kind = np.unique(np.stack([n, *[col[k].to_numpy() for k in ("rx", "ry", "rz", "wx", "wy", "wz")]], 1), axis=0, return_inverse=True)
            out = np.zeros(len(charge))
            for at, shape in enumerate(shapes):
                rows = np.flatnonzero(kind.reshape(-1) == at)
                images, waves = grid(shape[1:4]), grid(shape[4:7])
                waves = waves[len(waves) // 2 + 1 :]  # of a vector and its reverse the second
                size = max(1, CHUNK // (len(images) * shape[0] ** 2 + len(waves) * shape[0]))
                for a in range(0, len(rows), size):
                    some = rows[a : a + size]
                    sites = first[some][:, None] + np.arange(shape[0])
                    out[sites] = _potentials(m[some], xyz[sites], charge[sites], alpha[some], images, waves, reach)
            ids = col["id"].take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([ids, atoms.field("site"), pa.array(out)], ["id", "site", "potential"])

    return run


def ewald(structures: DataFrame, sites: DataFrame, digits: int = 8, split: float | None = None) -> DataFrame:
    """(id, site, potential): the electrostatic potential at each site of a neutral structure, in charges per length.

    ``sites`` have a column ``charge``. Charges within a cut-off are summed screened, the
    rest as a sum over wave vectors of structure factors, up to where both sums' cut-offs
    bound the error to about ``digits`` digits. ``split`` (inverse length) moves work
    between the two; the result does not hang on it. Half of charge times potential,
    summed over sites, is the energy of a cell.

    A structure of few distances and wave vectors is a row, and such rows are summed many
    at once; larger ones are joins and grouped sums over sites, as no structure of any
    size may be one task's work.
    """
    ship(structures.sparkSession)
    reach = math.sqrt(digits * math.log(10))
    full = F.col("lattice").isNotNull() & (F.size("lattice") == 3) & F.forall("lattice", lambda v: F.size(v) == 3)
    ranges = [f"{a}{k}" for a in "rw" for k in "xyz"]
    kind = structures.schema["id"].dataType.simpleString()
    types = f"id {kind}, lattice array<array<double>>, alpha double, {', '.join(f'{r} long' for r in ranges)}, images double, waves double"
    shaped = structures.filter(full).select("id", F.col("lattice").cast("array<array<double>>").alias("lattice")).mapInArrow(_shapes(reach, split), types)
    placed = sites.dropna(subset=["id", "site", "x", "y", "z", "charge"])
    sized = shaped.join(placed.groupBy("id").agg(F.count("*").cast("double").alias("n")), "id")
    sized = sized.withColumn("work", F.col("n") * F.col("n") * F.col("images") + F.col("n") * F.col("waves"))
    sized = written(sized.drop("images", "waves"), "sized-structures")
    atom = F.struct("site", *[F.col(k).cast("double").alias(k) for k in ("x", "y", "z", "charge")])
    few = placed.join(sized.filter(F.col("work") <= WORK), "id")
    few = few.groupBy("id").agg(*[F.first(k).alias(k) for k in ("lattice", "alpha", *ranges)], F.collect_list(atom).alias("atoms"))
    kinds = [f"{k} {sites.schema[k].dataType.simpleString()}" for k in ("id", "site")]
    out = few.mapInArrow(_whole(reach), ", ".join([*kinds, "potential double"]))
    many = sized.filter(F.col("work") > WORK).select("id")
    if many.isEmpty():
        return out
    return out.unionByName(_ewald_joined(structures.join(many, "id", "left_semi"), sites.join(many, "id", "left_semi"), reach, split))


def madelung(structures: DataFrame, sites: DataFrame, length: Column, digits: int = 8) -> DataFrame:
    """(id, energy, madelung): the energy of a cell, and its sites' mean constant for a nearest distance ``length`` (of the structure)."""
    p = ewald(structures, sites, digits).join(sites.select("id", "site", "charge"), ["id", "site"])
    per = p.groupBy("id").agg((F.sum(F.col("charge") * F.col("potential")) / 2).alias("energy"), F.count("*").alias("n"), F.avg(F.col("charge") * F.col("charge")).alias("q2"))
    return per.join(structures.select("id", length.alias("length")), "id").select("id", "energy", (-2 * F.col("energy") * F.col("length") / (F.col("n") * F.col("q2"))).alias("madelung"))
