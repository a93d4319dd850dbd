"""Sites, bonds and stages: edge tables and nested records to features of their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numeric import bond_valence
from tessella.operators.metrics import poisoned_sum


def effective_coordination(edges: DataFrame, site: list[str], distance: str) -> DataFrame:
    """Per site: sum of exp(1 - (d / d_min)^6), and the entropy number exp(-sum p ln p) of those weights."""
    w = Window.partitionBy(*site)
    e = edges.withColumn("_w", F.exp(1 - F.pow(F.col(distance) / F.min(distance).over(w), 6)))
    e = e.withColumn("_p", F.col("_w") / F.sum("_w").over(w))
    return e.groupBy(*site).agg(F.sum("_w").alias("econ"), F.exp(-F.sum(F.col("_p") * F.ln("_p"))).alias("entropy_cn"))


def bond_valence_sums(edges: DataFrame, site: list[str], distance: str, r0: str, charge: str) -> DataFrame:
    """Per site the valence sum and its deviation from the charge."""
    s = edges.groupBy(*site).agg(F.sum(bond_valence(distance, r0)).alias("bvs"), F.any_value(charge).alias(charge))
    return s.withColumn("deviation", F.col("bvs") - F.abs(charge))


def global_instability(sites: DataFrame, structure: str) -> DataFrame:
    """Root mean square of the sites' deviations."""
    return sites.groupBy(structure).agg(F.sqrt(F.avg(F.col("deviation") * F.col("deviation"))).alias("gii"))


def received_strength(edges: DataFrame, cations: DataFrame, cation: list[str], anion: list[str]) -> DataFrame:
    """Per anion: the sum of charge / coordination over its cations (NULL if any is), and their number."""
    j = edges.join(cations.select(*cation, "ox", "cn"), cation)
    return j.groupBy(*anion).agg(poisoned_sum(F.col("ox") / F.col("cn")).alias("strength"), F.count("*").alias("bonds"))


def shared_ligands(ligands: DataFrame, structure: str, centre: str, ligand: str) -> DataFrame:
    """(structure, i, j, shared, kind): centres i < j with common ligands; 1 corner, 2 edge, 3 and more face."""
    a = ligands.select(structure, F.col(centre).alias("i"), ligand)
    b = ligands.select(structure, F.col(centre).alias("j"), ligand)
    p = a.join(b, [structure, ligand]).filter("i < j").groupBy(structure, "i", "j").agg(F.count("*").alias("shared"))
    return p.withColumn("kind", F.when(F.col("shared") == 1, "corner").when(F.col("shared") == 2, "edge").otherwise("face"))


def site_summaries(sites: DataFrame, structure: str, charge: str, metrics: list[str]) -> DataFrame:
    """Per structure and sign of charge: mean, q05, q95, least and most of each metric."""
    aggs = []
    for m in metrics:
        q = F.percentile(m, [0.05, 0.95])
        aggs += [F.avg(m).alias(f"{m}_mean"), q[0].alias(f"{m}_q05"), q[1].alias(f"{m}_q95"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return sites.groupBy(structure, F.signum(charge).cast("int").alias("sign")).agg(F.count("*").alias("n"), *aggs)


def status_fold(stages: Column) -> Column:
    """Status of ordered stages array<struct<name, state>>: the first that is not complete decides."""
    bad = F.filter(stages, lambda s: s["state"] != "complete")
    return F.when(F.size(stages) == 0, "incomplete").when(F.size(bad) == 0, "complete").otherwise(F.get(bad, 0)["state"])


def mixing_temperature(occupancy: DataFrame, structure: str, site: str, share: str, energy: str, k: float = 8.617333262e-5) -> DataFrame:
    """Per structure: the mixing entropy per atom -sum p ln p over sites, and energy / (k entropy)."""
    s = occupancy.groupBy(structure, site).agg(F.sum(F.when(F.col(share) > 0, -F.col(share) * F.ln(share)).otherwise(0.0)).alias("h"), F.any_value(energy).alias("e"))
    t = s.groupBy(structure).agg(F.avg("h").alias("entropy"), F.any_value("e").alias("energy"))
    return t.withColumn("temperature", F.col("energy") / F.nullif(F.lit(k) * F.col("entropy"), F.lit(0.0)))


def complete_groups(df: DataFrame, group: str, measure: str, expected: int) -> DataFrame:
    """Per group with all its members: least, mean, most and spreads (a partial minimum would be biased)."""
    g = df.groupBy(group).agg(F.count(measure).alias("n"), F.min(measure).alias("least"), F.avg(measure).alias("mean"), F.max(measure).alias("most"))
    return g.filter(F.col("n") == expected).withColumns({"excess": F.col("mean") - F.col("least"), "span": F.col("most") - F.col("least")})


def relative_spread(c: str) -> Column:
    """(q75 - q25) / median."""
    q = F.percentile(c, [0.25, 0.5, 0.75])
    return (q[2] - q[0]) / F.nullif(q[1], F.lit(0.0))


def usable(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, ledger of reasons with counts); the first rule that fails is the reason."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    d = df.withColumn("_reason", reason)
    return d.filter("_reason is null").drop("_reason"), d.filter("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def flatten_stages(df: DataFrame, identity: str, stages: str, names: list[str]) -> DataFrame:
    """A map<stage, struct> to flat columns stage_field."""
    fields = df.schema[stages].dataType.valueType.names
    return df.select(identity, *[F.col(stages)[n][f].alias(f"{n}_{f}") for n in names for f in fields])
