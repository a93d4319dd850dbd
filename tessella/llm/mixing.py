"""Mixing sources to target weights by hierarchical budgeting.

Method: a token budget is propagated from the root through a tree of levels
(domain, language, source). At each node the budget is split among the children
by weight; a child that cannot fill its share is held at its capacity and the
shortage goes to its siblings by weight, and only what a whole subtree cannot
take reaches the ancestors' other children (capacities are those of subtrees,
so the top-down pass does exactly that). A leaf with budget b and t tokens takes
floor(b / t) whole epochs and, in the next, a prefix of its documents in the
order of md5(seed|epoch|id), the longest whose tokens do not exceed the rest.

The prefix is found without sorting a leaf: a radix descent over the hash's hex
digits sums 256 bins a leaf and round, so that only the last bin is ordered.

Everything is built-in SQL expressions; no Python runs on the executors.

Defined cases: a null level value is the child ``(none)``; a null or empty text
has no tokens, so it is taken with whole epochs only, or with a prefix that
passes it; rows that repeat are taken or left together; a leaf without tokens
gets budget 0; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.shared import materialize

LEVELS = ("domain", "lang", "source")
TOKEN = r"[^\x20\x09-\x0D]+"
#: Powers of two, so that sums and products of weights are exact.
WEIGHTS = {
    "domain": {"d0": 0.25, "d1": 0.25, "d2": 0.25, "d3": 0.25},
    "lang": {"en": 0.5, "de": 0.25, "fr": 0.25, "es": 0.125},
    "source": {},
}
DEFAULT_WEIGHT = {"domain": 0.125, "lang": 0.0625, "source": 1.0}


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """A source's domain: its number modulo 4."""
    number = F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999"))
    return F.concat(F.lit("d"), F.coalesce(number.cast("long") % 4, F.lit(0)).cast("string"))


def _weight(level: str, weights: Mapping, default: Mapping) -> Column:
    out = F.lit(float(default[level]))
    for value, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, total: Column, max_epochs: int, weights=WEIGHTS, default=DEFAULT_WEIGHT, levels=LEVELS) -> DataFrame:
    """Leaves (levels, tokens) with their budget; ``total`` is a column of ``leaves``."""
    tree = leaves.withColumn("_cap", (F.col("tokens") * max_epochs).cast("double")).withColumn("_budget", total.cast("double"))
    for depth, level in enumerate(levels):
        above = list(levels[:depth])
        below = Window.partitionBy(*above, level)
        tree = tree.withColumn("_w", _weight(level, weights, default)).withColumn("_sub", F.sum("_cap").over(below))
        nodes = tree.groupBy(*above, level).agg(F.first("_w").alias("_w"), F.first("_sub").alias("_sub"), F.first("_budget").alias("_b"))
        order = Window.partitionBy(*above).orderBy(F.col("_sub") / F.col("_w"), level)
        before, parent = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*above)
        nodes = (
            nodes.withColumn("_cb", F.coalesce(F.sum("_sub").over(before), F.lit(0.0)))
            .withColumn("_wb", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
            .withColumn("_wt", F.sum("_w").over(parent))
            .withColumn("_full", F.col("_sub") * (F.col("_wt") - F.col("_wb")) <= F.col("_w") * (F.col("_b") - F.col("_cb")))
            .withColumn("_cf", F.sum(F.when(F.col("_full"), F.col("_sub")).otherwise(0.0)).over(parent))
            .withColumn("_wf", F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0.0)).over(parent))
            .withColumn(
                "_to",
                F.when(F.col("_full"), F.col("_sub")).otherwise(
                    F.least(F.col("_sub"), (F.col("_b") - F.col("_cf")) * F.col("_w") / (F.col("_wt") - F.col("_wf")))
                ),
            )
            .select(*above, level, "_to")
        )
        tree = tree.join(nodes, [*above, level]).withColumn("_budget", F.col("_to")).drop("_to", "_w", "_sub")
    return tree.select(*levels, "tokens", F.floor("_budget").cast("long").alias("budget"))


def _key(seed: int, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"))


def mixture(
    docs: DataFrame,
    fraction: float,
    max_epochs: int,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Mapping = WEIGHTS,
    default: Mapping = DEFAULT_WEIGHT,
    rounds: int = 2,
) -> DataFrame:
    """A row per taken document and epoch: _id, _rid, epoch, levels, n_tokens, leaf_budget.

    The budget is floor(fraction x all tokens). ``docs`` has the level columns.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text_col).alias("_rid"),
        *[F.coalesce(F.col(x), F.lit("(none)")).alias(x) for x in LEVELS],
        n_tokens(F.col(text_col)).alias("n_tokens"),
    )
    rows = materialize(rows, "mixing-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(float(fraction)))
    plan = leaf_budgets(leaves.withColumn("_total", total), F.col("_total"), max_epochs, weights, default)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).drop("tokens")
    plan = materialize(plan, "mixing-leaves")
    keyed = rows.join(plan, list(LEVELS)).withColumn("key", _key(seed, F.col("whole"), F.col("_id")))
    # Radix descent: per leaf, the bin in which the prefix ends and what remains for it.
    cuts = plan.select(*LEVELS, F.lit("").alias("bin"), F.col("rest").alias("left_over"))
    for i in range(rounds):
        at = keyed.select(*LEVELS, "n_tokens", "key").join(cuts, list(LEVELS)).filter(F.substring("key", 1, 2 * i) == F.col("bin"))
        bins = at.groupBy(*LEVELS, F.substring("key", 1, 2 * i + 2).alias("next"), "left_over").agg(F.sum("n_tokens").alias("t"))
        run = Window.partitionBy(*LEVELS).orderBy("next")
        bins = bins.withColumn("upto", F.sum("t").over(run))
        full = F.col("upto") <= F.col("left_over")
        cuts = bins.groupBy(*LEVELS).agg(
            F.coalesce(F.min(F.when(~full, F.col("next"))), F.lit("~")).alias("bin"),
            (F.first("left_over") - F.coalesce(F.max(F.when(full, F.col("upto"))), F.lit(0))).alias("left_over"),
        )
        # A written table of one row a leaf: its known size lets joins leave the documents where they are.
        cuts = materialize(cuts, "mixing-cuts")
    width = 2 * rounds
    last = keyed.join(cuts, list(LEVELS)).filter(F.substring("key", 1, width) == F.col("bin"))
    run = Window.partitionBy(*LEVELS).orderBy("key")  # the default frame takes equal keys together
    last = last.withColumn("upto", F.sum("n_tokens").over(run)).filter(F.col("upto") <= F.col("left_over"))
    last = last.groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    cuts = cuts.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last_key", "bin").alias("cut"))
    cuts = materialize(cuts, "mixing-cuts")
    chosen = keyed.join(cuts, list(LEVELS), "left")
    in_prefix = (F.col("rest") > 0) & (F.col("key") <= F.col("cut"))
    epochs = F.filter(
        F.sequence(F.lit(0), F.col("whole")), lambda e: (e < F.col("whole")) | F.coalesce(in_prefix, F.lit(False))
    )
    return chosen.select("_id", "_rid", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), F.explode(epochs).alias("epoch"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.withColumn("domain", domain_of(F.col("source")))
    got = mixture(docs, fraction=0.75, max_epochs=3, seed=17)
    return got.select(F.col("_id").alias("doc_id"), "epoch", *LEVELS, "n_tokens", "leaf_budget")


def _level_sql(given: str, out: str, above: list[str], level: str, weight: str) -> str:
    cols, parent = ", ".join([*above, level]), f"PARTITION BY {', '.join(above)}" if above else ""
    return f"""
{out}_n AS (SELECT {cols}, {weight} AS w, sum(cap) AS sub, max(b) AS b FROM {given} GROUP BY {cols}),
{out}_p AS (SELECT *, coalesce(sum(sub) OVER ({parent} ORDER BY sub / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
  coalesce(sum(w) OVER ({parent} ORDER BY sub / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
  sum(w) OVER ({parent}) AS wt FROM {out}_n),
{out}_f AS (SELECT *, sub * (wt - wb) <= w * (b - cb) AS full_ FROM {out}_p),
{out}_s AS (SELECT *, sum(CASE WHEN full_ THEN sub ELSE 0 END) OVER ({parent}) AS cf, sum(CASE WHEN full_ THEN w ELSE 0 END) OVER ({parent}) AS wf FROM {out}_f),
{out}_t AS (SELECT {cols}, CASE WHEN full_ THEN sub ELSE least(sub, (b - cf) * w / (wt - wf)) END AS to_ FROM {out}_s),
{out} AS (SELECT g.* EXCLUDE (b), t.to_ AS b FROM {given} g JOIN {out}_t t USING ({cols}))"""


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, 'd' || coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4, 0)::VARCHAR AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * 3 AS cap FROM d GROUP BY ALL
), l0 AS (SELECT *, floor((SELECT sum(tokens) FROM leaves)::DOUBLE * 0.75) AS b FROM leaves),
{_level_sql("l0", "l1", [], "domain", "CASE WHEN domain IN ('d0','d1','d2','d3') THEN 0.25::DOUBLE ELSE 0.125::DOUBLE END")},
{_level_sql("l1", "l2", ["domain"], "lang", "CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.25::DOUBLE WHEN 'fr' THEN 0.25::DOUBLE WHEN 'es' THEN 0.125::DOUBLE ELSE 0.0625::DOUBLE END")},
{_level_sql("l2", "l3", ["domain", "lang"], "source", "1.0::DOUBLE")},
budgets AS (SELECT domain, lang, source, tokens, floor(b)::BIGINT AS leaf_budget,
  CASE WHEN tokens > 0 THEN floor(floor(b) / tokens)::BIGINT ELSE 0 END AS whole FROM l3),
ordered AS (
  SELECT d.*, leaf_budget, whole, leaf_budget - whole * tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17|' || whole || '|' || doc_id) RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN budgets USING (domain, lang, source)
)
SELECT doc_id, epoch::INTEGER AS epoch, domain, lang, source, n_tokens, leaf_budget
FROM (SELECT *, unnest(range(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM ordered)
"""
