"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of documents; a stage works on all that its predecessor kept.

1. toxicity: rows that the ordinal model flags go.
2. line_dedup: of lines found in at least 10 documents only the first occurrence
   stays. A document that loses lines and keeps nothing but white space goes too:
   each of its lines is still in the corpus once. Documents that were empty before
   stay.
3. jaccard_join: of each class linked by 5-word shingles at 0.8 or more, the
   document with the smallest id stays (of repeated rows one; null ids last).
4. source_mixing: three quarters of the tokens, by the weights of
   ``tessella.llm.mixing``, each document at most once.
5. best_fit_packing: a row per piece of at most 2048 tokens with its place.

Nulls, empty and repeated rows, empty tables and extra columns: as each operator's
docstring says; extra columns are carried through to the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from tessella.llm.shared import in_struct, materialize, ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)  # the flag is the last column, whatever its name
    return scored.filter(~F.col(f"`{scored.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    drops = line_dedup.dropped_lines(docs, min_docs=10, min_chars=1, keep="first")
    out = line_dedup.apply_drops(docs, drops, keep="first")
    lost = F.col("n_dropped") > 0
    out = out.filter(~(lost & (F.btrim("kept", F.lit(line_dedup.SPACE)) == "")))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    own = lambda c: F.col(f"row.`{c}`")
    return out.select(*[F.when(lost, new[c]).otherwise(own(c)).alias(c) if c in new else own(c) for c in docs.columns])


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def source_mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaves = docs.select("doc_id", "text", "lang", "source", mixing.domain_of(F.col("source")).alias("domain"))
    got = mixing.mixture(leaves, fraction=0.75, max_epochs=1, seed=17).select("_id", F.col("_rid").alias("_got")).distinct()
    rows = docs.select(in_struct(docs)).withColumns({"_doc": F.col("row.doc_id"), "_rid": F.xxhash64("row.text")})
    met = rows.join(got, rows["_doc"].eqNullSafe(got["_id"]) & (rows["_rid"] == got["_got"]), "left_semi")
    return met.select("row.*")


def best_fit_packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("source_mixing", source_mixing_stage),
    ("best_fit_packing", best_fit_packing_stage),
]

#: Two stages have no SQL form (a trained model, a tokenizer); tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
