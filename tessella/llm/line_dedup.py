"""Line-level deduplication with compressed per-document keep bitmaps.

Method: the distinct line keys of each document are hashed; counts and first
occurrences are pre-aggregated per (hash, salt); the partial rows are range-
partitioned by hash with a secondary sort by document and position, and a
window streams over each hash to get its document count and first occurrence.
What leaves the operator is not text but compressed bitmaps per document: of the
lines of frequent keys and of those among them that are kept (64-bit words; words
without such a line are not stored, all other lines are kept).

Everything is built-in SQL expressions; no Python runs on the executors.

Defined cases: a null or empty text is one empty line; a line that is empty
after trimming has no key and always stays; rows that repeat (same id and text)
count as separate documents for the document count; with ``keep="first"`` the
first of them (of any order) may keep a line that the others lose; rows that share
an id but not the text are told apart by a text hash; a null id is a value like
any other; an empty table gives an empty table; other columns of the input,
whatever their names, are carried through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.components import mark_repeats
from tessella.llm.shared import in_struct, materialize

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _row_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_rid", F.xxhash64("_text"))


def _occurrences(rows: DataFrame, min_chars: int) -> DataFrame:
    """A row per line with a key: _id, _rid, h1, h2, pos and whether it is the document's first of that key."""
    keyed = F.filter(
        F.transform(
            lines_of(F.col("_text")),
            lambda line, i: F.struct(key_of(line).alias("k"), i.alias("pos")),
        ),
        lambda s: F.char_length(s["k"]) >= min_chars,
    )
    hashed = F.sort_array(
        F.transform(keyed, lambda s: F.struct(F.xxhash64(s["k"]).alias("h1"), F.hash(s["k"]).alias("h2"), s["pos"].alias("pos")))
    )
    flat = rows.select("_id", "_rid", hashed.alias("a"))
    flat = flat.select(
        "_id",
        "_rid",
        F.explode(
            F.transform(
                "a",
                lambda s, i: F.struct(
                    s["h1"].alias("h1"),
                    s["h2"].alias("h2"),
                    s["pos"].alias("pos"),
                    F.coalesce(
                        (F.get("a", i - 1)["h1"] != s["h1"]) | (F.get("a", i - 1)["h2"] != s["h2"]), F.lit(True)
                    ).alias("fresh"),
                ),
            )
        ).alias("s"),
    )
    return flat.select("_id", "_rid", "s.h1", "s.h2", "s.pos", "s.fresh")


def frequent_keys(occ: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, first) of the keys found in at least ``min_docs`` documents."""
    partial = occ.groupBy("h1", "h2", F.pmod(F.hash("_id", "_rid"), F.lit(SALTS)).alias("salt")).agg(
        F.sum(F.col("fresh").cast("long")).alias("n"), F.min(F.struct("_id", "_rid", "pos")).alias("first")
    )
    n = int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = partial.repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", "first")
    streamed = Window.partitionBy("h1", "h2").orderBy("first")
    whole = streamed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranged.withColumn("n_docs", F.sum("n").over(whole))
        .withColumn("at", F.row_number().over(streamed))
        .filter((F.col("at") == 1) & (F.col("n_docs") >= min_docs))
        .select("h1", "h2", "n_docs", "first")
    )


def _bitmaps(hits: DataFrame) -> DataFrame:
    """(_id, _rid, map from word number to 64-bit mask) of the lines in ``hits``."""
    words = hits.groupBy("_id", "_rid", F.floor(F.col("pos") / 64).cast("int").alias("w"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"), F.bit_or(F.expr("if(kept, shiftleft(1L, pos % 64), 0L)")).alias("spared"))
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("w", c))))
    return words.groupBy("_id", "_rid").agg(entry("bits").alias("frequent"), entry("spared").alias("spared"))


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none"
) -> DataFrame:
    """(_id, _rid, frequent, spared): a row per document with a line of a frequent key.

    Both map a word number to a 64-bit mask; bit b of word w stands for line
    64 w + b. ``frequent`` has all lines of frequent keys; ``spared`` those of them
    that stay: none with ``keep='none'``, the first of each key by (document,
    position) with ``'first'``.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    occ = materialize(_occurrences(_row_ids(docs, id_col, text_col), min_chars), "line-occurrences")
    first = F.struct("_id", "_rid", "pos").eqNullSafe(F.col("first")) if keep == "first" else F.lit(False)
    return _bitmaps(occ.join(frequent_keys(occ, min_docs), ["h1", "h2"]).withColumn("kept", first))


def in_bitmap(bits: Column, i: Column) -> Column:
    word = F.try_element_at(bits, F.floor(i / 64).cast("int"))
    return F.coalesce(F.shiftrightunsigned(word, 0).bitwiseAND(_bit(i)) != 0, F.lit(False))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))


def apply_drops(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "none") -> DataFrame:
    """(row, n_lines, n_dropped, kept): the input's columns in a struct, and the remaining text."""
    rows = docs.select(in_struct(docs))
    rows = rows.withColumns({"_id": F.col(f"row.`{id_col}`"), "_text": F.col(f"row.`{text_col}`")}).withColumn("_rid", F.xxhash64("_text"))
    if keep == "first":  # which of rows that repeat is the one that spares lines
        rows = rows.withColumns({"_i": F.coalesce(F.col("_id").cast("string"), F.lit("")), "_no": F.isnull("_id")})
        rows = mark_repeats(rows, ["_i", "_no", "_rid"], rows.groupBy("_i", "_no", "_rid").agg(F.count("*").alias("times"))).drop("_i", "_no")
    else:
        rows = rows.withColumn("again", F.lit(False))
    d = drops.select(F.col("_id").alias("_drop_id"), F.col("_rid").alias("_drop_rid"), "frequent", "spared")
    met = rows.join(d, rows["_id"].eqNullSafe(d["_drop_id"]) & (rows["_rid"] == d["_drop_rid"]), "left")
    lines = lines_of(F.col("_text"))
    stays = lambda i: ~in_bitmap(F.col("frequent"), i) | (~F.col("again") & in_bitmap(F.col("spared"), i))
    ones = lambda c: F.coalesce(F.aggregate(F.map_values(c), F.lit(0), lambda a, w: a + F.bit_count(w)), F.lit(0))
    n_dropped = ones("frequent") - F.when(F.col("again"), 0).otherwise(ones("spared"))
    text = F.coalesce("_text", F.lit(""))
    kept = F.when(F.col("frequent").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: stays(i)), "\n"))
    return met.select("row", F.size(lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), kept.alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_drops(docs, dropped_lines(docs, min_docs=10, min_chars=1, keep="none"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(f.k))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY doc_id
"""
