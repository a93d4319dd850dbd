"""Connected components of a link table by DataFrame rounds, and joins that no key overloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import discard, materialize


def frequent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent keys, as many as there are shuffle partitions; any other key has a smaller share than one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_count"))
    return counts.orderBy(F.desc("_count"), *keys).limit(n).select(*keys)


def attach(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, whose keys are unique; keys are not null.

    The table's rows of the most frequent keys are broadcast, one a shuffle partition
    at most, so that rows of such a key stay where they are; all other keys meet in
    a shuffle. ``rows`` is read more than once.
    """
    hot = frequent(rows, keys) if hot is None else hot
    near = rows.join(F.broadcast(hot.join(table, keys, how)), keys)
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how)
    return near.unionByName(rest)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node of a link; comp is the component's smallest node.

    Contraction in rounds: a node points to the neighbour first in this round's order
    (a hash of the node and the round) if that comes before itself, takes the label
    that its pointer points to, and links go on between labels, each once. A node that
    points nowhere comes before all its neighbours, which in an order by chance is one
    node in two at most, so the expected rounds are the logarithm of the nodes, whatever
    form a component has and however its nodes are numbered, and the links that are
    left shrink with them. The rounds' labels are joined from the last to the first.
    Only whether links are left comes to the driver; neither a node of many links
    nor a component of many nodes is one task's work.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = materialize(edges.union(edges.select("v", "u")).filter("u <> v").distinct(), "links")
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        hubs = materialize(frequent(edges, ["u"]), "link-hubs")
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(rounds))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        first = edges.groupBy("u").agg(F.min(place("v")).alias("m"))
        points = materialize(first.select("u", F.when(F.col("m") < place("u"), F.col("m.v")).otherwise(F.col("u")).alias("p")), "link-points")
        label = attach(points, points.select(F.col("u").alias("p"), F.col("p").alias("f")), ["p"]).select("u", "f")
        label = materialize(label, "link-labels")
        near = attach(edges, label, ["u"], hot=hubs).select("v", F.col("f").alias("a"))
        near = attach(near, label.select(F.col("u").alias("v"), "f"), ["v"], hot=hubs.select(F.col("u").alias("v")))
        left = materialize(near.filter("a <> f").select(F.col("a").alias("u"), F.col("f").alias("v")).distinct(), "links")
        for spent in (edges, hubs, points):
            discard(spent)
        edges = left
        rounds.append(label)
    discard(edges)
    label = rounds[-1]
    for earlier in reversed(rounds[:-1]):  # a label without links in the next round stays
        later = label.select(F.col("u").alias("f"), F.col("f").alias("g"))
        met = attach(earlier, later, ["f"], "left").select("u", F.coalesce("g", "f").alias("f"))
        met = materialize(met, "link-labels")
        for spent in (earlier, label):
            discard(spent)
        label = met
    least = label.groupBy("f").agg(F.min("u").alias("comp"))
    out = materialize(attach(label, least, ["f"]).select(F.col("u").alias("node"), "comp"), "labels")
    discard(label)
    return out


def mark_repeats(rows: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with a boolean ``again``: false for one row of each key (not null), true for others of that key.

    Only rows whose key repeats are dealt by it, first within their input partition,
    so that no key, however frequent, brings more than one row a partition to a task.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("times")) if counts is None else counts
    many = materialize(counts.filter("times > 1").select(*keys), "repeats")
    if many.isEmpty():
        return rows.withColumn("again", F.lit(False))
    own = rows.join(many, keys, "left_semi").withColumn("task", F.spark_partition_id())
    within = Window.partitionBy(*keys, "task").orderBy(F.lit(0))
    own = own.withColumn("nth", F.row_number().over(within))
    first = own.filter("nth = 1").withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("task")))
    own = first.union(own.filter("nth > 1")).withColumn("again", F.col("nth") > 1).drop("nth", "task")
    return rows.join(many, keys, "left_anti").withColumn("again", F.lit(False)).unionByName(own)
