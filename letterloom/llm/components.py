"""Connected components of a link table, by minimum labels and pointer jumping in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.shared import ROWS, discard, scratch, written_at


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Each round hangs every root under the smallest root next to it (a minimum, combined before the shuffle),
    then jumps pointers and rewrites the remaining links between roots, so links shrink quickly. Every round
    is written to the shared folder, in as many files as its rows need, and removed when the next one is. Null ends and links of a node to itself add nothing; repeated links
    count once; an empty table gives an empty result.
    """
    spark, live = links.sparkSession, {}
    most = None

    def written(df: DataFrame, name: str) -> DataFrame:
        """``df`` written in place of the table of that name, which it may read."""
        path = scratch(spark, name)
        out = written_at(df.coalesce(most) if most else df, path)
        old, live[name] = live.get(name), path
        if old:
            discard(spark, old)
        return out

    links = links.where("a is not null and b is not null")
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    # no later table has over two rows a link: few files where there are few, and more with the links
    most = max(spark.sparkContext.defaultParallelism, -(-links.count() // ROWS))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    label = nodes.select("node", F.col("node").alias("root"))
    links = links.where("a <> b")
    for _ in range(max_rounds):
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        hang = written(ends.groupBy("u").agg(F.min("v").alias("up")).where("up < u"), "hang")
        if hang.isEmpty():
            return label.select("node", F.col("root").alias("component"))
        while True:  # pointers only point to smaller nodes, so this ends; it halves the depth each time
            over = hang.select(F.col("u").alias("up"), F.col("up").alias("further"))
            jumped = hang.join(over, "up", "left").select("u", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved"))
            jumped = written(jumped, "jumped")
            hang = jumped.select("u", "up")
            if jumped.where("moved").isEmpty():
                break
        label = label.join(hang.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        label = written(label, "label")
        moved = links
        for end in ("a", "b"):
            moved = moved.join(hang.select(F.col("u").alias(end), F.col("up").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = written(moved, "moved")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
