"""Connected components of a graph that no task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the run's folder and read back: computed once, and a
    join with it is a join with a plain table, which adaptive execution
    splits where a key is hot."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of the links (a, b): the label is the
    smallest node that can be reached. In each round every label hooks to its
    smallest neighbour (a partial aggregate), hooks are followed to their
    roots by pointer jumping, and the links are contracted to the roots; the
    labels left at least halve, so rounds are logarithmic in the longest
    chain."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.filter("a <> b").distinct(), "edges")
    labels = written(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    while not edges.isEmpty():
        up = written(edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
                     .select("n", F.least("n", "m").alias("up")), "hooks")
        while True:
            above = up.select(F.col("n").alias("up"), F.col("up").alias("top"))
            up = written(up.join(above, "up").select("n", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")),
                         "hooks")
            if up.filter("moved").isEmpty():
                break
            up = up.select("n", "up")
        root = up.select(F.col("n").alias("label"), F.col("up").alias("root"))
        labels = written(labels.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        a, b = (up.select(F.col("n").alias(side), F.col("up").alias(f"{side}_root")) for side in "ab")
        edges = written(edges.join(a, "a").join(b, "b").filter("a_root <> b_root")
                        .select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
    return labels
