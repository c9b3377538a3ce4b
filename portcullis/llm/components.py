"""Connected components of a link table by contraction: each round every node joins its smallest
neighbour and the links are rewritten between what is left, so a hub costs one aggregate, not a task."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a and b. Returns node and label (the smallest node of its component),
    one row for each node that has a link to another one. Null ends and loops are no links."""
    edges = stored(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).withColumnRenamed("a", "node"))
        steps.append(parent)
        left = edges.join(parent, edges["a"] == parent["node"]).select(F.col("p").alias("a"), "b")
        edges = stored(left.join(parent, left["b"] == parent["node"]).select("a", F.col("p").alias("b")).where("a <> b").distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    labels = steps[0].withColumnRenamed("p", "label")
    for step in steps[1:]:
        s = step.select(F.col("node").alias("at"), F.col("p"))
        labels = labels.join(s, labels["label"] == s["at"], "left").select("node", F.coalesce("p", "label").alias("label"))
    return stored(labels)
