"""Connected components of links, as a table of labels that is written in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import forget, kept


def components(links: DataFrame) -> DataFrame:
    """id, label of every id in links (a, b): the smallest id of its component.

    Each round takes the least label of the neighbours, then the label of that label, so paths
    are halved and rounds grow with the logarithm of the longest chain.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = kept(both, "links")
    labels = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = (
            labels.join(near, labels.id == near.a).join(jump, "label")
            .select("id", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("changed"))
        )
        before, labels = labels, kept(moved, "labels")
        forget(before)
        if labels.where("changed").isEmpty():
            forget(both)
            return labels.select("id", "label")


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, label of every id in ``labels`` (as ``components`` gives them) or in further links (a, b).

    Only links between components count, each pair of components once.
    """
    one, two = (labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab")
    ends = [F.coalesce(f"{c}_label", c).alias(f"{c}_label") for c in "ab"]
    named = kept(links.join(one, "a", "left").join(two, "b", "left").select("a", "b", *ends), "named")
    across = named.where("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    moved = components(across.distinct()).select(F.col("id").alias("label"), F.col("label").alias("to"))
    known = labels.union(named.select("a", "a_label")).union(named.select("b", "b_label")).distinct()
    joined = kept(known.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "joined")
    forget(named)
    return joined
