"""Connected components of a graph of links, by joins and written tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathom.llm.storage import save


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the least node that links reach.

    Every round each node takes the least label among its neighbours, then the label of its label, so that labels travel
    twice as far each time; it ends when nothing changes.
    """
    both = save(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label").union(labels)
        least = save(near.groupBy("node").agg(F.min("label").alias("label")), "labels")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = save(least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "before"), "node").filter("label < before").limit(1).count()
        labels = after
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components need more than {most_rounds} rounds")
