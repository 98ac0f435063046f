"""Connected components of a link table by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged


def connected_components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id of the component) for every end of a link (``a``, ``b``).

    Each round contracts: every node takes the smallest label among itself and
    its neighbours, labels are followed to the label's own label, and links are
    rewritten to labels; links inside a label vanish. Rounds end when none is
    left, after about the logarithm of the longest path. Minima are pre-aggregated
    map-side, and a hub's rows are split by the skew join.
    """
    edges = staged(links.select("a", "b").filter("a <> b").distinct(), "component-links")
    names = staged(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
                   .withColumn("component", F.col("id")), "component-names")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("low"))
        step = staged(low, "component-steps")
        # two hops at once: the label's own step
        hop = step.select(F.col("id").alias("low"), F.col("low").alias("next"))
        step = staged(step.join(hop, "low", "left").select("id", F.coalesce("next", "low").alias("to")), "component-steps")
        names = staged(names.join(step.withColumnRenamed("id", "component"), "component", "left")
                       .select("id", F.coalesce("to", "component").alias("component")), "component-names")
        one, two = step.select(F.col("id").alias("a"), F.col("to").alias("ta")), step.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        edges = staged(edges.join(one, "a").join(two, "b").filter("ta <> tb")
                       .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "component-links")
    return names
