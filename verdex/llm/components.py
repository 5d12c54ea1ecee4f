"""Connected components of a link table, without collecting anything to the driver.

Each round points every node at its smallest neighbour, follows the pointers to
their roots by doubling, and contracts the links to links between roots.  A round
at least halves the nodes that still have links, so there are O(log n) rounds.
Groups are only met by aggregates with partial sums and by joins straight above
scans of written tables, whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdex.llm.common import materialize


def follow(pointers: DataFrame) -> DataFrame:
    """(node, to) with to < node for all but roots, to (node, root)."""
    while True:
        nxt = pointers.alias("a").join(pointers.select(F.col("node").alias("at"), F.col("to").alias("further")), F.col("a.to") == F.col("at"), "left")
        jumped = materialize(nxt.select("node", F.coalesce("further", "to").alias("to"), (F.coalesce("further", "to") != F.col("to")).alias("moved")), "jump")
        pointers = jumped.select("node", "to")
        if jumped.where("moved").isEmpty():
            return pointers


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable.

    Links with a null end and loops are ignored; repeats and either order are allowed.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = materialize(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    labels: DataFrame | None = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        least = materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "least")
        roots = follow(least)
        to_a = roots.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        to_b = roots.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        met = links.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        links = materialize(met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if labels is None:
            labels = roots.withColumnRenamed("to", "component")
        else:
            step = roots.select(F.col("node").alias("component"), F.col("to").alias("next"))
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
