"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm._tables import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``; root is the component's least node.

    Each round gives a node the least root among its neighbours' roots and then
    follows the root's own root, so distances halve.  Every round is written to
    the shared folder; the driver sees one count per round.  A node with a
    third of all edges is summed before the shuffle (minimum per node).
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    roots = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"))
                  .select(F.col("u").alias("node"), "root"), "cc-roots")
    while True:
        near = (both.join(roots, both["v"] == roots["node"]).groupBy("u").agg(F.min("root").alias("near"))
                .withColumnRenamed("u", "n"))
        hooked = roots.join(near, roots["node"] == near["n"]).select("node", F.col("root").alias("old"),
                                                                     F.least("root", "near").alias("root"))
        up = roots.select(F.col("node").alias("r"), F.col("root").alias("above"))
        jumped = stage(hooked.join(up, hooked["root"] == up["r"], "left")
                       .select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "cc-roots")
        changed = jumped.filter("root <> old").count()
        roots = jumped.select("node", "root")
        if not changed:
            return roots
