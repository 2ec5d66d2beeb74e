"""Connected components of links, by contraction.

Each round hooks every node to its smallest neighbour, follows the pointers to their roots by doubling, and replaces the
links by those between roots. A component that still has links loses at least half of its nodes a round. All tables stay
in the shared folder; nothing is gathered on the driver but two counts a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import merged, stage


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (node, component), component being the smallest node; every linked node has a row."""
    links = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = stage(merged(roots, up, "root").select("node", "root", "above"), "roots")
            moved = not jumped.filter("above <> root").isEmpty()
            roots = jumped.select("node", F.col("above").alias("root"))
            if not moved:
                break
        step = roots.select(F.col("node").alias("component"), "root")
        found = roots.withColumnRenamed("root", "component") if found is None else stage(merged(found, step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "found")
        ends = merged(merged(links, roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a"), roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = stage(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b").distinct(), "links")
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
