"""Connected components of a graph given as a table of links.

Every node hooks to its smallest neighbour, the hooks are followed to their roots by doubling, and the links between
roots form the graph of the next round. A round at least halves the nodes that still have links; each doubling halves
the depth. All steps are equi joins and groupings whose results are written to the shared folder; nothing is gathered
on the driver or in one task, and a hub only makes a join key frequent, which Spark's skew join splits.
"""

from pyspark.sql import DataFrame, functions as F

from kbspark.llm.common import stored


def _roots(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links``: the end of its chain of smallest neighbours."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("near")))
    lowest = ends.groupBy("node").agg(F.min("near").alias("near"))
    hooks = stored(lowest.select("node", F.least("node", "near").alias("root")), "hooks")
    while True:
        above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        doubled = stored(hooks.join(above, "root").select("node", F.col("above").alias("root"),
                                                          (F.col("above") != F.col("root")).alias("moved")), "hooks")
        hooks = doubled.select("node", "root")
        if doubled.filter("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """``(node, root)``: for every node that has a link to another one, the smallest node it can reach.

    ``links`` has two columns of one type; null ends, loops, repeated links and the direction have no effect. Without
    links the result is empty.
    """
    a, b = links.columns
    current = stored(links.filter(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    found = None
    while found is None or not current.isEmpty():
        roots = _roots(current)
        if found is None:
            found = roots
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        between = current.join(left, "a").join(right, "b").filter("root_a != root_b")
        current = stored(between.select(F.least("root_a", "root_b").alias("a"),
                                        F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
    return found
