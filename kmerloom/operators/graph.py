"""Connected components by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.plans.storage import release, spool


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, follows the hooks once more and contracts the edges; nodes and
    edges shrink at least by half, and the loop ends when no edge is left. Only the count of edges reaches the driver. Null ends and
    self loops are no edges, but a node with a self loop only is its own component; repeated edges count once.
    """
    found = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    labels = spool(found.select(F.col("u").alias("node")).union(found.select("v")).distinct().withColumn("label", F.col("node")), "labels")
    live = spool(found.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    while not live.isEmpty():
        both = live.union(live.select("v", "u"))
        hooks = spool(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("hook")), "hooks")
        jump = hooks.alias("a").join(hooks.alias("b"), F.col("a.hook") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("b.hook").alias("hook"))
        jump = spool(jump, "hooks")
        release(hooks)
        before, links = labels, live
        labels = spool(before.join(jump, before.label == jump.u, "left").select("node", F.coalesce("hook", "label").alias("label")), "labels")
        left = links.join(jump, "u").select(F.col("hook").alias("p"), F.col("v").alias("u")).join(jump, "u").select("p", F.col("hook").alias("q"))
        live = spool(left.where("p != q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "links")
        release(before, links, jump)
    release(live)
    return labels.select("node", F.col("label").alias("component"))
