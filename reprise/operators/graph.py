"""Connected components of an edge table by minimum labels and pointer jumping, staged between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage, unstage


PART = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round: every node takes the smallest label around it, then the label of its label. Rows per round follow the
    edges. The edges of a node with many are dealt to as many parts as it takes (PART edges each), and its label is
    copied to each, so that it is no hot task in the join; the minimum around it is partial before the shuffle.
    An empty edge table gives no rows; self-loops and repeated edges change nothing; edges with a null end are ignored.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = F.ceil(F.col("degree") / PART).cast("int")
    heavy = stage(both.groupBy("b").agg(F.count("*").alias("degree")).where(F.col("degree") > PART).select("b", parts.alias("parts")))
    salted = bool(heavy.limit(1).count())
    if salted:
        both, plain = stage(both.join(heavy, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))), both
        unstage(plain)
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = label.select(F.col("node").alias("b"), "component")
        if salted:
            near = near.join(heavy, "b", "left").select("b", "component", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        around = both.join(near, ["b", "part"] if salted else ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        best = label.join(around, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("to"), F.col("component").alias("far"))
        new = stage(best.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("component"), "was"))
        changed = new.where("component <> was").limit(1).count()
        unstage(label)
        label = new
        if not changed:
            unstage(both, heavy)
            return label.select("node", "component")
