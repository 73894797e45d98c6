"""Connected components by minimum labels with hooking and pointer jumping; each round is a small table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoner.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """From rows (a, b): rows (id, component) for every id in an edge, component being the smallest id reachable.

    In a round each node proposes the smallest of its neighbours' labels' labels to itself and to the node that its label
    names, and its own label's label to itself; every node takes the smallest proposal.  As a tree's root is hooked by any
    of its members, the rounds grow with the logarithm of a component's width in any order of the ids.  Every step is a
    join or a partial aggregate, a round is one written table, and nothing comes to the driver but whether a label has
    changed.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").dropDuplicates(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        up = labels.join(labels.select(F.col("id").alias("component"), F.col("component").alias("up")), "component").select("id", "component", "up")
        near = both.join(up.select(F.col("id").alias("b"), "up"), "b").groupBy(F.col("a").alias("id")).agg(F.min("up").alias("near"))
        seen = up.join(near, "id").select("id", F.col("component").alias("was"), "near", "up")
        rows = seen.select(F.explode(F.array(F.struct("id", "was", F.least("near", "up").alias("to")), F.struct(F.col("was").alias("id"), F.lit(None).cast("long").alias("was"), F.col("near").alias("to")))).alias("r")).select("r.*")
        stepped = written(rows.groupBy("id").agg(F.max("was").alias("was"), F.min("to").alias("to")).select("id", "was", F.least("was", "to").alias("component")), "labels")
        labels = stepped.select("id", "component")
        if stepped.filter("was <> component").isEmpty():
            return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of ``edges`` and of the earlier edges that gave ``labels``, in the form of ``connected``.

    Edges are led over to their ends' components first, so that the rounds run on those that join components only.
    """
    a, b = (labels.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    across = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    across = written(across.filter("a <> b").dropDuplicates(), "edges")
    if across.isEmpty():
        return labels
    joined = connected(across)
    moved = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(joined.join(labels, "id", "left_anti")), "labels")
