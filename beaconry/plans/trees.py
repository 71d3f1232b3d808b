"""Values along the paths of deep trees, in a number of rounds that grows with the logarithm of the depth.

Every node points at an ancestor and carries what it knows of the path up to there. In each
round it looks at that ancestor's own row, takes over its pointer and composes both halves, so
pointers double their reach. A round is one join on (group, node), whose right side has one row
a node; adaptive execution splits a node that very many others point at. Nodes that no root
reaches (a cycle, or below one) never end and are left out.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from beaconry.plans.lineage import stored


def _largest(nodes: DataFrame, group: list[str]) -> int:
    """Nodes of the largest group: no path is longer."""
    return nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0


def along_paths(nodes: DataFrame, group: list[str], node: str, up: str,
                compose: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """``nodes`` without ``up`` (the parent, null for roots), values composed from the root down to each node.

    ``compose(above, own)`` gives the columns of a path from those of its upper and its lower
    part; it has to be associative. Columns it does not name keep a node's own value. Nodes
    whose parent is missing are left out, and so is all below them.
    """
    carried = [c for c in nodes.columns if c not in (*group, node, up)]
    state, reach = stored(nodes), 1
    bound = _largest(state, group)
    composed = compose(lambda c: F.col("_above")[c], F.col)
    while reach < bound:
        open_ = state.where(F.col(up).isNotNull())
        if open_.isEmpty():
            break
        above = state.select(*group, F.col(node).alias(up), F.col(up).alias("_up"), F.struct(*carried).alias("_above"))
        further = open_.join(above, [*group, up]).select(
            *group, node, F.col("_up").alias(up), *[composed.get(c, F.col(c)).alias(c) for c in carried])
        # By node, as the next round looks it up.
        state = stored(state.where(F.col(up).isNull()).unionByName(further).repartition(*group, node))
        reach *= 2
    return state.where(F.col(up).isNull()).drop(up)


def tree_sizes(nodes: DataFrame, group: list[str], node: str, up: str) -> DataFrame:
    """(group, node, Depth, Size): steps to the root, and nodes of the subtree (itself included).

    When pointers reach 2**k up, a node knows its descendants nearer than that; those that point
    at it stand at that distance and bring theirs, added up before they are joined.
    """
    start = F.when(F.col(up).isNull(), 0).otherwise(1).cast("bigint")
    state, reach = stored(nodes.select(*group, node, up, start.alias("Depth"), F.lit(1).cast("bigint").alias("Size"))), 1
    bound = _largest(state, group)
    while reach < bound:
        open_ = state.where(F.col(up).isNotNull())
        if open_.isEmpty():
            break
        more = open_.groupBy(*group, F.col(up).alias(node)).agg(F.sum("Size").alias("_more"))
        grown = state.join(more, [*group, node], "left").withColumn("Size", F.col("Size") + F.coalesce("_more", F.lit(0))).drop("_more")
        above = state.select(*group, F.col(node).alias(up), F.col(up).alias("_up"), F.col("Depth").alias("_depth"))
        further = grown.where(F.col(up).isNotNull()).join(above, [*group, up]).select(
            *group, node, F.col("_up").alias(up), (F.col("Depth") + F.col("_depth")).alias("Depth"), "Size")
        state = stored(grown.where(F.col(up).isNull()).unionByName(further).repartition(*group, node))
        reach *= 2
    return state.where(F.col(up).isNull()).drop(up)
