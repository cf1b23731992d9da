"""Mind maps: one tree per result out of a list of nodes with parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from readlake.session import pinned

MAX_DEPTH, MAX_NODES, MIN_NODES, MIN_THEMES = 3, 40, 6, 2


def bfs(nodes: DataFrame, tree: str = "artifact_id") -> DataFrame:
    """(tree, id, parent, depth, ord, route, position): what hangs from the one root, level by level.

    Three joins reach the deepest level a map may have, so a cycle cannot loop and a branch of a second root is
    never reached. Nodes are kept in the order of levels, then of arrival, up to the size limit.
    """
    first = nodes.groupBy(tree, "id").agg(F.min_by(F.struct("ord", F.coalesce("parent", F.lit("")).alias("parent")), "ord").alias("n"))
    known = pinned(first.select(tree, "id", "n.*").filter("id <> ''"), "tree_nodes")
    roots = known.filter("parent = ''").groupBy(tree).agg(F.count(F.lit(1)).alias("_r"), F.min("id").alias("id")).filter("_r = 1")
    at = roots.select(tree, "id").join(known, [tree, "id"]).select(
        tree, "id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("ord").alias("route"), F.array("id").alias("path")
    )
    at = pinned(at, "tree_level")
    out = at
    for depth in range(1, MAX_DEPTH + 1):
        children = known.filter("parent <> '' AND parent <> id").withColumnRenamed("id", "_c")
        up = at.select(tree, F.col("id").alias("parent"), F.col("route").alias("_route"), F.col("path").alias("_path"))
        at = children.join(up, [tree, "parent"]).filter(~F.array_contains("_path", F.col("_c"))).select(
            tree, F.col("_c").alias("id"), "parent", F.lit(depth).alias("depth"), F.concat("_route", F.array("ord")).alias("route"),
            F.concat("_path", F.array("_c")).alias("path"),
        )
        at = pinned(at, "tree_level")
        out = out.unionByName(at)
    ranked = out.withColumn("position", F.row_number().over(W.partitionBy(tree).orderBy("depth", "route")))
    return ranked.filter(F.col("position") <= MAX_NODES)


def valid(tree_rows: DataFrame, tree: str = "artifact_id") -> DataFrame:
    """Trees large enough to show."""
    sizes = tree_rows.groupBy(tree).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("depth") == 1).alias("themes"))
    return sizes.filter((F.col("nodes") >= MIN_NODES) & (F.col("themes") >= MIN_THEMES))


def paths(tree_rows: DataFrame, labels: DataFrame, tree: str = "artifact_id") -> DataFrame:
    """(tree, id, line): each node with its ancestors, root first."""
    steps = tree_rows.select(tree, "id", F.posexplode("path").alias("step", "_a"))
    named = steps.join(labels.select(tree, F.col("id").alias("_a"), "label"), [tree, "_a"])
    rows = named.groupBy(tree, "id").agg(F.array_sort(F.collect_list(F.struct("step", "label"))).alias("_l"))
    return rows.select(tree, "id", F.array_join(F.transform("_l", lambda x: x["label"]), " › ").alias("line"))


def children_lists(tree_rows: DataFrame, tree: str = "artifact_id") -> DataFrame:
    return tree_rows.filter("parent IS NOT NULL").groupBy(tree, F.col("parent").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("children")
    )
