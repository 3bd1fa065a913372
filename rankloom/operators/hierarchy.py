"""URL directory trees as flat tables: every path prefix is a node, no recursion needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.ladders import heat
from rankloom.functions.numbers import exact
from rankloom.functions.urls import tree_parts
from rankloom.operators.ranking import top_per_group


def _node_id(parts: Column) -> Column:
    return F.array_join(parts, "/")


def page_leaves(merged: DataFrame) -> DataFrame:
    """Pages placed in the tree; of several pages at the same place the strongest is kept."""
    placed = merged.withColumn("parts", tree_parts(F.col("final_url"))).withColumn("leaf_id", _node_id(F.col("parts")))
    return top_per_group(placed, ["leaf_id"], [F.desc("traffic"), "final_url"], 1)


def url_tree(merged: DataFrame) -> DataFrame:
    """One row per node with the sums of its subtree.

    Each page adds itself to all of its prefixes. The sums are combined before the shuffle, so the root of
    a site holding most pages arrives as one row per map task. The best keyword is that of the page with
    the most traffic below the node, then the one nearest to the node, then the smallest path.
    """
    c = F.col
    own = c("depth") == c("leaf_depth")
    keyword = F.coalesce(c("top_keyword"), F.lit(""))
    rank = F.struct((-c("traffic")).alias("t"), "leaf_depth", "leaf_id", keyword.alias("kw"))
    exploded = page_leaves(merged).select(
        "leaf_id",
        "final_url",
        "traffic",
        "keywords",
        "top_keyword",
        "in_sitemap",
        "parts",
        F.size("parts").alias("leaf_depth"),
        F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"),
    )
    nodes = exploded.select(
        "*", _node_id(F.slice(c("parts"), 1, c("depth"))).alias("node_id")
    ).drop("parts")
    return (
        nodes.groupBy("node_id", "depth")
        .agg(
            F.sum(exact(c("traffic"))).cast("double").alias("traffic"),
            F.count(F.lit(1)).alias("n_pages"),
            F.sum(exact(c("keywords"))).cast("double").alias("keywords"),
            F.coalesce(F.min(F.when(keyword != "", rank))["kw"], F.lit("")).alias("best_keyword"),
            F.max(F.when(own, c("final_url"))).alias("page_url"),
            F.max(F.when(own, c("in_sitemap"))).alias("page_in_sitemap"),
            F.max(F.when(own, keyword)).alias("page_keyword"),
        )
        .withColumns(
            {
                "label": F.regexp_extract(c("node_id"), r"([^/]*)$", 1),
                "parent_id": F.when(c("depth") > 1, F.regexp_replace(c("node_id"), r"/[^/]*$", "")).otherwise(""),
                "heat": heat(c("traffic")),
            }
        )
        .withColumn(
            "is_orphan",
            (c("traffic") == 0) & c("page_in_sitemap").isNotNull() & ~F.coalesce(c("page_in_sitemap"), F.lit(True)),
        )
    )


def tree_listing(tree: DataFrame) -> DataFrame:
    """Nodes with traffic, with the real URL of a page and the address of a directory."""
    c = F.col
    address = F.coalesce(c("page_url"), F.concat(F.lit("[目录组] https://"), c("node_id")))
    return (
        tree.filter(c("traffic") > 0)
        .select(
            "node_id", "label", "parent_id", "depth", "traffic", "keywords",
            F.when(c("best_keyword") == "", "无").otherwise(c("best_keyword")).alias("best_keyword"),
            "n_pages", address.alias("address"), "heat",
        )
        .orderBy("parent_id", F.desc("traffic"), "node_id")
    )


def _idle(tree: DataFrame) -> DataFrame:
    return tree.filter((F.col("traffic") == 0) & (F.col("depth") > 1))


def shown_nodes(tree: DataFrame, cap: int = 5) -> DataFrame:
    """Nodes of the folded tree: per directory all children with traffic and the first ``cap`` without.

    A node below a folded one is folded with it. Idle candidates are checked against their idle ancestors
    only, by joins on node ids.
    """
    c = F.col
    idle = _idle(tree)
    candidates = top_per_group(idle.select("node_id", "parent_id", "depth"), ["parent_id"], ["node_id"], cap)
    folded = idle.select(c("node_id").alias("ancestor_id")).join(
        candidates.select(c("node_id").alias("ancestor_id")), "ancestor_id", "left_anti"
    )
    parts = F.split(c("node_id"), "/")
    lineage = candidates.filter(c("depth") > 2).select(
        "node_id", F.explode(F.sequence(F.lit(2), c("depth") - 1)).alias("d")
    ).select("node_id", _node_id(F.slice(parts, 1, c("d"))).alias("ancestor_id"))
    hidden = lineage.join(folded, "ancestor_id", "left_semi").select("node_id").distinct()
    kept_idle = candidates.select("node_id").join(hidden, "node_id", "left_anti")
    return tree.join(kept_idle.withColumn("_kept", F.lit(True)), "node_id", "left").filter(
        (c("traffic") > 0) | (c("depth") == 1) | c("_kept")
    ).drop("_kept")


def hidden_counts(tree: DataFrame, cap: int = 5) -> DataFrame:
    """How many idle children each directory folds away."""
    return (
        _idle(tree)
        .groupBy("parent_id")
        .agg((F.count(F.lit(1)) - cap).alias("hidden_children"))
        .filter(F.col("hidden_children") > 0)
    )
