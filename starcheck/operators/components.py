"""Connected components by alternating large and small stars.

Kiveris et al., Connected Components in MapReduce and Beyond, SoCC 2014. Both steps need only the
smallest neighbour of each node, which is a partial aggregate, so a node with very many edges is
never gathered in one place.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcheck.operators.skew import ROWS_PER_TASK, lookup_join
from starcheck.session import cut

GROUP = "batch_id"


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour and its degree."""
    return edges.groupBy(GROUP, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_degree"))


def _with_least(edges: DataFrame, least: DataFrame, rows_per_task: int) -> DataFrame:
    return lookup_join(edges, least, [GROUP, "u"], "v", "_degree", rows_per_task=rows_per_task)


def _large_star(edges: DataFrame, rows_per_task: int) -> DataFrame:
    both = edges.unionByName(edges.select(GROUP, F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).withColumn("m", F.least("u", "m"))
    return _with_least(both.filter(F.col("v") > F.col("u")), least, rows_per_task).select(
        GROUP, F.col("v").alias("u"), F.col("m").alias("v")
    )


def _small_star(edges: DataFrame, rows_per_task: int) -> DataFrame:
    least = _least_neighbour(edges)
    moved = (
        _with_least(edges, least, rows_per_task)
        .filter(F.col("v") != F.col("m"))
        .select(GROUP, F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(least.select(GROUP, "u", F.col("m").alias("v"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node either points to one centre or is a centre."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")),
    )
    nodes = (
        edges.select(GROUP, F.inline(ends))
        .groupBy(GROUP, "node")
        .agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    )
    return nodes.filter((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("into") == 1))).isEmpty()


def connected_components(edges: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(batch_id, node, root) for every node that has an edge; root is the smallest node.

    `edges` has batch_id, u and v. Each round is checkpointed; the loop ends when only stars are
    left. The joins carry three numbers a row, and a hub is cut in parts of `rows_per_task` edges.
    """
    edges = edges.select(
        GROUP, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).filter(F.col("u") != F.col("v"))
    edges = cut(edges.distinct())
    while not _all_stars(edges):
        edges = cut(_small_star(cut(_large_star(edges, rows_per_task)), rows_per_task))
    roots = edges.select(GROUP, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(GROUP, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
