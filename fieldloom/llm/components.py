"""Connected components by contraction: trees of smallest neighbours, pointer jumps, reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldloom.session import checkpoint_dir


def roots_of(up: DataFrame, node: str, root: str) -> DataFrame:
    """(node, root) of `up`, one row a node as before, under these names.

    The plan says by grouping that a node has one row. Else Spark takes a join's size for the product of both sides, which a
    checkpoint keeps: over rounds of such joins that number doubles its digits each time, until the driver has no room for it.
    """
    return up.groupBy(F.col("node").alias(node)).agg(F.min("root").alias(root))


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for the nodes that have an edge to another one.

    Every node points to its smallest neighbour, if that is smaller; pointer jumps make stars of these trees in log of
    their depth; edges between stars are all that the next round has. Each round at least halves the nodes, so all rounds
    together read little more than the first one.
    """
    checkpoint_dir(edges.sparkSession)
    ends = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    left = edges.select(*ends("a", "b")).where("a <> b").distinct().checkpoint()
    of = None
    while of is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")).checkpoint()
        moved = True
        while moved:
            new = up.join(roots_of(up, "root", "then"), "root").select("node", F.col("then").alias("root"), (F.col("then") != F.col("root")).alias("moved")).checkpoint()
            moved = not new.where("moved").isEmpty()
            up = new.select("node", "root")
        side = lambda x: roots_of(up, x, f"r{x}")  # noqa: B023, E731
        left = left.join(side("a"), "a").join(side("b"), "b").where("ra <> rb").select(*ends("ra", "rb")).distinct().checkpoint()
        of = up if of is None else followed(of, up).checkpoint()
    return of


def followed(of: DataFrame, up: DataFrame) -> DataFrame:
    """(node, root) of `of` with the roots of its roots in `up`, and the nodes that only `up` has."""
    known = of.join(roots_of(up, "root", "then"), "root", "left").select("node", F.coalesce("then", "root").alias("root"))
    return known.unionByName(up.join(of.select("node"), "node", "left_anti").select("node", "root"))


def joined(of: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, root) with further edges (a, b), of which only the roots are read again."""
    side = lambda x: roots_of(of, x, f"r{x}")
    ends = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return followed(of, contracted(ends)).checkpoint()


def smallest_reachable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label, root): the smallest label, and the node that has it, of a node's component, for the nodes that have an
    edge (a, b). Null labels lose against others; of equal ones the smaller node has it."""
    of = contracted(edges)
    best = of.join(nodes, "node").groupBy("root").agg(F.min(F.struct(F.col("label").isNull().alias("none"), F.col("label"), F.col("node").alias("at"))).alias("best"))
    return of.join(best, "root").select("node", F.col("best.label").alias("label"), F.col("best.at").alias("root")).checkpoint()
