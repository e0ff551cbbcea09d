"""Connected components by randomised contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatsql.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """links(a long, b long) -> (node, root), one row for each node that has a link to another.

    Each round, every node joins the neighbour (or itself) with the least random rank of that round, and
    links are redrawn between what is left; the expected number of rounds is logarithmic whatever the
    shape of the components. Rounds end when no link is left. Nulls and self-links are ignored.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = scratch.write(pairs.union(pairs.select("b", "a")).distinct(), f"{name}-edges0")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(steps)
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        best = edges.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("to"))).alias("best"))
        step = scratch.write(best.select("node", F.when(F.col("best.rank") < rank("node"), F.col("best.to")).otherwise(F.col("node")).alias("parent")), f"{name}-step{turn}")
        steps.append(step)
        ends = {c: step.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_to")) for c in "ab"}
        moved = edges.join(ends["a"], "a").join(ends["b"], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct()
        edges = scratch.write(moved, f"{name}-edges{turn + 1}")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].select("node", F.col("parent").alias("root"))
    for step in steps[1:]:
        roots = roots.join(step.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return scratch.write(roots, f"{name}-roots")
