"""Connected components of an edge table by hooking and contraction, in a number of rounds that grows with the logarithm of the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

HOT = 100_000  # rows of one key that are looked up by broadcast


def looked_up(rows: DataFrame, key: str, table: DataFrame, n: int = 0, hot: DataFrame | None = None) -> DataFrame:
    """rows left-joined to table by key. Keys of more than HOT rows are broadcast, so none makes a hot task: those in
    `hot`, or those found in rows, of which there are n at most and so n / HOT such keys."""
    if hot is None:
        if n <= HOT:
            return rows.join(table, key, "left")
        hot = written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(key), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, key, "left")
    few = F.broadcast(hot)
    known = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, "left")
    return known.unionByName(rows.join(few, key, "left_anti").join(table, key, "left"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every node of edges(a long, b long).

    A round hooks each node to its first neighbour, if that comes before itself, follows hooks twice (four steps) and contracts the
    edges to those between labels, distinct. In every second round the order is that of the numbers, which joins
    stars at once; in the others it is a new random one, by which at most half of the nodes are expected to come before all their neighbours,
    whatever the graph. Every round's tables are written to the shared folder, so the lineage stays short. Nothing
    but counts comes to the driver.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mapping, nodes, turn = None, 0, 0
    while n := left.count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(F.col(c), F.lit(t)))
        met = both.groupBy("a").agg(F.min(order("b")).alias("first"), F.min_by("b", order("b")).alias("b"))
        hook = written(met.select("a", F.when(F.col("first") < order("a"), F.col("b")).otherwise(F.col("a")).alias("to")), "hooks")
        for _ in range(2):
            up = hook.where("a <> to").select(F.col("a").alias("to"), F.col("to").alias("further"))
            hook = looked_up(hook, "to", up, 2 * n).select("a", F.coalesce("further", "to").alias("to"))
        hook = written(hook, "labels")
        if mapping is None:
            mapping, nodes = hook.select(F.col("a").alias("node"), F.col("to").alias("label")), hook.count()
        else:
            mapping = written(looked_up(mapping, "label", hook.withColumnRenamed("a", "label"), nodes).select("node", F.coalesce("to", "label").alias("label")), "mapping")
        a, b = hook.select("a", F.col("to").alias("x")), hook.select(F.col("a").alias("b"), F.col("to").alias("y"))
        met = looked_up(looked_up(left, "a", a, n), "b", b, n)
        left = written(met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
    if mapping is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    least = mapping.groupBy("label").agg(F.min("node").alias("component"))
    return looked_up(mapping, "label", least, nodes).select("node", "component")
