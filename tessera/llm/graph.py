"""Distributed connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _drawn(vertex: Column, round_no: int) -> Column:
    """A vertex with its place in this round's random order."""
    return F.struct(F.xxhash64(F.lit(round_no), vertex).alias("h"), vertex.alias("v"))


def _contraction(edges: DataFrame, round_no: int) -> DataFrame:
    """``node`` and ``to``: the first vertex, in an order drawn anew, that lies within two edges of each vertex."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("b")).agg(F.least(F.min(_drawn(F.col("b"), round_no)), F.min(_drawn(F.col("a"), round_no))).alias("first"))
    return both.join(first, "b").groupBy(F.col("a").alias("node")).agg(F.min("first")["v"].alias("to"))


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Component of every vertex with an edge: columns ``node`` and ``component`` (its smallest vertex).

    ``edges`` has two columns of one orderable type; direction, loops, repeats and nulls (ignored)
    don't matter.  Each round draws a new random order, maps a vertex to the first one within two edges of it
    and contracts the edges along that map.  A star vanishes in one round, and of a path a third of the
    vertices is left, whatever its names are, so the number of rounds grows with the logarithm of the
    longest chain.  Maps are joined from the last, smallest one back to the first, and every join is
    written, so no plan grows with the rounds.  Neighbour minima are combined before the shuffle and hubs
    meet only in equi-joins that adaptive execution can split, so a hub with a third of all edges is no hot
    task.  Edges and maps go through the shared folder; the driver sees only whether edges are left.
    ``rounds``, if given, collects the vertices that each round began with.
    """
    a, b = edges.columns
    left = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "edges")
    loops = left.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("to"))
    held, ends, steps = [left], left.where("a <> b"), []
    while not ends.isEmpty():
        step = materialize(_contraction(ends, len(steps)), "contraction")
        steps.append(step)
        if rounds is not None:
            rounds.append(step.count())
        for end in ("a", "b"):
            ends = ends.join(step.withColumnRenamed("node", end), end).withColumn(end, F.col("to")).drop("to")
        ends = materialize(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        held.append(ends)
    named = steps[-1] if steps else loops
    for step in reversed(steps[:-1]):
        on = named.select(F.col("node").alias("to"), F.col("to").alias("last"))
        named = materialize(step.join(on, "to", "left").select("node", F.coalesce("last", "to").alias("to")), "contraction")
        held.append(named)
    if steps:  # a vertex that has nothing but a loop is a component
        named = named.unionByName(loops.join(named.select("node"), "node", "left_anti"))
    smallest = named.groupBy("to").agg(F.min("node").alias("component"))
    found = materialize(named.join(smallest, "to").select("node", "component"), "components")
    for done in (*held, *steps):
        discard(done)
    return found
