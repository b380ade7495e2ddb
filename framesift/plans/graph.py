"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framesift.plans.shared import write_shared


def _rank(node: Column, number: int) -> Column:
    """Even rounds order nodes by themselves, odd ones by a hash that each round draws anew."""
    return F.struct(node.alias("node")) if number % 2 == 0 else F.struct(F.xxhash64(F.lit(number), node).alias("hash"), node.alias("node"))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; direction, loops, repeats and nulls
    do not matter.  Returns (node, component).  Each round names every node after the first node of its
    neighbourhood (itself included; a grouped minimum, combined before the shuffle), puts the names in the
    place of the ends of the edges and drops loops and repeats, so the edges of stars are gone after one round.
    The order of nodes alternates between their own, which ends stars around their least node, and a new
    random one, which removes a constant share of the nodes of any graph a round, chains included (randomised
    contraction).  Names are written tables and are followed once, at the end.  Only whether edges are left
    reaches the driver.  Raises if any are left after ``max_rounds``.
    """
    kept = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = write_shared(kept.distinct(), "links")
    names: list[DataFrame] = []
    for number in range(max_rounds):
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select(F.col("b"), F.col("a")))
        first = ends.groupBy("node").agg(F.min(_rank(F.col("other"), number)).alias("first"))
        named = write_shared(first.select("node", F.least("first", _rank(F.col("node"), number))["node"].alias("name")), "names")
        names.append(named)
        a, b = named.select(F.col("node").alias("at"), F.col("name").alias("x")), named.select(F.col("node").alias("bt"), F.col("name").alias("y"))
        renamed = left.join(a, left["a"] == F.col("at")).join(b, left["b"] == F.col("bt")).where("x <> y")
        left = write_shared(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    found = names[-1].select("node", F.col("name").alias("component"))
    for named in reversed(names[:-1]):
        beyond = found.select(F.col("node").alias("of"), F.col("component").alias("beyond"))
        found = named.join(beyond, named["name"] == F.col("of"), "left").select("node", F.coalesce("beyond", "name").alias("component"))
    if len(names) == 1:  # every name is its component's least node
        return found
    found = write_shared(found, "members")
    least = found.groupBy(F.col("component").alias("of")).agg(F.min("node").alias("least"))
    return found.join(least, F.col("component") == F.col("of")).select("node", F.col("least").alias("component"))
