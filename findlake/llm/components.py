"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.shared import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of `edges` (a long, b long); component is the smallest id reachable.

    Alternating large-star and small-star rounds: each moves every edge towards the smallest neighbour, and the edges
    end as stars around the components' smallest ids after a number of rounds about logarithmic in the longest path.
    Edges are written to the shared folder after each round, so a lost executor costs one round at most. Nothing is
    gathered per node: the smallest neighbour is an aggregate with map-side partial sums, and the join back to the
    edges is one that adaptive execution can split where a node has very many neighbours.
    If the edges still change after `max_rounds` rounds an error is raised: a component that is not joined never comes out.
    An empty input gives an empty result; self-links and repeated edges change nothing; null ends are left out.
    """
    flat = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v and a is not null and b is not null").distinct()
    flat = materialise(flat, "edges")
    seen = None
    for _ in range(max_rounds):
        state = tuple(flat.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if not state[0] or state == seen:
            break
        seen = state
        both = flat.union(flat.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the larger neighbours of u are linked to u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        flat = materialise(small, "edges")
    else:
        raise RuntimeError(f"components are not joined after {max_rounds} rounds")
    roots = flat.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return roots.union(roots.select(F.col("component").alias("id"), "component").distinct())
