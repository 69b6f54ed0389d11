"""Edges joined end to end over their gaps, by list ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenejobs.functions.tables import written

_STATE = ["image_id", "edge_id", "back"]


def _ranked(steps: DataFrame) -> DataFrame:
    """image_id, edge_id, back, last_edge, last_back, hops, least, ring of every state in steps.

    A state is an edge travelled forward or back; steps lead from one to the next (next_edge,
    next_back), at most one from each and to each. Each round doubles the way that a state
    looks ahead. Chains arrive at their last state, hops steps on, and stop. Once the way is
    longer than any image has states, what still moves is a ring, and least is its smallest edge.
    """
    ahead = F.struct(F.col("next_edge").alias("edge_id"), F.col("next_back").alias("back"))
    starts = steps.select(*_STATE, ahead.alias("ahead"), F.lit(1).cast("long").alias("hops"))
    ends = steps.select("image_id", F.col("next_edge").alias("edge_id"), F.col("next_back").alias("back")).join(steps.select(*_STATE), _STATE, "left_anti")
    ends = ends.select(*_STATE, F.struct("edge_id", "back").alias("ahead"), F.lit(0).cast("long").alias("hops"))
    states = written(starts.unionAll(ends).withColumns({"least": F.least("edge_id", "ahead.edge_id"), "open": F.col("hops") > 0}))
    most, way = states.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0, 1
    while way < 4 * most and not states.where("open").isEmpty():
        far = states.select("image_id", F.struct("edge_id", "back").alias("ahead"), F.col("ahead").alias("then"), F.col("hops").alias("more"), F.col("least").alias("other"))
        moved = states.where("open").join(far, ["image_id", "ahead"]).select(*_STATE, F.col("then").alias("ahead"), (F.col("hops") + F.col("more")).alias("hops"), F.least("least", "other").alias("least"), (F.col("more") > 0).alias("open"))
        states, way = written(moved.unionByName(states.where("NOT open"))), way * 2
    return states.select(*_STATE, F.col("ahead.edge_id").alias("last_edge"), F.col("ahead.back").alias("last_back"), "hops", "least", F.col("open").alias("ring"))


def splice_gaps(edges: DataFrame, terminals: DataFrame, pairs: DataFrame) -> DataFrame:
    """image_id, edge_id, edges, path, d: edges joined to one over each pair of terminals; d is the number of steps of the path.

    edges has image_id, edge_id, path (an array); terminals has image_id, terminal, edge_id, at_end
    (whether the edge's path ends there or begins); pairs has image_id, a, b, terminals of
    different edges, each terminal once at most (see close_gaps()). Paths of a chain of edges
    follow each other whole, each turned the way that the chain runs: from the smaller
    of its two outer edges; a ring begins with its smallest edge, as it is. edge_id is the
    smallest of the edges, edges lists them in order as struct edge_id, back. Edges without
    a pair stay as they are. A chain of n edges takes about log2(n) rounds.
    """
    side = terminals.select("image_id", "terminal", "edge_id", "at_end")
    out = side.select("image_id", F.col("terminal").alias("a"), "edge_id", (~F.col("at_end")).alias("back"))
    into = side.select("image_id", F.col("terminal").alias("b"), F.col("edge_id").alias("next_edge"), F.col("at_end").alias("next_back"))
    both = pairs.select("image_id", "a", "b").unionAll(pairs.select("image_id", F.col("b"), F.col("a")))
    steps = written(both.join(out, ["image_id", "a"]).join(into, ["image_id", "b"]).select(*_STATE, "next_edge", "next_back"))
    ranked = _ranked(steps)
    rings = ranked.where("ring").select(*_STATE, "least")
    if not rings.isEmpty():  # cut before the least edge, and on the way back behind it
        opened = steps.join(rings, _STATE).where(~((F.col("next_edge") == F.col("least")) & ~F.col("next_back")) & ~((F.col("edge_id") == F.col("least")) & F.col("back"))).drop("least")
        ranked = ranked.where("NOT ring").unionByName(_ranked(written(opened)))
    chain = ["image_id", "last_edge", "last_back"]
    firsts = ranked.groupBy(*chain).agg(F.max_by("edge_id", "hops").alias("first"), F.min("edge_id").alias("name"), F.max("hops").alias("size")).where("first < last_edge")
    members = written(ranked.join(firsts, chain).select("image_id", "name", (F.col("size") - F.col("hops")).alias("pos"), "edge_id", "back"))
    parts = members.join(edges.select("image_id", "edge_id", "path"), ["image_id", "edge_id"])
    travelled = F.when(F.col("back"), F.reverse("path")).otherwise(F.col("path"))
    joined = parts.groupBy("image_id", "name").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("edge_id", "back").alias("edge"), travelled.alias("path")))).alias("p"))
    joined = joined.select("image_id", F.col("name").alias("edge_id"), F.col("p.edge").alias("edges"), F.flatten("p.path").alias("path"))
    alone = edges.join(members, ["image_id", "edge_id"], "left_anti").select("image_id", "edge_id", F.array(F.struct("edge_id", F.lit(False).alias("back"))).alias("edges"), "path")
    return joined.unionByName(alone).withColumn("d", F.size("path") - 1)
