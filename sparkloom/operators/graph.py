"""Graph operators on edge lists: tables of (u, v), with a dense edge id `eid` where one is needed.

Loops run by rounds; each round is a small plan over tables in the shared folder, and one number tells whether to go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import blocks, rounds
from ..plans.tables import dealt, release, settle
from ..sources.generators import unit


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return dealt(both, 2 * edges.count(), "u", "v").distinct()


def edge_array(adjacency: DataFrame) -> DataFrame:
    """eid, u, v of each undirected edge once (u < v), ids in order of (u, v)."""
    once = settle(adjacency.select("u", "v").where("u < v").distinct(), "edges")
    return blocks.dense_index(once, "u", "v", name="eid", rows=once.count())


def weighted_edge_array(adjacency: DataFrame, seed: int = 0) -> DataFrame:
    """edge_array with a weight in [0, 1) from a hash of the edge id."""
    return edge_array(adjacency).withColumn("weight", unit(seed, F.col("eid")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.count("*").alias("degree"))


def bfs(edges: DataFrame, source: int) -> tuple[DataFrame, int]:
    """(vertex, distance, parent) of all vertices reached along edges, and the rounds: eccentricity of the source + 1.

    A parent is the smallest vertex of the round before with an edge to the vertex.
    """
    spark, edges = edges.sparkSession, settle(edges.select("u", "v"), "bfs-edges")
    frontier = spark.range(1).select(F.lit(source).cast("long").alias("vertex"), F.lit(0).alias("distance"), F.lit(None).cast("long").alias("parent"))
    visited, k = settle(frontier, "bfs"), 0
    frontier = visited
    while not frontier.isEmpty():
        k += 1
        reached = frontier.select(F.col("vertex").alias("u")).join(edges, "u").groupBy(F.col("v").cast("long").alias("vertex")).agg(F.min("u").cast("long").alias("parent"))
        fresh = reached.join(visited, "vertex", "left_anti").select("vertex", F.lit(k).alias("distance"), "parent")
        frontier = settle(fresh, "bfs")
        visited = visited.unionByName(frontier)
        if k % 16 == 0:  # so that a long way does not read as many tables as it has rounds
            visited = settle(visited, "bfs")
    return visited, k


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """vertex, root (the smallest vertex of its component), by alternating large and small stars."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    all_ = edges.select(F.col("u").cast("long").alias("vertex")).union(edges.select(F.col("v").cast("long"))).distinct()
    all_ = all_ if vertices is None else all_.union(vertices.select(F.col("vertex").cast("long"))).distinct()
    e = settle(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "stars")
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settle(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, e = e, settle(small.where("u <> v").distinct(), "stars")
        release(old, large)
        after = state(e)
        if after == before:
            break
        before = after
    return all_.join(e.select(F.col("u").alias("vertex"), F.col("v").alias("root")), "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))


def independent_set(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The lexicographically first maximal independent set: column vertex.

    Each round takes every open vertex without a smaller open neighbour and closes its neighbours.
    """
    both = symmetric(edges.where("u <> v"))

    def step(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        live = both.join(open_.select(F.col("vertex").alias("u")), "u", "left_semi").join(open_.select(F.col("vertex").alias("v")), "v", "left_semi")
        smaller = live.where("v < u").select(F.col("u").alias("vertex")).distinct()
        taken = open_.join(smaller, "vertex", "left_anti")
        closed = live.join(taken.select(F.col("vertex").alias("u")), "u", "left_semi").select(F.col("v").alias("vertex")).distinct()
        return taken, open_.join(taken, "vertex", "left_anti").join(closed, "vertex", "left_anti")

    return rounds.until_empty(settle(vertices.select(F.col("vertex").cast("long")).distinct(), "vertices"), step, "independent-set")


def matching(edges: DataFrame) -> DataFrame:
    """eid of the maximal matching that takes edges in order of id; loops are skipped."""
    real = edges.where("u <> v")
    held = real.select("eid", F.col("u").alias("end")).union(real.select("eid", F.col("v").alias("end")))
    return rounds.reservations(settle(held, "edge-ends"), "eid", "end", "matching").select("eid")


def _hooked(picked: DataFrame) -> DataFrame:
    """picked: u, v, one row for each u; every v is a u. u, root: picks lead along trees to one pair that picks each other, whose smaller vertex is the root. Ways are halved until all are done."""
    other = picked.select(F.col("u").alias("v"), F.col("v").alias("w"))
    ways = settle(picked.join(other, "v").select("u", F.when((F.col("w") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("root")), "forest-ways")
    while True:
        further = ways.select(F.col("u").alias("root"), F.col("root").alias("next"))
        halved = settle(ways.join(further, "root").select("u", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "forest-ways")
        release(ways)
        ways = halved
        if ways.where("moved").isEmpty():
            return ways


def minimum_forest(edges: DataFrame) -> DataFrame:
    """eid of the minimum spanning forest under (weight, eid), which is unique; by rounds of least outgoing edges."""
    live = settle(edges.where("u <> v").select("eid", "weight", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "forest-edges")
    found: DataFrame | None = None
    while True:
        both = live.select("u", F.struct("weight", "eid").alias("key"), "v").union(live.select("v", F.struct("weight", "eid"), F.col("u").alias("v")))
        picked = settle(both.groupBy("u").agg(F.min(F.struct("key", "v")).alias("x")).select("u", "x.v", F.col("x.key.eid").alias("eid")), "forest-picked")
        if picked.isEmpty():
            return live.select("eid") if found is None else found
        chosen = picked.select("eid").distinct()
        found = chosen if found is None else found.union(chosen)
        roots = _hooked(picked.select("u", "v"))
        moved = live.join(roots.select("u", F.col("root").alias("ru")), "u").join(roots.select(F.col("u").alias("v"), F.col("root").alias("rv")), "v")
        moved = moved.where("ru <> rv").select("eid", "weight", F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        # Of edges between the same two components only the least can be taken.
        old, live = live, settle(moved.groupBy("u", "v").agg(F.min(F.struct("weight", "eid")).alias("x")).select(F.col("x.eid").alias("eid"), F.col("x.weight").alias("weight"), "u", "v"), "forest-edges")
        release(old, roots)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """eid of a spanning forest: the one of least ids, so the result is the same however it is computed."""
    return minimum_forest(edges.select("eid", F.col("eid").alias("weight"), "u", "v"))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").cast("long").alias("vertex")).union(edges.select(F.col("v").cast("long"))).distinct()


def adjacency(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """vertex, neighbours (ascending): the list form, for output only."""
    edges = settle(edges.select(F.col("u").alias("vertex"), "v"), "edges")
    return dealt(edges, edges.count(), "vertex").groupBy("vertex").agg(F.sort_array(F.collect_list("v")).alias("neighbours"))
