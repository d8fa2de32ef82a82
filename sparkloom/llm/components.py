"""Connected components of links between signatures, by the engine's graph operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, root for every node but the roots; a root is the smallest node of its component."""
    found = graph.components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.where("vertex <> root").select(F.col("vertex").alias("node"), "root")
