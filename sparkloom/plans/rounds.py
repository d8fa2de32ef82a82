"""Loops by rounds of deterministic reservations.

Each round, every open item reserves its resources with its id; the least id wins a resource. Items that win all of theirs are committed, what
conflicts with them is closed, and the rest tries again. The outcome is that of taking items one by one in order of id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import release, settle


class TooManyRounds(RuntimeError):
    pass


def until_empty(state: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], name: str, limit: int = 10_000) -> DataFrame:
    """Apply step(open) -> (done, still open) until nothing is open; the union of what was done. Both results are written each round."""
    done: DataFrame | None = None
    for _ in range(limit):
        finished, rest = step(state)
        finished = settle(finished, f"{name}-done")
        old, state = state, settle(rest, f"{name}-open")
        release(old)
        done = finished if done is None else done.unionByName(finished)
        if state.isEmpty():
            return done
    raise TooManyRounds(f"{name}: not finished after {limit} rounds")


def reservations(items: DataFrame, item: str, resource: str, name: str = "reservations") -> DataFrame:
    """items: a row for each (item, resource). The items chosen greedily in order of id, each excluding all that share a resource with it."""

    def step(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        won = open_.groupBy(resource).agg(F.min(item).alias("__first"))
        asked = open_.join(won, resource)
        chosen = asked.groupBy(item).agg(F.bool_and(F.col(item) == F.col("__first")).alias("all")).where("all").select(item)
        used = open_.join(chosen, item, "left_semi").select(resource).distinct()
        closed = open_.join(used, resource, "left_semi").select(item).distinct()
        return chosen, open_.join(closed, item, "left_anti")

    return until_empty(items.distinct(), step, name)
