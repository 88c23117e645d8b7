"""Joins of many rows with a table of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_dimension(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi join in which a key may hold a large share of the facts.

    Adaptive execution splits the facts of a hot key over as many tasks as their measured size asks for and repeats
    only that key's one row, whatever the size; ``session.get_spark`` lets it do so also where an aggregation follows.
    Small dimensions are broadcast by the planner, by their measured size.
    """
    return facts.join(dim, on, how)
