"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import dropped, written


def _edges(a, b, links: DataFrame) -> DataFrame:
    """Each link once, from the lesser to the greater id."""
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b) with a different partner: the least id that can be reached.

    In each round every id points at its least neighbour, pointers jump until they stand on a root, and links are
    renamed to roots: those within a tree vanish. Every tree holds two ids or more, so the ids halve at
    least, and a star of any size takes one round. Every step is a written table; nothing is collected but whether rows
    are left. A hot id meets a single row of the other side in each join, so that its rows can be split among tasks.
    """
    edges = written(_edges("a", "b", links), "edges")
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        near = edges.select(F.col("b").alias("id"), F.col("a").alias("up")).union(edges.select("a", "a"))
        near = written(near.groupBy("id").agg(F.min("up").alias("up")), "near")
        while True:
            top = near.select(F.col("id").alias("mid"), F.col("up").alias("top"))
            jumped = written(near.join(top, F.col("up") == F.col("mid")).select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "near")
            dropped(near)
            near = jumped.select("id", "up")
            if not jumped.where("moved").limit(1).count():
                break
        steps.append(near)
        of_a, of_b = near.select(F.col("id").alias("a"), F.col("up").alias("x")), near.select(F.col("id").alias("b"), F.col("up").alias("y"))
        left = written(_edges("x", "y", edges.join(of_a, "a").join(of_b, "b")), "edges")
        dropped(edges)
        edges = left
    dropped(edges)
    if not steps:
        return links.limit(0).select(F.col("a").alias("id"), F.col("a").alias("component"))
    out = steps.pop()
    for step in reversed(steps):
        later = out.select(F.col("id").alias("mid"), F.col("up").alias("top"))
        out = step.join(later, F.col("up") == F.col("mid"), "left").select("id", F.coalesce("top", "up").alias("up"))
    return out.withColumnRenamed("up", "component")
