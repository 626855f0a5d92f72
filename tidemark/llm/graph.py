"""Connected components of a graph that is only ever held in DataFrames.

Randomised contraction: in each round every node is replaced by the first of its closed
neighbourhood in a fresh pseudo-random order, which at least halves the nodes of a chain and
does better on anything denser. Work falls geometrically, so all rounds together read a few
times the links. A contracted graph of a fixed size or less is finished in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Table

#: Links that one task may finish.
AT_ONCE = 1 << 15


def _normal(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the nodes of a bounded number of links, by union-find."""
    parent: dict = {}

    def root(node):
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            for node in (a, b):
                parent.setdefault(node, node)
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(n) for n in nodes], kind)], ["node", "root"])


def components(edges: DataFrame, *, at_once: int = AT_ONCE, rounds: list | None = None) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b); a component is named by its least node.

    Links of a node with itself and repeated links change nothing; an empty table gives
    an empty table. `rounds` takes the number of links left after each round, for tests.
    """
    links, steps = Table(_normal(edges), "links"), []
    while (left := links.df.count()) > at_once:
        if rounds is not None:
            rounds.append(left)
        order = lambda c, turn=len(steps): F.xxhash64(c, F.lit(turn))
        ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
        near = links.df.select(F.explode(ways).alias("w")).select("w.*").groupBy("node").agg(F.min_by("near", order("near")).alias("near"))
        first = F.when(order("near") < order("node"), F.col("near")).otherwise(F.col("node"))
        step = Table(near.select("node", first.alias("rep")), "contraction")
        steps.append(step)
        side = lambda c: step.df.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep"))
        moved = links.df.join(side("a"), "a").join(side("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
        fewer = Table(_normal(moved), "links")
        links.drop()
        links = fewer
    if rounds is not None:
        rounds.append(left)
    kind = links.schema["a"].dataType.simpleString()
    found = Table(links.df.coalesce(1).mapInArrow(_finish, f"node {kind}, root {kind}"), "roots")
    links.drop()
    for step in reversed(steps):
        above = found.df.select(F.col("node").alias("rep"), "root")
        wider = Table(step.df.join(above, "rep", "left").select("node", F.coalesce("root", "rep").alias("root")), "roots")
        found.drop()
        step.drop()
        found = wider
    named = Table(found.df.groupBy("root").agg(F.min("node").alias("component")), "component-names")
    return found.df.join(named.df, "root").select("node", "component")
