"""Connected components of graph edges by contraction under a fresh random order each round."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import materialize

ALONE = 10_000


def _parents(edges: DataFrame, round_no: int) -> DataFrame:
    """(node, parent): the lowest of a node and its neighbours in this round's order, the step taken four times.

    A parent may itself have another parent. That loses no connection: both ends of an edge are replaced by nodes connected
    with them, and the edges between a node and its parent are replaced along.
    """
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_no)).alias("h"), F.col(c).alias("id"))
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    step = ends.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("low"))
    step = step.select("node", F.least("low", order("node")).getField("id").alias("parent"))
    for _ in range(2):
        step = step.join(step.select(F.col("node").alias("parent"), F.col("parent").alias("far")), "parent").select("node", F.col("far").alias("parent"))
    return step


def _search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) with the root of their component twice."""
    edges = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=object), *parts])
    root: dict = {}

    def find(x: object) -> object:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(edges["a"], edges["b"], strict=True):
        root[find(a)] = find(b)
    yield edges.assign(fa=[find(a) for a in edges["a"]], fb=[find(b) for b in edges["b"]])


def contractions(edges: DataFrame, alone: int = ALONE) -> list[DataFrame]:
    """One written table a round: the round's edges (a, b) with the parents of their ends (fa, fb).

    In a random order of the nodes about every third one of a chain is lower than both neighbours, and a part at least as
    large of any other graph falls away, so that the rounds are logarithmic in the nodes of a component, chains included.
    Once at most ``alone`` edges are left, one task searches them.
    """
    rounds: list[DataFrame] = []
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    while left := edges.limit(alone + 1).count():
        kind = edges.schema["a"].dataType.simpleString()
        if left <= alone:
            return [*rounds, materialize(edges.coalesce(1).mapInPandas(_search, ", ".join(f"{c} {kind}" for c in ("a", "b", "fa", "fb"))), "contraction")]
        parents = _parents(edges, len(rounds))
        for end in ("a", "b"):
            edges = edges.join(parents.select(F.col("node").alias(end), F.col("parent").alias(f"f{end}")), end)
        rounds.append(materialize(edges.select("a", "b", "fa", "fb"), "contraction"))
        edges = rounds[-1].where("fa <> fb").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()
    return rounds or [edges.select("a", "b", F.col("a").alias("fa"), F.col("b").alias("fb"))]


def connected(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node_id, component) of the nodes in ``edges`` (a, b); component is the smallest node id reachable."""
    return labels(contractions(edges, alone))


def labels(rounds: list[DataFrame]) -> DataFrame:
    roots = None
    for round_no, table in enumerate(reversed(rounds)):
        step = table.select("a", F.col("fa").alias("root")).unionByName(table.select(F.col("b").alias("a"), F.col("fb").alias("root"))).distinct()
        if roots is not None:
            far = roots.select(F.col("a").alias("root"), F.col("root").alias("far"))
            step = step.join(far, "root", "left").select("a", F.coalesce("far", "root").alias("root"))
        # each round has a part of the nodes of the one before; plans are cut now and then
        roots = materialize(step, "roots") if round_no % 4 == 3 else step
    roots = materialize(roots, "roots")
    lowest = roots.groupBy("root").agg(F.min("a").alias("component"))
    return roots.join(lowest, "root").select(F.col("a").alias("node_id"), "component")
