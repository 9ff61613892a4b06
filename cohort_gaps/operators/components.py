"""Connected components of any number of edges by random contraction over local union-find.

Edges are dealt to tasks of bounded size and each task unites its own. In every round nodes get new random priorities, a
local component is named by its node of least priority, and every node moves to the least of the names that it got; what
still joins different names are the edges of the next round. The draws do not follow the ids, so edges shrink by a
constant factor in the mean however the ids run: on a chain dealt to so many tasks that no two neighbours meet, the names
are the least of three nodes in a row, about half of all. The last round fits in one task of the same bounded size. A task needs its edges together, as arrays, which is why this operator leaves the JVM.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, scratch

# Edges of one task, in the mean.
EDGES = 1 << 20


def priorities(nodes: np.ndarray, turn: int) -> np.ndarray:
    """A number per node, drawn anew in every turn and different for different nodes."""
    x = nodes.astype(np.int64).view(np.uint64) ^ np.uint64((turn * 0x9E3779B97F4A7C15 + 0x1B873593) % (1 << 64))
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F), (32, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x.view(np.int64)


def local_roots(a: np.ndarray, b: np.ndarray, order: Callable[[np.ndarray], np.ndarray] | None = None
                ) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges and the smallest node of its component, by ``order`` of the nodes if that is given."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    if order is not None:
        ranked = np.argsort(order(nodes), kind="stable")
        rank = np.empty(len(nodes), np.int64)
        rank[ranked] = np.arange(len(nodes))
        nodes, places = nodes[ranked], rank[places]
    a, b = places[:len(a)], places[len(a):]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(before[a], before[b])
        # Both roots move, so that whole trees join at once.
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (before == root).all():
            return nodes, nodes[root]


def _unite(turn: int | None):
    """A task's work: ``(node, root, priority of the root)`` of its edges; without a turn the root is the smallest node."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in rows]
        if parts:
            both = [np.concatenate(x) for x in zip(*parts)]
            nodes, roots = local_roots(*both, order=None if turn is None else lambda n: priorities(n, turn))
            ranks = roots if turn is None else priorities(roots, turn)
            for at in range(0, len(nodes), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (nodes, roots, ranks)],
                                                 ["node", "root", "priority"])

    return batches


def connected_components(edges: DataFrame, left: str, right: str, smallest: bool = False,
                         per_task: int = EDGES) -> DataFrame:
    """``(node, component)`` for every node of an edge between two nodes, ``component`` being the largest node of its
    component, or with ``smallest`` the smallest. Edges with a missing end count for nothing.

    The edges are written first. A node with very many edges is spread over tasks, each of which hands on one row for it.
    A node that all lies in one task leaves with that round. Nothing but the number of edges reaches the driver, and the
    tables of a round go when the next one is written.
    """
    # Inside, roots are smallest nodes; for the largest the order is turned round.
    def turned(node: str):
        return F.col(node).cast("long") if smallest else F.bitwise_not(F.col(node).cast("long"))

    moves: list[DataFrame] = []
    with scratch(edges.sparkSession) as own:
        edges = cut_lineage(edges.select(turned(left).alias("a"), turned(right).alias("b")).filter("a <> b"))
        while True:
            turn, tasks = len(moves), max(1, -(-edges.count() // per_task))
            dealt = edges.repartition(tasks, F.xxhash64("a", "b", F.lit(turn))) if tasks > 1 else edges.repartition(1)
            forest = cut_lineage(dealt.mapInArrow(_unite(turn if tasks > 1 else None),
                                                  "node long, root long, priority long"))
            discard(edges)
            if tasks == 1:
                break
            move = cut_lineage(forest.groupBy("node").agg(F.min(F.struct("priority", "root")).alias("least"))
                               .select("node", F.col("least.root").alias("to")))
            moves.append(move)
            # A local component and all that its nodes moved to, then where its own name moved to.
            names = forest.join(move, "node").select("root", "to").distinct()
            names = names.join(move.withColumnsRenamed({"node": "root", "to": "moved"}), "root")
            edges = cut_lineage(names.filter("moved <> to").select(
                F.least("moved", "to").alias("a"), F.greatest("moved", "to").alias("b")).distinct())
            discard(forest)
        found = forest.select("node", F.col("root").alias("component"))
        for move in reversed(moves):
            later = found.withColumnRenamed("node", "to")
            found = move.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
        if moves:
            # Names were drawn; the smallest node of each takes its place.
            found = cut_lineage(found)
            least = found.groupBy("component").agg(F.min("node").alias("least"))
            found = cut_lineage(found.join(least, "component").select("node", F.col("least").alias("component")))
        own.keep_all_of([found])
    return found.select(turned("node").alias("node"), turned("component").alias("component"))
