"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node. The vectors of a label are dealt to shards of bounded size, every shard is indexed and queried
by all vectors of its label, in blocks that read the same stored graph. Beams widen until an audit against brute force passes; every link is verified by
its cosine in double precision, and linked vectors are united.
"""
from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage
from .text import _mix

COSINE = 0.98
# Most vectors of a shard, in the mean; a task holds one shard and one block of queries of this size.
SHARD = 8192
NEIGHBOURS, BUILD_BEAM, FIRST_BEAM, ENTRIES, WIDEN = 16, 48, 32, 4, 4
# Queries of a block audited against brute force, and the share that must be found of their links to other vectors; a query
# without a link must find the vector nearest to it instead, so that there is always something to find.
AUDITED, RECALL = 64, 0.99
QUERIES = 512


class Graph:
    """A small-world graph over unit vectors; row 0 of ``layers`` is the ground layer that holds every vector."""

    def __init__(self, vectors: np.ndarray, names: np.ndarray) -> None:
        self.vectors = vectors
        draw = (_mix(names.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        levels = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(NEIGHBOURS)).astype(int)
        self.order = np.lexsort((np.arange(len(names)), -levels))
        top = int(levels.max())
        self.entry = int(self.order[0])
        self.layers: list[np.ndarray] = []
        for level in range(top + 1):
            width = NEIGHBOURS * (2 if level == 0 else 1)
            self.layers.append(np.full((len(names), width), -1, np.int32))
        for level in range(top, -1, -1):
            self._build(level, self.order[levels[self.order] >= level])

    def stored(self) -> bytes:
        """The links, without the vectors."""
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"layer{k}": layer for k, layer in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def restored(cls, vectors: np.ndarray, stored: bytes) -> Graph:
        """The graph over the same vectors in the same order."""
        own = cls.__new__(cls)
        with np.load(io.BytesIO(stored)) as parts:
            own.vectors, own.entry = vectors, int(parts["entry"])
            own.layers = [parts[f"layer{k}"] for k in range(len(parts.files) - 1)]
        return own

    def _build(self, level: int, members: np.ndarray) -> None:
        """Insert the members of a layer in growing batches; a batch also meets itself, as far as it is close."""
        done = 1
        while done < len(members):
            batch = members[done:done + min(done * 2, QUERIES)]
            queries = self.vectors[batch]
            near, sims = self._search(queries, self._descend(queries, level, ENTRIES), level, BUILD_BEAM)
            among = queries @ queries.T
            np.fill_diagonal(among, -np.inf)
            most = min(NEIGHBOURS, len(batch) - 1)
            if most:
                own = np.argpartition(-among, most - 1, axis=1)[:, :most]
                near = np.concatenate((near, batch[own].astype(np.int32)), 1)
                sims = np.concatenate((sims, np.take_along_axis(among, own, 1)), 1)
            self._connect(level, batch, near, sims)
            done += len(batch)

    def _connect(self, level: int, batch: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        links = self.layers[level]
        chosen = self._diverse(near, sims, NEIGHBOURS)
        links[batch, :NEIGHBOURS] = chosen
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        # The nearest new links of each node join its old ones.
        closeness = np.einsum("kd,kd->k", self.vectors[source], self.vectors[target])
        order = np.lexsort((-closeness, target))
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, counts)
        near_enough = place < 2 * NEIGHBOURS
        fresh = np.full((len(nodes), 2 * NEIGHBOURS), -1, np.int32)
        fresh[np.repeat(np.arange(len(nodes)), counts)[near_enough], place[near_enough]] = source[near_enough]
        for at in range(0, len(nodes), 1024):
            own = nodes[at:at + 1024]
            old = links[own]
            new = fresh[at:at + 1024]
            new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)
            both = np.concatenate((old, new), 1)
            sims = np.einsum("rkd,rd->rk", self.vectors[np.maximum(both, 0)], self.vectors[own])
            sims[both < 0] = -np.inf
            links[own] = self._diverse(both, sims, links.shape[1])

    def _diverse(self, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in order of similarity, those first that are closer to the new vector than to one chosen before."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, :3 * most]
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        rows, width = near.shape
        valid = (near >= 0) & np.isfinite(sims)
        vectors = self.vectors[np.maximum(near, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        chosen = np.zeros((rows, width), bool)
        for k in range(width):
            clash = (chosen & (between[:, k, :] > sims[:, k, None])).any(1)
            chosen[:, k] = valid[:, k] & ~clash & (chosen.sum(1) < most)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        pick = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(near, pick, 1).astype(np.int32)
        out[~np.take_along_axis(valid, pick, 1)] = -1
        if out.shape[1] < most:
            out = np.concatenate((out, np.full((rows, most - out.shape[1]), -1, np.int32)), 1)
        return out

    def _descend(self, queries: np.ndarray, level: int, width: int) -> np.ndarray:
        """Up to ``width`` entries of each query for a layer: the nearest vectors found on the layer above.

        Several entries reach groups of vectors so tight that their links do not lead out of them.
        """
        at = np.full((len(queries), 1), self.entry, np.int32)
        for above in range(len(self.layers) - 1, level, -1):
            at = self._search(queries, at, above, max(width, 2))[0]
        return at

    def _search(self, queries: np.ndarray, entries: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest vectors found for each query on a layer, all queries one step at a time."""
        links, rows = self.layers[level], np.arange(len(queries))
        ids = np.full((len(queries), beam), -1, np.int32)
        sims = np.full((len(queries), beam), -np.inf, np.float32)
        open_ = np.zeros((len(queries), beam), bool)
        seen = np.zeros((len(queries), len(self.vectors)), bool)
        entries = entries[:, :beam]
        begun = np.arange(entries.shape[1])
        ids[:, begun], open_[:, begun] = entries, entries >= 0
        sims[:, begun] = np.where(entries >= 0, np.einsum("rkd,rd->rk", self.vectors[np.maximum(entries, 0)], queries), -np.inf)
        real = np.nonzero(entries >= 0)
        seen[real[0], entries[real]] = True
        active = rows
        while len(active):
            best = np.where(open_[active], sims[active], -np.inf).argmax(1)
            more = open_[active, best]
            active, best = active[more], best[more]
            if not len(active):
                break
            open_[active, best] = False
            step = links[ids[active, best]]
            fresh = (step >= 0) & ~seen[active[:, None], np.maximum(step, 0)]
            real = np.nonzero(fresh)
            seen[active[real[0]], step[real]] = True
            found = np.einsum("rkd,rd->rk", self.vectors[np.maximum(step, 0)], queries[active])
            found[~fresh] = -np.inf
            all_sims = np.concatenate((sims[active], found), 1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], step), 1), keep, 1)
            open_[active] = np.take_along_axis(np.concatenate((open_[active], fresh), 1), keep, 1)
        ids[~np.isfinite(sims)] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def nearest(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """``[query, place]`` of the vectors that a beam ends with."""
        return self._search(queries, self._descend(queries, 0, max(ENTRIES, beam // 8)), 0, beam)[0]

    def within(self, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """For each query the vectors found at ``least`` or nearer.

        The beam of a query whose results are all near doubles. A query with still more near vectors than WIDEN first beams
        hold is in a group so dense that it is compared with the whole shard.
        """
        widest = WIDEN * beam
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(queries)
        left = np.arange(len(queries))
        while len(left):
            if beam > widest:
                for at in range(0, len(left), QUERIES):
                    near = queries[left[at:at + QUERIES]] @ self.vectors.T >= least
                    for q, row in zip(left[at:at + QUERIES], near):
                        out[q] = np.flatnonzero(row).astype(np.int32)
                break
            beam = min(beam, len(self.vectors))
            again = []
            size = max(16, QUERIES * FIRST_BEAM // beam)
            for at in range(0, len(left), size):
                part = left[at:at + size]
                entries = self._descend(queries[part], 0, max(ENTRIES, beam // 8))
                ids, sims = self._search(queries[part], entries, 0, beam)
                for q, i, s in zip(part, ids, sims):
                    if s[-1] >= least and beam < len(self.vectors):
                        again.append(q)
                    else:
                        out[q] = i[(s >= least) & (i >= 0)]
            left, beam = np.array(again, int), beam * 2
        return out


def audited_links(graph: Graph, queries: np.ndarray, own: np.ndarray, least: float) -> list[np.ndarray]:
    """Results of ``within`` with a beam wide enough that an audit of spread queries passes; ``own`` is the place of each
    query in the shard, or -1, and being found by itself counts for nothing.

    A beam of half the shard is as good as no graph: then every vector of the shard is compared.
    """
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    sims = queries[sample] @ graph.vectors.T
    inside = np.flatnonzero(own[sample] >= 0)
    sims[inside, own[sample[inside]]] = -np.inf
    links, nearest = sims >= least, sims.argmax(1)
    linked, lone = np.flatnonzero(links.any(1)), np.flatnonzero(~links.any(1))
    wanted = RECALL * (links.sum() + len(lone))
    beam = FIRST_BEAM
    while 2 * beam < len(graph.vectors):
        found = sum(links[q, near].sum() for q, near in zip(linked, graph.within(queries[sample[linked]], least, beam)))
        found += (graph.nearest(queries[sample[lone]], beam) == nearest[lone, None]).sum()
        if found >= wanted:
            return graph.within(queries, least, beam)
        beam *= 2
    out = []
    for at in range(0, len(queries), QUERIES):
        near = queries[at:at + QUERIES] @ graph.vectors.T >= least
        out += [np.flatnonzero(row).astype(np.int32) for row in near]
    return out


def _unit(table: pa.Table) -> np.ndarray:
    column = table["embedding"].combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    values /= np.abs(values).max(1, keepdims=True)  # keeps squares in range
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each component of the pairs."""
    root = np.arange(size)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (before == root).all():
            break
    return root


def link_group(table: pa.Table, stored: bytes, least: float = COSINE) -> pa.Table:
    """``(a, b, n)`` of one shard and one block of queries: ``n`` copies linked to ``a`` here, ``b`` a vector of its component.

    ``stored`` is the shard's graph over its vectors in the order of ``rep``. With ``role`` 0 only, the shard is queried by itself and each pair counts once.
    """
    table = table.sort_by([("role", "ascending"), ("rep", "ascending")])
    role, rep, copies = (table[c].to_numpy() for c in ("role", "rep", "copies"))
    unit = _unit(table)
    shard, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    alone = len(asked) == 0
    asked = shard if alone else asked
    single = unit.astype(np.float32)
    graph = Graph.restored(single[shard], stored)
    places = np.arange(len(shard)) if alone else np.full(len(asked), -1)
    found = audited_links(graph, single[asked], places, least - 1e-5)
    a = np.repeat(asked, [len(f) for f in found])
    b = shard[np.concatenate(found)] if len(found) else np.zeros(0, int)
    if alone:
        # A pair found from one end only counts for both.
        a, b = np.minimum(a, b), np.maximum(a, b)
        a, b = np.unique(np.stack((a[a < b], b[a < b])), axis=1) if (a < b).any() else (a[:0], b[:0])
    good = np.concatenate([(unit[a[k:k + 65536]] * unit[b[k:k + 65536]]).sum(1) >= least
                           for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])
    a, b = a[good], b[good]
    n = np.bincount(a, copies[b], minlength=len(rep)) + np.bincount(b, copies[a], minlength=len(rep))
    root = _roots(len(rep), a, b)
    kept = np.flatnonzero(n > 0)
    return pa.table({"a": rep[kept], "b": rep[root[kept]], "n": n[kept].astype(np.int64)})


def near_duplicates(vectors: DataFrame, least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors (vec_id, embedding, label)``.

    Vectors are compared inside a label and a dimension. A row whose label, id or vector is null, whose vector is zero,
    empty or has a null or non-finite component links with nothing: no links, its own component. Repeated rows are further
    vectors, and different vectors with one id stay apart. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable
                     & F.exists("embedding", lambda x: x != 0), F.lit(False))
    nodes = cut_lineage(rows.filter(fit).groupBy("label", "embedding").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).select(
        # Vectors are known by a number of their own: different ones may share an id.
        "*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("rep")))
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("long").alias("shards"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("shards")))
    columns = ["label", "dim", "rep", "copies", "embedding"]
    index = dealt.select(*columns, F.col("own").alias("shard"), F.lit(0).alias("role"),
                         F.explode(F.expr("sequence(own, shards - 1)")).alias("block"))
    asks = dealt.filter("own > 0").select(*columns, F.explode(F.expr("sequence(0, own - 1)")).alias("shard"),
                                          F.lit(1).alias("role"), F.col("own").alias("block"))
    parts = index.unionByName(asks)
    # A shard meets each block once: itself (block = shard), and the blocks of later shards.
    parts = parts.filter("role = 1 OR block = shard OR block > shard")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        graph = Graph(_unit(table).astype(np.float32), table["rep"].to_numpy())
        return table.slice(0, 1).select(["label", "dim", "shard"]).append_column("graph", pa.array([graph.stored()], pa.binary()))

    # One graph per shard, written once; each of its blocks reads it.
    built = dealt.select("label", "dim", F.col("own").alias("shard"), F.lit(b"").alias("graph")).schema
    graphs = cut_lineage(dealt.withColumn("shard", F.col("own")).repartition("label", "dim", "shard").groupBy(
        "label", "dim", "shard").applyInArrow(build, built))
    read = graphs.join(sizes, ["label", "dim"]).select("label", "dim", "shard", "graph", F.explode(
        F.expr("sequence(shard, shards - 1)")).alias("block"))

    def group(table: pa.Table, own: pa.Table) -> pa.Table:
        roles = set(table["role"].to_pylist())
        if 0 not in roles or (1 not in roles and table["shard"][0].as_py() != table["block"][0].as_py()):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return link_group(table, own["graph"][0].as_py(), least)

    # Dealt by all four keys, else every group of a label would stay in the task that its size came from.
    keys = ["label", "dim", "shard", "block"]
    linked = cut_lineage(parts.repartition(*keys).groupBy(*keys).cogroup(read.repartition(*keys).groupBy(*keys)).applyInArrow(
        group, "a long, b long, n long"))
    counts = linked.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    united = connected_components(linked, "a", "b", smallest=True).withColumnRenamed("node", "rep")
    rooted = cut_lineage(nodes.join(counts, "rep", "left").join(united, "rep", "left").select(
        "label", "embedding", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("root")))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(names, "root").select("label", "embedding", "n_links", "component_id")
    keyed = rows.withColumn("fit", fit)
    linkable = keyed.filter("fit").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = keyed.filter("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                           F.col("vec_id").alias("component_id"))
    both = linkable.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def report(vectors: DataFrame) -> DataFrame:
    """The result of ``op6_hnsw``."""
    return near_duplicates(vectors)
