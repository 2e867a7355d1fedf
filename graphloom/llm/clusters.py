"""Problem 1: clusters of mutually similar records.

The approximate nearest-neighbour graph comes from neighbour descent inside the shards of ``vectors.route``.  Whole connected
components of it are gathered in bounded groups and divided there by modularity in array code; a component above the bound is divided by the same moves as
joins.  Every community is described by its size and its records of highest internal weighted degree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.kernels import neighbour_descent
from graphloom.llm.similar import open_shard
from graphloom.llm.vectors import TASK, classes_of_copies, route, shared_units
from graphloom.operators.graphs import components
from graphloom.operators.records import mix64
from graphloom.store import keep

EDGES = "a bigint, b bigint, w double"
#: Members compared at once when a group is verified, and records of the components that one task divides.
BLOCK, GROUP = 256, 20_000
#: Rounds without a higher modularity after which a level ends.
PATIENCE = 4


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of every row's connected component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for ends in (a, b, root[a], root[b]):
            np.minimum.at(after, ends, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _shard_edges(k: int, least: float, rounds: int):
    def edges(t: pa.Table) -> pa.Table:
        ids, _, sv, salt = open_shard(t)
        near, cos, leader = neighbour_descent(sv, salt, k, min(0.3, least), rounds, least)
        i, j = np.nonzero((near >= 0) & (cos >= least - 1e-6))
        led = np.flatnonzero(leader != np.arange(sv.n))
        lead_cos = sv.cosines(led, leader[led][:, None])[:, 0]
        a, b, w = np.r_[i, led], np.r_[near[i, j], leader[led]], np.r_[cos[i, j], lead_cos]
        w = np.round(np.clip(w, -1, 1), 6)
        low, high = np.minimum(a, b)[w >= least], np.maximum(a, b)[w >= least]
        _, first = np.unique(low * sv.n + high, return_index=True)
        low, high, w = low[first], high[first], w[w >= least][first]
        root = _roots(sv.n, low, high)
        tied = np.flatnonzero(root != np.arange(sv.n))  # a row without w ties a record to its component in this shard
        a, b = ids[np.r_[low, root[tied]]], ids[np.r_[high, tied]]
        flat = np.r_[w, np.zeros(len(tied))]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "w": pa.array(flat, mask=np.arange(len(flat)) >= len(w))}, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]))

    return edges


def neighbour_graph(units: DataFrame, members: DataFrame, total: int, k: int, least: float, rounds: int = 5, shard_rows: int = 4_000) -> DataFrame:
    """``(a, b, w)``, a < b: exact cosines of at least ``least`` between records and their approximate neighbours, an edge once
    for every shard that met it; rows with null ``w`` tie the records of a shard's components together."""
    return route(units, members, total, shard_rows).groupBy(*TASK).applyInArrow(_shard_edges(k, least, rounds), EDGES)


def divide_by_modularity(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, resolution: float = 1.0) -> np.ndarray:
    """Community of each of n nodes by parallel local moving and contraction, as ``modularity_communities`` does by joins.

    Edges ``a, b, w`` occur once; ``total`` is twice the weight of the whole graph, of which these may be some components.
    """
    label = np.arange(n)
    src, dst, weight = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    size, reached = n, None
    while True:
        k = np.bincount(src, weight, size)
        c = np.arange(size)

        def modularity(c, src=src, dst=dst, weight=weight, k=k, size=size):
            volume = np.bincount(c, k, size)
            return weight[c[src] == c[dst]].sum() / total - resolution * (volume * volume).sum() / total**2

        best, high, since, turn = c, modularity(c), 0, 0
        reached = high if reached is None else reached
        outer = src != dst
        osrc, odst, ow = src[outer], dst[outer], weight[outer]
        while since < PATIENCE:
            volume = np.bincount(c, k, size)
            key, at = np.unique(np.r_[osrc * size + c[odst], np.arange(size) * size + c], return_inverse=True)
            pull = np.bincount(at, np.r_[ow, np.zeros(size)], len(key))
            node, to = key // size, key % size
            gain = np.round(pull - resolution * k[node] * (volume[to] - np.where(to == c[node], k[node], 0)) / total, 9)
            if turn == 0:
                gain[to > c[node]] = -np.inf
            order = np.lexsort((to, -gain, node))
            first = order[np.r_[True, node[order][1:] != node[order][:-1]]]
            wish = to[first]
            if turn and (wish == c).all():
                break
            may = np.ones(size, bool) if turn == 0 else mix64(np.arange(size), turn) % np.uint64(2) == 0
            c = np.where(may, wish, c)
            now = modularity(c)
            best, high, since = (c, now, 0) if now > high + 1e-12 else (best, high, since + 1)
            turn += 1
        if high <= reached + 1e-12:
            return label
        reached = high
        _, best = np.unique(best, return_inverse=True)
        label, size = best[label], int(best.max()) + 1
        key, at = np.unique(best[src] * size + best[dst], return_inverse=True)
        weight = np.bincount(at, weight, len(key))
        src, dst = key // size, key % size


def _modularity(links: DataFrame, state: DataFrame, total: float, resolution: float) -> float:
    """Weight of ``links`` inside the communities of ``state (node, k, c)`` as part of all, less what degrees alone would give."""
    la, lb = (state.select(F.col("node").alias(x), F.col("c").alias("c" + x)) for x in "ab")
    inside = links.join(la, "a").join(lb, "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    squares = state.groupBy("c").agg(F.sum("k").alias("v")).agg(F.sum(F.col("v") * F.col("v"))).first()[0]
    return inside / total - resolution * squares / total**2


def modularity_communities(edges: DataFrame, total: float | None = None, resolution: float = 1.0) -> DataFrame:
    """``(id, community)`` of every end of ``edges (a, b, w)`` by parallel local moving for modularity.

    In a level's first round every node may join the neighbouring community of highest gain among those of smaller names; in
    later rounds half of the nodes, others in each round, may join any.  Ties go to the smaller community.  A level ends when no
    node would move, or when ``PATIENCE`` rounds brought no higher modularity, and then keeps its best division.  Communities
    are contracted and moved as nodes until a level raises the modularity no more.  Only sums per (node, community) are shuffled, aggregated before the
    shuffle, so a community of any size is never gathered.  ``total`` is twice the weight of the whole graph, if ``edges`` are some of its
    components.
    """
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    links = keep(both.groupBy("a", "b").agg(F.sum("w").alias("w")))
    total = total or links.agg(F.sum("w")).first()[0]
    labels = links.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("community"))
    if not total:
        return labels
    reached = None
    while True:
        degrees = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
        state = keep(degrees.select("node", "k", F.col("node").alias("c")))
        best, high, since, turn = state, _modularity(links, state, total, resolution), 0, 0
        reached = high if reached is None else reached
        while since < PATIENCE:
            volume = state.groupBy("c").agg(F.sum("k").alias("volume"))
            pull = (
                links.where("a <> b").join(state.select(F.col("node").alias("b"), "c"), "b")
                .groupBy(F.col("a").alias("node"), F.col("c").alias("to")).agg(F.sum("w").alias("pull"))
            )
            stay = state.select("node", F.col("c").alias("to"), F.lit(0.0).alias("pull"))
            options = pull.unionByName(stay).groupBy("node", "to").agg(F.sum("pull").alias("pull"))
            gain = F.col("pull") - F.lit(resolution) * F.col("k") * (F.col("volume") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / F.lit(total)
            scored = (
                options.join(state, "node").join(volume.withColumnRenamed("c", "to"), "to")
                .where((F.col("to") <= F.col("c")) if turn == 0 else F.lit(True))
                .select("node", "k", "c", "to", F.round(gain, 9).alias("gain"))
            )
            moved = scored.groupBy("node", "k", "c").agg(F.min_by("to", F.struct(-F.col("gain"), "to")).alias("to"))
            may = F.lit(True) if turn == 0 else F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
            state = keep(moved.select("node", "k", F.when(may, F.col("to")).otherwise(F.col("c")).alias("c"), (F.col("to") != F.col("c")).alias("wants")))
            restless = state.where("wants").limit(1).count()
            state = state.drop("wants")
            if turn and not restless:
                break
            now = _modularity(links, state, total, resolution)
            if now > high + 1e-9:
                best, high, since = state, now, 0
            else:
                since += 1
            turn += 1
        if high <= reached + 1e-9:
            return labels
        reached, state = high, best
        labels = keep(labels.join(state.select(F.col("node").alias("community"), F.col("c").alias("next")), "community").select("id", F.col("next").alias("community")))
        ends = state.select("node", "c")
        up = links.join(ends.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(ends.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        links = keep(up.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))


class Graph:
    """The neighbour graph of a collection, its components, and where each is divided.

    ``edges (bin, a, b, w)`` occur once; ``nodes (id, component, bin)`` are the ends of edges; ``bin`` is null for components above
    ``GROUP`` records, else the group of whole components that one task divides; ``total`` is twice the weight of all edges.
    """

    def __init__(self, vectors: DataFrame, k: int, least: float, features: int, shard_rows: int, group: int):
        self.units = keep(shared_units(vectors, least, features))
        count = self.units.count()
        self.members = classes_of_copies(self.units, count)
        met = keep(neighbour_graph(self.units, self.members, count, k, least, shard_rows=shard_rows))
        found = components(met.where("w is null"))
        large = found.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group).select("component", F.lit(True).alias("large"))
        bins = max(1, -(-count // group))
        place = F.when(F.col("large").isNull(), F.pmod(F.xxhash64("component"), F.lit(bins)).cast("int"))
        self.nodes = keep(found.join(large, "component", "left").select("id", "component", place.alias("bin")))
        edges = met.where("w is not null").repartition("a").dropDuplicates(["a", "b"])  # one shuffle serves this and the join
        self.edges = keep(edges.join(self.nodes.select(F.col("id").alias("a"), "bin"), "a").select("bin", "a", "b", "w"))
        self.total = 2 * (self.edges.agg(F.sum("w")).first()[0] or 0.0)
        self.counts = self.members.where("id = rep").select("id", "n")

    def large_communities(self, resolution: float) -> DataFrame | None:
        """``(id, community)`` in the components that no task gathers; None if there are none."""
        if self.nodes.where("bin is null").limit(1).count() == 0:
            return None
        return keep(modularity_communities(self.edges.where("bin is null").select("a", "b", "w"), self.total, resolution))


def _communities(total: float, resolution: float):
    def divide(t: pa.Table) -> pa.Table:
        ids, at = np.unique(np.r_[t["a"].to_numpy(), t["b"].to_numpy()], return_inverse=True)
        a, b = at[: t.num_rows], at[t.num_rows :]
        label = divide_by_modularity(len(ids), a, b, t["w"].to_numpy(), total, resolution)
        least = np.full(len(ids), len(ids))
        np.minimum.at(least, label, np.arange(len(ids)))
        return pa.table({"id": ids, "community": ids[least[label]]})

    return divide


def similarity_clusters(vectors: DataFrame, k: int = 10, least: float = 0.5, typical: int = 5, resolution: float = 1.0, features: int = 3, shard_rows: int = 4_000, group: int = GROUP) -> DataFrame:
    """``(cluster, size, typical, degree)``: every cluster with its ``typical`` most typical records, best first.

    ``vectors`` is ``(field_name, id, fids, vals)`` of one field.  A cluster holds at least two records; records
    without a neighbour of at least ``least`` are in none.  The internal weighted degree of a record adds the weights of its edges
    within the cluster, and 1 for each other copy of it; ties go to the smaller id.  ``cluster`` is the smallest id.
    An empty table gives none.
    """
    graph = Graph(vectors, k, least, features, shard_rows, group)
    labels = graph.edges.where("bin is not null").groupBy("bin").applyInArrow(_communities(graph.total, resolution), "id bigint, community bigint")
    large = graph.large_communities(resolution)
    labels = labels if large is None else labels.unionByName(large)
    alone = graph.counts.join(graph.nodes, "id", "left_anti").select("id", F.col("id").alias("community"))  # a class of copies is a group even without neighbours
    labels = keep(labels.unionByName(alone))
    la, lb = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    inside = graph.edges.join(la, "a").join(lb, "b").where("ca = cb")
    degree = inside.select(F.col("a").alias("id"), "w").unionByName(inside.select(F.col("b").alias("id"), "w")).groupBy("id").agg(F.sum("w").alias("d"))
    scored = (
        labels.join(degree, "id", "left").join(graph.counts, "id", "left")
        .select("id", "community", F.coalesce("n", F.lit(1)).alias("n"), (F.coalesce("d", F.lit(0.0)) + F.coalesce(F.col("n") - 1, F.lit(0))).alias("d"))
    )
    size = scored.groupBy("community").agg(F.sum("n").alias("size"), F.min("id").alias("cluster"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.round("d", 6)), "id"))
    top = scored.withColumn("r", rank).where(F.col("r") <= typical).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("r", "id", F.round("d", 6).alias("d")))).alias("t"))
    return size.where("size > 1").join(top, "community").select("cluster", "size", F.col("t.id").alias("typical"), F.col("t.d").alias("degree"))


def _tight(total: float, resolution: float, least: float, smallest: int):
    """Pairs of the communities of a group of components that are tight; (x, x) for every record x of them that has copies."""

    def pairs(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("id")
        ids, n = vectors["id"].to_numpy(), vectors["n"].to_numpy()
        a, b = np.searchsorted(ids, edges["a"].to_numpy()), np.searchsorted(ids, edges["b"].to_numpy())
        label = divide_by_modularity(len(ids), a, b, edges["w"].to_numpy(), total, resolution)
        held, size = np.bincount(label, minlength=len(ids)), np.bincount(label, n, len(ids))
        leaves = label[a] != label[b]
        fit = size >= smallest
        fit[label[a[leaves]]] = fit[label[b[leaves]]] = False
        fids, vals = vectors["fids"].combine_chunks(), vectors["vals"].combine_chunks()
        lengths = fids.value_lengths().to_numpy()
        start = np.r_[0, np.cumsum(lengths)]
        fids, vals = fids.flatten().to_numpy(), vals.flatten().to_numpy()
        order = np.argsort(label, kind="stable")
        begin = np.r_[0, np.cumsum(held)]
        left, right = [], []
        for c in np.flatnonzero(fit[: len(held)] & (held > 0)):
            rows = order[begin[c] : begin[c + 1]]
            m = len(rows)
            at = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
            _, code = np.unique(fids[at], return_inverse=True)
            x = np.zeros((m, int(code.max(initial=0)) + 1))
            x[np.repeat(np.arange(m), lengths[rows]), code] = vals[at]
            i, j = np.triu_indices(m, 1)
            if (np.round(x @ x.T, 6)[i, j] >= least).all():
                twice = rows[n[rows] > 1]
                left += [ids[rows[i]], ids[twice]]
                right += [ids[rows[j]], ids[twice]]
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *left]), "b": np.concatenate([none, *right])})

    return pairs


def _block_pairs(least: float):
    def pairs(t: pa.Table) -> pa.Table:
        x, y = t["bx"][0].as_py(), t["by"][0].as_py()
        t = t.append_column("asks", pa.array(t["block"].to_numpy() != x))
        ids, asks, sv, _ = open_shard(t.select(["asks", "id", "fids", "vals"]))
        m = int((~asks).sum())
        rows = np.arange(m)
        other = np.arange(m, sv.n) if x != y else rows
        cos = np.round(sv.cosines(rows, np.tile(other, (m, 1))), 6)
        ok = cos >= least
        if x == y:
            ok &= rows[:, None] < rows[None, :]
        i, j = np.nonzero(ok)
        a, b = ids[rows[i]], ids[other[j]]
        g = np.full(len(a), t["group"][0].as_py(), np.int64)
        return pa.table({"group": g, "a": np.minimum(a, b), "b": np.maximum(a, b)})

    return pairs


def _tight_large(graph: Graph, labels: DataFrame, least: float, smallest: int) -> DataFrame:
    """As ``_tight`` for the communities ``labels (id, community)`` of large components, block against block of their members.

    Communities whose vectors' sum is too short for all pairs to reach ``least`` are left out first, by an aggregate.
    """
    la, lb = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    leaving = graph.edges.where("bin is null").join(la, "a").join(lb, "b").where("ca <> cb")
    open_ = leaving.select(F.explode(F.array("ca", "cb")).alias("group")).distinct()
    union = labels.withColumnRenamed("community", "group").join(graph.counts, "id", "left").select("id", "group", F.coalesce("n", F.lit(1)).alias("n"))
    size = union.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size")).where(F.col("size") >= smallest).join(open_, "group", "left_anti")
    grouped = keep(union.join(size, "group").join(graph.units.select("id", "fids", "vals"), "id"))
    entries = grouped.select("group", "m", F.explode(F.arrays_zip("fids", "vals")).alias("e"))
    own = grouped.select("group", "m", F.aggregate("vals", F.lit(0.0), lambda s, v: s + v * v).alias("o")).groupBy("group").agg((F.first("m") - F.sum("o")).alias("rest"))
    sums = entries.groupBy("group", "m", F.col("e.fids").alias("f")).agg(F.sum("e.vals").alias("s"))
    m = F.col("m").cast("double")
    dense = sums.groupBy("group", "m").agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(own, "group")
    dense = dense.where(F.col("q") + F.col("rest") >= m + m * (m - 1) * F.lit(least - 1e-6) - 1e-6).select("group")
    placed = grouped.join(dense, "group").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.select("group", "id", "fids", "vals", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    met = met.select("group", "id", "fids", "vals", "block", F.least("block", "o").alias("bx"), F.greatest("block", "o").alias("by"))
    pairs = keep(met.groupBy("group", "bx", "by").applyInArrow(_block_pairs(least), "group bigint, a bigint, b bigint"))
    good = pairs.groupBy("group").agg(F.count(F.lit(1)).alias("p")).join(size, "group").where(F.col("p") == F.col("m") * (F.col("m") - 1) / 2).select("group")
    twice = grouped.where("n > 1").join(good, "group").select(F.col("id").alias("a"), F.col("id").alias("b"))
    return pairs.join(good, "group").select("a", "b").unionByName(twice)


def tight_pairs(vectors: DataFrame, k: int = 10, least: float = 0.5, smallest: int = 5, resolution: float = 0.1, features: int = 3, shard_rows: int = 4_000, group: int = GROUP) -> DataFrame:
    """``(gid_a, gid_b)`` of records in a community of which any two reach ``least`` and no record outside reaches one inside.

    That any two inside reach ``least`` is verified exactly.  Communities are those of modularity at a low ``resolution``, as such a
    cluster must not be divided; a community with an edge to another is left out, so that nobody outside reaches one inside is
    as sure as the graph, which is approximate.  A null or empty table gives none.
    """
    graph = Graph(vectors, k, least, features, shard_rows, group)
    rows = graph.units.select("id", "fids", "vals").join(graph.nodes.where("bin is not null").select("id", "bin"), "id").join(graph.counts, "id", "left")
    rows = rows.select("bin", "id", "fids", "vals", F.coalesce("n", F.lit(1)).alias("n"))
    found = graph.edges.where("bin is not null").groupBy("bin").cogroup(rows.groupBy("bin")).applyInArrow(_tight(graph.total, resolution, least, smallest), "a bigint, b bigint")
    large = graph.large_communities(resolution)
    found = found if large is None else found.unionByName(_tight_large(graph, large, least, smallest))
    alone = graph.counts.where(F.col("n") >= smallest).join(graph.nodes, "id", "left_anti").select(F.col("id").alias("a"), F.col("id").alias("b"))
    if graph.members.limit(1).count() == 0:
        return found.select(F.col("a").alias("gid_a"), F.col("b").alias("gid_b"))
    found = keep(found.unionByName(alone))
    copies = graph.members.select("rep", "id")
    expanded = found.where("a <> b").join(copies.toDF("a", "ia"), "a", "left").select(F.coalesce("ia", "a").alias("a"), "b")
    expanded = expanded.join(copies.toDF("b", "ib"), "b", "left").select("a", F.coalesce("ib", "b").alias("b"))
    held = found.where("a = b").select(F.col("a").alias("rep")).join(copies, "rep")
    same = held.toDF("rep", "a").join(held.toDF("rep", "b"), "rep").where("a < b").select("a", "b")
    return expanded.unionByName(same).select(F.least("a", "b").alias("gid_a"), F.greatest("a", "b").alias("gid_b"))
