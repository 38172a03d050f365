"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph starts from blocks of vectors that fall into one leaf of a random projection tree.
Then each round meets, at every vector, its neighbours and the vectors it is a neighbour of:
all pairs of that short list are measured and the nearer ones enter the lists of both. A
query walks the graph from its entry points, always on from the nearest vectors found.

Equal vectors are one node, so a vector that fills a third of the table is one point of the
graph and its copies come back in the answer only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import staged

#: Neighbours per node; trees of the start; nodes per block; nodes at least on which the upper part of the trees is fitted.
NEIGHBOURS, TREES, BLOCK, SAMPLE = 20, 6, 256, 8192
#: Nodes of a leaf that one task splits further, and sampled nodes at least that a leaf is fitted on.
GROUP, FITTED = 32_768, 32
#: The share of changed neighbours under which descent stops, and rounds at most, far more than it needs.
ROUNDS, CHANGED = 30, 0.01
#: Nodes that a query goes on from in one step, and nodes it remembers.
BEAM, REMEMBERED = 150, 600


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vector) without null ids, without null, zero or empty vectors and those with null or non-finite components.

    Vectors of another length than the most frequent one (the longer, if tied) take no part. Extra columns are left.
    """
    vector = F.col("embedding").cast("array<float>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = table.select("vec_id", vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0))
    length = some.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return some.where(F.size("vector") == (length["n"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _nearest(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its k nearest other rows and the squared distances."""
    squares = (points * points).sum(axis=1)
    d = squares[:, None] + squares[None, :] - 2 * points @ points.T
    np.fill_diagonal(d, np.inf)
    k = min(k, len(points) - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(points) - 1 else np.argsort(d, axis=1)[:, :k]
    return at, np.maximum(np.take_along_axis(d, at, axis=1), 0)


class Tree:
    """A random projection tree as arrays: a plane per inner node, split at the sample's median; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes, self.cuts, self.children, self.leaves = [], [], [], 0
        self._grow(sample, leaf, rng, 0)

    def _grow(self, sample: np.ndarray, leaf: int, rng: np.random.Generator, depth: int) -> int:
        plane = None
        for _ in range(8 if len(sample) > leaf and depth <= 64 else 0):
            a, b = sample[rng.choice(len(sample), 2, replace=False)]
            side = (sample * (a - b)).sum(axis=1)
            cut = np.float32(np.median(side))
            if not (side < cut).any() and (side > cut).any():
                cut = side[side > cut].min()
            if (side < cut).any():
                plane = a - b
                break
        if plane is None:
            self.leaves += 1
            return -self.leaves
        me = len(self.planes)
        self.planes.append(plane)
        self.cuts.append(cut)
        self.children.append([0, 0])
        self.children[me] = [self._grow(sample[side < cut], leaf, rng, depth + 1), self._grow(sample[side >= cut], leaf, rng, depth + 1)]
        return me

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if self.planes else np.full(len(points), -1)
        planes, cuts, children = np.array(self.planes), np.array(self.cuts), np.array(self.children)
        live = np.flatnonzero(at >= 0)
        while len(live):
            node = at[live]
            right = (points[live] * planes[node]).sum(axis=1) >= cuts[node]
            at[live] = children[node, right.astype(int)]
            live = live[at[live] >= 0]
        return -at - 1


def blocks(points: np.ndarray, block: int, seed: int) -> list[np.ndarray]:
    """The rows of ``points`` as leaves of a tree grown on all of them, at most ``2 * block`` each.

    Only vectors that no plane tells apart are cut by their order.
    """
    if len(points) <= 2 * block:
        return [np.arange(len(points))]
    leaf = Tree(points, 2 * block, seed).leaf_of(points)
    order = np.argsort(leaf, kind="stable")
    leaves = np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)
    return [part for rows in leaves for part in np.array_split(rows, -(-len(rows) // (2 * block)))]


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest (v, u, d) of each v."""
    order = Window.partitionBy("v").orderBy("d", "u")
    return edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def start_graph(nodes: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(v, u, d) from exact neighbours inside blocks, at every size the leaves of whole trees.

    The upper part of a tree is fitted on about ``sample`` nodes, or more, so that a leaf has ``FITTED`` of
    them and no more than about ``GROUP`` nodes; the task that gets a leaf grows the tree on, on all its nodes.
    """
    total = nodes.count()
    sample = max(sample, -(-FITTED * total // GROUP))
    drawn = nodes.where(F.expr("(xxhash64(node, 5) & 1048575) / 1048576D") < sample / max(1, total)).select("vector")
    points = matrix(drawn.toArrow().column("vector").combine_chunks()) if total else np.zeros((0, 1), np.float32)
    leaf = max(FITTED, round(block * len(points) / max(1, total)))
    forest = nodes.sparkSession.sparkContext.broadcast([Tree(points, leaf, seed) for seed in range(trees)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = matrix(batch.column("vector"))
            for number, tree in enumerate(forest.value):
                yield pa.RecordBatch.from_arrays([
                    batch.column("node"), batch.column("vector"), pa.array(np.full(len(held), number), pa.int32()),
                    pa.array(tree.leaf_of(held), pa.int32())], names=["node", "vector", "tree", "leaf"])

    placed = nodes.mapInArrow(place, "node long, vector array<float>, tree int, leaf int")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        name, points = table.column("node").to_numpy(), matrix(table.column("vector").combine_chunks())
        order = np.argsort(name)
        name, points = name[order], points[order]
        met = [(name[rows], *_nearest(points[rows], k)) for rows in blocks(points, block, table.column("tree")[0].as_py()) if len(rows) > 1]
        return pa.table({
            "v": pa.array(np.concatenate([np.zeros(0, np.int64), *(np.repeat(n, at.shape[1]) for n, at, _ in met)])),
            "u": pa.array(np.concatenate([np.zeros(0, np.int64), *(n[at.ravel()] for n, at, _ in met)])),
            "d": pa.array(np.concatenate([np.zeros(0), *(d.ravel() for _, _, d in met)]).astype(np.float64))})

    edges = placed.groupBy("tree", "leaf").applyInArrow(meet, "v long, u long, d double")
    return _top(edges.groupBy("v", "u").agg(F.min("d").alias("d")), k)


def both_ways(graph: DataFrame, k: int) -> DataFrame:
    """(w, m): each node beside its neighbours and the k nearest nodes that have it as theirs."""
    back = _top(graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "d"), k)
    return graph.select(F.col("v").alias("w"), F.col("u").alias("m")).union(back.select("v", "u")).distinct()


def _closer(k: int):
    """Pairs of each node's list that are nearer than the worst neighbour of either; lists arrive ordered by node."""

    def pairs(w: np.ndarray, m: np.ndarray, worst: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], w[1:] != w[:-1]))
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        place = np.arange(len(w)) - first[group]
        width = place.max() + 1
        table = np.zeros((len(first), width, points.shape[1]), np.float32)
        names, limits = np.full((len(first), width), -1, np.int64), np.full((len(first), width), -np.inf)
        table[group, place], names[group, place], limits[group, place] = points, m, worst
        full = np.zeros(names.shape, bool)
        full[group, place] = True
        squares = (table * table).sum(axis=2)
        d = squares[:, :, None] + squares[:, None, :] - 2 * table @ table.transpose(0, 2, 1)
        good = full[:, :, None] & full[:, None, :] & (d < limits[:, :, None])
        good[:, np.arange(width), np.arange(width)] = False
        g, a, b = np.nonzero(good)
        return pa.RecordBatch.from_arrays([pa.array(names[g, a]), pa.array(names[g, b]), pa.array(np.maximum(d[g, a, b], 0).astype(np.float64))], names=["v", "u", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            w = table.column("w").to_numpy()
            whole = int(np.searchsorted(w, w[-1])) if len(w) else 0
            for at, end in _cuts(w[:whole]):
                yield _of(table.slice(at, end - at))
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            for at, end in _cuts(rest.column("w").to_numpy()):
                yield _of(rest.slice(at, end - at))

    def _of(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        return pairs(*(table.column(c).to_numpy() for c in ("w", "m", "worst")), matrix(table.column("vector").combine_chunks()))

    def _cuts(w: np.ndarray, rows: int = 2048) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(w):
            end = int(np.searchsorted(w, w[min(at + rows, len(w)) - 1], side="right"))
            yield at, end
            at = end

    return run


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, changed: float = CHANGED, trees: int = TREES,
                block: int = BLOCK) -> DataFrame:
    """(v, u, d): about the k nearest nodes of each of ``nodes`` (node, vector), with squared distances."""
    graph = staged(start_graph(nodes, k, trees, block), "graph")
    total = graph.count()
    for _ in range(rounds if total else 0):
        worst = graph.groupBy("v").agg(F.max("d").alias("worst"), F.count("*").alias("n")).select(
            F.col("v").alias("m"), F.when(F.col("n") < k, float("inf")).otherwise(F.col("worst")).alias("worst"))
        members = nodes.select(F.col("node").alias("m"), "vector").join(worst, "m")
        lists = both_ways(graph, k).join(members, "m").repartition("w").sortWithinPartitions("w").select("w", "m", "worst", "vector")
        nearer = lists.mapInArrow(_closer(k), "v long, u long, d double").groupBy("v", "u").agg(F.min("d").alias("d"), F.lit(1).alias("new"))
        old = graph.select("v", "u", "d", F.lit(0).alias("new"))
        merged = old.union(nearer).groupBy("v", "u").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        step = staged(_top(merged, k), "graph")
        graph, moved = step.select("v", "u", "d"), step.where("new = 1").count()
        if moved < changed * total:
            break
    return graph


def _distance(a: str, b: str) -> Column:
    """Euclidean distance in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, entries: DataFrame, k: int = NEIGHBOURS,
                  beam: int = BEAM, remembered: int = REMEMBERED) -> DataFrame:
    """(q, u, d): the nodes found for ``queries`` (q, vector), walking from ``entries`` (q, u), nearest ``remembered`` each.

    A step opens, for each query, up to ``beam`` unopened nodes among its nearest, and measures
    their neighbours; it ends only when every query has opened its nearest ``2 * beam``. A node once
    pushed out of those remembered never comes back, so it does end.
    """
    ways = staged(both_ways(graph, k), "ways")
    places = nodes.select(F.col("node").alias("u"), F.col("vector").alias("there"))
    measured = lambda pairs: pairs.join(places, "u").join(queries.select("q", F.col("vector").alias("here")), "q").select(
        "q", "u", _distance("here", "there").alias("d"), F.lit(False).alias("opened"))
    near = Window.partitionBy("q").orderBy("d", "u")

    def turned(found: DataFrame) -> DataFrame:
        """The nodes remembered, with ``next`` on those to be opened now."""
        ranked = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= remembered)
        waiting = ~F.col("opened") & (F.col("r") <= 2 * beam)
        turn = F.sum(waiting.cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0))
        return staged(ranked.select("q", "u", "d", "opened", (waiting & (turn <= beam)).alias("next")), "found")

    found = turned(measured(entries.distinct()))
    while (opening := found.where("next")).limit(1).count():
        fresh = opening.select("q", F.col("u").alias("w")).join(ways, "w").select("q", F.col("m").alias("u")).distinct().join(
            found.select("q", "u"), ["q", "u"], "left_anti")
        found = turned(found.select("q", "u", "d", F.expr("opened or next").alias("opened")).union(measured(fresh)))
    return found.select("q", "u", "d")


def nearest(table: DataFrame, is_query: Column, k: int = 10, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, block: int = BLOCK,
            beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest vectors found for each row where ``is_query`` holds, itself excluded.

    Score is the Euclidean distance; ties go to the smaller vec_id. Rows that take no part are
    named in ``valid_vectors``. Rows that repeat vec_id and vector are one row, and a vec_id is
    never its own neighbour. An empty table gives none.
    """
    vectors = staged(valid_vectors(table), "vectors")
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    members = staged(few.withColumn("node", F.min("vec_id").over(Window.partitionBy("vector"))), "members")
    nodes = staged(members.where("r = 1").select("node", "vector"), "nodes")
    asked = staged(vectors.where(is_query).join(nodes, "vector").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).distinct(), "asked")
    graph = build_graph(nodes, neighbours, rounds, block=block)
    starts = asked.select("q").distinct()
    queries = starts.join(nodes, F.col("q") == F.col("node")).select("q", "vector")
    entries = graph.join(starts, F.col("v") == F.col("q"), "left_semi").select(F.col("v").alias("q"), "u").union(starts.select("q", F.col("q").alias("u")))
    found = greedy_search(queries, nodes, graph, entries, neighbours, beam)
    nearby = staged(found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "u"))).where(F.col("r") <= k + 1).drop("r"), "nearby")
    each = nearby.join(members.select(F.col("node").alias("u"), "vec_id"), "u")
    ranked = asked.join(each, "q").where(F.col("vec_id") != F.col("query_id")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def neighbour_report(table: DataFrame) -> DataFrame:
    return nearest(table.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
