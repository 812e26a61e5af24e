"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards of bounded size. In each shard every
vector gets the neighbours that robust pruning leaves of its nearest and of some random
members, and the reverse of these edges. A vector's lists of all its shards are joined.
Each shard is then searched, from its medoids, for all that is in range of its vectors: a greedy
beam first, then everything in range is expanded until nothing new is in range. A search that
finds a vector goes on in the other shards of that vector. Candidates are verified in double
precision, and recall is audited by brute force over all vectors for a bounded set of queries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.llm.common import map_batches, ship, stored
from rewardmill.llm.components import connected_components
from rewardmill.llm.tokens import ragged

#: Members a shard should have; one of twice as many is split again.
SHARD = 4096
#: Shards of each vector at the first split; at later ones its nearest shard alone is doubled.
OVERLAP = 3
#: Rows that centroids of one split are fitted on, centroids of one split, and cells split in one pass: the bound of what is sent to all tasks.
SAMPLE, MOST_CENTROIDS, MOST_CELLS = 20_000, 256, 1024
#: Nearest and random members that pruning chooses from, its slack, and how far below the threshold a node is still expanded.
NEAREST, RANDOM, ALPHA, SLACK = 64, 16, 1.2, 0.03
BEAM = 48
#: Queries of the audit, and the recall below which the beam is widened.
AUDITED, LEAST_RECALL = 512, 0.95
_QUERIES = 1 << 15


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fitted(units: np.ndarray, k: int, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Unit centroids by spherical k-means; centroids without members keep their place."""
    rng = np.random.default_rng(seed)
    centroids = units[rng.choice(len(units), min(k, len(units)), replace=False)].astype("f4")
    points = units.astype("f4")
    for _ in range(rounds):
        nearest = np.concatenate([(points[at : at + 4096] @ centroids.T).argmax(axis=1) for at in range(0, len(points), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def medoids(units: np.ndarray, seed: int = 0) -> np.ndarray:
    """Rows nearest to the centroids of a small clustering: where searches begin."""
    centroids = fitted(units, max(1, min(64, len(units) // 32)), 4, seed)
    return np.unique((centroids @ units.astype("f4").T).argmax(axis=1))


def pruned_graph(units: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to): robust-pruned neighbours of every row and the reverse of each.

    Of a row's candidates, nearest first, one is dropped if a kept one is nearer to it, by the factor ``ALPHA``, than the row is.
    """
    points, n = units.astype("f4"), len(units)
    rng = np.random.default_rng(seed)
    sources, targets = [], []
    near = min(NEAREST, n - 1)
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        like = points[rows] @ points.T
        like[np.arange(len(rows)), rows] = -4
        found = np.argpartition(-like, near - 1, axis=1)[:, :near] if near else np.zeros((len(rows), 0), "i8")
        some = np.concatenate([found, rng.integers(0, n, (len(rows), RANDOM))], axis=1)
        apart = 2 - 2 * np.take_along_axis(like, some, axis=1)
        order = np.argsort(apart, axis=1, kind="stable")
        some, apart = np.take_along_axis(some, order, axis=1), np.take_along_axis(apart, order, axis=1)
        vectors = points[some]
        between = 2 - 2 * (vectors @ vectors.transpose(0, 2, 1))
        alive = some != rows[:, None]
        alive[:, 1:] &= some[:, 1:] != some[:, :-1]
        kept = np.zeros_like(alive)
        for c in range(some.shape[1]):
            kept[:, c] = alive[:, c]
            alive &= ~(kept[:, c, None] & (ALPHA * ALPHA * between[:, c] <= apart))
        r, c = np.nonzero(kept)
        sources.append(rows[r])
        targets.append(some[r, c])
    a, b = np.concatenate(sources), np.concatenate(targets)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    return both // n, both % n


class Shard:
    """Members of one shard and their edges, ready to be searched."""

    def __init__(self, units: np.ndarray, sources: np.ndarray, targets: np.ndarray, entries: np.ndarray):
        self.units, self.points = units, units.astype("f4")
        self.targets, self.entries = targets, entries
        self.starts = np.searchsorted(sources, np.arange(len(units) + 1))

    def _expand(self, query: np.ndarray, node: np.ndarray, known: np.ndarray, asked: np.ndarray):
        """Neighbours of nodes that their query does not know yet, with their likeness; now they are known."""
        n = len(self.points)
        many = self.starts[node + 1] - self.starts[node]
        key = np.repeat(query, many) * n + self.targets[ragged(self.starts[node], many)]
        key = np.unique(key[~known.ravel()[key]])
        known.ravel()[key] = True
        query, node = key // n, key % n
        like = np.concatenate(
            [np.zeros(0, "f4"), *[np.einsum("ij,ij->i", self.points[node[at : at + (1 << 16)]], asked[query[at : at + (1 << 16)]]) for at in range(0, len(node), 1 << 16)]]
        )
        return query, node, like

    def in_range(self, asked: np.ndarray, least: float, beam: int, begin: tuple[np.ndarray, np.ndarray] | None = None):
        """(query, node) with a cosine of at least ``least``, for rows ``asked``; ``begin``: more nodes (query, node) to start from."""
        n, q = len(self.points), len(asked)
        points = asked.astype("f4")
        known, done = np.zeros((q, n), bool), np.zeros((q, n), bool)
        query, node = np.repeat(np.arange(q), len(self.entries)), np.tile(self.entries, q)
        if begin is not None:
            query, node = np.concatenate([query, begin[0]]), np.concatenate([node, begin[1]])
        key = np.unique(query * n + node)
        query, node = key // n, key % n
        known[query, node] = True
        like = np.einsum("ij,ij->i", self.points[node], points[query])
        best, score = np.full((q, beam), -1), np.full((q, beam), -9, "f4")
        found_q, found_n = [], []
        while True:
            hit = like >= least - SLACK
            found_q.append(query[hit])
            found_n.append(node[hit])
            if len(query):
                first = np.searchsorted(query, np.arange(q))
                width = int(np.bincount(query, minlength=q).max())
                more, its = np.full((q, width), -1), np.full((q, width), -9, "f4")
                place = np.arange(len(query)) - first[query]
                more[query, place], its[query, place] = node, like
                best, score = np.concatenate([best, more], axis=1), np.concatenate([score, its], axis=1)
                top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                best, score = np.take_along_axis(best, top, axis=1), np.take_along_axis(score, top, axis=1)
            # The best four of each beam that have not been expanded.
            open_ = np.where((best >= 0) & ~np.take_along_axis(done, np.maximum(best, 0), axis=1), score, -9)
            next_ = np.argpartition(-open_, min(4, beam - 1), axis=1)[:, :4]
            at, column = np.nonzero(np.take_along_axis(open_, next_, axis=1) > -9)
            if not len(at):
                break
            chosen = best[at, next_[at, column]]
            done[at, chosen] = True
            query, node, like = self._expand(at, chosen, known, points)
        query, node = np.concatenate(found_q), np.concatenate(found_n)
        while True:
            fresh = ~done[query, node]
            query, node = query[fresh], node[fresh]
            if not len(query):
                break
            done[query, node] = True
            query, node, like = self._expand(query, node, known, points)
            hit = like >= least - SLACK
            query, node = query[hit], node[hit]
            found_q.append(query)
            found_n.append(node)
        query, node = np.concatenate(found_q), np.concatenate(found_n)
        exact = np.concatenate(
            [np.zeros(0), *[np.einsum("ij,ij->i", self.units[node[at : at + (1 << 15)]], asked[query[at : at + (1 << 15)]]) for at in range(0, len(node), 1 << 15)]]
        )
        return query[exact >= least], node[exact >= least]


def distinct_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row with its digest (null if it cannot link), and one node for each distinct vector.

    Rows: vec_id, high, low. Nodes: node, high, low, least (smallest vec_id), n (rows), dims, unit (doubles).
    Equal vectors are counted in each task before the shuffle, so a group of copies is one row of it.
    """
    v = F.col(vector_column).cast("array<double>")
    fit = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    kept = F.when(fit, v)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), kept.alias("v"))
    rows = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("high"), F.when(F.col("v").isNotNull(), F.xxhash64(F.reverse("v"))).alias("low"))
    groups = rows.filter("high IS NOT NULL").groupBy("high", "low").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = groups.withColumn("node", F.monotonically_increasing_id())

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            units = [_units(np.array(x, "f8")[None])[0].tobytes() for x in batch.column("v").to_pylist()]
            dims = pa.array([len(u) // 8 for u in units], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "high", "low", "least", "n")], dims, pa.array(units, pa.binary())], ["node", "high", "low", "least", "n", "dims", "unit"])

    made = map_batches(nodes.select("node", "high", "low", "least", "n", "v"), normalise, "node long, high long, low long, least long, n long, dims int, unit binary")
    return rows.drop("v"), stored(made, "vectors")


def _rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Binary cells of doubles, all of one length, as a matrix."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), "f8").reshape(len(cells), -1)


def _order_of(node: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)


def shards(nodes: DataFrame) -> DataFrame:
    """(cell, node, unit, home): every node in its shards; ``home`` marks the one it is nearest to.

    Centroids are fitted to a bounded sample of each cell that is too large; all rows are assigned to them. Vectors of different
    lengths are never in one shard. Cells are split until none holds more than twice ``SHARD``.
    """
    members = nodes.select(F.col("dims").cast("long").alias("cell"), "node", "unit", F.lit(True).alias("home"))
    level = 0
    while True:
        sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 2 * SHARD).orderBy("cell").limit(MOST_CELLS)
        sizes = sizes.collect()
        if not sizes:
            return members
        spark = nodes.sparkSession
        large = F.broadcast(spark.createDataFrame([tuple(r) for r in sizes], "cell long, size long"))
        sample = members.join(large, "cell").filter(_order_of(F.col("node")) * F.col("size") < SAMPLE)
        copies = OVERLAP if level == 0 else 2

        def fit(rows: pa.Table) -> pa.Table:
            size = rows.column("size")[0].as_py()
            k = max(2, min(MOST_CENTROIDS, -(-copies * size // SHARD)))
            centroids = fitted(_rows_of(rows.sort_by("node").column("unit")), k)
            return pa.table({"cell": rows.column("cell").slice(0, 1), "k": pa.array([len(centroids)], pa.int32()), "centroids": [centroids.tobytes()]})

        ship(spark)
        splits = {r.cell: np.frombuffer(r.centroids, "f4").reshape(r.k, -1) for r in sample.groupBy("cell").applyInArrow(fit, "cell long, k int, centroids binary").collect()}

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                cells, home = batch.column("cell").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
                row, new, first = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0, bool)]
                for cell in np.unique(cells).tolist():
                    here = np.flatnonzero(cells == cell)
                    if cell not in splits:
                        row.append(here)
                        new.append(cells[here])
                        first.append(home[here])
                        continue
                    like = _rows_of(batch.column("unit").take(pa.array(here))).astype("f4") @ splits[cell].T
                    nearest = np.argsort(-like, axis=1, kind="stable")[:, :copies]
                    ranks = np.broadcast_to(np.arange(nearest.shape[1]), nearest.shape)
                    chosen = (ranks == 0) | home[here, None]
                    child = (np.uint64(cell % 2**64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((nearest + 1).astype("u8") * np.uint64(0xBF58476D1CE4E5B9))
                    row.append(np.repeat(here, chosen.sum(axis=1)))
                    new.append(child.view("i8")[chosen])
                    first.append((home[here, None] & (ranks == 0))[chosen])
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(new)), batch.column("node").take(row), batch.column("unit").take(row), pa.array(np.concatenate(first))], ["cell", "node", "unit", "home"]
                )

        members = stored(map_batches(members, assign, "cell long, node long, unit binary, home boolean"), "shards")
        level += 1


def _built(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("node")
    units, nodes = _rows_of(rows.column("unit")), rows.column("node").to_numpy()
    sources, targets = pruned_graph(units)
    counts = np.bincount(sources, minlength=len(nodes))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(nodes[targets]))
    entry = np.zeros(len(nodes), bool)
    entry[medoids(units)] = True
    return pa.table({"cell": rows.column("cell"), "node": rows.column("node"), "home": rows.column("home"), "entry": entry, "edges": lists})


def union_graph(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shard members with the joined adjacency lists of all their shards: cell, node, unit, n, home, entry, edges, cells."""
    ship(members.sparkSession)
    built = stored(members.groupBy("cell").applyInArrow(_built, "cell long, node long, home boolean, entry boolean, edges array<long>"), "shard-lists")
    lists = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"), F.array_sort(F.collect_list("cell")).alias("cells"))
    joined = built.drop("edges").join(lists, "node").join(nodes.select("node", "n", "unit"), "node")
    return stored(joined.select("cell", "node", "unit", "n", "home", "entry", "edges", "cells"), "graph")


_FOUND = "kind int, a long, b long, n long"
_COUNT, _LINK, _GO_ON = range(3)


def _search(shard: pa.Table, asked: pa.Table | None, least: float, beam: int) -> pa.Table:
    """What queries find in one shard: numbers of links (kind 0), links as a forest (1), further shards and nodes to start from there (2).

    Without ``asked`` the members are the queries. A node is counted in its home shard only.
    """
    shard = shard.sort_by("node")
    nodes, units, weight = shard.column("node").to_numpy(), _rows_of(shard.column("unit")), shard.column("n").to_numpy()
    home, cell = shard.column("home").to_numpy(), shard.column("cell")[0].as_py()
    edges = shard.column("edges").combine_chunks()
    many = np.diff(edges.offsets.to_numpy())
    ends = edges.flatten().to_numpy()
    at = np.minimum(np.searchsorted(nodes, ends), len(nodes) - 1)
    inside = nodes[at] == ends
    graph = Shard(units, np.repeat(np.arange(len(nodes)), many)[inside], at[inside], np.flatnonzero(shard.column("entry").to_numpy()))
    # Members that lie in the same shards are one class: a search goes on by class, not by member.
    sets = [tuple(c) for c in shard.column("cells").to_pylist()]
    classes = {s: i for i, s in enumerate(dict.fromkeys(sets))}
    of_class, others = np.array([classes[s] for s in sets]), [[c for c in s if c != cell] for s in classes]
    if asked is None:
        who, vectors, mine, begin = nodes, units, of_class, None
    else:
        asked = asked.sort_by("x")
        who, vectors, mine = asked.column("x").to_numpy(), _rows_of(asked.column("unit")), None
        starts = asked.column("starts").to_pylist()
        begin = [np.searchsorted(nodes, np.array(s, "i8")) for s in starts]
    counts = np.zeros(len(who), "i8")
    label = {}

    def root(i: int) -> int:
        while label.setdefault(i, i) != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    links, further = [], set()
    step = max(16, min(512, (1 << 23) // max(1, len(nodes))))
    for low in range(0, len(who), step):
        rows = np.arange(low, min(len(who), low + step))
        first = None
        if begin is not None:
            first = (np.repeat(np.arange(len(rows)), [len(begin[r]) for r in rows]), np.concatenate([begin[r] for r in rows]))
        query, node = graph.in_range(vectors[rows], least, beam, first)
        query = rows[query]
        other = who[query] != nodes[node]
        counts += np.bincount(query[other & home[node]], weights=weight[node[other & home[node]]], minlength=len(who)).astype("i8")
        # One start for each class that a query has reached.
        pairs, where = np.unique(query * len(others) + of_class[node], return_index=True)
        for pair, w in zip(pairs.tolist(), where.tolist()):
            r, c = divmod(pair, len(others))
            if mine is not None and c == mine[r]:
                continue
            further.update((int(who[r]), target, int(nodes[node[w]])) for target in others[c])
        for a, b in zip(who[query[other]].tolist(), nodes[node[other]].tolist()):
            x, y = root(a), root(b)
            if x != y:
                label[x] = y
                links.append((a, b))
    held = np.flatnonzero(counts)
    kinds = np.repeat([_COUNT, _LINK, _GO_ON], [len(held), len(links), len(further)]).astype("i4")
    further = list(further)
    columns = [
        np.concatenate([who[held], [x[0] for x in links], [x[0] for x in further]]),
        np.concatenate([np.full(len(held), cell), [x[1] for x in links], [x[1] for x in further]]),
        np.concatenate([counts[held], np.zeros(len(links), "i8"), [x[2] for x in further]]),
    ]
    return pa.table({"kind": kinds, **{name: pa.array(c.astype("i8")) for name, c in zip("abn", columns)}})


def _searched(graph: DataFrame, nodes: DataFrame, least: float, beam: int) -> DataFrame:
    """All that every node finds, shard after shard until no search goes on."""
    ship(graph.sparkSession)
    found = stored(graph.groupBy("cell").applyInArrow(lambda rows: _search(rows, None, least, beam), _FOUND), "found")
    visited = graph.select(F.col("node").alias("x"), "cell")
    whole = found
    while True:
        calls = found.filter(F.col("kind") == _GO_ON).groupBy(F.col("a").alias("x"), F.col("b").alias("cell")).agg(F.slice(F.array_sort(F.collect_set("n")), 1, 16).alias("starts"))
        calls = stored(calls.join(visited, ["x", "cell"], "left_anti"), "calls")
        if calls.isEmpty():
            return whole
        blocks = calls.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _QUERIES).cast("int").alias("blocks"))
        asked = calls.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
        asked = asked.join(nodes.select(F.col("node").alias("x"), "unit"), "x").select("cell", "block", "x", "starts", "unit")
        needed = graph.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        both = needed.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block"))

        def search(shard: pa.Table, queries: pa.Table) -> pa.Table:
            if not shard.num_rows or not queries.num_rows:
                return pa.table({"kind": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in "abn"}})
            return _search(shard, queries, least, beam)

        found = stored(both.applyInArrow(search, _FOUND), "found")
        visited = visited.unionByName(calls.select("x", "cell"))
        whole = whole.unionByName(found)


def _audit(nodes: DataFrame, degrees: DataFrame, least: float) -> float:
    """Share of the links of a bounded set of nodes, counted by brute force over all nodes, that the search has found."""
    total = nodes.count()
    asked = nodes.filter(_order_of(F.col("node")) * total < AUDITED).orderBy("node").limit(2 * AUDITED).select("node", "unit", "n").collect()
    if not asked:
        return 1.0
    by_dims: dict[int, list] = {}
    for r in asked:
        by_dims.setdefault(len(r.unit), []).append(r)
    sets = {size: (np.array([r.node for r in rows]), np.frombuffer(b"".join(r.unit for r in rows), "f8").reshape(len(rows), -1)) for size, rows in by_dims.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            cells, n = batch.column("unit").to_pylist(), batch.column("n").to_numpy()
            node, sizes = batch.column("node").to_numpy(), np.array([len(c) for c in cells])
            for size, (who, units) in sets.items():
                here = np.flatnonzero(sizes == size)
                if len(here):
                    points = np.frombuffer(b"".join(cells[h] for h in here), "f8").reshape(len(here), -1)
                    linked = (units @ points.T >= least) & (who[:, None] != node[here][None])
                    for x, c in zip(who.tolist(), (linked * n[here]).sum(axis=1).tolist()):
                        sums[x] = sums.get(x, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["node", "links"])

    true = map_batches(nodes.select("node", "unit", "n"), count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    both = true.join(degrees, "node", "left").agg(F.sum(F.least("links", F.coalesce("degree", F.lit(0)))), F.sum("links")).head()
    return both[0] / both[1] if both[1] else 1.0


def near_vectors(vectors: DataFrame, least: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding", beam: int = BEAM) -> DataFrame:
    """Every row's vec_id, n_links, component_id, kept, and ``audited_recall`` (one figure for the whole run).

    Two vectors link if their cosine, in double precision, is at least ``least``; pairs below are never linked, some above
    may be missed: the audit measures how many, and the beam is doubled until it finds ``LEAST_RECALL`` of the audited links.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths. Equal vectors
    are one node with the number of its rows, so repeated rows count. ``component_id`` is the smallest vec_id reachable by links
    (null ids last); a row with a null id and no link has a null one. Other columns are not handed on.
    """
    rows, nodes = distinct_vectors(vectors, id_column, vector_column)
    graph = union_graph(shards(nodes), nodes)
    while True:
        found = _searched(graph, nodes, least, beam)
        degrees = stored(found.filter(F.col("kind") == _COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree")), "degrees")
        recall = _audit(nodes, degrees, least)
        if recall >= LEAST_RECALL or beam >= 2 * SHARD:
            break
        beam *= 2
    roots = connected_components(found.filter(F.col("kind") == _LINK).select("a", "b"))
    labelled = nodes.select("node", "high", "low", "least", "n").join(roots, "node", "left").join(degrees, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = labelled.join(smallest, "root").select("high", "low", (F.col("n") - 1 + F.coalesce("degree", F.lit(0))).alias("links"), F.col("component_id").alias("reached"))
    whole = rows.join(of_node, ["high", "low"], "left")
    component = F.when(F.col("links") > 0, F.col("reached")).otherwise(F.col("vec_id"))
    return whole.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("audited_recall"),
    )
