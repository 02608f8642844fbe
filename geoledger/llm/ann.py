"""Approximate nearest neighbours by balanced posting lists.

Vectors of one length are a node. A node that holds more rows than a list is cut into balanced clusters, learnt from a
bounded sample of its rows, and the clusters are nodes of the next level; so there are as many lists as the rows need, and
no node has more than FANOUT children, whose centroids are kept in memory with a neighbour graph that rows and queries
search. A vector near a boundary is put into the lists of several clusters. A query reads the lists whose centroid is not
much farther than its nearest one. How much is measured: of CALIBRATION vectors the true neighbours are found by brute
force, and the least ratio of distances by which TARGET of them would be read is taken. Clustered vectors need few lists
then, and noise honestly needs many.

Rows meet centroids, and queries meet lists, in sorted partitions where the smaller side is held and the other streams
past, so every vector is sent once for each of its lists, however many queries there are. A block that grows long, or that
very many queries read, is dealt into sublists that all its queries meet; none is cut short. Up to BLOCK_LISTS sibling lists
are a block: a query is one row for each block with the lists that it reads there, and is compared with those lists only.

Equal vectors are one entry with their smallest ids, as many as an answer can hold; found neighbours get exact cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoledger.llm.common import checkpointed, table

#: Rows of a list that a cut makes, about; a node is cut if it holds more than WHOLE_ROWS.
LIST_ROWS, WHOLE_ROWS = 64, 512
#: Children of a node at most, rows they are learnt from for each, and numbers in one node's sample at most.
FANOUT, PER_CHILD, SAMPLE_VALUES = 1_024, 24, 1 << 24
#: Levels at most: a crowd that no clusters part (all in one direction) stays one list, which is dealt into sublists.
MOST_LEVELS = 4
#: Neighbours in the centroids' graph, random long links beside them, and the beam that searches it.
GRAPH_DEGREE, LONG_LINKS, BEAM = 20, 4, 16
#: A vector is copied to lists up to so many times its nearest centroid's distance away, and to so many at most.
CLOSURE_RATIO, MOST_COPIES = 1.04, 3
#: Vectors that the pruning ratio is measured with, and the share of their neighbours that must be read.
CALIBRATION, TARGET = 128, 0.95
#: Above the last level nodes are kept up to so many times farther than the ratio says, and so many of the nearest anyway.
SLACK, UPPER_LEAST = 1.05, 8
#: Distances that differ by rounding only are no further apart than this.
ROUNDING = 1e-6
#: Sibling lists that are held together; a query's vector is sent once for each such block, not for each list.
BLOCK_LISTS = 16
#: Rows that meet one copy of a node's centroids; rows of one sublist, and products of rows and queries in it.
ROUTE_ROWS, SUBLIST_ROWS, SUBLIST_WORK = 16_384, 4_096, 1 << 28
#: Rows of answers that a task holds at most.
HELD_ROWS = 1 << 20
_BATCH = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares of very large or small components are numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_clusters(x: np.ndarray, clusters: int, seed: int = 11) -> np.ndarray:
    """Unit centroids of about so many clusters of unit vectors: halve by two-means, each side between 0.4 and 0.6."""
    rng, done, todo = np.random.default_rng(seed), [], [np.arange(len(x))]
    size = max(1.0, len(x) / clusters)
    while todo:
        rows = todo.pop()
        if len(rows) <= 1.5 * size:
            done.append(rows)
            continue
        part = x[rows]
        pair = part[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            lean = part @ (pair[0] - pair[1])
            first = lean > np.median(lean)
            pair = np.stack([part[first].mean(axis=0), part[~first].mean(axis=0)]) if 0 < first.sum() < len(rows) else pair
        order = np.argsort(-(part @ (pair[0] - pair[1])), kind="stable")
        at = int(np.clip((part @ (pair[0] - pair[1]) > (pair @ pair.T).diagonal() @ [0.5, -0.5]).sum(), 0.4 * len(rows), 0.6 * len(rows)))
        at = min(max(at, 1), len(rows) - 1)
        todo += [rows[order[:at]], rows[order[at:]]]
    centroids = np.stack([x[rows].mean(axis=0) for rows in done])
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)


def graph(centroids: np.ndarray, degree: int = GRAPH_DEGREE) -> np.ndarray:
    """Links from each centroid to its nearest ones, and a few long ones that keep the graph in one piece."""
    near, links = min(degree, len(centroids) - 1), []
    for at in range(0, len(centroids), 512):
        alike = centroids[at : at + 512] @ centroids.T
        alike[np.arange(len(alike)), np.arange(at, at + len(alike))] = -9
        links.append(np.argsort(-alike, axis=1, kind="stable")[:, :near])
    far = np.random.default_rng(5).integers(0, len(centroids), (len(centroids), LONG_LINKS))
    return np.concatenate((np.concatenate(links), far), axis=1).astype(np.int32)


class Centroids:
    """A node's centroids, searched along their graph by a beam, many vectors at a time."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray | None = None):
        self.vectors = vectors
        self.links = graph(vectors) if links is None else links
        self.entries = np.unique(np.linspace(0, len(vectors) - 1, 24).astype(int))

    def search(self, x: np.ndarray, ratio: float = 1.0, least: int = 1, beam: int = BEAM, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, distance): the centroids found within ratio times the nearest one's distance of each unit vector, or among its ``least`` nearest.

        Centroids are opened, nearest first, while they are among the beam's or within the ratio.
        """
        n, k = len(x), len(self.vectors)
        alike, opened = np.full((n, k), -np.inf), np.zeros((n, k), bool)
        live = np.arange(n)
        new = np.broadcast_to(self.entries, (n, len(self.entries)))
        while len(live):
            alike[live[:, None], new] = np.einsum("nd,nmd->nm", x[live], self.vectors[new])
            own = alike[live]
            reach = 1 - 0.5 * ratio * ratio * np.maximum(0, 2 - 2 * own.max(axis=1))
            kth = np.partition(own, max(0, k - beam), axis=1)[:, max(0, k - beam)]
            ready = np.where(opened[live] | (own < np.minimum(reach, kth)[:, None]), -np.inf, own)
            pick = np.argpartition(-ready, min(width, k) - 1, axis=1)[:, : min(width, k)]
            worth = np.isfinite(np.take_along_axis(ready, pick, 1))
            going = worth.any(axis=1)
            pick, worth, live = pick[going], worth[going], live[going]
            pick = np.where(worth, pick, pick[np.arange(len(pick)), worth.argmax(axis=1)][:, None])
            if len(live):
                opened[live[:, None], pick] = True
                new = self.links[pick].reshape(len(live), -1)
        distance = np.sqrt(np.maximum(0, 2 - 2 * alike))
        limit = ratio * distance.min(axis=1, keepdims=True) + ROUNDING
        if least > 1:
            limit = np.maximum(limit, np.partition(distance, min(least, k) - 1, axis=1)[:, min(least, k) - 1 : min(least, k)])
        rows, places = np.nonzero(np.isfinite(alike) & (distance <= limit))
        return rows, places, distance[rows, places]


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part.

    Rows without an id or a vector, and vectors that are zero or hold a null, NaN or infinite component, take no part.
    """
    v = F.col("embedding").cast("array<double>")
    got = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return got.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x != 0)")


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"


def _cosine(a: str, b: str) -> str:
    """One root of both squares' product, where it is a number, rounds least: vectors of one direction tie at 1."""
    squares = f"{_dot(a, a)} * {_dot(b, b)}"
    apart = f"sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})"
    return f"{_dot(a, b)} / if({squares} between 1e-290 and 1e290, sqrt({squares}), {apart})"


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(key, kind, rows): rows that follow each other with the same first two columns (the key) and third (the kind)."""
    for batch in batches:
        first, second, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        change = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if b > a:
                yield (first[a], second[a]), int(kind[a]), batch.slice(a, b - a)


def _meeting(held: DataFrame, streamed: DataFrame, key: str, part: str) -> DataFrame:
    """Both sides in partitions by key and part, sorted so that the held rows (kind 0) come before those that stream past."""
    both = held.withColumn("kind", F.lit(0)).unionByName(streamed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    order = [key, part, "kind", *(c for c in held.columns if c not in (key, part))]
    return both.select(*order).repartition(key, part).sortWithinPartitions(key, part, "kind")


def _in_blocks(lists: DataFrame) -> DataFrame:
    """The columns of lists and, for its node, block and place: children of one node are in blocks by their numbers, a node without a parent is a block."""
    number = "cast(substring_index(node, '.', -1) as int)"
    blocks = f"concat(substring(node, 1, length(node) - length(substring_index(node, '.', -1))), 'b', {number} div {BLOCK_LISTS})"
    return lists.withColumn("block", F.expr(f"if(instr(node, '.') > 0, {blocks}, node)")).withColumn("place", F.expr(f"if(instr(node, '.') > 0, {number}, 0)"))


def _length(node: str) -> int:
    """The vectors' length, with which a node's name begins."""
    return int(node.partition(".")[0])


def _route(rows: DataFrame, level: DataFrame, ratio: float, least: int, most: int | None) -> DataFrame:
    """(uid, node, distance): the children of their node that rows (uid, node, v) belong to, ``most`` of the nearest ones.

    They are within the ratio of the nearest, or among the ``least`` nearest.
    """
    sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / ROUTE_ROWS).cast("int").alias("parts"))
    known = checkpointed(level.select("node").join(sizes, "node"))
    heads = level.join(known, "node").select("node", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(-1).cast("long").alias("uid"), F.col("centroids").alias("v"), "links")
    asking = rows.join(known, "node").select("node", F.expr("cast(pmod(xxhash64(uid), parts) as int)").alias("part"), "uid", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for (node, _), kind, part in _stretches(batches):
            width = _length(node)
            if kind == 0:
                vectors = _matrix(part.column(4), width)
                index = Centroids(vectors, _matrix(part.column(5), len(part.column(5)[0]) // len(vectors)))
                continue
            uids, x = part.column(3).to_numpy(), unit(_matrix(part.column(4), width))
            for at in range(0, len(x), _BATCH):
                at_row, place, distance = index.search(x[at : at + _BATCH], ratio, least)
                if most is not None:
                    order = np.lexsort((place, distance, at_row))
                    at_row, place, distance = at_row[order], place[order], distance[order]
                    first = np.searchsorted(at_row, at_row)
                    keep = np.arange(len(at_row)) - first < most
                    at_row, place, distance = at_row[keep], place[keep], distance[keep]
                names = pa.array([f"{node}.{p}" for p in place.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(uids[at : at + _BATCH][at_row]), names, pa.array(distance)], ["uid", "node", "distance"])

    return _meeting(heads, asking, "node", "part").mapInArrow(run, "uid long, node string, distance double")


def _learn(placed: DataFrame, vectors: DataFrame) -> DataFrame | None:
    """(node, centroids, links) of the nodes that are cut, each learnt from a bounded sample of its rows; None if none is."""
    sizes = placed.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE_ROWS)
    sizes = sizes.withColumn("width", F.expr("cast(substring_index(node, '.', 1) as long)"))
    sizes = sizes.withColumn("most", F.expr(f"least({PER_CHILD * FANOUT}, {SAMPLE_VALUES} div width)"))
    sizes = sizes.withColumn("children", F.expr(f"cast(greatest(2, least({FANOUT}, ceil(n / {LIST_ROWS}), most div 4)) as int)"))
    sizes = checkpointed(sizes.withColumn("share", F.expr(f"least(1D, greatest(64D, least(most, {PER_CHILD} * children)) / n)")).select("node", "children", "share"))
    if not sizes.take(1):
        return None
    drawn = placed.join(sizes, "node").where("pmod(xxhash64(uid, 'learn', node), 16777216) < share * 16777216").select("uid", "node", "children")

    def run(key, part):
        x = unit(np.stack(part["v"].to_numpy()))
        x = x[np.lexsort(x.T)]  # rows come in any order
        centroids = balanced_clusters(x, int(part["children"].iloc[0]))
        return part.iloc[:1][["node"]].assign(centroids=[centroids.ravel()], links=[graph(centroids).ravel()])

    return checkpointed(drawn.join(vectors, "uid").groupBy("node").applyInPandas(run, "node string, centroids array<double>, links array<int>"))


def _closest(placed: DataFrame, ratio: float, most: int | None) -> DataFrame:
    """Of the lists of each uid those within the ratio of its nearest, ``most`` at most."""
    own = Window.partitionBy("uid")
    near = placed.withColumn("least", F.min("distance").over(own)).where(F.col("distance") <= ratio * F.col("least") + ROUNDING)
    if most is not None:
        near = near.withColumn("at", F.row_number().over(own.orderBy("distance", "node"))).where(F.col("at") <= most)
    return near.drop("least", "at")


@dataclass
class Index:
    """Levels of nodes, and the lists (nodes without children) that every vector is in."""

    vectors: DataFrame
    levels: list[DataFrame]
    lists: DataFrame

    @classmethod
    def of(cls, vectors: DataFrame) -> Index:
        """vectors: uid, v, all of them different. Every vector is in one list at least."""
        index = cls(vectors, [], vectors.select("uid", F.size("v").cast("string").alias("node"), F.lit(0.0).alias("distance")))
        moving, settled = index.lists, None
        while len(index.levels) < MOST_LEVELS and (level := _learn(moving, vectors)) is not None:
            index.levels.append(level)
            still, moved = index._step(moving, level, CLOSURE_RATIO, 1, MOST_COPIES)
            settled = still if settled is None else settled.unionByName(still)
            if len(index.levels) > 1:  # a vector's copies come from several parents
                both = settled.withColumn("done", F.lit(True)).unionByName(moved.withColumn("done", F.lit(False)))
                near = checkpointed(_closest(both, CLOSURE_RATIO, MOST_COPIES))
                settled, moved = near.where("done").drop("done"), near.where("not done").drop("done")
            moving = checkpointed(moved)
        index.lists = moving if settled is None else checkpointed(settled.unionByName(moving))
        return index

    def _step(self, moving: DataFrame, level: DataFrame, ratio: float, least: int, most: int | None) -> tuple[DataFrame, DataFrame]:
        """(rows whose node has no children, rows moved to children of theirs)."""
        nodes = level.select("node")
        going = moving.join(nodes, "node", "left_semi").join(self.vectors, "uid").select("uid", "node", "v")
        return moving.join(nodes, "node", "left_anti"), _route(going, level, ratio, least, most)

    def probes(self, queries: DataFrame, ratio: float) -> DataFrame:
        """(uid, block, places): the lists that queries (uid) read, a row for each block of them."""
        moving, settled = queries.join(self.vectors, "uid").select("uid", F.size("v").cast("string").alias("node"), F.lit(0.0).alias("distance")), None
        for k, level in enumerate(self.levels, 1):
            last = k == len(self.levels)
            still, moved = self._step(moving, level, ratio if last else ratio * SLACK, 1 if last else UPPER_LEAST, None)
            settled = still if settled is None else settled.unionByName(still)
            moving = checkpointed(moved)
        found = moving if settled is None else settled.unionByName(moving)
        return _in_blocks(_closest(found, ratio, None)).groupBy("uid", "block").agg(F.collect_list("place").alias("places"))

    def ratio(self, k: int) -> float:
        """The least ratio of distances by which TARGET of the k nearest of CALIBRATION vectors, found by brute force, would be read."""
        if not self.levels:
            return 1.0
        drawn = self.vectors.orderBy(F.xxhash64("uid", F.lit("measure")), "uid").limit(CALIBRATION).select("uid", "v").toArrow().combine_chunks()
        uids, lists = drawn.column("uid").to_numpy(), drawn.column("v").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        of_length = {int(w): (uids[sizes == w], unit(_matrix(lists.filter(pa.array(sizes == w)), int(w)))) for w in np.unique(sizes)}

        def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {w: (np.full((len(x), k), -9.0), np.full((len(x), k), -1)) for w, (_, x) in of_length.items()}
            for batch in batches:
                here = batch.column(1).value_lengths().to_numpy()
                for w, (own, x) in of_length.items():
                    part = batch.filter(pa.array(here == w))
                    if part.num_rows:
                        near, at = best[w]
                        alike = x @ unit(_matrix(part.column(1), w)).T
                        ids = part.column(0).to_numpy()
                        alike[own[:, None] == ids] = -9
                        near, at = np.concatenate((near, alike), axis=1), np.concatenate((at, np.broadcast_to(ids, alike.shape)), axis=1)
                        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                        best[w] = np.take_along_axis(near, top, 1), np.take_along_axis(at, top, 1)
            for w, (near, at) in best.items():
                ok = near.ravel() > -9
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of_length[w][0], k)[ok]), pa.array(at.ravel()[ok]), pa.array(near.ravel()[ok])], ["quid", "uid", "near"])

        def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for node, flat in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if (w := _length(node)) in of_length:
                        own, x = of_length[w]
                        far = np.sqrt(np.maximum(0, 2 - 2 * x @ flat.values.to_numpy().reshape(-1, w).T))
                        names = [f"{node}.{p}" for p in range(far.shape[1])]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(names))), pa.array(names * len(own), pa.string()), pa.array(far.ravel())], ["quid", "node", "distance"])

        order = Window.partitionBy("quid").orderBy(F.desc("near"), "uid")
        near = self.vectors.select("uid", "v").mapInArrow(truth, "quid long, uid long, near double").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
        in_lists = checkpointed(self.lists.join(F.broadcast(near.select("quid", "uid")), "uid").select("quid", "uid", "node"))  # k * CALIBRATION rows are broadcast
        nodes = checkpointed(self._all_nodes())
        far = nodes.select("node", "centroids").mapInArrow(away, "quid long, node string, distance double").join(nodes.select("node"), "node", "left_anti")
        nearest = far.groupBy("quid").agg(F.min("distance").alias("least"))
        needs = far.join(F.broadcast(in_lists), ["quid", "node"]).join(nearest, "quid")  # MOST_COPIES times as many
        needs = in_lists.select("quid", "uid").distinct().join(needs.groupBy("quid", "uid").agg(F.min(F.col("distance") / F.greatest("least", F.lit(ROUNDING))).alias("r")), ["quid", "uid"], "left")
        got = [r["r"] if r["r"] is not None else 1.0 for r in needs.collect()]  # k * CALIBRATION numbers; one without a distance is in its length's only list
        return max(1.0, float(np.quantile(got, TARGET, method="higher"))) + 1e-6 if got else 1.0

    def _all_nodes(self) -> DataFrame:
        every = self.levels[0]
        for level in self.levels[1:]:
            every = every.unionByName(level)
        return every


class _Best:
    """The ``most`` nearest of each query among what a task has met so far, flushed when they are many."""

    def __init__(self, most: int):
        self._most, self._parts, self._rows = most, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Columns quid, uid, near, least."""
        self._parts.append(columns)
        self._rows += len(columns[0])
        if self._rows > HELD_ROWS:
            self._compact()
            if self._rows > HELD_ROWS // 2:
                yield from self.flush()

    def _compact(self) -> None:
        if not self._parts:
            return
        quid, uid, near, least = (np.concatenate(c) for c in zip(*self._parts))
        order = np.lexsort((uid, least, -near, quid))
        quid, uid, near, least = quid[order], uid[order], near[order], least[order]
        other = np.concatenate(([True], (quid[1:] != quid[:-1]) | (uid[1:] != uid[:-1])))
        quid, uid, near, least = quid[other], uid[other], near[other], least[other]
        keep = np.arange(len(quid)) - np.searchsorted(quid, quid) < self._most
        self._parts = [(quid[keep], uid[keep], near[keep], least[keep])]
        self._rows = int(keep.sum())

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._compact()
        for columns in self._parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["quid", "uid", "near", "least"])
        self._parts, self._rows = [], 0


class Search:
    """The k nearest of every usable row that ``is_query`` (SQL over vec_id) holds for, step by step."""

    def __init__(self, rows: DataFrame, is_query: str, k: int = 5):
        self.k = k
        own = checkpointed(usable(rows).distinct())
        place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        entries = own.withColumn("place", place).where(F.col("place") <= k + 1)  # no answer holds more of one vector's ids
        entries = entries.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        self.entries = checkpointed(entries.withColumn("uid", F.monotonically_increasing_id()))
        self.asked = checkpointed(own.where(is_query).join(self.entries.select("v", "uid"), "v").select(F.col("vec_id").alias("query_id"), "uid"))
        self.index = Index.of(self.entries.select("uid", "v"))
        self.ratio = self.index.ratio(k)
        queries = self.asked.select("uid").distinct()
        self.probes = checkpointed(self.index.probes(queries, self.ratio))
        rows = self._read().groupBy("uid").agg(F.sum("n").alias("n"))
        short = checkpointed(rows.where(F.col("n") <= (k + 1) * MOST_COPIES).select("uid"))
        if short.take(1):  # lists too small to answer: these queries read all lists of their length
            self.probes = self.probes.join(short, "uid", "left_anti").unionByName(self.index.probes(short, 1e6))

    def _sizes(self) -> DataFrame:
        """(block, n, own): rows of each block, and of each of its lists as a map."""
        lists = _in_blocks(self.index.lists).groupBy("block", "place").agg(F.count("*").alias("n"))
        return lists.groupBy("block").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("own"))

    def _read(self) -> DataFrame:
        """(uid, n): rows of the lists that a query reads in each of its blocks."""
        read = self.probes.join(self._sizes().drop("n"), "block")
        return read.select("uid", F.expr("aggregate(places, 0L, (s, p) -> s + coalesce(own[p], 0L))").alias("n"))

    def read_share(self) -> float:
        """The mean share of all entries, copies in several lists counted each, that one query's lists hold."""
        read, asked = self._read().agg(F.sum("n")).first()[0] or 0, self.asked.select("uid").distinct().count()
        return read / max(1, asked * self.entries.count())

    def _met(self) -> DataFrame:
        """(quid, uid, near, least): the nearest of each query in each task's sublists, k + 2 at least if there are (itself may be there); what differs by rounding only is a tie."""
        k, vectors = self.k, self.entries.select("uid", "v", F.col("ids")[0].alias("least"))
        asking = self.probes.groupBy("block").agg(F.count("*").alias("queries"))
        deal = self._sizes().join(asking, "block")
        deal = checkpointed(deal.selectExpr("block", f"cast(least(n, greatest(ceil(n / {SUBLIST_ROWS}), ceil(n * queries / {SUBLIST_WORK}))) as int) as subs"))
        held = _in_blocks(self.index.lists).join(deal, "block").select("block", F.expr("cast(pmod(xxhash64(uid), subs) as int)").alias("sub"), "uid", F.array("place").alias("places")).join(vectors, "uid")
        streamed = self.probes.join(deal, "block").select("block", F.explode(F.expr("sequence(0, subs - 1)")).alias("sub"), "uid", "places").join(vectors.drop("least"), "uid")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, parts, lists, met = None, [], None, _Best(k + 2)
            for key, kind, part in _stretches(batches):
                if key != last:
                    last, parts, lists = key, [], None
                width, places = _length(key[0]), part.column(4)
                if kind == 0:
                    parts.append((part.column(3).to_numpy(), part.column(6).to_numpy(), places.flatten().to_numpy(), unit(_matrix(part.column(5), width))))
                    continue
                if not parts:
                    continue
                if lists is None:
                    ids, least, place, x = (np.concatenate(c) for c in zip(*parts))
                    order = np.lexsort((least, place))
                    ids, least, place, x = ids[order], least[order], place[order], x[order]
                    cuts = np.flatnonzero(np.diff(place)) + 1
                    lists = {int(place[a]): (ids[a:b], least[a:b], x[a:b].T) for a, b in zip([0, *cuts], [*cuts, len(place)])}
                    parts = [()]
                quids, q = part.column(3).to_numpy(), unit(_matrix(part.column(5), width))
                row, reads = np.repeat(np.arange(len(quids)), places.value_lengths().to_numpy()), places.flatten().to_numpy()
                for p, (ids, least, own) in lists.items():
                    asked, most = row[reads == p], min(k + 2, len(ids))
                    for at in range(0, len(asked), _BATCH):
                        these = asked[at : at + _BATCH]
                        alike = np.round(q[these] @ own, 12)
                        best = np.argsort(-alike, axis=1, kind="stable")[:, :most]
                        near = np.take_along_axis(alike, best, 1).ravel()
                        yield from met.add(np.repeat(quids[these], most), ids[best.ravel()], near, least[best.ravel()])
            yield from met.flush()

        return _meeting(held, streamed, "block", "sub").mapInArrow(run, "quid long, uid long, near double, least long")

    def answers(self) -> DataFrame:
        """(query_id, rank, vec_id, score)."""
        k, vectors = self.k, self.entries.select("uid", "v")
        met = self._met().groupBy("quid", "uid").agg(F.max("near").alias("near"), F.first("least").alias("least"))
        met = met.withColumn("at", F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("near"), "least"))).where(F.col("at") <= k + 2)
        pairs = met.select("quid", "uid").unionByName(self.asked.select(F.col("uid").alias("quid"), "uid")).distinct()
        exact = pairs.join(vectors.select(F.col("uid").alias("quid"), F.col("v").alias("q")), "quid").join(self.entries, "uid")
        exact = exact.select("quid", "ids", F.expr(_cosine("q", "v")).alias("score"))
        found = self.asked.join(exact, F.col("quid") == F.col("uid")).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row that ``is_query`` (SQL over vec_id) holds for, its k nearest.

    Nearness is the cosine, in doubles, computed from the original vectors; ties go to the smaller vec_id. Vectors are
    compared with those of their own length. A row isn't its own neighbour. Repeated rows count once. With k or fewer
    candidates all come. An empty table gives no rows.
    """
    return Search(rows, is_query, k).answers()


def op4(spark, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
