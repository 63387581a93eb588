"""Approximate nearest neighbours by a hierarchical navigable small-world graph for each shard.

Equal vectors are one node that keeps its smallest ids, as many as a result can hold. Nodes are dealt to shards by a hash, and each shard's
graph is built in one task by insertion: a node's level is drawn from a hash; nodes come in batches, the first small, later ones in
proportion to the graph. A batch walks the graph so far together, greedily on the levels above a node's own and with a beam from there down, and on
each level a node is linked both ways to those of what the beam holds, and of its batch, that lie in different directions. Two far links
for each node keep clusters connected. The graph is stored as flat arrays of neighbours, a row for each shard.

Shards grow with the table: up to 64 of them hold as many nodes as they must, beyond that each holds what a task's memory does (`shard_bytes` of
vectors, `shard_rows` at most), so that there are as few graphs to search as can be. Queries are dealt to groups of QUERY_GROUP, and each group meets
each shard in one task, which holds the shard once and reads the queries in blocks. Walks use float32; what they find is scored on the
original vectors in double precision, and shard results, a few rows a query, are merged by these scores.

Every shard is searched for every query, so work grows with queries times shards, that is, with the square of the table once shards have their
largest size; memory is that of one shard and one block of queries.

Cases: vectors that are null, empty or zero, or hold a null or non-finite component, take no part; large components don't overflow;
a null id takes no part; vectors of different length are never compared; ties go to the smaller id; with fewer candidates all are
returned; rows with the same id and vector are one candidate; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.llm.common import cut, small_batches, start_task

#: Nodes of a shard: at least as many before there is another shard, and at most; bytes of its vectors at most; shards before the largest size counts.
LEAST_ROWS, SHARD_ROWS, SHARD_BYTES, SPREAD = 16_384, 131_072, 64 << 20, 64
#: Queries that meet a shard in one task, and that are packed in a row.
QUERY_GROUP, QUERY_BLOCK = 65_536, 512
#: Neighbours of a node on upper levels and on the lowest, candidates among which they are chosen, far links, beam.
LINKS, LOW_LINKS, CHOICE, FAR, BEAM = 16, 64, 64, 2, 160
#: Nodes of a beam that are opened at once; first and largest batch of an insertion; marks of seen nodes that are held at once, in bytes.
OPENED, FIRST_BATCH, BATCH, SEEN = 4, 256, 2048, 1 << 21


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm one; scaled first, so that large and small components don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _tamed(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, divided by powers of two, which changes no cosine and keeps squares finite."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


class Level:
    """The nodes of a level in the order of insertion, and their neighbours as places among them, -1 where there are fewer."""

    def __init__(self, members: np.ndarray, table: np.ndarray):
        self.members, self.table = members, table
        self.count = len(members)


def _walk(level: Level, unit: np.ndarray, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Goes to better neighbours while there are any."""
    at = at.copy()
    here = np.einsum("ij,ij->i", queries, unit[level.members[at]])
    rows = np.arange(len(at))
    while len(rows):
        found = level.table[at[rows]]
        score = np.where(found >= 0, np.einsum("ij,ikj->ik", queries[rows], unit[level.members[np.maximum(found, 0)]]), -np.inf)
        best = score.argmax(axis=1)
        better = score[np.arange(len(rows)), best] > here[rows]
        rows, found, score, best = rows[better], found[better], score[better], best[better]
        at[rows], here[rows] = found[np.arange(len(rows)), best], score[np.arange(len(rows)), best]
    return at


def _beam(level: Level, unit: np.ndarray, queries: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of the beam of each query, -1 where it isn't full. As many queries walk together as keep their marks in a cache."""
    step = max(64, SEEN // (level.count + 1))
    parts = [_beam_together(level, unit, queries[a : a + step], at[a : a + step], beam) for a in range(0, len(queries), step)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _beam_together(level: Level, unit: np.ndarray, queries: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n, q = level.count, len(queries)
    ids, near, done = np.full((q, beam), -1), np.full((q, beam), -np.inf, np.float32), np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # what short lists are filled with
    rows = np.arange(q)
    ids[:, 0], near[:, 0], done[:, 0], seen[rows, at] = at, np.einsum("ij,ij->i", queries, unit[level.members[at]]), False, True
    opened = min(OPENED, beam)
    while len(rows):
        open_ = np.where(done[rows], -np.inf, near[rows])
        best = np.argpartition(-open_, opened - 1, axis=1)[:, :opened]
        live = np.take_along_axis(open_, best, axis=1) > -np.inf
        some = live.any(axis=1)
        rows, best, live = rows[some], best[some], live[some]
        if not len(rows):
            break
        done[rows[:, None], best] = True
        found = level.table[np.where(live, ids[rows[:, None], best], 0)]
        found = np.where(live[:, :, None] & (found >= 0), found, n).reshape(len(rows), -1)
        found.sort(axis=1)
        new = ~seen[rows[:, None], found]
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen[rows[:, None], found] = True
        r, c = np.nonzero(new)
        score = np.full(found.shape, -np.inf, np.float32)
        score[r, c] = np.einsum("ij,ij->i", queries[rows[r]], unit[level.members[found[r, c]]])
        all_near = np.hstack([near[rows], score])
        keep = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        ids[rows], near[rows], done[rows] = (np.take_along_axis(x, keep, axis=1) for x in (np.hstack([ids[rows], found]), all_near, np.hstack([done[rows], ~new])))
    return np.where(near > -np.inf, ids, -1), near


def _chosen(unit: np.ndarray, who: np.ndarray, score: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates (nodes, best first, score -inf where there is none) up to `links` of which none is nearer to a better one than to the node."""
    x = unit[who]
    between = np.matmul(x, x.transpose(0, 2, 1))
    keep = np.zeros(who.shape, bool)
    for j in range(who.shape[1]):
        keep[:, j] = (score[:, j] > -np.inf) & ~((between[:, :j, j] >= score[:, j : j + 1]) & keep[:, :j]).any(axis=1)
    rank = np.argsort(~keep, axis=1, kind="stable")[:, :links]
    return np.take_along_axis(who, rank, axis=1), np.where(np.take_along_axis(keep, rank, axis=1), np.take_along_axis(score, rank, axis=1), -np.inf)


class Graph:
    """Levels over unit vectors; level 0 has all nodes."""

    def __init__(self, unit: np.ndarray, levels: list[Level]):
        self.unit, self.levels = unit, levels
        #: Where each level's nodes stand on the level below.
        self.down = [None, *(np.searchsorted(a.members, b.members) for a, b in zip(levels, levels[1:]))]

    @classmethod
    def build(cls, unit: np.ndarray, draw: np.ndarray) -> Graph:
        """`draw` has a random 64-bit number for each node."""
        n = len(unit)
        u = (draw >> np.uint64(11)).astype(float) / 2**53
        height = np.minimum(np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)), 8).astype(int)
        levels = []
        for k in range(int(height.max(initial=0)) + 1):
            members = np.flatnonzero(height >= k)
            level = Level(members, np.full((len(members), LINKS if k else LOW_LINKS), -1, np.int32))
            level.count = 0
            levels.append(level)
            if len(members) <= LINKS:
                break
        graph = cls(unit, levels)
        scores = [np.full((len(level.members), -(-level.table.shape[1] // 2)), -np.inf, np.float32) for level in levels]  # of those that chose a node
        at = 0
        while at < n:
            end = min(n, at + max(FIRST_BATCH, min(BATCH, at // 2)))
            graph._insert(at, end, scores)
            at = end
        low = levels[0]
        far = np.stack([np.random.default_rng(f).permutation(n) for f in range(FAR)], axis=1).astype(np.int32)  # a fixed shuffle for each far link
        low.table = np.hstack([low.table, np.where(far == np.arange(n)[:, None], -1, far)])
        return graph

    def _insert(self, begin: int, end: int, scores: list[np.ndarray]) -> None:
        new = self.unit[begin:end]
        at = None
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            first, last = np.searchsorted(level.members, [begin, end])
            own = level.members[first:last] - begin  # of the batch, on this level
            found, near = np.empty((len(own), 0), np.int64), np.empty((len(own), 0), np.float32)
            if level.count:
                if at is None:
                    at = (new @ self.unit[level.members[: level.count]].T).argmax(axis=1)
                if k:
                    at = _walk(level, self.unit, new, at)
                if len(own):
                    found, near = _beam(level, self.unit, new[own], at[own], CHOICE)
            if len(own):
                self._link(level, scores[k], first, own + begin, found, near)
                level.count = int(last)
            if at is not None and k:
                at = self.down[k][at]

    def _link(self, level: Level, scores: np.ndarray, first: int, nodes: np.ndarray, found: np.ndarray, near: np.ndarray) -> None:
        """Links new nodes, which stand from place `first` on, to what their beams found and to each other."""
        links = level.table.shape[1]
        mates = self.unit[nodes] @ self.unit[nodes].T
        np.fill_diagonal(mates, -np.inf)
        width = min(CHOICE, len(nodes))
        who = np.argpartition(-mates, width - 1, axis=1)[:, :width]
        who, score = np.hstack([found, who + first]), np.hstack([np.where(found >= 0, near, -np.inf), np.take_along_axis(mates, who, axis=1)])
        order = np.argsort(-score, axis=1, kind="stable")[:, :CHOICE]
        who, score = np.maximum(np.take_along_axis(who, order, axis=1), 0), np.take_along_axis(score, order, axis=1)
        places = np.arange(first, first + len(nodes))
        pairs = []
        for a in range(0, len(nodes), 512):
            some, s = _chosen_places(level, self.unit, who[a : a + 512], score[a : a + 512], links // 2)
            r, c = np.nonzero(s > -np.inf)
            pairs.append((places[a + r], some[r, c], s[r, c]))
        source, target, score = (np.concatenate(x) for x in zip(*pairs))
        own = links // 2  # a node's own choice keeps its places; of those that chose it the nearest stay, in the other ones
        rank = np.arange(len(source)) - np.searchsorted(source, source)
        level.table[source, rank] = target
        source, target = target, source
        order = np.lexsort((-score, source))
        source, target, score = source[order], target[order], score[order]
        rank = np.arange(len(source)) - np.searchsorted(source, source)
        fits = rank < links - own
        source, rank, target, score = source[fits], rank[fits], target[fits], score[fits]
        touched, row = np.unique(source, return_inverse=True)
        more, more_score = np.full((len(touched), links - own), -1, np.int32), np.full((len(touched), links - own), -np.inf, np.float32)
        more[row, rank], more_score[row, rank] = target, score
        both, both_score = np.hstack([level.table[touched, own:], more]), np.hstack([scores[touched], more_score])
        keep = np.argsort(-both_score, axis=1, kind="stable")[:, : links - own]
        level.table[touched, own:], scores[touched] = np.take_along_axis(both, keep, axis=1), np.take_along_axis(both_score, keep, axis=1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the beam of each unit query, -1 where it isn't full."""
        at = (queries @ self.unit[self.levels[-1].members].T).argmax(axis=1)
        for k in range(len(self.levels) - 1, 0, -1):
            at = self.down[k][_walk(self.levels[k], self.unit, queries, at)]
        return _beam(self.levels[0], self.unit, queries, at, beam)


def _chosen_places(level: Level, unit: np.ndarray, who: np.ndarray, score: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
    nodes, score = _chosen(unit, level.members[who], score, links)
    return np.searchsorted(level.members, nodes), score


INDEX = "shard int, dim int, vectors binary, ids array<array<long>>, nodes array<binary>, neighbours array<binary>"
#: What a task reads for a shard and a group of queries: the shard first, then blocks of queries.
MET = "shard int, grp int, block int, " + INDEX.split(", ", 1)[1] + ", queries array<struct<h1:long,h2:long>>, places binary"


def _element(vectors: DataFrame, vector_col: str) -> str:
    """The precision in which vectors are kept: that of the column."""
    kind = vectors.schema[vector_col].dataType
    return "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"


def _valid(vectors: DataFrame, id_col: str, vector_col: str, element: str) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast(f"array<{element}>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))


def shards_of(n: int, dim: int, shard_rows: int, shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards n vectors make."""
    largest = max(1, min(shard_rows, shard_bytes // (4 * dim)))
    return max(-(-n // largest), min(SPREAD, -(-n // LEAST_ROWS)))


def build_index(valid: DataFrame, k: int, shard_rows: int = SHARD_ROWS, element: str = "double") -> DataFrame:
    """INDEX: a row for each shard, checkpointed."""
    order = Window.partitionBy("h1", "h2").orderBy("id")
    some = valid.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    nodes = cut(some.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each vector length
    first, total = {}, 0
    for dim, n in sorted(sizes.items()):
        first[dim] = (total, shards_of(n, dim, shard_rows))
        total += first[dim][1]
    spark = valid.sparkSession
    if not first:
        return spark.createDataFrame([], INDEX)
    deal = spark.createDataFrame([(d, a, n) for d, (a, n) in first.items()], "dim int, first int, parts int")
    dealt = nodes.withColumn("dim", F.size("v")).join(F.broadcast(deal), "dim")  # a row for each vector length
    shard = (F.col("first") + F.pmod("h1", "parts")).cast("int")
    dealt = dealt.select(shard.alias("shard"), "dim", "h2", "ids", "v").repartitionByRange(total, "shard").sortWithinPartitions("shard", "h2", F.col("ids")[0])  # hashes of few numbers would put several shards in a task

    def make(shard: int, dim: int, draw: list, ids: list, flat: np.ndarray) -> pa.RecordBatch:
        x = flat.reshape(-1, dim)
        graph = Graph.build(_unit(x), np.asarray(draw, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        columns = ([shard], [dim], [x.tobytes()], [ids], [[a.members.astype(np.int32).tobytes() for a in graph.levels]], [[a.table.astype(np.int32).tobytes() for a in graph.levels]])
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.binary()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "dim", "vectors", "ids", "nodes", "neighbours"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("neighbours")
        now, draw, ids, flat = None, [], [], []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                key = int(shards[a]), batch.column(1)[a].as_py()
                if key != now:
                    if now:
                        yield make(*now, draw, ids, np.concatenate(flat))
                    now, draw, ids, flat = key, [], [], []
                part = batch.slice(a, b - a)
                draw += part.column(2).to_pylist()
                ids += part.column(3).to_pylist()
                flat.append(part.column(4).flatten().to_numpy())
        if now:
            yield make(*now, draw, ids, np.concatenate(flat))

    return cut(small_batches(dealt).mapInArrow(run, INDEX))


def _search(k: int, beam: int, element: str):
    kind = np.float32 if element == "float" else np.float64

    def results(graph: Graph, vectors: np.ndarray, ids: list, keys: list[dict], queries: np.ndarray) -> pa.RecordBatch:
        found, near = graph.search(_unit(queries), min(max(beam, 2 * (k + 1)), len(vectors)))
        best = np.argsort(-near, axis=1, kind="stable")[:, : 2 * (k + 1)]
        found = np.take_along_axis(found, best, axis=1)
        # exact scores of the best that were found
        a, b = _tamed(queries), _tamed(vectors[found])
        exact = np.einsum("ij,ikj->ik", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ikj,ikj->ik", b, b)))
        out: list[tuple] = []
        for q, some, scores in zip(keys, found.tolist(), exact.tolist(), strict=True):
            all_ = sorted((-s, i) for node, s in zip(some, scores, strict=True) if node >= 0 for i in ids[node])
            out += [(q["h1"], q["h2"], i, -s) for s, i in all_[: k + 1]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["h1", "h2", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("neighbours")
        graph, vectors, ids, shard = None, None, [], -1
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(2)[row].as_py() < 0:
                    if batch.column(0)[row].as_py() != shard:
                        shard, dim = batch.column(0)[row].as_py(), batch.column(3)[row].as_py()
                        vectors = np.frombuffer(batch.column(4)[row].as_py(), kind).reshape(-1, dim)
                        ids = batch.column(5)[row].as_py()
                        nodes = [np.frombuffer(x, np.int32) for x in batch.column(6)[row].as_py()]
                        tables = [np.frombuffer(x, np.int32).reshape(len(a), -1) for a, x in zip(nodes, batch.column(7)[row].as_py(), strict=True)]
                        graph = Graph(_unit(vectors), [Level(a, b) for a, b in zip(nodes, tables, strict=True)])
                    continue
                keys = batch.column(8)[row].as_py()
                yield results(graph, vectors, ids, keys, np.frombuffer(batch.column(9)[row].as_py(), kind).reshape(len(keys), -1))

    return run


def _packed(queries: DataFrame, groups: int, element: str) -> DataFrame:
    """Query vectors in rows of QUERY_BLOCK of one length and group: dim, grp, block, queries, places."""
    numbered = queries.dropDuplicates(["h1", "h2"]).select(F.size("v").alias("dim"), F.pmod("h1", F.lit(groups)).cast("int").alias("grp"), F.pmod("h2", F.lit(-(-QUERY_GROUP // QUERY_BLOCK))).cast("int").alias("block"), "h1", "h2", "v")
    kind = np.float32 if element == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("neighbours")
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                rows.setdefault(key, []).append(i)
            out = []
            for key, at in rows.items():
                part = batch.take(pa.array(at))
                keys = [{"h1": a, "h2": b} for a, b in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                out.append((*key, keys, part.column(5).flatten().to_numpy().astype(kind).tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())])), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["dim", "grp", "block", "queries", "places"])

    width = max(1, groups * -(-QUERY_GROUP // QUERY_BLOCK) // 32)
    dealt = numbered.repartition(width, "dim", "grp", "block").sortWithinPartitions("dim", "grp", "block")
    return dealt.mapInArrow(run, "dim int, grp int, block int, queries array<struct<h1:long,h2:long>>, places binary")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row that `is_query` (on the id, called id) selects."""
    element = _element(vectors, vector_col)
    valid = _valid(vectors, id_col, vector_col, element)
    index = build_index(valid, k, shard_rows, element)
    queries = valid.where(is_query).distinct()
    groups = max(1, -(-queries.count() // QUERY_GROUP))
    shards = index.select("shard", "dim")
    blocks = _packed(queries, groups, element).join(F.broadcast(shards), "dim")  # two numbers for each 16,384 vectors and more
    nothing = index.schema
    visits = blocks.select("shard", "grp", "block", *(F.lit(None).cast(nothing[c].dataType).alias(c) for c in nothing.names[1:]), "queries", "places")
    kept = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(-1).alias("block"), *nothing.names[1:], F.lit(None).cast("array<struct<h1:long,h2:long>>").alias("queries"), F.lit(None).cast("binary").alias("places"))
    width = max(1, 4 * shards.count() * groups)  # few meet in a task by chance
    met = kept.unionByName(visits).repartition(width, "shard", "grp").sortWithinPartitions("shard", "grp", "block")
    found = small_batches(met).mapInArrow(_search(k, beam, element), "h1 long, h2 long, vec_id long, score double")
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k)
    rows = queries.select("id", "h1", "h2").join(best, ["h1", "h2"]).select(F.col("id").alias("query_id"), F.posexplode(own).alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
