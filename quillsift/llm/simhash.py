"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are routed by pairs of bit blocks: with six blocks, two fingerprints that differ in at most four bits
agree on two blocks at least, so they meet under one of 15 keys. Under each key the fingerprints are sorted by Gray rank, and
an index is built over them: each node holds the bits on which all fingerprints below it agree. The index is
joined with itself from the top of each node downwards: the differences that two nodes' shared bits already show are a lower
bound for all pairs below them, so that groups are pruned whole; pairs of groups that are known to be connected are pruned too.
Only links that connect are returned, so a dense group of n fingerprints gives fewer than n rows for each key.

Keys with very many fingerprints are dealt into cells: the fingerprints of a key are hashed into s parts and each pair of
parts is a cell, so that a task's work is bounded and every pair still meets.

Copies share a fingerprint and are one row from the first aggregation on. Components of the links come from graph.components; what is
joined back to them is checkpointed first, so that Spark can split the rows of a large component.

Cases: a null text counts as empty; texts without a word have fingerprint zero and are linked like any other; long texts are hashed in parts
that overlap by a shingle less a word; repeated rows get the same component; ties in the number of set bits leave a bit at 0; rows with a null id take part in links and get the component's id (null if it has none other); an empty table
gives an empty table; other columns, whatever their names, are carried through by keep_first and not read otherwise. keep_first states which rows stay
where ids are shared or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import cut, parts_at_spaces, small_batches, start_task, utf8
from quillsift.llm.graph import components

SEED = 42
#: Fingerprints of one key that a task compares at once, and rows of many keys that it holds at once.
CELL = 8192
HELD = 150_000
FANOUT = 8
#: Pairs of nodes that are looked at together.
FRONT = 1 << 17
_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint(text: bytes, width: int = 4) -> int:
    """64 bits by majority over the hashes of all shingles of `width` words."""
    ones, n = np.zeros(64, np.int64), 0
    carried: list[bytes] = []  # words that begin shingles of the next part
    for part in parts_at_spaces(text):
        words = carried + part.lower().split()
        carried = words[-width + 1 :] if width > 1 else []
        if len(words) < width:
            carried = words
            continue
        hashes = _shingles(words, width)
        n += len(hashes)
        for at in range(0, len(hashes), 255):
            some = hashes[at : at + 255].view(np.uint8).reshape(-1, 8)
            ones += np.add.reduce(np.unpackbits(some, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    if not n:  # fewer words: the whole sequence
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), and if hashed k, the hash that tells texts of one id apart."""
    text = F.col(f"`{text_col}`")
    more = [F.xxhash64(text).alias("k")] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("simhash")
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", "k"][: batch.num_columns])

    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + ", k long" * hashed)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Connected:
    """Union-find over leaves, on whole arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray | None = None) -> np.ndarray:
        x = self.parent if of is None else self.parent[of]
        while True:
            y = self.parent[x]
            if np.array_equal(x, y):
                return x
            x = y

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
        self.parent = self.roots()


class GrayIndex:
    """Levels of nodes over fingerprints that are sorted by key and Gray rank; a node never spans two keys."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), keys))
        keys, codes = keys[self.order], codes[self.order]
        #: For each level: the bits that all leaves below a node share, which bits these are, the first child, the first leaf.
        self.shared, self.mask, self.child, self.leaf = [codes], [np.full(len(codes), ~np.uint64(0))], [None], [np.arange(len(codes) + 1)]
        while True:
            new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
            first = np.flatnonzero(new_key)
            if len(first) == len(keys):
                break
            within = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
            starts = np.flatnonzero(within % FANOUT == 0)
            both = np.bitwise_and.reduceat(self.mask[-1], starts)
            any_, all_ = np.bitwise_or.reduceat(self.shared[-1] & self.mask[-1], starts), np.bitwise_and.reduceat(self.shared[-1] | ~self.mask[-1], starts)
            mask = both & ~(any_ ^ (all_ & both))
            self.mask.append(mask)
            self.shared.append(any_ & mask)
            self.child.append(np.append(starts, len(keys)))
            self.leaf.append(self.leaf[-1][self.child[-1]])
            keys = keys[starts]

    def links(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (leaf, root) that connect all leaves of a key which links of at most `most` differing bits connect."""
        n = len(self.order)
        sets = _Connected(n)
        for level in range(1, len(self.mask)):
            self._join_below(level, most, sets)
        roots = sets.roots()
        moved = np.flatnonzero(roots != np.arange(n))
        return self.order[moved], self.order[roots[moved]]

    def _uniform(self, level: int, roots: np.ndarray) -> np.ndarray:
        """For each node, the root that all its leaves have, or -1."""
        if not level:
            return roots
        starts = self.leaf[level][:-1]
        low = np.minimum.reduceat(roots, starts)
        return np.where(low == np.maximum.reduceat(roots, starts), low, -1)

    def _join_below(self, level: int, most: int, sets: _Connected) -> None:
        """Joins the children of each node of `level` with each other; their own leaves are joined already."""
        starts, ends = self.child[level][:-1], self.child[level][1:]
        sizes = ends - starts
        work = []
        for i, j in combinations(range(FANOUT), 2):
            some = starts[sizes > j]
            work += [(level - 1, some[k : k + FRONT] + i, some[k : k + FRONT] + j) for k in range(0, len(some), FRONT)]
        roots = sets.roots()
        uniform: dict[int, np.ndarray] = {}
        while work:
            at, a, b = work.pop()
            if at not in uniform:
                uniform[at] = self._uniform(at, roots)
            same = uniform[at]
            m = self.mask[at][a] & self.mask[at][b]
            differ = np.bitwise_count((self.shared[at][a] ^ self.shared[at][b]) & m)
            stay = (differ <= most) & ((same[a] != same[b]) | (same[a] < 0))
            a, b = a[stay], b[stay]
            if not len(a):
                continue
            if not at:
                sets.link(a, b)
                roots = sets.roots()
                uniform.clear()
                continue
            # all pairs of children
            first, n_a = self.child[at][a], self.child[at][a + 1] - self.child[at][a]
            second, n_b = self.child[at][b], self.child[at][b + 1] - self.child[at][b]
            per = n_a * n_b
            pair = np.repeat(np.arange(len(a)), per)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(per) - per, per)
            down_a, down_b = first[pair] + k // n_b[pair], second[pair] + k % n_b[pair]
            work += [(at - 1, down_a[i : i + FRONT], down_b[i : i + FRONT]) for i in range(0, len(down_a), FRONT)]


def _local_links(most: int):
    """From rows (key columns, fp) that are sorted by key: links under each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("simhash")
        held: list[np.ndarray] = []
        n = 0

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            key = np.cumsum(change)
            many = np.bincount(key)[key] > 1
            key, codes = key[many], rows[many, 4].view(np.uint64)
            if len(key):
                a, b = GrayIndex(key, codes).links(most)
                yield pa.RecordBatch.from_arrays([pa.array(codes[a].view(np.int64)), pa.array(codes[b].view(np.int64))], ["u", "v"])

        for batch in batches:
            held.append(np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
            n += batch.num_rows
            if n >= HELD:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
                if len(last):
                    yield from flush(rows[: last[-1] + 1])
                    rows = rows[last[-1] + 1 :]
                held, n = [rows], len(rows)
        if n:
            yield from flush(np.concatenate(held))

    return run


def links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """Links (u, v) of distinct fingerprints (fp) that connect all that differ in at most `most` bits; most is 4 or less."""
    if not 0 <= most <= 4:
        raise ValueError("six blocks leave two intact for at most 4 differing bits")
    masks = []
    for (a, n), (b, m) in combinations(_BLOCKS, 2):
        bits = ((1 << n) - 1) << a | ((1 << m) - 1) << b
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for t, m in enumerate(masks)))).alias("key")).select("key.t", "key.m", "fp")
    hot = keyed.groupBy("t", "m").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("t", "m", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = keyed.join(hot, ["t", "m"], "left").select("t", "m", part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"), "fp")
    cells = dealt.select("t", "m", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp")
    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(width, "t", "m", "low", "high").sortWithinPartitions("t", "m", "low", "high").mapInArrow(_local_links(most), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id that links reach)."""
    return component_ids(cut(fingerprints(docs, width, id_col, text_col)), most)


def _firsts(prints: DataFrame, least: Column, most: int) -> DataFrame:
    """fp, first: the least of `least` over the component of each fingerprint."""
    distinct = cut(prints.groupBy("fp").agg(least.alias("least")))
    roots = components(links(distinct.select("fp"), most)).withColumnsRenamed({"node": "fp"})
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = cut(rooted.groupBy("root").agg(F.min("least").alias("first")))  # apart from the join, whose hot roots Spark can split then
    return rooted.join(first, "root").select("fp", "first")


def component_ids(prints: DataFrame, most: int = 4) -> DataFrame:
    """component_id for (doc_id, fp)."""
    return prints.join(_firsts(prints, F.min("doc_id"), most), "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id, nulls last, then of the least hash of the text.

    A document is an id and a text. Of documents that share an id each is kept or dropped by itself; repeated rows (id and text
    are equal) are one document and stay or go together. Documents without an id stay only where no other of their component has one.
    """
    prints = cut(fingerprints(docs, width, id_col, text_col, hashed=True))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    first = _firsts(prints, F.min(place), most)
    later = prints.join(first, "fp").where(place != F.col("first")).select("doc_id", "k").distinct()
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(text).alias("t"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    left = keyed.join(later, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("k")), "left_anti")
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
