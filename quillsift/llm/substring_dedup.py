"""Substring deduplication by compressed FM-indexes.

A window is `size` consecutive words. A window that also starts earlier (in a document with a smaller id, or before it in its own)
is a repeat, and its words are removed. All windows of all documents are compared:

1. Every window has an anchor, the least of its five-word hashes, which its words alone decide. Consecutive windows with one
   anchor are a segment. Only (anchor hash, document, number of segments) is shuffled, about one row for eight words; a text that
   repeats itself has one row for each hash. Places aren't sent but found again, from the text alone. Segments are counted by a partial
   aggregation, and the counts are joined back, so that Spark can split the rows of a very common anchor.
2. A window whose anchor hash occurs once in the corpus can't be repeated. The segments of the others go, with their words, to the
   shard of their anchor hash, so that equal windows always meet, however many documents and shards there are. Of equal segments in a
   megabyte of text only the first goes there; the others are repeats as a whole and are dealt to all shards, to be passed through.
3. Each shard, in parts that end between anchor hashes, builds an FM-index over its distinct segments: words as symbols, suffixes sorted to
   the window's depth, the BWT in a wavelet matrix of packed bits. Of the suffix array it keeps, as packed bits, where suffixes
   with another window begin and where those with another window less a word do, and the least text position of each window that occurs
   twice or more. All distinct segments are streamed through it by backward search, a word at a time from their ends: from `size` matched
   words on, the interval is widened to the last size - 1 words and extended again, so that it always holds the occurrences of the
   window at hand. As the text is in document order, the window's least position says whether it has an earlier occurrence.
4. Intervals of repeated words go back to their documents. Both meetings with the texts use the same exchange.

An anchor hash with more than HOT_ANCHOR segments, as at the edges of a very common passage, can have as many different segments as
documents. Its windows are dealt out one by one, as digests of 128 bits under their own hashes; equal digests are equal windows. These
windows don't go through the FM-index.

Words are runs of characters other than ASCII white space. Cases: a null or empty text has no words and is left alone; texts of fewer words
than a window are left alone; texts of any length are read in parts that overlap by a window less a word; rows with the same id and text are
one document, and are changed alike; other rows with the same id are ordered by their text's hash; a null id comes after all
others; an empty table gives an empty table; other columns, whatever their names, are carried through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import blocks, kept, parts_at_spaces, small_batches, start_task, utf8

#: Words of an anchor's hash.
GRAM = 5
#: Words that a worker indexes at once; a larger anchor hash is indexed by itself.
PART_WORDS = 300_000
#: Bytes of text in which a worker looks for anchors at once; a longer text is handled in parts.
SCAN_BYTES = 1 << 19
#: With more segments than this, an anchor hash is not one group: each of its windows goes by its own hash.
HOT_ANCHOR = 1000
#: Bytes of text whose segments are held at once.
HELD_BYTES = 1 << 20
#: Rows of an Arrow batch that a worker returns.
OUT_ROWS = 20_000
#: A window's number of starts under one anchor is kept in 8 bits.
LONGEST_WINDOW = 255
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_LAST = (1 << 63) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64; those of a block's size are kept."""

    def make(size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out, out=out)

    usual = SCAN_BYTES + (SCAN_BYTES >> 3)
    return make(n) if n > usual else kept("substrings", (base, usual), lambda: make(usual))[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


_GAP = re.compile(rb"[\x20\x09-\x0d]")


def overlapping(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """(words before it, part) for parts of a text; each window of `size` words is in one part."""
    at = before = 0
    reach = SCAN_BYTES
    while len(text) - at > reach and (gap := _GAP.search(text, at + reach)):
        part = text[at : gap.start()]
        starts, _ = word_places(np.frombuffer(part, np.uint8))
        if len(starts) < 2 * size:  # very long words
            reach += SCAN_BYTES
            continue
        yield before, part
        first = len(starts) - size + 1
        before, at, reach = before + first, at + int(starts[first]) if size > 1 else gap.start(), SCAN_BYTES
    yield before, text[at:]


def scans(texts: list[bytes], size: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """What is looked at together, at most about SCAN_BYTES: for each text or part its number, the words before it, and itself."""
    for begin, end in blocks(texts, SCAN_BYTES):
        if end - begin == 1 and len(texts[begin]) > SCAN_BYTES:
            for before, part in overlapping(texts[begin], size):
                yield [begin], [before], [part]
        else:
            yield list(range(begin, end)), [0] * (end - begin), texts[begin:end]


def anchors(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text and anchor hash: number of the text, hash; and offsets into the segments' places (first word << 8 | windows)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = word_places(raw)
    width = size - GRAM + 1
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int32), np.empty(0, np.int64)
    if len(starts) < size:
        return none
    # hashes of words, by sums of bytes times powers of an odd number modulo 2**64
    power = _powers(_P, len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    inverse = _powers(pow(_P, -1, 1 << 64), len(raw) + 1)
    word = _mix((sums[ends] - sums[starts]) * inverse[starts])
    n = len(word) - GRAM + 1
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = (gram + word[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
    gram = _mix(gram)
    # the leftmost least gram of each window
    best, at, have = gram, np.arange(n), 1
    while have < width:
        step = min(have, width - have)
        later = best[step:] < best[:-step]
        at = np.where(later, at[step:], at[:-step])
        best = np.where(later, best[step:], best[:-step])
        have += step
    doc_bytes = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first_word = np.searchsorted(starts, doc_bytes)
    doc = np.searchsorted(doc_bytes, starts, side="right") - 1
    window = np.flatnonzero(doc[: len(at)] == doc[size - 1 : size - 1 + len(at)])
    if not len(window):
        return none
    place = at[window]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[window[1:]] != doc[window[:-1]])])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    which, h = doc[window[head]], gram[place[head]].view(np.int64)
    order = np.lexsort((h, which))  # stable: places stay in order
    which, h, head, count = which[order], h[order], head[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (h[1:] != h[:-1])]))
    places = (window[head] - first_word[which]) << 8 | count
    return which[first], h[first], np.append(first, len(h)).astype(np.int32), places


class Bits:
    """Packed bits with the ones before each 64: ranks, and the ones around a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        cell = i >> 6
        return self.before[cell] + np.bitwise_count(self.words[cell] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each k-th one, from 0."""
        cell = np.searchsorted(self.before, k, side="right") - 1
        left, word = (k - self.before[cell]).astype(np.uint8), self.words[cell]
        at = np.zeros(len(k), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((word >> at) & np.uint64((1 << step) - 1))
            up = low <= left
            left = np.where(up, left - low, left)
            at = np.where(up, at + np.uint64(step), at)
        return (cell << 6) + at.astype(np.int64)


class WaveletMatrix:
    """Ranks of symbols in a sequence; each level is packed bits."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            one = (sequence >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(one), int(len(one) - one.sum())))
            sequence = np.concatenate([sequence[~one], sequence[one]])

    def rank_pair(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before `low` and before `high`."""
        k = len(symbol)
        i = np.concatenate([low, high])
        origin = np.zeros(k, np.int64)
        for bit, bits, zeros in self.levels:
            everything = np.concatenate([i, origin])
            ones = bits.rank(everything)
            up = np.tile(symbol >> bit & 1, 3).astype(bool)
            everything = np.where(up, zeros + ones, everything - ones)
            i, origin = everything[: 2 * k], everything[2 * k :]
        return i[:k] - origin, i[k:] - origin


class FMIndex:
    """Over a text of symbols from 1 with 0 between segments; suffixes are sorted by their first `depth` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.text, self.depth = text, depth
        ranks, have = {1: text.astype(np.int64)}, 1

        def joined(a: int, b: int) -> np.ndarray:
            """Keys that sort like the first a + b symbols (b at most a, overlaps allowed)."""
            r = ranks[a]
            later = np.zeros(n, np.int64)
            shift = b
            later[: n - shift] = r[shift:] + 1
            return r * np.int64(int(r.max(initial=0)) + 2) + later

        def dense(keys: np.ndarray) -> np.ndarray:
            order = np.argsort(keys)
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(keys[order[1:]] != keys[order[:-1]])
            return new

        while 2 * have < depth:
            ranks = {2 * have: dense(joined(have, have))}
            have *= 2
        whole = joined(have, depth - have)
        order = np.argsort(whole, kind="stable")
        first = self._begins(whole[order])
        self.wide = Bits(self._begins((joined(have, depth - 1 - have) if depth - 1 > have else ranks[have])[order]))
        heads = np.append(np.flatnonzero(first), n)
        several = np.diff(heads) > 1
        self.first, self.several = Bits(first), Bits(several)
        self.least = np.minimum.reduceat(order, heads[:-1])[several].astype(np.int32)
        self.wide_classes, self.n = int(self.wide.before[-1]), n
        sigma = int(text.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], sigma)

    @staticmethod
    def _begins(sorted_keys: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])

    def _widened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffixes that share depth - 1 symbols with the one at `low`."""
        k = self.wide.rank(low + 1)
        last = k == self.wide_classes
        return self.wide.select(k - 1), np.where(last, self.n, self.wide.select(np.where(last, 0, k)))

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least text position of a window's interval, where that holds more than one."""
        out = np.full(len(low), self.n, np.int64)
        many = np.flatnonzero(high - low > 1)
        out[many] = self.least[self.several.rank(self.first.rank(low[many] + 1) - 1)]
        return out

    def earlier(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each text position: whether a window of `depth` symbols starts there, within a segment, that also starts before it."""
        out = np.zeros(len(self.text), bool)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        end = begin + length
        low = high = np.empty(0, np.int64)
        for t in range(int(length[0]) if len(length) else 0):
            k = int(np.searchsorted(-length, -t, side="left"))  # segments longer than t
            at = end[:k] - 1 - t
            symbol = self.text[at]
            if t == 0:
                low, high = self.before[symbol], self.before[symbol + 1]
            else:
                low, high = low[:k], high[:k]
                if t >= self.depth:
                    low, high = self._widened(low)
                low, high = self.bwt.rank_pair(symbol, low, high)
                low, high = self.before[symbol] + low, self.before[symbol] + high
            if t + 1 >= self.depth:
                out[at] = self._least(low, high) < at
        return out


#: A segment without words is a repeat as a whole, under any hash; one of no windows is a single window of a hot anchor, as a digest.
SEGMENTS = "h long, d long, k long, start int, windows int, words binary"
REPEATS = "d long, k long, first int, end int"


def _find_anchors(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("substrings")
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), utf8(batch.column(1))
            for which, _, parts in scans(texts, size):
                doc, h, offsets, _ = anchors(parts, size)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(keys[np.asarray(which)[doc]], pa.int64()), pa.array(np.diff(offsets), pa.int32())], ["h", "doc", "segments"])

    return run


def _cut_segments(size: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def segments(batch: pa.RecordBatch) -> dict[tuple[int, bytes, int], list[tuple[int, int, int]]]:
        """(hash, words, windows) and the places (d, k, start) of the batch's segments whose anchors are shared."""
        held: dict[tuple[int, bytes, int], list[tuple[int, int, int]]] = {}
        d, k = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = utf8(batch.column(2))
        shared_now, shared = -1, {}
        for which, before, parts in scans(texts, size):
            doc, hashes, offsets, places = anchors(parts, size)
            edges = np.searchsorted(doc, np.arange(len(parts) + 1)).tolist()
            hashes, offsets, places = hashes.tolist(), offsets.tolist(), places.tolist()
            for j, i in enumerate(which):
                if i != shared_now:
                    shared_now, shared = i, {x["h"]: x["hot"] for x in batch.column(3)[i].as_py()}
                words = None
                for g in range(edges[j], edges[j + 1]):
                    h = hashes[g]
                    if (hot := shared.get(h)) is None:
                        continue
                    if words is None:
                        words = parts[j].split()
                    for place in places[offsets[g] : offsets[g + 1]]:
                        start, count = place >> 8, place & 255
                        if hot:
                            for at in range(start, start + count):
                                digest = xxhash.xxh3_128_digest(b" ".join(words[at : at + size]))
                                held.setdefault((int.from_bytes(digest[:8], "little", signed=True), digest, 0), []).append((d[i], k[i], at + before[j]))
                        else:
                            held.setdefault((h, b" ".join(words[start : start + count + size - 1]), count), []).append((d[i], k[i], start + before[j]))
        return held

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t) for t in utf8(batch.column(2))]
            ends = np.flatnonzero(np.diff(np.cumsum(sizes) // HELD_BYTES, prepend=0)).tolist()
            for begin, end in zip([0, *ends], [*ends, batch.num_rows]):
                if begin < end:
                    yield batch.slice(begin, end - begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("substrings")
        for batch in parts(batches):
            rows: list[tuple] = []
            whole: list[tuple[int, int, int, int]] = []  # repeats: d, k, first word, the word after the last
            for (h, words, count), at in segments(batch).items():
                at = sorted(set(at)) if len(at) > 1 else at  # rows of one document are one
                rows.append((h, *at[0], count, words))
                whole += [(*place, place[2] + max(1, count) - 1 + size) for place in at[1:]]
            whole.sort()
            merged: list[list[int]] = []
            for d, k, first, end in whole:
                if merged and merged[-1][:2] == [d, k] and first <= merged[-1][3]:
                    merged[-1][3] = max(end, merged[-1][3])
                else:
                    merged.append([d, k, first, end])
            # passed through, in any shard
            rows += [(k ^ (first * _P & _LAST) ^ (d & 0xFFFF), d, k, first, end - first + 1 - size, None) for d, k, first, end in merged]
            for begin in range(0, len(rows), OUT_ROWS):
                columns = zip(*rows[begin : begin + OUT_ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["h", "d", "k", "start", "windows", "words"])

    return run


def _search_shard(size: int):
    def search(part: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        """Repeats among segments (d, k, start, windows, words) that are in order under each anchor hash."""
        codes: dict[bytes, int] = {}
        text: list[int] = []
        begin = np.empty(len(part), np.int64)
        for i, row in enumerate(part):
            begin[i] = len(text)
            text += [codes.setdefault(w, len(codes) + 1) for w in row[4].split(b" ")]
            text.append(0)
        windows = np.fromiter((row[3] for row in part), np.int64, len(part))
        found = FMIndex(np.asarray(text, np.int64), size).earlier(begin, windows + size - 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))  # windows of two segments never touch
        which = np.searchsorted(begin, edges[::2], side="right") - 1
        for i, a, b in zip(which.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            d, k, start = part[i][:3]
            at = start - int(begin[i])
            yield d, k, at + a, at + b - 1 + size

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["d", "k", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("substrings")
        part: list[tuple] = []
        part_words = 0
        hash_now, last, reach, own, seen, out = None, None, 0, [], set(), []

        def close() -> None:
            nonlocal part_words
            if len(own) > 1:
                part.extend(own)
                part_words += sum(row[3] + size for row in own)

        for batch in batches:
            for h, d, k, start, windows, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words is None:
                    out.append((d, k, start, start + windows - 1 + size))
                    continue
                if h != hash_now:
                    close()
                    if part_words > PART_WORDS:
                        out += search(part)
                        part, part_words = [], 0
                    hash_now, last, reach, own, seen = h, None, 0, [], set()
                if not windows:  # in order, so that a digest's first place comes first
                    if (d, k, start) != last:
                        last = (d, k, start)
                        if words in seen:
                            out.append((d, k, start, start + size))
                        else:
                            seen.add(words)
                    continue
                if (d, k) != last:
                    last, reach = (d, k), 0
                if start < reach:
                    continue  # a repeated row
                reach = start + windows
                if words in seen:
                    out.append((d, k, start, start + windows - 1 + size))
                else:
                    seen.add(words)
                    own.append((d, k, start, windows, words))
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        close()
        if part:
            out += search(part)
        if out:
            yield batch_of(out)

    return run


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with their document (id and the text's hash) and its hash. Both joins with it read the same columns, so that the second finds the
    exchange of the first."""
    d, k = _key(id_col), F.xxhash64(f"`{text_col}`")
    return small_batches(docs).select(d.alias("__d"), k.alias("__k"), F.xxhash64(d, k).alias("__doc"), *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)))


def repeats(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Intervals of words [first, end) to remove, by document (REPEATS)."""
    if not GRAM <= size <= LONGEST_WINDOW:
        raise ValueError(f"a window has {GRAM} to {LONGEST_WINDOW} words")
    # the first pass reads the table itself, not the exchange of texts; documents that share a hash only look for each other's anchors too
    d, text = _key(id_col), F.col(f"`{text_col}`")
    found = small_batches(docs).select(F.xxhash64(d, F.xxhash64(text)).alias("doc"), text.alias("text")).mapInArrow(_find_anchors(size), "h long, doc long, segments int")
    counts = found.groupBy("h").agg(F.sum("segments").alias("n")).where("n > 1")
    shared = found.join(counts, "h")
    places = shared.groupBy("doc").agg(F.collect_list(F.struct("h", (F.col("n") > HOT_ANCHOR).alias("hot"))).alias("places"))
    met = _keyed(docs, id_col, text_col).join(places, F.col("__doc") == F.col("doc"))
    place = docs.columns.index(text_col)
    rest = [F.col(f"__c{i}") for i in range(len(docs.columns)) if i != place]  # read, as the exchange is shared
    segments = met.select("__d", "__k", f"__c{place}", "places", F.struct(F.lit(0), *rest)).mapInArrow(_cut_segments(size), SEGMENTS)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(width, "h").sortWithinPartitions("h", "d", "k", "start").mapInArrow(_search_shard(size), REPEATS)


def _stretches(text: bytes, gone: list[dict] | None) -> tuple[int, int, list[tuple[int, int]]]:
    """Number of words, how many of them go, and the places of the bytes of each stretch of words that stay."""
    n = sum(len(part.split()) for part in parts_at_spaces(text))
    edges: list[int] = []  # stretches that stay: first word and the word after the last, in turn
    at = 0
    for first, end in sorted((g["first"], g["end"]) for g in gone or ()):
        if first > at:
            edges += [at, first]
        at = max(at, end)
    if n > at:
        edges += [at, n]
    begins, ends = np.asarray(edges[::2], np.int64), np.asarray(edges[1::2], np.int64) - 1
    low, high = np.zeros(len(begins), np.int64), np.zeros(len(ends), np.int64)
    word = byte = 0
    for part in parts_at_spaces(text):
        starts, stops = word_places(np.frombuffer(part, np.uint8))
        for want, out, have in ((begins, low, starts), (ends, high, stops)):
            a, b = np.searchsorted(want, [word, word + len(have)])
            out[a:b] = have[want[a:b] - word] + byte
        word, byte = word + len(starts), byte + len(part)
    return n, n - int((ends - begins + 1).sum()), list(zip(low.tolist(), high.tolist(), strict=True))


def _marked(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """docs, with columns __c0 and so on, and each one's removed words."""
    gone = repeats(docs, size, id_col, text_col).groupBy(F.xxhash64("d", "k").alias("doc")).agg(F.collect_list(F.struct("d", "k", "first", "end")).alias("all"))
    own = F.filter("all", lambda x: (x["d"] == F.col("__d")) & (x["k"] == F.col("__k")))
    return _keyed(docs, id_col, text_col).join(gone, F.col("__doc") == F.col("doc"), "left").withColumn("gone", F.transform(own, lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end"))))


def digest(text: bytes, stretches: list[tuple[int, int]]) -> str:
    """SHA-256 of the words of the stretches, joined by one space."""
    sha, some = hashlib.sha256(), False
    for a, b in stretches:
        for part in parts_at_spaces(text[a:b]):
            if words := part.split():
                sha.update(b" " * some + b" ".join(words))
                some = True
    return sha.hexdigest()


def digests(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("substrings")
        for batch in batches:
            words, removed, sha = [], [], []
            for text, gone in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if gone:
                    n, m, stretches = _stretches(text, gone)
                else:
                    n, m, stretches = sum(len(part.split()) for part in parts_at_spaces(text)), 0, [(0, len(text))]
                words.append(n)
                removed.append(m)
                sha.append(digest(text, stretches))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = _marked(docs.select(f"`{id_col}`", f"`{text_col}`"), size, id_col, text_col)
    return marked.select(F.col("__c0").cast("long").alias("doc_id"), F.col("__c1").alias("text"), "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without their repeated words: the stretches of kept words, each as it is, joined by one space. A document of which nothing is left goes."""
    docs_columns = docs.columns
    place = docs_columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("substrings")
        for batch in batches:
            texts, stays = [], []
            columns = batch.columns[1:]
            for text, gone in zip(columns[place].to_pylist(), batch.column(0).to_pylist(), strict=True):
                if gone:
                    raw = text.encode()
                    stretches = _stretches(raw, gone)[2]
                    text = b" ".join(raw[a:b] for a, b in stretches).decode()
                    stays.append(bool(stretches))
                else:
                    stays.append(True)
                texts.append(text)
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, docs_columns).filter(pa.array(stays))

    marked = _marked(docs, size, id_col, text_col)
    return marked.select("gone", *(f"__c{i}" for i in range(len(docs_columns)))).mapInArrow(run, docs.schema)
