"""Byte-level BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of a word. A proposal is the word's encoding exactly when each token encodes to itself and no merge
crosses the boundary of an adjacent pair. The pairs of all new words are tested together, as arrays: the merges that made two
neighbours are undone, the latest first, and at each step the tokens that face each other at the boundary must not have a merge that would have come
before the one just undone. Only words with a failing pair are merged exactly: short ones together, each word's next merge in one step for all of them,
and long ones each from a heap of merges by rank and place.

Long texts are split a stretch at a time, at spaces, which no token crosses.

Cases: a null or empty text has no tokens; the special token's string in a text is that token; any other text is encoded whole, and decodes to
itself; a word of any length takes time in proportion to its length times its logarithm; a null id is carried; repeated rows and
other columns don't matter; an empty table gives an empty table; a vocabulary file with another normaliser, pre-tokeniser, decoder
or kind of model raises.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import blocks, kept, quiet_threads, small_batches, start_task, utf8

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, ids array<int>"
#: White space as Unicode defines it (Python's own class has four control characters more).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of other characters with the space before it, or white space; every split of the vocabulary's own pattern
#: at white space is one of these too, so that each match can be encoded by itself.
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Runs whose split is plain: Latin letters with the space before them, then ASCII marks.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\\[-`{-~]*)")
#: Bytes of a text that are split into runs at once; longer texts are handled in stretches that end before a space.
STRETCH = 1 << 20
#: Bytes of words that are handled together as arrays; a longer word is handled alone, its merges taken from a heap.
LONG_WORD = 64
#: Words that are merged together.
TOGETHER = 20_000
_NEVER = np.int32(2**31 - 1)
#: Entries of a worker's table from runs to ids.
CACHE_ENTRIES = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Lookup:
    """From non-negative numbers of 64 bits to numbers of 32 bits, for whole arrays: open addressing, with a quarter of the places used at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        place, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] < 0]
            self.keys[place[free]] = keys[free]  # of several, the last one stays
            took = free[self.keys[place[free]] == keys[free]]
            self.values[place[took]] = values[took]
            left = left[self.keys[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray, otherwise: int = -1) -> np.ndarray:
        place = self._place(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.values[place], np.int32(otherwise))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            there = self.keys[place[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[place[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class SpeculativeBpe:
    """Encoder and decoder for a byte-level BPE in the tokenizers library's file format."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        quiet_threads()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max(*vocab.values(), *self.specials.values()))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(symbols[c] for c in token)
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b}
        for b, i in self.specials.items():
            self.bytes_of[i] = b
        self.of_byte = [self.id_of[bytes([b])] for b in range(256)]
        #: The longest token that begins with two bytes.
        self.longest: dict[bytes, int] = {}
        for b in self.id_of:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        self._tables()
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.special = re.compile(b"(" + b"|".join(map(re.escape, self.specials)) + b")") if self.specials else None
        self.entries = entries
        #: Ids of runs, as numbers of 32 bits in bytes, which are joined faster than lists.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.speculated = self.merged = 0

    def _tables(self) -> None:
        """Merges as arrays: pairs in order with their ranks, and for each token the merge that makes it (rank -1: a byte)."""
        n = len(self.bytes_of)
        left, right, rank = (np.fromiter(x, np.int64, len(self.merge)) for x in ((a for a, _ in self.merge), (b for _, b in self.merge), (r for r, _ in self.merge.values())))
        made = np.fromiter((t for _, t in self.merge.values()), np.int64, len(self.merge))
        if len(np.unique(made)) < len(made):
            raise ValueError("two merges make the same token")
        self.rank_of = Lookup(left << 32 | right, rank)
        self.made = np.empty(len(made), np.int32)  # the token of each rank
        self.made[rank] = made
        self.left, self.right, self.rank = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        self.left[made], self.right[made], self.rank[made] = left, right, rank
        # a token encodes to itself if its halves do and nothing crosses between them before they are merged
        whole = self._stays_apart(left, right, rank)
        self.valid = np.zeros(n, bool)
        self.valid[self.of_byte] = True
        for i in np.argsort(rank).tolist():
            self.valid[made[i]] = whole[i] and self.valid[left[i]] and self.valid[right[i]]
        # bytes: their tokens, and the ranks of their pairs
        self.byte_token = np.asarray(self.of_byte, np.int32)
        both = self.byte_token.astype(np.int64)
        self.byte_rank = self.rank_of((both[:, None] << 32 | both[None, :]).reshape(-1), int(_NEVER))
        # a tree of the tokens' bytes: children by state and byte, and the token that ends in a state
        states: dict[bytes, int] = {b"": 0}
        keys, children = [], []
        for word in self.id_of:
            for i in range(1, len(word) + 1):
                if word[:i] not in states:
                    states[word[:i]] = len(states)
                    keys.append(states[word[: i - 1]] << 8 | word[i - 1])
                    children.append(states[word[:i]])
        self.child = Lookup(np.asarray(keys, np.int64), np.asarray(children, np.int32))
        self.token_at = np.full(len(states), -1, np.int32)
        for word, token in self.id_of.items():
            self.token_at[states[word]] = token

    def _stays_apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = 1 << 60) -> np.ndarray:
        """For pairs of tokens that encode to themselves: whether no merge of a rank less than `before` crosses their boundary."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, before = a.copy(), b.copy(), np.broadcast_to(before, len(a)).copy()
        while len(live):
            found = self.rank_of(a << 32 | b)
            crossed = (found >= 0) & (found < before)
            good[live[crossed]] = False
            made_a, made_b = self.rank[a], self.rank[b]
            go = ~crossed & ((made_a >= 0) | (made_b >= 0))
            live, a, b, made_a, made_b = live[go], a[go], b[go], made_a[go], made_b[go]
            # of merges of one rank the one further left comes first
            first = made_a > made_b
            before = np.where(first, made_a, made_b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def exact(self, word: bytes) -> bytes:
        """The encoding (ids of 32 bits) by merging the lowest-ranked pair, leftmost first, until none is left."""
        return self._exact_by_heap(list(map(self.of_byte.__getitem__, word)))

    def exact_together(self, words: list[bytes]) -> list[bytes]:
        """The same for many short words. Each step takes the next merge of every word that has one."""
        out = [b""] * len(words)
        by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(by_length), TOGETHER):
            some = by_length[at : at + TOGETHER]
            for i, ids in zip(some, self._merged_together([words[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _merged_together(self, words: list[bytes]) -> list[bytes]:
        n, width = len(words), max(1, max(map(len, words)))
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        inside = np.arange(width) < sizes[:, None]
        ids = np.where(inside, self.byte_token[raw], -1)
        # the rank of the pair that begins at each place; the places of a token's neighbours
        ranks = np.full((n, width), _NEVER, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.byte_rank[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]], _NEVER)
        after, before = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1)), np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        rows = np.arange(n)
        while len(rows):
            now = ranks[rows]
            i = now.argmin(axis=1)
            rank = now[np.arange(len(rows)), i]
            more = rank < _NEVER
            rows, i, rank = rows[more], i[more], rank[more]
            made = self.made[rank].astype(np.int64)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j], ranks[rows, j], after[rows, i] = made, -1, _NEVER, k
            last = k >= sizes[rows]
            next_ = np.where(last, 0, ids[rows, np.where(last, 0, k)]).astype(np.int64)
            ranks[rows, i] = np.where(last, _NEVER, self.rank_of(made << 32 | next_, int(_NEVER)))
            before[rows[~last], k[~last]] = i[~last]
            h = before[rows, i]
            inner = h >= 0
            r, h = rows[inner], h[inner]
            ranks[r, h] = self.rank_of(ids[r, h].astype(np.int64) << 32 | made[inner], int(_NEVER))
        stay = ids >= 0
        flat, ends = ids[stay].astype(np.int32).tobytes(), (4 * np.cumsum(stay.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _exact_by_heap(self, ids: list[int]) -> bytes:
        """The same for a list of byte tokens of any length: neighbours are linked, and merges wait in a heap by rank and place."""
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, pair, found[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (found := merge.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != pair[0] or ids[j] != pair[1]:
                continue  # one of the two was merged meanwhile (its id is -1 or another)
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merge.get((made, ids[k])):
                    heapq.heappush(heap, (found[0], i, (made, ids[k]), found[1]))
            h = before[i]
            if h >= 0 and (found := merge.get((ids[h], made))):
                heapq.heappush(heap, (found[0], h, (ids[h], made), found[1]))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        out, at, n, ids, longest = [], 0, len(word), self.id_of, self.longest
        while at < n:
            end = min(n, at + longest.get(word[at : at + 2], 1))
            while (found := ids.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def _compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair (second -1: a token alone): whether it encodes to itself."""
        keys, back = np.unique(first << 32 | second + 1, return_inverse=True)
        a, b = keys >> 32, (keys & 0xFFFFFFFF) - 1
        pairs = np.flatnonzero((b >= 0) & self.valid[a])
        ok = self.valid[a]
        ok[pairs] = self.valid[b[pairs]]
        pairs = pairs[ok[pairs]]
        ok[pairs] = self._stays_apart(a[pairs], b[pairs])
        return ok[back]

    def greedy_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at each place of many short words: tokens in order, and their number for each word. Words go down the tree together."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        rows = np.flatnonzero(np.diff(ends, prepend=0))
        at = np.concatenate([[0], ends[:-1]])[rows]
        state, best, reach = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int32), at.copy()
        ends = ends[rows]
        whose, tokens = [], []
        while len(rows):
            down = np.where(at < ends, self.child(state << 8 | raw[at]), -1)
            goes = down >= 0
            state, at = np.where(goes, down, 0).astype(np.int64), at + goes
            found = np.where(goes, self.token_at[state], -1)
            best, reach = np.where(found >= 0, found, best), np.where(found >= 0, at, reach)
            done = ~goes
            whose.append(rows[done])
            tokens.append(best[done])
            at = np.where(done, reach, at)
            stay = ~done | (at < ends)
            rows, at, ends, state, best, reach = rows[stay], at[stay], ends[stay], state[stay], best[stay], reach[stay]
        whose = np.concatenate([np.empty(0, np.int64), *whose])
        order = np.argsort(whose, kind="stable")
        return np.concatenate([np.empty(0, np.int32), *tokens])[order].astype(np.int64), np.bincount(whose, minlength=len(words))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Encodings (ids of 32 bits) of words that the pre-tokeniser has split."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if w and len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                first = np.asarray(self.greedy(w), np.int64)
                self._settle([i], first, np.array([len(first)]), out, lambda some: [self.exact(words[k]) for k in some])
        if short:
            first, sizes = self.greedy_together([words[i] for i in short])
            self._settle(short, first, sizes, out, lambda some: self.exact_together([words[k] for k in some]))
        return out

    def _settle(self, which: list[int], first: np.ndarray, sizes: np.ndarray, out: list[bytes], exact) -> None:
        """Fills `out` for words with proposals: those whose pairs all hold as they are, the others by `exact`."""
        ends = np.cumsum(sizes)
        second = np.append(first[1:], -1)
        second[ends - 1] = -1
        ok = np.logical_and.reduceat(self._compatible(first, second), ends - sizes)
        self.speculated += int(ok.sum())
        self.merged += int((~ok).sum())
        flat, stops = first.astype(np.int32).tobytes(), (4 * ends).tolist()
        wrong = []
        for i, good, a, b in zip(which, ok.tolist(), [0, *stops], stops):
            if good:
                out[i] = flat[a:b]
            else:
                wrong.append(i)
        for i, ids in zip(wrong, exact(wrong), strict=True):
            out[i] = ids

    def _learn(self, runs: set[str]) -> None:
        split: dict[str, list[bytes]] = {}
        for run in runs:
            if plain := PLAIN.fullmatch(run):
                letters, marks = plain.groups()
                split[run] = [letters.encode(), marks.encode()] if marks else [letters.encode()]
            else:
                split[run] = [run[a:b].encode() for _, (a, b) in self.split(run)]
        words = list({w for parts in split.values() for w in parts})
        found = dict(zip(words, self.encode_words(words), strict=True))
        for run, parts in split.items():
            self.known[run] = found[parts[0]] if len(parts) == 1 else b"".join([found[w] for w in parts])

    def encode_many(self, texts: list[bytes]) -> Iterator[list[int]]:
        """Ids of each text; the new words of a block of texts are speculated and verified together."""
        for begin, end in blocks(texts):
            if end - begin == 1 and len(texts[begin]) > STRETCH:
                yield list(chain.from_iterable(chain.from_iterable(map(self._encode_block, ([x] for x in stretches(texts[begin]))))))
            else:
                yield from self._encode_block(texts[begin:end])

    def _encode_block(self, texts: list[bytes]) -> list[list[int]]:
        split = [self._split(t) for t in texts]
        if len(self.known) > self.entries // 2:  # the older half goes, but for what is used again
            self.known, self.old = {}, self.known
        new = set().union(*(p for parts in split for p in parts if isinstance(p, list))).difference(self.known)
        again = {r: self.old[r] for r in new if r in self.old}
        self.known.update(again)
        if len(again) < len(new):
            self._learn(new.difference(again))
        known = self.known.__getitem__
        raw = (b"".join([np.int32(p).tobytes() if isinstance(p, int) else b"".join(map(known, p)) for p in parts]) for parts in split)
        return [np.frombuffer(x, np.int32).tolist() for x in raw]

    def encode(self, text: bytes) -> list[int]:
        return next(self.encode_many([text]))

    def _split(self, text: bytes) -> list[list[str] | int]:
        """Runs, and ids of special tokens between them."""
        if not any(s in text for s in self.specials):
            return [RUNS.findall(text.decode())]
        return [self.specials[p] if p in self.specials else RUNS.findall(p.decode()) for p in self.special.split(text)]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text; bytes that are no UTF-8 become the replacement character."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


def _check(spec: dict, path: str) -> None:
    """Raises unless the file is a byte-level BPE as this module reads it."""
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [
        name
        for name, bad in (
            ("normaliser", spec.get("normalizer")),
            ("pre-tokeniser", any(split.get(k) != v for k, v in level.items())),
            ("decoder", (spec.get("decoder") or {}).get("type") != "ByteLevel"),
            ("model", model.get("type", "BPE") != "BPE"),
            ("model's options", any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))),
            ("added tokens", any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"{path} is no plain byte-level BPE; it differs in its {', '.join(wrong)}")


_BEFORE_SPACE = re.compile(rb"(?<=[!-~])(?= [!-~])")


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """Parts of a text that end before a single space between ASCII characters, where two runs always meet."""
    at = 0
    while at < len(text):
        found = _BEFORE_SPACE.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def codec(path: str) -> SpeculativeBpe:
    """This worker's codec for a vocabulary file."""
    start_task("bpe")
    return kept("bpe", path, lambda: SpeculativeBpe(path))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each document (TOKENS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in batches:
            ids = list(bpe.encode_many(utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, TOKENS)


def decode_documents(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """Texts of token ids (TOKENS): doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in batches:
            texts = [bpe.decode(x or []).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each document where it is read; only digests leave the worker (ENCODED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_many(utf8(batch.column(1))):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, ENCODED)
