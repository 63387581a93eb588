"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised to piece lengths on the executors, words of Latin letters by tiktoken's merging and the rest by the tokenizers library. The plan depends only on how many pieces
there are of each length, a table of at most `capacity` rows at any corpus size, so it is made on the
driver: for each length, longest first, combinations of one, two or three shorter lengths that fill
the gap exactly are looked up by their sum and consumed as often as the counts allow; what is left
goes by best fit. Pieces longer than half a sequence each need a sequence of their own, so the look-up looks ahead: a combination may
use more short pieces than it fills such sequences only while enough short ones are left for every long one that still waits. Plans with
combinations of up to three, two and one length are made in this way, and the one of fewest sequences counts. The plan names slots (length, first rank, first sequence, offset). Pieces then get their rank within their length, hot lengths
in buckets, and find their slot.

Cases: a null text is empty and has the one closing token; no rows give no rows; repeated rows are packed
as often as they come; among pieces of one length, ids in order take slots in order, and rows that agree in all are alike; a text of any
length is tokenised in parts that end at white space; a null id is carried; an empty table gives an empty table; other columns are
not read; a vocabulary file of another kind raises.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.bpe import byte_symbols
from quillsift.llm.common import blocks, cut, kept, parts_at_spaces, quiet_threads, small_batches, start_task, utf8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Entries of a worker's table from white-space separated strings to ids.
CACHE_ENTRIES = 500_000
#: Bytes of a long text that are encoded at once.
PART_BYTES = 1 << 20
#: Pieces of one length that are ranked together at least.
BUCKET_ROWS = 250
#: Bytes of a word that is merged as one of many; longer ones go to the tokenizers library.
LONG_WORD = 200
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: The bytes of a-z, À-Ö, Ø-ö and ø-ÿ, which are in normal form and have a lower case of one letter each.
_LATIN = bytes([*range(97, 123), 0xC3, *({*range(0x80, 0xC0)} - {0x97, 0xB7})])


def _ends_in_letter(text: bytes) -> bool:
    """Also in normal form and in lower case, where a letter can become a letter and a combining mark."""
    return unicodedata.normalize("NFC", text[-4:].decode("utf-8", "ignore")).lower()[-1:].isalpha()


class _Table(dict):
    """Ids by string. A string that is in neither half is put down in `new` with an empty place for its ids, to be filled before texts are joined."""

    def __init__(self, old: dict[bytes, bytes]):
        self.old = old
        self.new: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytes | bytearray:
        ids = self.old.get(word)
        if ids is not None:
            self[word] = ids
            return ids
        return self.new.setdefault(word, bytearray())


class LetterMerger:
    """Ids of words of letters, by tiktoken's merging: a word a line, where the end of the line stands for </w>.

    tiktoken joins the neighbours that make the token of lowest rank, whichever two they are, and the tokenizers library only the two of
    that token's merge. Neighbours that together are a token got there as they would in the token's own text alone; so, if that token encodes to
    itself, they are the two of its merge. A token that doesn't is never made by the library and is left out here.
    """

    def __init__(self, spec: dict):
        import tiktoken

        symbols, vocab = byte_symbols(), spec["vocab"]
        merges = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in spec["merges"]]
        #: Bytes of a token, and its number in the library's vocabulary, by rank.
        ranked = [(bytes([b]), vocab[c]) for c, b in symbols.items()]
        ranked += [(bytes([b, 10]), vocab[c + "</w>"]) for c, b in symbols.items() if b != 10]
        raw = dict(zip(symbols, (token for token, _ in ranked))) | {c + "</w>": bytes([b, 10]) for c, b in symbols.items()}
        for (a, b), good in zip(merges, _valid(merges), strict=True):
            raw[a + b] = raw[a] + raw[b]
            if good:
                ranked.append((raw[a + b], vocab[a + b]))
        ranks = {token: rank for rank, (token, _) in enumerate(ranked)}
        if len(ranks) < len(ranked):
            raise ValueError("two tokens are of the same bytes")
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        self.id_of = np.asarray([i for _, i in ranked], "<u4")
        self.ends = np.asarray([token[-1:] == b"\n" for token, _ in ranked])

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """For words of bytes in _LATIN."""
        ranks = self.encoding.encode_to_numpy(b"\n".join([*words, b""]).decode().lower(), disallowed_special=())
        raw, ends = self.id_of[ranks].tobytes(), (4 * np.flatnonzero(self.ends[ranks]) + 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _valid(merges: list[tuple[str, str]]) -> list[bool]:
    """For each merge, whether its token encodes to itself: its halves do, and no earlier merge crosses between them."""
    rank_of = {pair: rank for rank, pair in enumerate(merges)}
    made = {a + b: rank for rank, (a, b) in enumerate(merges)}
    if len(made) < len(merges):
        raise ValueError("two merges make the same token")
    good: list[bool] = []
    for rank, (a, b) in enumerate(merges):
        of_a, of_b, before = made.get(a, -1), made.get(b, -1), rank
        if max(of_a, of_b) > rank:
            raise ValueError("a merge comes before one of its halves")
        whole = (of_a < 0 or good[of_a]) and (of_b < 0 or good[of_b])
        while whole:
            whole = not rank_of.get((a, b), before) < before
            if of_a < 0 and of_b < 0:
                break
            # the later merge is undone; of merges of one rank the one further left came first
            if of_a > of_b:
                a, before = merges[of_a][1], of_a
                of_a = made.get(a, -1)
            else:
                b, before = merges[of_b][0], of_b + 1
                of_b = made.get(b, -1)
        good.append(whole)
    return good


def _merger(spec: dict) -> LetterMerger | None:
    """None where tiktoken isn't installed or the vocabulary is of another build; words of letters then go to the tokenizers library, too."""
    try:
        return LetterMerger(spec)
    except (ImportError, KeyError, ValueError):
        return None


class ChunkEncoder:
    """Token ids as little-endian bytes, those of the tokenizers library, each distinct string once.

    ASCII white space always ends a token of this vocabulary and gives none itself, so the ids of a text are
    those of its white-space separated strings in order. The vocabulary is one of lower case, so that A-Z may be
    lowered first, except where special tokens are written out. The ASCII marks after a string's last letter or
    digit are tokens of their own. Words of Latin letters are merged by LetterMerger, all others by the library.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        quiet_threads()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        self.merger = _merger(spec["model"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.entries = entries
        self.known = _Table({})
        vocab = self.tokenizer.get_vocab()
        #: Tokens that end a word. A string of letters is one word, so that many can be encoded in one text and told apart.
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def encode_many(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text; the new strings of a block of texts are learnt together."""
        for begin, end in blocks(texts):
            if end - begin == 1 and len(texts[begin]) > PART_BYTES:
                yield b"".join(b"".join(self._encode_block([part])) for part in parts_at_spaces(texts[begin], PART_BYTES))
            else:
                yield from self._encode_block(texts[begin:end])

    def _encode_block(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.entries // 2:  # the older half goes, but for what is used again
            self.known = _Table(dict(self.known))
        known = self.known
        known.new = {}  # nothing of a block that failed
        held = [list(map(known.__getitem__, (t if b"<|" in t else t.lower()).split())) for t in texts]
        if known.new:
            places = known.new
            self._learn(set(places))
            for w, ids in places.items():
                ids += known[w]
        return list(map(b"".join, held))

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_many([text]))

    def _learn(self, new: set[bytes]) -> None:
        letters, rest = [], []  # of Latin letters, and not
        for w in new:
            (rest if w.translate(None, _LATIN) else letters).append(w)
        marked, mixed = {}, []
        for w in rest:
            body = w.rstrip(_MARKS)
            if len(body) < len(w) and (body and not body.translate(None, _LATIN) or body[-1:].isalnum() or _ends_in_letter(body)) and b"<|" not in w:
                marked[w] = body, w[len(body) :]
            else:
                mixed.append(w)
        for w in set().union(*marked.values()).difference(self.known, new):
            (mixed if w.translate(None, _LATIN) else letters).append(w)
        plain, other = [], []  # of any letters, and not
        for w in mixed:
            (plain if w.decode().isalpha() else other).append(w)
        short = [w for w in letters if len(w) <= LONG_WORD] if self.merger else []
        if short:
            self.known.update(zip(short, self.merger(short), strict=True))
        if len(short) < len(letters):
            plain += set(letters).difference(short)
        parts = [plain[at : at + 200] for at in range(0, len(plain), 200)]
        for some, found in zip(parts, self.tokenizer.encode_batch_fast([b"\n".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, "<u4")
            ends = 4 * np.flatnonzero(self.ends[ids]) + 4
            if len(ends) != len(some):
                other += some
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            self.known.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        for at in range(0, len(other), 10_000):
            some = other[at : at + 10_000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.known.update((w, np.asarray(e.ids, "<u4").tobytes()) for w, e in zip(some, found, strict=True))
        self.known.update((w, self.known[body] + self.known[marks]) for w, (body, marks) in marked.items())


def encoder_of(path: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file."""
    start_task("packing")
    return kept("packing", path, lambda: ChunkEncoder(path))


def _check(spec: dict, path: str) -> None:
    """Raises unless the file lower-cases, splits at white space, and ends words with </w>."""
    steps = spec.get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    split = spec.get("pre_tokenizer") or {}
    split = split.get("pretokenizers", [split])
    wrong = [
        name
        for name, bad in (
            ("normaliser", {s.get("type") for s in steps} - {"Replace"} != {"NFC", "Lowercase"} or any(s["type"] == "Replace" and s.get("content") != " " for s in steps)),
            ("pre-tokeniser", [s.get("type") for s in split] != ["Split", "ByteLevel"] or split[0].get("behavior") != "Removed" or not split[0].get("invert") or split[1].get("add_prefix_space")),
            ("model", spec["model"].get("end_of_word_suffix") != "</w>" or any(spec["model"].get(k) for k in ("dropout", "unk_token", "byte_fallback"))),
            ("added tokens", any(not t["content"].startswith("<|") or any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in spec["added_tokens"])),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"{path} is no vocabulary of lower-case words; it differs in its {', '.join(wrong)}")


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each piece of at most `capacity` tokens; every document ends with `end_id`."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(utf8(batch.column(1))), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, PIECES)


class Plan:
    """Patterns of lengths with the number of sequences that follow each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.patterns: list[tuple[tuple[int, ...], int]] = []

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        if times:
            self.patterns.append((lengths, times))

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def slots(self) -> dict[int, np.ndarray]:
        """By length: rows (first rank, first sequence, offset), ranks counted within the length."""
        used: dict[int, int] = defaultdict(int)
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        sequence = 0
        for lengths, times in self.patterns:
            offset = 0
            for length in lengths:
                out[length].append((used[length], sequence, offset))
                used[length] += times
                offset += length
            sequence += times
        return {k: np.asarray(v, np.int64) for k, v in out.items()}


def _complement(left: np.ndarray, gap: int, pairs: np.ndarray, most: int) -> tuple[int, ...]:
    """One, two or three available lengths, at most `most`, that sum to `gap`, the longest first; () if there are none."""
    if most and left[gap]:
        return (gap,)
    have = left > 0

    def two(total: int, least_counts: dict[int, int]) -> tuple[int, ...]:
        small = np.arange(1, total // 2 + 1)
        for a in small[have[small] & have[total - small]].tolist():
            b = total - a
            need = defaultdict(int, least_counts)
            need[a] += 1
            need[b] += 1
            if all(left[x] >= n for x, n in need.items()):
                return (b, a)
        return ()

    if most >= 2 and gap >= 2 and pairs[gap] and (found := two(gap, {})):
        return found
    if most >= 3 and gap >= 3:
        first = np.arange(gap - 2, 0, -1)
        for c in first[have[first] & pairs[gap - first]].tolist():
            if found := two(gap - c, {c: 1}):
                return tuple(sorted((c, *found), reverse=True))
    return ()


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Sequences for `counts` pieces of each length: the shortest of the plans with combinations of up to three, two and one length."""
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    best: Plan | None = None
    for longest in (3, 2, 1):
        plan = _plan(counts, capacity, longest)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, longest: int) -> Plan:
    plan = Plan(capacity)
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan.add((capacity,), int(left[capacity]))
    left[capacity] = 0
    half = capacity // 2
    #: Short pieces that are left, less the long ones that still need one, matched by best fit or here.
    surplus = int(left[: half + 1].sum() - left[half + 1 :].sum())

    def pair_sums() -> np.ndarray:
        have = (left > 0).astype(float)
        size = 1 << (2 * len(have)).bit_length()
        spectrum = np.fft.rfft(have, size)
        return np.fft.irfft(spectrum * spectrum, size)[: capacity + 1] > 0.5

    rest = np.zeros_like(left)
    pairs, fresh = pair_sums(), int((left > 0).sum())
    for length in range(capacity - 1, 0, -1):
        own = -1 if length > half else 1  # what the piece itself takes from the surplus
        while left[length]:
            left[length] -= 1  # the piece whose gap is to be filled
            most = min(longest, surplus - own)
            found = _complement(left, capacity - length, pairs, most) if most > 0 else ()
            left[length] += 1
            if not found:
                rest[length] += left[length]
                left[length] = 0
                break
            need: dict[int, int] = defaultdict(int)
            for x in (length, *found):
                need[x] += 1
            times = min(int(left[x]) // n for x, n in need.items())
            if (taken := own + len(found)) > 0:
                times = min(times, surplus // taken)
            plan.add((length, *found), times)
            surplus -= taken * times
            for x, n in need.items():
                left[x] -= n * times
        if (now := int((left > 0).sum())) != fresh:
            pairs, fresh = pair_sums(), now
    _best_fit(plan, rest)
    return plan


def _best_fit(plan: Plan, rest: np.ndarray) -> None:
    """Best fit, longest first; open sequences of one pattern are handled together."""
    open_: dict[int, list[list]] = defaultdict(list)  # gap: [[lengths, times], ...]
    gaps = np.zeros(plan.capacity + 1, bool)
    for length in range(plan.capacity, 0, -1):
        n = int(rest[length])
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                lengths, times = open_[gap].pop()
                gaps[gap] = bool(open_[gap])
                if times > n:
                    open_[gap].append([lengths, times - n])
                    gaps[gap] = True
                    times = n
                each = 1
            else:
                gap, lengths = plan.capacity, ()
                each = min(n, plan.capacity // length)
                times = n // each
            open_[gap - each * length].append([(*lengths, *[length] * each), times])
            gaps[gap - each * length] = True
            n -= each * times
            if gaps[0]:
                for done in open_.pop(0, []):
                    plan.add(tuple(done[0]), done[1])
                gaps[0] = False
    for groups in open_.values():
        for lengths, times in groups:
            plan.add(tuple(lengths), times)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """`pieces` (with the columns of PIECES) with sequence_id and offset."""
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    slots = plan_packing(counts, capacity).slots()
    # A hot length is ranked in buckets, as many as make the largest one a share of a task; there are about as many
    # buckets as lengths and four times the shuffle partitions together, at any corpus size.
    width = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(BUCKET_ROWS, -(-sum(counts.values()) // (4 * width)))
    hot = {length: -(-n // most) for length, n in counts.items() if n > most}
    buckets = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in hot.items() for x in pair)), F.col("length").cast("int")), F.lit(1)) if hot else F.lit(1)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets).cast("int"))
    first = dict.fromkeys(((length, 0) for length in counts if length not in hot), 0)
    seen: dict[int, int] = defaultdict(int)
    held = dealt.where(F.col("length").isin(list(hot))).groupBy("length", "bucket").agg(F.count("*").alias("n")).collect() if hot else []
    for length, bucket, n in sorted(map(tuple, held)):
        first[length, bucket] = seen[length]
        seen[length] += n
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")  # rows that agree in all are alike
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, buckets, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 5, 6))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.lexsort((buckets, lengths))
            edges = np.flatnonzero(np.diff(lengths[order]) | np.diff(buckets[order])) + 1
            for group in np.split(order, edges) if len(order) else []:
                key = int(lengths[group[0]]), int(buckets[group[0]])
                at_length = first[key] + rank[group]
                table = slots[key[0]]
                at = np.searchsorted(table[:, 0], at_length, side="right") - 1
                sequence[group] = table[at, 1] + at_length - table[at, 0]
                offset[group] = table[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "bucket", "rank").mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut into pieces and pack: one row for each piece, see PACKED."""
    return pack(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
