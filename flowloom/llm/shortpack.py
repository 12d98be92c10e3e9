"""Shortest-pack-first packing over the length histogram, with as little padding as cuts can buy.

Documents are tokenized in tasks. A document longer than ``capacity`` is cut at its multiples; every other one stays whole. Only the
number of pieces of each length (at most ``capacity`` rows) goes to the driver. There lengths are placed longest first, always into the
shortest packs that have room, and what is kept is a count for each packing pattern (a list of lengths), never a pack. Patterns that end
with room are then settled: the emptiest packs are taken apart, and their pieces fill the room of the others, cut where they have to be.
What is left of the last one is cut into sequences whose lengths are powers of two, which are not padded. Pieces get a rank
within their length, and patterns are joined back to them by it.

Cuts that the plan makes inside a piece need the checksum of each part. The ids of pieces that are not full are stored for that, in a
column of their own, which is read for the few pieces that are cut.

Defined cases: a null or empty text is one piece holding the end id only; rows without an id are packed with a null id; repeated rows
are packed as rows of their own; a very long text is cut like any other; an empty table gives an empty result; further columns, whatever
their names, are ignored; pieces of equal length are ranked by (doc_id, start, checksum, place in the stored table), so ties change
nothing but which of two like pieces comes first.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import batch_of, map_batches, text_of
from flowloom.session import checkpoint

CAPACITY = 1024
#: Room of fewer tokens than this stays as padding; more is filled, by a cut if need be.
LEAST_ROOM = 4
#: Pieces that share a length are ranked in independent sub-ranges of so many pieces on average, and in so many at least.
PIECES_PER_RANGE = 50_000
RANK_RANGES = 64
#: A plan of so many steps is sent to all tasks; a larger one is joined through a shuffle.
BROADCAST_STEPS = 500_000
#: Runs without (or of) white space from this length on are left to the tokenizer itself: its work grows slower with a run.
LONG_RUN = 2000

PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"

_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(r"\s{%d}" % LONG_RUN)


def _printable() -> dict[str, int]:
    """Characters by which byte-level vocabularies name bytes: those that print stand for themselves, the rest count up from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenIds:
    """Text -> ids as little-endian 32-bit bytes, equal to those of the tokenizer file.

    A byte-level vocabulary whose merges are in the order of their ids is worked off by merge ranks, which is several times
    faster. Texts that hold the name of an added token or a very long run, and files of any other kind, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        self.ranks = self._by_ranks(made)

    def _by_ranks(self, made: dict):
        model, cut = made["model"], made.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        whole = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        if model.get("type") != "BPE" or not plain or not whole or made.get("normalizer"):
            return None
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocabulary[a + b] for a, b in pairs]
        if order != sorted(order) or not order:
            return None
        import tiktoken

        byte, special = _printable(), set(self.added)
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("merge-ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        if len(text) >= LONG_RUN and (_SPACES.search(text) or max(map(len, text.split()), default=0) >= LONG_RUN):
            return False
        return not any(name in text for name in self.added)

    def __call__(self, text: str) -> bytes:
        if self.ranks is not None and self.plain(text):
            ids = self.ranks.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def token_ids(path: str) -> TokenIds:
    """One for a worker process, whatever number of tasks it runs."""
    return TokenIds(path)


def _cut(batches: Iterator[pa.RecordBatch], tokenizer_path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    ids_of, end = token_ids(tokenizer_path), end_id.to_bytes(4, "little")
    row = TaskContext.get().partitionId() << 38
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in PIECES}
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = memoryview(ids_of(text) + end)
            total = len(ids) // 4
            for start in range(0, total, capacity):
                length = min(capacity, total - start)
                own = ids[4 * start : 4 * (start + length)]
                values = (row, doc_id, start, length, zlib.crc32(own), total, None if length == capacity else bytes(own))
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
                row += 1
        yield batch_of(out, PIECES)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Documents cut at multiples of ``capacity``, with the ids of pieces that are not full. To be stored before it is used."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_batches(rows, _cut, PIECES_DDL, tokenizer_path=tokenizer_path, capacity=capacity, end_id=end_id)


def place(histogram: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Patterns (lengths, longest first) -> how many packs have them.

    Lengths are placed longest first. All of the shortest packs take one piece before the next shortest do; where none has room,
    packs are opened, each when the one before is full. Work depends on the number of patterns, not on that of pieces.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in by_room if r >= length), default=None)
            if room is None:
                most = capacity // length
                for each, many in ((most, left // most), (left % most, 1)):
                    if each and many:
                        packs = by_room[capacity - each * length]
                        packs[(length,) * each] = packs.get((length,) * each, 0) + many
                break
            packs, grown = by_room[room], by_room[room - length]
            for pattern in sorted(packs):
                many = min(packs[pattern], left)
                left -= many
                grown[(*pattern, length)] = grown.get((*pattern, length), 0) + many
                packs[pattern] -= many
                if not packs[pattern]:
                    del packs[pattern]
                if not left:
                    break
            if not packs:
                del by_room[room]
    return {pattern: many for packs in by_room.values() for pattern, many in packs.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, least_room: int = LEAST_ROOM) -> list[tuple[int, int, int, int, int, int, int]]:
    """Steps (length, first rank, past-last rank, begin, size, first sequence, offset).

    A step puts the tokens [begin, begin + size) of the pieces of one length and consecutive ranks into consecutive sequences.
    """
    steps: list[tuple[int, int, int, int, int, int, int]] = []
    ranks: dict[int, int] = defaultdict(int)
    sequences = 0
    open_packs = []  # (used, first sequence, how many, [(length, first rank)])
    for pattern, many in sorted(place(histogram, capacity).items(), reverse=True):
        slots = []
        for length in pattern:
            slots.append((length, ranks[length]))
            ranks[length] += many
        used = sum(pattern)
        if used & (used - 1) and capacity - used >= least_room:
            open_packs.append((used, sequences, many, slots))
        else:
            _put(steps, slots, many, sequences)
        sequences += many
    open_packs.sort(key=lambda p: (p[0], p[1]))
    room = sum((capacity - used) * many for used, _, many, _ in open_packs)
    parts: list[tuple[int, int, int, int, int]] = []  # (size, length, first rank, past-last rank, begin) of packs taken apart
    while open_packs:
        used, first, many, slots = open_packs[0]
        apart = min(many, room // capacity)  # each one takes its own room away and fills ``used`` of the others'
        if not apart:
            break
        room -= apart * capacity
        parts += [(length, length, rank, rank + apart, 0) for length, rank in slots]
        if apart == many:
            open_packs.pop(0)
        else:
            open_packs[0] = (used, first + apart, many - apart, [(length, rank + apart) for length, rank in slots])
    if open_packs:  # one more, of which a rest remains
        used, first, many, slots = open_packs.pop(0)
        parts += [(length, length, rank, rank + 1, 0) for length, rank in slots]
        if many > 1:
            open_packs.insert(0, (used, first + 1, many - 1, [(length, rank + 1) for length, rank in slots]))
    gaps = []
    for used, first, many, slots in open_packs:
        _put(steps, slots, many, first)
        gaps.append((used - capacity, first, many, used))
    rest = _fill(steps, parts, gaps, least_room)
    left = sum(size * (upto - rank) for size, _, rank, upto, _ in rest)
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            rest = _fill(steps, rest, [(-(1 << bit), sequences, 1, 0)], 1)
            sequences += 1
    return steps


def _put(steps: list, slots: list[tuple[int, int]], many: int, first: int) -> None:
    offset = 0
    for length, rank in slots:
        steps.append((length, rank, rank + many, 0, length, first, offset))
        offset += length


def _fill(steps: list, parts: list[tuple[int, int, int, int, int]], gaps: list[tuple[int, int, int, int]], least_room: int) -> list:
    """Fills gaps (minus room, first sequence, how many, offset), largest first, with parts, largest first; returns the parts left."""
    heapq.heapify(gaps)
    left = [(-size, *part) for size, *part in parts]
    heapq.heapify(left)
    while left and gaps:
        size, length, rank, upto, begin = heapq.heappop(left)
        room, first, many, offset = heapq.heappop(gaps)
        size, room, pieces = -size, -room, upto - rank
        each = max(1, size // room)  # gaps that one part fills
        n = min(pieces, many // each)
        if n:
            take = min(size, room)
        else:  # fewer gaps than one part fills
            n, each, take = 1, many, room
        for k in range(each):
            steps.append((length, rank, rank + n, begin + k * take, take, first + k * n, offset))
        if each * take < size:
            heapq.heappush(left, (each * take - size, length, rank, rank + n, begin + each * take))
        if n < pieces:
            heapq.heappush(left, (-size, length, rank + n, upto, begin))
        if take < room and room - take >= least_room:
            heapq.heappush(gaps, (take - room, first, n, offset + take))
        if n * each < many:
            heapq.heappush(gaps, (-room, first + n * each, many - n * each, offset))
    return [(-size, *part) for size, *part in left]


def _ranked(pieces: DataFrame, ranges: int) -> DataFrame:
    """``rank``: 0, 1, ... within each length. A common length is ranked in sub-ranges by many tasks."""
    keyed = pieces.withColumn("range", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(ranges)))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "range").agg(F.count("*").alias("n")).select(
        "length", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "range").orderBy("doc_id", "start", "ids_crc32", "row")
    at = keyed.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["length", "range"])
    return at.withColumn("rank", F.col("base") + F.col("at")).drop("range", "at", "base")


def pack(pieces: DataFrame, capacity: int = CAPACITY, least_room: int = LEAST_ROOM) -> DataFrame:
    """Sequences for stored ``token_pieces``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each part."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(histogram, capacity, least_room)
    steps = spark.createDataFrame(made or [(0,) * 7], "length long, _from long, _to long, _begin long, _size long, _first long, offset long")
    if len(made) <= BROADCAST_STEPS:
        steps = F.broadcast(steps)
    ranked = _ranked(pieces.drop("ids"), max(RANK_RANGES, -(-sum(histogram.values()) // PIECES_PER_RANGE))).alias("p")
    c, size = F.col, F.col("_size")
    same = (c("p.length") == c("s.length")) & (c("rank") >= c("_from")) & (c("rank") < c("_to"))
    placed = checkpoint(ranked.join(steps.alias("s"), same).select(
        "row", "doc_id", (c("start") + c("_begin")).alias("start"), size.alias("length"), "ids_crc32", "doc_tokens",
        (c("_first") + c("rank") - c("_from")).alias("sequence_id"), "offset", c("_begin").alias("begin"),
        (size < c("p.length")).alias("cut")))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = pieces.where(c("length") < capacity).select("row", "ids")
    own = F.crc32(F.substring("ids", (4 * c("begin") + 1).cast("int"), (4 * c("length")).cast("int")))
    parts = placed.where("cut").drop("ids_crc32").join(ids, "row").withColumn("ids_crc32", own)
    return placed.where("not cut").select(*out).unionByName(parts.select(*out))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, least_room: int = LEAST_ROOM) -> DataFrame:
    """One row per part of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0)."""
    return pack(checkpoint(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity, least_room)
