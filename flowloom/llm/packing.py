"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents are tokenized in tasks and cut into pieces of at most ``capacity`` tokens. Only the number of pieces of each
length (at most ``capacity`` rows) goes to the driver, where best-fit decreasing runs over counts: bins of equal free
space are one group, and a whole group takes pieces in one step. The plan says which ranks of each length go to which
sequences; pieces get a rank within their length and take the slot planned for it.

Defined cases: a null or empty text is one piece holding the end id only; a longer document is cut at multiples of
``capacity`` and only its last piece may be shorter; repeated rows (same id and text) are packed as rows of their own;
an empty table gives an empty result; further columns are ignored. Rows without an id are packed with a null id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import batch_of, map_batches, text_of
from flowloom.session import checkpoint

CAPACITY = 2048
#: Distinct chunks of text whose ids a worker remembers (past it the later half goes: common chunks come early), and that one call encodes.
CACHE_CHUNKS = 600_000
CHUNKS_PER_CALL = 64
#: Pieces that share a length are ranked in so many independent sub-ranges at least.
RANK_RANGES = 64
#: Pieces in one such sub-range on average, over all lengths.
PIECES_PER_RANGE = 50_000
#: A plan of so many steps is sent to all tasks; a larger one is joined through a shuffle.
BROADCAST_STEPS = 500_000

_ENDING = re.compile(rb"(?<=[a-z0-9])([!-&(-/:-@\[-`{-~]+)(?=[ \n]|$)")
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkIds:
    """Chunks between white space -> their ids as little-endian 32-bit bytes.

    The tokenizer puts letters into lower case, drops white space and merges nothing across it, so a text's ids are those of its
    chunks in turn. Only ASCII white space cuts and only A-Z change here; the tokenizer itself sees to all else. New chunks
    are encoded together; tokens fall to chunks by their offsets.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.known: dict[bytes, bytes] = {}
        # Any other kind of tokenizer gets whole texts.
        self.by_chunk = self.ids("Ab,  c") == [i for c in ("ab", ",", "c") for i in self.ids(c)]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) + len(chunks) > CACHE_CHUNKS:
            self.known = dict(islice(self.known.items(), CACHE_CHUNKS // 2))
        new = [c for c in chunks if c not in self.known]
        # A few chunks to a call: a call has its costs, and the tokenizer's work on one text grows faster than the text.
        ids, begins, sizes, base = [], [], [], 0
        for at in range(0, len(new), CHUNKS_PER_CALL):
            part = [c.decode() for c in new[at : at + CHUNKS_PER_CALL]]
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids += encoded.ids
            begins += [base + o[0] for o in encoded.offsets]
            sizes += [len(c) + 1 for c in part]
            base += sum(map(len, part)) + len(part)
        cuts = 4 * np.searchsorted(np.array(begins, dtype=np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
        packed = np.array(ids, dtype="<u4").tobytes()
        slices = map(slice, cuts[:-1].tolist(), cuts[1:].tolist())
        self.known.update(zip(new, map(packed.__getitem__, slices), strict=True))

    @staticmethod
    def chunks(text: str) -> list[bytes]:
        raw = text.encode()
        lowered = raw.lower()
        # A special token's name stays as it is written. Marks between a letter and white space are a chunk of their own.
        return raw.split() if b"<|" in lowered else _ENDING.sub(rb" \1", lowered).split()

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        if not self.by_chunk:
            yield from (np.array(self.ids(text), dtype="<u4").tobytes() for text in texts)
            return
        group, size = [], 0
        for text in texts:
            group.append(self.chunks(text))
            size += len(group[-1])
            if size > 200_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[bytes]]) -> Iterator[bytes]:
        self.learn(set().union(*group))
        for chunks in group:
            yield b"".join(map(self.known.__getitem__, chunks))


@lru_cache(maxsize=2)
def chunk_ids_of(tokenizer_path: str) -> ChunkIds:
    """One for a worker process: a chunk is encoded once for all tasks that run in it."""
    return ChunkIds(tokenizer_path)


def _cut(batches: Iterator[pa.RecordBatch], tokenizer_path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    chunk_ids, end = chunk_ids_of(tokenizer_path), end_id.to_bytes(4, "little")
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in PIECES}
        doc_ids, texts = (c.to_pylist() for c in batch.columns)
        for doc_id, ids in zip(doc_ids, chunk_ids.batch(texts), strict=True):
            ids = memoryview(ids + end)
            total = len(ids) // 4
            for piece, start in enumerate(range(0, total, capacity)):
                length = min(capacity, total - start)
                row = (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        yield batch_of(out, PIECES)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, each with the CRC of its ids. Text never leaves the scan's task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_batches(rows, _cut, PIECES_DDL, tokenizer_path=tokenizer_path, capacity=capacity, end_id=end_id)


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: steps (length, first rank, past-last rank, first sequence, offset).

    A step gives pieces of one length and consecutive ranks to consecutive sequences at the same offset. Work is
    bounded by groups of equal bins, not by pieces: a length splits one group at most and opens one at most.
    """
    free: dict[int, list[list[int]]] = {}  # free space -> [first sequence, how many]
    steps, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for space in sorted(s for s in free if s >= length):  # the fullest bins that still have room come first
            # A bin that still has room for the same length takes it again right away.
            while left and space >= length and free.get(space):
                first, many = free[space].pop()
                if not free[space]:
                    del free[space]
                fits = space // length
                whole = min(many, left // fits)
                for k in range(fits if whole else 0):
                    steps.append((length, rank, rank + whole, first, capacity - space + k * length))
                    rank += whole
                left -= whole * fits
                if whole:
                    free.setdefault(space - fits * length, []).append([first, whole])
                if whole < many:
                    rest, first = many - whole, first + whole
                    if left:  # fewer than fill one bin: they go into one bin
                        for k in range(left):
                            steps.append((length, rank, rank + 1, first, capacity - space + k * length))
                            rank += 1
                        free.setdefault(space - left * length, []).append([first, 1])
                        left, rest, first = 0, rest - 1, first + 1
                    if rest:
                        free.setdefault(space, []).append([first, rest])
                    break
        if left:
            fits = capacity // length
            whole, over = divmod(left, fits)
            for k in range(fits if whole else 0):
                steps.append((length, rank, rank + whole, sequences, k * length))
                rank += whole
            if whole:
                free.setdefault(capacity - fits * length, []).append([sequences, whole])
            sequences += whole
            for k in range(over):
                steps.append((length, rank, rank + 1, sequences, k * length))
                rank += 1
            if over:
                free.setdefault(capacity - over * length, []).append([sequences, 1])
                sequences += 1
    return steps


def ranked_by_length(pieces: DataFrame, ranges: int) -> DataFrame:
    """``rank``: 0, 1, ... within each length. A common length is ranked in sub-ranges by many tasks."""
    keyed = pieces.withColumn("_range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(ranges)).cast("int"))
    counts = keyed.groupBy("length", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_range").orderBy("doc_id", "piece")
    return (
        keyed.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_range"])
        .withColumn("rank", F.col("_start") + F.col("_at"))
        .drop("_range", "_at", "_start")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``pieces`` is read more than once: pass a stored table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = best_fit_plan(histogram, capacity)
    plan = spark.createDataFrame(steps or [(0, 0, 0, 0, 0)], "length long, _from long, _to long, _first long, offset long")
    if len(steps) <= BROADCAST_STEPS:
        plan = F.broadcast(plan)
    ranked = ranked_by_length(pieces, max(RANK_RANGES, -(-sum(histogram.values()) // PIECES_PER_RANGE))).alias("p")
    plan = plan.alias("s")
    taken = ranked.join(plan, (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("_from"))
                        & (F.col("rank") < F.col("_to")))
    return taken.select(*[F.col(f"p.{c}") for c in pieces.columns],
                        (F.col("_first") + F.col("rank") - F.col("_from")).alias("sequence_id"), F.col("s.offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0)."""
    return pack(checkpoint(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
