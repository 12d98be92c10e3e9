"""Language-model scores by deleted interpolation of n-gram estimates.

    p(w | v) = a2 * c(v, w) / c(v)  +  a1 * c(w) / N  +  a0 / (V + 1)

The weights a2, a1, a0 depend on how often the context v was seen (a bucket per factor of two). They are learned by
expectation-maximisation: bigrams of held-out training documents are explained by counts of the other training documents only.
Scores then use the counts of all training documents.

How it runs. A task turns documents into blocks of about ``BLOCK_TOKENS`` tokens: every token as a number into the block's own word list,
and the block's distinct words and bigrams as sorted 64-bit hashes with their counts, cut by hash range. Ranges are summed across blocks
(a word of every second line costs one entry per block, not one per token), and the totals come back to each block in the order it asked, so
answers need no keys. A block with its answers is then scored in one task. Entries grow with the distinct bigrams per block and tokens shuffled
with the tokens; nothing is gathered on the driver but weights and a table of held-out counts of bounded size (buckets x steps x steps).

The rows of ``docs`` must come in the same order each time they are read, as those of a table do; a block that changed stops the job.

Defined cases: null and empty texts are one end token; words are cut at ASCII white space with A-Z in lower case; a document's first token follows
a start mark, its end is a token; rows that repeat an id are scored one by one and counted as often as they occur; without training rows N and V
are 0 and every token has probability 1; rows without an id count as the id ''; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import fold_of, map_batches, mix, rows_of, text_of, words_of
from flowloom.session import checkpoint

FOLDS, HELD_OUT, TUNING = 5, 1, 4  # crc32 of the id modulo FOLDS: 1 is scored only, 4 tunes the weights
BLOCK_TOKENS = 1_500_000
#: Entries that one hash range holds, over all blocks, about.
RANGE_ENTRIES = 1_000_000
BUCKETS = 40
#: Steps of the held-out table for each of two ratios, in halves of a factor of two.
STEPS = 96
EM_STEPS = 200

_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ASKED = pa.schema([("part", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ASKED_DDL = "part int, block string, kind int, keys binary, counts binary"
BLOCK = pa.schema([("block", pa.string()), ("part", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
BLOCK_DDL = "block string, part int, kind int, body binary"
WORD, PAIR, TEXT = 0, 1, 2
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                 ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _packed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _opened(body: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=kind)


class Block:
    """Documents of one task in turn: ids, folds, lengths, tokens as numbers into ``words`` (64-bit hashes)."""

    def __init__(self, place: str, ids: list, lengths: list[int], tokens: np.ndarray, words: np.ndarray):
        self.ids, self.lengths, self.tokens, self.words = ids, np.array(lengths, dtype=np.int64), tokens, words
        self.folds = np.array([fold_of(i, FOLDS) for i in ids], dtype=np.int64)
        digest = xxhash.xxh3_128()
        for part in (repr(ids).encode(), self.lengths.tobytes(), words.tobytes(), tokens.tobytes()):
            digest.update(part)
        self.place = place
        self.name = f"{place}-{digest.hexdigest()}"
        fold_of_token = np.repeat(self.folds, self.lengths)
        self.tuning, self.training = fold_of_token == TUNING, fold_of_token != HELD_OUT
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    @cached_property
    def before(self) -> np.ndarray:
        """The word before each token; a document's first token follows the start mark, which comes after all words."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = len(self.words)
        return before

    @cached_property
    def asked_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of words and the start mark, and where each token and each context finds its own."""
        keys, spot = np.unique(np.append(self.words, _START), return_inverse=True)
        spot = spot.astype(np.int32)
        return keys, spot[self.tokens], spot[self.before]

    @cached_property
    def asked_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        contexts = np.append(self.words, _START)
        keys, at = np.unique(mix(contexts[self.before] + mix(self.words[self.tokens])), return_inverse=True)
        return keys, at.astype(np.int32)

    def counts(self, at: np.ndarray, n: int) -> np.ndarray:
        """Occurrences per key in training documents for the estimates, and in those for tuning."""
        own = np.bincount(at[self.training & ~self.tuning], minlength=n)
        return np.stack([own, np.bincount(at[self.tuning], minlength=n)]).astype(np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The same rows in the same order always give the same blocks, named by their place and contents."""
    known: dict[bytes, int] = {}
    ids, lengths, tokens = [], [], []
    task, number_of = TaskContext.get().partitionId(), count()

    def taken() -> Block:
        words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), dtype=np.uint64, count=len(known))
        words[0] = _END
        return Block(f"{task}-{next(number_of)}", ids, lengths, np.concatenate(tokens), words)

    known[b"\n"] = 0  # the end; no word holds white space
    size = 0
    for doc_id, text in rows_of(batches):
        words = words_of(text)
        words.append(b"\n")
        number = known.setdefault
        tokens.append(np.fromiter((number(w, len(known)) for w in words), dtype=np.int32, count=len(words)))
        ids.append(doc_id)
        lengths.append(len(words))
        size += len(words)
        if size >= BLOCK_TOKENS:
            yield taken()
            known, ids, lengths, tokens, size = {b"\n": 0}, [], [], [], 0
    if ids:
        yield taken()


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal hash ranges begins among sorted keys."""
    borders = (np.arange(parts + 1, dtype=object) * (1 << 64)) // parts
    return np.append(np.searchsorted(keys, np.array(borders[:-1], dtype=np.uint64)), len(keys))


def _ask(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        for kind, (keys, at, *_) in ((WORD, block.asked_words), (PAIR, block.asked_pairs)):
            both = [keys, block.counts(at, len(keys))]
            if kind == WORD:  # a start mark is the context of every document's first token
                starts = np.searchsorted(keys, _START)
                both[1][0, starts] = int(((block.folds != HELD_OUT) & (block.folds != TUNING)).sum())
                both[1][1, starts] = int((block.folds == TUNING).sum())
            cuts = _ranges(keys, parts)
            rows = [(p, block.name, kind, _packed(keys[a:b]), _packed(both[1][:, a:b])) for p, (a, b) in
                    enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            for at_row in range(0, len(rows), 64):
                part = rows[at_row : at_row + 64]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part, strict=True), ASKED, strict=True)], schema=ASKED)


def _answer(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums one hash range of one kind over all blocks, and gives each block its totals in its own order."""
    part, kind = key[0].as_py(), key[1].as_py()
    asked = [row for batch in group for row in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "counts")), strict=True)]
    keys = [_opened(k, "<u8") for _, k, _ in asked]
    counts = [_opened(c, "<u4").reshape(2, -1).astype(np.int64) for _, _, c in asked]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.stack([np.bincount(at, weights=np.concatenate([c[k] for c in counts]), minlength=len(every)) for k in (0, 1)]).astype(np.uint64)
    end = 0
    for (name, _, _), own in zip(asked, keys, strict=True):
        begin, end = end, end + len(own)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([kind], pa.int32()),
                                          pa.array([_packed(sums[:, at[begin:end]])], pa.binary())], schema=BLOCK)
    if kind == WORD:  # N and V: every word once, without the start mark
        real = every != _START
        size = np.array([sums[0][real].sum(), sums[1][real].sum(), (sums[0][real] > 0).sum(), (sums[:, real].sum(axis=0) > 0).sum()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([part], pa.int32()), pa.array([kind], pa.int32()),
                                          pa.array([_packed(size)], pa.binary())], schema=BLOCK)


def _texts(batches: Iterator[pa.RecordBatch], tuning_only: bool) -> Iterator[pa.RecordBatch]:
    """Blocks themselves: ids, lengths, words, tokens. For tuning only the blocks that hold tuning documents matter."""
    for block in _blocks(batches):
        if tuning_only and not block.tuning.any():
            continue
        known = np.array([i is not None for i in block.ids])
        ids = np.array([i or 0 for i in block.ids], dtype=np.int64)
        width = "<u2" if len(block.words) < 1 << 16 else "<u4"
        low, high = block.tokens & 0xFFFF, block.tokens >> 16
        place = block.place.encode()
        body = [place, ids.tobytes(), known.tobytes(), block.lengths.tobytes(), block.words.tobytes(), low.astype("<u2").tobytes(),
                high.astype("u1").tobytes() if width == "<u4" else b""]
        sizes = np.array([len(place), len(block.ids), len(block.words), len(block.tokens), len(body[-1])], dtype="<i8").tobytes()
        packed = zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(body))
        yield pa.RecordBatch.from_arrays([pa.array([block.name]), pa.array([0], pa.int32()), pa.array([TEXT], pa.int32()),
                                          pa.array([packed], pa.binary())], schema=BLOCK)


def _read_block(body: bytes) -> Block:
    raw = zstandard.ZstdDecompressor().decompress(body)
    letters, n, words, tokens, high = np.frombuffer(raw, "<i8", 5).tolist()
    at = 40

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    place = take("u1", letters).tobytes().decode()
    ids, known, lengths, hashes, low = take("<i8", n), take("?", n), take("<i8", n), take("<u8", words), take("<u2", tokens)
    numbers = low.astype(np.int32) + ((take("u1", high).astype(np.int32) << 16) if high else 0)
    return Block(place, [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths.tolist(), numbers, hashes)


def _told(group: pa.Table) -> tuple[Block, np.ndarray, np.ndarray] | None:
    """A block with the totals of its words and bigrams, in the order of its keys; None for answers without their block."""
    rows = sorted(zip(*(group[c].to_pylist() for c in ("kind", "part", "body")), strict=True), key=lambda r: r[:2])
    texts = [body for kind, _, body in rows if kind == TEXT]
    if not texts:
        return None
    block = _read_block(texts[0])
    empty = [np.zeros((2, 0), dtype=np.uint64)]
    sums = [np.concatenate(empty + [_opened(b, "<u8").reshape(2, -1) for k, _, b in rows if k == kind], axis=1).astype(np.float64)
            for kind in (WORD, PAIR)]
    if sums[0].shape[1] != len(block.asked_words[0]) or sums[1].shape[1] != len(block.asked_pairs[0]):
        raise RuntimeError("a block's answers do not fit the block: its input changed while it was read")
    return block, sums[0], sums[1]


def _shares(block: Block, words: np.ndarray, pairs: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: the context's bucket, the bigram's share of its context, the word's share of all."""
    _, word_at, before_at = block.asked_words
    context = words[before_at]
    bucket = np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1))).astype(np.int64)
    p2 = np.divide(pairs[block.asked_pairs[1]], context, out=np.zeros(len(context)), where=context > 0)
    return bucket, p2, words[word_at] / total if total else np.zeros(len(context))


def _step(ratio: np.ndarray) -> np.ndarray:
    """0 for none, else half factors of two around 1."""
    return np.where(ratio > 0, np.clip(np.round(2 * np.log2(np.maximum(ratio, 1e-300))) + 4, 1, STEPS - 1), 0).astype(np.int64)


def _tune(key: tuple, group: pa.Table, total: float, kinds: float) -> pa.Table:
    """Held-out tokens of a block by bucket and by the steps of p2 and p1 over the uniform share."""
    told = _told(group)
    if told is None:  # no tuning document in it
        return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    block, words, pairs = told
    bucket, p2, p1 = _shares(block, words[0], pairs[0], total)
    cell = (bucket * STEPS + _step(p2 * (kinds + 1))) * STEPS + _step(p1 * (kinds + 1))
    cells, counts = np.unique(cell[block.tuning], return_counts=True)
    return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(counts, pa.int64())})


def mixture(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights a2, a1, a0 per bucket by expectation-maximisation over held-out counts."""
    bucket, steps = cells // STEPS**2, np.stack([cells // STEPS % STEPS, cells % STEPS], axis=1)
    ratio = np.where(steps > 0, 2.0 ** ((steps - 4) / 2), 0.0)
    likely = np.column_stack([ratio, np.ones(len(cells))])  # each estimate over the uniform one
    weights = np.tile(np.array([0.4, 0.5, 0.1]), (BUCKETS, 1))
    for _ in range(EM_STEPS):
        share = weights[bucket] * likely
        share *= (counts / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + np.array([0.4, 0.5, 0.1])
        new /= new.sum(axis=1, keepdims=True)
        done = float(np.abs(new - weights).max()) < 1e-7
        weights = new
        if done:
            break
    weights[0] = [0.0, weights[0, 1] / (weights[0, 1] + weights[0, 2]), weights[0, 2] / (weights[0, 1] + weights[0, 2])]
    return weights


def _score(key: tuple, group: pa.Table, weights: list, total: float, kinds: float) -> pa.Table:
    told = _told(group)
    if told is None:
        raise RuntimeError("answers without their block: the input changed while it was read")
    block, words, pairs = told
    words, pairs = words.sum(axis=0), pairs.sum(axis=0)
    bucket, p2, p1 = _shares(block, words, pairs, total)
    a = np.array(weights)[bucket]
    seen = words[block.asked_words[1]]
    model = np.log10(a[:, 0] * p2 + a[:, 1] * p1 + a[:, 2] / (kinds + 1))
    base = np.log10((seen + 0.5) / (total + 0.5 * (kinds + 1)))
    if not total:
        model = np.zeros(len(seen))
    add = lambda x: np.add.reduceat(x, block.first)
    return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.folds == HELD_OUT, pa.bool_()),
                     "n_tokens": pa.array(block.lengths, pa.int64()), "n_known": pa.array(add((seen > 0).astype(np.int64)), pa.int64()),
                     "train_tokens": pa.array([int(total)] * len(block.ids), pa.int64()), "base_score": add(base), "score": add(model)},
                    schema=OUT)


def language_scores(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    letters = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = max(1, letters // 8 // RANGE_ENTRIES + 1)  # about 8 letters to an entry
    asked = map_batches(rows, _ask, ASKED_DDL, parts=parts)
    answers = checkpoint(asked.groupBy("part", "kind").applyInArrow(_answer, BLOCK_DDL))
    sizes = [_opened(r.body, "<u8") for r in answers.where("block = ''").select("body").collect()]  # one row per range
    estimate, tuning, own_kinds, kinds = (sum(float(s[k]) for s in sizes) for k in range(4))
    to_blocks = answers.where("block != ''")
    held = map_batches(rows, _texts, BLOCK_DDL, tuning_only=True).unionByName(to_blocks)
    tuned = held.groupBy("block").applyInArrow(_bound(_tune, total=estimate, kinds=own_kinds), "cell long, n long")
    table = tuned.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # BUCKETS * STEPS * STEPS rows at most
    weights = mixture(np.array([r.cell for r in table], dtype=np.int64), np.array([float(r.n) for r in table]))
    whole = map_batches(rows, _texts, BLOCK_DDL, tuning_only=False).unionByName(to_blocks)
    return whole.groupBy("block").applyInArrow(_bound(_score, weights=weights.tolist(), total=estimate + tuning, kinds=kinds), OUT_DDL)


def _bound(work, **fixed):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        return work(key, group, **fixed)

    return run
