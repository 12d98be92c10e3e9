"""Benchmark decontamination: word triples with gaps find passages, Smith-Waterman alignment scores them.

Match 2, mismatch and gap -1, divided by the score of the whole item: copies score 1, edited or paraphrased ones less, chance
overlaps far less. A document is contaminated where some passage of it reaches THRESHOLD; no frequency decides what is looked for.

Seeds leave no such passage out. An alignment of m matched words and e errors scores 2m - e. Of its m - 2 runs of three matched
words, those with more than GAPS = 2 errors inside are 2e / 3 at most, since an error lies in two runs at most. So an item of n words
that scores n or more shares about n / 3 - 2 triples or more (``needed``), each with at most two words between on either side, inside 2n
words of the document. Stretches that hold so many are aligned, all others cannot reach the threshold.

The index of seeds goes to all tasks in slices of ``SLICE_GRAMS`` words at most. A larger benchmark is worked off slice by
slice, each against all documents, so what a task holds is bounded whatever the number of items. Documents are read once a slice and never
shuffled.

Defined cases: null and empty texts and items without words match nothing; an item of fewer than WHOLE_ITEM words must be found whole, one of
fewer than SHORT_ITEM up to one edited word (its score less 3); of several items that match equally well the smallest item_id is told; repeated
rows give repeated results (with more than one slice, one result per id); an empty benchmark leaves every document clean; rows of items without an id are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import batch_of, map_batches, text_of
from flowloom.session import checkpoint

#: Errors inside a seed of three words; more would be lossless as well, fewer not.
GAPS = 2
#: Words of test items that one pass over the documents looks for (about 150 bytes each in a task).
SLICE_GRAMS = 400_000
#: Items of fewer words are found only as exact runs of words.
WHOLE_ITEM = 5
#: Items of fewer words are found with one edited word at most.
SHORT_ITEM = 8
#: Share of the item's own score from which a document counts as contaminated.
THRESHOLD = 0.5
#: Words of documents, and seeds found in them, that a task looks at in one go (a longer document by itself).
CHUNK_WORDS, CHUNK_HITS = 65_536, 2_000_000

#: Words between the first and second, and between the second and third word of a seed.
_SHAPES = [(g, h) for g in range(GAPS + 1) for h in range(GAPS + 1 - g)]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
_WORD = re.compile(r"\w+")
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()),
                   ("n_items", pa.int64())])
FOUND_DDL = "doc_id long, item_id long, score double, first_word long, n_items long"


def plain_words(text: str | None) -> list[str]:
    """Words of letters and digits in lower case; punctuation never decides a match."""
    return _WORD.findall(text.lower()) if text else []


def slices_of(items: list[tuple[int, str]]) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with words, in slices of at most SLICE_GRAMS words (or one item)."""
    part, size = [], 0
    for item_id, text in items:
        words = plain_words(text)
        if not words or item_id is None:
            continue
        if part and size + len(words) > SLICE_GRAMS:
            yield part
            part, size = [], 0
        part.append((item_id, words))
        size += len(words)
    if part:
        yield part


def least_score(n: int) -> int:
    """Score of an alignment from which an item of n words counts as found."""
    return 2 * n if n < WHOLE_ITEM else 2 * n - 3 if n < SHORT_ITEM else int(np.ceil(2 * n * THRESHOLD))


def needed(n: int) -> int:
    """Seeds that every alignment of an item of n words with its least score shares at least, starting at different words of the item."""
    least = least_score(n)
    return max(1, min(m - 2 - 2 * (2 * m - least) // (GAPS + 1) for m in range((least + 1) // 2, n + 1)))


def _triples(coded: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the seeds of one shape without word 0."""
    second, third = 1 + shape[0], 2 + sum(shape)
    if len(coded) <= third:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    a, b, c = coded[: len(coded) - third], coded[second : len(coded) - third + second], coded[third:]
    at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
    return at, (a[at] << 42) + (b[at] << 21) + c[at]


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - _FILTER_BITS)


class SeedIndex:
    """Seeds of items with their places. Words outside all items become 0 and are in no seed."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items
        self.words: dict[str, int] = {}
        self.coded = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], dtype=np.int64) for _, words in items]
        sizes = np.array([len(c) for c in self.coded], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.owner = np.repeat(np.arange(len(items)), sizes)
        self.least = [least_score(n) for n in sizes.tolist()]
        self.need = np.array([needed(n) if n >= WHOLE_ITEM else 0 for n in sizes.tolist()], dtype=np.int64)
        self.span = 2 * sizes
        self.runs: dict[tuple[int, ...], list[int]] = defaultdict(list)
        keys, places = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for k, coded in enumerate(self.coded):
            if len(coded) < WHOLE_ITEM:
                self.runs[tuple(coded.tolist())].append(k)
                continue
            for shape in _SHAPES:
                at, key = _triples(coded, shape)
                keys.append(key)
                places.append(at + self.base[k])
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        self.keys, self.places = key[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[_slot(self.keys)] = True

    def code(self, text: str | None) -> np.ndarray:
        words = plain_words(text)
        get = self.words.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))

    def hits(self, coded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in the document, place in the items) of seeds, CHUNK_HITS or few more at a time."""
        for shape in _SHAPES:
            at, key = _triples(coded, shape)
            maybe = self.filter[_slot(key)]
            at, key = at[maybe], key[maybe]
            first, last = (np.searchsorted(self.keys, key, side) for side in ("left", "right"))
            some = last > first
            at, first, many = at[some], first[some], (last - first)[some]
            ends = np.cumsum(many)
            begin = 0
            while begin < len(at):
                until = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK_HITS, "right")))
                n = many[begin:until]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(at[begin:until], n), self.places[np.repeat(first[begin:until], n) + step]
                begin = until

    def whole(self, coded: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place) of the items of fewer than WHOLE_ITEM words."""
        for n in sorted({len(r) for r in self.runs}):
            for at in np.flatnonzero(coded[: max(0, len(coded) - n + 1)] > 0).tolist():
                for k in self.runs.get(tuple(coded[at : at + n].tolist()), ()):
                    yield k, at

    def stretches(self, coded: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, end) where an item may reach its least score; stretches of 4n words that overlap by half."""
        apart = np.zeros(GAPS + 2, dtype=np.int64)  # no seed reaches from one document into the next
        row = np.concatenate([x for c in coded for x in (c, apart)] or [apart])
        start = np.cumsum([0] + [len(c) + len(apart) for c in coded])
        wide = np.int64(start[-1] + 1)
        seen = np.empty(0, dtype=np.int64)
        for at, place in self.hits(row):
            begin = start[np.searchsorted(start, at, "right") - 1]
            span = self.span[self.owner[place]]
            block = (at - begin) // span
            new = np.concatenate([place * wide + begin + block, (place * wide + begin + block - 1)[block > 0]])
            seen = np.union1d(seen, new)
        place, where = seen // wide, seen % wide
        pair, many = np.unique(self.owner[place] * wide + where, return_counts=True)
        pair = pair[many >= self.need[pair // wide]]
        item, where = pair // wide, pair % wide
        doc = np.searchsorted(start, where, "right") - 1
        block = where - start[doc]
        # Overlapping stretches of one item in one document are aligned as one.
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (block[1:] > block[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pair))[: len(first)] - 1
        for f, l in zip(first.tolist(), last.tolist(), strict=True):
            k = int(item[f])
            yield int(doc[f]), k, int(block[f] * self.span[k]), int((block[l] + 2) * self.span[k])


def aligned(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment of two word sequences, and the place after its last word in the window."""
    columns = np.arange(len(window) + 1)
    best, end, row = 0, 0, np.zeros(len(window) + 1, dtype=np.int64)
    for word in item:
        step = np.zeros_like(row)
        step[1:] = row[:-1] + np.where(window == word, 2, -1)
        step = np.maximum(np.maximum(step, row - 1), 0)
        # A gap along the window costs 1 a word: the best start before, in one running maximum.
        row = np.maximum(np.maximum.accumulate(step + columns) - columns, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def align(item: np.ndarray, window: np.ndarray) -> float:
    """Best local alignment of two word sequences, over the score of the whole item."""
    return aligned(item, window)[0] / (2 * len(item))


def _found(seeds: SeedIndex, coded: list[np.ndarray]) -> list[list[tuple[float, int, int]]]:
    best: list[dict[int, tuple[float, int]]] = [{} for _ in coded]
    for d, k, first, end in seeds.stretches(coded):
        item, window = seeds.coded[k], coded[d][first:end]
        score, last = aligned(item, window)
        if score >= seeds.least[k] and score / (2 * len(item)) > best[d].get(k, (0.0, 0))[0]:
            # Aligned backwards from its end, the passage ends where it begins.
            best[d][k] = (score / (2 * len(item)), first + last - aligned(item[::-1], window[:last][::-1])[1])
    for d, c in enumerate(coded):
        for k, at in seeds.whole(c):
            best[d].setdefault(k, (1.0, at))
    return [sorted((-s, seeds.items[k][0], first) for k, (s, first) in b.items()) for b in best]


def matches(seeds: SeedIndex, texts: list[str | None]) -> Iterator[list[tuple[float, int, int]]]:
    """For each text the items found in it: (minus score, item_id, first word of the passage), the best first."""
    part, size = [], 0
    for text in texts:
        coded = seeds.code(text)
        if part and size + len(coded) > CHUNK_WORDS:
            yield from _found(seeds, part)
            part, size = [], 0
        part.append(coded)
        size += len(coded)
    yield from _found(seeds, part)


def _search(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    seeds = index.value
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in FOUND}
        ids, texts = (c.to_pylist() for c in batch.columns)
        for doc_id, good in zip(ids, matches(seeds, texts), strict=True):
            score, item_id, first = good[0] if good else (0.0, None, None)
            for name, value in zip(out, (doc_id, item_id, abs(score), first, len(good)), strict=True):
                out[name].append(value)
        yield batch_of(out, FOUND)


def _keep_clean(batches: Iterator[pa.RecordBatch], index, text_at: int) -> Iterator[pa.RecordBatch]:
    seeds = index.value
    for batch in batches:
        yield batch.filter(pa.array([not m for m in matches(seeds, batch.column(text_at).to_pylist())], type=pa.bool_()))


def seed_passes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """For each slice of the items the broadcast index of its seeds."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    # Items reach the driver one after another; a slice of them is what one pass looks for.
    for part in slices_of((r.item_id, r.text) for r in items.orderBy("item_id", "text").toLocalIterator()):
        yield spark.sparkContext.broadcast(SeedIndex(part))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, item_id, score, first_word of the passage, n_items found, contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    results = [map_batches(rows, _search, FOUND_DDL, index=seeds) for seeds in seed_passes(docs, benchmark)]
    if not results:
        empty = {"item_id": "long", "score": "double", "first_word": "long"}
        return rows.select("doc_id", *[F.lit(0.0 if c == "score" else None).cast(t).alias(c) for c, t in empty.items()],
                           F.lit(0).cast("long").alias("n_items"), F.lit(False).alias("contaminated"))
    found = results[0]
    if len(results) > 1:  # rows with equal id: the best item of all slices, the sum of items
        united = checkpoint(reduce(DataFrame.unionByName, results))
        top = F.max(F.struct("score", (-F.col("item_id")).alias("_item"), "first_word"))
        found = united.groupBy("doc_id").agg(top.alias("_top"), F.sum("n_items").alias("n_items")).select(
            "doc_id", (-F.col("_top._item")).alias("item_id"), F.col("_top.score").alias("score"),
            F.col("_top.first_word").alias("first_word"), "n_items")
    return found.select("*", (F.col("n_items") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their own columns; nothing is shuffled."""
    kept = docs
    for seeds in seed_passes(docs, benchmark):
        kept = map_batches(kept, _keep_clean, docs.schema, index=seeds, text_at=docs.columns.index("text"))
    return kept
