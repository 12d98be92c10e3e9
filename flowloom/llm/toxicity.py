"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores from the context of each hit.

The lexicon holds stems. Some are given (``SEEDS``); the others are learned: words and word beginnings that hardly occur in clean
labelled texts, by information gain. A whole word ends with ``$``. All stems are one trie. A word that may be misspelled is the input of
a Levenshtein automaton, whose states (place in the word, edits so far) are carried along the branches of the trie; a branch dies with its
last state. So one walk compares the word with all stems. Words pass a cheap test before.

Every hit counts by its context: less inside quotation marks or beside words of report ("said", "called"), more next to an address
("you are"). Hits by stem and by kind (exact, misspelled), their sum and their density are the inputs of a logistic model.

Learning reads a bounded sample of labelled rows (``FIT_ROWS``, those with the smallest hashes of ids); everything else sees all rows.

Defined cases: null and empty texts have the score of a text without hits; a doc_id with several labels counts as toxic if one says so; null labels
and labels without a document are left out; without any toxic or any clean label the given stems and weights decide; repeated rows get equal
scores; rows without an id are scored (and count as those of fold ''); further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import batch_of, fit_logistic, fold, map_batches, rows_of, text_of

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Labelled rows that the lexicon and the weights are learned from, at most.
FIT_ROWS = 20_000
STEMS = 100
STEM_LENGTHS = range(4, 13)
#: Share of toxic texts among those with a learned stem, if both kinds were equally many, at least.
LEAST_PURITY = 0.95
#: Fewest toxic rows of the sample with a stem.
LEAST_TOXIC = 4
#: Information gain, in bits a row, that a learned stem brings at least.
LEAST_GAIN = 0.001
#: Words that a task remembers; past it the memory starts anew.
CACHE_WORDS = 400_000
WINDOW = 4

# Insults known beforehand, words of report, words of address.
SEEDS = ("idiot", "moron", "stupid", "trash", "scum", "loser", "clown", "worthless", "pathetic", "disgusting")
REPORT = frozenset("said says called calls wrote quoted word term quote".split())
ADDRESS = frozenset("you your youre are du bist tu es vous eres usted".split())
QUOTES = "\"“”„«»'‘’`"

_DROP = re.compile(r"[\W_]+")


class Node:
    """A place in the trie: nodes below by letter, the number of the stem that ends here, and what an edit here can lead to.

    ``skips``: by letter, nodes below (with their own letter) that have a node below for it; ``ends``: nodes below that end a stem.
    """

    __slots__ = ("below", "stem", "skips", "ends")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.stem: int | None = None
        self.skips: dict[str, list[tuple[str, Node]]] = {}
        self.ends: list[tuple[str, Node]] = []

    def finish(self) -> None:
        for own, node in self.below.items():
            node.finish()
            for letter in node.below:
                self.skips.setdefault(letter, []).append((own, node))
            if node.stem is not None:
                self.ends.append((own, node))


class Trie:
    def __init__(self, stems: list[str]):
        self.root, self.sizes = Node(), [len(stem) for stem in stems]
        for k, stem in enumerate(stems):
            node = self.root
            for letter in stem:
                node = node.below.setdefault(letter, Node())
            node.stem = k
        self.root.finish()
        # One edit leaves either the first two letters as they are or all from the fourth on, moved by one place at most.
        self.heads = {stem[:2] for stem in stems if len(stem) > 4}
        self.tails = {stem[3:6] for stem in stems if len(stem) > 5} | {stem[3:5] for stem in stems if len(stem) == 5}

    def may_match(self, word: str) -> bool:
        """A cheap test that no word fails which ``fuzzy`` finds something for."""
        tails = self.tails
        return (word[:2] in self.heads or word[3:6] in tails or word[2:5] in tails or word[4:7] in tails
                or word[3:5] in tails or word[2:4] in tails or word[4:6] in tails)

    def exact(self, word: str) -> int | None:
        """The longest stem that the word begins with."""
        node, found = self.root, None
        for letter in word:
            node = node.below.get(letter)
            if node is None:
                break
            if node.stem is not None:
                found = node.stem
        return found

    def fuzzy(self, word: str) -> int | None:
        """The stem of five letters or more that some beginning of the word is one edit away from at most (fewest, then longest).

        An edit is a letter too many, too few or wrong, or two neighbours in the wrong order. The states of the automaton that are alive
        are (place in the word, edits so far) at a node of the trie. One without an edit goes along the word; at each of its
        nodes those with one edit begin, of which each can only go on letter by letter and mostly ends at once.
        """
        found: list[tuple[int, int, int]] = []
        size, node, at = len(word), self.root, 0
        while node is not None:
            if node.stem is not None:
                found.append((0, -self.sizes[node.stem], node.stem))
            letter, after = word[at : at + 1], word[at + 1 : at + 2]
            alive = []
            if letter:
                alive.append((node, at + 1))
                alive += [(below, at) for _, below in node.skips.get(letter, ())]
            if after:
                alive += [(below, at + 1) for own, below in node.skips.get(after, ()) if own != letter]
                swapped = node.below.get(after)
                if swapped is not None and letter in swapped.below:
                    alive.append((swapped.below[letter], at + 2))
            for _, below in node.ends:
                alive.append((below, size))
            for state, k in alive:
                while state is not None:
                    if state.stem is not None:
                        found.append((1, -self.sizes[state.stem], state.stem))
                    state = state.below.get(word[k]) if k < size else None
                    k += 1
            node = node.below.get(letter) if letter else None
            at += 1
        return min((f for f in found if f[1] < -4), default=(0, 0, None))[2]


class Hits(dict):
    """Words as they stand in a text -> (stem, misspelled) or None."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, raw: str) -> tuple[int, bool] | None:
        word = _DROP.sub("", raw.lower())
        found = None
        if len(word) >= 3:
            word += "$"
            stem = self.trie.exact(word)
            if stem is not None:
                found = (stem, False)
            elif self.trie.may_match(word):
                stem = self.trie.fuzzy(word[:24])
                found = None if stem is None else (stem, True)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[raw] = found
        return found


def context_score(words: list[str], at: int) -> float:
    """How much a hit counts: 1, less in quotation or report, more in address."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    opened = any(w[0] in QUOTES for w in [*before, words[at]])
    closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES and len(w) > 1 for w in [words[at], *after])
    near = {_DROP.sub("", w.lower()) for w in [*before, *after]}
    score = 0.3 if opened and closed else 1.0
    if near & REPORT:
        score *= 0.6
    return score * 1.25 if near & ADDRESS else score


def features(text: str, hits: Hits, stems: int) -> np.ndarray:
    """Bias, weighted hits by stem (exact, then misspelled), for either kind whether there is one and all hits, density."""
    words = text.split()
    out = np.zeros(6 + 2 * stems)
    out[0] = 1.0
    total = [0.0, 0.0]
    for at, hit in enumerate(map(hits.__getitem__, words)):
        if hit is not None:
            weight = context_score(words, at)
            out[1 + hit[0] + stems * hit[1]] += weight
            total[hit[1]] += weight
    out[1 : 1 + 2 * stems] = np.log1p(out[1 : 1 + 2 * stems])
    out[-5:-1] = [min(1.0, total[0]), np.log1p(total[0]), min(1.0, total[1]), np.log1p(total[1])]
    out[-1] = min(10.0, 100.0 * total[0] / (len(words) + 20))
    return out


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold a word beginning, toxic ones and others, counted within the task."""
    schema = pa.schema([("stem", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    counts = {True: Counter(), False: Counter()}

    def taken() -> pa.RecordBatch:
        stems = list(counts[True] | counts[False])
        batch = batch_of({"stem": stems, "toxic": [counts[True][s] for s in stems], "clean": [counts[False][s] for s in stems]}, schema)
        counts[True].clear()
        counts[False].clear()
        return batch

    for text, toxic in rows_of(batches):
        words = {_DROP.sub("", w.lower()) + "$" for w in set(text.split())}
        counts[toxic == 1].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n})
        if len(counts[False]) + len(counts[True]) > 500_000:
            yield taken()
    yield taken()


def learned_stems(sample: DataFrame) -> list[str]:
    """SEEDS and word beginnings by information gain; none is the beginning of another one that was taken before it."""
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t, c = size.get(1, 0), size.get(0, 0)
    if not t or not c:
        return list(SEEDS)
    counted = map_batches(sample.select("text", "toxic"), _beginnings, "stem string, toxic long, clean long")
    summed = counted.groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(
        (F.col("a") >= LEAST_TOXIC) & (F.col("a") * c >= LEAST_PURITY * (F.col("a") * c + F.col("b") * t)))

    def entropy(a, b):
        """Bits of a rows against b, times their number."""
        part = lambda x: F.when(x > 0, -x * F.log2(x / (a + b))).otherwise(0.0)
        return part(a) + part(b)

    gain = entropy(F.lit(float(t)), F.lit(float(c))) - entropy(F.col("a"), F.col("b")) - entropy(t - F.col("a"), c - F.col("b"))
    best = summed.select("stem", (gain / (t + c)).alias("gain")).where(F.col("gain") >= LEAST_GAIN)
    stems = list(SEEDS)
    for r in best.orderBy(F.desc("gain"), F.desc(F.length("stem")), "stem").limit(40 * STEMS).collect():
        if len(stems) < STEMS and not any(r.stem.startswith(s) or s.startswith(r.stem) for s in stems):
            stems.append(r.stem)
    return stems


@lru_cache(maxsize=2)
def hits_of(stems: tuple[str, ...]) -> Hits:
    """One for a worker process: a word is looked up once for all tasks that run in it."""
    return Hits(Trie(list(stems)))


def _sample_features(batches: Iterator[pa.RecordBatch], stems: list[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])
    hits = hits_of(tuple(stems))
    for batch in batches:
        texts, toxic = (c.to_pylist() for c in batch.columns)
        yield batch_of({"toxic": toxic, "x": [features(t, hits, len(stems)).tolist() for t in texts]}, schema)


def prior_of(stems: list[str]) -> np.ndarray:
    """Weights without any label: known insults count, misspelled ones somewhat less."""
    prior = np.zeros(6 + 2 * len(stems))
    prior[0] = -2.0
    prior[1 : 1 + len(SEEDS)] = 2.0
    prior[1 + len(stems) : 1 + len(stems) + len(SEEDS)] = 1.5
    prior[-4] = 1.0
    return prior


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Stems and weights from labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(fold("_id", FOLDS) != HELD_OUT).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)  # 12 bytes a row: bounded, so it is broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text"))
    sample = rows.join(F.broadcast(chosen), "_id").select("text", "toxic")
    stems = learned_stems(sample)
    fitted = map_batches(sample, _sample_features, "toxic int, x array<double>", stems=stems).limit(2 * FIT_ROWS).collect()
    prior = prior_of(stems)
    y = np.array([r.toxic == 1 for r in fitted], dtype=float)
    if not len(y) or y.all() or not y.any():
        return stems, prior
    return stems, fit_logistic(np.array([r.x for r in fitted]), y, prior)


def _score(batches: Iterator[pa.RecordBatch], stems: list[str], weights: list[float], threshold: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    hits, w = hits_of(tuple(stems)), np.array(weights)
    for batch in batches:
        ids, held_out, texts = (c.to_pylist() for c in batch.columns)
        scores = [float(1 / (1 + np.exp(-np.clip(features(t, hits, len(stems)) @ w, -30, 30)))) for t in texts]
        yield batch_of({"doc_id": ids, "held_out": held_out, "score": scores, "predicted": [int(s >= threshold) for s in scores]}, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    stems, weights = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
                       text_of().alias("text"))
    return map_batches(rows, _score, "doc_id long, held_out boolean, score double, predicted int", stems=stems,
                       weights=weights.tolist(), threshold=threshold)
