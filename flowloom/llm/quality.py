"""Quality classifier: overlapping heuristic labellers, weighed by expectation-maximisation, train a hashed linear scorer.

Labellers look at one side of a text each (marks, table bars, capitals, repeated words, repeated lines, word lengths, ends of
sentences, stop words) and vote good, bad or abstain. Nobody tells how far to trust them: from how they agree over the whole corpus,
expectation-maximisation estimates the accuracy of each labeller for good and for bad texts and the share of good texts. Texts
that get the same votes are one row with a count, so the model sees at most 3^L patterns, whatever the size of the corpus.

The posterior of its votes is a text's weak label. A linear model on hashed features (runs of kinds of letters, rates in steps) learns
these labels from a bounded sample (``FIT_ROWS`` texts with the smallest hashes of their contents) and then scores every text; it
generalises to texts on which the labellers abstain. Votes are counted over all rows; only the fit of weights is bounded.

Defined cases: null and empty texts and those of no word score 0 and are rejected; equal texts have equal scores; without any vote, or with
votes of one kind only, the prior of ``PRIOR_GOOD`` decides; repeated rows are kept or rejected together; further columns pass through ``accepted``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import batch_of, fit_logistic, map_batches, mix, text_of

#: Weak labels that the linear model is fitted to, at most.
FIT_ROWS = 6_000
DIMENSIONS = 512
PRIOR_GOOD = 0.85
#: A text is rejected below this score.
KEEP_FROM = 0.5
EM_STEPS = 100
LABELLERS = ("marks", "bars", "capitals", "repeats", "lines", "lengths", "sentences", "common")
#: Where the search for accuracies starts: chances of a bad and of a good vote on bad texts and on good ones.
START = np.array([[0.3, 0.7], [0.002, 0.998]])
#: A labeller's bad votes are assumed to fall on no larger share of good texts: each looks for one plain fault. Without this
#: bound, a fault of its own kind, which no other labeller sees, would be explained as a habit of good texts.
FALSE_ALARMS = 0.002
#: Votes that this start is worth against those counted.
START_WEIGHT = 5.0

# Frequent short words of the four languages.
STOP = frozenset("the of and to in is that it was for on are as with a an be by this le la les de des et un une est en que qui dans pour "
                 "el los las y es por con para una der die das und ist von zu mit den nicht auf im".split())

#: Kinds of bytes: lower case, upper case, digit, blank, line end, stop, comma, ! and ?, bar, marks, quotes, brackets, beyond ASCII, other.
_KIND = np.full(256, 13, dtype=np.int64)
for _kind, _letters in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\r", b"\n", b".", b",", b"!?", b"|",
                                  b"*#$%&@^~\\=+_", b"\"'`", b"()[]{}<>", bytes(range(128, 256)))):
    _KIND[list(_letters)] = _kind
_HASHED = (mix(np.arange(16**3, dtype=np.uint64)) % np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1


def rates(text: str) -> tuple[int, np.ndarray, dict[str, float]]:
    """Number of words, kinds of bytes in turn, and what the labellers look at."""
    words = text.split()
    n = max(1, len(words))
    kinds = _KIND[np.frombuffer(text.encode(), dtype=np.uint8)]
    counts = np.bincount(kinds, minlength=16)
    lines = [x for x in text.split("\n") if len(x) > 20]
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    again = max((int((codes[k:] == codes[:-k]).sum()) for k in range(1, 6) if len(words) > 2 * k), default=0)
    return len(words), kinds, {
        "marks": float(counts[9]) / n,
        "bars": words.count("|") / n,
        "capitals": float(counts[1]) / max(20, int(counts[0] + counts[1])),  # a short text's one capital is no shouting
        "repeats": again / n,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0,
        "lengths": (len(text) - n) / n,
        "sentences": float(counts[5]) / n,
        "common": sum(map(STOP.__contains__, words)) / n,
        "shouts": float(counts[7]) / n,
    }


def votes(seen: tuple[int, np.ndarray, dict[str, float]]) -> list[int]:
    """One vote per labeller: 1 good, -1 bad, 0 abstains."""
    n, _, r = seen
    if not n:
        return [-1] * len(LABELLERS)
    enough = n >= 12

    def vote(good: bool, bad: bool, sure: bool = True) -> int:
        return 0 if not sure else 1 if good else -1 if bad else 0

    return [
        vote(r["marks"] <= 0.05, r["marks"] >= 0.5),
        vote(r["bars"] == 0, r["bars"] >= 0.1),
        vote(r["capitals"] <= 0.15, r["capitals"] >= 0.5),
        vote(r["repeats"] <= 0.1, r["repeats"] >= 0.3, enough),
        vote(r["lines"] <= 0.2, r["lines"] >= 0.6, enough),
        vote(1.5 <= r["lengths"] <= 10, r["lengths"] < 0.8 or r["lengths"] > 20),
        vote(0.01 <= r["sentences"] <= 0.5, r["shouts"] > 0.5, enough),
        vote(r["common"] >= 0.08, r["common"] < 0.005, n >= 40),
    ]


def hashed(seen: tuple[int, np.ndarray, dict[str, float]]) -> np.ndarray:
    """Bias, hashed runs of three kinds of bytes (roots of their shares), hashed steps of the rates: over the whole text."""
    _, kinds, r = seen
    out = np.zeros(DIMENSIONS)
    if len(kinds) > 2:
        runs = np.bincount(_HASHED[kinds[:-2] * 256 + kinds[1:-1] * 16 + kinds[2:]], minlength=DIMENSIONS)
        out += np.sqrt(runs / (len(kinds) - 2))
    for name, value in r.items():
        step = int(np.clip(np.round(2 * np.log2(1 + 31 * max(0.0, min(value, 32.0)))), 0, 40))
        out[1 + xxhash.xxh32_intdigest(f"{name}:{step}") % (DIMENSIONS - 1)] += 1.0
    out[0] = 1.0
    return out


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("votes", pa.list_(pa.int32())), ("n", pa.int64())])
    counts: Counter = Counter()
    for batch in batches:
        counts.update(tuple(votes(rates(t))) for t in batch.column(0).to_pylist())
    yield batch_of({"votes": [list(v) for v in counts], "n": list(counts.values())}, schema)


def weak_labels(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of 'good' per pattern of votes, and each labeller's chances of a bad and a good vote given the class.

    Votes are taken as independent given the class; who abstains says nothing. Every step sharpens the chances and the share of good
    texts by the posteriors.
    """
    kinds = np.stack([patterns == k for k in (-1, 1)], axis=2).astype(float)  # pattern, labeller, vote
    table = np.repeat(START[:, None, :], patterns.shape[1], axis=1)  # class (bad, good), labeller, vote
    share, post = np.array([1 - PRIOR_GOOD, PRIOR_GOOD]), None
    for _ in range(EM_STEPS):
        logs = np.log(share)[:, None] + np.einsum("plv,clv->cp", kinds, np.log(table))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if post is not None and float(np.abs(new - post).max()) < 1e-9:
            break
        post = new
        weight = np.stack([(1 - post) * counts, post * counts])
        table = np.einsum("cp,plv->clv", weight, kinds) + START_WEIGHT * START[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        table[1, :, 0] = np.minimum(table[1, :, 0], FALSE_ALARMS)
        table[1, :, 1] = 1 - table[1, :, 0]
        share = (weight.sum(axis=1) + START_WEIGHT * np.array([1 - PRIOR_GOOD, PRIOR_GOOD])) / (counts.sum() + START_WEIGHT)
    return post, table


def _fit_inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("votes", pa.list_(pa.int32())), ("x", pa.binary())])
    for batch in batches:
        seen = [rates(t) for t in batch.column(0).to_pylist()]
        yield batch_of({"votes": [votes(x) for x in seen], "x": [hashed(x).astype("<f4").tobytes() for x in seen]}, schema)


def learn(docs: DataFrame) -> tuple[np.ndarray, dict[tuple[int, ...], float]]:
    """Weights of the scorer, and the posterior of every pattern of votes that occurs."""
    rows = docs.select(text_of().alias("text"))
    counted = map_batches(rows, _vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return np.zeros(DIMENSIONS), {}
    patterns = np.array([r.votes for r in counted])
    posterior, _ = weak_labels(patterns, np.array([float(r.n) for r in counted]))
    known = {tuple(p): float(q) for p, q in zip(patterns.tolist(), posterior, strict=True)}
    # A bounded sample: first the hashes, 8 bytes a row in each task's top list, then the texts below the bound.
    hashes = rows.select(F.xxhash64("text").alias("h"))
    bound = hashes.distinct().orderBy("h").limit(FIT_ROWS).agg(F.max("h").alias("h")).first().h
    sample = rows.where(F.xxhash64("text") <= bound).dropDuplicates(["text"]).limit(FIT_ROWS)
    fitted = map_batches(sample, _fit_inputs, "votes array<int>, x binary").collect()
    x = np.array([np.frombuffer(r.x, dtype="<f4") for r in fitted], dtype=float)
    y = np.array([known.get(tuple(r.votes), PRIOR_GOOD) for r in fitted])
    prior = np.zeros(DIMENSIONS)
    prior[0] = np.log(PRIOR_GOOD / (1 - PRIOR_GOOD))
    return fit_logistic(x, y, prior), known


def scored(seen: tuple, weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(hashed(seen) @ weights, -30, 30)))) if seen[0] else 0.0


def _score(batches: Iterator[pa.RecordBatch], weights: list[float], known: dict) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("weak_label", pa.float64()), ("score", pa.float64()), ("accepted", pa.bool_())])
    w = np.array(weights)
    for batch in batches:
        ids, texts = (c.to_pylist() for c in batch.columns)
        seen = [rates(t) for t in texts]
        scores = [scored(x, w) for x in seen]
        yield batch_of({"doc_id": ids, "weak_label": [known.get(tuple(votes(x)), PRIOR_GOOD) for x in seen], "score": scores,
                        "accepted": [s >= KEEP_FROM for s in scores]}, schema)


def quality(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, weak_label (posterior of its votes), score (0 to 1, higher is better), accepted."""
    weights, known = learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_batches(rows, _score, "doc_id long, weak_label double, score double, accepted boolean", weights=weights.tolist(), known=known)


def _keep(batches: Iterator[pa.RecordBatch], weights: list[float], text_at: int) -> Iterator[pa.RecordBatch]:
    w = np.array(weights)
    for batch in batches:
        yield batch.filter(pa.array([scored(rates(t or ""), w) >= KEEP_FROM for t in batch.column(text_at).to_pylist()], type=pa.bool_()))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns; nothing is shuffled."""
    weights, _ = learn(docs)
    return map_batches(docs, _keep, docs.schema, weights=weights.tolist(), text_at=docs.columns.index("text"))
