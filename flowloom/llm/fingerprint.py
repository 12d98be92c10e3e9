"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into blocks whose borders depend only on a few symbols around them: runs of one symbol become one
symbol, deterministic coin tossing (the lowest bit in which a symbol differs from the one before, three times over) turns symbols
into small labels that differ from their neighbours, and a block starts at every local maximum of the labels. A block's name is a hash
of its symbols; the names are the next level's symbols. Equal substrings get equal names in their interior, wherever they start, so texts that
share passages share names. A fingerprint holds the ``SKETCH`` smallest scrambled names of the levels from ``LEVEL`` up (blocks of about a
dozen characters and more); the share of common values among the smallest of the union estimates the Jaccard likeness of the name sets.

A task parses many texts at once: they lie in one array and every text's start and end is a border at every level.

Defined cases: null counts as the empty text, whose fingerprint is the empty string; two empty texts have likeness 1, an empty and another one 0;
a text too short for the levels is named as a whole; rows are taken in order of (doc_id, text), nulls first, so rows that repeat an id
follow each other; the last row's successor is the first; a single row is its own successor; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import batch_of, map_batches, mix, rows_of, text_of

LEVEL, LEVELS, SKETCH = 2, 12, 64
#: Bytes parsed together in a task.
GROUP_BYTES = 600_000
#: Documents of one range of ids on average, and the most ranges (a range is streamed, so it may be larger).
ROWS_PER_RANGE, MOST_RANGES = 4_000, 20_000

_POWER = mix(np.arange(1, 1 << 8, dtype=np.uint64)) | np.uint64(1)


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit position that differs from the symbol before, plus that bit. A text's first symbol tosses against 0."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = 0
    differ = symbols ^ before
    lowest = differ & (~differ + np.uint64(1))
    place = np.bitwise_count(lowest - np.uint64(1)).astype(np.uint64)
    return place * np.uint64(2) + ((symbols & lowest) != 0)


def _level(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and where each text starts among them. Every text has a symbol at least."""
    change = np.empty(len(symbols), dtype=bool)
    change[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=change[1:])
    change[starts] = True
    at = np.flatnonzero(change)
    runs = np.diff(at, append=len(symbols))
    long = runs > 1
    symbols = symbols[at]
    symbols[long] = mix(symbols[long] + runs[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    starts = np.searchsorted(at, starts)
    labels = symbols
    for _ in range(3):
        labels = _toss(labels, starts)
    # A border at each local maximum inside its text.
    border = np.zeros(len(labels), dtype=bool)
    if len(labels) > 2:
        border[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    border[starts[1:] - 1] = False  # what follows in the array is another text
    border[starts] = True
    at = np.flatnonzero(border)
    size = np.diff(at, append=len(symbols))
    inside = np.arange(len(symbols)) - np.repeat(at, size)
    names = mix(np.add.reduceat(symbols * _POWER[inside % len(_POWER)], at) + size.astype(np.uint64))
    return names, np.searchsorted(at, starts)


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its smallest scrambled names (uint32, sorted, distinct); empty for the empty text."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(texts)
    some = [k for k, t in enumerate(texts) if t]
    if not some:
        return out
    sizes = np.array([len(texts[k]) for k in some])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols = mix(np.frombuffer(b"".join(texts[k] for k in some), dtype=np.uint8).astype(np.uint64) + np.uint64(1))
    live = np.arange(len(some))
    found_of, found = [], []
    for level in range(1, LEVELS + 1):
        symbols, starts = _level(symbols, starts)
        counts = np.diff(starts, append=len(symbols))
        last = counts == 1
        owner = np.repeat(live, counts)
        if level >= LEVEL:
            taken = np.ones(len(symbols), dtype=bool)
        else:
            taken = np.repeat(last, counts)  # a short text: what names it as a whole
        found_of.append(owner[taken])
        found.append(symbols[taken])
        if level == LEVELS or last.all():
            break
        symbols, live, counts = symbols[np.repeat(~last, counts)], live[~last], counts[~last]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # All names by text, then by value, without repeats; the first SKETCH of each text.
    owner, value = np.concatenate(found_of), (mix(np.concatenate(found)) >> np.uint64(32)).astype(np.uint64)
    both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | value)
    owner, value = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
    first = np.searchsorted(owner, np.arange(len(some) + 1))
    for k, at in enumerate(some):
        out[at] = value[first[k] : min(first[k + 1], first[k] + SKETCH)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values among the SKETCH smallest of both."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    union = np.union1d(a, b)[:SKETCH]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(common, union[-1], side="right")) / len(union)


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first ones of the following text (as many, or all it has)."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter] if quarter else text


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                 ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _group(pairs: list[tuple]) -> pa.RecordBatch:
    """Results of consecutive rows (doc_id, text, following text)."""
    texts = [t.encode() for _, t, _ in pairs]
    changed = [edited(t, f).encode() for _, t, f in pairs]
    prints = sketches([*texts, *changed, pairs[-1][2].encode()])
    n = len(pairs)
    own, other, following = prints[:n], prints[n : 2 * n], [*prints[1:n], prints[-1]]
    return batch_of({
        "doc_id": [p[0] for p in pairs], "n_chars": [len(p[1]) for p in pairs],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": [as_text(x) for x in own], "edited_fingerprint": [as_text(x) for x in other],
        "near_edited": [likeness(a, b) for a, b in zip(own, other, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(own, following, strict=True)],
    }, OUT)


def _consecutive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, doc_id, text, ahead) in order; ahead marks the copy of the next range's first row."""
    waiting: tuple | None = None
    pairs, size = [], 0
    for part, doc_id, text, ahead in rows_of(batches):
        if waiting is not None and waiting[0] == part:
            pairs.append((waiting[1], waiting[2], text))
            size += len(waiting[2])
            if size >= GROUP_BYTES // 3:
                yield _group(pairs)
                pairs, size = [], 0
        elif pairs:  # another range begins
            yield _group(pairs)
            pairs, size = [], 0
        waiting = None if ahead else (part, doc_id, text)
    if pairs:
        yield _group(pairs)


def _range_of(bounds: list[int]):
    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), dtype=np.int32)  # rows without an id come first
        out[known] = np.searchsorted(bounds, ids[known].astype("int64"), side="right")
        return pd.Series(out)

    return place


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ids are cut into ranges; a task streams a range in order and sees one row of the next one, so texts are shuffled once and no
    task holds a range in memory. The driver holds one bound and one first id per range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).first()
    ranges = max(1, min(MOST_RANGES, -(-size.n // ROWS_PER_RANGE)))
    cuts = rows.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    bounds = sorted({int(c) for c in cuts if c > size.low})
    dealt = rows.withColumn("part", _range_of(bounds)("doc_id"))
    firsts = {r.part: None if r.nulls else r.doc_id for r in dealt.groupBy("part").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()}
    parts = sorted(firsts) or [0]
    heads = spark.createDataFrame([(p, firsts.get(p), parts[k - 1]) for k, p in enumerate(parts)],
                                  "part int, _head long, _before int")  # MOST_RANGES rows at most
    of_head = dealt.join(F.broadcast(heads), "part").where(F.col("doc_id").eqNullSafe(F.col("_head")))
    ahead = of_head.groupBy("_before").agg(F.min(F.struct("doc_id", "text")).alias("_row")).select(
        F.col("_before").alias("part"), "_row.doc_id", "_row.text", F.lit(True).alias("ahead"))
    both = dealt.select("part", "doc_id", "text", F.lit(False).alias("ahead")).unionByName(ahead)
    ordered = both.repartition("part").sortWithinPartitions("part", "ahead", "doc_id", "text")
    return map_batches(ordered, _consecutive, OUT_DDL)
