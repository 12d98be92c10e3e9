"""Shortest-pack-first: the plan against packs filled one piece at a time, and whole results against the tokenizer."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloom.llm import shortpack
from flowloom.llm.common import table
from flowloom.llm.queries import tokenizer_path

PATH = "byte_bpe_50k.json"


def one_by_one(lengths: list[int], capacity: int) -> Counter:
    """The same rule with real packs: the longest piece next, the shortest pack takes it, each of equal ones in turn."""
    packs: list[list[int]] = []
    for length in sorted(lengths, reverse=True):
        fits = [p for p in packs if capacity - sum(p) >= length]
        if fits:
            min(fits, key=lambda p: (sum(p), p)).append(length)
        else:
            packs.append([length])
    return Counter(map(tuple, packs))


@pytest.mark.parametrize("seed", range(20))
def test_patterns_equal_packs_filled_one_by_one(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, rng.integers(2, 33), 150).tolist()
    assert Counter(shortpack.place(Counter(lengths), 32)) == one_by_one(lengths, 32)


@pytest.mark.parametrize("seed", range(40))
def test_plan_uses_every_token_once_with_little_padding(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    lengths = np.minimum(rng.geometric(rng.uniform(0.02, 0.5), rng.integers(0, 300)), capacity).tolist()
    least = int(rng.integers(1, 5))
    histogram = Counter(lengths)
    covered = {(n, r): [] for n, many in histogram.items() for r in range(many)}
    packs = defaultdict(list)
    for length, rank, upto, begin, size, first, offset in shortpack.plan(dict(histogram), capacity, least):
        for k in range(upto - rank):
            covered[length, rank + k].append((begin, size))
            packs[first + k].append((offset, size))
    for (length, _), parts in covered.items():
        assert [b for b, _ in sorted(parts)] + [length] == [0] + list(np.cumsum([s for _, s in sorted(parts)]))
    padded = 0
    for parts in packs.values():
        parts.sort()
        ends = np.cumsum([s for _, s in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1]] and ends[-1] <= capacity
        room = 0 if ends[-1] & (ends[-1] - 1) == 0 else capacity - ends[-1]
        assert room < least
        padded += room
    assert len(packs) <= -(-(sum(lengths) + padded) // capacity) + 7


def test_a_large_histogram_is_planned_by_counts():
    histogram = {n: 10**12 // n for n in range(1, 1025)}
    steps = shortpack.plan(histogram)
    tokens = sum(n * many for n, many in histogram.items())
    assert sum((upto - rank) * size for _, rank, upto, _, size, _, _ in steps) == tokens
    assert len(steps) < 50_000


def expected(texts: dict) -> dict:
    tokenizer = Tokenizer.from_file(tokenizer_path(PATH))
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}


def check(got, texts):
    ids, packs, parts = expected(texts), defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length >= 1
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        parts[r.doc_id].append((r.start, r.length))
        packs[r.sequence_id].append((r.offset, r.length))
    assert parts.keys() == ids.keys()
    for i, own in parts.items():
        own.sort()
        assert [s for s, _ in own] + [len(ids[i])] == [0, *np.cumsum([n for _, n in own])]
    padding = 0
    for own in packs.values():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [o for o, _ in own] == [0, *ends[:-1]] and ends[-1] <= 1024
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 1024 - ends[-1]
    return padding / max(1, sum(map(len, ids.values())))


def test_documents_are_packed_whole_and_nearly_without_padding(spark, sf):
    docs = table(spark, sf, "documents")
    got = shortpack.pack_documents(docs, tokenizer_path(PATH)).collect()
    assert check(got, {r.doc_id: r.text for r in docs.collect()}) < 0.002


def test_packing_of_odd_rows(spark):
    made = {1: None, 2: "", 3: " \n", 4: "one two", 5: " ".join(f"w{k % 977}" for k in range(20_000)), 6: "x<|endoftext|>y", 7: "a" * 5000,
            8: "b " + " " * 4000 + "c", 9: "né 漢字 \U0001f600'll don't 1234"}
    frame = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    clash = {c: F.lit(1) for c in ("row", "ids", "start", "length", "rank", "range", "base", "_from", "offset", "cut")}
    got = shortpack.pack_documents(frame.withColumns(clash), tokenizer_path(PATH)).collect()
    assert check(got, made) == 0
    twice = spark.createDataFrame([(None, "same words"), (None, "same words"), (3, "same words")], "doc_id long, text string")
    got = shortpack.pack_documents(twice, tokenizer_path(PATH)).collect()
    assert sum(r.length for r in got if r.doc_id is None) == 2 * sum(r.length for r in got if r.doc_id == 3)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert shortpack.pack_documents(frame.limit(0), tokenizer_path(PATH)).count() == 0


def test_other_vocabularies_go_to_the_tokenizer():
    ids = shortpack.TokenIds(tokenizer_path("word_bpe_49k.json"))
    assert ids.ranks is None and ids("Ab, c") == np.array(ids.tokenizer.encode("Ab, c", add_special_tokens=False).ids, "<u4").tobytes()
    assert shortpack.TokenIds(tokenizer_path(PATH)).ranks is not None
