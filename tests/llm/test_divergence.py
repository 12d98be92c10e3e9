"""Divergence of sources against counting by hand, with shared digests, small blocks and either way of joining."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import divergence
from flowloom.llm.common import table

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows: list[tuple], least: int, top: int) -> list[tuple]:
    documents, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", x or "", s or "") for _, t, x, s in rows):
        terms = [m.translate(LOWER) for m in TERM.findall(text)]
        sources[lang].add(source)
        documents[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, own in sources.items():
        kept = {t for t, n in documents[lang].items() if n >= least}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in own}
        q = shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            over = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def made(n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    words = ["und", "Ähre", "äpfel", "x", "YZ", "yz", "漢字", "été"] + [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    weights = rng.dirichlet(np.full(len(words), 0.3), 12)
    rows = []
    for i in range(n):
        source = int(rng.integers(12))
        text = " ".join(rng.choice(words, rng.integers(0, 40), p=weights[source])) + rng.choice(["", ", 42!", "\u0000a"])
        rows.append((i, str(text), str(rng.choice(["de", "en"], p=[0.2, 0.8])), f"s{source}"))
    return rows


def got(frame, least, top):
    return sorted(tuple(r) for r in divergence.audit(frame, least, top).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_counting_by_hand(spark, sf):
    frame = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in frame.collect()]
    want = by_hand(rows, 10, 7)
    assert got(frame, 10, 7) == want and len(want) > 500
    rows = made(400, 1)
    assert got(spark.createDataFrame(rows, DOCS).repartition(5), 5, 4) == by_hand(rows, 5, 4)


@pytest.mark.parametrize("most", [0, 10**6])
def test_shared_digests_are_split(spark, monkeypatch, most):
    """Digests of four bits: nearly all are shared, and terms of too few documents hide among kept ones."""
    monkeypatch.setattr(divergence, "BROADCAST_DIGESTS", most)
    whole = divergence.kept_terms
    monkeypatch.setattr(divergence, "kept_terms", lambda docs, least: whole(docs, least, bits=4))
    rows = made(300, 2) + [(1000 + k, f"rare{chr(97 + k % 20)}", "en", "s1") for k in range(40)]
    assert got(spark.createDataFrame(rows, DOCS), 6, 5) == by_hand(rows, 6, 5)


def test_blocks_of_sources_meet_once(spark, monkeypatch):
    plain = divergence.distances
    monkeypatch.setattr(divergence, "SHARES_PER_GROUP", 40)
    monkeypatch.setattr(divergence, "distances", lambda groups, shares: plain(groups, shares, block=5))
    rows = made(300, 3)
    assert got(spark.createDataFrame(rows, DOCS), 5, 3) == by_hand(rows, 5, 3)


def test_small_holdings_change_nothing(spark, monkeypatch):
    plain = divergence.map_batches
    monkeypatch.setattr(divergence, "map_batches", lambda df, work, ddl, **fixed: plain(df, work, ddl, **fixed | ({"held": 3} if "held" in fixed else {})))
    rows = made(200, 4)
    assert got(spark.createDataFrame(rows, DOCS), 5, 3) == by_hand(rows, 5, 3)


def test_odd_rows(spark):
    long = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k % 7)}" for k in range(60_000))
    rows = [(None, None, None, None), (1, "", "en", None), (2, "a b a", "en", "s"), (2, "a b a", "en", "s"), (3, long, "en", "t"), (4, "12 !", "xx", "s"),
            (5, None, "xx", "t"), (6, "a", None, "only"), (7, "A", "en", "t")]
    clash = {c: F.lit(1) for c in ("digest", "key", "place", "p", "q", "term", "documents", "count", "all", "part", "_lang", "total")}
    frame = spark.createDataFrame(rows, DOCS).withColumns(clash)
    assert got(frame, 2, 3) == by_hand(rows, 2, 3)
    assert got(frame.limit(0), 2, 3) == []
    assert got(frame.where("lang = 'xx'"), 2, 3) == [("xx", "s", "pair", "t", 0, 1), ("xx", "t", "pair", "s", 0, 1)]
