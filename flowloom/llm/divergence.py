"""How the sources of a language differ from each other and from the whole, by exact term shares, with text joined late.

Terms are counted as digests of 63 bits: a task counts the terms of its documents, and only (language, source, digest, counts) are shuffled.
Digests in few documents of their language go. For the digests that stay, the texts are read once more: every task names the terms
behind them, and per digest the smallest and the largest term that occur are kept. Where these differ, several terms share the digest;
their documents are counted again by the terms themselves, and the digest is split. What is kept of the text is one term for each
kept digest; shares, distances and ranks are computed on digests, and terms are joined to the rows that come out (and to those that tie
with the last one).

Shares are integers: p = 1 + floor(10^9 * (count + 5) / (N + 5 V)) with N the group's count of kept terms and V the number of them. A
distance between two sources sums |p - q| over all kept terms. A source has the same share for all terms that it lacks, so only terms that
occur are looked at; the rest follows from V.

Defined cases: null text, language and source count as ''; a group without terms, or a language without kept ones (V = 0), still
gives its pairs (distance 0 where V = 0); a language with one source has no pairs; repeated rows count as documents of their
own; equal values rank by the term or source in the order of its UTF-8 bytes; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import batch_of, map_batches, text_of
from flowloom.session import checkpoint

#: A term stays if it stands in so many documents of its language.
LEAST_DOCUMENTS = 30
#: Added to every count, and the scale of a share.
PRIOR, SCALE = 5, 1_000_000_000
#: Digests have so many bits, so that they are never negative.
DIGEST_BITS = 63
#: Terms listed for a source.
TOP_TERMS = 50
#: Distinct (language, source, digest) or terms that a task holds before it sends them on.
HELD = 600_000
#: Kept digests up to this number are sent to all tasks (8 bytes each); more are joined through a shuffle.
BROADCAST_DIGESTS = 1_000_000
#: Sources that one task compares with as many others, and stored shares of a group of such comparisons on average.
BLOCK = 128
SHARES_PER_GROUP = 200_000

_KEEP = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)).lower()
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("count", pa.int64()), ("documents", pa.int64())])
COUNTS_DDL = "lang string, source string, digest long, count long, documents long"
SPLIT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64())])
SPLIT_DDL = "lang string, source string, term string, count long"
TERMS = pa.schema([("lang", pa.string()), ("digest", pa.int64()), ("term", pa.string())])
TERMS_DDL = "lang string, digest long, term string"


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, with A-Z in lower case, in UTF-8."""
    return text.encode().translate(_KEEP).split()


def digests_of(terms: Iterable[bytes], n: int, bits: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, n) >> np.uint64(64 - bits)).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))


def _count(batches: Iterator[pa.RecordBatch], bits: int, held: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents by (language, source, digest), sent on whenever ``held`` terms have come together."""
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in sums.items():
            n = len(counts)
            columns = (digests_of(counts, n, bits), np.fromiter(counts.values(), np.int64, n), np.fromiter(map(documents.__getitem__, counts), np.int64, n))
            for at in range(0, n, 65_536):
                digest, count, many = (x[at : at + 65_536] for x in columns)
                yield batch_of({"lang": pa.repeat(lang, len(digest)), "source": pa.repeat(source, len(digest)), "digest": digest,
                                "count": count, "documents": many}, COUNTS)
        sums.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, documents = sums.setdefault((lang, source), (Counter(), Counter()))
            terms = terms_of(text)
            counts.update(terms)
            documents.update(set(terms))
        if sum(len(counts) for counts, _ in sums.values()) > held:
            yield from flush()
    yield from flush()


def _name(batches: Iterator[pa.RecordBatch], bits: int, held: int, kept: object = None) -> Iterator[pa.RecordBatch]:
    """(language, digest, term) of every term whose digest is kept (of all terms without ``kept``), once a task where memory allows."""
    seen: dict[str, set[bytes]] = {}
    for batch in batches:
        fresh: dict[str, set[bytes]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fresh.setdefault(lang, set()).update(terms_of(text))
        for lang, terms in fresh.items():
            before = seen.setdefault(lang, set())
            new = list(terms - before)
            if sum(map(len, seen.values())) + len(new) > held:
                seen = {lang: (before := set())}
            before.update(new)
            found = digests_of(new, len(new), bits)
            if kept is not None:
                own = kept.value.get(lang)
                hit = np.flatnonzero(own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found) if own is not None else found[:0]
                found, new = found[hit], [new[i] for i in hit.tolist()]
            if len(found):
                yield batch_of({"lang": pa.repeat(lang, len(new)), "digest": found, "term": [t.decode() for t in new]}, TERMS)


def _recount(batches: Iterator[pa.RecordBatch], bits: int, shared: object) -> Iterator[pa.RecordBatch]:
    """Counts by the term itself, of terms that share their digest with others; one row a document and term."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in SPLIT}
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = Counter(terms_of(text))
            own = shared.value.get(lang, frozenset())
            for (term, n), digest in zip(counts.items(), digests_of(counts, len(counts), bits).tolist(), strict=True):
                if digest in own:
                    for name, value in zip(out, (lang, source, term.decode(), n), strict=True):
                        out[name].append(value)
        yield batch_of(out, SPLIT)


def _by_language(digests: DataFrame) -> dict[str, np.ndarray]:
    rows = digests.toArrow().to_pandas()
    return {lang: np.sort(own.to_numpy(np.int64)) for lang, own in rows.groupby("lang")["digest"]}


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, bits: int = DIGEST_BITS) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, key, count, all) of the terms that stay, ``all`` over the language, and their names (lang, key, term).

    Both are stored tables. ``key`` is the digest; terms that share one have negative keys, counted down in their language.
    """
    rows, spark = _rows(docs), docs.sparkSession
    c = F.col
    tables = map_batches(rows, _count, COUNTS_DDL, bits=bits, held=HELD)
    # Dealt by (language, digest) once: sums of a source and of its language need no further shuffle.
    sums = tables.repartition("lang", "digest").groupBy("lang", "digest", "source").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    whole = Window.partitionBy("lang", "digest")
    stay = sums.withColumns({"all": F.sum("count").over(whole), "documents": F.sum("documents").over(whole)}).where(c("documents") >= least)
    counts = checkpoint(stay.select("lang", "source", c("digest").alias("key"), "count", "all"))
    digests = checkpoint(counts.select("lang", c("key").alias("digest")).distinct())
    read = rows.select("lang", "text")
    if digests.count() <= BROADCAST_DIGESTS:
        named = map_batches(read, _name, TERMS_DDL, bits=bits, held=HELD, kept=spark.sparkContext.broadcast(_by_language(digests)))
    else:
        named = map_batches(read, _name, TERMS_DDL, bits=bits, held=HELD).join(digests, ["lang", "digest"], "left_semi")
    ends = checkpoint(named.groupBy("lang", "digest").agg(F.min("term").alias("term"), F.max("term").alias("last")))
    several = ends.where(c("term") != c("last")).select("lang", "digest")
    names = ends.where(c("term") == c("last")).select("lang", c("digest").alias("key"), "term")
    # 10^9 kept terms of a language share a digest about once in twenty corpora: what comes to the driver here is a handful.
    shared = {lang: frozenset(own.tolist()) for lang, own in _by_language(several).items()}
    if not shared:
        return counts, names
    again = map_batches(rows, _recount, SPLIT_DDL, bits=bits, shared=spark.sparkContext.broadcast(shared))
    again = again.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.count("*").alias("documents"))
    whole = Window.partitionBy("lang", "term")
    again = checkpoint(again.withColumns({"all": F.sum("count").over(whole), "documents": F.sum("documents").over(whole)}).where(c("documents") >= least))
    number = -F.row_number().over(Window.partitionBy("lang").orderBy("term")).cast("long")
    split = checkpoint(again.select("lang", "term").distinct().select("lang", "term", number.alias("key")))
    alone = counts.join(several.withColumnRenamed("digest", "key"), ["lang", "key"], "left_anti")
    counts = alone.unionByName(again.join(split, ["lang", "term"]).select("lang", "source", "key", "count", "all"))
    return checkpoint(counts), checkpoint(names.unionByName(split.select("lang", "key", "term")))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """Exact at any size: products of counts pass 64 bits."""
    wide = "decimal(38,0)"
    up = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(24,0)") + F.lit(PRIOR).cast("decimal(3,0)"))
    down = total.cast("decimal(24,0)") + F.lit(PRIOR).cast("decimal(3,0)") * terms.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", up.cast(wide), down.cast(wide)).cast("long")


def _meet(key: tuple, rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """Sums of |p - q| less what absence alone gives, over the terms of one group, for all sources of one block against those of another.

    Rows marked ``bare`` give a source's share of a term that it lacks; each source of both blocks has one.
    """
    lang, left, right, _ = key
    bare = rows["bare"].to_numpy(bool)
    order = np.argsort(rows["place"].to_numpy()[bare])
    places, absent = (rows[n].to_numpy(np.int64)[bare][order] for n in ("place", "p"))
    a, b = np.flatnonzero(places // block == left), np.flatnonzero(places // block == right)
    terms, codes = np.unique(rows["key"].to_numpy(np.int64)[~bare], return_inverse=True)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    column, shares = (rows[n].to_numpy(np.int64)[~bare][order] for n in ("place", "p"))
    column = np.searchsorted(places, column)
    sums = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, len(terms), 4096):  # so many terms in memory, with all sources of both blocks
        part = slice(*np.searchsorted(codes, [at, at + 4096]))
        p = np.repeat(absent[None, :], min(4096, len(terms) - at), axis=0)
        p[codes[part] - at, column[part]] = shares[part]
        for i, k in enumerate(a):
            sums[i] += np.abs(p[:, k : k + 1] - p[:, b]).sum(axis=0) - len(p) * np.abs(absent[k] - absent[b])
    i, j = np.meshgrid(places[a], places[b], indexing="ij")
    return pd.DataFrame({"lang": lang, "place": i.ravel(), "other": j.ravel(), "apart": sums.ravel()})


def distances(groups: DataFrame, shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, other source, value) for all ordered pairs of sources of a language.

    ``groups``: lang, source, place (0, 1, ... in its language), terms (V), absent; ``shares``: lang, place, key, p of terms that occur.
    Sources are cut into blocks; each pair of blocks meets once for every group of terms, so no task sees a whole language.
    """
    c = F.col
    blocks = groups.groupBy("lang").agg((F.floor(F.max("place") / block) + 1).alias("blocks"))
    parts = max(1, -(-shares.count() // SHARES_PER_GROUP))
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    rows = shares.select("lang", "place", "key", "p", F.lit(False).alias("bare"), F.array(F.pmod(F.xxhash64("key"), F.lit(parts))).alias("part"))
    bare = groups.select("lang", "place", F.lit(0).cast("long").alias("key"), c("absent").alias("p"), F.lit(True).alias("bare"), every.alias("part"))
    own = F.floor(c("place") / block)
    meetings = F.transform(F.sequence(F.lit(0).cast("long"), c("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("left"), F.greatest(own, o).alias("right")))
    dealt = rows.unionByName(bare).join(blocks, "lang").withColumn("_part", F.explode("part")).withColumn("_meeting", F.explode(meetings))
    dealt = dealt.select("lang", c("_meeting.left").alias("left"), c("_meeting.right").alias("right"), c("_part").alias("part"), "place", "key", "p", "bare")
    sums = dealt.groupBy("lang", "left", "right", "part").applyInPandas(lambda key, rows: _meet(key, rows, block), "lang string, place long, other long, apart long")
    # Blocks meet once: a pair is in the order of its blocks, and both ways within a block.
    low, high = F.least("place", "other"), F.greatest("place", "other")
    same = F.floor(c("place") / block) == F.floor(c("other") / block)
    sums = sums.where(~same | (c("place") < c("other"))).groupBy("lang", low.alias("low"), high.alias("high")).agg(F.sum("apart").alias("apart"))
    a = groups.select("lang", "source", c("place").alias("a"), "terms", c("absent").alias("p"))
    b = groups.select(c("lang").alias("_lang"), c("source").alias("item"), c("place").alias("b"), c("absent").alias("q"))
    pairs = a.join(b, (c("lang") == c("_lang")) & (c("a") != c("b"))).withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    value = c("terms") * F.abs(c("p") - c("q")) + F.coalesce(c("apart"), F.lit(0))
    found = pairs.join(sums, ["lang", "low", "high"], "left")
    return found.select("lang", "source", "item", F.when(c("terms") > 0, value).otherwise(0).cast("long").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    c = F.col
    counts, names = kept_terms(docs, least)
    terms = names.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    zero = F.lit(0).cast("long")
    groups = _rows(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    language = Window.partitionBy("lang")
    groups = checkpoint(groups.select(
        "*", F.sum("total").over(language).alias("whole"), (F.row_number().over(language.orderBy("source")) - 1).cast("long").alias("place"),
        F.when(c("terms") > 0, _share(zero, c("total"), c("terms"))).otherwise(0).alias("absent")))
    shares = checkpoint(counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "place", "key", _share(c("count"), c("total"), c("terms")).alias("p"), _share(c("all"), c("whole"), c("terms")).alias("q")))

    pairs = distances(groups, shares.select("lang", "place", "key", "p"))
    best = Window.partitionBy("lang", "source").orderBy(c("value").desc())
    over = shares.where(c("p") > c("q")).select("lang", "source", "key", (c("p") - c("q")).alias("value"))
    over = over.withColumn("at", F.rank().over(best)).where(c("at") <= top).drop("at")  # all that tie with the last one, too
    over = over.join(names, ["lang", "key"]).select("lang", "source", c("term").alias("item"), "value")

    ordered = Window.partitionBy("lang", "source").orderBy(c("value").desc(), c("item").asc())

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(ordered).cast("int").alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(c("rank") <= top))
