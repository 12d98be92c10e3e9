"""Near-duplicates by an inverted join over MinHash coordinates.

A document's set holds hashes of its five-word shingles (``SHINGLE``); ``COORDINATES`` minima of it under different hash functions are its
signature. Two sets of similarity 0.85 agree in 54 of 64 coordinates on average, in fewer than 40 in about two of a million pairs; two of
similarity 0.8 in 51, in fewer than 34 in less than one of a million. A ``Rule`` holds the similarity and these coordinates (``matches`` below).

1. Documents with equal sets become one class; the smallest id stands for it.
2. Every coordinate with its value is a posting key. Keys of one class only match nothing: a class with fewer than ``matches`` keys that others
   have, too, is out. Prefix: two classes that agree in ``matches`` keys share one of the rarest (keys - matches + 1) keys of each, so only these
   are posted, and passages that very many documents share are hardly posted at all. An exact test comes before: a class of which more
   than 100 - ``similar`` of 100 shingles occur in no other class that is left has no partner. It clears groups that are alike but not alike enough.
3. Skip merging. Posting lists with the same smallest class, the hub, are merged. First every class of a list is a candidate of its hub
   only. Classes that end up in one component skip each other from then on: only lists that hold several components are looked at again, in
   blocks whose meetings go to tasks, and a task gives the few links that join components.
4. A candidate agrees in ``matches`` coordinates; it becomes a link if 100 * intersection >= similar * union holds for the full sets, read anew from the
   texts. Sets meet in tasks; no table of candidate pairs is ever made but the hubs' own.

So no link between different components is lost (but by MinHash itself), while rows grow with the classes of a group, not with its pairs.
Hub groups are salted, so one hub with very many candidates is spread over tasks.

Defined cases: a document of fewer than five words has its whole sequence as its one shingle; null, empty and blank texts have the empty set and
link with nothing; rows that repeat an id are one document (they share a component, and any of their sets may link); rows without an
id have no component and are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import batch_of, fresh, map_batches, mix, text_of, words_of
from flowloom.llm.components import components, joined
from flowloom.session import checkpoint

SHINGLE, COORDINATES, OF = 5, 64, 100


class Rule(NamedTuple):
    """Texts are near-duplicates from ``similar`` of OF on; pairs that agree in fewer than ``matches`` coordinates are not looked at."""

    similar: int
    matches: int


#: The query's rule, and that of a stage which cleans a corpus.
QUERY_RULE, STAGE_RULE = Rule(85, 40), Rule(80, 34)
#: Classes of one list that meet as many others in a task.
BLOCK_ROWS = 128
#: Candidates of one hub in one task.
HUB_ROWS = 64
#: A table of so many ids is sent to all tasks; a larger one is joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000

_FACTORS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_A = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_B = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xAF251AF3B0F025B5))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(codes) < SHINGLE:
        return mix(np.array([(codes * _FACTORS[: len(codes)]).sum() + np.uint64(len(codes))], dtype=np.uint64))
    many = len(codes) - SHINGLE + 1
    total = codes[:many] * _FACTORS[0]
    for k in range(1, SHINGLE):
        total = total + codes[k : many + k] * _FACTORS[k]
    return np.unique(mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of every coordinate's hash function over the set, as int32."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(shingles), 2048):
        part = ((shingles[None, at : at + 2048] * _A[:, None] + _B[:, None]) >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, part.min(axis=1))
    return least.view(np.int32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.list_(pa.int32()))])
    for batch in batches:
        ids, texts = (c.to_pylist() for c in batch.columns)
        sets = [shingle_set(t) for t in texts]
        flat = np.concatenate([signature(s) for s in sets if len(s)] or [np.empty(0, dtype=np.int32)])
        ends = np.cumsum([0] + [COORDINATES * (len(s) > 0) for s in sets]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        ids, texts = (c.to_pylist() for c in batch.columns)
        yield batch_of({"doc_id": ids, "shingles": [shingle_set(t).tobytes() for t in texts]}, schema)


def similar(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    """The exact rule on two sets, both sorted and distinct."""
    if rule.similar * max(len(a), len(b)) > OF * min(len(a), len(b)) or not len(a):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OF * common >= rule.similar * (len(a) + len(b) - common)


def _confirm(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, shingles) in order, those of the hub itself (b null) first in each group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    here, hubs = None, []
    for batch in batches:
        out: dict[str, list] = {"a": [], "b": []}
        for a, salt, b, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(shingles, dtype=np.uint64)
            if (a, salt) != here:
                here, hubs = (a, salt), []
            if b is None:
                hubs.append(own)
            elif any(similar(hub, own, rule) for hub in hubs):
                out["a"].append(a)
                out["b"].append(b)
        yield batch_of(out, schema)


def only_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` (doc_id, ...) whose id is in the stored table ``ids`` (doc_id)."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def confirmed(rows: DataFrame, candidates: DataFrame, rule: Rule) -> DataFrame:
    """Links among the stored candidates (a, b), by full sets. ``a`` is the side with more candidates."""
    involved = checkpoint(candidates.select(F.col("a").alias("doc_id")).unionByName(candidates.select(F.col("b").alias("doc_id"))).distinct())
    sets = checkpoint(map_batches(only_ids(rows, involved), _sets, "doc_id long, shingles binary"))
    many = checkpoint(candidates.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).alias("salts")))
    salted = candidates.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    members = salted.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "shingles")
    hubs = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select(
        "a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    ordered = members.unionByName(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return checkpoint(map_batches(ordered, _confirm, "a long, b long", rule=rule).distinct())


def _able(keys: DataFrame, matches: int) -> DataFrame:
    """From (rep, key): classes with ``matches`` keys that others have, too: rep, those keys, and the rarest of them as prefix."""
    shared = checkpoint(keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    of_class = keys.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("df", "key"))).alias("s"))
    able = of_class.where(F.size("s") >= matches)
    return checkpoint(able.select("rep", F.col("s.key").alias("keys"), F.slice(F.col("s.key"), 1, F.size("s") - matches + 1).alias("prefix")))


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        ids, texts = (c.to_pylist() for c in batch.columns)
        for at in range(0, len(ids), 32):
            part = [shingle_set(t).view(np.int64) for t in texts[at : at + 32]]
            yield batch_of({"rep": ids[at : at + 32], "shingles": part}, schema)


def without_partner(rows: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """Stored ``reps`` (doc_id) that so many shingles of no other of them fill, that none can be similar enough: rep.

    A partner holds ``similar`` of 100 shingles at least. Ids with several texts are never named.
    """
    sets = map_batches(only_ids(rows, reps), _all_shingles, "rep long, shingles array<long>")
    places = sets.select("rep", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("rep").alias("rep"))
    own = places.where("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
    size = sets.groupBy("rep").agg(F.sum(F.size("shingles")).alias("size"), F.count("*").alias("texts"))
    return own.join(size, "rep").where((F.col("texts") == 1) & (OF * (F.col("size") - F.col("own")) < rule.similar * F.col("size"))).select("rep")


def postings(rows: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Classes that may have a partner: rep, keys (all that others have, too), prefix (its rarest ones, rarest first)."""
    keys = classes.select("rep", F.posexplode("signature").alias("k", "v")).select(
        "rep", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    able = _able(keys, rule.matches)
    alone = checkpoint(without_partner(rows, checkpoint(able.select(F.col("rep").alias("doc_id"))), rule))
    return _able(able.join(alone, "rep", "left_anti").select("rep", F.explode("keys").alias("key")), rule.matches)


def merged_lists(posted: DataFrame) -> DataFrame:
    """(hub, rep): posting lists of the same smallest class are one list, which names a class once."""
    lists = posted.select("rep", F.explode("prefix").alias("key"))
    hubs = checkpoint(lists.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    return checkpoint(lists.join(hubs, "key").select("hub", "rep").distinct())


def hub_candidates(posted: DataFrame, lists: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): every class of a list with the list's smallest class, where enough keys agree."""
    pairs = lists.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    with_b = pairs.join(posted.select(F.col("rep").alias("b"), F.col("keys").alias("kb")), "b")
    with_a = with_b.join(posted.select(F.col("rep").alias("a"), F.col("keys").alias("ka")), "a")
    return checkpoint(with_a.where(F.size(F.array_intersect("ka", "kb")) >= rule.matches).select("a", "b"))


def block_pairs(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, i, j, block, rep, comp): lists that still hold more than one component, cut into blocks; a row for every meeting of its block.

    A component with BLOCK_ROWS classes in a list has blocks of its own, which do not meet each other; the others share blocks.
    """
    named = labels.withColumnRenamed("node", "rep")
    known = lists.join(named, "rep", "left").select("hub", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = checkpoint(known.groupBy("hub", "comp").agg(F.count("*").alias("n")))
    mixed = sizes.groupBy("hub").agg(F.count("*").alias("comps")).where("comps > 1").select("hub")
    pool = F.when(F.col("n") >= BLOCK_ROWS, F.col("comp")).otherwise(F.lit(None).cast("long"))
    pooled = sizes.join(mixed, "hub", "left_semi").select("hub", pool.alias("pool"), "n").groupBy("hub", "pool").agg(
        F.ceil(F.sum("n") / BLOCK_ROWS).cast("long").alias("blocks"))
    earlier = Window.partitionBy("hub").orderBy("pool").rowsBetween(Window.unboundedPreceding, -1)
    placed = checkpoint(pooled.select("hub", F.col("pool").alias("_pool"), "blocks", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)).alias("base"),
                                      F.sum("blocks").over(Window.partitionBy("hub")).alias("all")))
    own = known.join(sizes, ["hub", "comp"]).withColumn("pool", pool)
    cut = own.join(placed, "hub").where(F.col("pool").eqNullSafe(F.col("_pool"))).withColumn(
        "block", F.col("base") + F.pmod(F.xxhash64("rep"), F.col("blocks")))
    away = lambda x: F.col("pool").isNull() | (x < F.col("base")) | (x >= F.col("base") + F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), away)
    met = cut.select("hub", "rep", "comp", "block", F.explode(others).alias("other"))
    return met.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets on the left with sets on the right, by products of 0/1 matrices over shared shingles."""
    values, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sides = np.repeat([0, 1], [sum(map(len, left)), sum(map(len, right))])
    both = (np.bincount(at[sides == 0], minlength=len(values)) > 0) & (np.bincount(at[sides == 1], minlength=len(values)) > 0)
    column = np.cumsum(both) - 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    kept = both[at]
    owner, column = owner[kept], column[at[kept]]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(both.sum()), 8192):  # bounds the matrices, whatever the sets' sizes
        begin, end = np.searchsorted(column, [first, first + 8192])
        grid = np.zeros((len(left) + len(right), 8192), dtype=np.float32)
        grid[owner[begin:end], column[begin:end] - first] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return np.rint(out).astype(np.int64)


def _merge(key: tuple, group: pa.Table, rule: Rule) -> pa.Table:
    """Links between different components in one meeting of two blocks: as many as join what they link, no more."""
    i, j = key[1].as_py(), key[2].as_py()
    reps, comps, blocks = (group[c].to_numpy() for c in ("rep", "comp", "block"))
    grid = np.full((len(reps), COORDINATES), -1, dtype=np.int64) - np.arange(len(reps))[:, None]  # what is not shared matches nothing
    for row, keys in enumerate(group["keys"].to_pylist()):
        own = np.array(keys, dtype=np.int64)
        grid[row, own >> 32] = own & 0xFFFFFFFF
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"].to_pylist()]
    size = np.array([len(x) for x in sets])
    left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        agree = np.zeros((len(left), len(right)), dtype=np.int16)
        for k in range(COORDINATES):
            agree += grid[left, k][:, None] == grid[right, k][None, :]
        able = (agree >= rule.matches) & (comps[left][:, None] != comps[right][None, :])
        a, b = size[left][:, None], size[right][None, :]
        able &= OF * np.minimum(a, b) >= rule.similar * np.maximum(a, b)
        if able.any():
            rows, columns = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
            able, left, right = able[np.ix_(rows, columns)], left[rows], right[columns]
            common = intersections([sets[x] for x in left], [sets[x] for x in right])
            linked = able & (OF * common >= rule.similar * (size[left][:, None] + size[right][None, :] - common))
            parent = {int(c): int(c) for c in comps}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for x, y in zip(*np.nonzero(linked), strict=True):
                one, two = root(int(comps[left[x]])), root(int(comps[right[y]]))
                if one != two:
                    parent[one] = two
                    found.append((int(reps[left[x]]), int(reps[right[y]])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def cross_links(rows: DataFrame, posted: DataFrame, lists: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between classes of one list in different components. ``labels``: stored (node, component)."""
    dealt = checkpoint(block_pairs(lists, labels))
    involved = checkpoint(dealt.select(F.col("rep").alias("doc_id")).distinct())
    sets = map_batches(only_ids(rows, involved), _sets, "doc_id long, shingles binary").withColumnRenamed("doc_id", "rep")
    load = checkpoint(sets.join(posted.select("rep", "keys"), "rep"))
    full = dealt.join(load, "rep").select("hub", "i", "j", "block", "rep", "comp", "keys", "shingles")
    merge = lambda key, group: _merge(key, group, rule)
    return checkpoint(full.groupBy("hub", "i", "j").applyInArrow(merge, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, rule: Rule = QUERY_RULE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept (whether that is its own)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sketch = checkpoint(map_batches(rows, _sketch, "doc_id long, n_shingles long, digest binary, signature array<int>"))
    known = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = checkpoint(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"),
                                                    F.first("signature").alias("signature")))
    named = rows.where("doc_id is not null")
    posted = postings(named, classes, rule)
    lists = merged_lists(posted)
    links = confirmed(named, hub_candidates(posted, lists, rule), rule)
    labels = checkpoint(components(links))
    more = cross_links(named, posted, lists, labels, rule)
    if not more.isEmpty():
        labels = checkpoint(joined(labels, more))
    copies = checkpoint(classes.where("copies > 1").select("digest", "rep"))
    found = sketch.select("doc_id", "n_shingles", "digest").join(copies, "digest", "left").select(
        "doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
        .otherwise(F.col("doc_id")).alias("node"))
    placed = found.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, rule: Rule = STAGE_RULE) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id, with all columns; of rows that repeat an id, one."""
    id_, number = fresh(docs, "_id", "_number")
    judged = checkpoint(near_duplicates(docs, rule))
    gone = checkpoint(judged.where("not kept").select(F.col("doc_id").alias(id_)).distinct())
    named = docs.withColumn(id_, F.col("doc_id").cast("long"))
    kept = named.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, id_, "left_anti")
    twice = checkpoint(judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("doc_id").alias(id_)))
    if not twice.isEmpty():
        one = Window.partitionBy(id_).orderBy(F.xxhash64("text"))
        single = kept.join(twice, id_, "left_semi").withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).drop(number)
        kept = kept.join(twice, id_, "left_anti").unionByName(single)
    return kept.select(*docs.columns)
