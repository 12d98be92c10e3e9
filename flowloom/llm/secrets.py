"""Secret scans with column functions only, judged by how many owners share a value.

Base finds, leftmost and non-overlapping per kind: assignments to secret names, access key ids, long hexadecimal runs. A match's
place follows from the pieces that ``split`` leaves between matches. The method adds bare finds: long runs of mixed letters and
digits outside all base finds.

Every find's value is hashed. Over the whole corpus, hashes are counted by distinct owner and distinct repository. A value that
``EXAMPLE_OWNERS`` owners or more show is a widely copied example; a rarer one is specific to its owners, and live if it looks random
(Shannon entropy of its characters). Base finds are always reported with their class; a bare find is reported only if it is live.

Shuffled are hashes, owners and counts, never texts: finds are few and small beside the texts they come from. (hash, owner) pairs are
reduced in tasks before the shuffle, so a value that a third of all rows share is counted from one row per task and owner.

Defined cases: a null text is empty; rows without finds have zero counts and empty spans; a null owner or repository is one of its own named
''; rows that repeat an id are reported one by one, with equal classes for equal values; offsets are code points; further columns are ignored,
but ``redacted`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import fresh, text_of
from flowloom.session import checkpoint

# The patterns of base finds. Kinds are numbered in this order.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BARE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "bare")
LEAST_ASSIGNED = 12
#: From so many distinct owners on, a value counts as a copied example.
EXAMPLE_OWNERS = 8
#: Bits a character from which a value looks random; hexadecimal digits reach 4 at most.
LIVE_BITS = 2.8
#: Finds of a text are folded in blocks of so many, a text is cut in pages of so many code points: time grows with the text.
BLOCK, PAGE = 128, 1024
#: Behind every text.
NOWHERE = 2**31 - 1

larger = lambda a, b: F.greatest(a, b)
smaller = lambda a, b: F.least(a, b)

FIND = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, first: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of a few values what was folded before it. Every step copies the array made so far."""
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda done, v: F.struct(
        combine(done["at"], v).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))
    return F.aggregate(values, start, step, lambda done: done["out"])


def _folded(values: Column, zero: int, combine: Callable[[Column, Column], Column]) -> Column:
    """For each value what was folded before it: blocks are folded, then the values of each block from what its block starts with."""
    last = lambda all_: F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / BLOCK).cast("int")
    cut = lambda all_: F.transform(F.sequence(F.lit(0), last(all_)), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))
    whole = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), combine))
    return _let(values, lambda all_: _let(cut(all_), lambda blocks: F.flatten(F.zip_with(
        blocks, _before(whole(blocks), F.lit(zero), combine), lambda b, first: _before(b, first, combine)))))


def _placed(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their places: structs of start, kind, end, value (of an assignment: of its right side)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pair = lambda w, v: F.struct(F.length(w).alias("size"), v.alias("value"))
    sized = F.zip_with(whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), pair) if kind == 0 else F.transform(
        whole, lambda w: pair(w, w))
    row = lambda g, m: F.struct(F.length(g).alias("gap"), m["size"].alias("size"), m["value"].alias("value"))
    zipped = F.filter(F.zip_with(F.split(text, pattern, -1), sized, row), lambda m: m["size"].isNotNull())

    def find(m: Column, before: Column) -> Column:
        begin = before + m["gap"]
        return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + m["size"]).alias("end"), m["value"].alias("value"))

    found = _let(zipped, lambda rows: F.zip_with(
        rows, _folded(F.transform(rows, lambda m: m["gap"] + m["size"]), 0, lambda a, b: a + b), find))
    if kind == 0:
        found = F.filter(found, lambda f: F.length(f["value"]) >= LEAST_ASSIGNED)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(FIND))


def _apart(sorted_finds: Column) -> Column:
    """Finds in order of (start, kind) without the bare ones that touch a base find.

    Such a base find either starts no later and ends behind the bare find's start, or is the next one and starts before its end.
    """
    bare = lambda f: f["kind"] == len(KINDS) - 1
    ends = lambda all_: F.transform(all_, lambda f: F.when(bare(f), 0).otherwise(f["end"]))
    starts = lambda all_: F.transform(F.reverse(all_), lambda f: F.when(bare(f), NOWHERE).otherwise(f["start"]))
    around = lambda all_: F.zip_with(_folded(ends(all_), 0, larger), F.reverse(_folded(starts(all_), NOWHERE, smaller)),
                                     lambda end, start: F.struct(end.alias("end"), start.alias("start")))
    free = lambda f, near: F.when(~bare(f) | ((near["end"] <= f["start"]) & (near["start"] >= f["end"])), f)
    return _let(sorted_finds, lambda all_: F.filter(F.zip_with(all_, around(all_), free), lambda f: f.isNotNull()))


def _bits(value: Column) -> Column:
    """Shannon entropy of a value's characters."""
    letters = F.split(value, "")
    n = F.length(value).cast("double")
    shares = F.transform(F.filter(F.array_distinct(letters), lambda c: c != ""), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda total, share: total - share * F.log2(share))


def _mixed(value: Column) -> Column:
    """Letters of both cases and digits: how a random token differs from a long word, a path or a number."""
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & (_bits(value) >= 3.5)


def finds(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, text_hash, owner, repository and all finds in order of (start, kind); bare ones only where they touch no base find."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                       F.concat_ws("/", *repository).alias("repository"), text_of().alias("text"))
    placed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "owner", "repository", F.concat(
        _placed(F.col("text"), ASSIGN, 0), _placed(F.col("text"), ACCESS, 1), _placed(F.col("text"), HEX, 2)).alias("base"),
        _placed(F.col("text"), BARE, 3).alias("long"))
    free = lambda all_: F.filter(all_, lambda f: (f["kind"] < len(KINDS) - 1) | _mixed(f["value"]))
    both = F.when(F.size("long") == 0, F.array_sort("base")).otherwise(free(_apart(F.array_sort(F.concat("base", "long")))))
    return placed.select("doc_id", "text_hash", "owner", "repository", both.alias("finds"))


def classes(found: DataFrame) -> DataFrame:
    """Per value hash: owners and repositories that show it. Pairs are made distinct before anything is counted."""
    pairs = found.select("owner", "repository", F.explode("finds").alias("f")).select(
        F.xxhash64("f.value").alias("hash"), "owner", "repository").distinct()
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("r"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))


def judged(found: DataFrame) -> DataFrame:
    """One row per find: row, doc_id, text_hash, start, kind, end, owners, repositories, class. ``found`` is a stored table."""
    single = found.where(F.size("finds") > 0).select("row", "doc_id", "text_hash", F.explode("finds").alias("f")).select(
        "row", "doc_id", "text_hash", "f.start", "f.kind", "f.end", F.xxhash64("f.value").alias("hash"),
        (_bits(F.col("f.value")) >= LIVE_BITS).alias("random"))
    known = single.join(classes(found.where(F.size("finds") > 0)), "hash")
    kind = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(F.col("random"), "live").otherwise("weak")
    return known.withColumn("class", kind).where("kind < 3 or class = 'live'").drop("random", "hash")


def stored_finds(docs: DataFrame) -> DataFrame:
    """Finds of every row with a number of the row: a small table beside the texts, read more than once."""
    return checkpoint(finds(docs).withColumn("row", F.monotonically_increasing_id()))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_bare, n_live, n_example, max_owners."""
    found = stored_finds(docs)
    of_row = judged(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "class", "owners"))).alias("s"))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,class:string,owners:bigint>>")
    all_rows = found.select("row", "doc_id").join(of_row, "row", "left").select("doc_id", F.coalesce("s", nothing).alias("s"))
    number = lambda test: F.size(F.filter("s", test)).cast("long")
    base = F.filter("s", lambda f: f["kind"] < 3)
    return all_rows.select(
        "doc_id", number(lambda f: f["kind"] == 0).alias("n_assign"), number(lambda f: f["kind"] == 1).alias("n_access"),
        number(lambda f: f["kind"] == 2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"),
        number(lambda f: f["kind"] == 3).alias("n_bare"), number(lambda f: f["class"] == "live").alias("n_live"),
        number(lambda f: f["class"] == "example").alias("n_example"), F.coalesce(F.array_max("s.owners"), F.lit(0)).alias("max_owners"))


def _between(pages: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text in pages of ``PAGE``: reads the pages it lies in, not the text before them."""
    first, last = F.floor(a / PAGE).cast("int"), F.floor(b / PAGE).cast("int")
    page = lambda k: F.coalesce(F.get(pages, k), F.lit(""))
    inside = F.substring(page(first), a % PAGE + 1, b - a)
    over = F.concat(F.substring(page(first), a % PAGE + 1, F.lit(PAGE)), F.array_join(F.slice(pages, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                    F.substring(page(last), F.lit(1), b % PAGE))
    return F.when(first == last, inside).otherwise(over)


def _cut_out(text: Column, spans: Column, mask: str) -> Column:
    """The text with every run of overlapping spans replaced."""
    paged = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))

    def pieces(pages: Column, cuts: Column) -> Column:
        before = _folded(F.transform(cuts, lambda s: s["end"]), 0, larger)
        own = F.zip_with(cuts, before, lambda s, done: F.when(s["start"] >= done, F.concat(_between(pages, done, s["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(own, ""), _between(pages, F.array_max(F.transform(cuts, lambda s: s["end"])), F.length(text)))

    return _let(paged, lambda pages: _let(F.array_sort(spans), lambda cuts: pieces(pages, cuts)))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``, live finds masked in the text and n_chars counted anew; copied examples stay."""
    id_, hash_, spans, changed = fresh(docs, "_id", "_hash", "_spans", "_changed")
    live = judged(stored_finds(docs)).where("class = 'live'").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "end")).alias(spans))
    # The stored table's size is known, so Spark sends it to all tasks while it is small and shuffles else.
    cuts = checkpoint(live).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), spans)
    text = F.col("text")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_of()) == F.col(hash_))
    joined = docs.join(cuts, same, "left").withColumn(changed, F.col(spans).isNotNull())
    out = joined.withColumn("text", F.when(F.col(changed), _cut_out(text, F.col(spans), mask)).otherwise(text))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(changed), size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
