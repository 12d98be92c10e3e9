"""Chat formatting of logged conversations, of which many are snapshots of longer ones.

A log writes a conversation again after every turn, so most logged conversations are beginnings of others. Each turn has a 128-bit
hash of its number, role and text; the exclusive or of all turns so far is the hash of the prefix that ends there. It is
associative, so a very long conversation is cut into chunks that are hashed apart and joined by one carried hash per chunk. A conversation
whose whole hash is a proper prefix of another is dropped by an anti-join; of equal conversations the smallest id stays.
What is left is rendered in segments of ``SEGMENT`` turn numbers, so no row holds an unbounded conversation.

Defined cases: rows that are equal in conv_id, turn, role and text count once; several rows at one turn are ordered by role and text; a null
turn comes before all others; null roles and texts are empty; rows without conv_id belong to no conversation and are left out; turn
numbers are part of a prefix; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import checkpoint

#: Turn numbers that are hashed and rendered together.
SEGMENT = 256


def turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, segment, and the turn's hash in two halves."""
    rows = conversations.where("conv_id is not null").select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumns({
        "h1": F.xxhash64("turn", "role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "role", "turn"),
        "segment": F.floor(F.col("turn") / SEGMENT).cast("long")})
    return hashed.dropDuplicates(["conv_id", "segment", "turn", "h1", "h2"])


def _xor(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))


def prefixes(rows: DataFrame) -> DataFrame:
    """Per turn, in the order in which it is rendered (rows of one turn by role, then text): conv_id, n (turns so far), p1, p2 (hash so far) and size (turns in all)."""
    chunks = rows.groupBy("conv_id", "segment").agg(F.expr("bit_xor(h1)").alias("c1"), F.expr("bit_xor(h2)").alias("c2"),
                                                   F.count("*").alias("c"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        "conv_id", "segment", F.expr("bit_xor(c1)").over(earlier).alias("c1"), F.expr("bit_xor(c2)").over(earlier).alias("c2"),
        F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"), F.sum("c").over(whole).alias("size"))
    inside = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("conv_id", "segment", F.expr("bit_xor(h1)").over(inside).alias("l1"),
                        F.expr("bit_xor(h2)").over(inside).alias("l2"), F.count("*").over(inside).alias("l"))
    return local.join(carried, ["conv_id", "segment"]).select(
        "conv_id", (F.col("c") + F.col("l")).alias("n"), _xor(F.col("l1"), F.col("c1")).alias("p1"),
        _xor(F.col("l2"), F.col("c2")).alias("p2"), "size")


def maximal(rows: DataFrame) -> DataFrame:
    """Ids of conversations that are no proper prefix of another, one of each group of equals, with how many of these there are."""
    marks = prefixes(rows.select("conv_id", "segment", "turn", "role", "text", "h1", "h2"))
    key = ["n", "p1", "p2"]
    inner = marks.where("n < size").select(*key).distinct()
    whole = marks.where("n = size").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return whole.join(inner, key, "left_anti").select("conv_id", "copies")


def chat_rows(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, segment, turns, copies, text.

    A turn is rendered as its role between ``<|`` and ``|>``, a line end, its text and ``<|end|>`` with a line end.
    """
    rows = checkpoint(turns(conversations))
    kept = rows.select("conv_id", "segment", "turn", "role", "text").join(maximal(rows), "conv_id")
    one = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    packed = kept.select("conv_id", "segment", "copies", F.struct("turn", "role", "text", one.alias("line")).alias("t"))
    grouped = packed.groupBy("conv_id", "segment").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", "segment", F.size("ts").cast("long").alias("turns"), "copies",
                          F.array_join(F.col("ts.line"), "").alias("text"))
