"""Faults of conversations and their cheapest repair, streamed in the order of turns.

Conversations are dealt by id, so that each lies in one partition, and sorted there (Spark's sort spills). ``mapInPandas`` then reads a
partition twice, and what it carries from one Arrow batch to the next is a few numbers:

* backwards, the cheapest cost from here to the end for each of the four states that a repaired conversation can be in; each row gets
  the best edit for each state, two bits for a state, as a column of its own. These one-byte backpointers lie in the sorted
  rows and spill with them, however long a conversation is;
* forwards, the state, the counts and the running hash of the repaired text; a conversation's row comes out when it ends.

Repaired roles read ``(system? (user assistant)+)?``. Keeping a row costs 0, another role (user or assistant) 2, deleting 3, a new
empty row 2, and a truncated row that stays 1 more. Blank rows and duplicates have to go. Of the cheapest edits those win whose initials (Keep,
Rerole, Delete, Insert) are least as a string: in one state each initial can occur only once, so the least one among the cheapest is
taken, row by row. One conversation is one stream, as its repaired text has one hash.

Defined cases: a null role, text, id or turn reads as one space where text is asked for; rows without an id are one conversation;
null turns come first; rows of one turn come in the order of role, then text (UTF-8 bytes); repeated rows are rows of their own, and all but the first
are duplicates; a conversation that lost all rows has zeros, an empty audit and the hash of nothing; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import TEXT_BATCH_ROWS

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Edits by initial, in their order as text; the numbers are what backpointers hold.
EDITS = "DIKR"
#: States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row. The role that may be made in each, and where each initial leads.
MADE = ("user", "user", "assistant", "user")
MADE_STATE = (2, 2, 3, 2)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Cost after the last row: a conversation may end in states 0 and 3; in 2 an assistant is missing, in 1 a user as well.
END = (0, 2 * INSERT, INSERT, 0)

FAULTS_DDL = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with damage by crc32('conv_id:turn') % 20: dropped (0), emptied (1), without end marks (2), twice (3), by the user (4).

    Returns conv ('' for none, else '=' and the id), turn, role, text, gone (a dropped row, kept so that its conversation is known).
    """
    c = F.col

    def told(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(told(c("conv_id")), F.lit(":"), told(c("turn"))).cast("binary")) % 20
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), c("conv_id").cast("string")), F.lit("")).alias("conv"), c("turn").cast("long").alias("turn"),
        told(c("role")).alias("role"), told(c("text")).alias("text"), fate.alias("fate"))
    text = F.when(c("fate") <= 1, "").when(c("fate") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))
    times = F.array_repeat(F.lit(True), F.when(c("fate") == 3, 2).otherwise(1))
    return rows.select("conv", "turn", F.when(c("fate") == 4, "user").otherwise(c("role")).alias("role"), text.alias("text"),
                       (c("fate") == 0).alias("gone"), F.explode(times).alias("_")).drop("_")


@lru_cache(maxsize=100_000)
def step(after: tuple[int, int, int, int], initial: str, fault: str) -> tuple[tuple[int, int, int, int], int]:
    """Costs before a row from those after it (less the smallest one), and its backpointer: the edit's number for each state."""
    stays = TRUNCATED if fault == "truncated" else 0
    options: list[dict[str, int]] = []
    for state in range(4):
        found = {"D": DELETE + after[state]}
        if fault not in ("blank", "duplicate"):
            found["R"] = REROLE + stays + after[MADE_STATE[state]]
            if initial in NEXT[state]:
                found["K"] = KEEP + stays + after[NEXT[state][initial]]
        options.append(found)
    least = [min(found.values()) for found in options]
    for state in (2, 3, 0, 1):  # a made row leads to 2 or 3, and two of them in turn back to where one was
        options[state]["I"] = INSERT + least[MADE_STATE[state]]
    costs = [min(found.values()) for found in options]
    for state in (0, 1):  # these may make a row that leads to a made row
        options[state]["I"] = INSERT + costs[2]
        costs[state] = min(options[state].values())
    pointer = 0
    for state in range(4):
        best = min(e for e, cost in options[state].items() if cost == costs[state])
        pointer |= EDITS.index(best) << 2 * state
    return tuple(cost - min(costs) for cost in costs), pointer


def _point(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in descending order, each with its backpointer."""
    conv, costs = None, END
    for frame in frames:
        pointers = []
        for own, gone, initial, fault in zip(frame["conv"], frame["gone"], frame["initial"], frame["fault"], strict=True):
            if own != conv:
                conv, costs = own, END
            pointer = 0
            if not gone:
                costs, pointer = step(costs, initial, fault)
            pointers.append(pointer)
        yield frame.assign(pointer=pd.Series(pointers, dtype="int16", index=frame.index))


class _Repair:
    """One conversation on its way: counts, the state so far, and the hash of what is repaired."""

    def __init__(self, conv: str):
        self.conv = conv
        self.low = self.high = None
        self.turns = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.state = 0
        self.before: str | None = None
        self.audit = bytearray()
        self.hash = hashlib.sha256()

    def line(self, role: str, text: str, state: int) -> None:
        self.hash.update(f"{chr(10) if self.state else ''}{role}:{text}".encode())
        self.state = state

    def insert(self) -> None:
        self.audit += b"I"
        self.cost += INSERT
        self.line(MADE[self.state], "", MADE_STATE[self.state])

    def row(self, turn: int | None, role: str, text: str, initial: str, fault: str, pointer: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault:
            self.faults[fault] += 1
        while (edit := EDITS[pointer >> 2 * self.state & 3]) == "I":
            self.insert()
        self.audit += edit.encode()
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED * (fault == "truncated")
        if edit == "R":
            self.cost += REROLE
            self.line(MADE[self.state], text, MADE_STATE[self.state])
        else:
            self.line(role, text, NEXT[self.state][initial])

    def end(self) -> tuple:
        while END[self.state]:
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


def _repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in ascending order with their backpointers -> one row a conversation."""
    names = [part.split()[0] for part in FAULTS_DDL.split(", ")]
    now: _Repair | None = None
    for frame in frames:
        done = []
        columns = (frame[n] for n in ("conv", "gone", "no_turn", "turn", "role", "text", "initial", "fault", "pointer"))
        for conv, gone, no_turn, turn, *rest in zip(*columns, strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.end())
                now = _Repair(conv)
            if not gone:
                now.row(None if no_turn else int(turn), *rest)
        yield pd.DataFrame(done, columns=names)
    if now is not None:
        yield pd.DataFrame([now.end()], columns=names)


def repair_damaged(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``damaged`` rows (conv, turn, role, text, gone)."""
    c = F.col
    bare = F.rtrim(c("text"), F.lit(SPACE))
    dealt = rows.withColumns({
        "digest": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), c("role"), c("text")).cast("binary"), 256)),
        "no_turn": c("turn").isNull(), "turn": F.coalesce(c("turn"), F.lit(0).cast("long")), "initial": F.substring("role", 1, 1),
    }).repartition("conv")
    order = [c("no_turn").desc(), c("turn").asc(), c("role").asc(), c("text").asc()]
    # By conversation and digest: the rows are already dealt by conversation, so this is a sort and no shuffle.
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "digest").orderBy(*order[:2]))
    fault = (F.when(bare == "", "blank").when(c("again") > 1, "duplicate")
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))
    told = dealt.withColumn("again", seen).withColumn("fault", fault).drop("digest")
    back = told.sortWithinPartitions("conv", c("no_turn").asc(), c("turn").desc(), c("role").desc(), c("text").desc(), c("again").desc())
    pointed = _mapped(back, _point, f"{_ddl(back)}, pointer short").sortWithinPartitions("conv", *order, c("again").asc())
    return _mapped(pointed, _repair, FAULTS_DDL)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _mapped(df: DataFrame, work, ddl: str) -> DataFrame:
    """``mapInPandas`` with bounded batches of texts."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if int(spark.conf.get(key, "10000")) > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    return df.mapInPandas(work, ddl)


def repairs(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation, after the damage."""
    found = repair_damaged(damaged(turns))
    kind = turns.schema["conv_id"].dataType
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, (1 << 31) - 1).cast(kind)).alias("conv_id")
    return found.select(conv_id, *found.columns[1:])
