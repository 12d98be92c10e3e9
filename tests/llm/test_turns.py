"""Repair of conversations against its SQL on odd rows, against all edits of short ones, and on one that spans many batches."""

import hashlib
import heapq

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.llm import turns
from flowloom.llm.queries import TURNS_SQL

CHAT = "conv_id long, turn long, role string, text string"
ROLES = ["user", "assistant", "system", "tool", "", "User", "unknown", None]
TEXTS = ["a.", "b", "b ", "Yes!\n", "", " \t\n", "x? \x0b", "no. more", "é", "\xa0", None]


def by_sql(rows):
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("given", conversations)
    con.execute("create view conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role::varchar as role, text::varchar as text from given")
    relation = con.execute(TURNS_SQL)
    names = [x[0] for x in relation.description]
    return sorted((tuple(r) for r in relation.fetchall()), key=repr), names


def by_spark(frame, names):
    return sorted((tuple(r) for r in turns.repairs(frame).select(*names).collect()), key=repr)


def test_repairs_equal_the_sql_on_random_rows_with_nulls_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = []
    for conv in [*range(400), None]:
        for _ in range(rng.integers(1, 12)):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 9))
            rows.append((conv, turn, ROLES[min(7, rng.geometric(0.35) - 1)], TEXTS[rng.integers(len(TEXTS))]))
    rows += rows[:200]
    want, names = by_sql(rows)
    clash = {c: F.lit(1) for c in ("conv", "fate", "gone", "digest", "again", "fault", "pointer", "initial", "no_turn", "copies")}
    assert by_spark(spark.createDataFrame(rows, CHAT).withColumns(clash).repartition(7), names) == want
    assert len({r[names.index("audit")] for r in want}) > 200


def test_a_giant_conversation_spans_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(1, t, ["user", "assistant", "system"][rng.integers(3)], f"t{rng.integers(900)}" + "." * int(rng.integers(2))) for t in range(1800)]
    rows += [(2, 0, "user", "hi.")]
    want, names = by_sql(rows)
    assert by_spark(spark.createDataFrame(rows, CHAT), names) == want


def cheapest(rows):
    """The least (cost, audit, text) over all edits, by the shortest path with whole strings."""
    queue, done = [(0, "", "", 0, 0)], set()
    ends = []
    while queue:
        cost, audit, said, i, state = heapq.heappop(queue)
        if cost > 2 * 3 * (len(rows) + 1) or (audit, i, state) in done:
            continue
        done.add((audit, i, state))
        if i == len(rows) and state in (0, 3):
            ends.append((cost, audit, said))
        new = turns.MADE[state]
        if audit.count("I") < 6:
            heapq.heappush(queue, (cost + 2, audit + "I", f"{said}\n{new}:", i, turns.MADE_STATE[state]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", said, i + 1, state))
            if fault in ("", "truncated"):
                more = cost + (fault == "truncated")
                heapq.heappush(queue, (more + 2, audit + "R", f"{said}\n{new}:{i}", i + 1, turns.MADE_STATE[state]))
                if initial in turns.NEXT[state]:
                    heapq.heappush(queue, (more, audit + "K", f"{said}\n{initial}:{i}", i + 1, turns.NEXT[state][initial]))
    return min(ends)


@pytest.mark.parametrize("seed", range(60))
def test_backpointers_lead_to_the_least_of_all_edits(seed):
    rng = np.random.default_rng(seed)
    rows = [(str(rng.choice(list("suat"))), str(rng.choice(["", "", "truncated", "blank", "duplicate"]))) for _ in range(rng.integers(0, 5))]
    costs, pointers = turns.END, []
    for initial, fault in reversed(rows):
        costs, pointer = turns.step(costs, initial, fault)
        pointers.append(pointer)
    repair = turns._Repair("=1")
    for i, (initial, fault) in enumerate(rows):
        repair.row(i, initial, str(i), initial, fault, pointers[-1 - i])
    got = repair.end()
    cost, audit, said = cheapest(rows)
    assert got[6:] == (cost, audit, hashlib.sha256(said[1:].encode()).hexdigest())


def test_empty_and_dropped_conversations(spark):
    dropped = [(c, 0, "user", "x") for c in range(2000)]
    frame = spark.createDataFrame(dropped, CHAT)
    gone = frame.join(turns.damaged(frame).where("gone").select(F.expr("cast(substring(conv, 2) as long)").alias("conv_id")), "conv_id", "left_semi")
    found = turns.repairs(gone).collect()
    assert len(found) > 50
    assert {tuple(r)[1:] for r in found} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert turns.repairs(frame.limit(0)).count() == 0
    by_name = spark.createDataFrame([("c1", 1, "user", "Hi."), ("c1", 2, "assistant", "Yo.")], "conv_id string, turn int, role string, text string")
    assert [r.conv_id for r in turns.repairs(by_name).collect()] == ["c1"]
