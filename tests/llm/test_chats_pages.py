"""Chats, web archives and the pipeline against step-by-step models, and the defined odd cases."""

import base64
import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from flowloom.llm import chats, warc
from flowloom.llm.common import table
from flowloom.llm.queries import CHATS_SQL

CHAT = "conv_id long, turn int, role string, text string"


def maximal(made: dict) -> set:
    kept = set()
    for i, own in made.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in made.values())
        if not longer and not any(o == own and j < i for j, o in made.items()):
            kept.add(i)
    return kept


def test_maximal_conversations(spark, monkeypatch):
    monkeypatch.setattr(chats, "SEGMENT", 3)
    rng = np.random.default_rng(9)
    made = {}
    for i in range(200):
        start = made[int(rng.choice(list(made)))] if made and rng.random() < 0.7 else []
        made[i] = start[: rng.integers(0, 9)] + [(rng.choice(["user", "assistant"]), f"t{rng.integers(3)}") for _ in range(rng.integers(1, 4))]
    logged = [(i, n, str(r), t) for i, turns in made.items() for n, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(logged + logged[:50], CHAT)
    got = chats.chat_rows(frame).collect()
    assert {r.conv_id for r in got} == maximal(made)
    for i in maximal(made):
        text = "".join(r.text for r in sorted(got, key=lambda r: r.segment) if r.conv_id == i)
        assert text == "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in made[i])


def test_several_rows_of_a_turn_equal_the_sql(spark):
    rng = np.random.default_rng(12)
    rows = [(2 * i + more, turn, role, text) for i in range(40) for more in (0, 1)
            for turn, role, text in [(0, "user", f"a{i}"), *([(0, "user", f"b{i}")] if more else [])]]
    rows += [(1000 + i, int(rng.integers(2)), str(rng.choice(["user", "assistant"])), str(rng.choice(["x", "y", "z"]))) for i in rng.integers(0, 40, 200).tolist()]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = sorted(con.execute(f"select conv_id, segment, turns, copies, text from ({CHATS_SQL})").fetchall())
    got = sorted(tuple(r) for r in chats.chat_rows(spark.createDataFrame(rows, CHAT)).select("conv_id", "segment", "turns", "copies", "text").collect())
    assert got == want and {r[0] for r in want if r[0] < 80} == set(range(1, 80, 2))


def test_chats_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, None, None), (1, 0, "user", "a"), (None, 0, "user", "lost"), (2, 0, "user", ""), (3, 0, "user", ""),
                                   (3, 0, "user", ""), (4, 0, "user", "x"), (4, 0, "user", "y")], CHAT).withColumn("segment", F.lit(0))
    got = {r.conv_id: (r.turns, r.copies, r.text) for r in chats.chat_rows(frame).collect() if r.conv_id != 1}
    assert got == {2: (1, 2, "<|user|>\n<|end|>\n"), 4: (2, 1, "<|user|>\nx<|end|>\n<|user|>\ny<|end|>\n")}
    assert chats.chat_rows(frame.limit(0)).count() == 0


def digest(payload: str | None) -> str:
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def round_trip(spark, pages):
    path = warc.archive_path(spark)
    warc.write_warc(pages, path)
    return warc.page_records(warc.read_warc(spark, path)).collect()


def test_archives_survive_any_split(spark, monkeypatch):
    """Payloads hold version lines and whole false records; files are cut into splits of a few hundred bytes."""
    false = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfalse\r\n\r\n"
    rng = np.random.default_rng(10)
    parts = ["é<p>", false, "WARC/1.1\r\n", "x" * 300, "\r\n\r\n", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n", "", false * 12]
    made = {i: "".join(rng.choice(parts, size=rng.integers(0, 6))) for i in range(150)}
    made[7] = None
    pages = spark.createDataFrame([(i, f"http://a/{i} b", h) for i, h in made.items()], "page_id long, url string, html string").repartition(3)
    monkeypatch.setenv("TZ", "UTC")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.page_id: r for r in round_trip(spark, pages)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(made)
    first = {}
    for i in sorted(made):
        first.setdefault(made[i] or "", i)
    for i, html in made.items():
        original = first[html or ""]
        want = (len((html or "").encode()), digest(html), "response" if original == i else "revisit", None if original == i else original)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want


def test_false_beginnings_are_not_reachable(spark):
    path = warc.archive_path(spark)
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc"
    broken = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\ntoo short"
    spark.createDataFrame([(good,), (broken,), (good,)], "value string").coalesce(1).write.option("lineSep", warc.END).text(path)
    # The second record's length runs into the third, so its end is no version line: the third is not reached.
    assert sorted((r.start, r.length) for r in warc.read_warc(spark, path).collect()) == [(0, 3), (len(good) + 4, 50)]


ODD_PAGES = [(1, "u", "same"), (1, "u", "same"), (1, "t", "same"), (2, None, "same"), (2, "v", None), (None, "w", "same"), (3, "", ""),
             (None, "w", "lone"), (None, "w", "lone"), (None, None, "lone"), (9, "z", "nine"), (5, "z", "nine"), (5, "z", "nine"), (-4, "é \n", "minus")]


def test_pages_of_odd_rows(spark, sf):
    """Ties, repeated rows and rows without an id against a plain choice: one response a payload, all others revisit it."""
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    want = []
    for payload in {h or "" for _, _, h in ODD_PAGES}:
        ids = sorted((i for i, _, h in ODD_PAGES if (h or "") == payload), key=lambda i: (i is None, i or 0))
        want += [(i, len(payload.encode()), digest(payload), "revisit" if k else "response", ids[0] if k else None) for k, i in enumerate(ids)]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(spark, pages)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert round_trip(spark, pages.limit(0)) == []
    assert len(round_trip(spark, table(spark, sf, "pages"))) == table(spark, sf, "pages").count()


def test_records_have_names_and_dates(spark):
    path = warc.archive_path(spark)
    warc.write_warc(spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string"), path)
    heads = [dict(line.split(": ", 1) for line in r.header.split("\r\n") if line) for r in warc.read_warc(spark, path).collect()]
    names = {h["WARC-Record-ID"]: h for h in heads}
    assert len(names) == len(ODD_PAGES) and len({h["WARC-Date"] for h in heads}) == 1
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) for h in heads)
    assert all(names[h["WARC-Refers-To"]]["WARC-Type"] == "response" for h in heads if h["WARC-Type"] == "revisit")


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    before, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            after = spark.createDataFrame(after.collect(), docs.schema)
            seen.append({r.doc_id for r in after.collect()})
            before = after
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False))
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in seen[0] for i in good) >= 0.98 * len(good)
    assert {r.doc_id for r in after.collect()} == seen[-1]
    ran = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in ran.collect()} == seen[-1]
