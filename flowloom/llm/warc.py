"""WARC archives: written by tasks, read back by verifying chains of record boundaries.

Writing. A page is one record; the text sink writes it with the blank lines that end a record as its separator, so tasks
write plain WARC files in parallel. Payloads are grouped by digest: the page with the smallest id keeps its payload, the
others become revisits that name it. Ids that are null come last; of rows with one id and payload, one is the response.

Reading. Files are read by Spark's text source, cut at the version line, in as many splits as Spark likes. A piece of text that
follows a version line is a candidate record: its header gives the length, so the offset of its successor. Payloads may hold a
version line themselves, so candidates prove nothing. The first pass keeps one row per candidate (offset and successor). Inside a
split the chain is followed from every candidate that could be entered, which leaves one jump per candidate to the first offset
past the split; between splits, pointer jumping from the start of each file squares these jumps, so a file of n splits takes
log2(n) rounds. The result is the entry offset of every split. The second pass follows the chain from there and emits records;
a payload that runs into further splits is put together by its offset.

Defined cases: null html is an empty payload; null page_id rows are written with an empty id and read back as null (a revisit of one refers to
null); rows that repeat a page_id, or are equal in every column, are records of their own, with names of their own; an empty table writes and
reads no record;
text before the first version line, after a broken header or past a wrong length is not reachable and not returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import batch_of, map_batches, rows_of
from flowloom.session import checkpoint, shared_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads of fewer bytes never become revisits.
MIN_REVISIT_BYTES = 0
#: A table of so many revisits is sent to all writers; a larger one is joined by a shuffle of the pages.
BROADCAST_REVISITS = 1_000_000
#: Entry offsets of so many splits are sent to all readers; more are joined by a shuffle.
BROADCAST_SPLITS = 1_000_000

_LENGTH = re.compile(rb"(?i)(?:^|\r\n)content-length:[ \t]*(\d+)[ \t]*(?=\r\n|$)")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def repeats_of(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Payloads that several rows hold: sha1, page_id, url, copies (rows equal in these), own, first_id, first_url.

    ``own`` marks the rows of which one is the response: the smallest page_id (null last), then the smallest url. Only ids, addresses and digests
    are shuffled, counted in tasks before; digests that occur once take no further part.
    """
    seen = pages.select("page_id", "url", F.sha1("html").alias("sha1")).where(F.octet_length("html") >= min_bytes)
    per = checkpoint(seen.groupBy("sha1", "page_id", "url").agg(F.count("*").alias("copies")))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = per.groupBy("sha1").agg(F.min(place).alias("_first"), F.sum("copies").alias("_n")).where("_n > 1")
    own = F.col("page_id").eqNullSafe(F.col("_first.page_id")) & F.col("url").eqNullSafe(F.col("_first.url"))
    return per.join(first, "sha1").select("sha1", "page_id", "url", "copies", own.alias("own"), F.col("_first.page_id").alias("first_id"),
                                          F.col("_first.url").alias("first_url"))


def record_id(page_id: int | None, url: str | None, sha1: str, copy: int) -> str:
    """Name of a record: the page's id, and what tells it from other rows with that id."""
    rest = "\n".join(("-" if url is None else "+" + url, sha1, str(copy)))
    return f"<urn:page:{'' if page_id is None else page_id}:{hashlib.sha1(rest.encode()).hexdigest()}>"


def _records(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("value", pa.string())])
    for batch in batches:
        out = []
        for page_id, url, html, sha1, copy, revisit, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body = html or b""
            head = [
                f"WARC-Type: {'revisit' if revisit else 'response'}",
                f"WARC-Record-ID: {record_id(page_id, url, sha1, copy)}",
                f"WARC-Date: {date}",
                "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
                f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
                f"Content-Length: {len(body)}",
            ]
            if revisit:
                head[5:5] = [f"WARC-Refers-To: {record_id(first_id, first_url, sha1, 1)}",
                             "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            out.append(MAGIC + "\r\n".join(head) + END + body.decode())
        yield batch_of({"value": out}, schema)


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> None:
    """Write one record per row of pages (page_id, url, html) into WARC files under ``path``; ``date`` (default: now) is in all records.

    Revisits have no payload, so they are written from the table of repeats. Of rows equal in every column one is written with its payload.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    repeats = checkpoint(repeats_of(rows, min_bytes))
    known = F.broadcast(repeats) if repeats.count() <= BROADCAST_REVISITS else repeats
    r = known.alias("r")
    same = (F.sha1("p.html") == F.col("r.sha1")) & F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & F.col("p.url").eqNullSafe(F.col("r.url"))
    held = rows.alias("p").join(r, same, "left").where("r.sha1 is null or r.own").select(
        "p.page_id", "p.url", "p.html", F.sha1("p.html").alias("sha1"), (F.coalesce("r.copies", F.lit(1)) > 1).alias("tied"))
    record = ("page_id", "url", "html", "sha1", "copy", "revisit", "first_id", "first_url")
    response = {"copy": F.lit(1).cast("long"), "revisit": F.lit(False), "first_id": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")}
    written = held.where("not tied").withColumns(response).select(*record)
    if not repeats.where("own and copies > 1").isEmpty():
        one = held.where("tied").groupBy("sha1", "page_id", "url").agg(F.first("html").alias("html"))
        written = written.unionByName(one.withColumns(response).select(*record))
    copies = repeats.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).where("not own or copy > 1")
    written = written.unionByName(copies.select("page_id", "url", F.lit(None).cast("binary").alias("html"), "sha1", "copy",
                                                F.lit(True).alias("revisit"), "first_id", "first_url"))
    map_batches(written, partial(_records, date=date), "value string").write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines, with the file and the split it was read from, in file order within a split."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("value").cast("binary").alias("piece"))


def successor(piece: bytes, at: int) -> int | None:
    """Offset after the record whose version line ends before ``piece``; ``at`` is the offset of the version line."""
    head = piece.find(b"\r\n\r\n")
    length = _LENGTH.search(piece, 0, head) if head >= 0 else None
    return at + len(MAGIC) + head + 4 + int(length[1]) + len(END) if length else None


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """Pieces in order as (file, block, offset relative to the split's first piece, size with the version line, piece).

    A split starts with the first piece that begins in it. In a file's first split that is what lies before the first
    version line, so a piece's own version line is at its offset minus the line's length.
    """
    here, at = None, 0
    for file, block, piece in rows_of(batches):
        if (file, block) != here:
            here, at = (file, block), 0
        yield file, block, at, len(piece) + len(MAGIC), piece
        at += len(piece) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("next", pa.int64()),
                        ("size", pa.int64())])
    out: dict[str, list] = {f.name: [] for f in schema}
    for file, block, at, size, piece in _walk(batches):
        start = at - len(MAGIC)
        follower = successor(piece, start) if block or at else None
        for name, value in zip(out, (file, block, start, follower, size), strict=True):
            out[name].append(value)
        if len(out["at"]) >= 8192:
            yield batch_of(out, schema)
            out = {name: [] for name in out}
    yield batch_of(out, schema)


def _exits(key: tuple, group: pa.Table) -> pa.Table:
    """For every candidate of a split the first offset past it that its chain leads to; null where the chain breaks.

    Offsets are bound to the file by now. Going backwards through a split, a candidate takes the exit of its successor.
    """
    at, follower = group["start"].to_pylist(), group["next"].to_pylist()
    past = group["end"][0].as_py()
    exit_of: dict[int, int | None] = {}
    for k in sorted(range(len(at)), key=at.__getitem__, reverse=True):
        n = follower[k]
        exit_of[at[k]] = n if n is None or n >= past else exit_of.get(n)
    return pa.table({"file": pa.array([key[0].as_py()] * len(at), pa.string()),
                     "block": pa.array([key[1].as_py()] * len(at), pa.int64()), "start": pa.array(at, pa.int64()),
                     "exit": pa.array([exit_of[a] for a in at], pa.int64())})


def split_entries(spark: SparkSession, path: str) -> DataFrame:
    """Per split: file, block, base (offset of its first piece) and entry: offset of its first true record, null if it has none."""
    found = checkpoint(map_batches(_pieces(spark, path), _candidates, "file string, block long, at long, next long, size long"))
    splits = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = "sum(bytes) over (partition by file order by block rows between unbounded preceding and 1 preceding)"
    # A candidate's version line ends where its piece begins, so a split owns version lines from base - length on.
    bases = checkpoint(splits.selectExpr("file", "block", f"coalesce({before}, 0) as base", "bytes"))
    bound = found.join(bases, ["file", "block"]).selectExpr(
        "file", "block", "base + at as start", "base + next as next", f"base + bytes - {len(MAGIC)} as end")
    exits = bound.groupBy("file", "block").applyInArrow(_exits, "file string, block long, start long, exit long")
    # Only candidates at which a split may be entered matter between splits: those that an exit leads to, and a file's first.
    exits = checkpoint(exits.where("start >= 0"))
    targets = exits.select("file", F.col("exit").alias("start")).where("start is not null").distinct()
    firsts = exits.groupBy("file").agg(F.min("start").alias("start")).where("start = 0")
    doors = checkpoint(exits.join(targets.unionByName(firsts).distinct(), ["file", "start"]))
    reached = firsts
    jumps = doors.select("file", "start", F.col("exit").alias("to")).where("to is not null")
    while True:  # reached: all doors up to 2^k jumps from the start; jumps: doors 2^k jumps apart
        more = reached.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))
        grown = checkpoint(reached.unionByName(more).distinct())
        if grown.count() == reached.count():
            break
        reached = grown
        far = jumps.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        jumps = checkpoint(jumps.join(far, ["file", "to"]).select("file", "start", F.col("further").alias("to")))
    entries = doors.join(reached, ["file", "start"], "left_semi").groupBy("file", "block").agg(F.min("start").alias("entry"))
    return checkpoint(bases.join(entries, ["file", "block"], "left").select("file", "block", "base", "entry"))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that are whole in this split, and parts of those that are not (need: bytes of the block still asked for)."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()),
                        ("header", pa.string()), ("length", pa.int64()), ("reach", pa.int64()), ("block", pa.binary())])
    here, at, wanted, record = None, 0, None, None
    out: dict[str, list] = {f.name: [] for f in schema}

    def put(*row) -> None:
        for name, value in zip(out, row, strict=True):
            out[name].append(value)

    for file, block, base, entry, piece in rows_of(batches):
        if (file, block) != here:
            if record:
                put(*record_parts(record))
            here, at, wanted, record = (file, block), base, entry, None
        start = at - len(MAGIC)  # of this piece's version line
        at += len(piece) + len(MAGIC)
        if wanted is not None and start == wanted:
            if record:
                put(*record_parts(record))
            head = piece.find(b"\r\n\r\n")
            wanted = successor(piece, start)
            if wanted is None:
                record = None
                continue
            length = wanted - len(END) - (start + len(MAGIC) + head + 4)
            record = (file, start, piece[:head].decode("utf-8", "replace"), length, wanted - len(END), [piece[head + 4 :]])
        elif record:
            record[5].extend((MAGIC.encode(), piece))
        elif base or start >= 0:  # before the split's first record: may belong to a record of an earlier split
            put(file, None, start, False, None, None, None, MAGIC.encode() + piece)
        if len(out["file"]) >= 256:
            yield batch_of(out, schema)
            for column in out.values():
                column.clear()
    if record:
        put(*record_parts(record))
    yield batch_of(out, schema)


def record_parts(record: tuple) -> tuple:
    file, start, header, length, reach, parts = record
    body = b"".join(parts)
    whole = len(body) >= length
    return file, start, start, whole, header, length, reach, body[:length] if whole else body


def _stitch(key: tuple, group: pa.Table) -> pa.Table:
    """A record whose payload runs over splits, from its parts in file order."""
    rows = sorted(zip(*(group[c].to_pylist() for c in ("at", "header", "length", "block")), strict=True))
    header, length = rows[0][1], rows[0][2]
    body = b"".join(r[3] for r in rows)
    return pa.table({"file": [key[0].as_py()], "start": pa.array([key[1].as_py()], pa.int64()), "header": [header],
                     "length": pa.array([length], pa.int64()), "block": [body[:length]]})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Reachable records of all files under ``path``: file, start, header, length, block (bytes)."""
    entries = split_entries(spark, path)
    pieces, given = _pieces(spark, path), ["file", "block", "base", "entry", "piece"]
    if entries.count() <= BROADCAST_SPLITS:
        bound = pieces.join(F.broadcast(entries), ["file", "block"]).select(*given)  # keeps the order of the scan
    else:
        numbered = pieces.withColumn("_row", F.monotonically_increasing_id()).join(entries, ["file", "block"])
        bound = numbered.repartition("file", "block").sortWithinPartitions("file", "block", "_row").select(*given)
    ddl = "file string, start long, at long, whole boolean, header string, length long, reach long, block binary"
    emitted = map_batches(bound, _emit, ddl)
    columns = ["file", "start", "header", "length", "block"]
    whole = emitted.where("whole").select(*columns)
    # A split whose first version line is no record's may hold the rest of a payload from the split before.
    if entries.where(f"base > 0 and (entry is null or entry > base - {len(MAGIC)})").isEmpty():
        return whole
    parts = emitted.where("not whole")
    opened = parts.where("start is not null").selectExpr("file as _file", "start as _start", "header as _header",
                                                         "length as _length", "reach as _reach")
    owned = parts.join(opened, (F.col("file") == F.col("_file")) & (F.col("at") >= F.col("_start"))
                       & (F.col("at") < F.col("_reach"))).selectExpr(
        "file", "_start as start", "at", "_header as header", "_length as length", "block")
    joined = owned.groupBy("file", "start").applyInArrow(_stitch, "file string, start long, header string, length long, block binary")
    return whole.unionByName(joined.select(*columns))


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("name", pa.string())])
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for header, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            named = dict(line.split(": ", 1) for line in header.split("\r\n") if ": " in line)
            page = lambda field: re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]+>", named.get(field, ""))
            own, other = page("WARC-Record-ID"), page("WARC-Refers-To")
            revisit = named["WARC-Type"] == "revisit"
            digest = named.get("WARC-Payload-Digest", "").rpartition(":")[2] if revisit else base32_sha1(block)
            row = (int(own[1]) if own else None, named["WARC-Type"], int(other[1]) if other else None,
                   None if revisit else len(block), digest, named.get("WARC-Refers-To" if revisit else "WARC-Record-ID"))
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        yield batch_of(out, schema)


def page_records(records: DataFrame) -> DataFrame:
    """Read records as pages: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the bytes that were read. A revisit has its digest from its header, and its
    size from the response that it names, which must have that digest (else the size is null).
    """
    read = checkpoint(map_batches(records.select("header", "block"), _payloads, "page_id long, record_type string, refers_to long, "
                                  "payload_bytes long, payload_digest string, name string"))
    responses = read.where("record_type = 'response'")
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes")
    full = responses.where("name is not null").select("name", "payload_digest", "payload_bytes").distinct()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(revisits.join(full, ["name", "payload_digest"], "left").select(*columns))


def archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/flowloom-warc-{uuid.uuid4().hex}"
