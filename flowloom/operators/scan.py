"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. The operators here cut every key
into chunks of bounded size, scan inside the chunk, and carry a one-row summary per chunk forward.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from flowloom.session import checkpoint

FRAMES_PER_CHUNK = 1 << 17
#: The range of a row in ``ordered_scan``.
CHUNK = "_chunk"
#: Which sums a row adds to, where a scan has sums of kinds.
KIND = "_adds"
#: Widths of a chain in one of its chunks: more make the carried tables smaller and the chunks larger.
CHAIN_WIDTHS = 16
#: Chunks of a chain (three or more) that are composed to a larger one: a task walks the tables of so many at most.
CHAIN_FAN = 256

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(how: str, local: Column, carried: Column) -> Column:
    if how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return F.greatest(local, carried) if how == "max" else F.least(local, carried)


def chunk_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    folds: dict[str, tuple[str, Column, bool]],
    *,
    reverse: bool = False,
) -> DataFrame:
    """Running sum / max / min per key, in any number of chunks.

    ``folds`` maps an output name to ``(how, value, inclusive)``. ``chunk`` must grow with ``order``.
    ``order`` is given in scan direction; ``reverse`` says that the chunks are walked downwards.
    """
    rows = df.withColumn("_chunk", chunk)
    part = [*keys, "_chunk"]
    running = Window.partitionBy(*part).orderBy(*order)
    upto, before = running.rowsBetween(Window.unboundedPreceding, 0), running.rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = rows.select(
        "*",
        *[
            _AGG[how](value).over(upto if inclusive else before).alias(f"_in_{name}")
            for name, (how, value, inclusive) in folds.items()
        ],
    )
    totals = rows.groupBy(*part).agg(
        *[_AGG[how](value).alias(f"_sum_{name}") for name, (how, value, _) in folds.items()]
    )
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk").asc()
    earlier = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *part,
        *[
            _AGG[how](F.col(f"_sum_{name}")).over(earlier).alias(f"_carry_{name}")
            for name, (how, _, _) in folds.items()
        ],
    )
    joined = local.join(carry, part)
    return joined.select(
        *df.columns,
        *[
            _combine(how, F.col(f"_in_{name}"), F.col(f"_carry_{name}")).alias(name)
            for name, (how, _, _) in folds.items()
        ],
    )


def _new_keys(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Rows whose key differs from the one before (never the first row); nulls are equal."""
    out = np.zeros(batch.num_rows, dtype=bool)
    for column in batch.columns[:keys]:
        left, right = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(left, right), False), pc.not_equal(pc.is_null(left), pc.is_null(right)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _sums_of_kinds(
    batch: pa.RecordBatch, folds: list[tuple[str, str, str, bool, int | None]], at: np.ndarray, start: np.ndarray, follows: np.ndarray, held: dict
) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Running sums at the rows ``at`` and after the last row, each over the rows of one kind only."""
    kinds = pc.fill_null(batch.column(KIND), -1).to_numpy(zero_copy_only=False)
    asked = np.append(at, len(kinds) - 1)
    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    values, after = {}, {}
    for name, _, source, _, kind in folds:
        if kind not in places:
            rows = np.flatnonzero(kinds == kind)
            places[kind] = rows, np.searchsorted(rows, asked, side="right"), np.searchsorted(rows, start[asked])
        rows, upto, since = places[kind]
        own = pc.fill_null(batch.column(source), 0).to_numpy(zero_copy_only=False)[rows]
        total = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        found = total[upto] - total[since] + np.where(follows[asked], held.get(name) or 0, 0)
        values[name], after[name] = found[:-1], int(found[-1])
    return values, after


def _scan_sorted(
    batches: Iterator[pa.RecordBatch], keys: int, folds: list[tuple[str, str, str, bool, int | None]], keep: str | None, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Folds along sorted rows of one range, and two rows that tell how it begins and ends."""
    of_kinds = [f for f in folds if f[4] is not None]
    of_rows = [f[:4] for f in folds if f[4] is None]
    chunk = TaskContext.get().partitionId()
    key: tuple | None = None
    first: tuple | None = None
    held: dict[str, int | None] = {}
    opening = True

    def emit(taken: pa.RecordBatch | None, own: tuple, kind: int, values: dict, opened: object) -> pa.RecordBatch:
        n = taken.num_rows if taken is not None else 1
        columns = []
        for field in schema:
            if field.name in values:
                columns.append(pa.array(values[field.name], field.type))
            elif field.name == CHUNK:
                columns.append(pa.repeat(pa.scalar(chunk, field.type), n))
            elif field.name == "_kind":
                columns.append(pa.repeat(pa.scalar(kind, field.type), n))
            elif field.name == "_open":
                columns.append(pa.array(opened, field.type))
            elif taken is not None:
                own_column = taken.column(field.name)
                columns.append(own_column if own_column.type.equals(field.type) else own_column.cast(field.type))
            elif field.name in names:
                columns.append(pa.array([own[names.index(field.name)]], field.type))
            else:
                columns.append(pa.nulls(1, field.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    names: list[str] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = batch.schema.names[:keys]
        begins = _new_keys(batch, keys)
        front = tuple(c[0].as_py() for c in batch.columns[:keys])
        if first is None:
            first = front
        elif front != key:
            begins[0] = True
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(begins, at, 0))
        follows = start == 0 if not begins[0] else np.zeros(n, dtype=bool)  # rows that go on with what was held
        if begins[0]:
            held, opening = {}, False
        is_open = (start == 0) & opening if not begins.any() else (at < int(np.argmax(begins))) & opening
        values: dict[str, object] = {}
        after: dict[str, int | None] = {}
        if of_kinds:
            places = np.flatnonzero(pc.fill_null(batch.column(keep), False).to_numpy(zero_copy_only=False))
            at_kept, ended = _sums_of_kinds(batch, of_kinds, places, start, follows, held)
            after |= ended
        for name, how, source, inclusive in of_rows:
            column = batch.column(source)
            carried = held.get(name)
            if how == "sum":
                own = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(own)
                running = total - (total[start] - own[start]) + np.where(follows, carried or 0, 0)
                after[name] = int(running[-1])
                values[name] = running if inclusive else running - own
            else:
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                own = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.maximum.accumulate(np.where(valid, at, -1))
                if not inclusive:
                    after_place = place[-1]
                    place = np.concatenate([[-1], place[:-1]])
                else:
                    after_place = place[-1]
                known = place >= start
                seen = np.where(known, own[np.maximum(place, 0)], carried if carried is not None else 0)
                missing = ~known & ~(follows & (carried is not None))
                values[name] = pa.array(seen, mask=missing)
                ended = after_place >= start[-1]
                after[name] = int(own[after_place]) if ended else (carried if follows[-1] else None)
        held, key = after, tuple(c[n - 1].as_py() for c in batch.columns[:keys])
        if keep is None:
            yield emit(batch, key, 0, values, is_open)
        else:
            mask = pc.fill_null(batch.column(keep), False)
            if mask.true_count:
                chosen = mask.to_numpy(zero_copy_only=False)
                picked = {k: v.filter(mask) if isinstance(v, pa.Array) else v[chosen] for k, v in values.items()} | (at_kept if of_kinds else {})
                yield emit(batch.filter(mask), key, 0, picked, is_open[chosen])
        if begins.any():
            opening = False
    if first is not None:
        yield emit(None, first, 1, {}, [False])
        yield emit(None, key, 2, {name: [held.get(name)] for name, *_ in folds}, [False])


def ordered_scan(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, tuple], *, keep: str | None = None
) -> DataFrame:
    """Running sums and last values per key, spread evenly over tasks whatever the keys are.

    Rows are dealt by ranges of (key, order), so a key that holds most rows lies in many ranges. A task folds its range and adds two
    rows: the key it begins with, and the key it ends with and what was folded for that one. From these few rows (two a task) follows
    what each range has to add to the rows of its first key. One shuffle, whatever the number of folds.

    ``folds`` maps an output name to ``(how, column, inclusive)``; ``how`` is "sum" or "last" (the newest value that is not null) of a
    long column. ``order`` holds long columns without nulls, in scan direction. With ``keep``, a boolean column, only its rows come out. With
    ``keep`` and a fourth entry, a number, an inclusive sum counts only rows of that number in the column ``KIND``: many sums share few
    columns, since each row adds to the sums of its own kind. The result is stored; it has the columns of ``rows`` (without ``keep``) and the folds. ``rows`` is read twice, once to find the ranges.
    """
    keys, order = list(keys), list(order)
    payload = [n for n in rows.columns if n not in (*keys, keep)]
    kinds = {f.name: f.dataType for f in rows.schema}
    plan = [(name, how, source, inclusive, kind[0] if kind else None) for name, (how, source, inclusive, *kind) in folds.items()]
    fields = [StructField(n, kinds[n]) for n in (*keys, *payload)] + [StructField(n, LongType()) for n in folds]
    fields += [StructField(CHUNK, IntegerType()), StructField("_kind", IntegerType()), StructField("_open", BooleanType())]
    out = StructType(fields)
    ranged = rows.select(*keys, *payload, *([keep] if keep else [])).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    work = partial(_scan_sorted, keys=len(keys), folds=plan, keep=keep, schema=to_arrow_schema(out))
    stored = checkpoint(ranged.mapInArrow(work, out))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "last": lambda n: F.last(n, ignorenulls=True)}
    carry = stored.where("_kind > 0").select(
        CHUNK, "_kind", *[fold[how](name).over(earlier).alias(f"_carry_{name}") for name, how, *_ in plan]).where("_kind = 1").drop("_kind")
    whole = stored.where("_kind = 0").join(F.broadcast(carry), CHUNK, "left")  # one row a task

    def carried(name: str, how: str) -> Column:
        own, before = F.col(name), F.when(F.col("_open"), F.col(f"_carry_{name}"))
        return own + F.coalesce(before, F.lit(0)) if how == "sum" else F.coalesce(own, before)

    return whole.select(*keys, *payload, *[carried(name, how).alias(name) for name, how, *_ in plan])


def first_at_or_after(
    points: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    event: Column,
    out: str,
) -> DataFrame:
    """Forward as-of lookup: for each point the smallest event struct whose ``at`` is not earlier.

    ``events`` needs the columns ``keys`` and ``at``; ``event`` is a struct of longs that starts with ``at``. Points without a later event
    keep a null. Both are scanned downwards in time together (``ordered_scan``), so one key may hold all rows.
    """
    keys, marks = list(keys), events.select(*keys, at, event.alias("_event"))
    names = marks.schema["_event"].dataType.names
    payload = [n for n in points.columns if n not in keys]
    # At equal times events come first, the smallest one last.
    then = -F.col(f"_event.{names[1]}") if len(names) > 1 else F.lit(0)
    asked = points.select(*keys, *payload, (-F.col(at)).alias("_down"), F.lit(1).alias("_late"), F.lit(0).cast("long").alias("_then"),
                          *[F.lit(None).cast("long").alias(f"_of_{n}") for n in names], F.lit(True).alias("_asked"))
    given = marks.select(*keys, (-F.col(at)).alias("_down"), F.lit(0).alias("_late"), then.cast("long").alias("_then"), *[F.col(f"_event.{n}").cast("long").alias(f"_of_{n}") for n in names], F.lit(False).alias("_asked"))
    both = asked.unionByName(given, allowMissingColumns=True)
    hits = ordered_scan(both, keys, ["_down", "_late", "_then"], {f"_hit_{n}": ("last", f"_of_{n}", True) for n in names}, keep="_asked")
    hit = F.struct(*[F.col(f"_hit_{n}").alias(n) for n in names])
    return hits.select(*points.columns, F.when(F.col(f"_hit_{names[0]}").isNotNull(), hit).alias(out))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a sorted partition in tables of whole runs (rows of equal ``_run``); the last run is held until it ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column("_run").to_numpy()
        changes = np.flatnonzero(run[1:] != run[:-1]) + 1
        cut = int(changes[-1]) if len(changes) else 0
        if held and run[0] != last and not cut:
            yield pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = run[-1]
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the runs of a table begin; for each row the run it is in, and where that run ends."""
    run = table["_run"].to_numpy()
    begin = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
    size = np.diff(np.append(begin, len(run)))
    of = np.repeat(np.arange(len(begin)), size)
    return begin, of, (begin + size)[of]


def _first_from(times: np.ndarray, of: np.ndarray, wanted: np.ndarray, wanted_of: np.ndarray) -> np.ndarray:
    """For each wanted time the place of the first row of its run that is not earlier (the end of the run if none): all runs at once."""
    order = np.lexsort((np.concatenate([np.ones(len(times), np.int8), np.zeros(len(wanted), np.int8)]), np.concatenate([times, wanted]), np.concatenate([of, wanted_of])))
    is_row = order < len(times)
    out = np.empty(len(wanted), dtype=np.int64)
    out[order[~is_row] - len(times)] = np.cumsum(is_row)[~is_row]
    return out


def _chunk_tables(batches: Iterator[pa.RecordBatch], width_us: int, chunk_us: int) -> Iterator[pa.RecordBatch]:
    """Per chunk: for every time at which the chain may enter, the last time it keeps there (``last_us``).

    Rows that have ``last_us`` already are entries of smaller chunks; these are composed to entries of the chunk that holds them all.
    """
    for table in _whole_runs(batches):
        times = table["ts_us"].to_numpy()
        reach = table["last_us"].to_numpy() if "last_us" in table.column_names else times
        begin, of, end = _bounds(table)
        follower = _first_from(times, of, reach + width_us, of)
        last = np.where(follower == end, np.arange(len(times)), follower)
        while (last[last] != last).any():  # pointers within the chunk: log2 of the times kept in it
            last = last[last]
        # Whoever comes from the chunk before enters at a time of the first width, or at the first one after it.
        door = _first_from(times, of, (times[begin] // chunk_us) * chunk_us + width_us, np.arange(len(begin)))
        chosen = np.flatnonzero(np.arange(len(times)) <= door[of])
        out = table.select([n for n in table.column_names if n not in ("_run", "last_us")]).take(pa.array(chosen))
        yield from out.append_column("last_us", pa.array(reach[last[chosen]], pa.int64())).combine_chunks().to_batches()


def _walk(batches: Iterator[pa.RecordBatch], keys: int, width_us: int) -> Iterator[pa.RecordBatch]:
    """Follows every key through the tables of its chunks in order; one row per chunk that keeps a time."""
    key, due, done = None, None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        chosen = []
        for at, row in enumerate(zip(*columns, strict=True)):
            own, chunk, ts_us, last_us = row[:keys], row[keys], row[keys + 1], row[keys + 2]
            if own != key:
                key, due, done = own, None, None
            if chunk != done and (due is None or ts_us >= due):
                chosen.append(at)
                due, done = last_us + width_us, chunk
        yield batch.select(list(range(keys + 2))).take(pa.array(chosen, pa.int64()))


def _kept(batches: Iterator[pa.RecordBatch], width_us: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each chunk that its chain keeps, from the time at which the chain enters it."""
    for table in _whole_runs(batches):
        times = table["ts_us"].to_numpy()
        begin, of, end = _bounds(table)
        follower = _first_from(times, of, times + width_us, of)
        at = _first_from(times, of, table["_enter"].to_numpy()[begin], np.arange(len(begin)))
        at = at[at < end[begin]]
        chosen = np.zeros(len(times), dtype=bool)
        while len(at):  # one step along the chains of all runs: as many as a chunk keeps
            chosen[at] = True
            then = follower[at]
            at = then[then < end[at]]
        yield from table.select(columns).filter(pa.array(chosen)).combine_chunks().to_batches()


def greedy_chain(rows: DataFrame, keys: Sequence[str], width_us: int, *, staged: bool = False) -> DataFrame:
    """Rows kept by "at least ``width_us`` after the last kept row", from the first row of each key.

    ``rows`` has the columns ``keys``, ``ts_us`` and ``pos`` (order within equal times). Returns
    ``keys, ts_us, pos`` of the kept rows. Time is cut into chunks of ``CHAIN_WIDTHS`` widths. A task sees
    one chunk of one key and tells, for every time at which the chain may enter, where it leaves: those of
    the first width only, so a key's tables are a small part of its rows. The tables of ``CHAIN_FAN`` neighbouring chunks
    are composed to one of a larger chunk, and so on until a key has no more than that many; then the entry of each chunk
    follows downwards, from larger to smaller ones, and chunks give their kept rows. No task sees all chunks of a key, all
    work is linear in the rows, and the number of levels is the logarithm of the time that is covered. ``staged`` says
    that ``rows`` is cheap to read again; otherwise they are written once first.
    """
    keys, chunk_us = list(keys), CHAIN_WIDTHS * width_us
    base = rows.groupBy(*keys, "ts_us").agg(F.min("pos").alias("pos"))
    base = base if staged else checkpoint(base)
    cut = base.withColumn("_chunk", F.floor(F.col("ts_us") / F.lit(chunk_us)).cast("long"))
    run = F.xxhash64(*keys, "_chunk").alias("_run")

    def in_runs(df: DataFrame) -> DataFrame:
        return df.repartition(*keys, "_chunk").sortWithinPartitions("_run", *keys, "_chunk", "ts_us")

    sample = cut.select(*keys, "_chunk", "ts_us")
    schema = StructType([*sample.schema.fields, StructField("last_us", LongType())])

    def composed(df: DataFrame, span_us: int) -> DataFrame:
        return checkpoint(in_runs(df.select("*", run)).mapInArrow(partial(_chunk_tables, width_us=width_us, chunk_us=span_us), schema))

    def entered(df: DataFrame, entries: DataFrame, within: Column) -> DataFrame:
        """Rows of ``df`` in the chunks (``within``) of ``entries``, with the time at which the chain enters there."""
        entry = entries.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_chunk").alias("_in"), F.col("ts_us").alias("_enter"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], within == F.col("_in"))
        return df.join(entry, same)

    levels = [composed(sample, chunk_us)]
    covered = levels[0].groupBy(*keys).agg((F.max("_chunk") - F.min("_chunk")).alias("n")).agg(F.max("n")).first()[0] or 0
    larger = F.floor(F.col("_chunk") / F.lit(CHAIN_FAN)).cast("long")
    span_us = chunk_us
    while covered >= CHAIN_FAN:
        covered, span_us = covered // CHAIN_FAN + 1, span_us * CHAIN_FAN
        levels.append(composed(levels[-1].withColumn("_chunk", larger), span_us))
    ordered = levels.pop().repartition(*keys).sortWithinPartitions(*keys, "_chunk", "ts_us")
    entries = checkpoint(ordered.mapInArrow(partial(_walk, keys=len(keys), width_us=width_us), sample.schema))
    while levels:
        inner = entered(levels.pop(), entries, larger).where("ts_us >= _enter").select(*keys, F.col("_in").alias("_outer"), "_chunk", "ts_us", "last_us")
        ordered = inner.repartition(*keys, "_outer").sortWithinPartitions(*keys, "_outer", "_chunk", "ts_us")
        walked = ordered.mapInArrow(partial(_walk, keys=len(keys) + 1, width_us=width_us), inner.drop("last_us").schema)
        entries = checkpoint(walked.drop("_outer"))
    bound = entered(cut, entries, F.col("_chunk")).select(*keys, "_chunk", "ts_us", "pos", "_enter", run)
    out = ["ts_us", "pos"]
    return in_runs(bound).mapInArrow(partial(_kept, width_us=width_us, columns=[*keys, *out]), cut.select(*keys, *out).schema)
