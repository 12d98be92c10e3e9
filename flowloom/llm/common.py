"""Small helpers shared by the operators of this folder.

Every operator takes DataFrames, keeps no state on executors or the driver's disk, and reads inputs only through Spark.
Worker functions use Arrow batches; a worker sees one batch of a partition at a time.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch where texts travel to Python: bounds the memory of a worker.
TEXT_BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; rows without an id count as the text ''."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def fold_of(doc_id: int | None, folds: int) -> int:
    """The same fold inside a worker."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def words_of(text: str | None) -> list[bytes]:
    """Words between white space of ASCII, with A-Z in lower case; other letters stay."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def give_back() -> None:
    """Returns freed memory of this process to the system: Arrow's and, with glibc, that of NumPy and Python."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _then_give_back(batches: Iterator[pa.RecordBatch], work: Callable[..., Iterable[dict | pa.RecordBatch]]) -> Iterator[dict | pa.RecordBatch]:
    """A worker outlives its task and waits beside the next stages: what the task has freed is not kept until then."""
    try:
        yield from work(batches)
    finally:
        give_back()


def map_batches(df: DataFrame, work: Callable[..., Iterable[dict | pa.RecordBatch]], schema: str, **fixed) -> DataFrame:
    """``mapInArrow`` with bounded batches of texts."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    return df.mapInArrow(partial(_then_give_back, work=partial(work, **fixed)), schema)


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """All rows of a partition as tuples, one batch in memory."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic model by Newton's method, drawn to ``prior`` by ``ridge`` (the first one, the bias, barely).

    ``y`` may hold probabilities. The bounded rows that fit a model are all that this sees.
    """
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    w = prior.astype(float).copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - prior)
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w
