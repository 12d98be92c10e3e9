"""A Python worker waits for its next task with little memory of the last one."""

from __future__ import annotations

import pyarrow as pa

from flowloom.llm.common import map_batches


def test_freed_memory_is_returned_when_a_task_ends(spark):
    def own_mb() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    def work(batches, mb):
        import sys

        import numpy as np

        for batch in batches:
            before = own_mb()
            blocks = [np.ones(100_000, dtype=np.uint8) for _ in range(10 * mb)]
            sys.modules["numpy"]._kept_by_test = blocks[-1:]  # lies above the others, so they are free but not at the end of the heap
            full = own_mb()
            del blocks
            yield pa.RecordBatch.from_pydict({"before": [before], "full": [full]}, schema=pa.schema([("before", pa.int64()), ("full", pa.int64())]))

    one = spark.range(1).coalesce(1)
    first = map_batches(one, work, "before long, full long", mb=300).collect()[0]
    again = map_batches(one, work, "before long, full long", mb=1).collect()[0]
    assert first["full"] - first["before"] > 200
    assert again["before"] < first["full"] - 200
