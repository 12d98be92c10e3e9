"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: The JVM never compiles a method of more bytes. A stage whose generated method is larger runs operator by operator, in small methods.
METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}

_WRITTEN: list[str] = []


def build_session(app: str = "flowloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **METHOD_LIMIT, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch folder where none is named on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """Deletes the stage tables written inside when it ends. Results that read them must be written by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[before:]:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        del _WRITTEN[before:]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a stage table to the shared folder and read it back.

    Unlike a checkpointed RDD the table is compressed and columnar, so later stages read only the
    columns they use, and lost executors cost no recomputation of what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/flowloom-stage-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
