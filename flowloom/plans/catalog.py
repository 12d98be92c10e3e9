"""Registry of runnable queries, each beside its comparison SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.plans import inputs
from flowloom.plans.chain import Stages
from flowloom.session import METHOD_LIMIT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # event times have no zone of their own
            for key, value in METHOD_LIMIT.items():
                spark.conf.set(key, value)
            return run(spark, sf_dir)

        QUERIES[name] = in_utc
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


@lru_cache(maxsize=8)
def _stages(session_id: str, sf_dir: str) -> Stages:
    return Stages(inputs.packets(SparkSession.active(), sf_dir))


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    """Stages over the derived packets, shared by the queries of one session (see ``reset``)."""
    return _stages(spark.sparkContext.applicationId, sf_dir)


def reset() -> None:
    """Forget shared stages, so that the next query builds its whole chain again."""
    _stages.cache_clear()
    _prepared.cache_clear()


@lru_cache(maxsize=8)
def _prepared(session_id: str, sf_dir: str) -> DataFrame:
    from flowloom.operators import labelled
    from flowloom.session import checkpoint

    return checkpoint(labelled.prepared_rows(raw_labelled(SparkSession.active(), sf_dir)))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark.sparkContext.applicationId, sf_dir)


def raw_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived labelled flows under the column names of flow exports."""
    return inputs.labelled_flows(spark, sf_dir).selectExpr(
        "source_name", "source_index", "duration_us as `Flow Duration`", "n_out as `Total Fwd Packets`",
        "n_in as `Total Backward Packets`", "b_out as `Total Length of Fwd Packets`",
        "b_in as `Total Length of Bwd Packets`", "std_out as `Fwd Packet Length Std`",
        "std_in as `Bwd Packet Length Std`", "iat_std_us as `Flow IAT Std`", "label as Label",
    )


def r6(value: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded to six places, and never the negative zero that compares unequal as text."""
    out = F.round(value, digits) + F.lit(0.0)
    return out.alias(name or (value if isinstance(value, str) else "value"))


def big(value: Column | str, name: str | None = None) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("bigint").alias(name or (value if isinstance(value, str) else "value"))


def joined(value: Column | str, name: str) -> Column:
    return F.array_join(value, ",").alias(name)


def load_all() -> None:
    from flowloom.plans import queries_flows, queries_tables  # noqa: F401
