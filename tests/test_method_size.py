"""Stages whose generated method is too large for the JVM's compiler run in small methods."""

from __future__ import annotations


def test_queries_bound_generated_methods(spark):
    """Methods above 8,000 bytes are never compiled by the JVM: queries say so to Spark, which then runs such a stage in small ones."""
    from flowloom.plans import catalog

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    catalog.query("limited")(lambda session, sf_dir: session.range(1))
    try:
        catalog.QUERIES["limited"](spark, "")
    finally:
        del catalog.QUERIES["limited"]
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
