"""Scalar maths on columns; an undefined value is null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.fixed import FLOW_MODEL_FEATURES


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def finite(value: Column) -> Column:
    value = value.cast("double")
    return F.when(F.abs(value) < float("inf"), value)  # NaN is above all numbers


def population_variance(sample_std: Column, count: Column) -> Column:
    """Population variance from a sample standard deviation over ``count`` values."""
    n = count.cast("double")
    shrink = safe_ratio(F.greatest(n - 1, F.lit(0.0)), n)
    return F.when(n == 1, F.lit(0.0)).otherwise(sample_std * sample_std * shrink)


def pooled_variance(
    n_out: Column, n_in: Column, bytes_out: Column, bytes_in: Column, std_out: Column, std_in: Column
) -> Column:
    """One population variance from two directional sample summaries."""
    mean = safe_ratio(bytes_out + bytes_in, n_out + n_in)

    def spread(n: Column, total: Column, std: Column) -> Column:
        shift = safe_ratio(total, n) - mean
        within = F.greatest(n - 1, F.lit(0)).cast("double") * (std * std)
        return F.when(n > 0, within + n.cast("double") * (shift * shift)).otherwise(F.lit(0.0))

    both = spread(n_out, bytes_out, std_out) + spread(n_in, bytes_in, std_in)
    return safe_ratio(both, n_out + n_in)


def flow_model_values(
    *,
    duration: Column,
    packets_out: Column,
    packets_in: Column,
    payload_out: Column,
    payload_in: Column,
    payload_variance: Column,
    iat_variance: Column,
) -> dict[str, Column]:
    """The ordered model inputs, one definition for labelled tables and for live flows."""
    seconds = duration.cast("double")
    packets = (packets_out + packets_in).cast("double")
    payload = (payload_out + payload_in).cast("double")
    values = (
        seconds,
        packets_out.cast("double"),
        packets_in.cast("double"),
        packets,
        payload_out.cast("double"),
        payload_in.cast("double"),
        payload,
        safe_ratio(payload, packets),
        payload_variance.cast("double"),
        safe_ratio(seconds, packets - 1),
        iat_variance.cast("double"),
        payload_out.cast("double") / (payload_in.cast("double") + 1),
        safe_ratio(packets, seconds),
        safe_ratio(payload, seconds),
    )
    return dict(zip(FLOW_MODEL_FEATURES, values, strict=True))


def entropy_of_counts(counts: Column) -> Column:
    """Shannon entropy in bits of a ``MAP<_, LONG>`` of counts; 0 for an empty map."""
    positive = F.filter(F.map_values(counts), lambda n: n > 0)
    total = F.aggregate(positive, F.lit(0).cast("long"), lambda a, n: a + n)
    bits = F.aggregate(
        positive,
        F.lit(0.0),
        lambda a, n: a + (n / total) * F.log2(total / n),
    )
    return F.when(total > 0, bits).otherwise(F.lit(0.0))


def entropy_from_sums(total: Column, n_log_n: Column) -> Column:
    """The same entropy from N and the sum of n*log2(n), both of which add up over groups."""
    bits = F.log2(total.cast("double")) - n_log_n / total
    return F.when((total > 0) & (bits > 1e-12), bits).otherwise(F.lit(0.0))


def n_log_n(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def exact_variance(count: Column, total: Column, squares: Column) -> Column:
    """Population variance from integer sums; the subtraction is exact before the division."""
    n, s, q = (c.cast("decimal(38,0)") for c in (count, total, squares))
    return F.when(count > 0, (n * q - s * s).cast("double") / (count.cast("double") * count.cast("double")))


def periodicity_from_sums(count: Column, gaps_us: Column, squared_gaps_us: Column) -> dict[str, Column]:
    """Mean interval (s), its coefficient of variation and a regularity score, from gap sums.

    ``count`` is the number of points; the gaps between them number one less.
    """
    m = count - 1
    mean_us = gaps_us / m
    enough = count >= 3
    moving = enough & (gaps_us > 0)
    variation = F.sqrt(F.greatest(exact_variance(m, gaps_us, squared_gaps_us), F.lit(0.0))) / mean_us
    return {
        "mean_connection_interval": F.when(enough, mean_us / 1_000_000),
        "connection_interval_cv": F.when(moving, variation),
        "periodicity_score": F.when(
            moving, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - variation))
        ).when(enough, F.lit(0.0)),
    }


def periodicity(times_us: Column) -> dict[str, Column]:
    """The same three values from an ordered ``ARRAY<LONG>`` of times in microseconds."""
    gaps = F.zip_with(
        F.slice(times_us, 2, F.greatest(F.size(times_us) - 1, F.lit(0))),
        F.slice(times_us, 1, F.greatest(F.size(times_us) - 1, F.lit(0))),
        lambda now, before: F.greatest(now - before, F.lit(0)),
    )
    zero = F.lit(0).cast("long")
    total = F.aggregate(gaps, zero, lambda a, g: a + g)
    squares = F.aggregate(gaps, zero, lambda a, g: a + g * g)
    return periodicity_from_sums(F.size(times_us).cast("long"), total, squares)
