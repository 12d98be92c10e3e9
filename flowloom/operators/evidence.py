"""Evidence gate: does a classification rest on evidence the capture can show?

Policies have one entry per class and become literal maps in the plan, so nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.fixed import (
    BENIGN_CLASSES,
    CAPABILITIES,
    EVIDENCE_POLICY,
    SEVERITY_RULES,
    UNKNOWN_MIN_CONFIDENCE,
)

# --- fixed values: texts of missing evidence ------------------------------------------------------
NO_POLICY = "evidence_policy_not_configured"
NO_THRESHOLD = "validation_threshold_unavailable"
ONE_OF = "one_of:"


def _names(key: str, policy: dict) -> Column:
    """The class's list of names, or an empty list."""
    empty = F.array().cast("array<string>")
    out = empty
    for name, rules in policy.items():
        if rules.get(key):
            out = F.when(F.col("threat_class") == name, F.array(*[F.lit(x) for x in rules[key]])).otherwise(out)
    return out


def _capability(name: Column) -> Column:
    flags = F.create_map(*[x for n in CAPABILITIES for x in (F.lit(n), F.col(f"capabilities.{n}"))])
    return F.coalesce(F.try_element_at(flags, name), F.lit(False))


def missing_capabilities(policy: dict = EVIDENCE_POLICY) -> Column:
    return F.filter(_names("required_capabilities", policy), lambda n: ~_capability(n))


def missing_any_capability(policy: dict = EVIDENCE_POLICY) -> Column:
    names = _names("any_capabilities", policy)
    unmet = (F.size(names) > 0) & ~F.exists(names, lambda n: _capability(n))
    text = F.concat(F.lit(ONE_OF), F.array_join(names, ","))
    return F.when(unmet, F.array(text)).otherwise(F.array().cast("array<string>"))


def missing_evidence(policy: dict = EVIDENCE_POLICY) -> Column:
    c = F.col
    absent = lambda n: F.try_element_at(c("evidence"), n).isNull() & F.try_element_at(
        c("evidence_flags"), n
    ).isNull()
    return F.filter(_names("required_evidence", policy), absent)


def below_minimum(policy: dict = EVIDENCE_POLICY) -> Column:
    out = F.array().cast("array<string>")
    for name, rules in policy.items():
        tests = [
            F.when(
                F.coalesce(
                    F.try_element_at(F.col("evidence"), F.lit(n)),
                    F.try_element_at(F.col("evidence_flags"), F.lit(n)).cast("double"),
                )
                >= least,
                F.lit(None),
            ).otherwise(F.lit(f"{n}>={least}"))
            for n, least in rules.get("minimum_evidence", {}).items()
        ]
        if tests:
            found = F.filter(F.array(*tests), lambda t: t.isNotNull())
            out = F.when(F.col("threat_class") == name, found).otherwise(out)
    return out


def not_true(policy: dict = EVIDENCE_POLICY) -> Column:
    held = lambda n: F.coalesce(F.try_element_at(F.col("evidence_flags"), n), F.lit(False))
    return F.filter(_names("required_true", policy), lambda n: ~held(n))


def missing_list(policy: dict = EVIDENCE_POLICY) -> Column:
    """Everything missing, in order of first mention."""
    none = F.array().cast("array<string>")
    configured = F.col("threat_class").isin(*[n for n, rules in policy.items() if rules])
    return F.array_distinct(
        F.concat(
            F.coalesce(F.col("missing_evidence"), none),
            F.when(~configured, F.array(F.lit(NO_POLICY))).otherwise(none),
            F.when(F.col("class_threshold").isNull(), F.array(F.lit(NO_THRESHOLD))).otherwise(none),
            missing_capabilities(policy),
            missing_any_capability(policy),
            missing_evidence(policy),
            below_minimum(policy),
            not_true(policy),
        )
    )


def evidence_gate(
    verdicts: DataFrame, policy: dict = EVIDENCE_POLICY, unknown_min: float = UNKNOWN_MIN_CONFIDENCE
) -> DataFrame:
    """Add ``gate_missing``, ``decision`` (null: no alert) and ``evidence_quality``.

    Needs threat_class, calibrated_confidence, class_threshold, missing_evidence, evidence,
    evidence_flags and the capabilities struct.
    """
    if not 0 <= unknown_min <= 1:
        raise ValueError("unknown_min must be between 0 and 1")
    c = F.col
    benign = c("threat_class").isin(*BENIGN_CLASSES)
    strong = F.size(_names("required_evidence", policy)) >= 3
    accepted = c("calibrated_confidence") >= c("class_threshold")
    suspicious = c("calibrated_confidence") >= unknown_min
    lacking = F.size("gate_missing") > 0
    gated = verdicts.withColumn(
        "gate_missing", F.when(benign, F.array().cast("array<string>")).otherwise(missing_list(policy))
    )
    return gated.withColumn(
        "decision",
        F.when(benign, F.lit(None))
        .when(lacking, "INSUFFICIENT_EVIDENCE")
        .when(accepted, "ACCEPT")
        .when(suspicious, "UNKNOWN_SUSPICIOUS"),
    ).withColumn(
        "evidence_quality",
        F.when(benign, "ADEQUATE")
        .when(lacking, "INSUFFICIENT")
        .when(accepted, F.when(strong, "STRONG").otherwise("ADEQUATE"))
        .when(suspicious, "ADEQUATE")
        .otherwise("WEAK"),
    )


def severity(threat_class: Column, rules: dict[str, str] = SEVERITY_RULES) -> Column:
    """Configured severity; an unmapped class takes the UNKNOWN rule, else LOW."""
    out = F.lit(rules.get("UNKNOWN", "LOW"))
    for name, level in rules.items():
        out = F.when(threat_class == name, F.lit(level)).otherwise(out)
    return out


def with_threshold(verdicts: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    out = F.lit(None).cast("double")
    for name, value in thresholds.items():
        out = F.when(F.col("threat_class") == name, F.lit(float(value))).otherwise(out)
    return verdicts.withColumn("class_threshold", out)
